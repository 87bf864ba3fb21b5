"""Image folders, formula tables and results in Spark's own sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EXTENSION = r"(?i)\.(png|jpe?g|bmp)$"


def _gray(images: DataFrame) -> DataFrame:
    """Mode bytes to gray bytes: one byte stays, three or four (blue, green, red) are weighed."""
    n = F.col("image.nChannels")
    byte = lambda i: F.conv(F.hex(F.substring(F.col("image.data"), i + 1, F.lit(1))), 16, 10).cast("int")
    at = F.sequence(F.lit(0), F.col("image.width") * F.col("image.height") - 1)
    gray = F.transform(at, lambda i: F.lpad(F.hex(F.floor(0.299 * byte(i * n + 2) + 0.587 * byte(i * n + 1) + 0.114 * byte(i * n) + 0.5).cast("int")), 2, "0"))
    return images.withColumn("gray", F.when(n == 1, F.col("image.data")).otherwise(F.unhex(F.array_join(gray, ""))))


#: Columns of Spark's image source.
IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def _named(raw: DataFrame) -> DataFrame:
    raw = _gray(raw.where(F.col("image.origin").rlike(_EXTENSION)))
    return raw.select(F.col("image.origin").alias("image_id"), "image.height", "image.width", F.lit(1).alias("n_channels"), F.col("gray").alias("data"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, height, width, n_channels, data``, gray; files that cannot be decoded are left out."""
    return _named(spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path))


def stream_images(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_images``, a stream of the files that come to a folder."""
    return _named(spark.readStream.format("image").schema(IMAGE).option("dropInvalid", True).load(path))


def read_training_images(spark: SparkSession, root: str) -> DataFrame:
    """As ``read_images``, with ``label``: the name of the folder."""
    images = read_images(spark, root)
    return images.withColumn("label", F.url_decode(F.regexp_extract("image_id", r"([^/]+)/[^/]+$", 1)))


def load_summary(images: DataFrame) -> DataFrame:
    """``n_images, n_classes``."""
    return images.agg(F.count("*").alias("n_images"), F.count_distinct("label").alias("n_classes"))


def label_counts(images: DataFrame) -> DataFrame:
    """``label, n``: images of each label, most first."""
    return images.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def read_latex(spark: SparkSession, path: str) -> DataFrame:
    """``formula_id, latex`` from lines of text; equal lines are formulas of their own."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("formula_id"), F.col("value").alias("latex"))


def write_results(results: DataFrame, path: str, kind: str = "parquet") -> None:
    results.write.format(kind).mode("errorifexists").save(path)


def compose_layout(specs: DataFrame, gap: int = 2) -> DataFrame:
    """``name, part, pos, label, x, y, w, h`` of composed formulas.

    ``specs`` has ``name, part`` (upper, lower or main), ``pos, label, w, h``.  Parts run from
    the left with ``gap`` between; upper and lower rows are centred over each other with a
    line of two pixels between.
    """
    from pyspark.sql import Window

    row = Window.partitionBy("name", "part").orderBy("pos")
    whole = Window.partitionBy("name")
    s = specs.withColumn("x", F.coalesce(F.sum(F.col("w") + gap).over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = Window.partitionBy("name", "part")
    s = s.withColumns({"row_w": F.max(F.col("x") + F.col("w")).over(part), "row_h": F.max("h").over(part)})
    s = s.withColumns({"all_w": F.max("row_w").over(whole), "upper_h": F.max(F.when(F.col("part") == "upper", F.col("row_h")).otherwise(0)).over(whole)})
    left = F.expr("(all_w - row_w) div 2")
    top = F.when(F.col("part") == "lower", F.col("upper_h") + 2 * gap + 2).otherwise(0) + F.expr("(row_h - h) div 2")
    return s.select("name", "part", "pos", "label", (F.col("x") + left).cast("long").alias("x"), top.cast("long").alias("y"), "w", "h")
