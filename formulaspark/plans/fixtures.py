"""Tables of symbols, formulas, pixels and labels that Spark derives from the star-schema
tables; the same SQL text (as common table expressions) serves the DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SYMBOLS = """
SELECT formula_id, CAST(sym_idx AS INT) AS sym_idx,
 CAST(10 + 34*sym_idx + s % 7 - CASE WHEN k IN (4,5) AND s % 2 = 0 THEN 34 ELSE 0 END AS INT) AS x,
 CAST(CASE WHEN k <= 3 THEN 50 WHEN k = 4 AND s % 2 = 0 THEN 5 WHEN k = 4 THEN 34
   WHEN k = 5 AND s % 2 = 0 THEN 95 WHEN k = 5 THEN 76 WHEN k = 6 THEN 62
   WHEN s % 3 = 0 THEN 35 ELSE 40 END AS INT) AS y,
 CAST(CASE WHEN k <= 3 THEN 20 + s % 10 WHEN k IN (4,5) THEN 10 + s % 3
   WHEN k = 6 THEN 60 + s % 20 WHEN s % 3 = 0 THEN 90 ELSE 6 END AS INT) AS w,
 CAST(CASE WHEN k <= 3 THEN 30 + p % 12 WHEN k IN (4,5) THEN 13 + p % 3
   WHEN k = 6 THEN 3 WHEN s % 3 = 0 THEN 60 ELSE 6 END AS INT) AS h,
 substr('0123456789xyzabcnkOolISZBG', CAST(1 + (p + s) % 26 AS INT), 1) AS label,
 CAST(0.5 + (p % 50) / 100.0 AS DOUBLE) AS confidence,
 (k = 6) AS is_fraction_line, (k = 7 AND s % 3 = 0) AS is_sqrt,
 (p % 40 = 3) AS is_sum, (p % 40 = 11) AS is_integral
FROM (SELECT l_orderkey AS formula_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS sym_idx,
  l_partkey AS p, l_suppkey AS s, l_partkey % 8 AS k FROM {lineitem}) b"""

#: The formulas that the LaTeX table repeats; @ is a letter, # a digit.
TEMPLATES = [
    r"@^2 - # = 0",
    r"@^2 + 2@ + 1",
    r"\frac{@^2 - 1}{@ - 1}",
    r"\sin^2(@) + \cos^2(@)",
    r"\frac{d}{d@} @^3",
    r"\int @^2 d@",
    r"\lim_{@ \to 0} @",
    r"\sum_{i=1}^{n} @",
    r"\prod_{i} @",
    r"\begin{pmatrix} @ & # \end{pmatrix}",
    r"A \cap B \subseteq C",
    r"\forall @ \exists y",
    r"\mathbb{R}",
    r"f(@) = # @",
    r"@ \leq #",
    r"(@ + #",
    r"@ ++ #",
    r"* @ + #",
    r"@ + # *",
    r"@ \infty",
    r"\left( @ \right)",
    r"\{ @ \} = #",
    "   ",
    r"\frac{@}{0} + \mathscr{L} \times \sqrt{#}",
]

#: Formulas that are computed; @ and # are numbers from 1 to 7 and 1 to 5.
WORKED = [
    r"(x+@)(x-#)^{2}",
    r"\frac{d}{dx} (@ x^{3} + # x)",
    r"\int (@ x^{2} - #) dx",
    r"\int_{0}^{#} @ x dx",
    r"\lim_{x \to #} (x+@)^2",
    r"(x-@)(x+#) = 0",
    r"\frac{1}{2}x^{2} \cdot @",
    r"{x}^{2} - @ = #",
    r"\left(x-@\right)\left(x-#\right)",
    r"x^2 + @ = 0",
    r"@ y - # = z",
    r"(x + @ = #",
]

#: Sides of the pictures, and how often a number of a vector is repeated each way.
SIDE, TIMES = 32, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that a task numbers at most, on average.
LINES = 500_000


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of formulas: one shuffle, on the formula, to more tasks where there are more lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = -(-lines.count() // LINES)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.repartition(parts, "l_orderkey")
    return spark.sql(_SYMBOLS, lineitem=lines)


def latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``formula_id, latex``: templates filled by order and customer."""
    templates = F.array(*[F.lit(t) for t in TEMPLATES])
    text = F.element_at(templates, (F.col("o_orderkey") % 24 + 1).cast("int"))
    letter, digit = F.chr(F.lit(97) + F.col("o_custkey") % 26), (F.col("o_orderkey") % 9 + 1).cast("string")
    filled = F.replace(F.replace(text, F.lit("@"), letter), F.lit("#"), digit)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("formula_id"), filled.alias("latex"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``formula_id, power, coef``: a quadratic per part."""
    part = table(spark, sf_dir, "part")
    coef = [F.col("p_size") % 7 - 3, F.col("p_partkey") % 11 - 5, F.col("p_partkey") % 3]
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("power"), c.cast("double").alias("coef")) for p, c in enumerate(coef)]))
    return part.select(F.col("p_partkey").alias("formula_id"), rows.alias("t")).select("formula_id", "t.power", "t.coef")


def worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``formula_id, latex``: formulas that are computed, one per part."""
    part = table(spark, sf_dir, "part")
    text = F.element_at(F.array(*[F.lit(t) for t in WORKED]), (F.col("p_partkey") % len(WORKED) + 1).cast("int"))
    a, b = (F.col("p_size") % 7 + 1).cast("string"), (F.expr("p_partkey div 12") % 5 + 1).cast("string")
    return part.select(F.col("p_partkey").alias("formula_id"), F.replace(F.replace(text, F.lit("@"), a), F.lit("#"), b).alias("latex"))


#: Formulas that a task computes at most, on average.
FORMULAS = 20_000


def spread(formulas: DataFrame) -> DataFrame:
    """``formulas`` dealt to as many tasks as their number asks for: a file that one task reads may hold hours of work."""
    parts = -(-formulas.count() // FORMULAS)
    return formulas.repartition(parts, "formula_id", "latex") if parts > 1 else formulas


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, y, x, v``: each vector's signs as an 8 by 8 picture, four pixels a number each
    way, as ink on paper."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "e"))
    step = F.sequence(F.lit(0), F.lit(TIMES - 1))
    e = e.withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step))
    e = e.select("image_id", "e", (F.expr("pos div 8") * TIMES + F.col("dy")).cast("int").alias("y"), (F.col("pos") % 8 * TIMES + F.col("dx")).cast("int").alias("x"))
    v = F.when(F.col("e") > 0, 20 + (7 * F.col("x") + 13 * F.col("y")) % 30).otherwise(225 + (3 * F.col("x") + 5 * F.col("y")) % 20)
    return e.select("image_id", "y", "x", v.cast("int").alias("v"))


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, y, x, v, ink``: each vector of 64 numbers as an 8 by 8 picture."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "e"))
    e = e.withColumn("e", F.col("e").cast("double"))
    return e.select(
        "vec_id", "label", F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), F.floor(128 + 240 * F.col("e")).cast("int").alias("v"), (F.col("e") > 0).alias("ink")
    )


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, y, pred``: labels, and predictions that are wrong for every fifth id."""
    wrong = F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("y"), wrong.cast("int").alias("pred"))


#: Labels of the ten candidates.
CANDIDATES = "0OolIx5S2Z"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, idx, prob, label``: probabilities of ten candidates per vector, each from the components at every tenth place."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    # whole numbers, so that sums do not depend on their order
    e = e.groupBy("vec_id", (F.col("pos") % 10).alias("idx")).agg(F.sum(F.floor(F.abs(F.col("x").cast("double")) * 1000000)).alias("a"))
    e = e.withColumn("total", F.sum("a").over(Window.partitionBy("vec_id")))
    return e.select("vec_id", "idx", (F.col("a") / F.col("total")).alias("prob"), F.substring(F.lit(CANDIDATES), F.col("idx") + 1, F.lit(1)).alias("label"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Common table expressions of the DuckDB twins, by name, and what each needs.
CTES = {
    "symbols": (_SYMBOLS.format(lineitem="lineitem"), ()),
    "latex": (
        "SELECT o_orderkey AS formula_id, replace(replace(list_extract(["
        + ", ".join(map(_quoted, TEMPLATES))
        + "], CAST(o_orderkey % 24 + 1 AS INT)), '@', chr(CAST(97 + o_custkey % 26 AS INT))), '#', CAST(o_orderkey % 9 + 1 AS VARCHAR)) AS latex FROM orders",
        (),
    ),
    "terms": (
        "SELECT p_partkey AS formula_id, CAST(power AS INT) AS power, CAST(CASE power WHEN 0 THEN p_size % 7 - 3 WHEN 1 THEN p_partkey % 11 - 5 ELSE p_partkey % 3 END AS DOUBLE) AS coef"
        " FROM part, (VALUES (0), (1), (2)) t(power)",
        (),
    ),
    "worked": (f"SELECT p_partkey AS formula_id, p_partkey % {len(WORKED)} AS kind, p_size % 7 + 1 AS a, p_partkey // 12 % 5 + 1 AS b FROM part", ()),
    "pixels": (
        f"SELECT image_id, y, x, CAST(CASE WHEN ink THEN 20 + (7*x + 13*y) % 30 ELSE 225 + (3*x + 5*y) % 20 END AS INT) AS v FROM (SELECT vec_id AS image_id, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x,"
        f" embedding[8 * (yy // {TIMES}) + xx // {TIMES} + 1] > 0 AS ink FROM embeddings, range({SIDE}) a(yy), range({SIDE}) b(xx))",
        (),
    ),
    "glyphs": (
        "SELECT vec_id, label, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, CAST(floor(128 + 240 * CAST(embedding[p + 1] AS DOUBLE)) AS INT) AS v, embedding[p + 1] > 0 AS ink"
        " FROM embeddings, range(64) r(p)",
        (),
    ),
    "report": ("SELECT vec_id, label AS y, CAST(CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS INT) AS pred FROM embeddings", ()),
    "candidates": (
        "SELECT vec_id, idx, CAST(a AS DOUBLE) / sum(a) OVER (PARTITION BY vec_id) AS prob,"
        f" substr('{CANDIDATES}', idx + 1, 1) AS label FROM (SELECT vec_id, CAST(p % 10 AS INT) AS idx, sum(CAST(floor(abs(CAST(embedding[p + 1] AS DOUBLE)) * 1000000) AS BIGINT)) AS a FROM embeddings, range(64) r(p) GROUP BY ALL)",
        (),
    ),
}


def with_tables(body: str, *names: str) -> str:
    """``body`` after the expressions that it names and those that these need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][1]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.lstrip().startswith(start):
            return f"{start}{head}, {body.lstrip()[len(start):]}"
    return f"WITH {head} {body}"
