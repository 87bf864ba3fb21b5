"""Polynomials in one variable as tables of terms: ``formula_id, power, coef``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One term: a number, a power of a letter, or both.
TERM = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?[a-z](?:\^[0-9]+)?|[0-9]+(?:\.[0-9]+)?|[a-z](?:\^[0-9]+)?)"
SIDE = rf"(?:{TERM})(?:[+-](?:[0-9]+(?:\.[0-9]+)?[a-z](?:\^[0-9]+)?|[0-9]+(?:\.[0-9]+)?|[a-z](?:\^[0-9]+)?))*"
WHOLE = rf"^{SIDE}(?:={SIDE})?$"


def to_terms(formulas: DataFrame) -> DataFrame:
    """``formula_id, side, power, coef`` of formulas that match the grammar as a whole and
    use one letter at most; others give no rows."""
    text = F.replace(F.regexp_replace("latex", r"\s+", ""), F.lit("*"), F.lit(""))
    letters = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z]"), F.lit(0))))
    kept = formulas.withColumn("text", text).where(F.col("text").rlike(WHOLE) & (letters <= 1))
    sides = kept.select("formula_id", F.posexplode(F.split("text", "=")).alias("side", "part"))
    terms = sides.select("formula_id", "side", F.explode(F.regexp_extract_all("part", F.lit(TERM), F.lit(0))).alias("t"))
    number = F.regexp_extract("t", r"^[+-]?([0-9]+(?:\.[0-9]+)?)?", 1)
    size = F.when(number == "", 1.0).otherwise(number.try_cast("double"))
    raised = F.regexp_extract("t", r"\^([0-9]+)$", 1)
    power = F.when(~F.col("t").rlike("[a-z]"), 0).when(raised == "", 1).otherwise(raised.try_cast("int"))
    return terms.select("formula_id", "side", power.alias("power"), F.when(F.col("t").startswith("-"), -size).otherwise(size).alias("coef"))


def simplify(terms: DataFrame) -> DataFrame:
    """Like terms combined, zeros dropped; a ``side`` column brings the right side to the left."""
    coef = F.when(F.col("side") == 1, -F.col("coef")).otherwise(F.col("coef")) if "side" in terms.columns else F.col("coef")
    return terms.groupBy("formula_id", "power").agg(F.sum(coef).alias("coef")).where("coef <> 0")


def derivative(terms: DataFrame) -> DataFrame:
    return terms.where("power > 0 and coef <> 0").select("formula_id", (F.col("power") - 1).alias("power"), (F.col("coef") * F.col("power")).alias("coef"))


def integral(terms: DataFrame) -> DataFrame:
    """Antiderivative without its constant."""
    return terms.where("coef <> 0").select("formula_id", (F.col("power") + 1).alias("power"), (F.col("coef") / (F.col("power") + 1)).alias("coef"))


def value_at(terms: DataFrame, point: float) -> DataFrame:
    """``formula_id, value``: also the limit at ``point``, as polynomials are continuous."""
    return terms.groupBy("formula_id").agg(F.sum(F.col("coef") * F.pow(F.lit(float(point)), F.col("power"))).alias("value"))


def definite_integral(terms: DataFrame, a: float, b: float) -> DataFrame:
    p = F.col("power")
    return integral(terms).groupBy("formula_id").agg(F.sum(F.col("coef") * (F.pow(F.lit(float(b)), p) - F.pow(F.lit(float(a)), p))).alias("value"))


def solve(terms: DataFrame) -> DataFrame:
    """``formula_id, degree, root1, root2``: real roots in order for degrees 1 and 2, else null."""
    c = lambda p: F.sum(F.when(F.col("power") == p, F.col("coef")).otherwise(0.0))
    top = F.coalesce(F.max(F.when(F.col("coef") != 0, F.col("power"))), F.lit(0))
    q = simplify(terms).groupBy("formula_id").agg(top.alias("degree"), c(0).alias("c"), c(1).alias("b"), c(2).alias("a"))
    d = F.col("b") * F.col("b") - 4 * F.col("a") * F.col("c")
    half = F.sqrt(F.greatest(d, F.lit(0.0)))
    low, high = F.try_divide(-F.col("b") - half, 2 * F.col("a")), F.try_divide(-F.col("b") + half, 2 * F.col("a"))
    real = (F.col("degree") == 2) & (d >= 0)
    one = F.try_divide(-F.col("c"), F.col("b"))
    return q.select(
        "formula_id",
        "degree",
        F.when(F.col("degree") == 1, one).when(real, F.least(low, high)).alias("root1"),
        F.when(real & (d > 0), F.greatest(low, high)).alias("root2"),
    )


def to_latex(terms: DataFrame, letter: str = "x") -> DataFrame:
    """``formula_id, latex``, powers descending; whole coefficients without a point."""
    size = F.abs("coef")
    shown = F.when(size == F.floor(size), size.cast("long").cast("string")).otherwise(size.cast("string"))
    body = (
        F.when(F.col("power") == 0, shown)
        .when(size == 1, F.lit(letter))
        .otherwise(F.concat(shown, F.lit(letter)))
    )
    body = F.when(F.col("power") > 1, F.concat(body, F.lit("^{"), F.col("power").cast("string"), F.lit("}"))).otherwise(body)
    term = F.concat(F.when(F.col("coef") < 0, " - ").otherwise(" + "), body)
    rows = F.array_sort(F.collect_list(F.struct(-F.col("power").alias("p"), term.alias("t"))))
    joined = terms.where("coef <> 0").groupBy("formula_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("s"))
    first = F.when(F.col("s").startswith(" - "), F.concat(F.lit("-"), F.expr("substring(s, 4)"))).otherwise(F.expr("substring(s, 4)"))
    return joined.select("formula_id", first.alias("latex"))
