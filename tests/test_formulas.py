from pyspark.sql import functions as F

from formulaspark.functions import latex as L
from formulaspark.operators import polynomials as Y
from formulaspark.plans.pipelines import process_semantic


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "latex string").select(make(F.col("latex")).alias("r")).first()["r"]


def test_classes(spark):
    cases = {
        "x^2 = 4": "equation",
        "x^2 + 2x + 1": "expression",
        r"\int x dx": "integral",
        r"\frac{d}{dx} x^2": "derivative",
        r"\infty": "set_expression",
        r"\left( x \right)": "inequality",
        "f(x) = 2": "function_def",
        r"\mathbb{R}": "number_set",
    }
    rows = spark.createDataFrame(list(cases.items()), "latex string, want string").withColumn("got", L.classify_formula(F.col("latex"))).collect()
    assert [(r.latex, r.got) for r in rows] == [(r.latex, r.want) for r in rows]
    assert one(spark, r"\int x dx", lambda c: L.classify_formula(c, "literal")) == "set_expression"


def test_checks(spark):
    assert one(spark, "x + y + z", L.variables) == ["x", "y", "z"]
    assert len(one(spark, "(x + 1", L.bracket_errors)) == 1
    assert one(spark, "x ++ 1 +", L.operator_errors) == ["operators ++", "ends with an operator"]
    assert one(spark, "x -", L.operator_errors) == []
    assert one(spark, r"\frac{x}{0}", L.zero_division) == ["division by zero"]
    assert one(spark, r"\frac{x}{05}", L.zero_division) == []
    assert one(spark, "a + b", L.format_latex) == "a  +  b"
    assert one(spark, "{a", L.format_latex) == "{a}"


def test_labels(spark):
    labels = ["alpha", "eq", "#", "x", None, "mathbb{N}", "unknown", "12"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, v string").select("i", L.symbol_latex(F.col("v")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == [r"\alpha", "=", r"\#", "x", "", r"\mathbb{N}", "unknown", "12"]


def test_record_of_blank_null_and_empty(spark):
    rows = process_semantic(spark.createDataFrame([(1, "  "), (2, None), (3, "x = 1")], "formula_id long, latex string")).orderBy("formula_id").collect()
    assert [r.formula_type for r in rows] == ["unknown", "unknown", "equation"]
    assert rows[0].errors and rows[1].errors and not rows[2].errors
    assert process_semantic(spark.createDataFrame([], "formula_id long, latex string")).count() == 0


def test_semantics_need_no_exchange(spark):
    plan = process_semantic(spark.createDataFrame([(1, "x")], "formula_id long, latex string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_polynomials(spark):
    f = spark.createDataFrame([(1, "x^2 - 4 = 0"), (2, "x^3"), (3, "sin(x)"), (4, "2x + 3x - y")], "formula_id long, latex string")
    terms = Y.to_terms(f)
    assert {r.formula_id for r in terms.collect()} == {1, 2}
    assert [(r.root1, r.root2) for r in Y.solve(terms.where("formula_id = 1")).collect()] == [(-2.0, 2.0)]
    assert [(r.power, r.coef) for r in Y.derivative(Y.simplify(terms.where("formula_id = 2"))).collect()] == [(2, 3.0)]
    back = Y.derivative(Y.integral(Y.simplify(terms.where("formula_id = 2")))).collect()
    assert [(r.power, r.coef) for r in back] == [(3, 1.0)]
    assert Y.to_latex(Y.simplify(terms)).where("formula_id = 1").first()["latex"] == "x^{2} - 4"


def test_solved_records(spark):
    from formulaspark.plans.pipelines import solved_records

    rows = [(1, "x^2 - 4 = 0"), (2, "2y = 3"), (3, "x^2 + 1 = 0"), (4, "(x = 1"), (5, "x^2 - 4"), (6, None), (7, "x y = 1")]
    got = {r.formula_id: r for r in solved_records(spark.createDataFrame(rows, "formula_id long, latex string")).collect()}
    assert got[1].solution == {"degree": "2", "solutions": "-2.0, 2.0"} and got[1].interpretation.endswith("Solutions: -2.0, 2.0.")
    assert (got[2].root1, got[2].root2) == (1.5, None)
    assert "no real solution was found" in got[3].warnings and got[3].solution is None
    assert all(got[i].root1 is None for i in (4, 5, 6, 7))


def test_latex_of_many_terms(spark):
    from formulaspark.operators import polynomials as Y

    rows = [(1, p, 1.0 if p % 2 else -2.5) for p in range(400)]
    got = Y.to_latex(spark.createDataFrame(rows, "formula_id long, power int, coef double")).first()["latex"]
    assert len(got) > 3000 and got.startswith("x^{399} - 2.5x^{398}") and got.endswith(" - 2.5")


def test_formulas_that_one_task_reads_are_computed_by_many(spark, tmp_path, monkeypatch):
    from formulaspark.plans import fixtures as T
    from formulaspark.plans import queries_formulas as Q

    part = spark.range(1200).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    want = Q.computed_solutions(spark, str(tmp_path)).collect()
    assert T.spread(T.worked(spark, str(tmp_path))).rdd.getNumPartitions() == 1
    monkeypatch.setattr(T, "FORMULAS", 100)
    assert T.spread(T.worked(spark, str(tmp_path))).rdd.getNumPartitions() == 12
    for name in ("computed_solutions", "computed_results", "expanded_terms"):
        assert "RepartitionByExpression" in Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(Q.computed_solutions(spark, str(tmp_path)).collect()) == sorted(want) and len(want) == 1000
