from formulaspark.plans.pipelines import process_semantic
from formulaspark.streaming.formulas import each_batch, stream_semantics


def test_streams_give_what_tables_give(spark, tmp_path):
    rows = [(1, "x = 1"), (2, "(a"), (3, r"\mathbb{R}")]
    table = spark.createDataFrame(rows, "formula_id long, latex string")
    table.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = each_batch(stream_semantics(spark, str(tmp_path / "in")), lambda b: b, out, str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.formula_id: (r.formula_type, r.errors) for r in spark.read.parquet(out).collect()}
    assert got == {r.formula_id: (r.formula_type, r.errors) for r in process_semantic(table).collect()}


def test_a_batch_that_runs_again_replaces_what_it_left(spark, tmp_path):
    """A batch that was written but not committed comes again; its rows stay single."""
    import shutil

    spark.createDataFrame([(1, "x = 1"), (2, "y")], "formula_id long, latex string").write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: each_batch(stream_semantics(spark, str(tmp_path / "in")), lambda b: b, out, state).trigger(availableNow=True).start().awaitTermination()
    run()
    shutil.rmtree(tmp_path / "state" / "commits")  # as if the query had died after the write
    run()
    assert sorted(r.formula_id for r in spark.read.parquet(out).collect()) == [1, 2]
