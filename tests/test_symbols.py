from pyspark.sql import functions as F

from formulaspark.functions.geometry import Box
from formulaspark.operators import components as C
from formulaspark.operators import recognition as M
from formulaspark.operators import structure as R

FLAGS = "is_fraction_line boolean, is_sqrt boolean, is_sum boolean, is_integral boolean"


def symbols(spark, rows):
    flags = {"line": 0, "root": 1, "sum": 2, "int": 3}
    full = [(*r[:6], r[6], *[k == flags.get(r[7] if len(r) > 7 else "") for k in range(4)]) for r in rows]
    return spark.createDataFrame(full, f"formula_id long, sym_idx int, x int, y int, w int, h int, label string, {FLAGS}")


def test_boxes(spark):
    a, b = Box.of("a"), Box.of("b")
    cases = [(0, 0, 100, 100, 50, 50, 100, 100), (0, 0, 50, 50, 100, 100, 50, 50), (0, 0, 100, 100, 50, 0, 100, 100), (0, 0, 9, 9, 0, 0, 9, 9)]
    d = spark.createDataFrame(cases, "ax int, ay int, aw int, ah int, bx int, by int, bw int, bh int")
    rows = d.select(a.intersection(b).alias("i"), a.iou(b).alias("iou")).collect()
    assert tuple(rows[0].i) == (50, 50, 50, 50) and rows[1].i is None and rows[1].iou == 0
    assert abs(rows[2].iou - 1 / 3) < 1e-9 and rows[3].iou == 1


def test_relations(spark):
    s = symbols(spark, [(1, 0, 10, 50, 20, 30, "a"), (1, 1, 50, 50, 20, 30, "b"), (2, 0, 10, 50, 30, 40, "x"), (2, 1, 45, 35, 12, 15, "2")])
    rel = {(r.formula_id, r.i, r.j): r.rel for r in R.spatial_relations(s).collect()}
    assert rel[1, 0, 1] == "right" and rel[2, 0, 1] == "superscript"
    moved = {(r.formula_id, r.i, r.j): r.rel for r in R.spatial_relations(s.withColumn("x", F.col("x") + 700)).collect()}
    assert moved == rel


def test_symbols_to_latex(spark):
    s = symbols(
        spark,
        [
            (1, 0, 10, 50, 30, 40, "x"),
            (1, 1, 45, 30, 15, 20, "2"),
            (1, 2, 80, 55, 25, 30, "+"),
            (1, 3, 130, 50, 30, 40, "y"),
            (2, 0, 10, 50, 40, 3, "line", "line"),
            (2, 1, 20, 15, 20, 25, "a"),
            (2, 2, 20, 62, 20, 25, "b"),
            (3, 0, 10, 50, 20, 30, None),
            (4, 0, 10, 10, 90, 60, "sqrt", "root"),
            (4, 1, 60, 25, 20, 30, "x"),
        ],
    )
    got = {r.formula_id: r.latex for r in R.analyze_structure(s).collect()}
    assert got == {1: "{x}^{2} + y", 2: r"\frac{a}{b}", 3: "", 4: r"\sqrt{x}"}
    literal = {r.formula_id: r.latex for r in R.render_latex(R.build_syntax_tree(s, literal=True)).collect()}
    assert literal[2] != got[2]
    assert all(t.count("{") == t.count("}") for t in got.values())


def test_empty(spark):
    s = symbols(spark, [(1, 0, 0, 0, 0, 0, "x")]).where("false")
    assert R.spatial_relations(s).count() == R.analyze_structure(s).count() == R.reading_order(s).count() == 0


def test_merge_is_an_equivalence(spark):
    comps = spark.createDataFrame([(1, i, 10 * i, 0, 5, 5, 25) for i in range(6)], "image_id long, comp_id int, x int, y int, w int, h int, area long")
    edges = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 1, 3)], "image_id long, a int, b int")
    got = {(r.comp_id, r.x, r.w, r.area) for r in C.merge_components(comps, edges).collect()}
    assert got == {(0, 0, 45, 75), (1, 10, 25, 50), (5, 50, 5, 25)}


def test_candidates_descend_and_ties_take_the_higher_index(spark):
    p = spark.createDataFrame([(1, 0, 0.2, "a"), (1, 1, 0.4, "b"), (1, 2, 0.2, "c"), (1, 3, 0.2, "d")], "vec_id long, idx int, prob double, label string")
    assert [r.label for r in M.top_candidates(p).orderBy("rank").collect()] == ["b", "d", "c"]


def test_recognition_without_model(spark):
    s = symbols(spark, [(1, 0, 0, 0, 9, 9, "q"), (1, 1, 0, 0, 90, 3, "q", "line")])
    got = {r.sym_idx: (r.label, r.confidence) for r in M.recognize_symbols(s, None).collect()}
    assert got == {0: ("symbol_0", 0.0), 1: ("fraction_line", 1.0)}


def test_report_counts(spark):
    rows = M.classification_report(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, pred int")).orderBy("label").collect()
    assert [(r.label, r.support) for r in rows] == [(0, 2), (1, 1), (2, 1)]
    assert rows[1].precision == round(1 / 3, 6) and rows[2].f1 == 0


def test_registered_forest_has_the_operator_s_size(monkeypatch):
    from formulaspark.plans import queries_symbols as Q

    class Frame:
        withColumn = where = select = lambda self, *_: self

    given = {}
    monkeypatch.setattr(Q, "_vectors", lambda *_: Frame())
    monkeypatch.setattr(Q.M, "stratified_split", lambda v: v)
    monkeypatch.setattr(Q.M, "fit_classifier", lambda train, kind, **sizes: given.update(sizes))
    monkeypatch.setattr(Q.M, "predict", lambda *_: Frame())
    monkeypatch.setattr(Q, "F", __import__("unittest.mock").mock.MagicMock())
    Q.random_forest(None, None)
    assert given == {}


def test_trees_as_json(spark):
    import json

    rows = [(1, 0, None, None, 0, "expression", None), (1, 1, 0, None, 0, "fraction", None), (1, 2, 1, "numerator", 0, "expression", None), (1, 3, 2, None, 0, "symbol", 'a"\\b'), (1, 4, 1, "denominator", 1, "expression", None), (1, 5, 4, None, 1, "symbol", "y"), (1, 6, 4, None, 0, "symbol", "x")]
    nodes = spark.createDataFrame(rows, "formula_id long, node_id int, parent_id int, role string, ord int, node_type string, value string")
    leaf = lambda v: {"type": "symbol", "value": v, "children": []}
    part = lambda *kids: {"type": "expression", "children": list(kids)}
    want = part({"type": "fraction", "children": [part(leaf('a"\\b')), part(leaf("x"), leaf("y"))]})
    assert json.loads(R.tree_json(nodes).first()["tree"]) == want


def test_large_operators_by_label(spark):
    rows = [(1, 0, "sum"), (1, 1, "int"), (1, 2, "x"), (1, 3, None), (1, 4, "unknown")]
    got = R.flag_large_operators(spark.createDataFrame(rows, "formula_id long, sym_idx int, label string").withColumn("is_sum", F.lit(False))).orderBy("sym_idx").collect()
    assert [(r.is_sum, r.is_integral) for r in got] == [(True, False), (False, True), (False, False), (False, False), (False, False)]


def test_pairs_stay_with_their_formula(spark, monkeypatch):
    """Pairs are compared within the task of their formula: no join or exchange has a row a pair."""
    rows = [(f, i, 10 + 34 * i, 50 if i % 3 else 20, 20, 12 + i % 5, "x", i == 2, i == 4, i == 5, i == 6) for f in range(3) for i in range(9)]
    s = spark.createDataFrame(rows, "formula_id long, sym_idx int, x int, y int, w int, h int, label string, is_fraction_line boolean, is_sqrt boolean, is_sum boolean, is_integral boolean")
    for made in (R.spatial_relations(s), R.structure_groups(s), R.script_anchors(s), R.syntax_trees(s), R.tree_json(R.syntax_trees(s)), R.tree_text(R.syntax_trees(s))):
        text = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in text and "Generate" not in text
    # the same whether a task compares all pairs at once or one symbol's at a time
    whole = sorted(map(tuple, R.structure_groups(s).collect()), key=str), sorted(map(tuple, R.spatial_relations(s).collect()))
    assert len(whole[0]) and len(whole[1])
    batch = R._by_formula(s).toArrow().to_batches()[0]
    f = R.Formulas.read(batch)
    once = [c.tolist() for c in next(f.links())]
    monkeypatch.setattr(R, "PAIRS", 5)
    parts = [[c.tolist() for c in part] for part in f.links()]
    assert len(parts) > 9 and [sum(c, []) for c in zip(*parts, strict=True)] == once


def test_ranks_are_those_of_reading_order(spark):
    rows = [(f, i, (i * 37 + f) % 50, (i * 23) % 40, 9, 7 + i % 4) for f in range(4) for i in range(f, 8)]
    s = spark.createDataFrame(rows, "formula_id long, sym_idx int, x int, y int, w int, h int")
    flagged = s.selectExpr("*", *[f"false as {c}" for c in R.FLAGS])
    want = {(r.formula_id, r.sym_idx): r["rank"] for r in R.reading_order(s).collect()}
    for batch in R._by_formula(flagged).toArrow().to_batches():
        f = R.Formulas.read(batch)
        keys = [(batch.column("formula_id")[int(k)].as_py(), int(i)) for k, i in zip(f.of, f.idx, strict=True)]
        assert {k: int(r) for k, r in zip(keys, f.ranks(), strict=True)} == {k: want[k] for k in keys}


def test_more_lines_go_to_more_tasks(spark, monkeypatch, tmp_path):
    from formulaspark.plans import fixtures as T

    lines = spark.range(1000).selectExpr("id div 4 as l_orderkey", "id as l_partkey", "id as l_suppkey", "cast(id % 4 as int) as l_linenumber")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(T, "LINES", 100)
    assert T.symbols(spark, str(tmp_path)).rdd.getNumPartitions() == 10


def test_nearest_of_many_ties(spark):
    """Ties at the last place go to the smaller ids, within a part and between parts; whole rows are not sorted."""
    rows = [(i, f"c{i % 3}", [float(i % 2), 0.0]) for i in range(40)]
    t = spark.createDataFrame(rows, "id long, label string, features array<double>")
    got = {r.id: (r.pred, r.prob) for r in M.nearest_labels(t, t, k=5, block=16).collect()}
    want = {}
    for i, _, a in rows:
        near = sorted((abs(a[0] - b[0]), j, label) for j, label, b in rows)[:5]
        labels = [label for *_, label in near]
        want[i] = min((-labels.count(c), c) for c in labels)[1], max(map(labels.count, labels)) / 5
    assert got == want
    few = M.nearest_labels(t, t.where("id < 3"), k=5, block=16).collect()
    assert len(few) == 40
