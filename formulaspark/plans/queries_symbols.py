"""Queries over symbols: boxes, relations, groups, order, trees; and over labels and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from formulaspark.functions.geometry import Box
from formulaspark.functions.latex import symbol_latex
from formulaspark.operators import components as C
from formulaspark.operators import recognition as M
from formulaspark.operators import structure as R
from formulaspark.plans import fixtures as T
from formulaspark.sources.scratch import kept

#: Height of the pages that symbols stand on.
CANVAS = 112

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    def add(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = T.with_tables(sql, *tables) if tables else sql
        return make

    return add


def near(spark, d):
    """Neighbouring symbols of a formula."""
    s = T.symbols(spark, d)
    a = s.select("formula_id", F.col("sym_idx").alias("i"), *[F.col(c).alias("a" + c) for c in "xywh"])
    b = s.select("formula_id", (F.col("sym_idx") - 1).alias("i"), *[F.col(c).alias("b" + c) for c in "xywh"])
    return a.join(b, ["formula_id", "i"])


NEAR = "near AS (SELECT a.formula_id, a.sym_idx AS i, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS \"by\", b.w AS bw, b.h AS bh FROM symbols a JOIN symbols b ON a.formula_id = b.formula_id AND b.sym_idx = a.sym_idx + 1)"


@query(
    "box_properties",
    "SELECT formula_id, sym_idx, x + w AS x2, y + h AS y2, x + w / 2 AS cx, y + h / 2 AS cy, w * h AS area, round(w / greatest(h, 1), 6) AS aspect FROM symbols",
    "symbols",
)
def box_properties(spark, d):
    b = Box.of()
    return T.symbols(spark, d).select(
        "formula_id", "sym_idx", b.x2.alias("x2"), b.y2.alias("y2"), b.center_x.alias("cx"), b.center_y.alias("cy"), b.area.alias("area"), F.round(b.aspect_ratio, 6).alias("aspect")
    )


@query("box_rects", "SELECT formula_id, sym_idx, concat_ws(',', x, y, w, h) AS as_tuple, concat_ws(',', x, y, x + w, y + h) AS as_rect FROM symbols", "symbols")
def box_rects(spark, d):
    b = Box.of()
    s = T.symbols(spark, d).withColumns({"t": b.to_tuple(), "r": b.to_rect()})
    return s.select("formula_id", "sym_idx", F.concat_ws(",", "t.x", "t.y", "t.w", "t.h").alias("as_tuple"), F.concat_ws(",", "r.x", "r.y", "r.x2", "r.y2").alias("as_rect"))


@query("box_expand", "SELECT formula_id, sym_idx, greatest(0, x - 15) AS x, greatest(0, y - 15) AS y, w + 30 AS w, h + 30 AS h FROM symbols", "symbols")
def box_expand(spark, d):
    e = Box.of().expand(15)
    return T.symbols(spark, d).select("formula_id", "sym_idx", e.x.alias("x"), e.y.alias("y"), e.w.alias("w"), e.h.alias("h"))


@query(
    "box_intersection",
    f"WITH {NEAR} SELECT formula_id, i, CASE WHEN ok THEN greatest(ax, bx) END AS x, CASE WHEN ok THEN greatest(ay, \"by\") END AS y, CASE WHEN ok THEN least(ax + aw, bx + bw) - greatest(ax, bx) END AS w,"
    " CASE WHEN ok THEN least(ay + ah, \"by\" + bh) - greatest(ay, \"by\") END AS h FROM (SELECT *, greatest(ax, bx) < least(ax + aw, bx + bw) AND greatest(ay, \"by\") < least(ay + ah, \"by\" + bh) AS ok FROM near)",
    "symbols",
)
def box_intersection(spark, d):
    return near(spark, d).withColumn("b", Box.of("a").intersection(Box.of("b"))).select("formula_id", "i", "b.x", "b.y", "b.w", "b.h")


@query(
    "box_union",
    f"WITH {NEAR} SELECT formula_id, i, least(ax, bx) AS x, least(ay, \"by\") AS y, greatest(ax + aw, bx + bw) - least(ax, bx) AS w, greatest(ay + ah, \"by\" + bh) - least(ay, \"by\") AS h FROM near",
    "symbols",
)
def box_union(spark, d):
    u = Box.of("a").union(Box.of("b"))
    return near(spark, d).select("formula_id", "i", u.x.alias("x"), u.y.alias("y"), u.w.alias("w"), u.h.alias("h"))


@query(
    "box_overlaps",
    f"""WITH {NEAR}, o AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) AS ow, greatest(0, least(ay + ah, "by" + bh) - greatest(ay, "by")) AS oh FROM near)
    SELECT formula_id, i, round(ow * oh / greatest(aw * ah + bw * bh - ow * oh, 1), 6) AS iou, round(oh / greatest(least(ah, bh), 1), 6) AS vertical, round(ow / greatest(least(aw, bw), 1), 6) AS horizontal,
    round(ow / greatest(bw, 1), 6) AS coverage, round(sqrt(((ax + aw / 2) - (bx + bw / 2)) ^ 2 + ((ay + ah / 2) - ("by" + bh / 2)) ^ 2), 6) AS distance FROM o""",
    "symbols",
)
def box_overlaps(spark, d):
    a, b = Box.of("a"), Box.of("b")
    return near(spark, d).select(
        "formula_id",
        "i",
        F.round(a.iou(b), 6).alias("iou"),
        F.round(a.vertical_overlap(b), 6).alias("vertical"),
        F.round(a.horizontal_overlap(b), 6).alias("horizontal"),
        F.round(a.coverage(b), 6).alias("coverage"),
        F.round(a.distance(b), 6).alias("distance"),
    )


@query(
    "overlapping_boxes",
    """SELECT formula_id, a, b, iou FROM (SELECT a.formula_id, a.sym_idx AS a, b.sym_idx AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS o,
    round(o / greatest(a.w * a.h + b.w * b.h - o, 1), 6) AS iou FROM symbols a JOIN symbols b ON a.formula_id = b.formula_id AND a.sym_idx < b.sym_idx) WHERE o > 0""",
    "symbols",
)
def overlapping_boxes(spark, d):
    s = T.symbols(spark, d).select(F.col("formula_id").alias("image_id"), F.col("sym_idx").alias("comp_id"), "x", "y", "w", "h")
    return C.overlapping_boxes(s).select(F.col("image_id").alias("formula_id"), "a", "b", F.round("iou", 6).alias("iou"))


_GEO = """a.x + a.w / 2 AS acx, a.y + a.h / 2 AS acy, b.x + b.w / 2 AS bcx, b.y + b.h / 2 AS bcy"""
_RELATIONS = f"""rel0 AS (SELECT a.formula_id, a.sym_idx AS i, b.sym_idx AS j, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS "by", b.w AS bw, b.h AS bh, a.is_fraction_line AS line, a.is_sqrt AS root, a.is_sum AS sum_, a.is_integral AS int_, {_GEO}
 FROM symbols a JOIN symbols b ON a.formula_id = b.formula_id AND a.sym_idx <> b.sym_idx),
 rel1 AS (SELECT *, bcx - acx AS dx, bcy - acy AS dy, greatest(bw, bh) / greatest(greatest(aw, ah), 1) AS sz, (bx - ax - aw) / greatest(aw, 1) AS gap, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) AS ow, greatest(0, least(ay + ah, "by" + bh) - greatest(ay, "by")) AS oh FROM rel0),
 rel2 AS (SELECT *, ow / greatest(bw, 1) AS cov, NOT (dx <= 0 AND bx < ax + aw - aw * 0.2::DOUBLE) AND gap <= 2 AS near_, dx / greatest(greatest(aw, ah), 1) AS ndx, dy / greatest(ah, 1) AS ndy FROM rel1),
 rel3 AS (SELECT *, CASE
  WHEN line AND cov > 0.2 AND abs(dy) < greatest(2 * bh, 50) AND dy < 0 THEN 'numerator'
  WHEN line AND cov > 0.2 AND abs(dy) < greatest(2 * bh, 50) AND dy > 0 THEN 'denominator'
  WHEN near_ AND ((("by" + bh - ay) / greatest(ah, 1) < 0.6 AND dy < -ah * 0.15::DOUBLE AND sz < 0.9) OR (dy < -0.25 * ah AND sz < 0.75 AND dx > 0) OR ("by" < ay - ah * 0.15::DOUBLE AND dx > 0 AND sz < 0.85 AND gap < 1)) THEN 'superscript'
  WHEN near_ AND ((("by" - ay) / greatest(ah, 1) > 0.4 AND dy > ah * 0.15::DOUBLE AND sz < 0.9) OR (dy > 0.25 * ah AND sz < 0.75 AND dx > 0) OR ("by" + bh > ay + ah + ah * 0.15::DOUBLE AND dx > 0 AND sz < 0.85 AND gap < 1)) THEN 'subscript'
  WHEN ndx > 0.3 AND oh / greatest(least(ah, bh), 1) > 0.4 THEN 'right'
  WHEN abs(ndx) < 0.5 AND ndy < -0.5 AND ow / greatest(least(aw, bw), 1) > 0.3 THEN 'above'
  WHEN abs(ndx) < 0.5 AND ndy > 0.5 AND ow / greatest(least(aw, bw), 1) > 0.3 THEN 'below' END AS rel FROM rel2)"""


@query("spatial_relations", f"WITH {_RELATIONS} SELECT formula_id, i, j, rel FROM rel3 WHERE rel IS NOT NULL", "symbols")
def spatial_relations(spark, d):
    return R.spatial_relations(T.symbols(spark, d))


@query("relation_counts", f"WITH {_RELATIONS} SELECT rel, count(*) AS n FROM rel3 WHERE rel IS NOT NULL GROUP BY rel", "symbols")
def relation_counts(spark, d):
    return R.spatial_relations(T.symbols(spark, d)).groupBy("rel").agg(F.count("*").alias("n"))


def _script_sql(name: str) -> str:
    return f"WITH {_RELATIONS} SELECT formula_id, i, j FROM rel3 WHERE rel = '{name}'"


@query("superscripts", _script_sql("superscript"), "symbols")
def superscripts(spark, d):
    return R.spatial_relations(T.symbols(spark, d)).where("rel = 'superscript'").select("formula_id", "i", "j")


@query("subscripts", _script_sql("subscript"), "symbols")
def subscripts(spark, d):
    return R.spatial_relations(T.symbols(spark, d)).where("rel = 'subscript'").select("formula_id", "i", "j")


_GROUPS = """grp AS (
 SELECT formula_id, 'fraction' AS type, i AS anchor_idx, CASE WHEN rel IN ('numerator', 'denominator') THEN rel WHEN cov > 0.2 AND bcy < acy AND ay - "by" - bh < greatest(2 * bh, 50) THEN 'numerator'
   WHEN cov > 0.2 AND bcy > acy AND "by" - ay - ah < greatest(2 * bh, 50) THEN 'denominator' END AS role, j AS member_idx FROM rel3 WHERE line
 UNION ALL SELECT formula_id, 'sqrt', i, CASE WHEN bcx > ax + aw * 0.3::DOUBLE AND bcx < ax + aw AND bcy > ay AND bcy < ay + ah THEN 'inner' END, j FROM rel3 WHERE root
 UNION ALL SELECT formula_id, CASE WHEN sum_ THEN 'sum' ELSE 'integral' END, i, CASE rel WHEN 'above' THEN 'upper' WHEN 'below' THEN 'lower' WHEN 'right' THEN 'operand' END, j FROM rel3 WHERE sum_ OR int_),
 grp1 AS (SELECT * FROM grp WHERE role IS NOT NULL),
 lone AS (SELECT formula_id, 'sqrt' AS type, sym_idx AS anchor_idx FROM symbols WHERE is_sqrt UNION ALL SELECT formula_id, CASE WHEN is_sum THEN 'sum' ELSE 'integral' END, sym_idx FROM symbols WHERE is_sum OR is_integral),
 grps AS (SELECT * FROM grp1 UNION ALL SELECT l.formula_id, l.type, l.anchor_idx, NULL, NULL FROM lone l WHERE NOT EXISTS (SELECT 1 FROM grp1 g WHERE g.formula_id = l.formula_id AND g.type = l.type AND g.anchor_idx = l.anchor_idx))"""


def _groups(kinds: tuple[str, ...]):
    return lambda spark, d: R.structure_groups(T.symbols(spark, d)).where(F.col("type").isin(*kinds))


for _name, _kinds in (("fraction_groups", ("fraction",)), ("sqrt_groups", ("sqrt",)), ("operator_groups", ("sum", "integral"))):
    _listed = ", ".join(f"'{k}'" for k in _kinds)
    query(_name, f"WITH {_RELATIONS}, {_GROUPS} SELECT formula_id, type, anchor_idx, role, member_idx FROM grps WHERE type IN ({_listed})", "symbols")(_groups(_kinds))

_ORDER = """ord0 AS (SELECT formula_id, sym_idx, x + w / 2 AS cx, y + h / 2 AS cy, avg(h) OVER (PARTITION BY formula_id) AS mh, lag(y + h / 2) OVER (PARTITION BY formula_id ORDER BY y + h / 2, sym_idx) AS prev FROM symbols),
 ord1 AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR cy - prev >= mh * 0.3::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY formula_id ORDER BY cy, sym_idx ROWS UNBOUNDED PRECEDING) AS INT) AS line FROM ord0),
 ord AS (SELECT formula_id, sym_idx, line, CAST(row_number() OVER (PARTITION BY formula_id ORDER BY line, cx, cy, sym_idx) AS INT) AS rank FROM ord1)"""


@query("reading_order", f"WITH {_ORDER} SELECT * FROM ord", "symbols")
def reading_order(spark, d):
    return R.reading_order(T.symbols(spark, d))


@query(
    "script_anchors",
    f"""WITH {_RELATIONS}, {_GROUPS}, {_ORDER}, taken AS (SELECT formula_id, anchor_idx AS k FROM grps WHERE type = 'fraction' UNION SELECT formula_id, member_idx FROM grps WHERE type = 'fraction'),
    sc AS (SELECT r.formula_id, r.i, r.j, r.rel, row_number() OVER (PARTITION BY r.formula_id, r.j ORDER BY o.rank) AS n FROM rel3 r JOIN ord o ON o.formula_id = r.formula_id AND o.sym_idx = r.i WHERE r.rel IN ('superscript', 'subscript')
      AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.formula_id = r.formula_id AND (t.k = r.i OR t.k = r.j)))
    SELECT formula_id, i AS base_idx, j AS script_idx, rel FROM sc WHERE n = 1""",
    "symbols",
)
def script_anchors(spark, d):
    return R.script_anchors(T.symbols(spark, d))


@query("syntax_tree")
def syntax_tree(spark, d):
    return R.build_syntax_tree(T.symbols(spark, d))


@query("symbols_to_latex")
def symbols_to_latex(spark, d):
    return R.analyze_structure(T.symbols(spark, d))


@query("tree_json")
def tree_json(spark, d):
    return R.tree_json(R.syntax_trees(T.symbols(spark, d)))


@query("tree_outline")
def tree_outline(spark, d):
    return R.tree_text(R.syntax_trees(T.symbols(spark, d)))


@query(
    "simple_render",
    """SELECT l_orderkey AS formula_id, '\\frac{' || n || '}{' || dd || '}' AS latex FROM (SELECT l_orderkey, coalesce(string_agg(lb, ' ' ORDER BY k) FILTER (k % 2 = 0), '') AS n, coalesce(string_agg(lb, ' ' ORDER BY k) FILTER (k % 2 = 1), '') AS dd FROM
    (SELECT formula_id AS l_orderkey, sym_idx AS k, label AS lb FROM symbols) GROUP BY l_orderkey)""",
    "symbols",
)
def simple_render(spark, d):
    """Trees of fixed depth: symbols with even places over those with odd ones."""
    s = T.symbols(spark, d)
    leaf = s.select("formula_id", (F.col("sym_idx") + 10).alias("node_id"), (F.col("sym_idx") % 2 + 2).alias("parent_id"), F.lit(None).cast("string").alias("role"), F.col("sym_idx").alias("ord"), F.lit("symbol").alias("node_type"), F.col("label").alias("value"))
    top = F.explode(
        F.array(*[F.struct(F.lit(n).alias("node_id"), F.lit(p).cast("int").alias("parent_id"), F.lit(o).alias("ord"), F.lit(k).alias("node_type")) for n, p, o, k in ((0, None, 0, "expression"), (1, 0, 0, "fraction"), (2, 1, 0, "expression"), (3, 1, 1, "expression"))])
    )
    head = s.select("formula_id").distinct().select("formula_id", top.alias("t")).select("formula_id", "t.node_id", "t.parent_id", F.lit(None).cast("string").alias("role"), "t.ord", "t.node_type", F.lit(None).cast("string").alias("value"))
    return R.render_latex(head.unionByName(leaf))


@query(
    "label_latex",
    """SELECT name AS label, CASE WHEN length(name) = 1 AND contains('#$%&_{}', name) THEN '\\' || name WHEN name IN ('eq', 'lt') THEN CASE name WHEN 'eq' THEN '=' ELSE '<' END
    WHEN length(name) > 1 AND regexp_matches(name, '^[A-Za-z]+$') THEN '\\' || name ELSE name END AS latex FROM
    (SELECT l_shipdate_ AS name FROM (SELECT CASE l_orderkey % 6 WHEN 0 THEN 'alpha' WHEN 1 THEN 'eq' WHEN 2 THEN 'lt' WHEN 3 THEN '#' WHEN 4 THEN label ELSE 'fraction' END AS l_shipdate_ FROM (SELECT formula_id AS l_orderkey, label FROM symbols)))""",
    "symbols",
)
def label_latex(spark, d):
    k = F.col("formula_id") % 6
    name = F.when(k == 0, "alpha").when(k == 1, "eq").when(k == 2, "lt").when(k == 3, "#").when(k == 4, F.col("label")).otherwise("fraction")
    return T.symbols(spark, d).select(name.alias("label")).select("label", symbol_latex(F.col("label")).alias("latex"))


@query(
    "sqrt_content",
    """SELECT a.formula_id, a.sym_idx AS sqrt_idx, b.sym_idx AS member_idx FROM symbols a JOIN symbols b ON a.formula_id = b.formula_id AND a.sym_idx <> b.sym_idx WHERE a.is_sqrt
    AND b.x + b.w / 2 > a.x + a.w * 0.3::DOUBLE AND b.x + b.w / 2 < a.x + a.w AND b.y + b.h / 2 > a.y AND b.y + b.h / 2 < a.y + a.h""",
    "symbols",
)
def sqrt_content(spark, d):
    return C.sqrt_content(T.symbols(spark, d))


@query(
    "fraction_parts",
    """SELECT a.formula_id, a.sym_idx AS line_idx, b.sym_idx AS member_idx, CASE WHEN b.y + b.h / 2 < a.y + a.h / 2 THEN 'numerator' ELSE 'denominator' END AS role FROM symbols a JOIN symbols b ON a.formula_id = b.formula_id AND a.sym_idx <> b.sym_idx
    WHERE a.is_fraction_line AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / greatest(least(a.w, b.w), 1) >= 0.3""",
    "symbols",
)
def fraction_parts(spark, d):
    return C.fraction_parts(T.symbols(spark, d))


def _comps(spark, d):
    return T.symbols(spark, d).select(F.col("formula_id").alias("image_id"), F.col("sym_idx").alias("comp_id"), "x", "y", "w", "h", (F.col("w") * F.col("h")).cast("long").alias("area"))


_COMPS = "c0 AS (SELECT formula_id AS image_id, sym_idx AS comp_id, x, y, w, h, w * h AS area, avg(h) OVER (PARTITION BY formula_id) AS mean FROM symbols)"
_SIDES = f"""{_COMPS}, sides AS (SELECT a.image_id, a.comp_id, bool_or(b.y + b.h / 2 < a.y) AS above, bool_or(b.y + b.h / 2 > a.y + a.h) AS below FROM c0 a JOIN c0 b ON a.image_id = b.image_id AND a.comp_id <> b.comp_id
 WHERE greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / greatest(least(a.w, b.w), 1) >= 0.2 GROUP BY ALL)"""


@query("above_and_below", f"WITH {_SIDES} SELECT c.image_id, c.comp_id, coalesce(above, false) AS above, coalesce(below, false) AS below FROM c0 c LEFT JOIN sides s USING (image_id, comp_id)", "symbols")
def above_and_below(spark, d):
    return C.above_and_below(_comps(spark, d))


@query(
    "fraction_line_flags",
    f"""WITH {_SIDES} SELECT c.image_id, c.comp_id, (w / greatest(h, 1) > 5 AND h <= 8 AND h / 112 < 0.1) OR (w / greatest(h, 1) > 4 AND h <= 12 AND h < mean * 0.3::DOUBLE AND coalesce(above, false) AND coalesce(below, false)) AS is_fraction_line
    FROM c0 c LEFT JOIN sides s USING (image_id, comp_id)""",
    "symbols",
)
def fraction_line_flags(spark, d):
    return C.flag_fraction_lines(_comps(spark, d), CANVAS).select("image_id", "comp_id", "is_fraction_line")


_MERGE = f"""{_COMPS}, m AS (SELECT a.image_id, a.comp_id AS a, b.comp_id AS b, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, a.area AS aa, b.x AS bx, b.y AS "by", b.w AS bw, b.h AS bh, b.area AS ba, a.mean AS mean,
 greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / greatest(least(a.w, b.w), 1) AS ho, abs((a.y + a.h / 2) - (b.y + b.h / 2)) AS gy, abs((a.x + a.w / 2) - (b.x + b.w / 2)) AS gx
 FROM c0 a JOIN c0 b ON a.image_id = b.image_id AND a.comp_id < b.comp_id WHERE NOT (a.w / greatest(a.h, 1) > 4 AND a.h <= 8) AND NOT (b.w / greatest(b.h, 1) > 4 AND b.h <= 8)),
 e AS (SELECT image_id, a, b FROM m WHERE (ba <= aa * 0.25 AND "by" + bh <= ay AND ho >= 0.3 AND ay - "by" - bh <= mean * 0.5) OR (aa <= ba * 0.25 AND ay + ah <= "by" AND ho >= 0.3 AND "by" - ay - ah <= mean * 0.5)
 OR (aw / greatest(ah, 1) >= 2 AND bw / greatest(bh, 1) >= 2 AND least(aw, bw) / greatest(aw, bw, 1) >= 0.7 AND ho >= 0.7 AND NOT (ay + ah > "by" AND "by" + bh > ay) AND abs(least(ay, "by") - greatest(ay + ah, "by" + bh)) <= (ah + bh) / 2 * 3)
 OR (aa <= mean * mean * 0.2::DOUBLE AND ba <= mean * mean * 0.2::DOUBLE AND ho >= 0.5 AND gy >= mean * 0.2::DOUBLE AND gy <= mean * 0.8::DOUBLE)
 OR (aa <= mean * mean * 0.15::DOUBLE AND ba <= mean * mean * 0.15::DOUBLE AND gx >= mean * 0.2::DOUBLE AND gy >= mean * 0.2::DOUBLE))"""


#: In pictures of at most 64 rows, parts of broken strokes merge as well.
_MERGE_SMALL = f"""{_MERGE}, e2 AS (SELECT image_id, a, b FROM e UNION SELECT image_id, a, b FROM m WHERE ho > 0.5 AND least(aa, ba) / greatest(aa, ba, 1) > 0.3 AND greatest(0, greatest(ay, "by") - least(ay + ah, "by" + bh)) / greatest(least(ah, bh), 1) < 0.3)"""


@query("merge_edges_small", f"WITH {_MERGE_SMALL} SELECT image_id, a, b FROM e2", "symbols")
def merge_edges_small(spark, d):
    return C.merge_edges(_comps(spark, d), 64)


@query("merge_edges", f"WITH {_MERGE} SELECT image_id, a, b FROM e", "symbols")
def merge_edges(spark, d):
    return C.merge_edges(_comps(spark, d), CANVAS)


@query(
    "merged_components",
    "WITH RECURSIVE "
    + _MERGE
    + """, both_ AS (SELECT image_id, a, b FROM e UNION SELECT image_id, b, a FROM e), reach AS (SELECT image_id, comp_id AS n, comp_id AS r FROM c0 UNION SELECT q.image_id, q.n, k.b FROM reach q JOIN both_ k ON k.image_id = q.image_id AND k.a = q.r),
    root AS (SELECT image_id, n, min(r) AS root FROM reach GROUP BY ALL) SELECT c.image_id, root AS comp_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, CAST(sum(area) AS BIGINT) AS area FROM c0 c JOIN root r ON r.image_id = c.image_id AND r.n = c.comp_id GROUP BY c.image_id, root""",
    "symbols",
)
def merged_components(spark, d):
    c = _comps(spark, d)
    return C.merge_components(c, C.merge_edges(c, CANVAS)).select("image_id", "comp_id", "x", "y", "w", "h", "area")


# labels and vectors


def _vectors(spark, d):
    e = T.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


@query("label_index", "SELECT DISTINCT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS idx FROM embeddings WHERE label IS NOT NULL")
def label_index(spark, d):
    return M.label_index(T.table(spark, d, "embeddings"))


@query(
    "standardized",
    """WITH e AS (SELECT vec_id, CAST(p AS INT) AS dim, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(p)), s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM e GROUP BY dim)
    SELECT vec_id, dim, round((v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 4) AS z FROM e JOIN s USING (dim)""",
)
def standardized(spark, d):
    v = _vectors(spark, d)
    return M.standardize(v, M.scaler(v)).select(F.col("id").alias("vec_id"), F.posexplode("features").alias("dim", "z")).select("vec_id", "dim", F.round("z", 4).alias("z"))


@query(
    "stratified_split",
    """SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY ((vec_id % 2147483648) * 2654435761) % 4294967296, vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5) AS is_test FROM embeddings""",
)
def stratified_split(spark, d):
    return M.stratified_split(_vectors(spark, d)).select(F.col("id").alias("vec_id"), "label", "is_test")


@query(
    "classification_report",
    """WITH l AS (SELECT DISTINCT y AS label FROM report UNION SELECT DISTINCT pred FROM report), r AS (SELECT label, (SELECT count(*) FROM report WHERE y = label AND pred = label) AS hit, (SELECT count(*) FROM report WHERE pred = label) AS g, (SELECT count(*) FROM report WHERE y = label) AS support FROM l)
    SELECT label, round(coalesce(hit / nullif(g, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * (hit / nullif(g, 0)) * (hit / nullif(support, 0)) / nullif(hit / nullif(g, 0) + hit / nullif(support, 0), 0), 0), 6) AS f1, support FROM r""",
    "report",
)
def classification_report(spark, d):
    return M.classification_report(T.report(spark, d))


@query(
    "report_averages",
    """WITH l AS (SELECT DISTINCT y AS label FROM report UNION SELECT DISTINCT pred FROM report), r AS (SELECT label, (SELECT count(*) FROM report WHERE y = label AND pred = label) AS hit, (SELECT count(*) FROM report WHERE pred = label) AS g, (SELECT count(*) FROM report WHERE y = label) AS n FROM l),
    p AS (SELECT n, round(coalesce(hit / nullif(g, 0), 0), 6) AS p, round(coalesce(hit / nullif(n, 0), 0), 6) AS c, round(coalesce(2 * (hit / nullif(g, 0)) * (hit / nullif(n, 0)) / nullif(hit / nullif(g, 0) + hit / nullif(n, 0), 0), 0), 6) AS f FROM r)
    SELECT 'macro avg' AS label, round(avg(p), 6) AS precision, round(avg(c), 6) AS recall, round(avg(f), 6) AS f1, CAST(sum(n) AS BIGINT) AS support FROM p
    UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 6), round(sum(c * n) / sum(n), 6), round(sum(f * n) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM p""",
    "report",
)
def report_averages(spark, d):
    return M.report_averages(M.classification_report(T.report(spark, d)))


@query("accuracy", "SELECT round(avg(CAST(y = pred AS INT)), 6) AS accuracy, count(*) AS n FROM report", "report")
def accuracy(spark, d):
    return M.accuracy(T.report(spark, d))


@query(
    "top_candidates",
    "SELECT vec_id, rank, label, round(prob, 6) AS prob FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, idx DESC) AS INT) AS rank FROM candidates) WHERE rank <= 3",
    "candidates",
)
def top_candidates(spark, d):
    return M.top_candidates(T.candidates(spark, d)).withColumn("prob", F.round("prob", 6))


@query(
    "nearest_labels",
    """WITH v AS (SELECT vec_id AS id, label, [CAST(q AS DOUBLE) for q in embedding] AS f FROM embeddings), p AS (SELECT a.id AS query, b.id, b.label, round(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a.f, b.f)]), 9) AS dd FROM v a CROSS JOIN v b),
    k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY dd, id) <= 5), n AS (SELECT query, label, count(*) AS n FROM k GROUP BY ALL)
    SELECT query AS id, label AS pred, n / 5 AS prob FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1""",
)
def nearest_labels(spark, d):
    v = _vectors(spark, d)
    return M.nearest_labels(v, v)


@query(
    "template_match",
    """WITH e AS (SELECT vec_id, label, CAST(p AS INT) AS dim, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(p)), t0 AS (SELECT label, dim, avg(v) AS v FROM e GROUP BY ALL),
    s AS (SELECT vec_id, dim, (v - m) / sqrt(sum((v - m) ^ 2) OVER (PARTITION BY vec_id)) AS a FROM (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS m FROM e)),
    t AS (SELECT label, dim, (v - m) / sqrt(sum((v - m) ^ 2) OVER (PARTITION BY label)) AS b FROM (SELECT *, avg(v) OVER (PARTITION BY label) AS m FROM t0)),
    c AS (SELECT vec_id, label, round(sum(a * b), 9) AS score FROM s JOIN t USING (dim) GROUP BY ALL) SELECT vec_id AS id, label, round(score, 4) AS score FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""",
)
def template_match(spark, d):
    v = _vectors(spark, d)
    mean = v.select("label", F.posexplode("features").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    templates = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("t_features"))
    return M.match_templates(v.select("id", "features"), templates).withColumn("score", F.round("score", 4))


@query(
    "recognized_symbols",
    """SELECT formula_id, sym_idx, CASE WHEN is_fraction_line THEN 'fraction_line' WHEN is_sqrt THEN 'sqrt' WHEN sym_idx % 5 = 4 THEN 'unknown' ELSE label END AS label, CASE WHEN is_fraction_line OR is_sqrt THEN 1.0::DOUBLE WHEN sym_idx % 5 = 4 THEN 0.0::DOUBLE ELSE round(confidence, 6) END AS confidence FROM symbols""",
    "symbols",
)
def recognized_symbols(spark, d):
    s = T.symbols(spark, d)
    given = s.where("sym_idx % 5 <> 4").select("formula_id", "sym_idx", F.col("label").alias("pred"), F.col("confidence").alias("prob"))
    return M.recognize_symbols(s, given).withColumn("confidence", F.round("confidence", 6))


@query(
    "resolved_labels",
    f"""WITH {_ORDER}, s AS (SELECT s.*, o.rank, CASE s.label WHEN '0' THEN 'O' WHEN 'O' THEN '0' WHEN '1' THEN 'l' WHEN 'l' THEN '1' WHEN 'I' THEN '1' WHEN 'x' THEN 'times' ELSE 'q' END AS second FROM symbols s JOIN ord o USING (formula_id, sym_idx)),
    n AS (SELECT *, coalesce(lag(label) OVER w, '') AS p, coalesce(lead(label) OVER w, '') AS q FROM s WINDOW w AS (PARTITION BY formula_id ORDER BY rank))
    SELECT formula_id, sym_idx, CASE WHEN second = 'q' OR confidence > 0.9::DOUBLE THEN label WHEN label IN ('0', 'O') THEN CASE WHEN regexp_matches(p, '^[0-9]$') OR regexp_matches(q, '^[0-9]$') THEN '0' WHEN regexp_matches(p, '^[a-zA-Z]$') OR regexp_matches(q, '^[a-zA-Z]$') THEN 'O' ELSE label END
    WHEN label IN ('1', 'l', 'I') THEN CASE WHEN regexp_matches(p, '^[0-9]$') OR regexp_matches(q, '^[0-9]$') THEN '1' ELSE 'l' END
    ELSE CASE WHEN regexp_matches(p, '^[0-9]$') AND regexp_matches(q, '^[0-9]$') THEN 'times' ELSE 'x' END END AS label FROM n""",
    "symbols",
)
def resolved_labels(spark, d):
    s = T.symbols(spark, d)
    second = F.when(F.col("label") == "0", "O").when(F.col("label") == "O", "0").when(F.col("label") == "1", "l").when(F.col("label").isin("l", "I"), "1").when(F.col("label") == "x", "times").otherwise("q")
    return M.resolve_ambiguity(s, R.reading_order(s), s.select("formula_id", "sym_idx", second.alias("second")))


@query("random_forest")
def random_forest(spark, d):
    """Held-out labels by a forest of the operator's size."""
    v = M.stratified_split(_vectors(spark, d)).withColumn("label", F.col("label").cast("string"))
    model = M.fit_classifier(v.where("not is_test"), "random_forest")
    return M.predict(model, v.where("is_test")).select("id", F.col("label").alias("y"), "pred", F.round("prob", 6).alias("prob"))


@query("kernel_machine")
def kernel_machine(spark, d):
    """Held-out labels by random Fourier features and multinomial logistic regression, with the operator's own
    scaler, kernel width and penalty."""
    v = _vectors(spark, d).withColumn("label", F.col("label").cast("string"))
    scale = kept(M.scaler(v), "scale")
    rows = kept(M.stratified_split(M.standardize(v, scale)), "scaled")
    seen = rows.where("not is_test")
    gamma, n = 1.0 / (scale.count() * M.mean_variance(seen)), seen.count()
    mapped = M.fourier_features(rows.select("id", "label", "features", "is_test"), gamma)
    model = M.fit_classifier(mapped.where("not is_test"), "svm", penalty=1.0 / (10.0 * n))
    return M.predict(model, mapped.where("is_test")).select("id", F.col("label").alias("y"), "pred", F.round("prob", 6).alias("prob"))
