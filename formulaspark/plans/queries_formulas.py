"""Queries over LaTeX columns and polynomial term tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formulaspark.functions import latex as L
from formulaspark.operators import calculus
from formulaspark.operators import polynomials as Y
from formulaspark.plans import fixtures as T
from formulaspark.plans.pipelines import computed_records, process_semantic, solved_records as solved

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    def add(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = T.with_tables(sql, *tables) if tables else sql
        return make

    return add


def column(name: str, make, sql: str):
    """A query of one expression over the formulas; lists are joined by '|'."""
    query(name, f"SELECT formula_id, {sql} AS result FROM latex", "latex")(lambda spark, d: T.latex(spark, d).select("formula_id", make(F.col("latex")).alias("result")))


def _any(parts) -> str:
    return "(" + " OR ".join(f"contains(latex, {T._quoted(p)})" for p in parts) + ")"


def _count(part: str) -> str:
    return f"CAST((length(latex) - length(replace(latex, {T._quoted(part)}, ''))) / {len(part)} AS INT)"


def _listed(cases: list[tuple[str, str]]) -> str:
    """DuckDB: those of (condition, text) that hold, joined."""
    items = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in cases)
    return f"array_to_string(list_filter([{items}], lambda q: q IS NOT NULL), '|')"


def _classify(slash: str) -> str:
    return (
        "CASE WHEN " + _any([rf"\begin{{{m}}}" for m in L.MATRICES]) + " THEN 'matrix' WHEN " + _any([slash + "lim"]) + " THEN 'limit' WHEN "
        + _any([slash + w for w in ("int", "iint", "iiint", "oint")]) + " THEN 'integral' WHEN " + _any([r"\frac{d", r"\frac{\partial", "'"]) + " THEN 'derivative' WHEN "
        + _any([slash + "sum"]) + " THEN 'sum' WHEN " + _any([slash + "prod"]) + " THEN 'product' WHEN " + _any(L.SET_OPERATORS) + " THEN 'set_expression' WHEN "
        + _any(L.LOGIC_OPERATORS) + " THEN 'logic_expression' WHEN " + _any(L.NUMBER_SETS) + r" THEN 'number_set' WHEN regexp_matches(latex, '[a-zA-Z]\s*\([^)]+\)\s*=') THEN 'function_def' WHEN "
        + _any(L.INEQUALITY_SIGNS) + " THEN 'inequality' WHEN contains(latex, '=') THEN 'equation' ELSE 'expression' END"
    )


_BRACKETS = _listed([(f"{_count(a)} <> {_count(b)}", f"'unbalanced brackets: {a} ' || {_count(a)} || ', {b} ' || {_count(b)}") for a, b in L.BRACKETS])
_OPERATORS = _listed(
    [(_any([x]), f"'operators {x}'") for x in L.DOUBLED]
    + [(r"regexp_matches(latex, '^\s*[+*/]')", "'starts with an operator'"), (r"regexp_matches(latex, '[+*/]\s*$')", "'ends with an operator'")]
)
_ZERO = _listed([(r"regexp_matches(latex, '\\frac\{[^{}]*\}\{\s*0+(\.0*)?\s*\}') OR regexp_matches(latex, '/\s*0+(\.0*)?\s*([^0-9.]|$)')", "'division by zero'")])
_VARIABLES = r"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(latex, '\\(begin|end)\{[a-z]*\}', ' ', 'g'), '\\[A-Za-z]+', ' ', 'g'), '[^A-Za-z]+'), lambda q: length(q) = 1))), '|')"
_KINDS = [
    ("addition", ["+"]),
    ("differentiation", [r"\frac{d", r"\frac{\partial"]),
    ("division", [r"\frac", "/", r"\div"]),
    ("exponentiation", ["^"]),
    ("exponential", [r"\exp"]),
    ("integration", [r"\int"]),
    ("limit", [r"\lim"]),
    ("logarithm", [r"\log", r"\ln"]),
    ("multiplication", ["*", r"\times", r"\cdot"]),
    ("square_root", [r"\sqrt"]),
    ("subtraction", ["-"]),
    ("summation", [r"\sum"]),
    ("trigonometric", [r"\sin", r"\cos", r"\tan"]),
]
_OPERATIONS = _listed([(_any(p), f"'{k}'") for k, p in _KINDS])
_SPECIAL_OPS = _listed([(_any([op]), f"'{name}'") for op, name in {**L.SET_OPERATORS, **L.LOGIC_OPERATORS}.items()])
_SPECIAL_VARS = r"""(SELECT coalesce(string_agg(v, '|' ORDER BY f), '') FROM (SELECT v, min(k) AS f FROM (SELECT unnest(w) AS v, generate_subscripts(w, 1) AS k FROM (SELECT regexp_split_to_array(regexp_replace(latex, '\\[a-zA-Z]+(\{[^}]*\})?', ' ', 'g'), '[^A-Za-z0-9_]+') AS w)) WHERE regexp_matches(v, '^[A-Za-z]$') GROUP BY v))"""
_SETS = f"array_to_string(list_filter([{', '.join(f'CASE WHEN {_any([s])} THEN {T._quoted(n)} END' for s, n in L.NUMBER_SETS.items())}], lambda q: q IS NOT NULL), ', ')"


def _replaced(start: str, pairs) -> str:
    for old, new in pairs:
        start = f"replace({start}, {T._quoted(old)}, {T._quoted(new)})"
    return start


def _regex_replaced(start: str, pairs) -> str:
    for old, new in pairs:
        start = f"regexp_replace({start}, {T._quoted(old)}, {T._quoted(new)}, 'g')"
    return start


def _format_sql() -> str:
    text = r"trim(regexp_replace(latex, '\s+', ' ', 'g'))"
    need = f"(length(replace({text}, '}}', '')) - length(replace({text}, '{{', '')))"  # opening less closing braces
    fixed = f"repeat('{{', CAST(greatest(-{need}, 0) AS INT)) || {text} || repeat('}}', CAST(greatest({need}, 0) AS INT))"
    for op in "+-=<>":
        fixed = f"replace(replace({fixed}, '{op} ', ' {op} '), ' {op}', ' {op} ')"
    return rf"regexp_replace(regexp_replace({fixed}, '\{{\s+', '{{', 'g'), '\s+\}}', '}}', 'g')"


_listing = lambda make: lambda c: F.array_join(make(c), "|")
column("formula_types", L.classify_formula, _classify("\\"))
column("formula_types_literal", lambda c: L.classify_formula(c, "literal"), _classify("\\\\"))
column("bracket_errors", _listing(L.bracket_errors), _BRACKETS)
column("operator_errors", _listing(L.operator_errors), _OPERATORS)
column("zero_division", _listing(L.zero_division), _ZERO)
column("formula_variables", _listing(L.variables), _VARIABLES)
column("formula_operations", _listing(L.operations), _OPERATIONS)
column("special_operations", _listing(L.special_operations), _SPECIAL_OPS)
column("special_variables", _listing(L.special_variables), _SPECIAL_VARS)
column("number_sets", L.number_sets, _SETS)
column("preprocessed_latex", L.preprocess_latex, "trim(" + _replaced("latex", [(r"\cdot", r" \cdot "), (r"\times", r" \times "), (r"\div", " / "), (r"\pm", r" \pm ")]) + ")")
column("simple_expressions", L.latex_to_simple, _regex_replaced("latex", [(p, t.replace("$", "\\")) for p, t in L.SIMPLE]))
column("display_latex", L.display_latex, _replaced("latex", [(r"\mathds", r"\mathbb"), (r"\mathscr", r"\mathcal"), (r"\mathfrak", r"\mathrm")]))
column("formatted_latex", L.format_latex, _format_sql())

_PHRASES = "CASE kind " + " ".join(f"WHEN '{k}' THEN {T._quoted(v)}" for k, v in L.PHRASES.items()) + " END"
_RECORD = f"""WITH k AS (SELECT *, CASE WHEN trim(latex) = '' THEN 'unknown' ELSE {_classify(chr(92))} END AS kind FROM latex),
 s AS (SELECT *, kind IN ('set_expression', 'logic_expression', 'number_set') AS special FROM k),
 r AS (SELECT formula_id, latex, kind, special, CASE WHEN kind = 'unknown' THEN '' WHEN special THEN {_SPECIAL_VARS} ELSE {_VARIABLES} END AS vars, CASE WHEN kind = 'unknown' THEN '' WHEN special THEN {_SPECIAL_OPS} ELSE {_OPERATIONS} END AS ops,
 CASE WHEN kind = 'unknown' THEN 'empty formula' WHEN special THEN '' ELSE array_to_string(list_filter([{_BRACKETS}, {_OPERATORS}], lambda q: q <> ''), '|') END AS errors, CASE WHEN special OR kind = 'unknown' THEN '' ELSE {_ZERO} END AS warnings, CASE WHEN kind = 'number_set' THEN {_SETS} END AS simplified FROM s)"""


@query(
    "semantic_records",
    _RECORD
    + f""" SELECT formula_id, latex, kind AS formula_type, vars AS variables, ops AS operations, errors, warnings, simplified, 'This is ' || {_PHRASES} || CASE WHEN vars <> '' THEN ' in ' || replace(vars, '|', ', ') ELSE '' END
    || CASE WHEN ops <> '' THEN ', with ' || array_to_string(string_split(ops, '|')[1:3], ', ') ELSE '' END || '.' AS interpretation FROM r""",
    "latex",
)
def semantic_records(spark, d):
    r = process_semantic(T.latex(spark, d))
    join = lambda c: F.array_join(c, "|").alias(c)
    return r.select("formula_id", "latex", "formula_type", join("variables"), join("operations"), join("errors"), join("warnings"), "simplified", "interpretation")


@query("types_by_count", _RECORD + " SELECT kind AS formula_type, count(*) AS n FROM r GROUP BY kind", "latex")
def types_by_count(spark, d):
    return process_semantic(T.latex(spark, d)).groupBy("formula_type").agg(F.count("*").alias("n"))


_WHOLE = Y.WHOLE.replace("'", "''")
_TERMS = rf"""p AS (SELECT formula_id, replace(regexp_replace(latex, '\s+', '', 'g'), '*', '') AS t FROM latex), ok AS (SELECT * FROM p WHERE regexp_matches(t, '{_WHOLE}') AND len(list_distinct(regexp_extract_all(t, '[a-z]'))) <= 1),
 sd AS (SELECT formula_id, CAST(generate_subscripts(string_split(t, '='), 1) - 1 AS INT) AS side, unnest(string_split(t, '=')) AS part FROM ok), tm AS (SELECT formula_id, side, unnest(regexp_extract_all(part, '{Y.TERM}')) AS t FROM sd),
 parsed AS (SELECT formula_id, side, CASE WHEN NOT regexp_matches(t, '[a-z]') THEN 0 WHEN contains(t, '^') THEN CAST(regexp_extract(t, '\^([0-9]+)$', 1) AS INT) ELSE 1 END AS power,
 CASE WHEN starts_with(t, '-') THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * coalesce(TRY_CAST(nullif(regexp_extract(t, '^[+-]?([0-9]+(?:\.[0-9]+)?)?', 1), '') AS DOUBLE), 1) AS coef FROM tm)"""


@query("parsed_terms", f"WITH {_TERMS} SELECT formula_id, side, power, coef FROM parsed", "latex")
def parsed_terms(spark, d):
    return Y.to_terms(T.latex(spark, d))


@query("parsed_simplified", f"WITH {_TERMS} SELECT formula_id, power, sum(CASE WHEN side = 1 THEN -coef ELSE coef END) AS coef FROM parsed GROUP BY ALL HAVING sum(CASE WHEN side = 1 THEN -coef ELSE coef END) <> 0", "latex")
def parsed_simplified(spark, d):
    return Y.simplify(Y.to_terms(T.latex(spark, d)))


@query(
    "solved_records",
    f"""WITH {_TERMS}, c AS (SELECT formula_id, power, sum(CASE WHEN side = 1 THEN -coef ELSE coef END) AS coef FROM parsed GROUP BY ALL HAVING sum(CASE WHEN side = 1 THEN -coef ELSE coef END) <> 0),
    q AS (SELECT formula_id, max(power) AS degree, coalesce(sum(coef) FILTER (power = 0), 0) AS c, coalesce(sum(coef) FILTER (power = 1), 0) AS b, coalesce(sum(coef) FILTER (power = 2), 0) AS a FROM c GROUP BY formula_id),
    e AS (SELECT *, b * b - 4 * a * c AS dd, sqrt(greatest(b * b - 4 * a * c, 0)) AS s FROM q),
    r AS (SELECT formula_id, round(CASE WHEN degree = 1 THEN -c / b WHEN degree = 2 AND dd >= 0 THEN least((-b - s) / (2 * a), (-b + s) / (2 * a)) END, 6) + 0.0 AS root1, round(CASE WHEN degree = 2 AND dd > 0 THEN greatest((-b - s) / (2 * a), (-b + s) / (2 * a)) END, 6) + 0.0 AS root2 FROM e),
    k AS (SELECT formula_id, CASE WHEN trim(latex) = '' THEN 'unknown' ELSE {_classify(chr(92))} END AS formula_type, {_BRACKETS} = '' AND {_OPERATORS} = '' AS sound FROM latex)
    SELECT formula_id, formula_type, CASE WHEN formula_type = 'equation' AND sound THEN root1 END AS root1, CASE WHEN formula_type = 'equation' AND sound THEN root2 END AS root2 FROM k LEFT JOIN r USING (formula_id)""",
    "latex",
)
def solved_records(spark, d):
    return solved(T.latex(spark, d)).select("formula_id", "formula_type", "root1", "root2")


@query("simplified_terms", "SELECT formula_id, power, sum(coef) AS coef FROM terms GROUP BY ALL HAVING sum(coef) <> 0", "terms")
def simplified_terms(spark, d):
    return Y.simplify(T.terms(spark, d))


@query("derivatives", "SELECT formula_id, power - 1 AS power, coef * power AS coef FROM terms WHERE power > 0 AND coef <> 0", "terms")
def derivatives(spark, d):
    return Y.derivative(T.terms(spark, d))


@query("integrals", "SELECT formula_id, power + 1 AS power, round(coef / (power + 1), 6) AS coef FROM terms WHERE coef <> 0", "terms")
def integrals(spark, d):
    return Y.integral(T.terms(spark, d)).withColumn("coef", F.round("coef", 6))


@query("definite_integrals", "SELECT formula_id, round(sum(coef / (power + 1) * (2.0::DOUBLE ^ (power + 1) - (-1.0::DOUBLE) ^ (power + 1))), 6) AS value FROM terms WHERE coef <> 0 GROUP BY formula_id", "terms")
def definite_integrals(spark, d):
    return Y.definite_integral(T.terms(spark, d), -1, 2).withColumn("value", F.round("value", 6))


@query("limits", "SELECT formula_id, round(sum(coef * 3.0::DOUBLE ^ power), 6) AS value FROM terms GROUP BY formula_id", "terms")
def limits(spark, d):
    return Y.value_at(T.terms(spark, d), 3).withColumn("value", F.round("value", 6))


@query(
    "roots",
    """WITH q AS (SELECT formula_id, coalesce(max(power) FILTER (coef <> 0), 0) AS degree, coalesce(sum(coef) FILTER (power = 0), 0) AS c, coalesce(sum(coef) FILTER (power = 1), 0) AS b, coalesce(sum(coef) FILTER (power = 2), 0) AS a FROM terms WHERE coef <> 0 GROUP BY formula_id),
    e AS (SELECT *, b * b - 4 * a * c AS dd, sqrt(greatest(b * b - 4 * a * c, 0)) AS s FROM q)
    SELECT formula_id, degree, round(CASE WHEN degree = 1 THEN -c / b WHEN degree = 2 AND dd >= 0 THEN least((-b - s) / (2 * a), (-b + s) / (2 * a)) END, 6) + 0.0 AS root1, round(CASE WHEN degree = 2 AND dd > 0 THEN greatest((-b - s) / (2 * a), (-b + s) / (2 * a)) END, 6) + 0.0 AS root2 FROM e""",
    "terms",
)
def roots(spark, d):
    return Y.solve(T.terms(spark, d)).select("formula_id", "degree", (F.round("root1", 6) + 0.0).alias("root1"), (F.round("root2", 6) + 0.0).alias("root2"))


@query(
    "terms_to_latex",
    """WITH t AS (SELECT formula_id, power, coef, CASE WHEN abs(coef) = floor(abs(coef)) THEN CAST(CAST(abs(coef) AS BIGINT) AS VARCHAR) ELSE CAST(abs(coef) AS VARCHAR) END AS s FROM terms WHERE coef <> 0),
    u AS (SELECT formula_id, string_agg(CASE WHEN coef < 0 THEN ' - ' ELSE ' + ' END || CASE WHEN power = 0 THEN s WHEN abs(coef) = 1 THEN 'x' ELSE s || 'x' END || CASE WHEN power > 1 THEN '^{' || power || '}' ELSE '' END, '' ORDER BY power DESC) AS l FROM t GROUP BY formula_id)
    SELECT formula_id, CASE WHEN starts_with(l, ' - ') THEN '-' ELSE '' END || substr(l, 4) AS latex FROM u""",
    "terms",
)
def terms_to_latex(spark, d):
    return Y.to_latex(T.terms(spark, d))


@query(
    "special_solutions",
    _RECORD + " SELECT formula_id, CASE kind WHEN 'set_expression' THEN 'set operations' ELSE 'logic expression' END AS type, replace(ops, '|', ', ') AS operations, replace(vars, '|', ', ') AS letters FROM r WHERE kind IN ('set_expression', 'logic_expression') AND ops <> ''",
    "latex",
)
def special_solutions(spark, d):
    r = computed_records(T.spread(T.latex(spark, d))).where("solution['type'] is not null")
    s = F.col("solution")
    return r.select("formula_id", s["type"].alias("type"), F.coalesce(s["operations"], s["quantifiers_or_connectives"]).alias("operations"), F.coalesce(s["elements"], s["variables"]).alias("letters"))


#: What each of the worked formulas comes to, by hand: method, power and coefficient.
_WORKED = """r AS (SELECT formula_id, kind, a, b, CASE WHEN kind IN (5, 7, 9) THEN 'solve' WHEN kind = 1 THEN 'derivative' WHEN kind IN (2, 3) THEN 'integral' WHEN kind = 4 THEN 'limit' ELSE 'simplify' END AS method,
  CASE kind WHEN 0 THEN [a * b * b, b * b - 2 * a * b, a - 2 * b, 1] WHEN 1 THEN [b, 0, 3 * a] WHEN 2 THEN [0, -b, 0, a / 3.0] WHEN 3 THEN [a * b * b / 2.0] WHEN 4 THEN [(a + b) * (a + b)]
  WHEN 5 THEN [-a * b, b - a, 1] WHEN 6 THEN [0, 0, a / 2.0] WHEN 7 THEN [-a - b, 0, 1] WHEN 8 THEN [a * b, -a - b, 1] WHEN 9 THEN [a, 0, 1] END::DOUBLE[] AS coefs FROM worked WHERE kind < 10)"""


@query("computed_results", f"WITH {_WORKED} SELECT formula_id, method, CAST(power AS INT) AS power, round(coefs[power + 1], 6) AS coef FROM r, range(4) t(power) WHERE power < len(coefs) AND coefs[power + 1] <> 0", "worked")
def computed_results(spark, d):
    r = calculus.computed(T.spread(T.worked(spark, d))).where("formula_id % 12 < 10")
    return r.select("formula_id", "computed.method", F.posexplode("computed.result").alias("power", "coef")).where("coef <> 0").withColumn("coef", F.round("coef", 6))


@query(
    "expanded_terms",
    f"""WITH {_WORKED}, s AS (SELECT formula_id, CAST(side AS INT) AS side, CASE WHEN side = 0 AND kind = 7 THEN [-a, 0, 1] WHEN side = 0 THEN coefs WHEN kind = 7 THEN [b] ELSE [0] END::DOUBLE[] AS coefs FROM r, range(2) t(side) WHERE method = 'simplify' AND side = 0 OR method = 'solve')
    SELECT formula_id, side, CAST(power AS INT) AS power, coefs[power + 1] AS coef FROM s, range(4) t(power) WHERE power < len(coefs) AND coefs[power + 1] <> 0""",
    "worked",
)
def expanded_terms(spark, d):
    return calculus.expand_terms(T.spread(T.worked(spark, d)))


def _number_sql(v: str) -> str:
    """A number without its sign: whole, a fraction, or twelve decimals."""
    by = f"list_filter(range(1, 61), lambda k: abs(abs({v}) * k - round(abs({v}) * k)) < 1e-9)[1]"
    whole = f"CAST(CAST(round(abs({v}) * {by}) AS BIGINT) AS VARCHAR)"
    decimal = f"regexp_replace(CAST(CAST(abs({v}) AS DECIMAL(38,12)) AS VARCHAR), '\\.?0+$', '')"
    return f"CASE WHEN {by} = 1 THEN {whole} WHEN {by} IS NOT NULL THEN '\\frac{{' || {whole} || '}}{{' || {by} || '}}' ELSE {decimal} END"


_TERMS_SQL = f"""e AS (SELECT formula_id, power, coefs[power + 1] AS c FROM r, range(4) t(power) WHERE power < len(coefs) AND coefs[power + 1] <> 0),
    n AS (SELECT *, {_number_sql("c")} AS s FROM e),
    j AS (SELECT formula_id, string_agg(CASE WHEN c < 0 THEN ' - ' ELSE ' + ' END || CASE WHEN power = 0 THEN s WHEN abs(c) = 1 THEN 'x' ELSE s || 'x' END || CASE WHEN power > 1 THEN '^{{' || power || '}}' ELSE '' END, '' ORDER BY power DESC) AS l FROM n GROUP BY formula_id),
    u AS (SELECT r.*, CASE WHEN starts_with(l, ' - ') THEN '-' ELSE '' END || substr(l, 4) AS t, sqrt(a + b) AS root, sqrt(a) AS size FROM r JOIN j USING (formula_id))"""


@query(
    "computed_solutions",
    f"""WITH {_WORKED}, {_TERMS_SQL}, v AS (SELECT *, {_number_sql("root")} AS rs, CASE WHEN a = 1 THEN '' ELSE {_number_sql("size")} END AS ss FROM u)
    SELECT formula_id, method, CASE kind WHEN 2 THEN t || ' + C' WHEN 5 THEN '-' || b || ', ' || a WHEN 7 THEN '-' || rs || ', ' || rs WHEN 9 THEN '-' || ss || 'i, ' || ss || 'i' ELSE t END AS answer,
    CASE WHEN kind = 0 OR method <> 'simplify' AND method <> 'solve' THEN t WHEN method = 'solve' THEN t || ' = 0' ELSE t END AS terms,
    CASE WHEN kind = 8 AND a = b THEN '(x - ' || a || ')^{{2}}' WHEN kind = 8 THEN '(x - ' || least(a, b) || ')(x - ' || greatest(a, b) || ')' WHEN method = 'simplify' THEN t END AS factored FROM v""",
    "worked",
)
def computed_solutions(spark, d):
    r = computed_records(T.spread(T.worked(spark, d))).where("solution is not null")
    s = F.col("solution")
    answer = F.coalesce(s["result"], s["results"], s["expanded"])
    terms = F.when(s["method"] == "simplify", s["expanded"]).otherwise(F.col("simplified"))
    return r.select("formula_id", s["method"].alias("method"), answer.alias("answer"), terms.alias("terms"), s["factored"].alias("factored"))
