"""Formulas that are computed: equations solved, expressions expanded and factored, derivatives,
integrals and limits of polynomials.  All of it is one projection over a LaTeX column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulaspark.functions import algebra as A

_GROUP = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
_BOUND = rf"(?:{_GROUP}|([^{{}}\\\s]))"
#: Heads: ``\frac{d^{n}}{dx^{n}} body`` or ``\frac{d body}{dx}``, ``\int_{a}^{b} body dx``, ``\lim_{x \to a} body``.
_DERIVATIVE = rf"^\s*\\frac\s*\{{\s*(?:d|\\partial)\s*(?:\^\s*(?:\{{\s*([0-9]+)\s*\}}|([0-9])))?\s*(.*?)\s*\}}\s*\{{\s*(?:d|\\partial)\s*([A-Za-z])\s*(?:\^\s*(?:\{{\s*([0-9]+)\s*\}}|([0-9])))?\s*\}}(.*)$"
_INTEGRAL = rf"^\s*\\int(?:\s*_\s*{_BOUND}\s*\^\s*{_BOUND})?(.*?)(?:\\[,;:!]|\s)*d\s*([A-Za-z])\s*$"
_LIMIT = rf"^\s*\\lim\s*_\s*\{{\s*([A-Za-z])\s*\\(?:to|rightarrow)(?![A-Za-z])((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}(.*)$"
#: Derivatives beyond this order are not computed.
MOST_ORDER = 20


def _found(latex: Column, pattern: str, *groups: int) -> Column:
    """The first of ``groups`` that the pattern fills, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(latex, pattern, g), F.lit("")) for g in groups])


def kinds(latex: Column) -> Column:
    """Whether a formula is a derivative, an integral, a limit."""
    return F.array(*[latex.rlike(p) for p in (_DERIVATIVE, _INTEGRAL, _LIMIT)])


def heads(latex: Column, kinds: Column) -> dict[str, Column]:
    """What a formula of ``kinds`` asks for: ``method``, its ``letter``, ``degree_of`` a derivative, bounds or point, and its ``body``."""
    derivative, integral, limit = (F.get(kinds, i) for i in range(3))
    order = F.coalesce(_found(latex, _DERIVATIVE, 1, 2), F.lit("1"))
    same = order == F.coalesce(_found(latex, _DERIVATIVE, 5, 6), F.lit("1"))
    inside, after = F.regexp_extract(latex, _DERIVATIVE, 3), F.trim(F.regexp_extract(latex, _DERIVATIVE, 7))
    body = F.when(after == "", inside).when(inside == "", after)
    sides = F.split(latex, "=")
    return {
        "method": F.when(derivative, "derivative").when(integral, "integral").when(limit, "limit").when(F.size(sides) == 2, "solve").otherwise("simplify"),
        "letter": F.when(derivative, F.regexp_extract(latex, _DERIVATIVE, 4)).when(integral, F.regexp_extract(latex, _INTEGRAL, 6)).when(limit, F.regexp_extract(latex, _LIMIT, 1)),
        "order": F.when(derivative & same, order.try_cast("int")),
        "body": F.when(derivative, F.nullif(body, F.lit(""))).when(integral, F.trim(F.regexp_extract(latex, _INTEGRAL, 5))).when(limit, F.regexp_extract(latex, _LIMIT, 3)).when(F.size(sides) == 2, F.get(sides, 0)).otherwise(latex),
        "first": F.when(integral, _found(latex, _INTEGRAL, 1, 2)).when(limit, F.regexp_extract(latex, _LIMIT, 2)).when(~derivative & (F.size(sides) == 2), F.get(sides, 1)),
        "second": F.when(integral, _found(latex, _INTEGRAL, 3, 4)),
    }


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: a generator of one value, through which the
    optimiser does not copy the expression into all that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def computed(formulas: DataFrame) -> DataFrame:
    """``formulas`` with a struct ``computed``: ``method, letter, body, first, second, result, degree, roots, middle, distance``.

    ``body``, ``first`` and ``second`` are coefficients, lowest power first: of what stands under the
    head or on the left of an equation; of the lower bound, the point or the right side; of the upper
    bound.  ``result`` has those of the derivative, of the antiderivative or the value of a definite
    integral, of the limit (polynomials are continuous), of the equation brought to one side, or of
    the expanded expression.  ``roots`` are the real roots, in order, of equations of degree 1 or 2;
    complex ones are ``middle`` plus and minus ``distance`` times i.  Whatever is no polynomial in one
    letter, that of the head if it names one, is null.
    """
    # heads are matched once, what they ask for is taken out once, and only texts that are there are read
    made = _once(formulas, "__kinds", kinds(F.col("latex")))
    made = _once(made, "__head", F.struct(*[v.alias(n) for n, v in heads(F.col("latex"), F.col("__kinds")).items()]))
    h = F.col("__head")
    tokens = F.transform(F.array(h["body"], h["first"], h["second"]), lambda text: F.when(text.isNotNull(), A.tokens(text)))
    asked = F.struct(*[h[n].alias(n) for n in ("method", "letter", "order")], h["first"].isNotNull().alias("bounded"), tokens.alias("tokens"))
    made = _once(_once(made, "__asked", asked), "__found", A.polynomials_of("__asked.tokens"))
    used = A.letters(F.flatten(F.filter("__asked.tokens", lambda t: t.isNotNull())))
    letter = F.coalesce("__asked.letter", F.get(used, 0))
    fits = (F.size(used) <= 1) & F.coalesce(F.get(used, 0) == letter, F.lit(True))
    read = F.struct(letter.alias("letter"), *[F.when(fits, F.get("__found", i)).alias(n) for i, n in enumerate(("body", "first", "second"))])
    made = _once(made, "__read", read)
    body, first, second = (F.col(f"__read.{n}") for n in ("body", "first", "second"))
    point = lambda c: F.when(F.size(c) == 1, F.get(c, 0))
    order = F.col("__asked.order")
    derived = F.when(order.between(1, MOST_ORDER), F.aggregate(F.sequence(F.lit(1), order), body, lambda c, _: A.derivative(c)))
    whole = A.integral(body)
    definite = A.value_at(whole, point(second)) - A.value_at(whole, point(first))
    one = lambda v: F.when(v.isNotNull(), F.array(v))
    method = F.col("__asked.method")
    result = (
        F.when(method == "derivative", derived)
        .when((method == "integral") & F.col("__asked.bounded"), one(definite))
        .when(method == "integral", whole)
        .when(method == "limit", one(A.value_at(body, point(first))))
        .when(method == "solve", A.difference(body, first))
        .otherwise(body)
    )
    made = _once(made, "__result", result)
    q, top = F.col("__result"), A.degree(F.col("__result"))
    c, b, a = (F.get(q, i) for i in range(3))
    d = b * b - 4 * a * c
    middle, distance = F.try_divide(-b, 2 * a) + 0.0, F.try_divide(F.sqrt(F.abs(d)), F.abs(2 * a))
    real = F.when(top == 1, F.array(F.try_divide(-c, b))).when((top == 2) & (d == 0), F.array(middle)).when((top == 2) & (d > 0), F.array(middle - distance, middle + distance))
    pair = (method == "solve") & (top == 2) & (d < 0)
    out = {"method": method, "letter": F.col("__read.letter"), "body": body, "first": first, "second": second, "result": q, "degree": top}
    out |= {"roots": F.when(method.isin("solve", "simplify"), F.transform(real, lambda r: r + 0.0)), "middle": F.when(pair, middle), "distance": F.when(pair, distance)}
    return _once(made, "computed", F.struct(*[v.alias(n) for n, v in out.items()])).drop("__kinds", "__head", "__asked", "__found", "__read", "__result")


def answered(made: DataFrame) -> DataFrame:
    """Tables of ``computed`` with structs of texts: ``answer, simplified, solution``, null where nothing was computed.

    ``answer`` has the roots, the derivative, the antiderivative with its constant, the value, or the
    expanded terms.  ``simplified`` is the result without a constant of integration, an equation
    brought to one side, or the shorter of an expression and its expanded form.  ``solution`` has
    the fields by name.
    """
    r = F.col("computed")
    letter, method = F.coalesce(r["letter"], F.lit("x")), r["method"]
    lead = F.get(r["result"], F.size(r["result"]) - 1)
    polynomials = F.array(r["result"], r["first"], r["second"])
    numbers = F.concat(F.array(lead, r["middle"], r["distance"]), F.coalesce(r["roots"], F.array().cast("array<double>")))
    made = _once(made, "__texts", F.transform(polynomials, lambda c: A.polynomial_latex(c, letter)))
    made = _once(made, "__numbers", F.transform(numbers, A.signed_number))
    terms, first, second = (F.get("__texts", i) for i in range(3))
    lead_text, middle, distance = (F.get("__numbers", i) for i in range(3))
    roots = F.when(r["roots"].isNotNull(), F.slice("__numbers", 4, F.greatest(F.size(r["roots"]), F.lit(1))))

    size = F.when(distance == "1", "").otherwise(distance)
    around = F.when(r["middle"] == 0, F.concat(F.lit("-"), size, F.lit("i, "), size, F.lit("i"))).otherwise(F.concat(middle, F.lit(" - "), size, F.lit("i, "), middle, F.lit(" + "), size, F.lit("i")))
    constant = (method == "integral") & second.isNull()
    answer = F.when(method == "solve", F.coalesce(F.array_join(roots, ", "), around)).when(constant, F.concat(terms, F.lit(" + C"))).otherwise(terms)
    short = F.when(F.length(terms) < F.length("latex"), terms).when(terms.isNotNull(), F.col("latex"))
    simplified = F.when(method == "solve", F.concat(terms, F.lit(" = 0"))).when(method == "simplify", short).otherwise(terms)

    # a product of linear factors, where there are real roots
    factor = lambda t: F.when(t == "0", letter).when(t.startswith("-"), F.concat(F.lit("("), letter, F.lit(" + "), F.substring(t, F.lit(2), F.length(t)), F.lit(")"))).otherwise(F.concat(F.lit("("), letter, F.lit(" - "), t, F.lit(")")))
    twice = (r["degree"] == 2) & (F.size(r["roots"]) == 1)
    before = F.when(lead == 1, "").when(lead == -1, "-").otherwise(lead_text)
    product = F.concat(before, F.array_join(F.transform(roots, factor), ""), F.when(twice, "^{2}").otherwise(""))
    monomial = (r["degree"] == 1) & (F.get(r["result"], 0) == 0)
    factored = F.when(roots.isNotNull() & ~monomial, product).otherwise(terms)
    asked = method.isin("derivative", "integral", "limit")
    fields = {"method": method, "variable": r["letter"], "results": F.when(method == "solve", answer), "result": F.when(asked, answer)}
    fields |= {"point": F.when(method == "limit", first), "from": F.when(method == "integral", first), "to": F.when(method == "integral", second)}
    fields |= {n: F.when(method == "simplify", v) for n, v in (("simplified", short), ("expanded", terms), ("factored", factored))}
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in fields.items()]), lambda e: e["value"].isNotNull())
    made = _once(made, "answered", F.struct(answer.alias("answer"), simplified.alias("simplified"), entries.alias("entries")))
    whole = F.when(F.col("answered.answer").isNotNull(), F.map_from_entries("answered.entries"))
    return _once(made, "told", F.struct(F.col("answered.answer"), F.col("answered.simplified"), whole.alias("solution"))).drop("__texts", "__numbers", "answered")


def expand_terms(formulas: DataFrame) -> DataFrame:
    """``formula_id, side, power, coef``: terms of expressions and of both sides of equations, multiplied
    out and combined, without zeros; formulas that are no polynomials give no rows."""
    made = computed(formulas).where("computed.method in ('simplify', 'solve') and computed.result is not null")
    sides = F.when(F.col("computed.first").isNull(), F.array("computed.body")).otherwise(F.array("computed.body", "computed.first"))
    rows = made.select("formula_id", F.posexplode(sides).alias("side", "coefs")).select("formula_id", "side", F.posexplode("coefs").alias("power", "coef"))
    return rows.where("coef <> 0")
