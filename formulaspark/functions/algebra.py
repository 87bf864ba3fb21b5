"""Polynomials in one letter as column expressions over LaTeX text.

A formula is read by one fold over its tokens.  The state is a stack of open groups, each with
the sum of its finished terms, the product of the current term and the last factor, which a power
may still follow; polynomials are arrays of coefficients, lowest power first, and products
are convolutions.  So any nesting of groups is one projection: no exchange, no Python.

What is read: numbers, one letter, ``+ - * / ^``, ``\\cdot``, ``\\times``, ``\\div``, round, square and
curly brackets (also with ``\\left``, ``\\right``), ``\\frac``; a letter, group or fraction may follow
a factor without a sign.  Divisors must be constant and not 0, exponents whole, from 0 to
``MOST_POWER``.  All else (other commands, two letters, a sign without an operand, brackets that
do not match) gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exponents and degrees beyond are not expanded.
MOST_POWER = 100

TOKEN = r"\\frac|[0-9]+(?:\.[0-9]+)?|[A-Za-z]|[-+*/^(){}]"
#: Spellings and what they are read as, in order.
SPELLINGS = [
    (r"\\(?:left|right)(?![A-Za-z])\.?", ""),
    (r"\\[,;:!]", ""),
    (r"\\(?:d|t|c)frac(?![A-Za-z])", r"\\frac"),
    (r"\\(?:cdot|times|ast)(?![A-Za-z])", "*"),
    (r"\\div(?![A-Za-z])", "/"),
    (r"\s+", ""),
    (r"\[", "("),
    (r"\]", ")"),
]

_NO_TERM = "cast(null as array<double>)"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _product(a: str, b: str) -> str:
    inner = f"aggregate(sequence(greatest(0, pk - size({b}) + 1), least(pk, size({a}) - 1)), 0D, (pz, pi) -> pz + get({a}, pi) * get({b}, pk - pi))"
    return f"transform(sequence(0, size({a}) + size({b}) - 2), pk -> {inner})"


def _sum(a: str, b: str) -> str:
    return f"transform(sequence(0, greatest(size({a}), size({b})) - 1), qi -> coalesce(get({a}, qi), 0D) + coalesce(get({b}, qi), 0D))"


def _constant(a: str) -> str:
    """The value of a polynomial without the letter, else null."""
    return f"case when forall(slice({a}, 2, size({a})), vc -> vc = 0) then get({a}, 0) end"


def _quotient(a: str, b: str) -> str:
    return _let("qd", _constant(b), f"case when qd <> 0 then transform({a}, qc -> qc / qd) end")


def _power(a: str, b: str) -> str:
    fits = f"rn between 0 and {MOST_POWER} and rn = floor(rn) and rn * (size({a}) - 1) <= {MOST_POWER}"
    raised = f"aggregate(array_repeat(0, cast(rn as int)), array(1D), (ra, rb) -> {_product('ra', a)})"
    return _let("rn", _constant(b), f"case when {fits} then {raised} end")


#: An open group: its bracket, finished terms, current term, last factor, whether that divides, and what it waits for.
_FRAME = ("kind", "total", "product", "last", "divides", "op")
_STACK = "array<struct<kind:string,total:array<double>,product:array<double>,last:array<double>,divides:boolean,op:string>>"
_BAD = f"cast(null as {_STACK})"


def _frame(of: str, **new: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {new.get(n, f'{of}.{n}')}" for n in _FRAME) + ")"


def _opened(kind: str) -> str:
    return _frame("", kind=kind, total="array(0D)", product="array(1D)", last=_NO_TERM, divides="false", op="''")


def _term(f: str) -> str:
    """The current term, with its last factor."""
    return f"case when {f}.divides then {_quotient(f'{f}.product', f'{f}.last')} else {_product(f'{f}.product', f'{f}.last')} end"


def _received(f: str, v: str) -> str:
    """The group ``f`` after the factor ``v``."""
    op = f"case when endswith({f}.op, 'frac') then 'over' else '' end"
    product = f"case when {f}.last is null then {f}.product else {_term(f)} end"
    divides = f"{f}.last is not null and startswith({f}.op, '/')"
    return (
        f"case when {f}.op = '^' then {_frame(f, last=_power(f'{f}.last', v), op=_EMPTY)}"
        f" when {f}.op = 'over' then {_frame(f, last=_quotient(f'{f}.last', v), op=_EMPTY)}"
        f" else {_frame(f, product=product, last=v, divides=divides, op=op)} end"
    )


_EMPTY = "''"


def _step(s: str, t: str) -> str:
    """The stack ``s`` after the token ``t``; null from where the text is no polynomial."""
    frac = "(f.op = 'over' or endswith(f.op, 'frac'))"
    done = "(f.op = '' and f.last is not null)"
    closing = f"{t} in (')', '}}')"
    matched = f"(({t} = ')' and f.kind = '(') or ({t} = '}}' and f.kind = '{{'))"
    # w: the group so far, where a sign or bracket ends its term
    whole = f"case when {done} and ({closing} or {t} in ('+', '-')) then {_sum('f.total', _term('f'))} end"
    value = f"case when {closing} then w when {t} rlike '^[0-9]' then array(cast({t} as double)) else array(0D, 1D) end"
    group, rest = f"element_at({s}, case when {closing} then size({s}) - 1 else size({s}) end)", f"slice({s}, 1, size({s}) - case when {closing} then 2 else 1 end)"
    factor = _let("b", group, _let("v", value, f"array_append({rest}, {_received('b', 'v')})"))
    put = lambda frame: f"array_append(slice({s}, 1, size({s}) - 1), {frame})"
    signed = _frame("f", total="coalesce(w, f.total)", product=f"array(case when {t} = '-' then -1D else 1D end)", last=_NO_TERM, divides="false", op="'+'")
    step = f"""case
      when {t} in ('(', '{{') then case when {t} = '{{' or not {frac} then array_append({s}, {_opened(t)}) end
      when {closing} and not (size({s}) > 1 and {done} and {matched}) or not {closing} and {frac} then null
      when {t} in ('+', '-') then case when f.op = '' then {put(signed)} end
      when {t} in ('*', '/', '^') then case when {done} then {put(_frame("f", op=t))} end
      when {t} = '\\\\frac' then case when f.op <> '^' then {put(_frame("f", op="concat(f.op, 'frac')"))} end
      when {t} rlike '^[0-9]' and {done} or {t} rlike '^[A-Za-z]' and f.op = '^' then null
      else {factor} end"""
    return f"case when {s} is null then {_BAD} else " + _let("f", f"element_at({s}, -1)", _let("w", whole, step)) + " end"


def tokens(latex: Column) -> Column:
    """The tokens of a formula; null if it holds anything else."""
    text = latex
    for pattern, by in SPELLINGS:
        text = F.regexp_replace(text, pattern, by)
    # lists of one, so that the spelling and the tokens are written once
    split = F.transform(F.array(text), lambda t: F.struct(t.alias("text"), F.regexp_extract_all(t, F.lit(f"({TOKEN})"), F.lit(1)).alias("found")))
    whole = F.filter(split, lambda s: (F.size(s["found"]) > 0) & (F.array_join(s["found"], "") == s["text"]))
    return F.get(whole, F.lit(0))["found"]


def letters(tokens: Column) -> Column:
    """The different letters among tokens."""
    return F.array_distinct(F.filter(tokens, lambda t: t.rlike("^[A-Za-z]$")))


def polynomials_of(lists: str) -> Column:
    """For a column of token lists, by its name, the coefficients of each list, lowest power first and
    without leading zeros; null for a list that is null or no polynomial."""
    start = f"cast(array({_opened(_EMPTY)}) as {_STACK})"
    whole = _let("f", "element_at(s, -1)", f"case when size(s) = 1 and f.op = '' and f.last is not null then {_sum('f.total', _term('f'))} end")
    cut = _let("tc", whole, "slice(tc, 1, array_max(transform(tc, (c, i) -> case when c <> 0 then i + 1 else 1 end)))")
    return F.expr(f"transform({lists}, list -> aggregate(list, {start}, (s, t) -> {_step('s', 't')}, s -> {cut}))")


def derivative(coefs: Column) -> Column:
    raised = F.transform(coefs, lambda c, i: c * i)
    return F.when(F.size(coefs) > 1, F.slice(raised, 2, F.size(coefs))).otherwise(F.when(coefs.isNotNull(), F.array(F.lit(0.0))))


def integral(coefs: Column) -> Column:
    """Antiderivative without its constant; that of 0 is 0."""
    zero = (F.size(coefs) == 1) & (F.get(coefs, 0) == 0)
    return F.when(zero, coefs).otherwise(F.concat(F.array(F.lit(0.0)), F.transform(coefs, lambda c, i: c / (i + 1))))


def difference(a: Column, b: Column) -> Column:
    each = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    return F.when(a.isNotNull() & b.isNotNull(), F.transform(each, lambda i: F.coalesce(F.get(a, i), F.lit(0.0)) - F.coalesce(F.get(b, i), F.lit(0.0))))


def degree(coefs: Column) -> Column:
    """The highest power with a coefficient; 0 for constants."""
    return F.array_max(F.transform(coefs, lambda c, i: F.when(c != 0, i).otherwise(0)))


def value_at(coefs: Column, point: Column) -> Column:
    """By Horner's rule."""
    return F.aggregate(F.reverse(coefs), F.lit(0.0), lambda total, c: total * point + c)


def number_latex(number: Column) -> Column:
    """A number without its sign: whole, as a fraction with a denominator of at most 60, or as a decimal."""
    size = F.abs(number)
    near = lambda d: F.abs(size * d - F.round(size * d)) < 1e-9 * F.greatest(F.lit(1.0), size * d)
    decimal = F.coalesce(F.regexp_replace(size.cast("decimal(38,12)").cast("string"), r"\.?0+$", ""), size.cast("string"))

    def fraction(by: Column) -> Column:
        whole = F.round(size * by).cast("long").cast("string")
        return F.when(by == 1, whole).when(by.isNotNull(), F.concat(F.lit("\\frac{"), whole, F.lit("}{"), by.cast("string"), F.lit("}"))).otherwise(decimal)

    # the denominator is looked for once, and only where the number is not whole
    searched = F.get(F.transform(F.array(F.get(F.filter(F.sequence(F.lit(1), F.lit(60)), near), F.lit(0))), fraction), F.lit(0))
    return F.when(size >= 1e15, decimal).when(size == F.floor(size), size.cast("long").cast("string")).otherwise(searched)


def signed_number(number: Column) -> Column:
    return F.concat(F.when(number < 0, "-").otherwise(""), number_latex(number))


def polynomial_latex(coefs: Column, letter: Column) -> Column:
    """Powers descending; ``0`` for the zero polynomial."""

    def term(c: Column, p: Column) -> Column:
        text = number_latex(c)
        body = F.when(p == 0, text).when(F.abs(c) == 1, letter).otherwise(F.concat(text, letter))
        body = F.when(p > 1, F.concat(body, F.lit("^{"), p.cast("string"), F.lit("}"))).otherwise(body)
        return F.when(c != 0, F.concat(F.when(c < 0, " - ").otherwise(" + "), body)).otherwise("")

    def from_first(joined: Column) -> Column:
        rest = F.substring(joined, F.lit(4), F.length(joined))
        return F.when(joined == "", "0").when(joined.startswith(" - "), F.concat(F.lit("-"), rest)).otherwise(rest)

    # a list of one, so that the terms are written once
    return F.when(coefs.isNotNull(), F.get(F.transform(F.array(F.array_join(F.reverse(F.transform(coefs, term)), "")), from_first), F.lit(0)))
