"""Polynomials from LaTeX against numpy, and what is computed from them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formulaspark.functions import algebra as A
from formulaspark.operators import calculus
from formulaspark.plans.pipelines import computed_records

READ = {
    "x^{2}": [0, 0, 1], "{x}^{2}": [0, 0, 1], r"2 \cdot x": [0, 2], r"\frac{1}{2}x": [0, 0.5], "(x+1)(x-2)^2": [4, 0, -3, 1], r"\left(x+1\right)^{2}": [1, 2, 1],
    r"\dfrac{2x+4}{2}": [2, 1], "1/2x": [0, 0.5], "x/2^2": [0, 0.25], "x^{1+1}": [0, 0, 1], "-(x-1)": [1, -1], "[x]^2": [0, 0, 1], r"x \times x \div 4": [0, 0, 0.25], "x^0": [1], "0x": [0], "((x))": [0, 1],
    r"\frac{\frac{1}{2}}{4}x^{10}": [0] * 10 + [0.125], "x-x+3": [3], r"2\,x": [0, 2],
}
REFUSED = ["", "x++1", "x+", "+", "2x3", "(x", "x)", "(x}", "()", "{}", r"\frac{x^2-1}{x-1}", r"\frac{1}{0}", r"\frac{1}", r"\frac 1 2", "x^x", r"\sin x", "x*-1", "x^{-1}", "x^{1/2}", "x^{101}", "x_1", "^2", "*x", "x^", r"\alpha", None]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "formula_id long, latex string")


def read(spark, texts):
    rows = frame(spark, texts).withColumn("t", F.array(A.tokens(F.col("latex")))).withColumn("p", A.polynomials_of("t")[0])
    return [r.p for r in rows.orderBy("formula_id").collect()]


def test_what_is_read(spark):
    got = read(spark, [*READ, *REFUSED])
    assert dict(zip(READ, got)) == READ
    assert got[len(READ) :] == [None] * len(REFUSED)


def test_random_formulas(spark):
    rng = random.Random(7)

    def grow(depth):
        """A formula with its coefficients, by numpy."""
        if depth == 0 or rng.random() < 0.2:
            n = rng.randint(0, 9)
            return rng.choice([(str(n), np.array([float(n)])), ("x", np.array([0.0, 1.0])), (f"{n}x", np.array([0.0, n])), ("x^{2}", np.array([0.0, 0.0, 1.0]))])
        (a, p), (b, q) = grow(depth - 1), grow(depth - 1)
        n = rng.randint(0, 3)
        power = np.array([1.0])
        for _ in range(n):
            power = np.convolve(power, p)
        wide = max(len(p), len(q))
        p0, q0 = np.pad(p, (0, wide - len(p))), np.pad(q, (0, wide - len(q)))
        return rng.choice([(f"({a})({b})", np.convolve(p, q)), (f"{{{a}}} \\cdot ({b})", np.convolve(p, q)), (f"({a}) + ({b})", p0 + q0), (f"({a})-({b})", p0 - q0), (f"({a})^{n}", power), (f"\\frac{{{a}}}{{4}}", p / 4)])

    made = [grow(4) for _ in range(150)]
    made = [(t, c) for t, c in made if len(c) < 90]
    for (text, want), got in zip(made, read(spark, [t for t, _ in made])):
        size = max(len(want), len(got))
        assert np.allclose(np.pad(want, (0, size - len(want))), np.pad(got, (0, size - len(got)))), text
        assert len(got) == 1 or got[-1] != 0


def test_terms_read_back(spark):
    rows = [(i, [float(v) for v in c]) for i, c in enumerate([[1, -2, 3], [0, 0.5, 0, -1 / 3], [7], [0, -1], [2.5, 1e6], [0.123456789]])]
    table = spark.createDataFrame(rows, "formula_id long, c array<double>").withColumn("latex", A.polynomial_latex(F.col("c"), F.lit("y")))
    back = calculus.computed(table).select("formula_id", "computed.result").collect()
    assert all(np.allclose(r.result, dict(rows)[r.formula_id], rtol=1e-11) for r in back) and len(back) == len(rows)


ANSWERS = {
    r"\frac{d}{dx} x^{3}": ("3x^{2}", {"method": "derivative", "variable": "x", "result": "3x^{2}"}),
    r"\frac{d^{2}}{dx^{2}} (x+1)^3": ("6x + 6", {"method": "derivative", "variable": "x", "result": "6x + 6"}),
    r"\frac{dy^{2}}{dy}": ("2y", {"method": "derivative", "variable": "y", "result": "2y"}),
    r"\int x^{2} dx": (r"\frac{1}{3}x^{3}", {"method": "integral", "variable": "x", "result": r"\frac{1}{3}x^{3} + C"}),
    r"\int_{0}^{2} x^{2} dx": (r"\frac{8}{3}", {"method": "integral", "variable": "x", "from": "0", "to": "2", "result": r"\frac{8}{3}"}),
    r"\int_0^\frac{1}{2} 3 \, dt": (None, None),
    r"\int_{-1}^{\frac{1}{2}} 3 \, dt": (r"\frac{9}{2}", {"method": "integral", "variable": "t", "from": "-1", "to": r"\frac{1}{2}", "result": r"\frac{9}{2}"}),
    r"\lim_{x \to 3} x^{2}": ("9", {"method": "limit", "variable": "x", "point": "3", "result": "9"}),
    r"\lim_{x \to \infty} x": (None, None),
    "x^2 - 4 = 0": ("x^{2} - 4 = 0", {"method": "solve", "variable": "x", "results": "-2, 2"}),
    "(x-1)^2 = 0": ("x^{2} - 2x + 1 = 0", {"method": "solve", "variable": "x", "results": "1"}),
    "{x}^{2} + 2x = -5": ("x^{2} + 2x + 5 = 0", {"method": "solve", "variable": "x", "results": "-1 - 2i, -1 + 2i"}),
    "x^3 = 8": (None, None),
    "3 = 4": (None, None),
    "x y = 1": (None, None),
    "2x + 4 - x": ("x + 4", {"method": "simplify", "variable": "x", "simplified": "x + 4", "expanded": "x + 4", "factored": "(x + 4)"}),
    "x^2 - 1": ("x^2 - 1", {"method": "simplify", "variable": "x", "simplified": "x^2 - 1", "expanded": "x^{2} - 1", "factored": "(x + 1)(x - 1)"}),
    r"A \cap B": (None, {"type": "set operations", "operations": "intersection", "elements": "A, B"}),
    r"\forall x \exists y": (None, {"type": "logic expression", "quantifiers_or_connectives": "universal_quantifier, existential_quantifier", "variables": "x, y"}),
    "(x = 1": (None, None),
    "": (None, None),
}


def test_computed_records(spark):
    out = computed_records(frame(spark, list(ANSWERS)).withColumn("computed_by", F.lit(1)))
    assert out.columns[:3] == ["formula_id", "latex", "computed_by"]
    rows = out.orderBy("formula_id").collect()
    assert {r.latex: (r.simplified, r.solution) for r in rows} == ANSWERS
    told = {r.latex: r for r in rows}
    assert told["x^2 - 4 = 0"].interpretation.endswith(" Result: -2, 2.") and told["x^3 = 8"].warnings == ["no solution was found"]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert computed_records(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("text, sides", [("x(x+1) = 2", {0: {1: 1.0, 2: 1.0}, 1: {0: 2.0}}), ("x^{2}x", {0: {3: 1.0}}), ("(x = 1", {}), (r"\sin x", {})])
def test_expanded_terms(spark, text, sides):
    got: dict = {}
    for r in calculus.expand_terms(frame(spark, [text])).collect():
        got.setdefault(r.side, {})[r.power] = r.coef
    assert got == sides
