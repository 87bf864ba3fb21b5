"""LaTeX as column expressions: labels, formatting, classes, checks, meaning.

All functions take and return columns and need no shuffle, so they also run on streams.
Null text gives null or empty results, as each function says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels whose LaTeX is not a backslash and the label.
LABEL_EXCEPTIONS = {
    "omicron": "o",
    "Alpha": "A",
    "Beta": "B",
    "Epsilon": "E",
    "Zeta": "Z",
    "Eta": "H",
    "Iota": "I",
    "Kappa": "K",
    "Mu": "M",
    "Nu": "N",
    "Omicron": "O",
    "Rho": "P",
    "Tau": "T",
    "Chi": "X",
    "plus": "+",
    "minus": "-",
    "divide": r"\div",
    "eq": "=",
    "lt": "<",
    "less_than": "<",
    "gt": ">",
    "greater_than": ">",
    "degree": r"^\circ",
    "celsius": r"^\circ\text{C}",
    "prime": "'",
    "dprime": "''",
    "lparen": "(",
    "paren_open": "(",
    "rparen": ")",
    "paren_close": ")",
    "lbracket": "[",
    "bracket_open": "[",
    "rbracket": "]",
    "bracket_close": "]",
    "lbrace": r"\{",
    "brace_open": r"\{",
    "rbrace": r"\}",
    "brace_close": r"\}",
    "forward_slash": "/",
    "double_vertical_bar": r"\|",
    "vertical_bar": "|",
    "checked": r"\checkmark",
    "dollar": r"\$",
    "hash": r"\#",
    "ampersand": r"\&",
    "percent": r"\%",
    "comma": ",",
    "period": ".",
    "colon": ":",
    "semicolon": ";",
    "exclaim": "!",
    "question": "?",
}
#: Labels that pass through as they are although they are words.
PLAIN_LABELS = ("fraction_line", "unknown")


def symbol_latex(label: Column) -> Column:
    """LaTeX of a symbol's label; null gives ''.  Words become commands."""
    known = F.create_map(*[F.lit(x) for pair in LABEL_EXCEPTIONS.items() for x in pair])
    single = F.length(label) == 1
    return (
        F.when(label.isNull(), "")
        .when(known[label].isNotNull(), known[label])
        .when(single & label.isin(list("#$%&_{}")), F.concat(F.lit("\\"), label))
        .when(single | label.isin(*PLAIN_LABELS) | label.rlike("^[0-9]+$"), label)
        .when(label.rlike(r"^math[a-z]+\{.+\}$") | label.rlike("^[A-Za-z]+$"), F.concat(F.lit("\\"), label))
        .otherwise(label)
    )


def format_latex(latex: Column) -> Column:
    """Single blanks, braces made up, blanks on both sides of operators, none inside braces."""
    text = F.trim(F.regexp_replace(latex, r"\s+", " "))
    missing = count_of(text, "{") - count_of(text, "}")
    text = F.concat(F.repeat(F.lit("{"), F.greatest(-missing, F.lit(0))), text, F.repeat(F.lit("}"), F.greatest(missing, F.lit(0))))
    for op in "+-=<>":
        text = F.replace(F.replace(text, F.lit(f"{op} "), F.lit(f" {op} ")), F.lit(f" {op}"), F.lit(f" {op} "))
    return F.regexp_replace(F.regexp_replace(text, r"\{\s+", "{"), r"\s+\}", "}")


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


#: What the classes are recognised by.
SET_OPERATORS = {
    r"\cap": "intersection",
    r"\cup": "union",
    r"\in": "set_membership",
    r"\notin": "set_membership",
    r"\subset": "subset",
    r"\supset": "subset",
    r"\subseteq": "subset",
    r"\supseteq": "subset",
    r"\setminus": "set_difference",
    r"\emptyset": "empty_set",
    r"\bigcup": "union",
    r"\bigcap": "intersection",
}
LOGIC_OPERATORS = {
    r"\forall": "universal_quantifier",
    r"\exists": "existential_quantifier",
    r"\neg": "logical_not",
    r"\lnot": "logical_not",
    r"\land": "logical_and",
    r"\lor": "logical_or",
    r"\wedge": "logical_and",
    r"\vee": "logical_or",
    r"\implies": "implication",
    r"\iff": "equivalence",
}
NUMBER_SETS = {r"\mathbb{N}": "natural numbers", r"\mathbb{Z}": "integers", r"\mathbb{Q}": "rational numbers", r"\mathbb{R}": "real numbers", r"\mathbb{C}": "complex numbers", r"\mathbb{H}": "quaternions"}
INEQUALITY_SIGNS = ["<", ">", r"\leq", r"\geq", r"\neq", r"\le", r"\ge", r"\leqslant", r"\geqslant", r"\lesssim", r"\gtrsim"]
MATRICES = ["matrix", "pmatrix", "bmatrix", "vmatrix"]


def any_of(text: Column, parts) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def classify_formula(latex: Column, mode: str = "contract") -> Column:
    """Type of a formula, the first rule that holds.

    ``literal`` asks for two backslashes before ``lim``, ``int``, ``sum`` and ``prod``, so
    that in usual text those rules never hold.
    """
    slash = "\\" if mode == "contract" else "\\\\"
    return (
        F.when(any_of(latex, [rf"\begin{{{m}}}" for m in MATRICES]), "matrix")
        .when(latex.contains(slash + "lim"), "limit")
        .when(any_of(latex, [slash + w for w in ("int", "iint", "iiint", "oint")]), "integral")
        .when(any_of(latex, [r"\frac{d", r"\frac{\partial", "'"]), "derivative")
        .when(latex.contains(slash + "sum"), "sum")
        .when(latex.contains(slash + "prod"), "product")
        .when(any_of(latex, SET_OPERATORS), "set_expression")
        .when(any_of(latex, LOGIC_OPERATORS), "logic_expression")
        .when(any_of(latex, NUMBER_SETS), "number_set")
        .when(latex.rlike(r"[a-zA-Z]\s*\([^)]+\)\s*="), "function_def")
        .when(any_of(latex, INEQUALITY_SIGNS), "inequality")
        .when(latex.contains("="), "equation")
        .otherwise("expression")
    )


BRACKETS = [("(", ")"), ("[", "]"), ("{", "}"), (r"\{", r"\}")]


def _present(*cases: Column) -> Column:
    return F.filter(F.array(*cases), lambda c: c.isNotNull())


def bracket_errors(latex: Column) -> Column:
    """One message per pair of brackets whose counts differ."""
    cases = []
    for left, right in BRACKETS:
        a, b = count_of(latex, left), count_of(latex, right)
        cases.append(F.when(a != b, F.concat(F.lit(f"unbalanced brackets: {left} "), a.cast("string"), F.lit(f", {right} "), b.cast("string"))))
    return _present(*cases)


#: Operators that must not follow each other.
DOUBLED = ["++", "--", "**", "//", "+*", "*/"]


def operator_errors(latex: Column) -> Column:
    """Doubled operators, and operators at the start or (but for a minus) at the end."""
    cases = [F.when(latex.contains(d), f"operators {d}") for d in DOUBLED]
    return _present(*cases, F.when(latex.rlike(r"^\s*[+*/]"), "starts with an operator"), F.when(latex.rlike(r"[+*/]\s*$"), "ends with an operator"))


def zero_division(latex: Column) -> Column:
    """A warning if a denominator is the number zero."""
    zero = latex.rlike(r"\\frac\{[^{}]*\}\{\s*0+(\.0*)?\s*\}") | latex.rlike(r"/\s*0+(\.0*)?\s*([^0-9.]|$)")
    return _present(F.when(zero, "division by zero"))


def variables(latex: Column) -> Column:
    """Single letters outside commands, sorted."""
    bare = F.regexp_replace(F.regexp_replace(latex, r"\\(begin|end)\{[a-z]*\}", " "), r"\\[A-Za-z]+", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(bare, r"[^A-Za-z]+"), lambda w: F.length(w) == 1)))


def operations(latex: Column) -> Column:
    """Kinds of operations that the text shows, sorted."""
    has = lambda *p: any_of(latex, p)
    return _present(
        F.when(has("+"), "addition"),
        F.when(has(r"\frac{d", r"\frac{\partial"), "differentiation"),
        F.when(has(r"\frac", "/", r"\div"), "division"),
        F.when(has("^"), "exponentiation"),
        F.when(has(r"\exp"), "exponential"),
        F.when(has(r"\int"), "integration"),
        F.when(has(r"\lim"), "limit"),
        F.when(has(r"\log", r"\ln"), "logarithm"),
        F.when(has("*", r"\times", r"\cdot"), "multiplication"),
        F.when(has(r"\sqrt"), "square_root"),
        F.when(has("-"), "subtraction"),
        F.when(has(r"\sum"), "summation"),
        F.when(has(r"\sin", r"\cos", r"\tan"), "trigonometric"),
    )


def special_operations(latex: Column) -> Column:
    """Set and logic operations in the order of their tables, repeats included."""
    return _present(*[F.when(latex.contains(op), name) for op, name in {**SET_OPERATORS, **LOGIC_OPERATORS}.items()])


def special_variables(latex: Column) -> Column:
    """Lone letters after commands and their arguments are gone, as first seen."""
    bare = F.regexp_replace(latex, r"\\[a-zA-Z]+(\{[^}]*\})?", " ")
    return F.array_distinct(F.filter(F.split(bare, r"[^A-Za-z0-9_]+"), lambda w: w.rlike("^[A-Za-z]$")))


def number_sets(latex: Column) -> Column:
    return F.array_join(_present(*[F.when(latex.contains(s), name) for s, name in NUMBER_SETS.items()]), ", ")


def preprocess_latex(latex: Column) -> Column:
    for old, new in ((r"\cdot", r" \cdot "), (r"\times", r" \times "), (r"\div", " / "), (r"\pm", r" \pm ")):
        latex = F.replace(latex, F.lit(old), F.lit(new))
    return F.trim(latex)


#: Patterns and what stands for them, in order.
SIMPLE = [
    (r"\\frac\{([^}]+)\}\{([^}]+)\}", "(($1)/($2))"),
    (r"\\sqrt\{([^}]+)\}", "sqrt($1)"),
    (r"\\sin", "sin"),
    (r"\\cos", "cos"),
    (r"\\tan", "tan"),
    (r"\\log", "log"),
    (r"\\ln", "log"),
    (r"\\exp", "exp"),
    (r"\\pi", "pi"),
    (r"\\infty", "oo"),
    (r"\^", "**"),
    (r"\\times", "*"),
    (r"\\cdot", "*"),
    (r"\\left", ""),
    (r"\\right", ""),
    (r"\\[a-zA-Z]+", ""),
    (r"[{}]", ""),
]


def latex_to_simple(latex: Column) -> Column:
    for pattern, text in SIMPLE:
        latex = F.regexp_replace(latex, pattern, text)
    return latex


def display_latex(latex: Column) -> Column:
    """Alphabets that a plain renderer knows."""
    for old, new in ((r"\mathds", r"\mathbb"), (r"\mathscr", r"\mathcal"), (r"\mathfrak", r"\mathrm")):
        latex = F.replace(latex, F.lit(old), F.lit(new))
    return latex


PHRASES = {
    "equation": "an equation",
    "inequality": "an inequality",
    "expression": "an expression",
    "function_def": "a function definition",
    "derivative": "a derivative",
    "integral": "an integral",
    "limit": "a limit",
    "sum": "a sum",
    "product": "a product",
    "matrix": "a matrix",
    "set_expression": "a set expression",
    "logic_expression": "a logic expression",
    "number_set": "a number set",
    "unknown": "of unknown type",
}
SPECIAL = ("set_expression", "logic_expression", "number_set")


def interpretation(formula_type: Column, names: Column, ops: Column) -> Column:
    """A sentence: type, variables, the first three operations."""
    phrases = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    return F.concat(
        F.lit("This is "),
        F.coalesce(phrases[formula_type], F.lit("an expression")),
        F.when(F.size(names) > 0, F.concat(F.lit(" in "), F.array_join(names, ", "))).otherwise(""),
        F.when(F.size(ops) > 0, F.concat(F.lit(", with "), F.array_join(F.slice(ops, 1, 3), ", "))).otherwise(""),
        F.lit("."),
    )


def semantics(latex: Column, mode: str = "contract") -> dict[str, Column]:
    """The columns of a semantic record.  Blank or null text is ``unknown`` with an error;
    set, logic and number-set formulas skip validation."""
    blank = F.coalesce(F.trim(latex), F.lit("")) == ""
    kind = F.when(blank, "unknown").otherwise(classify_formula(latex, mode))
    special = kind.isin(*SPECIAL)
    none = F.array().cast("array<string>")
    names = F.when(blank, none).when(special, special_variables(latex)).otherwise(variables(latex))
    ops = F.when(blank, none).when(special, special_operations(latex)).otherwise(operations(latex))
    errors = F.when(blank, F.array(F.lit("empty formula"))).when(special, none).otherwise(F.concat(bracket_errors(latex), operator_errors(latex)))
    warnings = F.when(blank | special, none).otherwise(zero_division(latex))
    return {
        "formula_type": kind,
        "variables": names,
        "constants": none,
        "operations": ops,
        "simplified": F.when(kind == "number_set", number_sets(latex)),
        "errors": errors,
        "warnings": warnings,
        "interpretation": interpretation(kind, names, ops),
    }
