"""Answer normalisers: ordered LaTeX and text clean-ups as one column expression each.

Steps are single-use replacements where possible: a step that names its input
twice would double the expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units a loose comparison ignores, in the order they are removed.
UNITS = (
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour",
    "day", "week", "month", "year", "foot", "feet", "inch", "yard",
)


def _drop(x: Column, *texts: str) -> Column:
    for text in texts:
        x = F.replace(x, F.lit(text), F.lit(""))
    return x


def _swap(x: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def _brace_frac(x: Column) -> Column:
    """\\frac12 and \\frac1{72} get their braces; a last \\frac with one character left undoes nothing else."""
    x = F.regexp_replace(x, r"\\frac([^{\\])([^{])", r"\\frac{$1}{$2}")
    return F.regexp_replace(x, r"\\frac([^{\\])(?=\{)", r"\\frac{$1}")


def _brace_sqrt(x: Column) -> Column:
    return F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}")


def _slash_to_frac(x: Column) -> Column:
    return F.regexp_replace(x, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def _plain_latex(x: Column) -> Column:
    """Fractions as a/b, behind a number as n+a/b; roots as sqrt(a); pi and products by name."""
    x = _brace_sqrt(_brace_frac(F.regexp_replace(x, r"\\[td]frac", r"\\frac")))
    x = F.regexp_replace(x, r"\\sqrt\{([^{}]*)\}", "sqrt($1)")
    x = F.regexp_replace(x, r"(\d) *\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1+$2/$3")
    x = F.regexp_replace(x, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")
    return _swap(x, ("\\pi", "pi"), ("\\cdot", "*"), ("\\times", "*"), ("\\infty", "inf"))


def _leading_zero(x: Column) -> Column:
    return F.regexp_replace(_swap(x, (" .", " 0."), ("{.", "{0.")), r"^\.", "0.")


def _assigned_value(x: Column) -> Column:
    """`k=5` becomes `5` when exactly one `=` follows at most two characters."""
    return F.regexp_replace(x, "^[^=]{0,2}=([^=]*)$", "$1")


def normalize_answer(answer: Column) -> Column:
    x = F.trim(F.regexp_replace(F.trim(answer), r"^\\text\{(.+?)\}$", "$1"))
    x = _drop(x, "\n", "\\!")
    x = _swap(x, ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"))
    x = _drop(x, "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$")
    x = F.regexp_replace(x, r"^((?:(?!\\text\{ )[\s\S])*)\\text\{ [\s\S]*$", "$1")
    x = _leading_zero(_drop(x, "\\%"))
    x = _brace_sqrt(_assigned_value(x))
    x = _brace_frac(_drop(x, " "))
    x = F.regexp_replace(x, r"^0\.5$", r"\\frac{1}{2}")
    return _slash_to_frac(x)


def normalize_answer_loose(answer: Column) -> Column:
    x = F.regexp_replace(answer, r"^\\text\{(.+?)\}$", "$1")
    x = _drop(_swap(x, ("\\%", "%"), ("\\$", "$")), "$", "%")
    x = _swap(x, (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))
    for unit in UNITS:
        x = F.regexp_replace(x, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
    x = F.regexp_replace(x, r"\^ *\\circ", "")
    x = F.regexp_replace(x, r"^\{([\s\S]*)\}$", "$1")
    x = F.regexp_replace(x, r",\\! *", "")
    x = _plain_latex(_integral(x))
    x = F.regexp_replace(x, "- *", "-")
    x = F.regexp_replace(x, "([0-9]) +([0-9])", "$1+$2")
    x = F.lower(_drop(x, " ", "{", "}"))
    whole = r"^-?[\d,]*\d(\.0*)?$"
    return F.when(x.rlike(whole), _integral(_drop(x, ","))).otherwise(x)


def _integral(x: Column) -> Column:
    """A number equal to an integer to 7 decimals is written as that integer; anything else stays."""
    return F.regexp_replace(x, r"^(-?)0*(\d+?)(?:\.0*|\.0{7}\d*)?$", "$1$2")


def strip_string(answer: Column) -> Column:
    x = F.regexp_replace(_drop(F.trim(answer), "\n"), r"\.+$", "")
    x = F.regexp_replace(_drop(x, "\\!"), r"^\\text\{([\s\S]*)\}$", "$1")
    x = _drop(_swap(x, ("tfrac", "frac"), ("dfrac", "frac"), ("cfrac", "frac")), "\\left", "\\right")
    x = F.trim(F.regexp_replace(x, r"(\S)\s*\\text\{.*?\}$", "$1"))
    x = F.trim(_drop(x, "^{\\circ}", "^\\circ"))
    x = F.trim(F.regexp_replace(x, r"\{(c|m)?m\}(\^(2|3))?", ""))
    x = F.trim(F.regexp_replace(x, r"p\.m\.$", ""))
    x = F.trim(F.regexp_replace(x, r"(\d)\s*t$", "$1"))
    x = _drop(x, "\\$", "$", "x\\in")
    x = _swap(x, ("\\%", "%"), (" .", " 0."), ("{.", "{0."))
    x = _swap(_drop(x, "\\cdot"), ("infinity", "\\infty"))
    x = F.when(x.contains("\\infty"), x).otherwise(_swap(x, ("inf", "\\infty")))
    x = F.regexp_replace(_drop(x, "\\mathbf", "\\mathrm"), r"\\mbox\{.*?\}", "")
    x = F.when(x.contains("j") & ~x.contains("i"), _swap(x, ("j", "i"))).otherwise(x)
    x = F.regexp_replace(x, r"(\d+)\.0+([^\d])", "$1$2")
    x = F.regexp_replace(x, r"(\d+)\.0+$", "$1")
    x = _brace_sqrt(F.regexp_replace(x, r"^\.", "0."))
    x = F.regexp_replace(x, r"\\tan(-?[0-9.a-zA-Z]+)", r"\\tan{$1}")
    x = F.regexp_replace(x, r"\\tan\s+(\w+)$", r"\\tan{$1}")
    # an integer or something with a root, on both sides of a single slash
    side = r"(0|-?[1-9][0-9]*|[^/]*sqrt[^/]*)"
    x = F.regexp_replace(_brace_frac(_drop(x, " ")), f"^{side}/{side}$", r"\\frac{$1}{$2}")
    return F.regexp_replace(x, r"(\\|,|\.)+$", "")
