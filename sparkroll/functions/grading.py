"""Grades and rewards as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkroll.functions.arrays import let
from sparkroll.functions.normalize import normalize_answer, normalize_answer_loose

TOLERANCE = 1e-3


def grade_exact(given: Column, truth: Column) -> Column:
    """Trimmed, comma-free, case-insensitive equality; a missing answer is wrong."""
    return F.coalesce(F.lower(F.replace(F.trim(given), F.lit(","), F.lit(""))) == F.lower(F.trim(truth)), F.lit(False))


def reward(answer: Column, gold: Column, finish_reason: Column | None = None, penalty: float = 0.0, penalize: bool = True) -> Column:
    """STRUCT<reward, is_unfinished>: 1 or 0 by grade, the penalty for unfinished rollouts."""
    unfinished = answer.isNull()
    score = F.when(grade_exact(answer, gold), 1.0).otherwise(0.0)
    if penalize:
        score = F.when(unfinished, float(penalty)).otherwise(score)
    if finish_reason is not None:
        cut = finish_reason == "length"
        score = F.when(cut, float(penalty)).otherwise(score)
        unfinished = unfinished | cut
    return F.struct(score.alias("reward"), unfinished.alias("is_unfinished"))


def wald_ci_length(mean: Column, count: Column, z: float = 1.96) -> Column:
    """Length of the normal interval of a proportion; NaN where the mean leaves [0, 1]."""
    spread = mean * (1 - mean) / count
    return F.when(spread < 0, float("nan")).otherwise(2 * z * F.sqrt(F.greatest(spread, F.lit(0.0))))


def parse_number(text: Column) -> Column:
    """The value of `1,234.5` or `23%` or `23\\%`, else null."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    percent = F.regexp_extract(plain, r"^(.*?)\\?%$", 1)
    return F.coalesce(plain.try_cast("double"), F.when(plain.endswith("%"), percent.try_cast("double") / 100))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(TOLERANCE), 1e-9 * F.greatest(F.abs(a), F.abs(b)))


def grade_numeric_tolerant(given: Column, truth: Column) -> Column:
    """Equal text, or numbers within 1e-3 of the truth, a hundredth of it, or a hundred times it."""
    g, t = parse_number(given), parse_number(truth)
    numeric = _close(g, t / 100) | _close(g, t) | _close(g, t * 100)
    return F.coalesce((given == truth) | numeric, F.lit(False))


def _elementwise(given: Column, truth: Column, separator: str) -> Column:
    a, b = F.split(given, separator), F.split(truth, separator)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: grade_numeric_tolerant(F.trim(x), F.trim(y))), lambda ok: ok)


def grade_interval_matrix(given: Column, truth: Column) -> Column:
    """Unions, tuples or intervals, and matrices, compared element by element."""
    bracketed = r"^[(\[].+[)\]]$"

    def inner(x: Column) -> Column:
        return F.substring(x, F.lit(2), F.length(x) - 2)

    def one(g: Column, t: Column) -> Column:
        as_tuple = g.rlike(bracketed) & t.rlike(bracketed) & _elementwise(inner(g), inner(t), ",")
        return grade_numeric_tolerant(g, t) | as_tuple

    matrix = r"^\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}$"

    def rows(x: Column) -> Column:
        lines = F.split(F.regexp_extract(x, matrix, 1), r"\\\\")
        return F.filter(F.transform(lines, lambda line: F.trim(line)), lambda line: line != "")

    as_matrix = (
        given.rlike(matrix)
        & truth.rlike(matrix)
        & (F.size(rows(given)) == F.size(rows(truth)))
        & F.forall(F.zip_with(rows(given), rows(truth), lambda x, y: _elementwise(x, y, "&")), lambda ok: ok)
    )
    parts_g, parts_t = F.split(given, r"\\cup"), F.split(truth, r"\\cup")
    # a union matches when every part has a partner on the other side
    covered = F.forall(parts_g, lambda x: F.exists(parts_t, lambda y: one(F.trim(x), F.trim(y))))
    covering = F.forall(parts_t, lambda y: F.exists(parts_g, lambda x: one(F.trim(x), F.trim(y))))
    union = given.contains(r"\cup") & truth.contains(r"\cup") & covered & covering
    return F.coalesce(union | as_matrix | one(given, truth), F.lit(False))


def _is_int(x: Column) -> Column:
    n = F.replace(x, F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(F.abs(n - F.round(n)) <= 1e-7, F.lit(False))


# sign, whole part before +, factor, root or pi, and below a slash factor and root
VALUE = r"^(-?)(?:(\d+)\+)?(\d+(?:\.\d*)?|\.\d+)?\*?(?:sqrt\((\d+(?:\.\d+)?)\)|(pi))?(?:/\(?(\d+(?:\.\d+)?)?\*?(?:sqrt\((\d+(?:\.\d+)?)\))?\)?)?$"


def _value(x: Column) -> Column:
    """The number behind a decimal, a fraction, a mixed number, or a multiple of a root or of pi; else null."""

    def part(group: int, missing: float) -> Column:
        return F.coalesce(F.regexp_extract(x, VALUE, group).try_cast("double"), F.lit(missing))

    pi = F.when(F.regexp_extract(x, VALUE, 5) == "pi", F.pi()).otherwise(1.0)
    below = part(6, 1.0) * F.sqrt(part(7, 1.0))
    size = part(2, 0.0) + part(3, 1.0) * F.sqrt(part(4, 1.0)) * pi / F.when(below != 0, below)
    signed = F.when(F.regexp_extract(x, VALUE, 1) == "-", -size).otherwise(size)
    return F.coalesce(x.try_cast("double"), F.when(x.rlike(VALUE) & x.rlike(r"^-?(\d|\.\d|sqrt|pi)") & ~x.endswith("/"), signed))


def grade_normalized(given: Column, truth: Column) -> Column:
    """Equal after either normaliser, else tuple elements by number.

    Unreduced fractions must match as text, an integer never equals a
    non-integer, and numeric equality stands in for symbolic algebra.
    """
    is_tuple = r"^[(\[][^()\[\]]+[)\]]$"

    def elements(x: Column) -> Column:
        # the loose form keeps separators; 1,234 is one number, not a tuple
        body = F.regexp_replace(x, r"(?<=\d),(?=\d{3}(?:$|\D))", "")
        inside = F.transform(F.split(F.substring(body, F.lit(2), F.length(body) - 2), ","), lambda e: F.trim(e))
        return F.when(body.rlike(is_tuple), inside).otherwise(F.array(body))

    def same(g: Column, t: Column) -> Column:
        fraction = r"^-?\d+/0*[1-9]\d*$"
        numeric = F.coalesce(F.abs(_value(g) - _value(t)) < 1e-9, F.lit(False))
        return F.when(g.rlike(fraction) & t.rlike(fraction), g == t).when(_is_int(g) != _is_int(t), False).otherwise(numeric)

    def compare(v: Column) -> Column:
        brackets = (F.substring(v["g"], 1, 1) == F.substring(v["t"], 1, 1)) & (F.right(v["g"], F.lit(1)) == F.right(v["t"], F.lit(1)))
        by_element = let(
            F.struct(elements(v["g"]).alias("g"), elements(v["t"]).alias("t")),
            lambda e: (F.size(e["g"]) == F.size(e["t"])) & ((F.size(e["t"]) == 1) | brackets) & F.forall(F.zip_with(e["g"], e["t"], same), lambda ok: ok),
        )
        return (v["g"] == v["t"]) | ((F.length(v["g"]) > 0) & by_element)

    loose = let(F.struct(normalize_answer_loose(given).alias("g"), normalize_answer_loose(truth).alias("t")), compare)
    return F.coalesce((normalize_answer(given) == normalize_answer(truth)) | loose, F.lit(False))
