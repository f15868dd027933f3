"""Step splitting: start indices of the reasoning steps of a text, in one pass per text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of the prose splitter.
SHORT_PIECE, LONG_PIECE = 20, 100
# A sentence ends behind a stop that follows a word of at least three letters (so not an initial or
# a short abbreviation) or a closing bracket, if a capital or a digit comes next.
SENTENCE_STOP = re.compile(r"""(?:[^\W\d_]{3,}|[\d)\]}])[.!?]["')]*(?=\s+["'(]?[A-Z0-9])""")
SEPARATORS = re.compile(r",|\sand\s|:|;|=")
# What opens or closes a formula; any other escaped character is passed over.
FORMULA_MARK = re.compile(r"\\begin\{[^}]*\}|\\end\{[^}]*\}|\\.|\$+|\[/?asy\]")


def formula_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the formulas: from an opening mark to the first one that closes it; an unclosed mark is text."""
    marks = [(m.start(), m.end(), m.group()) for m in FORMULA_MARK.finditer(text)]
    spans, at = [], 0
    while at < len(marks):
        start, _, mark = marks[at]
        closing = _closing_mark(mark)
        end = next((k for k in range(at + 1, len(marks)) if marks[k][2] == closing), None) if closing else None
        if end is not None:
            spans.append((start, marks[end][1]))
            at = end
        at += 1
    return spans


def _closing_mark(mark: str) -> str | None:
    if mark.startswith("$"):
        return mark
    if mark.startswith("\\begin"):
        return mark.replace("begin", "end", 1)
    return {"\\(": "\\)", "\\[": "\\]", "[asy]": "[/asy]"}.get(mark)


def split_steps_delimiter(text: Column, delimiter: str, answer_prefix: str | None) -> Column:
    """Start indices with 0 and the length; the delimiter opens the next step.

    Blank leading steps join the first real one. With an answer part (the prefix
    occurs exactly once), blank trailing steps and the answer join the last one.
    """

    @F.pandas_udf("array<int>")
    def indices(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else delimiter_indices(t, delimiter, answer_prefix))

    return indices(text)


def delimiter_indices(text: str, delimiter: str, answer_prefix: str | None) -> list[int]:
    answered = answer_prefix is not None and text.count(answer_prefix) == 1
    body = text[: text.index(answer_prefix)] if answered else text
    cuts = [m.start() for m in re.finditer(re.escape(delimiter), body)]
    first, last = len(body) - len(body.lstrip()), len(body.rstrip())
    if last == 0:  # nothing but white space
        cuts = [] if answered else cuts
    else:
        # a cut before the first character would leave a blank first step
        cuts = [c for c in cuts if c > first and not (answered and c >= last)]
    return [0, *cuts, len(text)]


def step_texts(text: Column, indices: Column) -> Column:
    """The steps themselves; they join back to the text."""
    return F.transform(F.sequence(F.lit(1), F.size(indices) - 1), lambda i: F.substring(text, F.element_at(indices, i) + 1, F.element_at(indices, i + 1) - F.element_at(indices, i)))


def prefix_of(text: Column, indices: Column, step: Column) -> Column:
    """Everything up to the end of step `step` (0-based)."""
    return F.substring(text, F.lit(1), F.element_at(indices, step + 2))


def suffix_of(text: Column, indices: Column, step: Column) -> Column:
    """Everything from the start of step `step`."""
    return F.substring(text, F.element_at(indices, step + 1) + 1, F.length(text))


def next_action(state: Column, continuation: Column, indices: Column) -> Column:
    """The step after the state's own steps; null where the state does not end at a step border."""
    at = F.array_position(indices, F.length(state)).cast("int")
    usable = continuation.startswith(state) & (at > 1) & (at < F.size(indices))
    start = F.element_at(indices, F.when(usable, at))
    end = F.element_at(indices, F.when(usable, at + 1))
    return F.when(usable, F.substring(continuation, start + 1, end - start))


def split_steps_prose(text: Column) -> Column:
    """Start indices for prose with formulas: sentences and lines, short pieces merged, long ones balanced."""

    @F.pandas_udf("array<int>")
    def indices(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else prose_indices(t))

    return indices(text)


def prose_indices(text: str) -> list[int]:
    spans = formula_spans(text)
    cuts = _outside([m.end() for m in SENTENCE_STOP.finditer(text)] + [m.start() for m in re.finditer("\n", text)], spans)
    cuts += [end for start, end in spans if text[start:end].rstrip("$)]\\").endswith(".") and end < len(text)]
    pieces = _merge_short(text, sorted({0, *cuts, len(text)}))
    return _balance_long(text, pieces, spans)


def _outside(cuts: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """Cuts that do not fall into a formula; both lists are walked once in order."""
    kept, at = [], 0
    for cut in sorted(cuts):
        while at < len(spans) and spans[at][1] <= cut:
            at += 1
        if at == len(spans) or not spans[at][0] < cut:
            kept.append(cut)
    return kept


def _merge_short(text: str, borders: list[int]) -> list[int]:
    out = [borders[0]]
    for here, after in zip(borders[1:], [*borders[2:], None]):
        piece = text[out[-1] : here]
        short = len(piece) < SHORT_PIECE and not piece.endswith(".")
        if after is None or not short:
            out.append(here)
    return out


def _balance_long(text: str, borders: list[int], spans: list[tuple[int, int]]) -> list[int]:
    out = [0]
    for start, end in zip(borders, borders[1:]):
        inner = [start + m.start() for m in SEPARATORS.finditer(text[start:end])] if end - start > LONG_PIECE else []
        todo = [(start, end)]
        inner = _outside([c for c in inner if c > start], spans)
        while todo:
            a, b = todo.pop()
            between = [c for c in inner if a + SHORT_PIECE <= c <= b - SHORT_PIECE] if b - a > LONG_PIECE else []
            if between:
                middle = min(between, key=lambda c: abs(2 * c - a - b))
                todo += [(middle, b), (a, middle)]
            else:
                out.append(b)
    return out


def split_steps_lossy(text: Column) -> Column:
    """The older form: trimmed pieces, short ones joined to the next by a space."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else lossy_pieces(t))

    return pieces(text)


def lossy_pieces(text: str) -> list[str]:
    spans = formula_spans(text)
    cuts = _outside([m.end() for m in SENTENCE_STOP.finditer(text)] + [m.start() for m in re.finditer("\n", text)], spans)
    borders = sorted({0, *cuts, len(text)})
    trimmed = [p for p in (text[a:b].strip() for a, b in zip(borders, borders[1:])) if p]
    out: list[str] = []
    for piece in trimmed:
        if out and len(out[-1]) < SHORT_PIECE and not out[-1].endswith("."):
            out[-1] = f"{out[-1]} {piece}"
        else:
            out.append(piece)
    return out
