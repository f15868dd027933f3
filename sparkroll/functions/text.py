"""Templates, the default tokenizer, and text extraction as column functions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from string import Formatter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Every text is the concatenation of its tokens, so decoding is exact and
# offsets are running lengths. The same pattern works in Java, RE2 and Python.
TOKEN = r"[ \t\n\r\f]*[^ \t\n\r\f.,;:!?|]+|[ \t\n\r\f]*[.,;:!?|]|[ \t\n\r\f]+"
BOS_ID, EOS_ID, FIRST_ID = 1, 2, 3


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_spans(text: Column) -> Column:
    """ARRAY<STRUCT<tok, start, end>> in one linear pass per text, as an Arrow UDF."""
    return _spans_udf()(text)


def _spans_udf():
    pattern = TOKEN

    @F.pandas_udf("array<struct<tok:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        find = re.compile(pattern).finditer
        return texts.map(lambda t: None if t is None else [{"tok": m.group(), "start": m.start(), "end": m.end()} for m in find(t)])

    return spans


def token_ids(toks: Column) -> Column:
    """A stable integer per token text (28 bits of its digest), above the special ids."""
    return F.transform(toks, lambda t: (F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int") + FIRST_ID))


def tokens_before(toks: Column, chars: Column) -> Column:
    """How many tokens start before character `chars`; a straddling token counts."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"))
    walked = F.aggregate(
        toks,
        start,
        lambda acc, t: F.struct((acc["pos"] + F.length(t)).alias("pos"), (acc["n"] + F.when(acc["pos"] < chars, 1).otherwise(0)).alias("n")),
    )
    return walked["n"]


def render_template(template: str, columns: Mapping[str, Column]) -> Column:
    """`{name}` replaced by the value of each named column in turn; a value may bring a later placeholder in."""
    out = F.lit(template)
    for name, value in columns.items():
        if "{" + name + "}" in template:
            out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def render_prompt_strict(template: str, columns: Mapping[str, Column], question_field: str) -> Column:
    """Format-string rendering, compiled once; the question must appear in the template."""
    pieces = list(Formatter().parse(template))
    fields = [field for _, field, _, _ in pieces if field is not None]
    if question_field not in fields:
        raise ValueError(f"the template does not use {{{question_field}}}")
    parts: list[Column] = []
    for literal, field, _, _ in pieces:
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(columns[field].cast("string"))
    return F.concat(*parts)


def split_query_response(full_text: Column, query: Column) -> Column:
    return F.substring(full_text, F.length(query) + 1, F.length(full_text))


def extract_answer_marker(text: Column, marker: str = "# Answer\n") -> Column:
    """The trimmed part after the marker, if the marker occurs exactly once."""
    parts = F.split(text, _quoted(marker))
    return F.when(F.size(parts) == 2, strip(parts[1]))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _quoted(literal: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


# Fixed value: what counts as a number in a solution.
NUMBER = r"(?:[+-]?\d+\.\d*|[+-]?\.\d+|[+-]?\d+e[-+]?\d+|[+-]?\d+)"


def extract_last_number(text: Column) -> Column:
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.try_element_at(found, F.lit(-1))


def extract_hash_answer(text: Column) -> Column:
    """Trimmed text after the last `####`, null if there is none."""
    return F.when(text.contains("####"), strip(F.substring_index(text, "####", -1)))


def extract_hash_gold(text: Column) -> Column:
    """Trimmed text between the first `####` and the next, null if there is none."""
    return strip(F.try_element_at(F.split(text, "####"), F.lit(2)))


def strip_calculator(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<<.*?>>", "")


def extract_abcd(text: Column) -> Column:
    """The only letter of A to D in the text, else "no-answer"."""
    letters = ["A", "B", "C", "D"]
    present = sum((text.contains(c).cast("int") for c in letters[1:]), text.contains("A").cast("int"))
    only = F.coalesce(*[F.when(text.contains(c), c) for c in letters])
    return F.when(present == 1, only).otherwise("no-answer")


def answer_after_prefix(text: Column, prefix: str, finish_reason: Column | None = None, end_of_turn: str | None = None) -> Column:
    """Everything after the first prefix, with the end-of-turn text unless cut off; null where the prefix is missing."""
    at = F.instr(text, prefix)
    rest = F.substring(text, at + len(prefix), F.length(text))
    if end_of_turn is not None:
        suffix = F.lit(end_of_turn) if finish_reason is None else F.when(finish_reason == "length", "").otherwise(end_of_turn)
        rest = F.concat(rest, suffix)
    return F.when(at > 0, rest)


def solution_text(solution: Column, prefix: str | None, answer: Column, steps_text: Column | None = None) -> Column:
    """The gold steps if given, else the solution; prefix and answer follow where there is an answer."""
    body = solution if steps_text is None else F.coalesce(steps_text, solution)
    if prefix is None:
        return body
    return F.when(answer.isNotNull(), F.concat(body, F.lit(prefix), answer)).otherwise(body)


def listed_solution_text(solution_steps: Column) -> Column:
    """A solution given as a list already holds its answer."""
    return F.array_join(solution_steps, "\n")
