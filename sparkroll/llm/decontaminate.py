"""Benchmark decontamination: windows of canonical templates, and consistency of what fills their slots."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkroll.llm.common import DIGIT, LETTER, ODD, UPPER, character_tables, code_points, mixed, pieces, prepared, run_hashes, stored, table, text_buffers

#: Template words of a window; a shorter item is one window of its own length.
WINDOW = 8
#: A window needs so many words that are not placeholders, or all but two of a shorter one. An item whose windows cover too little of
#: it, or that has fewer template words, is searched by its literal words instead: numbers and names as they stand, down to one word.
LITERAL = 5
LEAST_WORDS = 4
#: A document leaks an item if windows with consistent slots cover this share of its words, or so many words.
COVERAGE, RUN = 0.45, 25
#: Windows of the benchmark that one pass over the documents looks for; a larger benchmark takes several passes.
PASS_WINDOWS = 2_000_000
#: Measures that become a placeholder behind a number.
UNITS = (
    "km m cm mm mi mile miles ft feet foot inch inches yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons l ml liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent degree degrees kmh mph km2 m2 m3"
).split()
WORD, NUMBER, NAME, UNIT = range(4)
SLOTS = np.array([0x1111111111111111, 0x2222222222222222, 0x3333333333333333, 0x4444444444444444], np.uint64)
SENTENCE_ENDS = np.array([ord(c) for c in ".!?:;\n"], np.uint32)

_units: list[np.ndarray] = []


def split_words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each character: class, in a word, first of its text. Of each word: place, hash in lower case, number of the text."""
    kinds, lowered = character_tables()
    small = np.minimum(points, 0x10000)
    kind = kinds[small]
    solid = (kind == LETTER) | (kind == UPPER) | (kind == DIGIT)
    first_of_text = np.zeros(len(points), bool)
    first_of_text[offsets[:-1][offsets[:-1] < len(points)]] = True
    edge = solid.copy()
    edge[1:] &= ~solid[:-1] | first_of_text[1:]
    starts = np.flatnonzero(edge)
    if not len(starts):
        return kind, solid, first_of_text, starts, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = np.where(solid, np.where(points < 0x10000, lowered[small], points) + 1, 0).astype(np.uint64)
    return kind, solid, first_of_text, starts, run_hashes(values, starts), np.searchsorted(offsets, starts, side="right") - 1


def literal(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts as they stand, in lower case, in the form of `template`."""
    *_, actual, owner = split_words(points, offsets)
    return actual, actual, np.full(len(actual), WORD), owner


def template(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical words of texts: (template hash, hash of what stands there, kind, number of the text).

    A word is a run of letters and digits. With a digit it is a number; behind a number it may be a unit; capitalised within a
    sentence, but not all in capitals, it is a name. Numbers or names in a row are one. Other words are themselves in lower case.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    kind, solid, first_of_text, starts, actual, owner = split_words(points, offsets)
    if not len(starts):
        return none
    digits = np.add.reduceat((kind == DIGIT).astype(np.int32), starts) > 0
    breaks = np.where(first_of_text | np.isin(points, SENTENCE_ENDS), np.arange(len(points)), -1)
    last_break = np.maximum.accumulate(breaks)[starts]
    before = np.concatenate([[-1], starts[:-1]])
    capitals = np.add.reduceat((kind == UPPER).astype(np.int32), starts)
    letters = np.add.reduceat(solid.astype(np.int32), starts)
    named = (kind[starts] == UPPER) & (capitals < letters) & (last_break <= before)
    of = np.where(digits, NUMBER, np.where(named, NAME, WORD))
    if not _units:
        units = [np.array([ord(c) + 1 for c in u], np.uint64) for u in UNITS]
        _units.append(np.sort(run_hashes(np.concatenate(units), np.concatenate([[0], np.cumsum([len(u) for u in units])[:-1]]))))
    behind = np.zeros(len(of), bool)
    behind[1:] = (of[:-1] == NUMBER) & (owner[1:] == owner[:-1])
    may = np.flatnonzero(behind & (of != NUMBER))
    of[may[np.isin(actual[may], _units[0])]] = UNIT
    # runs of numbers or of names become one
    more = np.zeros(len(of), bool)
    more[1:] = (of[1:] == of[:-1]) & np.isin(of[1:], (NUMBER, NAME)) & (owner[1:] == owner[:-1])
    if more.any():
        heads = np.flatnonzero(~more)
        actual, of, owner = np.add.reduceat(actual * np.where(more, ODD, np.uint64(1)), heads), of[heads], owner[heads]
    return np.where(of == WORD, actual, SLOTS[of]), actual, of, owner


def templates(texts: pa.Array, of_words=template) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`template` (or `literal`) of whole texts, read in passages."""
    data, offsets = text_buffers(texts)
    found = []
    for part, own, numbers in pieces(data, offsets, 1 << 18):
        words, actual, of, owner = of_words(*code_points(part, own))
        found.append((words, actual, of, numbers[owner] if len(owner) else owner))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else template(np.zeros(0, np.uint32), np.zeros(1, np.int64))


def windows(words: np.ndarray, of: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of the windows of `size` words inside a text with enough literal words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = rolled * ODD + words[k : k + n]
    literal = np.concatenate([[0], np.cumsum(of == WORD)])
    good = (owner[:n] == owner[size - 1 :]) & (literal[size:] - literal[:n] >= min(LITERAL, size - 2))
    place = np.flatnonzero(good)
    return place, mixed(rolled[place] + np.uint64(size))


@dataclass(frozen=True)
class Items:
    """A bounded part of the benchmark: words of its items one after the other, and their windows sorted by hash."""

    ids: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    actual: np.ndarray
    kinds: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    places: np.ndarray
    sizes: tuple[int, ...]
    sieve: np.ndarray
    of_words: Callable = template
    #: Literal words of the items that templates cannot find.
    also: Items | None = None

    def searched(self) -> np.ndarray:
        """Which items have windows over enough of their words."""
        lengths = np.diff(self.starts)
        size = np.minimum(lengths[np.searchsorted(self.starts, self.places, side="right") - 1], WINDOW)
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, self.places, 1)
        np.add.at(change, self.places + size, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
        return (covered[self.starts[1:]] - covered[self.starts[:-1]] >= COVERAGE * lengths) & (lengths > 0)


def read_items(rows: list, of_words: Callable = template) -> Items:
    """Templates and windows of benchmark rows (item_id, text), or their literal words and windows."""
    words, actual, of, owner = templates(pa.array([r.text for r in rows], pa.string()), of_words)
    starts = np.searchsorted(owner, np.arange(len(rows) + 1))
    lengths = np.diff(starts)
    hashes, places, sizes = [], [], []
    for size in range(LEAST_WORDS if of_words is template else 1, WINDOW + 1):
        own = lengths == size if size < WINDOW else lengths >= WINDOW
        if own.any():
            # names also as plain words, for copies in capitals or in lower case
            for seen, kinds in ((words, of), (np.where(of == NAME, actual, words), np.where(of == NAME, WORD, of))):
                place, found = windows(seen, kinds, owner, size)
                mine = own[owner[place]]
                places.append(place[mine])
                hashes.append(found[mine])
            sizes.append(size)
    found = np.concatenate(hashes or [np.zeros(0, np.uint64)])
    place = np.concatenate(places or [np.zeros(0, np.int64)])
    _, once = np.unique(np.stack([found, place.astype(np.uint64)]), axis=1, return_index=True)
    found, place = found[once], place[once]
    order = np.argsort(found, kind="stable")
    unique, first = np.unique(found[order], return_index=True)
    sieve = np.zeros(1 << 22, bool)
    sieve[unique >> np.uint64(42)] = True
    return Items(np.array([r.item_id for r in rows], np.int64), starts, words, actual, of, unique, np.append(first, len(found)), place[order], tuple(sizes), sieve, of_words)


def with_literals(rows: list) -> Items:
    """Items of benchmark rows; those that templates do not search also by their literal words."""
    items = read_items(rows)
    rest = [r for r, searched in zip(rows, items.searched(), strict=True) if not searched]
    return replace(items, also=read_items(rest, literal)) if rest else items


def each_pass(benchmark: DataFrame) -> tuple[int, Iterator[Items]]:
    """How many passes there are, and the benchmark (item_id, text) in parts of at most about PASS_WINDOWS windows, one at a time.

    Null ids and texts are left out. Each part has a fixed size, so it can travel to every task.
    """
    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    # a window needs at least two characters for each word and gap
    total = known.agg(F.sum(F.char_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-total // (2 * PASS_WINDOWS)))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    rows = (sorted(known.where(part == k).distinct().collect(), key=lambda r: (r.item_id, r.text)) for k in range(parts))
    return parts, (with_literals(r) for r in rows if r)


def benchmark_passes(benchmark: DataFrame) -> list[Items]:
    """All parts of `each_pass` at once, for a small benchmark."""
    return list(each_pass(benchmark)[1])


def leaks(items: Items, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item id, matched words, words of the item, slots, slots that are consistent) of each leak in a batch."""
    words, actual, of, owner = templates(texts, items.of_words)
    found = []
    for size in items.sizes:
        place, hashes = windows(words, of, owner, size)
        maybe = items.sieve[hashes >> np.uint64(42)]
        place, hashes = place[maybe], hashes[maybe]
        at = np.minimum(np.searchsorted(items.hashes, hashes), max(len(items.hashes) - 1, 0))
        hit = items.hashes[at] == hashes if len(items.hashes) else np.zeros(len(at), bool)
        place, at = place[hit], at[hit]
        times = items.first[at + 1] - items.first[at]
        there = items.places[np.repeat(items.first[at] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())] if len(at) else at
        found.append((np.repeat(place, times), there, np.full(len(there), size)))
    if not found:
        return []
    place, there, size = (np.concatenate(x) for x in zip(*found, strict=True))
    item = np.searchsorted(items.starts, there, side="right") - 1
    order = np.lexsort((place, item, owner[place]))
    place, there, size, item = place[order], there[order], size[order], item[order]
    text = owner[place]
    edges = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])) if len(text) else []
    out = []
    for a, b in zip(edges, [*edges[1:], len(text)]):
        which = int(item[a])
        total = int(items.starts[which + 1] - items.starts[which])
        here, slots, consistent = consistent_words(items, actual, place[a:b], there[a:b], size[a:b], int(items.starts[which]), total)
        if here >= COVERAGE * total or here >= RUN:
            out.append((int(text[a]), int(items.ids[which]), here, total, slots, consistent))
    return out


def all_leaks(items: Items, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
    """`leaks` by templates, and by literal words of the items that were not found so."""
    found = leaks(items, texts)
    if items.also:
        known = {f[:2] for f in found}
        found = sorted(found + [f for f in leaks(items.also, texts) if f[:2] not in known])
    return found


def consistent_words(items: Items, actual: np.ndarray, place: np.ndarray, there: np.ndarray, size: np.ndarray, start: int, total: int) -> tuple[int, int, int]:
    """Words of an item that the windows cover, its covered slots, and those that are filled consistently.

    What fills a slot may differ from the item, but the same filling of the item must always become the same one
    of the document. A slot that breaks the most frequent rule for its filling does not count as covered.
    """
    spread = np.concatenate([np.arange(s) for s in size])
    mine, theirs = np.repeat(there, size) + spread, np.repeat(place, size) + spread
    pairs = np.unique(np.stack([mine, actual[theirs].view(np.int64)]), axis=1)
    mine, filling = pairs[0], pairs[1].view(np.uint64)
    slot = items.kinds[mine] != WORD
    covered = np.zeros(total, bool)
    covered[mine[~slot] - start] = True
    rules: dict[int, dict[int, set[int]]] = {}
    for m, f in zip(mine[slot], filling[slot], strict=True):
        rules.setdefault(int(items.actual[m]), {}).setdefault(int(f), set()).add(int(m))
    consistent = set().union(*(max(r.values(), key=len) for r in rules.values())) if rules else set()
    covered[[m - start for m in consistent]] = True
    return int(covered.sum()), len({int(m) for m in mine[slot]}), len(consistent)


HITS = "item_id bigint, matched_words int, item_words int, slots int, consistent_slots int"


def find_leaks(passes: list[Items], text: str | Column) -> Column:
    """array of structs (see HITS): the items of the benchmark that a whole text leaks, by item id; empty for a null text."""
    # `passes` have a fixed size each (see PASS_WINDOWS)
    fields = [pa.field(c.split()[0], pa.int64() if "bigint" in c else pa.int32()) for c in HITS.split(", ")]
    kind = pa.list_(pa.struct(fields))

    def one(items: Items) -> Column:
        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in texts:
                found: list[list[dict]] = [[] for _ in range(len(batch))]
                for number, *values in all_leaks(items, batch):
                    found[number].append(dict(zip([f.name for f in fields], values, strict=True)))
                yield pa.array(found, kind)

        return arrow_udf(run, f"array<struct<{HITS.replace(' ', ':').replace(',:', ',')}>>").asNondeterministic()(text)

    columns = [one(items) for items in passes]
    return F.array().cast(f"array<struct<{HITS.replace(' ', ':').replace(',:', ',')}>>") if not columns else columns[0] if len(columns) == 1 else F.concat(*columns)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched_words, item_words, slots, consistent_slots, coverage: a row for each item that a row of `documents` leaks."""
    parts, passes = each_pass(benchmark)
    found = None
    for items in passes:
        hits = documents.select("doc_id", find_leaks([items], F.col("text")).alias("hits"))
        hits = hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        # stored, a pass lets go of its part of the benchmark
        hits = stored(hits) if parts > 1 else hits
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        hits = documents.select("doc_id", F.explode(find_leaks([], F.col("text"))).alias("h"))
        found = hits.select("doc_id", "h.*")
    return found.select("*", (F.col("matched_words") / F.col("item_words")).alias("coverage"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that leak nothing, with the columns they came with."""
    prepared(spark)
    parts, passes = each_pass(table(spark, sf_dir, "benchmark"))
    for items in passes:
        docs = docs.withColumn("__hits", find_leaks([items], F.col("text"))).where(F.size("__hits") == 0).drop("__hits")
        docs = stored(docs) if parts > 1 else docs
    return docs
