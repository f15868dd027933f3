"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokens of A and B are laid over the bytes of " " + text. Where a token of A and
one of B end at the same byte, the text is cut; what lies between two cuts is a
group. Groups are found by diagonal run skipping: while tokens pair off one to
one, the two end arrays are equal at the current shift of their indexes, and
slices of doubling length are compared at once; where they part, the smaller
end advances until both meet again, which fixes the next shift. Two tokens are
linked if their byte ranges overlap.

How the corpus-wide counts reach the documents. A task packs its documents into
blocks of a bounded number of links and stores them: the distinct id pairs of
the block once, and each document as places in that list. So a pair is one row
of a block, however frequent it is. These rows are summed by pair, and every
block gets the totals of its own pairs back; no text, token or link is a row,
and no table of all pairs is sent to every task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroll.llm.common import stored, table
from sparkroll.llm.tokens import counter

#: A block is closed when it holds so many links; one text may have more.
BLOCK_LINKS = 3_000_000
#: Bits of a B id in a pair; ids of either vocabulary are below 2 ** 20.
B_BITS = 20
#: Tokens behind a cut that are compared one by one before slices are.
NEAR = 4
#: Texts that go through the tokenizers at once.
AT_ONCE = 256
#: Words up to this length are remembered, in two generations of about so many bytes, an entry counting ENTRY.
LONG, REMEMBERED_BYTES, ENTRY = 64, 128 << 20, 300
#: White space beside a space, where a word of its own would be split otherwise than in its place.
AMBIGUOUS = re.compile(r" \s|\s ")


@dataclass(frozen=True)
class Pair:
    """The files of both tokenizers: A is byte-level, B is a sentencepiece model that adds a leading space."""

    path_a: str
    path_b: str


class Encoder:
    """Token ids by both tokenizers, and the bytes of their ids.

    Both cut before a single space between other signs: A's pattern begins a
    word there, and no piece of B has a space behind another sign. So such texts
    are encoded word by word, and words are remembered; other texts as a whole.
    """

    def __init__(self, pair: Pair):
        import sentencepiece

        self.a, self.b = counter(pair.path_a), sentencepiece.SentencePieceProcessor(model_file=pair.path_b)
        spelled = [_piece(self.b, i) for i in range(self.b.get_piece_size())]
        # ids without bytes get one that no text has
        self.bytes_a, self.bytes_b = [[b"\xff" if x is None else x for x in side] for side in (self.a.token_bytes, spelled)]
        self.sizes_a, self.sizes_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.by_words = all(b" " not in x.lstrip(b" ") for x in self.bytes_b)
        # A spells what it was given, unless the file changes texts first
        self.faithful = self.a.library.normalizer is None and self.a.fast is not None
        # what was asked for lately, and before that: ids of a word by A and B as bytes of 32-bit numbers, and whether both spell it
        self.young: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.unspelled: set[str] = set()
        self.size = 0

    def words_of(self, text: str) -> list[str] | None:
        """The words of a text, if it may be encoded word by word."""
        raw = " " + text
        return None if not self.by_words or raw[-1] == " " or AMBIGUOUS.search(raw) else text.split(" ")

    def spells(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = b" " + text.encode()
        spelled_a = self.faithful or b"".join(map(self.bytes_a.__getitem__, a)) == raw
        return spelled_a and b"".join(map(self.bytes_b.__getitem__, b)) == raw

    def learn(self, words: set[str]) -> None:
        """Remember the ids of these words, and forget those that were not asked for lately."""
        if self.size > REMEMBERED_BYTES:
            self.old, self.young, self.size = self.young, ({}, {}), 0
            self.unspelled = {w for w in self.unspelled if w in self.old[0]}
        a_ids, b_ids = self.young
        new = []
        for word in words.difference(a_ids):
            known = self.old[0].get(word)
            if known is None:
                new.append(word)
                continue
            a_ids[word], b_ids[word] = known, self.old[1][word]
            self.size += ENTRY
        for word, a, b in self.together([w for w in new if not w[-1].isspace()]) + self.singly([w for w in new if w[-1].isspace()]):
            a_ids[word], b_ids[word] = a, b
            self.size += ENTRY + 2 * len(word)

    def together(self, words: list[str]) -> list[tuple[str, bytes, bytes]]:
        """Ids of words, read as one text and cut at the words' ends."""
        if not words:
            return []
        text = " ".join(words)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        a, b = self.a.ids(" " + text, special=False), np.array(self.b.encode(text), np.uint32)
        sides = []
        if self.spells(text, a.tolist(), b.tolist()):
            for ids, sizes in ((a.astype(np.uint32), self.sizes_a), (b, self.sizes_b)):
                at = np.cumsum(sizes[ids])
                place = np.searchsorted(at, ends)
                if np.array_equal(at[place], ends):
                    data, stops = ids.tobytes(), (4 * (place + 1)).tolist()
                    sides.append([data[i:j] for i, j in zip([0, *stops], stops)])
        return list(zip(words, *sides, strict=True)) if len(sides) == 2 else self.singly(words)

    def singly(self, words: list[str]) -> list[tuple[str, bytes, bytes]]:
        out = []
        for word in words:
            a, b = self.a.word_ids(" " + word), self.b.encode(word)
            if not self.spells(word, a, b):
                self.unspelled.add(word)
            out.append((word, np.array(a, np.uint32).tobytes(), np.array(b, np.uint32).tobytes()))
        return out

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by A of " " + text, and by B of each text; None if either side does not spell it."""
        split = [self.words_of(t) if t else None for t in texts]
        words = set(chain.from_iterable(w for w in split if w))
        self.learn({w for w in words if len(w) <= LONG})
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, words in zip(texts, split, strict=True):
            if words is None or max(map(len, words)) > LONG:
                a, b = self.a.ids(" " + text, special=False), self.b.encode(text)
                out.append((a.astype(np.int64), np.array(b, np.int64)) if self.spells(text, a.tolist(), b) else None)
            elif self.unspelled and not self.unspelled.isdisjoint(words):
                out.append(None)
            else:
                out.append(tuple(np.frombuffer(b"".join(map(side.__getitem__, words)), np.uint32).astype(np.int64) for side in self.young))
        return out


def _piece(model, i: int) -> bytes | None:
    piece = model.id_to_piece(i)
    if model.is_byte(i):
        return bytes([int(piece[3:-1], 16)])
    return None if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode()


@lru_cache(maxsize=2)
def encoder(pair: Pair) -> Encoder:
    return Encoder(pair)


@lru_cache(maxsize=2)
def _names(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id below `size` in digits with what follows it (a comma, a bar, a semicolon), as rows of bytes; and which bytes count."""
    names = [f"{i}{mark}".encode() for mark in ",|;" for i in range(size)]
    lengths = np.array(list(map(len, names)))
    table = np.zeros((len(names), int(lengths.max())), np.uint8)
    inside = np.arange(table.shape[1])[None, :] < lengths[:, None]
    table[inside] = np.frombuffer(b"".join(names), np.uint8)
    return table, inside


def common_cuts(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B lie before each common end, by diagonal run skipping.

    Both lists ascend and end with the same number; two empty lists have no cut.
    """
    # stretches of cuts: the first one's place in both, and how many follow one to one
    firsts: list[int] = []
    shifts: list[int] = []
    lengths: list[int] = []
    i, j, n, m = 0, 0, len(ends_a), len(ends_b)
    while i < n:
        a, b = ends_a[i], ends_b[j]
        # an irregular group: the smaller end moves on until both meet
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        first, shift, step = i, j - i, 1
        i += 1
        most = min(n, m - shift)
        near = min(i + NEAR, most)
        while i < near and ends_a[i] == ends_b[i + shift]:
            i += 1
        # further on, slices are compared; where the stretch has ended already, the first one fails
        while i == near or step > 1:
            if i + step > most or ends_a[i : i + step] != ends_b[i + shift : i + shift + step]:
                break
            i += step
            step *= 2
        while step > 1:
            step //= 2
            if i + step <= most and ends_a[i : i + step] == ends_b[i + shift : i + shift + step]:
                i += step
        j = i + shift
        firsts.append(first + 1)
        shifts.append(shift)
        lengths.append(i - first)
    if not firsts:
        return NOTHING, NOTHING
    size = np.array(lengths)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    cuts = np.repeat(np.array(firsts), size) + within
    return cuts, cuts + np.repeat(np.array(shifts), size)


NOTHING = np.zeros(0, np.int64)


@dataclass(frozen=True)
class Aligned:
    """One text: token ids, their ends in bytes, and the cuts; all empty if the tokens do not spell the text."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray

    def described(self) -> bytes:
        """`a1,a2|b1;a3|b2,b3`: ids of each group in order; the last group has no semicolon behind it."""
        if len(self.a) == 0:
            return b""
        size = 1 << B_BITS if max(self.a.max(), self.b.max()) >= 65_536 else 65_536
        code_a, code_b = self.a.copy(), self.b.copy()
        ends_a, ends_b = self.cuts_a, self.cuts_b
        code_a[ends_a - 1] += size
        code_b[ends_b - 1] += 2 * size
        # a token of A stands behind all of B in earlier groups, and the other way round behind A's of its own
        before_b = np.repeat(np.append(0, ends_b[:-1]), np.diff(ends_a, prepend=0))
        before_a = np.repeat(ends_a, np.diff(ends_b, prepend=0))
        order = np.empty(len(code_a) + len(code_b), np.int64)
        order[np.arange(len(code_a)) + before_b] = code_a
        order[np.arange(len(code_b)) + before_a] = code_b
        table, inside = _names(size)
        return table[order][inside[order]].tobytes()[:-1]

    def links(self) -> np.ndarray:
        """The id pair of each link, as A id * 2 ** B_BITS + B id.

        Each stretch between two neighbouring ends of either side lies in one
        token of A and one of B, and two tokens share at most one stretch. So
        there is one link for each end of A, and one for each end of B that is no cut.
        """
        alone = np.ones(len(self.b), bool)
        alone[self.cuts_b - 1] = False
        beside_b = self.a[np.searchsorted(self.ends_a, self.ends_b[alone])]
        beside_a = self.b[np.searchsorted(self.ends_b, self.ends_a)]
        return np.concatenate([(self.a << B_BITS) | beside_a, (beside_b << B_BITS) | self.b[alone]])


UNALIGNED = Aligned(NOTHING, NOTHING, NOTHING, NOTHING, NOTHING, NOTHING)


def align(pair: Pair, texts: list[str | None]) -> list[Aligned]:
    """The alignment of each text. A null or empty text, or one that either side does not spell exactly, has no tokens."""
    out, tool, filled = [], encoder(pair), [t or "" for t in texts]
    for text, found in zip(filled, tool.ids(filled), strict=True):
        if not text or found is None:
            out.append(UNALIGNED)
            continue
        ends_a, ends_b = np.cumsum(tool.sizes_a[found[0]]), np.cumsum(tool.sizes_b[found[1]])
        out.append(Aligned(*found, ends_a, ends_b, *common_cuts(ends_a.tolist(), ends_b.tolist())))
    return out


GROUPS = "doc_id bigint, a array<int>, b array<int>, cuts_a array<int>, cuts_b array<int>, ends array<bigint>"


def aligned_groups(documents: DataFrame, pair: Pair) -> DataFrame:
    """doc_id, the ids of both sides, how many of them lie before the end of each group, and the byte it ends at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        schema = pa.schema([("doc_id", pa.int64()), ("a", ints), ("b", ints), ("cuts_a", ints), ("cuts_b", ints), ("ends", pa.list_(pa.int64()))])
        for batch in batches:
            found = align(pair, batch.column(1).to_pylist())
            columns = [[x.a for x in found], [x.b for x in found], [x.cuts_a for x in found], [x.cuts_b for x in found]]
            ends = [x.ends_a[x.cuts_a - 1] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([np.asarray(v, np.int32) for v in c], ints) for c in columns), pa.array(ends, pa.list_(pa.int64()))], schema=schema)

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, GROUPS)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, dtype, length: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, length * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


BLOCKS = "block string, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, digests array<string>, sizes array<bigint>, n_pairs bigint, pairs binary, sums binary, places binary, times binary"


class _Block:
    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.counts: list[tuple[int, int, int]] = []
        self.digests: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.links = 0

    def add(self, doc_id: int | None, found: Aligned) -> None:
        self.ids.append(doc_id)
        self.counts.append((len(found.a), len(found.b), len(found.cuts_a)))
        self.digests.append(hashlib.sha256(found.described()).hexdigest() if len(found.a) else "")
        links = np.sort(found.links())
        starts = np.flatnonzero(np.diff(links, prepend=-1))
        self.pairs.append(links[starts])
        self.times.append(np.diff(starts, append=len(links)).astype(np.int32))
        self.links += len(links)

    def row(self, name: str) -> dict:
        sizes = [len(p) for p in self.pairs]
        distinct, places = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.concatenate(self.times)
        sums = np.bincount(places, weights=times, minlength=len(distinct)).astype(np.int64)
        return {
            "block": name, "ids": self.ids, "n_a": [c[0] for c in self.counts], "n_b": [c[1] for c in self.counts], "n_groups": [c[2] for c in self.counts],
            "digests": self.digests, "sizes": sizes, "n_pairs": len(distinct), "pairs": _packed(np.diff(distinct, prepend=0)), "sums": _packed(sums),
            # places ascend within a document, so their differences pack well
            "places": _packed(np.diff(places.astype(np.int32), prepend=0).astype(np.int32)), "times": _packed(times.astype(np.int32)),
        }


def blocks_of(documents: DataFrame, pair: Pair, block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row for each block of documents: their counts and digests, and their linked id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        schema = pa.schema([
            ("block", pa.string()), ("ids", longs), ("n_a", longs), ("n_b", longs), ("n_groups", longs), ("digests", pa.list_(pa.string())), ("sizes", longs),
            ("n_pairs", pa.int64()), ("pairs", pa.binary()), ("sums", pa.binary()), ("places", pa.binary()), ("times", pa.binary()),
        ])
        task, number, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                for doc_id, found in zip(part.column(0).to_pylist(), align(pair, part.column(1).to_pylist()), strict=True):
                    block.add(doc_id, found)
                    if block.links >= block_links:
                        yield pa.RecordBatch.from_pylist([block.row(f"{task}-{number}")], schema)
                        number, block = number + 1, _Block()
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(f"{task}-{number}")], schema)

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, BLOCKS)


def _pairs_of(row: dict) -> np.ndarray:
    return np.cumsum(_unpacked(row["pairs"], np.int64, row["n_pairs"]))


def pair_rows(blocks: DataFrame) -> DataFrame:
    """block, pair, times: each distinct pair of a block with the number of its links there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_pairs"]
                columns = [pa.array([row["block"]] * n, pa.string()), pa.array(_pairs_of(row)), pa.array(_unpacked(row["sums"], np.int64, n))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "pair", "times"])

    return blocks.select("block", "n_pairs", "pairs", "sums").mapInArrow(run, "block string, pair bigint, times bigint")


DIGESTS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _answered(blocks: pa.Table, totals: pa.Table) -> pa.Table:
    """The documents of one block, with the totals of its pairs."""
    row = blocks.to_pylist()[0]
    order = np.argsort(totals["pair"].to_numpy())
    if not np.array_equal(totals["pair"].to_numpy()[order], _pairs_of(row)):
        raise ValueError(f"block {row['block']} did not get the totals of its pairs")
    sizes = np.array(row["sizes"], np.int64)
    n = int(sizes.sum())
    places, times = np.cumsum(_unpacked(row["places"], np.int32, n)), _unpacked(row["times"], np.int32, n).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[starts[1:]] - total[starts[:-1]]

    # sums of a block stay below 2 ** 63 for corpora of up to 10 ** 12 links of one pair
    total, best = totals["total"].to_numpy()[order], totals["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
    n_a, n_b, groups = (np.array(row[k], np.int64) for k in ("n_a", "n_b", "n_groups"))
    columns = [pa.array(row["ids"], pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(n_a + n_b - groups)]
    columns += [pa.array(sums(times * best[places]) if n else sums(NOTHING)), pa.array(sums(times * total[places]) if n else sums(NOTHING)), pa.array(row["digests"], pa.string())]
    return pa.Table.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_totals(rows: DataFrame) -> DataFrame:
    """pair, total, best: links of each id pair in the corpus, and whether no pair of its B id has more."""
    totals = stored(rows.groupBy("pair").agg(F.sum("times").alias("total")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    most = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("most"))
    # one row for each id of B's vocabulary at most
    return totals.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def alignment_digests(documents: DataFrame, pair: Pair, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Counts of tokens, groups and links of each document, and how its links stand in the corpus.

    One row for each row of `documents` (doc_id, text; further columns are left
    out). Null and repeated ids are kept as they are, and repeated rows count as
    often as they occur. A text without tokens gets zeros and an empty digest.
    """
    blocks = stored(blocks_of(documents, pair, block_links))
    rows = pair_rows(blocks)
    asked = rows.select("block", "pair").join(pair_totals(rows), "pair").select("block", "pair", "total", "best")
    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_answered, DIGESTS)


def tokenizers() -> Pair:
    import public_tokenizers

    return Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents"), tokenizers())
