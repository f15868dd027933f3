"""Byte-pair encoding and decoding of whole texts with a contiguous rank array."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkroll.llm.common import prepared, table

#: Fixed value: how this vocabulary splits normalised text into words; the rest is dropped.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = "</w>"
#: Words with more parts than this are merged with a heap instead of repeated scans.
SHORT = 64
#: Words, and signs between white space, whose ids a worker remembers.
REMEMBERED = 200_000
NO_RANK = 1 << 30


def byte_letters() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(shown)))
    return [names[b] for b in range(256)]


SEPARATORS = re.compile("[\x1c-\x1f]")
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=1)
def unassigned() -> tuple[re.Pattern, frozenset[str]]:
    """Code points that the Unicode version of this Python does not have: a pattern for the first plane, a set for the rest."""
    free = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    return re.compile("[" + "".join(f"\\u{c:04x}" for c in free if c < 0x10000) + "]"), frozenset(chr(c) for c in free if c >= 0x10000)


def has_unassigned(text: str) -> bool:
    near, far = unassigned()
    return bool(near.search(text)) or bool(ASTRAL.search(text)) and not far.isdisjoint(text)


def remember(memory: dict, key: str, value: tuple) -> tuple:
    if len(memory) >= REMEMBERED:
        memory.clear()
    memory[key] = value
    return value


class WordPairs:
    """The vocabulary of one tokenizer file, with a memory for words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        # (left id, right id) -> (rank, id of the whole)
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.inner = [vocab[c] for c in byte_letters()]
        self.last = [vocab[c + END] for c in byte_letters()]
        self.digits = {i: str(i) for i in self.names}
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.letter = {c: b for b, c in enumerate(byte_letters())}
        self.path, self.library = path, None

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word, given as bytes."""
        parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self.scan(parts) if len(parts) <= SHORT else self.heap(parts)

    def scan(self, parts: list[int]) -> list[int]:
        """Merge the pair of least rank, the leftmost of equals, until no pair has a rank.

        `parts` and `ranks` are contiguous: deleting a boundary shifts both, and
        only the ranks of the two neighbours are looked up again.
        """
        known, none = self.ranks, (NO_RANK, 0)
        ranks = [known.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = known.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = known.get((parts[i], parts[i + 1]), none)
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long word, in n log n steps."""
        known, n = self.ranks, len(parts)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n

        def pair(i: int):
            j = after[i]
            found = known.get((parts[i], parts[j])) if j >= 0 else None
            return None if found is None else (found[0], i, parts[i], parts[j], found[1])

        queue = [p for i in range(n) if (p := pair(i))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, whole = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j] = whole, False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(queue, p)
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens inside it become their ids."""
        ids: list[int] = []
        at = 0
        for found in self.specials.finditer(text):
            self._ordinary(text[at : found.start()], ids)
            ids.append(self.special[found.group()])
            at = found.end()
        self._ordinary(text[at:] if at else text, ids)
        return ids

    def _ordinary(self, text: str, ids: list[int]) -> None:
        if not text.isascii():
            if has_unassigned(text):
                return self._recent(text, ids)
            text = unicodedata.normalize("NFC", text)
        # one character at a time, as a final sigma must not depend on its place
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        memory = self.tokens
        # words never cross white space; the four signs are white space for split() alone
        for token in text.split() if not SEPARATORS.search(text) else regex.split(r"\s+", text):
            found = memory.get(token)
            if found is None:
                found = remember(memory, token, tuple(i for w in WORDS.findall(token) for i in self.words.get(w) or remember(self.words, w, tuple(self.word(w.encode("utf-8"))))))
            ids += found

    def _recent(self, text: str, ids: list[int]) -> None:
        """A text with signs that this Python's Unicode tables lack: the tokenizers library splits it into words."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            ids += self.word(bytes(self.letter[c] for c in word))

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by spaces: this vocabulary has no decoder that would undo word ends."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordPairs:
    return WordPairs(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(path: str, text: str | Column) -> Column:
    """Token ids (array of int) of a whole text; a null or empty text has none."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for batch in texts:
            yield pa.array([bpe.encode(t.as_py() or "") for t in batch], pa.list_(pa.int32()))

    return arrow_udf(run, "array<int>").asNondeterministic()(text)


def decode(path: str, ids: str | Column) -> Column:
    """The decoded text of an array of ids; null or empty gives the empty text. An unknown id raises."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for batch in arrays:
            yield pa.array([bpe.decode(a.as_py() or []) for a in batch], pa.string())

    return arrow_udf(run, "string").asNondeterministic()(ids)


def round_trip(path: str, text: str | Column, keep_ids: bool = False) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, digest both; with the ids if they are to be kept.

    In one pass, so that the ids of long texts need not leave the worker. A null
    text counts as empty: no tokens, digests of the empty string.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        sha = hashlib.sha256
        for batch in texts:
            counts, coded, decoded, kept = [], [], [], []
            for text in batch:
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                coded.append(sha(" ".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha(bpe.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>>" if keep_ids else ">")
    return arrow_udf(run, kind).asNondeterministic()(text)


def coded_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and the columns of `round_trip`, one row for each row of `documents`."""
    rows = documents.select("doc_id", round_trip(path, F.col("text")).alias("r"))
    return rows.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return coded_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def encoded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: doc_id, the digests and the ids of each kept document."""
    prepared(spark)
    rows = docs.select("doc_id", round_trip(vocabulary_path(), F.col("text"), keep_ids=True).alias("r"))
    return rows.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256", "r.ids")
