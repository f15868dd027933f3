"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced at stable boundaries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkroll.llm.bpe import has_unassigned
from sparkroll.llm.common import shuffle_partitions, stored, table

#: Characters of a chunk, and of the overlap with the next one. Only longer texts are cut.
CHUNK, OVERLAP = 32_768, 512
#: An overlap without a common boundary grows by this factor.
WIDEN = 8
#: A boundary is stable only so far from the end of a chunk: longer than any special string or contraction.
MARGIN = 32
#: Bytes of distinct words that one call of `boundaries` keeps counts of; beyond, it begins anew.
REMEMBERED_BYTES = 32 << 20
LIMIT = 1024


class Counter:
    """Ids and counts of one byte-level tokenizer file.

    The file's own library is the measure. Where its merges are in the order of
    their ids, as byte-level files have them, the same merges run several times
    as fast through `tiktoken`; the library then encodes only texts with code
    points that this Python does not know, and runs of white space too long for
    the other one's pattern.
    """

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.split = regex.compile(public_tokenizers.PATTERN)
        specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(specials, key=len, reverse=True)))
        self.token_bytes = byte_level_tokens(path)
        self.fast = None
        if in_rank_order(path):
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.token_bytes) if b is not None and i not in specials.values()}
            self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)

    def ids(self, text: str, special: bool) -> np.ndarray:
        """Token ids of a text; `special` says whether the strings of special tokens stand for these."""
        if self.fast is not None and (text.isascii() or not has_unassigned(text)):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
            except ValueError:  # the pattern's stack ends at about a million blanks in a row
                pass
        return np.array((self.library if special else self.plain).encode(text, add_special_tokens=False).ids, np.uint32)

    def word_ids(self, word: str) -> list[int]:
        """Ids of a short text whose special strings are plain text, as a list."""
        if self.fast is not None and (word.isascii() or not has_unassigned(word)):
            return self.fast.encode_ordinary(word)
        return self.plain.encode(word, add_special_tokens=False).ids

    def segments(self, text: str) -> Iterator[tuple[int, str | None]]:
        """(start, ordinary text) of the parts between special strings, (start, None) for these."""
        at = 0
        for found in self.specials.finditer(text):
            if found.start() > at:
                yield at, text[at : found.start()]
            yield found.start(), None
            at = found.end()
        if at < len(text):
            yield at, text[at:] if at else text

    def count(self, text: str) -> int:
        """Tokens of a text."""
        return len(self.ids(text, special=True))

    def boundaries(self, text: str) -> tuple[list[int], list[int]]:
        """Where words and special strings begin, and how many tokens lie before each; the end comes last."""
        places, words = [], []
        if not text.isascii() and has_unassigned(text):
            found = self.library.encode(text, add_special_tokens=False)
            pieces = [(a, a + 1) for a in range(len(found))]
            offsets, names = found.offsets, found.word_ids
            begins = [k for k, _ in pieces if k == 0 or names[k] is None or names[k] != names[k - 1]]
            # a word's offsets leave out its leading space, so it begins where the one before it ended
            return [0 if k == 0 else offsets[k - 1][1] for k in begins] + [len(text)], begins + [len(found)]
        for start, ordinary in self.segments(text):
            if ordinary is None:
                places.append(start)
                words.append("")
            else:
                for found in self.split.finditer(ordinary):
                    places.append(start + found.start())
                    words.append(found.group())
        known, size, before, counts = {"": 1}, 0, 0, []
        for word in words:
            counts.append(before)
            n = known.get(word)
            if n is None:
                n = known[word] = len(self.ids(word, special=False))
                size += len(word)
                if size > REMEMBERED_BYTES:
                    known, size = {"": 1}, 0
            before += n
        return [*places, len(text)], [*counts, before]


def _model(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)["model"]


def byte_level_tokens(path: str) -> list[bytes | None]:
    """The bytes that each id of a byte-level vocabulary stands for; None for ids of characters outside the byte alphabet."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    vocabulary = _model(path)["vocab"]
    out: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if all(c in letters for c in token):
            out[i] = bytes(letters[c] for c in token)
    return out


def in_rank_order(path: str) -> bool:
    """Whether each merge of the file makes a larger id than the one before it, and all single bytes have an id."""
    model = _model(path)
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(a < b for a, b in zip(made, made[1:])) and len({t for t in byte_level_tokens(path) if t is not None and len(t) == 1}) == 256


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_short(path: str, text: str | Column) -> Column:
    """Tokens of a text that is read in one piece; a null text has none."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = counter(path)
        for batch in texts:
            yield pa.array([tool.count(t.as_py() or "") for t in batch], pa.int64())

    return arrow_udf(run, "bigint").asNondeterministic()(text)


CHUNKS = "digest string, idx int, last boolean, first_at bigint, until bigint, part string"


def cut(long_texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks of texts with their digests; chunk idx begins at idx * step and ends overlap behind the next."""
    step = max(chunk, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(text)
                pieces = 1 if n <= step + overlap else -(-(n - overlap) // step)
                for i in range(pieces):
                    last = i == pieces - 1
                    end = n if last else (i + 1) * step + overlap
                    yield pa.RecordBatch.from_pylist([{"digest": digest, "idx": i, "last": last, "first_at": i * step, "until": end, "part": text[i * step : end]}], schema)

    schema = pa.schema([("digest", pa.string()), ("idx", pa.int32()), ("last", pa.bool_()), ("first_at", pa.int64()), ("until", pa.int64()), ("part", pa.string())])
    return long_texts.mapInArrow(run, CHUNKS)


ENCODED = "digest string, idx int, last boolean, total bigint, heads array<bigint>, head_counts array<bigint>, tails array<bigint>, tail_counts array<bigint>"


def encode_chunks(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """Token total of each chunk, and the boundaries with counts in its overlaps with the chunk before and behind.

    A boundary in the overlap with the next chunk is listed only if no text
    behind the chunk could move it: it is no later than the start of the last
    word and MARGIN away from the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                places, counts = tool.boundaries(row["part"])
                size = len(row["part"])
                stable = min(size - MARGIN, places[-2] if len(places) > 1 else 0)
                head = [k for k, p in enumerate(places) if p < overlap] if row["idx"] else []
                tail = [] if row["last"] else [k for k, p in enumerate(places) if size - overlap <= p <= stable]
                out.append({
                    "digest": row["digest"], "idx": row["idx"], "last": row["last"], "total": counts[-1],
                    "heads": [row["first_at"] + places[k] for k in head], "head_counts": [counts[k] for k in head],
                    "tails": [row["first_at"] + places[k] for k in tail], "tail_counts": [counts[k] for k in tail],
                })
            yield pa.RecordBatch.from_pylist(out, schema)

    longs = pa.list_(pa.int64())
    schema = pa.schema([("digest", pa.string()), ("idx", pa.int32()), ("last", pa.bool_()), ("total", pa.int64()), ("heads", longs), ("head_counts", longs), ("tails", longs), ("tail_counts", longs)])
    return chunks.mapInArrow(run, ENCODED)


def splice(encoded: DataFrame) -> DataFrame:
    """digest, n_tokens, failed: neighbouring chunks meet at the last boundary that both have.

    From a common boundary on both chunks split alike, as the split of a word
    depends only on what follows. So the tokens of the text are those of the
    last chunk plus, for each meeting, what lies before it in the earlier chunk
    less what lies before it in the later one.
    """
    later = encoded.where("idx > 0").select("digest", (F.col("idx") - 1).alias("idx"), "heads", "head_counts")
    met = encoded.select("digest", "idx", "last", "total", "tails", "tail_counts").join(later, ["digest", "idx"], "left")
    met = met.withColumn("at", F.array_max(F.array_intersect("tails", "heads")))

    def before(places: str, counts: str) -> Column:
        return F.element_at(counts, F.array_position(places, F.col("at")).cast("int"))

    gain = F.when(F.col("last"), F.col("total")).otherwise(before("tails", "tail_counts") - before("heads", "head_counts"))
    return met.groupBy("digest").agg(F.sum(gain).alias("n_tokens"), F.max((~F.col("last") & F.col("at").isNull()).cast("int")).alias("failed"))


def count_long(long_texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """digest, n_tokens of long texts (digest, text). Texts that fail to align are cut again with a wider overlap."""
    done, spark = None, long_texts.sparkSession
    while True:
        # a repeated row leaves one chunk in each task, and then one in all
        parts = cut(long_texts, chunk, overlap).dropDuplicates(["digest", "idx"]).repartition(shuffle_partitions(spark), "digest", "idx")
        # both sides of the splice read the encoded chunks, so these are stored
        result = stored(splice(stored(encode_chunks(parts, path, overlap))))
        good = result.where("failed = 0").select("digest", "n_tokens")
        done = good if done is None else done.unionByName(good)
        bad = result.where("failed = 1").select("digest")
        if bad.isEmpty():
            return done
        long_texts = long_texts.join(bad, "digest", "left_semi")
        overlap *= WIDEN


def one_of_each(long: DataFrame) -> DataFrame:
    """digest and text of the row with the least id of each digest; several only where an id is repeated.

    Ids are told by digest first, so a text copied a million times is one
    small row of each task there, and its copies are dealt by id as well.
    """
    named = long.select("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    first = named.groupBy("digest").agg(F.min("name").alias("name"))
    return named.join(first, ["digest", "name"], "left_semi").select("digest", "text")


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row for each row of `documents`.

    A null text counts as empty (0 bytes, 0 tokens). Texts above `chunk`
    characters are known by their SHA-256, so equal ones are cut and encoded once and
    repeated rows all get their count; ids may be null or repeated.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    # a long text has more bytes than `chunk`, which Parquet readers give without decoding the characters
    is_long = (F.col("n_bytes") > chunk) & (F.char_length("text") > chunk)
    short = rows.where(~is_long).select("doc_id", "n_bytes", count_short(path, "text").alias("n_tokens"))
    long = rows.where(is_long).withColumn("digest", F.sha2("text", 256))
    counted = count_long(one_of_each(long), path, chunk, overlap)
    long = long.select("doc_id", "n_bytes", "digest").join(counted, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).select("*", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
