"""SimHash near-duplicates; pairs meet at anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkroll.llm.common import shuffle_partitions, stored, table, text_buffers
from sparkroll.llm.components import components

WORDS, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of one anchor that are compared in one step; larger groups are compared block against block.
BLOCK = 2048


def fingerprint_bits(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; 0 without words."""
    tokens = text.lower().split()  # bytes: only A-Z changes, only the six ASCII spaces split
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), (ends[words - 1 :] if len(tokens) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 14)], last[at : at + (1 << 14)], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """SimHashes (uint64) of a batch of texts; 0 for a null one."""
    data, offsets = text_buffers(texts)
    raw = data.tobytes() if len(data) < 2 * (offsets[-1] - offsets[0] + 1) else data[: offsets[-1]].tobytes()
    return np.array([fingerprint_bits(raw[a:b], words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | Column, words: int = WORDS) -> Column:
    """SimHash of a whole text as a (signed) bigint column; 0 for a null text or one without words."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(fingerprints(batch, words).view(np.int64))

    return arrow_udf(run, "bigint").asNondeterministic()(text)


# --- anchors -------------------------------------------------------------------------------------------------
# Fingerprints with at most three differing bits have a half with at most one. A half has 32 bits: the anchors
# are the words of the Hamming code on 31 of them, times the two values of the last bit. That code covers
# with radius 1, so each half has a home anchor at distance 0 or 1, and a half that differs in one bit lies within
# radius plus threshold, 2, of that home. Every half goes to all anchors within 2: 17 of 2**27, or 2.

CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]


def _anchors(half: Column) -> tuple[Column, Column]:
    """Home anchor of a half, and all anchors within distance 2."""
    syndrome = F.lit(0)
    for j, check in enumerate(CHECKS):
        syndrome = syndrome + F.pmod(F.bit_count(half.bitwiseAND(F.lit(check))), F.lit(2)) * (1 << j)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), (i - 1).cast("int"))
    home = F.when(syndrome == 0, half).otherwise(half.bitwiseXOR(bit(syndrome)))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: i < i.bitwiseXOR(syndrome))
    near = F.transform(pairs, lambda i: half.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(syndrome))))
    return home, F.concat(F.array(home, home.bitwiseXOR(F.lit(1 << 31))), F.when(syndrome == 0, F.array().cast("array<bigint>")).otherwise(near))


def at_anchors(prints: DataFrame) -> DataFrame:
    """key, fp, home: each fingerprint at all its anchors of either half; the half is part of the key."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32))
    halves = prints.select("fp", F.explode(F.array(*[F.struct(v.alias("v"), F.lit(k << 32).cast("bigint").alias("side")) for k, v in enumerate((low, high))])).alias("h"))
    halves = halves.select("fp", F.col("h.v").alias("v"), F.col("h.side").alias("side"))
    home, near = _anchors(F.col("v"))
    spread = halves.select("fp", "side", home.alias("own"), F.explode(near).alias("anchor"))
    return spread.select((F.col("anchor") + F.col("side")).alias("key"), "fp", (F.col("anchor") == F.col("own")).alias("home"))


def linked(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Trees over fingerprints (uint64, distinct) that link at `distance`: (member, least of its tree), members only."""
    left = np.sort(prints)
    roots, members = [], []
    while len(left) > 1:
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= distance
            if near.any():
                found = left[near]
                members.append(found)
                roots.append(np.full(len(found), root, np.uint64))
                frontier.extend(found)
                left = left[~near]
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(members or empty), np.concatenate(roots or empty)


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges a, b between distinct fingerprints fp that connect whatever links at `distance`.

    A pair meets at the home anchor of either, with the other among that
    anchor's members. Each anchor gives a tree over its members instead of
    all their pairs. An anchor with more members than `block` is cut into
    blocks by hash, and each pair of blocks is a row of its own, so no task holds a hot group.
    """
    if distance > 3:
        raise ValueError("two halves with one differing bit each allow a distance of 3")
    # joins ask for a merge: the size that Spark expects of exploded rows is that of the rows before, and what it takes for small would be broadcast
    members = at_anchors(prints)
    homes = members.where("home").select("key").distinct().hint("merge")
    # nearly all copies stand at anchors that are nobody's home
    met = stored(members.join(homes, "key").select("key", "fp"))
    # stored, so that both sides of the join are plain shuffles, which adaptive execution splits at a hot key
    sizes = stored(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")).hint("merge")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = met.join(sizes, "key").select("key", "fp", blocks.alias("blocks")).select("key", "fp", "blocks", own.alias("own"))
    paired = placed.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # dealt out by block pair: by key alone, all pairs of a hot anchor would be one task's
    dealt = paired.select("key", "fp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).repartition(shuffle_partitions(prints.sparkSession), "key", "low", "high")
    groups = dealt.groupBy("key", "low", "high").agg(F.collect_list("fp").alias("prints"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, offsets = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
            found = [linked(values[a:b], distance) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return groups.select("prints").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id, one row for each row of `documents`.

    component_id is the least key whose fingerprint can be reached over links of
    at most `distance` differing bits, the row's own included. Null, empty
    and wordless texts have fingerprint zero and link like any other. Null
    keys are never a component_id unless no row of the component has one. Equal fingerprints are
    compared once, however many rows share them.
    """
    rows = stored(documents.select(F.col(key).alias("id"), fingerprint(text, words).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    tree = components(links(prints.select("fp"), distance))
    rooted = prints.join(tree.hint("merge"), prints.fp == tree.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    reached = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(reached.hint("merge"), "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named.hint("merge"), "fp").select(F.col("id").alias(key), digits.alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
