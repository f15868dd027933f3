"""Shards of near equal bytes from a k-d tree over document metadata, with DataFrame functions alone."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkroll.llm.common import stored, table

SHARDS = 40
#: Bytes of a row besides its text.
ROW_BYTES = 16
#: Bits of one refinement of a median: so many bins of each node come to the driver, at most SHARDS times 2 ** BITS.
BITS = 12
#: Digits of a position: one of the dimension and four of the text's hash, then four of the row's hash.
DIGITS = 9
#: A cut may be off its median by this share of a shard.
TOLERANCE = 0.005
DIMENSIONS = ("lang", "source", "bytes")
#: Rows of one slice of a shard, within which slots are counted by a window.
SLICE_ROWS = 20_000


@dataclass
class Node:
    """A cell of the tree that becomes `leaves` shards from number `first` on."""

    leaves: int
    first: int
    dimension: int = 0
    total: int = 0
    digits: list[int] = field(default_factory=list)
    #: Bytes of the cell that are known to lie before the digits so far.
    before: int = 0
    cut: tuple[int, int] | None = None


def _prefix_number(name: str) -> Column:
    """First six bytes of a string as a number, so that order is kept; 0 for null."""
    digits = F.rpad(F.hex(F.substring(F.encode(F.coalesce(name, F.lit("")), "utf-8"), 1, 6)), 12, "0")
    return F.conv(digits, 16, 10).cast("bigint")


def _listed(values: list[int], kind: str = "bigint") -> Column:
    return F.array(*[F.lit(int(v)).cast(kind) for v in values])


def _at(values: list[int], kind: str = "bigint") -> Column:
    """The value of the row's node, from a list of at most SHARDS values."""
    return F.element_at(_listed(values, kind), F.col("node") + 1)


def positions(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, dims, spread, row_hash: the narrow table that the tree is built on.

    Rows of equal text are a group and take the metadata of its least id, so that they have one position and stay together
    unless a group is too heavy for the balance. `dims` holds a number of BITS bits
    for each dimension, scaled to its range over all rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + ROW_BYTES
    rows = documents.select(
        "doc_id", size.alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        _prefix_number("lang").alias("lang"), _prefix_number("source").alias("source"),
    )
    rows = stored(rows)
    # stored, so that both sides of the join are plain shuffles, which adaptive execution splits at a hot text
    first = stored(rows.groupBy("text_hash", "size").agg(F.min(F.struct("doc_id", "lang", "source")).alias("f")))
    rows = rows.select("doc_id", "size", "text_crc32", "text_hash").join(first, ["text_hash", "size"])
    rows = rows.select("doc_id", "size", "text_crc32", "text_hash", F.col("f.lang").alias("lang"), F.col("f.source").alias("source"), F.log2("size").alias("bytes"))
    ends = rows.agg(*[f(d).cast("double").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).first()

    def scaled(d: str) -> Column:
        low, high = ends[f"low_{d}"], ends[f"high_{d}"]
        if low is None or low == high:
            return F.lit(0).cast("bigint")
        return F.floor((F.col(d).cast("double") - F.lit(low)) / F.lit(high - low) * F.lit(float((1 << BITS) - 1))).cast("bigint")

    spread = F.col("text_hash").bitwiseAND(F.lit((1 << 4 * BITS) - 1))
    row_hash = F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit((1 << 4 * BITS) - 1))
    return rows.select("doc_id", "size", "text_crc32", F.array(*[scaled(d) for d in DIMENSIONS]).alias("dims"), spread.alias("spread"), row_hash.alias("row_hash"))


def _with_code(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """`code`: the row's number along the dimension of its node, followed by the text's hash."""
    along = F.element_at("dims", _at([n.dimension + 1 for n in nodes], "int"))
    return rows.withColumn("code", along * F.lit(1 << 4 * BITS) + F.col("spread"))


def _choose_dimensions(rows: DataFrame, nodes: list[Node]) -> None:
    """Total of each node and its widest dimension; of equally wide ones the first."""
    ends = [f(F.element_at("dims", k + 1)).alias(f"{n}{k}") for k in range(len(DIMENSIONS)) for n, f in (("low", F.min), ("high", F.max))]
    for r in rows.groupBy("node").agg(F.sum("size").alias("total"), *ends).collect():
        node = nodes[r.node]
        node.total = r.total
        widths = [r[f"high{k}"] - r[f"low{k}"] for k in range(len(DIMENSIONS))]
        node.dimension = widths.index(max(widths))


def _prefixes(node: Node) -> tuple[int, int]:
    """The node's digits so far as a number of the code, and as one of the row hash."""
    code = row = 0
    for k, digit in enumerate(node.digits):
        if k < 5:
            code = (code << BITS) + digit
        else:
            row = (row << BITS) + digit
    return code, row


def _refine(rows: DataFrame, nodes: list[Node], slack: float) -> None:
    """Find the cut of every node: one more digit of its weighted median with each pass over the rows."""
    open_nodes = [k for k, n in enumerate(nodes) if n.leaves > 1 and n.cut is None]
    step = 0
    while open_nodes:
        here = [k for k in open_nodes if len(nodes[k].digits) == step]
        code_shift, row_shift = BITS * max(0, 4 - step), BITS * (8 - step)
        known = [_prefixes(n) if k in here else (-1, -1) for k, n in enumerate(nodes)]
        shift = lambda c, n: F.call_function("shiftright", c, F.lit(n))
        if step < 5:
            match = shift(F.col("code"), code_shift + BITS) == _at([c for c, _ in known])
            digit = shift(F.col("code"), code_shift)
        else:
            match = (F.col("code") == _at([c for c, _ in known])) & (shift(F.col("row_hash"), row_shift + BITS) == _at([r for _, r in known]))
            digit = shift(F.col("row_hash"), row_shift)
        bins = defaultdict(list)
        digit = digit.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("digit")
        for r in rows.where(match).select("node", digit, "size").groupBy("node", "digit").agg(F.sum("size").alias("size")).collect():
            bins[r.node].append((r.digit, r.size))
        for k in here:
            node = nodes[k]
            target = node.total * (node.leaves // 2) / node.leaves
            for number, size in sorted(bins[k]):
                if node.before + size >= target or (number, size) == max(bins[k]):
                    break
                node.before += size
            if size > slack and step + 1 < DIGITS:
                node.digits.append(number)
                continue
            # the nearer edge of the bin
            node.digits.append(number + (1 if node.before + size - target < target - node.before else 0))
            code, row = _prefixes(node)
            missing = max(0, 4 - step)
            node.cut = (code << BITS * missing, 0) if step < 5 else (code, row << BITS * (8 - step))
        step += 1
        open_nodes = [k for k in open_nodes if nodes[k].cut is None]


def kd_shards(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`placed` (see `positions`) with its shard, 0 to shards - 1, sizes near equal.

    A node of L shards is cut at the weighted quantile floor(L / 2) / L of its widest
    dimension. All nodes of a level are refined together; what reaches the driver are
    node totals and bins, whose number does not depend on the rows.
    """
    rows = placed.withColumn("node", F.lit(0))
    nodes = [Node(shards, 0)]
    while any(n.leaves > 1 for n in nodes):
        _choose_dimensions(rows, nodes)
        coded = _with_code(rows, nodes)
        slack = TOLERANCE * sum(n.total for n in nodes) / shards
        _refine(coded, nodes, slack)
        children, starts = [], []
        for n in nodes:
            starts.append(len(children))
            half = n.leaves // 2
            children += [Node(half, n.first), Node(n.leaves - half, n.first + half)] if n.leaves > 1 else [Node(1, n.first)]
        cuts = [n.cut or ((1 << 62), 0) for n in nodes]
        code_cut, row_cut = _at([c for c, _ in cuts]), _at([r for _, r in cuts])
        right = (F.col("code") > code_cut) | ((F.col("code") == code_cut) & (F.col("row_hash") >= row_cut))
        # each level is stored: its node expression would otherwise be nested in all that follow
        rows = stored(coded.withColumn("node", (_at(starts, "int") + right.cast("int")).cast("int")).drop("code"))
        nodes = children
    return rows.withColumn("shard", _at([n.first for n in nodes], "int")).drop("node")


def with_slots(rows: DataFrame, count: int) -> DataFrame:
    """`slot`: place of the row in its shard, gapless from 0. A shard is counted in slices, tied by their sizes."""
    slices = max(16, -(-count // (SHARDS * SLICE_ROWS)) * 4)
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int"))
    sizes = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")) - 1
    return sliced.join(sizes, ["shard", "slice"]).withColumn("slot", (F.col("before") + inside).cast("bigint")).drop("slice", "before")


def assign_shards(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row for each row of `documents`.

    The law is `bytes`. Null text, lang, source or id are values like any other (size 16 for a null text,
    first in order); repeated rows are placed each. An empty table has no shards.
    """
    placed = stored(positions(documents))
    count = placed.count()
    rows = stored(kd_shards(placed, shards).select("doc_id", "size", "text_crc32", "shard")) if count else placed.withColumn("shard", F.lit(0))
    rows = with_slots(rows, count)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_kd_shards(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
