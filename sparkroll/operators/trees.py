"""Reasoning trees as an adjacency table, worked level by level, or with ancestors found by pointer doubling.

Columns: tree_id, node_id, parent_id, depth, expanded, answer, is_correct, and
any others; depth counts the links to the root. The table is stored once, as it
is read for every level; joins to it ask for a merge, since its compressed size
would have Spark broadcast what is large. Trees of fewer than SHALLOW levels pass scores up and
chains down, so that a chain is shuffled once for each parent, not once for
each node below it. Deeper ones take few rounds: pointers to the parent become pointers to the ancestor 2, 4, 8, ...
levels up by joining them with themselves; a set of nodes meets all its ancestors
by taking one kind of pointer after the other, so a tree of depth d needs
log2(d) rounds of joins, not d. Only ids travel in them; what else a chain holds is
joined to the finished pairs. Every few rounds ids are stored in the checkpoint
folder, which bounds the plan and what a lost executor costs. Wide nodes and big
trees stay spread: pairs are keyed by node, and sums combine before they shuffle.
`max_depth` only says how deep a tree was meant to be, for weights and repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroll.functions.arrays import last
from sparkroll.operators.bleu import group_bleu
from sparkroll.operators.sampling import sample_per_group
from sparkroll.session import reliable_checkpoint, reliable_table
from sparkroll.skew import has_hot_group, rank_in_group


#: Rounds of doubling between two stores.
STORE_EVERY = 2
#: Trees with fewer levels are worked level by level.
SHALLOW = 8


def level(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.where(F.col("depth") == depth)


def deepest(nodes: DataFrame) -> int:
    """Depth of the deepest node: the levels are those of the data, whatever depth the trees were meant to have."""
    return nodes.agg(F.max("depth")).first()[0] or 0


def parent_pointers(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, above and share of every node with a parent in the table.

    The share is what a node's score counts in its parent's: one over the
    number of children, and 0 where the parent has an answer of its own.
    """
    kids = nodes.where(F.col("parent_id").isNotNull()).groupBy("tree_id", F.col("parent_id").alias("above")).agg(F.count(F.lit(1)).alias("kids"))
    parents = nodes.select("tree_id", F.col("node_id").alias("above"), F.col("answer").isNotNull().alias("answered")).join(kids, ["tree_id", "above"])
    shares = parents.select("tree_id", "above", F.when(F.col("answered"), 0.0).otherwise(1.0 / F.col("kids")).alias("share"))
    return nodes.select("tree_id", "node_id", F.col("parent_id").alias("above")).join(shares, ["tree_id", "above"]).select("tree_id", "node_id", "above", "share")


def ancestors(starts: DataFrame, pointers: DataFrame, depth: int) -> DataFrame:
    """tree_id, node_id, above, share: each start (tree_id, node_id) with itself and all ancestors up to `depth` levels up.

    The share is the product along the way. After round k a start has met the
    ancestors fewer than 2 ** k levels up, and pointers reach 2 ** k levels.
    """
    met = starts.select("tree_id", "node_id", F.col("node_id").alias("above"), F.lit(1.0).alias("share"))
    rounds = max(depth, 0).bit_length()
    for k in range(rounds):
        step = pointers.select("tree_id", F.col("node_id").alias("__via"), F.col("above").alias("__above"), F.col("share").alias("__share"))
        onward = met.withColumnRenamed("above", "__via").join(step, ["tree_id", "__via"])
        met = met.unionByName(onward.select("tree_id", "node_id", F.col("__above").alias("above"), (F.col("share") * F.col("__share")).alias("share")))
        if k == rounds - 1:
            break
        doubled = pointers.withColumnRenamed("above", "__via").join(step, ["tree_id", "__via"])
        pointers = doubled.select("tree_id", "node_id", F.col("__above").alias("above"), (F.col("share") * F.col("__share")).alias("share"))
        if k % STORE_EVERY == STORE_EVERY - 1:
            met, pointers = reliable_checkpoint(met), reliable_checkpoint(pointers)
    return met


def tree_score(nodes: DataFrame, correct: Column | None = None) -> DataFrame:
    """Score of every node: its grade if answered, else the unweighted mean of its children, 0 without any."""
    grade = F.coalesce((F.col("is_correct") if correct is None else correct).cast("double"), F.lit(0.0))
    answered = F.col("answer").isNotNull()
    nodes = reliable_table(nodes)
    depth = deepest(nodes)
    if not _shallow(nodes, depth):
        return _score_by_doubling(nodes, depth, grade, answered)
    parts: list[DataFrame] = []
    for at in range(depth, -1, -1):
        here, mean = level(nodes, at), F.lit(0.0)
        if parts:
            means = parts[-1].groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.avg("score").alias("__mean")).hint("merge")
            here, mean = here.join(means, ["tree_id", "node_id"], "left"), F.coalesce("__mean", F.lit(0.0))
        parts.append(here.withColumn("score", F.when(answered, grade).otherwise(mean)).select(*nodes.columns, "score"))
    return _union(parts)


def _shallow(nodes: DataFrame, depth: int) -> bool:
    """True if every row has one of a few levels."""
    return depth < SHALLOW and nodes.where(F.col("depth").isNull() | (F.col("depth") < 0)).isEmpty()


def _score_by_doubling(nodes: DataFrame, depth: int, grade: Column, answered: Column) -> DataFrame:
    """An unanswered node has the sum of the grades of the answered nodes below it, each times its share, where no other answered node stands between."""
    pointers = reliable_checkpoint(parent_pointers(nodes))
    graded = nodes.where(answered).select("tree_id", "node_id", grade.alias("__grade"))
    met = ancestors(graded.where("__grade != 0"), pointers, depth).where((F.col("share") > 0) & (F.col("node_id") != F.col("above")))
    sums = met.join(graded, ["tree_id", "node_id"]).groupBy("tree_id", F.col("above").alias("node_id")).agg(F.sum(F.col("share") * F.col("__grade")).alias("__sum"))
    scored = nodes.join(sums, ["tree_id", "node_id"], "left")
    return scored.withColumn("score", F.when(answered, grade).otherwise(F.coalesce("__sum", F.lit(0.0)))).select(*nodes.columns, "score")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


BASE = ["tree_id", "node_id", "parent_id", "depth", "expanded", "answer"]


def chains(nodes: DataFrame, max_depth: int, fields: Sequence[str], branch_factor: int | None = None, keep_child: Callable[[DataFrame], DataFrame] | None = None, wanted: Column | None = None) -> DataFrame:
    """Every node with `chain`, the structs from the root down to it, and `path_key`, its DFS sort key.

    With a `score` field each struct also gets `advantage`, the score minus the
    parent's; it is null at the root and below an answered node. A branch factor
    adds `weight`. `keep_child` may sample the first level of children, and
    `wanted` says which nodes get a chain, else all do. A node that no chain of
    parents ties to a root (depth 0) has none.
    """
    kept = ["node_id", *[f for f in fields if f != "node_id"]]
    weight = importance_weight(F.col("depth"), branch_factor, max_depth) if branch_factor else F.lit(1.0)
    columns = nodes.columns if keep_child else [c for c in nodes.columns if c in (*BASE, *kept)]
    nodes = reliable_table(nodes.select(*columns, (F.lit(True) if wanted is None else wanted).alias("__wanted")))
    depth = deepest(nodes.where("__wanted"))
    build = _chains_by_level if _shallow(nodes, deepest(nodes)) else _chains_by_doubling
    rows = build(nodes, depth, kept, weight)
    if keep_child is None:
        return rows
    first_level = keep_child(level(nodes, 1)).select("tree_id", F.col("node_id").alias("__top"))
    top = rows.withColumn("__top", F.try_element_at("path_key", F.lit(2)))
    return top.where("depth = 0").drop("__top").unionByName(top.where("depth > 0").join(first_level, ["tree_id", "__top"], "left_semi").select(*rows.columns))


def _chains_by_level(nodes: DataFrame, depth: int, kept: Sequence[str], weight: Column) -> DataFrame:
    """The rows of `chains` where `__wanted`: each level takes the chains of its parents."""
    fields = [F.col(f).alias(f) for f in kept]
    unanswered, weight, gain = F.col("answer").isNull(), weight.alias("weight"), "score" in kept
    root = F.struct(*fields, *([F.lit(None).cast("double").alias("advantage")] if gain else []), weight, unanswered.alias("open"))
    above = last(F.col("__chain"))
    advantage = [F.when(above["open"], F.col("score") - above["score"]).cast("double").alias("advantage")] if gain else []
    node = F.struct(*fields, *advantage, weight, (above["open"] & unanswered).alias("open"))
    whole, parts = None, []
    for at in range(depth + 1):
        here = level(nodes, at)

        def chained(rows: DataFrame) -> DataFrame:
            if whole is None:
                return rows.select(*BASE, "__wanted", F.array(root).alias("chain"))
            over = whole.select("tree_id", F.col("node_id").alias("parent_id"), F.col("chain").alias("__chain")).hint("merge")
            return rows.join(over, ["tree_id", "parent_id"]).select(*BASE, "__wanted", F.concat("__chain", F.array(node)).alias("chain"))

        parts.append(chained(here.where("__wanted")))
        whole = chained(here)
    return _union(parts).select(*BASE, "chain", F.transform("chain", lambda n: n["node_id"]).alias("path_key"))


def _chains_by_doubling(nodes: DataFrame, depth: int, kept: Sequence[str], weight: Column) -> DataFrame:
    """The rows of `chains` where `__wanted`: ends meet their ancestors as pairs of ids."""
    ends = nodes.where("__wanted")
    edges = nodes.where(F.col("parent_id").isNotNull()).select("tree_id", "node_id", F.col("parent_id").alias("above"), F.lit(1.0).alias("share"))
    met = ancestors(ends.select("tree_id", "node_id"), reliable_checkpoint(edges), depth).drop("share")
    entry = F.struct(F.col("depth").alias("__at"), *kept, weight.alias("weight"), F.col("answer").isNotNull().alias("__answered"))
    entries = nodes.select("tree_id", F.col("node_id").alias("above"), entry.alias("__entry"))
    # one row for each level of a node's own chain
    lists = met.join(entries, ["tree_id", "above"]).groupBy("tree_id", "node_id").agg(F.array_sort(F.collect_list("__entry")).alias("__raw"))
    whole = (F.col("__raw")[0]["__at"] == 0) & (F.size("__raw") == F.col("depth") + 1)
    rows = ends.select(*BASE).join(lists, ["tree_id", "node_id"]).where(whole)
    # the first answered node from the top: nothing below it is open
    first = F.array_position(F.transform("__raw", lambda n: n["__answered"]), True) - 1
    rows = rows.withColumn("__first", F.when(first >= 0, first).otherwise(F.size("__raw")))

    def finished(n: Column, i: Column) -> Column:
        above = F.try_element_at("__raw", F.greatest(i, F.lit(1)))
        gain = F.when((i > 0) & (i <= F.col("__first")), n["score"] - above["score"]) if "score" in kept else None
        extra = [gain.cast("double").alias("advantage")] if gain is not None else []
        return F.struct(*[n[f].alias(f) for f in kept], *extra, n["weight"].alias("weight"), (i < F.col("__first")).alias("open"))

    return rows.select(*BASE, F.transform("__raw", finished).alias("chain"), F.transform("__raw", lambda n: n["node_id"]).alias("path_key"))


def tree_advantage(chained: DataFrame) -> DataFrame:
    return chained.select("tree_id", "node_id", last(F.col("chain"))["score"].alias("score"), last(F.col("chain"))["advantage"].alias("advantage"))


def tree_paths(chained: DataFrame) -> DataFrame:
    """Root-to-leaf chains; a leaf is a node that was never expanded, also when it has no answer."""
    return chained.where(~F.col("expanded"))


def importance_weight(depth: Column, branch_factor: int, max_depth: int) -> Column:
    return F.when(depth < max_depth, F.pow(F.lit(float(branch_factor)), max_depth - depth)).otherwise(1.0)


def tree_paths_repeated(paths: DataFrame, branch_factor: int, max_depth: int) -> DataFrame:
    """A leaf above the maximal depth stands for all the leaves it would have had."""
    copies = importance_weight(F.col("depth"), branch_factor, max_depth).cast("int")
    return paths.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))


def state_action_paths(nodes: DataFrame, max_depth: int, fields: Sequence[str], branch_factor: int, first_children: int | None = None, seed: int = 0) -> DataFrame:
    """One path per non-root node, weighted by the leaves it stands for; optionally n first-level children per tree."""
    keep = None if first_children is None else lambda children: sample_per_group(children, ["tree_id"], ["node_id"], seed, first_children)
    chained = chains(nodes, max_depth, fields, branch_factor, keep).where(F.col("depth") > 0)
    weight = F.greatest(F.pow(F.lit(float(branch_factor)), max_depth - F.col("depth")), F.lit(1.0))
    return chained.withColumn("path_weight", weight)


def candidate_answers(chained: DataFrame) -> DataFrame:
    """Answered nodes with their position in DFS order."""
    answered = chained.where(F.col("answer").isNotNull())
    return rank_in_group(answered, ["tree_id"], [F.col("path_key")], "pos")


def candidate_logprobs(chained: DataFrame, logprob: str) -> DataFrame:
    """Log-probability summed from the root to each answered node; missing ancestors count 0, a missing own value raises."""
    own = last(F.col("chain"))[logprob]
    total = F.aggregate("chain", F.lit(0.0), lambda acc, n: acc + F.coalesce(n[logprob], F.lit(0.0)))
    checked = F.when(own.isNull(), F.raise_error(F.lit("an answered node has no log-probability")).cast("double")).otherwise(total)
    return chained.where(F.col("answer").isNotNull()).select("tree_id", "node_id", checked.alias("sum_logprob"))


def branch_factor(depth: Column, constant: int | None = None, steps: Sequence[tuple[int, int]] | None = None, spine: tuple[Column, int] | None = None) -> Column:
    """Constant; the last step at or above the depth; or k on the spine and 1 elsewhere."""
    if constant is not None:
        return F.lit(constant)
    if spine is not None:
        return F.when(spine[0], spine[1]).otherwise(1)
    chosen = F.lit(None).cast("int")
    for start, factor in sorted(steps):
        chosen = F.when(depth >= start, factor).otherwise(chosen)
    return chosen


Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
OPEN_SCHEMA = "tree_id bigint, node_id string, parent_id string, depth bigint, child_idx bigint, text string, full_text string, closed boolean"


def expand_frontier(roots: DataFrame, generator: Generator, factor: Callable[[Column], Column], max_depth: int) -> DataFrame:
    """Grow trees: each round every open node yields factor(depth) children from the user's generator.

    The generator maps Arrow batches of requests (tree_id, parent_id, depth,
    child_idx, prefix) to OPEN_SCHEMA rows. Each level is checkpointed in the
    shared folder, so a lost executor never repeats a generation.
    """
    frontier, grown = roots, [roots]
    for depth in range(max_depth):
        requests = frontier.where(~F.col("closed")).select(
            "tree_id", F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), factor(F.lit(depth)).cast("bigint") - 1)).alias("child_idx"), F.col("full_text").alias("prefix"))
        frontier = reliable_checkpoint(requests.mapInPandas(generator, OPEN_SCHEMA))
        grown.append(frontier)
    return _union(grown)


def fish_bone_spine(solutions: DataFrame, key: str, steps: str, prompt: Column) -> DataFrame:
    """Solution steps as a spine: node i holds its text and everything up to it; the root holds prompt and step 0."""
    def ends(lengths: Column) -> Column:
        # one running sum: the fold carries the array of ends
        start = F.array(F.length(prompt))
        return F.aggregate(lengths, start, lambda acc, n: F.concat(acc, F.array(last(acc) + n)))

    whole = F.concat(prompt, F.array_join(steps, ""))
    rows = solutions.select(key, whole.alias("whole"), F.arrays_zip(F.col(steps).alias("step"), F.slice(ends(F.transform(steps, lambda s: F.length(s))), F.lit(2), F.size(steps)).alias("upto")).alias("nodes"))
    spine = rows.select(key, "whole", F.posexplode("nodes").alias("pos", "n"))
    full = F.substring("whole", F.lit(1), F.col("n.upto"))
    return spine.select(key, F.col("pos").cast("bigint").alias("depth"), F.when(F.col("pos") == 0, full).otherwise(F.col("n.step")).alias("text"), full.alias("full_text"))


def tree_bleu(nodes: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """BLEU of the child texts of every node with more than one child, and its averages over trees."""
    children = nodes.where(F.col("parent_id").isNotNull())
    hot = has_hot_group(children, ["tree_id", "parent_id"])
    ranked = rank_in_group(children, ["tree_id", "parent_id"], [F.col("node_id")], "__idx", hot)
    per_node = group_bleu(ranked, ["tree_id", "parent_id", "depth"], "__idx", text, hot)
    by_depth = per_node.groupBy("tree_id", "depth").agg(F.sum("bleu").alias("s"), F.count(F.lit(1)).alias("n"))
    per_tree = by_depth.groupBy("tree_id").agg((F.sum("s") / F.sum("n")).alias("mean"), F.avg(F.col("s") / F.col("n")).alias("by_depth"))
    summary = per_tree.agg(F.avg("mean").alias("avg_tree_bleu"), F.avg("by_depth").alias("avg_tree_bleu_depth_normalized"), F.count(F.lit(1)).alias("trees"))
    return per_node, summary


NODE_FIELDS = {"answer": "string", "finish_reason": "string"}


def tree_from_json(docs: DataFrame, column: str, fields: Mapping[str, str] = NODE_FIELDS) -> DataFrame:
    """JSON trees of any depth to node rows; invalid documents are dropped, an empty child list still counts as expanded.

    A node's id is the path of its child indexes, so equal texts are different nodes; `fields` names what else
    is read of a node, with types. Each level is parsed once, one node deep, and stored; the documents of
    the next one stay text.
    """
    schema = ", ".join(["text string", *[f"`{n}` {t}" for n, t in fields.items()], "children array<string>"])
    rows = docs.select("tree_id", F.lit("0").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("bigint").alias("child_idx"), F.from_json(column, schema).alias("n"))
    rows, parts, depth = reliable_table(rows.where("n.text is not null")), [], 0
    while not parts or not rows.isEmpty():
        parts.append(rows.select(
            "tree_id", "node_id", "parent_id", F.lit(depth).cast("bigint").alias("depth"), "child_idx", F.col("n.text").alias("text"),
            F.col("n.children").isNotNull().alias("expanded"), *[F.col(f"n.{n}").alias(n) for n in fields]))
        below = rows.select("tree_id", "node_id", F.posexplode("n.children").alias("pos", "doc"))
        rows = reliable_table(below.select(
            "tree_id", F.concat_ws(".", "node_id", "pos").alias("node_id"), F.col("node_id").alias("parent_id"), F.col("pos").cast("bigint").alias("child_idx"), F.from_json("doc", schema).alias("n")))
        depth += 1
    return _union(parts)


def tree_to_json(nodes: DataFrame, text: str = "node_id", fields: Sequence[str] = ("answer",)) -> DataFrame:
    """One sorted-key JSON document per tree, of whatever depth: text, depth, children, and the given string columns."""
    nodes = reliable_table(nodes.select(*dict.fromkeys(["tree_id", "node_id", "parent_id", "depth", "expanded", text, *fields])))
    below = None
    for depth in range(deepest(nodes), -1, -1):
        here = level(nodes, depth)
        children: Column = F.when(F.col("expanded"), F.lit("[]"))
        if below is not None:
            here = here.join(below, (F.col("tree_id") == F.col("__tree")) & (F.col("node_id") == F.col("__node")), "left")
            children = F.when(F.col("expanded"), F.coalesce("__children", F.lit("[]")))
        doc = _object({**{f: _string(F.col(f)) for f in fields}, "children": children, "depth": F.col("depth").cast("string"), "text": _string(F.col(text))})
        here = here.select("tree_id", "node_id", "parent_id", doc.alias("doc"))
        if depth == 0:
            return here.select("tree_id", F.col("doc").alias("tree"))
        ordered = F.sort_array(F.collect_list(F.struct("node_id", "doc")))["doc"]
        below = here.groupBy("tree_id", "parent_id").agg(F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]")).alias("__children")).select(
            F.col("tree_id").alias("__tree"), F.col("parent_id").alias("__node"), "__children").hint("merge")
    raise AssertionError("unreachable")


def _string(x: Column) -> Column:
    """A JSON string literal, null stays null."""
    # behind {"s": and before }, which a literal never ends with
    return F.when(x.isNotNull(), F.rtrim(F.substr(F.to_json(F.struct(x.alias("s"))), F.lit(6)), F.lit("}")))


def _object(fields: dict[str, Column]) -> Column:
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}": '), v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
