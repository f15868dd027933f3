"""Path filters, post-processors and aggregators, and the strategy that chains them.

A path is one row with its chain as an array of at most max_depth + 1 structs,
so filters and rewrites are expressions on that array: no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroll.functions.arrays import last, let
from sparkroll.operators.sampling import sample_per_group
from sparkroll.plugins import Registry
from sparkroll.skew import has_hot_group, rank_in_group, with_group_stats

CHAIN = "chain"
EPSILON = 1e-6

filters: Registry[Callable[[Column], Column]] = Registry("path filter")
post_processors: Registry[Callable[..., Column]] = Registry("path post-processor")
aggregators: Registry[Callable[..., DataFrame]] = Registry("path aggregator")


@filters.register("none")
def keep_every(chain: Column) -> Column:
    return F.lit(True)


@filters.register("successful")
def successful(chain: Column) -> Column:
    return F.coalesce(last(chain)["answer"].isNotNull() & (last(chain)["is_correct"] == 1), F.lit(False))


@filters.register("non_zero_score")
def non_zero_score(chain: Column) -> Column:
    return F.coalesce(F.try_element_at(chain, F.lit(2))["score"] > 0, F.lit(False))


@filters.register("non_zero_last_step_score")
def non_zero_last_step_score(chain: Column) -> Column:
    return last(chain)["score"] > 0


@filters.register("zero_last_step_score")
def zero_last_step_score(chain: Column) -> Column:
    return last(chain)["score"] == 0


@filters.register("non_zero_last_step_advantage")
def non_zero_last_step_advantage(chain: Column) -> Column:
    return F.coalesce(last(chain)["advantage"] > 0, F.lit(False))


def _positions(chain: Column, test: Callable[[Column], Column]) -> Column:
    """0-based indexes of the nodes after the root that pass the test."""
    hits = F.transform(chain, lambda n, i: F.when((i >= 1) & F.coalesce(test(n), F.lit(False)), i))
    return F.filter(hits, lambda i: i.isNotNull())


@post_processors.register("chop_zero_advantage_tail")
def chop_zero_advantage_tail(chain: Column) -> Column:
    end = F.coalesce(F.array_max(_positions(chain, lambda n: F.abs(n["advantage"]) >= EPSILON)), F.lit(0))
    return F.slice(chain, F.lit(1), end + 1)


@post_processors.register("keep_first_step_only")
def keep_first_step_only(chain: Column) -> Column:
    return F.slice(chain, 1, 2)


@post_processors.register("chop_up_to_first_negative_advantage")
def chop_up_to_first_negative_advantage(chain: Column) -> Column:
    cut = F.coalesce(F.array_min(_positions(chain, lambda n: n["advantage"] < 0)), F.size(chain))
    return F.slice(chain, F.lit(1), cut)


def _rewrite(chain: Column, field: str, value: Callable[[Column, Column, Column], Column]) -> Column:
    """Replace one field of every node; value(node, index, size) gives the new one."""
    return let(F.size(chain), lambda n: F.transform(chain, lambda node, i: node.withField(field, value(node, i, n).cast("double"))))


@post_processors.register("all_advantages_to_one")
def all_advantages_to_one(chain: Column) -> Column:
    return _rewrite(chain, "advantage", lambda n, i, size: F.when(n["advantage"].isNotNull(), 1.0))


@post_processors.register("zero_advantages_to_epsilon")
def zero_advantages_to_epsilon(chain: Column, epsilon: float = 0.05) -> Column:
    return _rewrite(chain, "advantage", lambda n, i, size: F.when(n["advantage"] == 0, epsilon).otherwise(n["advantage"]))


@post_processors.register("negative_advantages_to_zero")
def negative_advantages_to_zero(chain: Column) -> Column:
    return _rewrite(chain, "advantage", lambda n, i, size: F.when(n["advantage"] < 0, 0.0).otherwise(n["advantage"]))


@post_processors.register("non_last_nodes_score_to_zero")
def non_last_nodes_score_to_zero(chain: Column) -> Column:
    return _rewrite(chain, "score", lambda n, i, size: F.when(i < size - 1, 0.0).otherwise(n["score"]))


@post_processors.register("non_last_nodes_advantage_to_zero")
def non_last_nodes_advantage_to_zero(chain: Column) -> Column:
    return _rewrite(chain, "advantage", lambda n, i, size: F.when((i < size - 1) & n["advantage"].isNotNull(), 0.0).otherwise(n["advantage"]))


@post_processors.register("fill_advantage_from_score")
def fill_advantage_from_score(chain: Column) -> Column:
    return _rewrite(chain, "advantage", lambda n, i, size: F.when(i >= 1, n["score"]).otherwise(n["advantage"]))


@post_processors.register("apply_importance_weights")
def apply_importance_weights(chain: Column) -> Column:
    kept = _rewrite(chain, "original_advantage", lambda n, i, size: n["advantage"])
    return _rewrite(kept, "advantage", lambda n, i, size: n["advantage"] * n["weight"])


@post_processors.register("last_step_advantage_to_one")
def last_step_advantage_to_one(chain: Column) -> Column:
    return _rewrite(chain, "advantage", lambda n, i, size: F.when(i == size - 1, 1.0).otherwise(n["advantage"]))


@aggregators.register("identity")
def identity(paths: DataFrame) -> DataFrame:
    return paths


@aggregators.register("unique")
def unique(paths: DataFrame, fields: Sequence[str] = ("depth", "answer", "is_correct", "score", "advantage", "weight")) -> DataFrame:
    """Distinct whole paths of a tree by the given node fields; the first in DFS order stays."""
    types = {f.name: f.dataType.typeName() for f in paths.schema[CHAIN].dataType.elementType.fields}

    def comparable(node: Column, field: str) -> Column:
        # adding zero makes -0.0 and 0.0 one value, as they are equal numbers
        return (node[field] + F.lit(0.0) if types[field] == "double" else node[field]).alias(field)

    content = F.transform(CHAIN, lambda n: F.struct(*[comparable(n, f) for f in fields]))
    keyed = paths.withColumn("__content", F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256))
    firsts = keyed.groupBy("tree_id", "__content").agg(F.min_by(F.struct(*paths.columns), "path_key").alias("p"))
    return firsts.select("p.*")


def path_value(reduction: str = "mean") -> Column:
    """Sum of advantages, or its mean over all nodes: the root counts in the mean. Ties are equal to 9 decimals."""
    total = F.aggregate(CHAIN, F.lit(0.0), lambda acc, n: acc + F.coalesce(n["advantage"], F.lit(0.0)))
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduction}")
    return F.round(total / F.size(CHAIN) if reduction == "mean" else total, 9)


@aggregators.register("top_k_percent")
def top_k_percent(paths: DataFrame, top_k_percent: float, keep_at_least_one: bool = True, reduction: str = "mean") -> DataFrame:
    valued = paths.withColumn("__value", path_value(reduction))
    hot = has_hot_group(valued, ["tree_id"])
    ranked = rank_in_group(valued, ["tree_id"], [F.col("__value").desc(), F.col("path_key")], "__rank", hot)
    counted = with_group_stats(ranked, ["tree_id"], {"__n": F.count(F.lit(1))}, hot)
    keep = F.floor(F.col("__n") * top_k_percent)
    return counted.where(F.col("__rank") < (F.greatest(keep, F.lit(1)) if keep_at_least_one else keep)).drop("__value", "__rank", "__n")


@aggregators.register("max_k")
def max_k(paths: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most k random paths of each tree."""
    keyed = paths.withColumn("__key", F.array_join("path_key", "/"))
    return sample_per_group(keyed, ["tree_id"], ["__key"], seed, k).drop("__key")


def drop_query_only(paths: DataFrame) -> DataFrame:
    return paths.where(F.size(CHAIN) > 1)


def path_strategy(paths: DataFrame, path_filters: Sequence[str] = (), steps: Sequence = (), aggregate: Sequence = ()) -> DataFrame:
    """Filters, then rewrites, then aggregators, then paths of the bare root go.

    Steps and aggregators are names, or (name, options) pairs.
    """
    for name in path_filters:
        paths = paths.where(filters[name](F.col(CHAIN)))
    for item in steps:
        name, options = (item, {}) if isinstance(item, str) else item
        paths = paths.withColumn(CHAIN, post_processors[name](F.col(CHAIN), **options))
    for item in aggregate:
        name, options = (item, {}) if isinstance(item, str) else item
        paths = aggregators[name](paths, **options)
    return drop_query_only(paths)
