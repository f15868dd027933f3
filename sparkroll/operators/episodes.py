"""Episode tables: length filter, row checks, padding into batches, reports.

Padding takes every episode it is given; which ones are short enough for a model
is the business of `filter_long_episodes`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkroll.operators.sampling import seeded
from sparkroll.skew import rank_by_id

EPISODE = "episode_id"
# Fixed values of the padded positions.
PAD_ID, IGNORED_LABEL, PAD_LOGPROB = 0, -100, -1e9
# An array of more tokens than this is taken for a mistake in the data.
MOST_TOKENS = 10_000_000


def lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(EPISODE).agg(F.count(F.lit(1)).alias("len"), F.count_if("is_action").alias("response_len"))


def filter_long_episodes(tokens: DataFrame, max_seq_len: int) -> DataFrame:
    """Every episode with its length and whether it is kept."""
    return lengths(tokens).withColumn("kept", F.col("len") <= max_seq_len)


def validate(tokens: DataFrame, reward: Column, scores: Column) -> DataFrame:
    """Row checks per episode, and the reward that stands for both names."""
    checks = tokens.groupBy(EPISODE).agg(
        (F.count_if(~F.col("is_action")) > 0).alias("has_query"),
        (F.count_if("is_action") > 0).alias("has_response"),
        (F.count_if(F.col("is_action") & F.col("advantage").isNotNull()) == F.count_if("is_action")).alias("advantages_match"),
        F.max_by(F.coalesce(reward, scores), "t").alias("reward"),
    )
    return checks.withColumn("valid", F.col("has_query") & F.col("has_response") & F.col("advantages_match"))


def collect_tokens(tokens: DataFrame, columns: Mapping[str, Column], most: int = MOST_TOKENS) -> DataFrame:
    """One row per episode, its columns as arrays in token order; an episode of more than `most` tokens raises."""
    rows = tokens.select(EPISODE, "t", "is_action", *[c.alias(n) for n, c in columns.items()]).groupBy(EPISODE).agg(
        F.count(F.lit(1)).alias("len"), F.count_if("is_action").alias("response_len"), F.array_sort(F.collect_list(F.struct("t", *columns))).alias("rows"))
    held = F.when(F.col("len") <= most, F.col("len")).otherwise(F.raise_error(F.lit(f"an episode has more than {most} tokens")).cast("bigint"))
    return rows.select(EPISODE, held.alias("len"), "response_len", *[F.col(f"rows.{n}").alias(n) for n in columns])


def in_batches(sizes: DataFrame, key: str, batch_size: int) -> DataFrame:
    """Consecutive batches in key order, each with the length of its longest member, from (key, len) rows."""
    placed = rank_by_id(sizes.select(key, F.col("len").cast("int").alias("__len")), key, "pos").withColumn("batch", F.floor(F.col("pos") / batch_size))
    # a batch has at most batch_size rows
    members = Window.partitionBy("batch")
    return placed.select(key, "batch", "pos", F.max("__len").over(members).alias("max_len"), F.count(F.lit(1)).over(members).alias("members"))


def pad(values: Column, to: Column, filler: Column) -> Column:
    return F.concat(values, F.array_repeat(filler, F.greatest(to - F.size(values), F.lit(0))))


def pad_batches(tokens: DataFrame, token_id: Column, batch_size: int) -> DataFrame:
    """Input ids, labels, mask, advantages, shifted log-probs and values of every episode, padded to its batch."""
    action = F.col("is_action")
    arrays = collect_tokens(tokens, {
        "ids": token_id, "labels": F.when(action, token_id).otherwise(IGNORED_LABEL), "adv": F.when(action, F.col("advantage")).otherwise(0.0),
        "lp": F.col("actor_lp"), "values": F.col("value")})
    rows = arrays.join(in_batches(lengths(tokens), EPISODE, batch_size), EPISODE)
    size = F.col("max_len")
    query_len = F.col("len") - F.col("response_len")
    # log-probs are those of the next token: the first kept one is at the last query position
    shifted = F.transform(F.slice("lp", F.lit(2), F.size("lp")), lambda x, i: F.when(i >= query_len - 1, x).otherwise(PAD_LOGPROB))
    return rows.select(
        EPISODE, "batch", "max_len",
        pad(F.col("ids"), size, F.lit(PAD_ID)).alias("input_ids"),
        pad(F.col("labels"), size, F.lit(IGNORED_LABEL)).alias("labels"),
        pad(F.array_repeat(F.lit(1), F.size("ids")), size, F.lit(0)).alias("attention_mask"),
        pad(F.col("adv"), size, F.lit(0.0)).alias("advantages"),
        pad(shifted, size - 1, F.lit(PAD_LOGPROB)).alias("shifted_logprobs"),
        pad(F.col("values"), size, F.lit(PAD_LOGPROB)).alias("values"),
    )


def pair_arrays(tokens: DataFrame, token_id: Column) -> DataFrame:
    """Accept (even) and reject (odd) episodes of each pair; pairs with a missing half are left out."""
    arrays = collect_tokens(tokens, {"ids": token_id, "labels": F.when(F.col("is_action"), token_id).otherwise(IGNORED_LABEL)})
    pair = F.floor(F.col(EPISODE) / 2).alias("pair_id")
    accept = arrays.where(F.col(EPISODE) % 2 == 0).select(pair, F.col("ids").alias("accept_ids"), F.col("labels").alias("accept_labels"))
    reject = arrays.where(F.col(EPISODE) % 2 == 1).select(pair, F.col("ids").alias("reject_ids"), F.col("labels").alias("reject_labels"))
    return accept.join(reject, "pair_id")


def pair_sizes(tokens: DataFrame) -> DataFrame:
    """The longer side of every complete pair, from token counts."""
    pairs = lengths(tokens).groupBy(F.floor(F.col(EPISODE) / 2).alias("pair_id")).agg(F.max("len").alias("len"), F.count(F.lit(1)).alias("sides"))
    return pairs.where("sides = 2")


def pad_pair_batches(tokens: DataFrame, token_id: Column, batch_size: int) -> DataFrame:
    """One maximal length over both sides of a batch."""
    rows = pair_arrays(tokens, token_id).join(in_batches(pair_sizes(tokens), "pair_id", batch_size), "pair_id")
    sides = []
    for side in ("accept", "reject"):
        sides += [
            pad(F.col(f"{side}_ids"), F.col("max_len"), F.lit(PAD_ID)).alias(f"{side}_input_ids"),
            pad(F.col(f"{side}_labels"), F.col("max_len"), F.lit(IGNORED_LABEL)).alias(f"{side}_labels"),
            pad(F.array_repeat(F.lit(1), F.size(f"{side}_ids")), F.col("max_len"), F.lit(0)).alias(f"{side}_attention_mask"),
        ]
    return rows.select("pair_id", "batch", "max_len", *sides)


def pad_stacked_pairs(tokens: DataFrame, token_id: Column, batch_size: int) -> DataFrame:
    """Chosen rows, then rejected rows of a batch as one stack of twice the size; all labels ignored."""
    rows = pair_arrays(tokens, token_id).join(in_batches(pair_sizes(tokens), "pair_id", batch_size), "pair_id")
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("accept_ids").alias("ids")), F.struct(F.lit(1).alias("side"), F.col("reject_ids").alias("ids")))
    stacked = rows.select("pair_id", "batch", "pos", "max_len", "members", F.inline(both))
    return stacked.select(
        "pair_id", "batch", (F.col("side") * F.col("members") + F.col("pos") % batch_size).alias("row"), "side", "max_len",
        pad(F.col("ids"), F.col("max_len"), F.lit(PAD_ID)).alias("input_ids"), F.array_repeat(F.lit(IGNORED_LABEL), F.col("max_len")).alias("labels"))


def sample_report(tokens: DataFrame, seed: int, n: int, columns: Mapping[str, Column]) -> DataFrame:
    """A seeded sample of episodes with their columns joined to text, for the log."""
    ids = lengths(tokens).orderBy(seeded(seed, EPISODE), EPISODE).limit(n).select(EPISODE)
    arrays = collect_tokens(tokens.join(ids, EPISODE, "left_semi"), columns)
    return arrays.select(EPISODE, F.col("len").alias("instance_length"), *[F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in columns])

