"""Pairs inside a group without building all of them: preference pairs, pair counts, ranking accuracy, greedy picks."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkroll.operators.bleu import MAX_N, WORDS
from sparkroll.operators.sampling import permuted_picks
from sparkroll.session import reliable_checkpoint
from sparkroll.skew import has_hot_group, rank_in_group, running, with_group_stats

QUESTION = "question_id"


def enrich_left_join(rows: DataFrame, bank: DataFrame, key: str, bank_key: str) -> DataFrame:
    """Every row with the question-bank record of its key, null where there is none."""
    return rows.join(bank, F.col(key) == F.col(bank_key), "left")


def dpo_pairs(rewarded: DataFrame, threshold: float, max_pairs: int, seed: int) -> DataFrame:
    """Accepted x rejected rollouts of each question: at most max_pairs of them, each equally likely.

    A pair is a number below accepted * rejected, so picks are numbers and the
    product is never built. Both lookups are keyed by (question, side position),
    which spreads a hot question over all partitions.
    """
    if max_pairs < 1:
        raise ValueError("max_pairs must be positive; the full product of a large question is not offered")
    sided = rewarded.withColumn("accepted", F.col("reward") >= threshold)
    placed = rank_in_group(sided, [QUESTION, "accepted"], [F.col("rollout_idx")], "side_pos")
    sizes = rewarded.groupBy(QUESTION).agg(F.count_if(F.col("reward") >= threshold).alias("a"), F.count_if(F.col("reward") < threshold).alias("r"))
    # never empty; a plain explode would pick a second time to ask for that
    picks = sizes.where("a > 0 and r > 0").select(QUESTION, "r", F.explode_outer(permuted_picks(F.col("a") * F.col("r"), max_pairs, seed, QUESTION)).alias("pair"))
    picks = picks.select(QUESTION, "pair", F.expr("pair div r").alias("accept_pos"), (F.col("pair") % F.col("r")).alias("reject_pos"))
    accepted = placed.where("accepted").select(QUESTION, F.col("side_pos").alias("accept_pos"), F.col("rollout_idx").alias("accept_idx"))
    rejected = placed.where("not accepted").select(QUESTION, F.col("side_pos").alias("reject_pos"), F.col("rollout_idx").alias("reject_idx"))
    # rollouts may come from a stored table, whose compressed size would have them broadcast
    return picks.join(accepted.hint("merge"), [QUESTION, "accept_pos"]).join(rejected.hint("merge"), [QUESTION, "reject_pos"]).select(QUESTION, "pair", "accept_idx", "reject_idx")


def pair_statistics(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """How many unordered pairs a group has and how many agree in `value`, from counts alone."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    agreeing = F.sum(F.when(F.col(value).isNotNull(), F.col("n") * (F.col("n") - 1) / 2).otherwise(0.0))
    return counts.groupBy(*group).agg((n * (n - 1) / 2).cast("bigint").alias("pairs"), agreeing.cast("bigint").alias("agreeing_pairs"))


def concordant_pairs(rows: DataFrame, group: Sequence[str], tie: str, gt: str, pred: str, hot: bool | None = None) -> DataFrame:
    """Per group: pairs, and pairs that both columns order the same way; ties count as wrong.

    Positions are taken so that a tie in either column reverses the other one.
    A concordant pair is then two rows in the same order in both positions, and
    each is counted at the one bit where their first positions part: n log n
    rows and running counts instead of n^2 pairs.
    """
    group = list(group)
    if hot is None:
        hot = has_hot_group(rows, group)
    ranked = rank_in_group(rows, group, [F.col(gt), F.col(pred).desc(), F.col(tie)], "__p", hot)
    ranked = rank_in_group(ranked, group, [F.col(pred), F.col(gt).desc(), F.col(tie).desc()], "__q", hot)
    sized = with_group_stats(ranked.select(*group, "__p", "__q"), group, {"__n": F.count(F.lit(1))}, hot)
    bits = F.length(F.bin(F.col("__n") - 1)) - 1
    exploded = sized.select(*group, "__p", "__q", F.explode(F.sequence(F.lit(0), bits)).alias("__bit"))
    split = exploded.select(*group, "__bit", "__q", F.expr("shiftright(__p, __bit + 1)").alias("__block"), F.expr("1 - (shiftright(__p, __bit) & 1)").alias("__low"))
    counted = running(split, [*group, "__bit", "__block"], "__q", {"__before": ("sum", "__low")}, hot=hot)
    hits = counted.groupBy(*group).agg(F.sum(F.when(F.col("__low") == 0, F.col("__before")).otherwise(0)).alias("concordant"))
    pairs = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).select(*group, F.expr("__n * (__n - 1) div 2").alias("pairs"))
    return pairs.where("pairs > 0").join(hits, group)


def action_ranking_accuracy(state_actions: DataFrame) -> DataFrame:
    totals = concordant_pairs(state_actions, ["state_id"], "action", "gt_value", "pred_value")
    return totals.agg((F.sum("concordant") / F.sum("pairs")).alias("ranking_accuracy"), F.sum("pairs").alias("comparisons"))


def token_budget_pack(items: DataFrame, group: Sequence[str], pos: str, cost: str, budget: int) -> DataFrame:
    """Greedy in order: an item is taken if it still fits, else skipped.

    The room left only shrinks, so of the items with one cost exactly a prefix
    is taken, of at most budget / cost items. What the fold sees of a group is
    bounded by the budget; free items are always taken and never collected.
    """
    group = list(group)
    free = items.where(F.col(cost) == 0)
    priced = items.where((F.col(cost) > 0) & (F.col(cost) <= budget))
    nth = F.row_number().over(Window.partitionBy(*group, cost).orderBy(pos))
    candidates = priced.withColumn("__nth", nth).where(F.col("__nth") <= budget).where(F.col("__nth") * F.col(cost) <= budget)
    listed = candidates.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(cost).cast("bigint").alias("c")))).alias("__items"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<p:bigint,c:bigint>>").alias("kept"))

    def take(state: Column, item: Column) -> Column:
        fits = state["used"] + item["c"] <= budget
        return F.struct(
            (state["used"] + F.when(fits, item["c"]).otherwise(0)).alias("used"),
            F.when(fits, F.concat(state["kept"], F.array(F.struct(item["p"].alias("p"), item["c"].alias("c"))))).otherwise(state["kept"]).alias("kept"))

    packed = listed.select(*group, F.inline(F.aggregate("__items", start, take)["kept"]))
    taken = packed.select(*group, F.col("p").alias(pos), F.col("c").alias(cost))
    return taken.unionByName(free.select(*group, F.col(pos).cast("bigint").alias(pos), F.col(cost).cast("bigint").alias(cost)))


def _bleu(predictions: list[list[str]], reference: list[str]) -> float:
    """Corpus BLEU of several predictions against one reference each time."""
    logs, ref_len, pred_len = 0.0, len(reference) * len(predictions), sum(map(len, predictions))
    for n in range(1, MAX_N + 1):
        want = _counts(reference, n)
        hit = sum(min(c, want.get(g, 0)) for p in predictions for g, c in _counts(p, n).items())
        possible = sum(max(len(p) - n + 1, 0) for p in predictions)
        if not hit or not possible:
            return 0.0
        logs += math.log(hit / possible)
    return math.exp(logs / MAX_N) * (1.0 if pred_len > ref_len else math.exp(1 - ref_len / pred_len))


def _counts(words: list[str], n: int) -> dict:
    out: dict = {}
    for at in range(len(words) - n + 1):
        gram = tuple(words[at : at + n])
        out[gram] = out.get(gram, 0) + 1
    return out


def bleu_rejection_select(candidates: DataFrame, group: str, idx: str, text: str, k: int, threshold: float, final: Column) -> DataFrame:
    """Greedy diverse selection of k texts per group, in order.

    The first is accepted; another one if its BLEU to the accepted is at most
    the threshold, or if it is from the final round of attempts. Each of the
    k - 1 rounds scores all later candidates in parallel against the few
    accepted texts and keeps the first that passes, so no group is collected.
    """
    find = re.compile(WORDS)

    @F.pandas_udf("double")
    def similarity(accepted: pd.Series, this: pd.Series) -> pd.Series:
        return pd.Series([_bleu([find.findall(a) for a in acc], find.findall(t)) for acc, t in zip(accepted, this)])

    rows = candidates.select(group, F.col(idx).cast("bigint").alias(idx), text, F.coalesce(final, F.lit(False)).alias("__final"))
    firsts = rows.groupBy(group).agg(F.min_by(F.struct(idx, text), idx).alias("f"))
    state = firsts.select(group, F.array("f").alias("kept"))
    for _ in range(k - 1):
        later = rows.join(state, group).where(F.col(idx) > F.element_at("kept", -1)[idx])
        texts = F.transform("kept", lambda x: x[text])
        scored = later.withColumn("__bleu", F.when(F.col("__final"), 0.0).otherwise(similarity(texts, F.col(text))))
        chosen = scored.where(F.col("__final") | (F.col("__bleu") <= threshold)).groupBy(group).agg(F.min_by(F.struct(idx, text), idx).alias("next"))
        grown = F.when(F.col("next").isNotNull(), F.concat("kept", F.array("next"))).otherwise(F.col("kept"))
        state = reliable_checkpoint(state.join(chosen, group, "left").select(group, grown.alias("kept")))
    return state.select(group, F.inline("kept"))


def distinct_actions(rows: DataFrame, state: str = "state_id", action: str = "action") -> DataFrame:
    """Sorted distinct actions of each state with their position."""
    return rank_in_group(rows.select(state, action).distinct(), [state], [F.col(action)], "action_idx")


def min_actions_filter(rows: DataFrame, minimum: int, state: str = "state_id", action: str = "action") -> DataFrame:
    """Rows of states with at least `minimum` distinct actions, and never fewer than two."""
    enough = rows.groupBy(state).agg(F.count_distinct(action).alias("__n")).where(F.col("__n") >= max(minimum, 2)).select(state)
    return rows.join(enough, state, "left_semi")
