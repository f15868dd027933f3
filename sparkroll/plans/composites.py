"""End-to-end flows: each is a composition of operators, one plan for Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroll.functions import text
from sparkroll.functions.arrays import let
from sparkroll.functions.grading import grade_exact, reward
from sparkroll.operators import credit, evaluation, logprobs, pairs, sampling
from sparkroll.plugins import model_score_batch
from sparkroll.session import reliable_checkpoint, reliable_table

Evaluator = Callable[[Column, Column], Column]


def graded_rollouts(rollouts: DataFrame, penalty: float, evaluator: Evaluator | None = None) -> DataFrame:
    """Rollouts with reward and unfinished flag; an injected evaluator replaces the exact grade."""
    scored = reward(F.col("answer"), F.col("gold"), F.col("finish_reason"), penalty)
    df = rollouts.withColumn("__r", scored).withColumns({"reward": F.col("__r.reward"), "is_unfinished": F.col("__r.is_unfinished")}).drop("__r")
    if evaluator is None:
        return df
    return df.withColumn("reward", F.when(F.col("is_unfinished"), float(penalty)).otherwise(evaluator(F.col("answer"), F.col("gold"))))


def ppo_episodes(rollouts: DataFrame, query: Column, response: Column, max_len: int, penalty: float) -> DataFrame:
    """Reward, tokenise together, truncate, drop empty responses."""
    df = graded_rollouts(rollouts, penalty).withColumns({"query_text": query, "response_text": response})
    counted = let(text.tokens(F.concat("query_text", "response_text")), lambda toks: F.struct(
        text.tokens_before(toks, F.length("query_text")).alias("n_query"), toks.alias("__toks")))
    # a generated row is computed once, where a filter on an expression would repeat it; ids are made of what is left
    df = df.select("*", F.inline(F.array(counted)))
    size, room = F.size("__toks"), F.least(F.size("__toks"), F.lit(max_len)) - F.col("n_query")
    df = df.withColumn("n_response", F.greatest(room, F.lit(0))).where("n_response > 0")
    ids = text.token_ids(F.slice("__toks", F.col("n_query") + 1, F.col("n_response")))
    df = df.withColumns({
        "reward": F.when(size > max_len, float(penalty)).otherwise(F.col("reward")), "is_unfinished": F.col("is_unfinished") | (size > max_len)})
    return df.withColumn("response_token_ids", F.when(F.col("is_unfinished"), ids).otherwise(F.concat(ids, F.array(F.lit(text.EOS_ID))))).drop("__toks")


def restem_episodes(episodes: DataFrame, threshold: float, per_question: int) -> DataFrame:
    """Episodes with enough reward, the first N of each question."""
    return sampling.first_n_per_group(episodes.where(F.col("reward") >= threshold), ["question_id"], ["rollout_idx"], per_question)


def dpo_episodes(episodes: DataFrame, threshold: float, max_pairs: int, seed: int) -> DataFrame:
    """Preference pairs with the texts of both sides; empty responses went before pairing.

    The episode table is read for the ranks and for both sides, so it is stored once.
    """
    episodes = reliable_table(episodes.select("question_id", "rollout_idx", "reward", "query_text", "response_text"))
    chosen = pairs.dpo_pairs(episodes.select("question_id", "rollout_idx", "reward"), threshold, max_pairs, seed)
    sides = episodes.select("question_id", "rollout_idx", "query_text", "response_text")
    accept = sides.select("question_id", F.col("rollout_idx").alias("accept_idx"), "query_text", F.col("response_text").alias("accept_text"))
    reject = sides.select("question_id", F.col("rollout_idx").alias("reject_idx"), F.col("response_text").alias("reject_text"))
    return chosen.join(accept.hint("merge"), ["question_id", "accept_idx"]).join(reject.hint("merge"), ["question_id", "reject_idx"])


def vine_advantages(steps: DataFrame, state_text: Column, uid: Column, rollouts: DataFrame, penalty: float) -> DataFrame:
    """Step advantages from Monte-Carlo values of the distinct prefix states.

    `rollouts` answer the unique requests by their uid as question_id.
    """
    requests = sampling.dedupe_requests(steps.withColumns({"state": state_text, "uid": uid}), "state", "uid")
    unique = requests.where("is_unique").select(F.col("uid").alias("question_id"))
    values = evaluation.mc_value(unique, rollouts, penalty).select(F.col("question_id").alias("unique_uid"), F.col("value").alias("mc"))
    valued = requests.join(values, "unique_uid").withColumn("value_est", F.col("mc"))
    return credit.mc_step_advantage(credit.fill_missing_values_tail(valued))


def ppo_batches(tokens: DataFrame, beta: float, gamma: float, lam: float) -> DataFrame:
    """Token rewards, generalised advantages over the action tokens, whitening over all of them."""
    rewarded = logprobs.token_rewards(tokens, beta).withColumn("pos", F.col("t") - 1)
    estimated = credit.gae(rewarded, ["episode_id"], "pos", "value", "reward", gamma, lam)
    # the statistics and the rows both read it: stored once instead of computed twice
    return credit.whiten(reliable_checkpoint(estimated), "gae_advantage", "whitened")


def action_ranking(returns: DataFrame, minimum_actions: int, sample: int, seed: int) -> DataFrame:
    """Ranking accuracy of values from a few sampled returns against values from all returns."""
    states = pairs.min_actions_filter(returns, minimum_actions)
    gt = states.groupBy("state_id", "action").agg(F.avg("ret").alias("gt_value"))
    few = sampling.sample_per_group(states, ["state_id", "action"], ["k"], seed, sample)
    pred = few.groupBy("state_id", "action").agg(F.avg("ret").alias("pred_value"))
    return pairs.action_ranking_accuracy(gt.join(pred, ["state_id", "action"]))


def reward_fn_episodes(path_rows: DataFrame, load_model) -> DataFrame:
    """Paths as query and response, then one batched scoring stage."""
    chain = F.col("chain")
    query = F.concat(F.lit("Tree "), F.col("tree_id").cast("string"), F.lit(":"))
    response = F.array_join(F.transform(F.slice(chain, F.lit(2), F.size(chain)), lambda n: F.concat(F.lit(" then "), n["node_id"])), "")
    return model_score_batch(path_rows.select("tree_id", F.col("node_id").alias("leaf_id"), query.alias("query_text"), response.alias("response_text")), "query_text", "response_text", load_model)


def evaluated(rollouts: DataFrame, evaluator: Evaluator = grade_exact) -> DataFrame:
    """Task performance with the evaluator passed in."""
    return evaluation.eval_task_performance(rollouts, evaluator(F.col("answer"), F.col("gold")))
