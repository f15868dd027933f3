"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sparkroll import catalog  # noqa: E402
from sparkroll.session import local_session  # noqa: E402

HEADLINE = [
    "eval_task_performance", "majority_vote", "reward_function", "mc_value", "ci_stopping_point", "mc_rollout_metrics", "pairwise_bleu",
    "shuffle_take", "leftover_cache", "shard_contiguous", "sample_without_replacement", "first_n_per_question", "dedupe_requests",
    "mc_step_advantage", "gae", "token_step_range_join", "mc_token_advantage",
    "reward_distribution", "episode_kl_stats", "ppo_clip_diagnostics", "dpo_positive_diagnostics", "batch_step_metrics", "whiten",
    "tree_score", "tree_advantage", "tree_paths", "path_top_k_percent", "path_strategy", "tree_bleu",
    "dpo_pairs", "action_ranking_accuracy", "attach_source_row", "few_shot_sample",
    "tokenize_split", "split_steps_delimiter", "prefix_states", "grade_normalized", "forecast_unroll",
    "pad_batches", "load_split", "server_log_stats",
    "ppo_episodes", "dpo_episodes", "vine_advantages", "ppo_batches", "stream_episode_metrics",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"), app="sparkroll-bench")
    queries = catalog.queries()
    # one untimed query starts the JVM's Python workers and code generation
    queries["unfinished_rate"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[key](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - start, 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
