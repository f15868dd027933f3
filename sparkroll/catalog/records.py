"""Source, sink, filter and run-record queries."""

from functools import reduce

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll.catalog.base import big, query, r4
from sparkroll.session import shared_folder
from sparkroll.sources import committed, readers

SEED = 17


@query("load_split", "f1", "select question_id, gold, row_number() over (order by question_id) - 1 as row_id from f1 where split = 'train'")
def _(spark, sf):
    return readers.load_split(fx.f1(spark, sf), "train", "question_id").select("question_id", "gold", "row_id")


@query("rename_fields", "f1", "select question_id as qid, gold as answer, split from f1")
def _(spark, sf):
    return readers.rename_fields(fx.f1(spark, sf), {"question_id": "qid", "gold": "answer"}, remove_mapped=True)


@query("load_offline_results", "", "select l_orderkey as question_id, l_returnflag as answer, l_quantity::bigint as num_tokens from lineitem")
def _(spark, sf):
    columns = {"question_id": F.col("l_orderkey"), "answer": F.col("l_returnflag"), "num_tokens": big("l_quantity")}
    return readers.load_results(spark, f"{sf}/lineitem.parquet", columns)


@query("read_columnar_json", "f6", """select conv_id, turn, p as pos, case when p = 0 then query_text else response_text end as query, case when p = 0 then response_text else query_text end as response, (turn + p)::double as reward
from f6, (select unnest(range(2)) as p)""")
def _(spark, sf):
    doc = F.to_json(F.struct(F.array("query_text", "response_text", "query_text").alias("query"), F.array("response_text", "query_text", "query_text").alias("response"),
                             F.array(F.col("turn").cast("double"), F.col("turn") + 1.0, F.lit(9.0)).alias("reward")))
    rows = fx.f6(spark, sf).select("conv_id", "turn", doc.alias("doc"))
    return readers.explode_columnar(rows, "doc", {"query": "string", "response": "string", "reward": "double"}, first=2)


@query("synth_episodes")
def _(spark, sf):
    return readers.synth_episodes(fx.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", SEED, include_advantages=True)


@query("read_jsonl_results", "f10", "select iteration, step, name, accuracy from f10")
def _(spark, sf):
    """Results are stored as JSON lines and read back from the files."""
    results = fx.f10(spark, sf).select("iteration", "step", "name", "accuracy")
    return committed.write_missing(results, shared_folder(spark, "results"), kind="jsonl").drop("reused")


@query("parse_jsonl_column", "f10", "select iteration, step, name, accuracy from f10")
def _(spark, sf):
    lines = fx.f10(spark, sf).select(F.to_json(F.struct("iteration", "step", "name", "accuracy")).alias("line"))
    return readers.parse_jsonl(lines, "line", "iteration bigint, step bigint, name string, accuracy double")


def json_runs(spark, sf):
    """Runs as JSON texts: odd steps have a list of seeds and a schedule, even steps a plain seed and a note."""
    i, s, odd = F.col("iteration"), F.col("step"), F.col("step") % 2 == 1
    config = F.when(odd, F.to_json(F.struct(F.struct(i.alias("iteration"), F.struct(s.alias("step"), F.lit("cosine").alias("decay")).alias("opt")).alias("trainer"), F.array(i + s, i - s).alias("seeds"))))
    config = config.otherwise(F.to_json(F.struct(F.struct(i.alias("iteration")).alias("trainer"), s.alias("seed"), F.concat(F.lit("it's "), s.cast("string")).alias("note"))))
    summary = F.to_json(F.struct(F.struct(r4("accuracy").alias("accuracy"), F.when(odd, s > 6).alias("late")).alias("eval"), F.when(s % 3 == 0, s * 2).alias("steps")))
    return fx.f10(spark, sf).select("name", config.alias("config"), summary.alias("summary"))


@query("flatten_run_records_mixed", "f10", """select name, iteration as "cfg__trainer.iteration", case when step % 2 = 1 then step end as "cfg__trainer.opt.step", case when step % 2 = 1 then 'cosine' end as "cfg__trainer.opt.decay",
case when step % 2 = 1 then iteration + step end as "cfg__seeds.0", case when step % 2 = 1 then iteration - step end as "cfg__seeds.1", case when step % 2 = 0 then step end as "cfg__seed", case when step % 2 = 0 then 'it''s ' || step end as "cfg__note",
round(accuracy, 4) as "sum__eval#accuracy", case when step % 2 = 1 then step > 6 end as "sum__eval#late", case when step % 3 = 0 then step * 2 end as "sum__steps" from f10""")
def _(spark, sf):
    return readers.flatten_json_records(json_runs(spark, sf), "config", "summary")


@query("run_record_leaves", "f10", """select name, key, value from f10, lateral (select unnest(['cfg__trainer.iteration', 'cfg__trainer.opt.step', 'cfg__trainer.opt.decay', 'cfg__seeds.0', 'cfg__seeds.1', 'cfg__seed', 'cfg__note']) as key,
 unnest([iteration::varchar, case when step % 2 = 1 then step::varchar end, case when step % 2 = 1 then 'cosine' end, case when step % 2 = 1 then (iteration + step)::varchar end, case when step % 2 = 1 then (iteration - step)::varchar end,
 case when step % 2 = 0 then step::varchar end, case when step % 2 = 0 then 'it''s ' || step end]) as value) where value is not null""")
def _(spark, sf):
    """The same runs as (key, value) rows: no column for a key that a run lacks."""
    leaves = readers.json_leaves(json_runs(spark, sf).drop("summary"), {"config": ("cfg__", ".")})
    return leaves.select("name", "key", F.col("leaf").cast("string").alias("value"))


@query("flatten_metrics", "f10", """select name, k as key, case k when 'eval/acc' then case when step % 3 = 0 then 'None' else step::varchar end when 'eval/deep/it' then iteration::varchar else (iteration * step)::varchar end as value
from f10, (select unnest(['eval/acc', 'eval/deep/it', 'total']) as k)""")
def _(spark, sf):
    metrics = F.struct(F.struct(F.when(F.col("step") % 3 != 0, F.col("step")).alias("acc"), F.struct(F.col("iteration").alias("it")).alias("deep")).alias("eval"), (F.col("iteration") * F.col("step")).alias("total"))
    return readers.flatten_metrics(fx.f10(spark, sf).select("name", metrics.alias("m")), "m", ["name"])


@query("merge_shards", "f1", "select question_id, case when split = 'train' then 0 else 1 end::bigint as shard from f1")
def _(spark, sf):
    questions = fx.f1(spark, sf)
    return readers.merge_shards({1: questions.where("split = 'test'").select("question_id"), 0: questions.where("split = 'train'").select("question_id")})


@query("write_iteration_once", "f10", """with s as (select iteration, name, 1.0::double as accuracy, true as reused from f10 where iteration <= 1995)
select * from s union all select iteration, name, round(accuracy, 4), false from f10 where iteration > 1995""")
def _(spark, sf):
    """Early iterations are stored first; the second write keeps them and adds the others. The rows are read back."""
    folder = shared_folder(spark, "iterations")
    scores = fx.f10(spark, sf).select("iteration", "name", r4("accuracy").alias("accuracy"))
    committed.write_missing(scores.where("iteration <= 1995").withColumn("accuracy", F.lit(1.0)), folder)
    return committed.write_missing(scores, folder)


@query("resume_pending", "f1 f2", "select question_id, gold, split from f1 where question_id not in (select l_orderkey from lineitem)")
def _(spark, sf):
    done = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"))
    return readers.resume_pending(fx.f1(spark, sf), done, "question_id")


LOG = """select coalesce(avg(nullif(regexp_extract(line, 'Avg generation throughput: ([0-9.]+) tokens/s', 1), '')::double), 0) as avg_generation_throughput, coalesce(avg(nullif(regexp_extract(line, 'Running: (\\d+) reqs', 1), '')::double), 0) as avg_running_reqs,
 coalesce(avg(nullif(regexp_extract(line, 'Pending: (\\d+) reqs', 1), '')::double), 0) as avg_pending_reqs, coalesce(avg(nullif(regexp_extract(line, 'GPU KV cache usage: ([0-9.]+)%', 1), '')::double), 0) as avg_gpu_kv_cache,
 coalesce(avg(nullif(regexp_extract(line, 'CPU KV cache usage: ([0-9.]+)%', 1), '')::double), 0) as avg_cpu_kv_cache from f11"""
COUNTERS = ["generation_throughput", "running_reqs", "pending_reqs", "gpu_kv_cache", "cpu_kv_cache"]


@query("server_log_stats", "f11", f"with s as ({LOG}) select " + ", ".join(f"round(avg_{c}, 4) as avg_{c}" for c in COUNTERS) + " from s")
def _(spark, sf):
    stats = readers.server_log_stats(fx.f11(spark, sf))
    return stats.select(*[r4(c).alias(c) for c in stats.columns])


@query("total_throughput", "f11", f"with s as ({LOG}) select " + ", ".join(f"round(avg_{c}, 2) as avg_{c}" for c in COUNTERS) + ", round(avg_generation_throughput * 4, 2) as total_generation_throughput from s")
def _(spark, sf):
    return readers.total_throughput(readers.server_log_stats(fx.f11(spark, sf)), processes=4)


@query("filter_invalid_value", "f3", "select traj_id, step_idx from f3 where coalesce(value_est, -100) = -100")
def _(spark, sf):
    rows = fx.f3(spark, sf).withColumn("gt_value", F.coalesce("value_est", F.lit(-100.0)))
    return rows.where(F.col("gt_value") == -100.0).select("traj_id", "step_idx")


def equals_all(key_values):
    """Conjunction of column = value; an empty mapping keeps everything."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in key_values.items()], F.lit(True))


@query("filter_by_key_values", "f10", "select name, step from f10 where iteration = 1995 and step = 3")
def _(spark, sf):
    return fx.f10(spark, sf).where(equals_all({"iteration": 1995, "step": 3})).where(equals_all({})).select("name", "step")


def non_last_steps(rows):
    """By the flag if the table has it, else by the sentinel of a missing value."""
    return rows.where(~F.col("is_last_step")) if "is_last_step" in rows.columns else rows.where(F.col("gt_value") == -100)


@query("filter_non_last_steps", "f3", "select traj_id, step_idx, 'flag' as form from f3 where step_idx < num_steps - 1 union all select traj_id, step_idx, 'value' from f3 where value_est is null")
def _(spark, sf):
    steps = fx.f3(spark, sf)
    by_flag = non_last_steps(steps.withColumn("is_last_step", F.col("step_idx") == F.col("num_steps") - 1))
    by_value = non_last_steps(steps.withColumn("gt_value", F.coalesce("value_est", F.lit(-100.0))))
    return by_flag.select("traj_id", "step_idx", F.lit("flag").alias("form")).unionByName(by_value.select("traj_id", "step_idx", F.lit("value").alias("form")))


@query("group_mean_std", "f10", "select iteration, round(avg(accuracy), 4) as mean, round(stddev_samp(accuracy), 4) as std from f10 group by iteration")
def _(spark, sf):
    return fx.f10(spark, sf).groupBy("iteration").agg(r4(F.avg("accuracy")).alias("mean"), r4(F.stddev_samp("accuracy")).alias("std"))


@query("analyzer", "f10", "select 'eval/accuracy' as key, round(avg(accuracy), 4) as value from f10 union all select 'eval/best', round(max(accuracy), 4) from f10 union all select 'eval/steps', max(step)::double from f10")
def _(spark, sf):
    from sparkroll.plugins import analyze, merge_logs

    scores = fx.f10(spark, sf)
    first = analyze(scores, "eval", accuracy=F.lit(0.0), best=F.max("accuracy"))
    second = analyze(scores, "eval", accuracy=F.avg("accuracy"), steps=F.max("step"))
    return merge_logs([first, second]).select("key", r4("value").alias("value"))
