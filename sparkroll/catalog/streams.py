"""Streaming queries: the jobs run over the given tables until they are read through."""

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll.catalog.base import query, r4
from sparkroll.session import shared_folder
from sparkroll.streaming import jobs, state


def event_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    # a pattern is read both if the table is one file and if it is a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")


def scores_of(events):
    return events.select(F.lit("main").alias("run"), F.dayofmonth("ts").cast("bigint").alias("iteration"), F.col("value").alias("score"))


CUMULATIVE = """with i as (select iteration, count(*) as n, sum(score) as s, avg(score) as bm, stddev_samp(score) as bs from f13 group by iteration),
v as (select distinct iteration, var_pop(score) over (order by iteration) as vp from f13),
c as (select *, sum(n) over w as tn, sum(s) over w as ts from i join v using (iteration) window w as (order by iteration))
select iteration, tn::bigint as count, round(ts / tn, 4) as mean, round(vp, 4) as var, round(sqrt(vp * tn / (tn - 1)), 4) as std, round(bm, 4) as batch_mean, round(bs, 4) as batch_std from c"""


@query("running_moments", "f13", CUMULATIVE)
def _(spark, sf):
    scores = fx.f13(spark, sf).withColumn("run", F.lit("main"))
    df = jobs.running_moments(jobs.moments(scores, ["run", "iteration"], "score"), "run", "iteration")
    return df.select("iteration", "count", r4("mean").alias("mean"), r4("var").alias("var"), *[r4(c).alias(c) for c in ("std", "batch_mean", "batch_std")])


@query("stream_running_moments", "f13", CUMULATIVE)
def _(spark, sf):
    """The same state, fed by micro-batches."""
    folder = shared_folder(spark, "moments")
    jobs.accumulate_moments(scores_of(event_stream(spark, sf)), ["run", "iteration"], "score", f"{folder}/table", f"{folder}/progress").awaitTermination()
    df = jobs.running_moments(spark.read.parquet(f"{folder}/table"), "run", "iteration")
    return df.select("iteration", "count", r4("mean").alias("mean"), r4("var").alias("var"), *[r4(c).alias(c) for c in ("std", "batch_mean", "batch_std")])


KL = """with i as (select iteration, avg(score) / 50 as kl, count(*) as n_steps from f13 group by iteration),
m as (select *, ln(1 + least(greatest(kl / 0.9::double - 1, -0.2::double), 0.2::double) * n_steps / 5000.0::double) as l from i)
"""
BEFORE = "round(0.05::double * exp(coalesce(sum(l) over (order by iteration rows between unbounded preceding and 1 preceding), 0)), 6) as kl_coef"


@query("adaptive_kl_coef", "f13", KL + f"select iteration, n_steps, {BEFORE}, 0.05::double as fixed_coef from m")
def _(spark, sf):
    per_iteration = fx.f13(spark, sf).groupBy("iteration").agg((F.avg("score") / 50).alias("kl"), F.count(F.lit(1)).alias("n_steps")).withColumn("run", F.lit("main"))
    df = jobs.adaptive_kl_coef(per_iteration, "run", "iteration", initial=0.05, target=0.9, horizon=5000.0)
    fixed = jobs.fixed_kl_coef(df.withColumn("adaptive", F.round("kl_coef", 6)), 0.05)
    return fixed.select("iteration", "n_steps", F.col("adaptive").alias("kl_coef"), F.col("kl_coef").alias("fixed_coef"))


def folded(spark, iterations, fold):
    """The iterations arrive in three parts, the last one with a repeat; the job is started anew for each."""
    folder = shared_folder(spark, "runs")
    iterations.write.parquet(f"{folder}/all")
    stored = spark.read.parquet(f"{folder}/all")
    for part in ("iteration <= 10", "iteration between 11 and 20", "iteration > 18 or iteration is null"):
        stored.where(part).write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(stored.schema).parquet(f"{folder}/arrived")
        state.fold_runs(stream, "run", "iteration", fold, f"{folder}/table", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/table")


@query("stream_adaptive_kl_coef", "f13", KL + f"select iteration, n_steps, {BEFORE} from m")
def _(spark, sf):
    per_iteration = fx.f13(spark, sf).groupBy("iteration").agg((F.avg("score") / 50).alias("kl"), F.count(F.lit(1)).alias("n_steps")).withColumn("run", F.lit("main"))
    df = folded(spark, per_iteration, state.KlCoefficient(initial=0.05, target=0.9, horizon=5000.0))
    return df.select("iteration", "n_steps", F.round("kl_coef", 6).alias("kl_coef"))


@query("stream_state_moments", "f13", CUMULATIVE.replace(", round(bm, 4) as batch_mean, round(bs, 4) as batch_std", ""))
def _(spark, sf):
    scores = fx.f13(spark, sf).withColumn("run", F.lit("main"))
    df = folded(spark, jobs.moments(scores, ["run", "iteration"], "score"), state.RunningMoments())
    return df.select("iteration", "count", *[r4(c).alias(c) for c in ("mean", "var", "std")])


@query("stream_episode_metrics", "f13", "select iteration, count(*) as episodes, round(avg(score), 4) as score_mean, round(stddev_pop(score), 4) as score_std from f13 group by iteration")
def _(spark, sf):
    folder = shared_folder(spark, "metrics")
    jobs.accumulate_moments(scores_of(event_stream(spark, sf)), ["iteration"], "score", f"{folder}/table", f"{folder}/progress").awaitTermination()
    df = jobs.episode_metrics(spark.read.parquet(f"{folder}/table"), ["iteration"])
    return df.select("iteration", "episodes", r4("score_mean").alias("score_mean"), r4("score_std").alias("score_std"))


@query("stream_dedupe_requests", "", "select distinct event_type || ':' || cast(user_id % 40 as varchar) as txt from events")
def _(spark, sf):
    folder = shared_folder(spark, "requests")
    requests = event_stream(spark, sf).select(F.concat("event_type", F.lit(":"), (F.col("user_id") % 40).cast("string")).alias("txt"))
    jobs.dedupe_requests(requests, "txt", f"{folder}/table", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("txt")
