"""Few-shot prompts: seeded examples per question, retried until the prompt fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroll.functions.text import tokens
from sparkroll.operators.sampling import permuted_picks
from sparkroll.skew import rank_by_id

ATTEMPTS = 10


def length_filter(examples: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """Keep examples under every limit; a limit of None does not apply."""
    for column, limit in limits.items():
        if limit is not None:
            examples = examples.where(F.col(column) <= limit)
    return examples


def _pool_bounds(pool: DataFrame, example: str, k: int) -> tuple[int, int | None]:
    """Rows of the pool, and its longest example; None where one question could lose all its k + 1 picks to copies of itself and nulls."""
    texts = pool.groupBy(F.sha2(example, 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length(example)).alias("len"))
    copies, nulls = F.max(F.when(F.col("sha").isNotNull(), F.col("n"))), F.sum(F.when(F.col("sha").isNull(), F.col("n")))
    size, longest, copies, nulls = texts.agg(F.sum("n"), F.max("len"), copies, nulls).first()
    lost = (copies or 0) + (nulls or 0)
    return size or 0, longest if lost < min(size or 0, k + 1) else None


def attempts_to_make(question_chars: Column, most_added: int | None, max_chars: int) -> Column:
    """Numbers of the attempts that can be chosen: the last where the question alone is too long, the first where all that can be added fits, else all."""
    first = F.when(question_chars > max_chars, ATTEMPTS - 1).otherwise(0)
    end = F.lit(ATTEMPTS - 1) if most_added is None else F.when(question_chars + most_added <= max_chars, 0).otherwise(ATTEMPTS - 1)
    return F.sequence(first, end)


def few_shot_sample(questions: DataFrame, qid: str, question: str, pool: DataFrame, pid: str, example: str, k: int, seed: int, max_chars: int, delimiter: str, max_tokens: int | None = None) -> DataFrame:
    """k pool examples before each question.

    Picks are pool positions, so the pool is met by equi-joins and never paired
    with every question. Attempts are compared by lengths alone; texts are
    fetched for the chosen attempt only. Attempts that lengths rule out are not made.
    """
    size, longest = _pool_bounds(pool, example, k)
    placed = rank_by_id(pool.select(F.col(pid), F.col(example).alias("__ex")), pid, "__pos").select("__pos", "__ex", F.length("__ex").alias("__len"), F.sha2("__ex", 256).alias("__sha"))
    asked = questions.select(qid, F.length(question).alias("__qlen"), F.sha2(question, 256).alias("__qsha"))
    tries = asked.withColumn("attempt", F.explode(attempts_to_make(F.col("__qlen"), None if longest is None else k * (longest + len(delimiter)), max_chars))).withColumn("__seed", F.col("attempt") + seed)
    # an empty pool gives a position of null, which meets nothing; a plain explode would pick a second time to ask for that
    picks = tries.select("*", F.posexplode_outer(permuted_picks(F.lit(size).cast("bigint"), k + 1, F.col("__seed"), qid)).alias("__j", "__pos"))
    met = picks.join(placed.select("__pos", "__len", "__sha"), "__pos").where(F.col("__sha") != F.col("__qsha"))
    # at most k + 1 examples per question and attempt: drop the one beyond k, or the question itself
    used = met.groupBy(qid, "attempt", "__qlen").agg(F.array_sort(F.collect_list(F.struct("__j", "__pos", "__len"))).alias("ex")).withColumn("ex", F.slice("ex", 1, k))
    length = F.aggregate("ex", F.col("__qlen"), lambda acc, e: acc + e["__len"] + len(delimiter))
    fits = F.when(length <= max_chars, F.struct(F.col("attempt"), F.col("ex")))
    final = F.when(F.col("attempt") == ATTEMPTS - 1, F.struct(F.col("attempt"), F.col("ex")))
    chosen = used.groupBy(qid).agg(F.coalesce(F.min_by(fits, F.when(fits.isNotNull(), F.col("attempt"))), F.max(final)).alias("c"))
    lines = chosen.select(qid, F.col("c.attempt").alias("attempt"), F.explode("c.ex").alias("e")).select(qid, "attempt", F.col("e.__j").alias("__j"), F.col("e.__pos").alias("__pos"))
    texts = lines.join(placed.select("__pos", "__ex"), "__pos").groupBy(qid, "attempt").agg(F.array_sort(F.collect_list(F.struct("__j", "__ex"))).alias("ex"))
    context = F.array_join(F.transform("ex", lambda e: e["__ex"]), delimiter)
    prompts = questions.select(qid, question).join(texts, qid).select(qid, "attempt", F.concat(context, F.lit(delimiter), F.col(question)).alias("prompt"))
    return prompts if max_tokens is None else prompts.withColumn("prompt", keep_last_tokens(F.col("prompt"), max_tokens))


def keep_last_tokens(text: Column, n: int) -> Column:
    """The text without the tokens that are too many on the left."""
    toks = tokens(text)
    return F.array_join(F.when(F.size(toks) > n, F.slice(toks, -n, n)).otherwise(toks), "")


def fixed_prefix(question: Column, prefix: str, max_tokens: int) -> Column:
    return keep_last_tokens(F.concat(F.lit(prefix), question), max_tokens)
