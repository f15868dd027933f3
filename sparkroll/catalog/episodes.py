"""Episode-table queries."""

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll.catalog.base import big, query
from sparkroll.operators import episodes as ep

SEED, BATCH, MAX_LEN = 17, 16, 6
ID_SQL = "((episode_id * 3 + t * 7) % 97 + 1)"


def token_id():
    return ((F.col("episode_id") * 3 + F.col("t") * 7) % 97 + 1).cast("int")


def text_of(column, scale=None):
    value = (lambda x: F.round(x * scale).cast("bigint").cast("string")) if scale else (lambda x: x.cast("string"))
    return F.array_join(F.transform(column, lambda x: value(x)), " ")


SIZED = """with n as (select episode_id, count(*) as len, count(*) filter (where is_action) as rl, row_number() over (order by episode_id) - 1 as pos0 from f7 group by episode_id),
b as (select episode_id, len, rl, pos0, pos0 // 16 as batch, max(len) over (partition by pos0 // 16) as max_len from n),
k as (select f7.*, b.batch, b.max_len, b.len, b.rl from f7 join b using (episode_id))
"""


@query("filter_long_episodes", "f7", "select episode_id, count(*) as len, count(*) filter (where is_action) as response_len, count(*) <= 6 as kept from f7 group by episode_id")
def _(spark, sf):
    return ep.filter_long_episodes(fx.f7(spark, sf), MAX_LEN)


@query("validate_episodes", "f7", """select episode_id, bool_or(not is_action) as has_query, bool_or(is_action) as has_response, count(*) filter (where is_action and advantage > -0.05) = count(*) filter (where is_action) as advantages_match,
  arg_max(case when episode_id % 2 = 0 then score else value end, t) as reward, bool_or(not is_action) and bool_or(is_action) and count(*) filter (where is_action and advantage > -0.05) = count(*) filter (where is_action) as valid from f7 group by episode_id""")
def _(spark, sf):
    rows = fx.f7(spark, sf).withColumn("advantage", F.when(F.col("advantage") > -0.05, F.col("advantage")))
    return ep.validate(rows, F.when(F.col("episode_id") % 2 == 0, F.col("score")), F.col("value"))


def padded(expr, filler, n="max_len"):
    return f"array_to_string(list_concat(list({expr} order by t), list_transform(range({n} - len), lambda x: {filler})), ' ')"


@query("pad_batches", "f7", SIZED + f"""select episode_id, any_value(batch) as batch, any_value(max_len) as max_len,
 {padded(ID_SQL, '0', 'any_value(max_len)').replace('- len', '- any_value(len)')} as input_ids,
 {padded('case when is_action then ' + ID_SQL + ' else -100 end', '-100', 'any_value(max_len)').replace('- len', '- any_value(len)')} as labels,
 {padded('1', '0', 'any_value(max_len)').replace('- len', '- any_value(len)')} as attention_mask,
 {padded('case when is_action then round(advantage * 100)::bigint else 0 end', '0', 'any_value(max_len)').replace('- len', '- any_value(len)')} as advantages,
 array_to_string(list_concat(coalesce(list(round(actor_lp * 100)::bigint order by t) filter (where t > 0), []), list_transform(range(any_value(max_len) - any_value(len)), lambda x: -100000000000)), ' ') as shifted_logprobs,
 {padded('round(value * 100)::bigint', '-100000000000', 'any_value(max_len)').replace('- len', '- any_value(len)')} as values
from k group by episode_id""")
def _(spark, sf):
    df = ep.pad_batches(fx.f7(spark, sf), token_id(), BATCH)
    return df.select("episode_id", "batch", big("max_len").alias("max_len"), text_of("input_ids").alias("input_ids"), text_of("labels").alias("labels"), text_of("attention_mask").alias("attention_mask"),
                     text_of("advantages", 100).alias("advantages"), text_of("shifted_logprobs", 100).alias("shifted_logprobs"), text_of("values", 100).alias("values"))


PAIRED = f"""with e as (select episode_id, list({ID_SQL} order by t) as ids, list(case when is_action then {ID_SQL} else -100 end order by t) as labels, count(*) as len from f7 group by episode_id),
p as (select a.episode_id // 2 as pair_id, a.ids as aids, a.labels as al, r.ids as rids, r.labels as rl, row_number() over (order by a.episode_id) - 1 as pos from e a join e r on a.episode_id // 2 = r.episode_id // 2 and a.episode_id % 2 = 0 and r.episode_id % 2 = 1),
q as (select *, pos // 16 as batch, max(greatest(len(aids), len(rids))) over (partition by pos // 16) as max_len, count(*) over (partition by pos // 16) as n from p)
"""


def filled(ids, filler):
    return f"array_to_string(list_concat({ids}, list_transform(range(max_len - len({ids})), lambda x: {filler})), ' ')"


@query("pad_pair_batches", "f7", PAIRED + f"""select pair_id, batch, max_len, {filled('aids', 0)} as accept_input_ids, {filled('al', -100)} as accept_labels, {filled('rids', 0)} as reject_input_ids, {filled('rl', -100)} as reject_labels,
 {filled('list_transform(aids, lambda x: 1)', 0)} as accept_attention_mask, {filled('list_transform(rids, lambda x: 1)', 0)} as reject_attention_mask from q""")
def _(spark, sf):
    df = ep.pad_pair_batches(fx.f7(spark, sf), token_id(), BATCH)
    names = [f"{s}_{c}" for s in ("accept", "reject") for c in ("input_ids", "labels", "attention_mask")]
    return df.select("pair_id", "batch", big("max_len").alias("max_len"), *[text_of(c).alias(c) for c in names])


@query("pad_stacked_pairs", "f7", PAIRED + f"""select pair_id, batch, side, side * n + pos % 16 as row, {filled('case when side = 0 then aids else rids end', 0)} as input_ids, max_len * -100 as label_sum
from q, (select unnest([0, 1])::bigint as side)""")
def _(spark, sf):
    df = ep.pad_stacked_pairs(fx.f7(spark, sf), token_id(), BATCH)
    total = F.aggregate("labels", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.select("pair_id", "batch", big("side").alias("side"), big("row").alias("row"), text_of("input_ids").alias("input_ids"), total.alias("label_sum"))


@query("sample_episodes_report", "f7", f"""with n as (select episode_id, count(*) as len from f7 group by episode_id),
s as (select * from n order by md5(concat('{SEED}|', episode_id::varchar)), episode_id limit 128)
select episode_id, any_value(len) as instance_length, string_agg({ID_SQL}::varchar, ' ' order by t) as tokens, string_agg(round(advantage * 100)::bigint::varchar, ' ' order by t) as advantages from f7 join s using (episode_id) group by episode_id""")
def _(spark, sf):
    return ep.sample_report(fx.f7(spark, sf), SEED, 128, {"tokens": token_id(), "advantages": F.round(F.col("advantage") * 100).cast("bigint")})
