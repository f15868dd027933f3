"""Template, token, splitting, extraction, normalising and grading queries."""

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll import plugins
from sparkroll.catalog.base import big, feistel_sql, pick_sql, query, r4
from sparkroll.functions import extraction, grading, normalize, steps, text
from sparkroll.functions.arrays import let
from sparkroll.operators import fewshot, forecasting
from sparkroll.operators.trees import fish_bone_spine as spine_of

SEED = 17
TOKS = f"regexp_extract_all({{}}, '{text.TOKEN}')"


def toks_sql(x):
    return TOKS.format(x)


@query("render_template", "f6", """select conv_id, turn, md5(replace(replace(replace('Q: {query_text}' || chr(10) || 'A: {response_text} [{turn}]', '{query_text}', query_text), '{response_text}', response_text), '{turn}', turn::varchar)) as digest from f6""")
def _(spark, sf):
    cols = {c: F.col(c) for c in ["query_text", "response_text", "turn", "conv_id"]}
    return fx.f6(spark, sf).select("conv_id", "turn", F.md5(text.render_template("Q: {query_text}\nA: {response_text} [{turn}]", cols)).alias("digest"))


@query("render_prompt_strict", "f6", """select conv_id, turn, 'Question {1}: ' || query_text || chr(10) || 'Turn ' || turn::varchar as prompt from f6""")
def _(spark, sf):
    cols = {c: F.col(c) for c in ["query_text", "turn"]}
    prompt = text.render_prompt_strict("Question {{1}}: {query_text}\nTurn {turn}", cols, "query_text")
    return fx.f6(spark, sf).select("conv_id", "turn", prompt.alias("prompt"))


@query("split_query_response", "f6", "select conv_id, turn, response_text as response from f6")
def _(spark, sf):
    return fx.f6(spark, sf).select("conv_id", "turn", text.split_query_response(F.col("full_text"), F.col("query_text")).alias("response"))


SPLIT_SQL = f"""with u as (select conv_id, turn, query_text, length(query_text) as ql, {toks_sql('full_text')} as toks from f6),
p as (select conv_id, turn, ql, toks, unnest(range(len(toks))) as p from u),
s as (select conv_id, turn, count(*) filter (where coalesce(list_sum(list_transform(toks[1:p], lambda x: length(x))), 0) < ql) as n_query, max(len(toks)) as n, any_value(toks) as toks from p group by conv_id, turn)
"""


def split_tokens(df):
    return df.withColumn("toks", text.tokens(F.col("full_text"))).withColumn("n_query", text.tokens_before(F.col("toks"), F.length("query_text")))


@query("tokenize_split", "f6", SPLIT_SQL + "select conv_id, turn, n_query, n - n_query as n_response, toks[n_query] as last_query_token, toks[n_query + 1] as first_response_token from s")
def _(spark, sf):
    df = split_tokens(fx.f6(spark, sf))
    return df.select("conv_id", "turn", big("n_query").alias("n_query"), big(F.size("toks") - F.col("n_query")).alias("n_response"),
                     F.element_at("toks", F.col("n_query")).alias("last_query_token"), F.try_element_at("toks", F.col("n_query") + 1).alias("first_response_token"))


def episodes(df, unfinished):
    """Query and response token ids with BOS in front and EOS behind finished responses."""
    ids = text.token_ids(F.col("toks"))
    df = split_tokens(df).withColumn("ids", ids)
    query_ids = F.concat(F.array(F.lit(text.BOS_ID)), F.slice("ids", F.lit(1), F.col("n_query")))
    rest = F.slice("ids", F.col("n_query") + 1, F.size("ids") - F.col("n_query"))
    return df.withColumns({"query_token_ids": query_ids, "response_token_ids": F.when(unfinished, rest).otherwise(F.concat(rest, F.array(F.lit(text.EOS_ID))))})


ID = "(('0x' || substr(md5({}), 1, 7))::bigint + 3)"


@query("append_special_tokens", "f6", SPLIT_SQL + f"""select conv_id, turn, n_query + 1 as n_query_ids, n - n_query + (case when turn % 4 = 3 then 0 else 1 end) as n_response_ids, 1::bigint as first_id,
  case when turn % 4 = 3 then {ID.format('toks[n]')} else 2 end::bigint as last_id from s""")
def _(spark, sf):
    df = episodes(fx.f6(spark, sf), F.col("turn") % 4 == 3)
    return df.select("conv_id", "turn", big(F.size("query_token_ids")).alias("n_query_ids"), big(F.size("response_token_ids")).alias("n_response_ids"),
                     big(F.element_at("query_token_ids", 1)).alias("first_id"), big(F.element_at("response_token_ids", -1)).alias("last_id"))


@query("roundtrip_check", "f6", f"""select conv_id, turn, array_to_string({toks_sql('query_text')}, '') = query_text as query_ok, array_to_string({toks_sql('response_text')}, '') = response_text as response_ok,
  array_to_string({toks_sql('full_text')}, '') = full_text as full_ok from f6""")
def _(spark, sf):
    ok = [(F.array_join(text.tokens(F.col(f"{c}_text")), "") == F.col(f"{c}_text")).alias(f"{c}_ok") for c in ["query", "response", "full"]]
    return fx.f6(spark, sf).select("conv_id", "turn", *ok)


@query("truncate_to_max_len", "f6", SPLIT_SQL + """select conv_id, turn, n_query, case when n > 120 then greatest(120 - n_query, 0) else n - n_query end as n_response, case when n > 120 then -0.5::double else 1 end as reward, n > 120 as is_unfinished from s""")
def _(spark, sf):
    df = split_tokens(fx.f6(spark, sf))
    cut = F.size("toks") > 120
    n_response = F.when(cut, F.greatest(F.lit(120) - F.col("n_query"), F.lit(0))).otherwise(F.size("toks") - F.col("n_query"))
    return df.select("conv_id", "turn", big("n_query").alias("n_query"), big(n_response).alias("n_response"), F.when(cut, -0.5).otherwise(1.0).alias("reward"), cut.alias("is_unfinished"))


@query("truncate_response_text", "f6", f"""select conv_id, turn, case when len(q) + len(r) > 100 then array_to_string(r[1:greatest(100 - len(q), 0)], '') else response_text end as response
from (select *, {toks_sql('query_text')} as q, {toks_sql('response_text')} as r from f6)""")
def _(spark, sf):
    q, r = text.tokens(F.col("query_text")), text.tokens(F.col("response_text"))
    df = fx.f6(spark, sf).withColumns({"q": F.size(q), "r": r})
    kept = F.array_join(F.slice("r", F.lit(1), F.greatest(F.lit(100) - F.col("q"), F.lit(0))), "")
    return df.select("conv_id", "turn", F.when(F.col("q") + F.size("r") > 100, kept).otherwise(F.col("response_text")).alias("response"))


@query("sft_episodes", "f6", SPLIT_SQL + "select conv_id, turn, n_query + 1 as n_query_ids, n - n_query + 1 as n_response_ids, 1.0::double as reward, (n - n_query + 1)::double as advantage_sum from s")
def _(spark, sf):
    df = episodes(fx.f6(spark, sf), F.lit(False)).withColumn("advantages", F.array_repeat(F.lit(1.0), F.size("response_token_ids")))
    return df.select("conv_id", "turn", big(F.size("query_token_ids")).alias("n_query_ids"), big(F.size("response_token_ids")).alias("n_response_ids"),
                     F.lit(1.0).alias("reward"), F.aggregate("advantages", F.lit(0.0), lambda a, x: a + x).alias("advantage_sum"))


@query("pairwise_columns", "f6", "select conv_id, turn, query_text as prompt, response_text as chosen, reverse(response_text) as rejected from f6")
def _(spark, sf):
    return fx.f6(spark, sf).select("conv_id", "turn", F.col("query_text").alias("prompt"), F.col("response_text").alias("chosen"), F.reverse("response_text").alias("rejected"))


@query("reward_model_episodes", "f6", f"""select conv_id, turn, len({toks_sql("'Q: ' || query_text")}) + 1 as n_query, len({toks_sql("' A: ' || response_text")}) + 1 as n_chosen, len({toks_sql("' A: ' || query_text")}) + 1 as n_rejected from f6""")
def _(spark, sf):
    def ids(template, **cols):
        return text.token_ids(text.tokens(text.render_template(template, cols)))

    eos = F.array(F.lit(text.EOS_ID))
    df = fx.f6(spark, sf).select(
        "conv_id", "turn", F.concat(F.array(F.lit(text.BOS_ID)), ids("Q: {q}", q=F.col("query_text"))).alias("q"),
        F.concat(ids(" A: {r}", r=F.col("response_text")), eos).alias("c"), F.concat(ids(" A: {r}", r=F.col("query_text")), eos).alias("r"))
    return df.select("conv_id", "turn", big(F.size("q")).alias("n_query"), big(F.size("c")).alias("n_chosen"), big(F.size("r")).alias("n_rejected"))


@query("binary_episodes", "f9", f"""select doc_id, len({toks_sql("'Doc: ' || solution")}) + 2 as n_query, target_prob from f9 where target_prob is not null""")
def _(spark, sf):
    ids = text.token_ids(text.tokens(text.render_template("Doc: {solution}", {"solution": F.col("solution")})))
    df = fx.f9(spark, sf).where("target_prob is not null").select("doc_id", "target_prob", F.concat(F.array(F.lit(text.BOS_ID)), ids, F.array(F.lit(text.EOS_ID))).alias("q"))
    return df.select("doc_id", big(F.size("q")).alias("n_query"), "target_prob")


@query("filter_long_questions", "f6", f"select conv_id, turn from f6 where len({toks_sql('query_text')}) <= 60")
def _(spark, sf):
    return fx.f6(spark, sf).where(F.size(text.tokens(F.col("query_text"))) <= 60).select("conv_id", "turn")


@query("empty_response_drop", "f1 f2", "select count(*) filter (where num_tokens - 2 > 0) as kept, count(*) filter (where num_tokens - 2 <= 0) as dropped, round(avg((num_tokens - 2 <= 0)::int::double), 6) as empty_response from f2")
def _(spark, sf):
    empty = F.col("num_tokens") - 2 <= 0
    return fx.f2(spark, sf).agg(F.count_if(~empty).alias("kept"), F.count_if(empty).alias("dropped"), F.round(F.avg(empty.cast("double")), 6).alias("empty_response"))


PREFIX = " que "
# lines with their starts; leading blanks and, with an answer, trailing blanks join their neighbour
BORDERS = f"""with b as (select doc_id, solution, len(string_split(solution, '{PREFIX}')) = 2 as answered, case when len(string_split(solution, '{PREFIX}')) = 2 then string_split(solution, '{PREFIX}')[1] else solution end as body from f9),
l as (select doc_id, solution, answered, body, string_split(body, chr(10)) as ls from b),
p as (select doc_id, solution, answered, body, ls, unnest(range(1, len(ls))) as i from l),
c as (select doc_id, answered, body, list_sum(list_transform(ls[1:i], lambda x: length(x))) + i - 1 as cut from p),
k as (select doc_id, cut::bigint as cut from c where regexp_matches(substr(body, 1, cut::bigint), '[^ \\t\\n\\r\\f\\v]') and (not answered or regexp_matches(substr(body, cut::bigint + 1), '[^ \\t\\n\\r\\f\\v]'))),
ix as (select f9.doc_id, any_value(solution) as solution, list_concat([0], list_concat(coalesce(list(cut order by cut) filter (where cut is not null), []), [length(any_value(solution))])) as ix from f9 left join k using (doc_id) group by f9.doc_id)
"""


def with_steps(spark, sf):
    df = fx.f9(spark, sf)
    return df.withColumn("ix", steps.split_steps_delimiter(F.col("solution"), "\n", PREFIX))


@query("split_steps_delimiter", "f9", BORDERS + "select doc_id, array_to_string(ix, ',') as indices from ix")
def _(spark, sf):
    return with_steps(spark, sf).select("doc_id", F.array_join(F.transform("ix", lambda i: i.cast("string")), ",").alias("indices"))


@query("count_steps", "f9", BORDERS + "select doc_id, len(ix) - 1 as num_steps from ix")
def _(spark, sf):
    return with_steps(spark, sf).select("doc_id", big(F.size("ix") - 1).alias("num_steps"))


@query("prefix_states", "f9", BORDERS + """, q as (select doc_id, solution, ix, unnest(range(len(ix) - 2)) as step from ix)
select doc_id, 0 as state_idx, length('Q' || doc_id::varchar) as state_len, md5('Q' || doc_id::varchar) as digest from f9
union all select doc_id, step + 1, ix[step + 2] + length('Q' || doc_id::varchar), md5('Q' || doc_id::varchar || substr(solution, 1, ix[step + 2])) from q""")
def _(spark, sf):
    """The query is state 0; then the text up to the end of each step but the last."""
    rows = with_steps(spark, sf)
    question = F.concat(F.lit("Q"), F.col("doc_id").cast("string"))
    count = F.size("ix") - 2
    exploded = rows.where(count > 0).select("doc_id", "solution", "ix", question.alias("q"), F.explode(F.sequence(F.lit(0), count - 1)).alias("step"))
    state = F.concat("q", steps.prefix_of(F.col("solution"), F.col("ix"), F.col("step")))
    inner = exploded.select("doc_id", big(F.col("step") + 1).alias("state_idx"), state.alias("state"))
    first = rows.select("doc_id", F.lit(0).cast("bigint").alias("state_idx"), question.alias("state"))
    return first.unionByName(inner).select("doc_id", "state_idx", big(F.length("state")).alias("state_len"), F.md5("state").alias("digest"))


@query("suffix_responses", "f9", BORDERS + """, q as (select doc_id, solution, ix, unnest(range(len(ix) - 1)) as step from ix)
select doc_id, step, md5(substr(solution, ix[step + 1] + 1)) as digest from q""")
def _(spark, sf):
    rows = with_steps(spark, sf).select("doc_id", "solution", "ix", F.explode(F.sequence(F.lit(0), F.size("ix") - 2)).alias("step"))
    return rows.select("doc_id", big("step").alias("step"), F.md5(steps.suffix_of(F.col("solution"), F.col("ix"), F.col("step"))).alias("digest"))


@query("next_action", "f9", BORDERS + """select doc_id, case when doc_id % 5 <> 0 and len(ix) - 1 > doc_id % 3 + 1 then substr(solution, ix[doc_id % 3 + 2] + 1, ix[doc_id % 3 + 3] - ix[doc_id % 3 + 2]) end as action from ix""")
def _(spark, sf):
    rows = with_steps(spark, sf)
    border = F.try_element_at("ix", (F.col("doc_id") % 3 + 2).cast("int"))
    # every fifth state stops one character early, so no step border lines up
    state = F.substring("solution", F.lit(1), F.coalesce(border, F.length("solution")) - F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    action = steps.next_action(F.col("state"), F.col("solution"), F.col("ix"))
    return rows.withColumn("state", state).select("doc_id", F.when(F.col("doc_id") % 5 != 0, action).alias("action"))


@query("split_steps_prose")
def _(spark, sf):
    ix = steps.split_steps_prose(F.col("solution"))
    return fx.f9(spark, sf).select("doc_id", "solution", ix.alias("ix")).select("doc_id", F.size("ix").alias("borders"), (F.element_at("ix", -1) == F.length("solution")).alias("covers"))


@query("split_steps_lossy")
def _(spark, sf):
    return fx.f9(spark, sf).select("doc_id", steps.split_steps_lossy(F.col("solution")).alias("p")).select("doc_id", F.size("p").alias("pieces"), F.array_max(F.transform("p", lambda x: F.length(x))).alias("longest"))


@query("join_gold_steps", "f9", "select doc_id, md5(array_to_string(string_split(solution, '. '), chr(10))) as digest from f9")
def _(spark, sf):
    return fx.f9(spark, sf).select("doc_id", F.md5(text.listed_solution_text(F.split("solution", r"\. "))).alias("digest"))


@query("solution_text", "f9", """select doc_id, md5(case when doc_id % 3 = 0 then 'steps of ' || doc_id::varchar else solution end || case when target_prob is not null then chr(10) || '# Answer' || chr(10) || target_prob::bigint::varchar else '' end) as digest from f9""")
def _(spark, sf):
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("steps of "), F.col("doc_id").cast("string")))
    full = text.solution_text(F.col("solution"), "\n# Answer\n", F.col("target_prob").cast("bigint").cast("string"), given)
    return fx.f9(spark, sf).select("doc_id", F.md5(full).alias("digest"))


@query("fish_bone_spine", "f9", """with l as (select doc_id, 'P' || doc_id::varchar || ': ' as q, string_split(solution, chr(10)) as ls from f9), p as (select doc_id, q, ls, unnest(range(len(ls))) as i from l)
select doc_id, i as depth, md5(case when i = 0 then q || ls[1] else ls[i + 1] end) as text, md5(q || array_to_string(ls[1:i + 1], '')) as full_text from p""")
def _(spark, sf):
    rows = fx.f9(spark, sf).select("doc_id", F.split("solution", "\n").alias("steps"))
    spine = spine_of(rows, "doc_id", "steps", F.concat(F.lit("P"), F.col("doc_id").cast("string"), F.lit(": ")))
    return spine.select("doc_id", "depth", F.md5("text").alias("text"), F.md5("full_text").alias("full_text"))


@query("answer_after_prefix", "f6", """select conv_id, turn, case when instr(response_text, ' the ') > 0 then substr(response_text, instr(response_text, ' the ') + 5) || case when turn % 4 = 1 then '' else '<end>' end end as answer from f6""")
def _(spark, sf):
    reason = F.when(F.col("turn") % 4 == 1, "length").otherwise("stop")
    return fx.f6(spark, sf).select("conv_id", "turn", text.answer_after_prefix(F.col("response_text"), " the ", reason, "<end>").alias("answer"))


@query("extract_abcd", "f6", """with x as (select *, contains(response_text, 'A')::int as a, contains(response_text, 'B')::int as b, contains(response_text, 'C')::int as c, contains(response_text, 'D')::int as d from f6)
select conv_id, turn, case when a + b + c + d <> 1 then 'no-answer' when a = 1 then 'A' when b = 1 then 'B' when c = 1 then 'C' else 'D' end as letter from x""")
def _(spark, sf):
    return fx.f6(spark, sf).select("conv_id", "turn", text.extract_abcd(F.col("response_text")).alias("letter"))


# whole solutions with every answer form behind them: the number n is the expected answer


@query("extract_answer_marker", "f9", "select doc_id, case when doc_id % 3 = 1 then (doc_id * 7)::varchar end as answer from f9")
def _(spark, sf):
    forms = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\n# Answer\n  "), (F.col("doc_id") * 7).cast("string"), F.lit(" "))).otherwise("# Answer\nx# Answer\ny")
    return fx.f9(spark, sf).select("doc_id", text.extract_answer_marker(F.concat("solution", forms)).alias("answer"))


NUMBER = r"(?:[+-]?\d+\.\d*|[+-]?\.\d+|[+-]?\d+e[-+]?\d+|[+-]?\d+)"


@query("extract_last_number", "f9", f"select doc_id, regexp_extract_all(replace(solution, ',', ''), '{NUMBER}')[-1] as answer from f9")
def _(spark, sf):
    return fx.f9(spark, sf).select("doc_id", text.extract_last_number(F.col("solution")).alias("answer"))


@query("extract_hash_answer", "f9", """with x as (select doc_id, case when doc_id % 2 = 0 then solution else solution || ' #### ' || doc_id::varchar || ' #### last ' end as t from f9)
select doc_id, case when contains(t, '####') then regexp_replace(string_split(t, '####')[-1], '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') end as answer, case when doc_id % 2 = 1 and not contains(regexp_replace(t, ' #### [0-9]+ #### last $', ''), '####') then doc_id::varchar
  when contains(t, '####') then regexp_replace(string_split(t, '####')[2], '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') end as gold from x""")
def _(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, F.col("solution")).otherwise(F.concat("solution", F.lit(" #### "), F.col("doc_id").cast("string"), F.lit(" #### last ")))
    return fx.f9(spark, sf).withColumn("t", t).select("doc_id", text.extract_hash_answer(F.col("t")).alias("answer"), text.extract_hash_gold(F.col("t")).alias("gold"))


@query("strip_calculator", "f9", "select doc_id, md5(solution || ' so 12=12 and done') as digest from f9")
def _(spark, sf):
    marked = F.concat("solution", F.lit(" so 12=<<6*2=\n12>>12 and <<1>>done"))
    return fx.f9(spark, sf).select("doc_id", F.md5(text.strip_calculator(marked)).alias("digest"))


@query("extract_boxed", "f9", r"select doc_id, '\frac{1}{2}|' || doc_id::varchar || '}' as boxed from f9")
def _(spark, sf):
    t = F.concat("solution", F.lit(r" so \boxed{\frac{1}{2}} or \boxed{"), F.col("doc_id").cast("string"), F.lit("}% done"))
    return fx.f9(spark, sf).select("doc_id", F.array_join(extraction.extract_boxed(t), "|").alias("boxed"))


@query("extract_answer_cascade", "f9", """select doc_id, case when doc_id % 6 = 5 then '' else (doc_id * 3)::varchar || '.5' end as answer from f9""")
def _(spark, sf):
    n = F.concat((F.col("doc_id") * 3).cast("string"), F.lit(".5"))
    forms = {
        0: F.concat(F.lit("Hence the final answer is $"), n, F.lit("$. I hope it is correct.")), 1: F.concat(F.lit(r"thus \boxed{"), n, F.lit("}.")),
        2: F.concat(F.lit("The answer is: "), n, F.lit(".\nNext line")), 3: F.concat(F.lit("run\n```output\n"), n, F.lit("\n```\nend")), 4: F.concat(F.lit("first 1,000 then "), n, F.lit(" items")),
    }
    t = F.regexp_replace("solution", "[0-9]", "")
    for i, form in forms.items():
        t = F.when(F.col("doc_id") % 6 == i, F.concat("solution", F.lit("\n"), form)).otherwise(t)
    return fx.f9(spark, sf).select("doc_id", extraction.extract_answer_cascade(t).alias("answer"))


@query("split_answer_list", "f9", """select doc_id, case doc_id % 3 when 0 then doc_id::varchar || '|2|3' when 1 then '(' || doc_id::varchar || ',2)' else doc_id::varchar || '|7' end as answers from f9""")
def _(spark, sf):
    d = F.col("doc_id").cast("string")
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(d, F.lit(", 2 ,3"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("("), d, F.lit(",2)"))).otherwise(F.concat(d, F.lit(r" \text{ and } 7")))
    question = F.when(F.col("doc_id") % 3 == 2, "Which ones?").otherwise("List them separated by commas.")
    return fx.f9(spark, sf).select("doc_id", F.array_join(extraction.split_answer_list(question, F.array(answer)), "|").alias("answers"))


# raw answers of orders, and what each normaliser must make of them
FORMS = {
    0: (r"\dfrac{K}{7}", r"\frac{K}{7}", "K/7", r"\frac{K}{7}"),
    1: ("K/7", r"\frac{K}{7}", "K/7", r"\frac{K}{7}"),
    2: ("0.5", r"\frac{1}{2}", "0.5", "0.5"),
    3: ("x=K", "K", "x=K", "x=K"),
    4: (r"K\%", "K", "K", "K%"),
    5: (r"\text{Word K}", "WordK", "wordK", "WordK"),
    6: ("K cm", "Kcm", "K", "Kcm"),
    7: (r"\sqrt3", r"\sqrt{3}", "sqrt(3)", r"\sqrt{3}"),
    8: (r"K^\circ", "K", "K", "K"),
    9: ("K.0", "K.0", "K", "K"),
    10: (r"K \frac{3}{4}", r"K\frac{3}{4}", "K+3/4", r"K\frac{3}{4}"),
    11: (r"\sqrt{K}/2", r"\sqrt{K}/2", "sqrt(K)/2", r"\frac{\sqrt{K}}{2}"),
}


def forms_sql(which):
    cases = " ".join(f"when {i} then replace('{f[which]}', 'K', (o_orderkey % 50 + 2)::varchar)" for i, f in FORMS.items())
    return f"case o_orderkey % {len(FORMS)} {cases} end"


def forms_col(which):
    key = F.col("o_orderkey")
    number = (key % 50 + 2).cast("string")
    out = F.lit(None).cast("string")
    for i, f in FORMS.items():
        out = F.when(key % len(FORMS) == i, F.replace(F.lit(f[which]), F.lit("K"), number)).otherwise(out)
    return out


@query("normalize_answer", "", f"select o_orderkey, {forms_sql(1)} as answer from orders")
def _(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", normalize.normalize_answer(forms_col(0)).alias("answer"))


@query("normalize_answer_loose", "", f"select o_orderkey, {forms_sql(2)} as answer from orders")
def _(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", normalize.normalize_answer_loose(forms_col(0)).alias("answer"))


@query("strip_string_minerva", "", f"select o_orderkey, {forms_sql(3)} as answer from orders")
def _(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", normalize.strip_string(forms_col(0)).alias("answer"))


# pairs of answers with the grade each must get
GRADES = {0: (r"\frac{K}{7}", "K/7", True), 1: ("(K,2)", "(K, 2)", True), 2: ("(K,2)", "[K,2]", False), 3: ("K", "K.5", False), 4: ("2/4", "1/2", False),
          5: ("0.25", "1/4", True), 6: ("K dollars", "K euros", False), 7: ("1,234", "1234", True), 8: (r"K\%", "K", True), 9: ("K", "K.0", True),
          10: (r"\frac{3}{4}", "0.75", True), 11: (r"(\frac{1}{2},K)", "(0.5,K)", True), 12: ("7 3/4", "31/4", True), 13: (r"K \dfrac{1}{4}", "K.25", True), 14: (r"2\sqrt{3}", r"\sqrt{12}", True),
          15: (r"\frac{\pi}{2}", "0.5*pi", True), 16: (r"\frac{K}{3}", "K", False), 17: (r"\sqrt{K}", "K.5", False)}
TOLERANT = {0: ("K", "K.0004", True), 1: ("K%", "K", True), 2: ("1,234", "1234", True), 3: ("K", "K.01", False), 4: ("word", "word", True), 5: ("word", "K", False), 6: (r"50\%", "0.5", True), 7: ("K", "K00", True), 8: ("", "", True), 9: ("-K", "K", False)}
SHAPES = {0: ("(K,0.5)", "(K, 0.5001)", True), 1: ("(K,1)", "(K,1,2)", False), 2: (r"\begin{pmatrix} 1 & K \\ 3 & 4 \end{pmatrix}", r"\begin{pmatrix}1&K\\3&4\end{pmatrix}", True),
          3: (r"[0,1] \cup (2,K)", r"(2,K)\cup[0,1]", True), 4: (r"[0,1] \cup (2,K)", r"(2,K)\cup[0,7]", False), 5: ("[1,2)", "[1,2)", True), 6: ("(1,2)", "3", False), 7: (r"\begin{pmatrix}1\\2\end{pmatrix}", r"\begin{pmatrix}1\\3\end{pmatrix}", False), 8: ("K", "K", True), 9: ("(K,7)", "[K,7]", True)}


def graded(spark, sf, table, grade):
    key = F.col("o_orderkey")
    number = (key % 50 + 2).cast("string")
    given, truth = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (g, t, _) in table.items():
        given = F.when(key % len(table) == i, F.replace(F.lit(g), F.lit("K"), number)).otherwise(given)
        truth = F.when(key % len(table) == i, F.replace(F.lit(t), F.lit("K"), number)).otherwise(truth)
    return fx.table(spark, sf, "orders").select("o_orderkey", given.alias("g"), truth.alias("t")).select("o_orderkey", grade(F.col("g"), F.col("t")).alias("is_correct"))


def grades_sql(table):
    return f"select o_orderkey, case o_orderkey % {len(table)} " + " ".join(f"when {i} then {str(ok).lower()}" for i, (_, _, ok) in table.items()) + " end as is_correct from orders"


@query("grade_normalized", "", grades_sql(GRADES))
def _(spark, sf):
    return graded(spark, sf, GRADES, grading.grade_normalized)


@query("grade_numeric_tolerant", "", grades_sql(TOLERANT))
def _(spark, sf):
    return graded(spark, sf, TOLERANT, grading.grade_numeric_tolerant)


@query("grade_interval_matrix", "", grades_sql(SHAPES))
def _(spark, sf):
    return graded(spark, sf, SHAPES, grading.grade_interval_matrix)


VALID = "answers_str is not null and answers_str <> 'not a list' and probs_str <> '[0.5]'"
LISTS = f"""with l as (select question_id, {VALID} as valid, case when {VALID} then from_json(answers_str, '["VARCHAR"]') end as a, case when {VALID} then from_json(probs_str, '["DOUBLE"]') end as p from f12)"""


def lists(spark, sf):
    return forecasting.parse_lists(fx.f12(spark, sf))


@query("parse_list_strings", "f12", LISTS + " select question_id, coalesce(valid, false) as valid, case when valid then len(a) end as n from l")
def _(spark, sf):
    return lists(spark, sf).select("question_id", "valid", F.when(F.col("valid"), big(F.size("answers"))).alias("n"))


@query("forecast_unroll", "f12", LISTS + """, u as (select question_id, i - 1 as idx, a[i] as answer, p[i] as prob from l, lateral (select unnest(range(1, len(a) + 1)) as i) where valid)
select question_id, idx, answer, prob from u where prob between 0 and 1""")
def _(spark, sf):
    return forecasting.forecast_unroll(lists(spark, sf), "question_id")


@query("extraction_target", "f12", LISTS + " select question_id, case when valid then case when a[2] = a[3] then a[2] else a[2] || '; ' || a[3] end end as target from l")
def _(spark, sf):
    return forecasting.extraction_target(lists(spark, sf)).select("question_id", "target")


@query("ordered_unique_list", "f12", LISTS + " select question_id, case when valid then case when a[1] = a[2] and a[2] = a[3] then a[1] when a[1] = a[2] or a[2] = a[3] then a[1] || '|' || a[3] when a[1] = a[3] then a[1] || '|' || a[2] else a[1] || '|' || a[2] || '|' || a[3] end end as uniq from l")
def _(spark, sf):
    return lists(spark, sf).select("question_id", F.when(F.col("valid"), F.array_join(F.array_distinct("answers"), "|")).alias("uniq"))


@query("list_set_match", "f12", LISTS + """ select question_id, list_distinct(a) @> ['LOW'] and list_distinct(a) @> ['F'] and len(list_distinct(a)) = 2 as matched from l where valid""")
def _(spark, sf):
    ok = forecasting.list_set_match(F.col("answers"), F.array(F.lit("LOW"), F.lit("F"), F.lit("LOW")))
    return lists(spark, sf).where("valid").select("question_id", ok.alias("matched"))


@query("few_shot_length_filter", "f9", """select doc_id from f9 where length(solution) <= 900 and len(string_split(solution, chr(10))) <= 6""")
def _(spark, sf):
    rows = fx.f9(spark, sf).select("doc_id", F.length("solution").alias("solution_chars"), F.size(F.split("solution", "\n")).alias("num_steps"))
    return fewshot.length_filter(rows, {"solution_chars": 900, "num_steps": 6, "doc_id": None}).select("doc_id")


K, MAXC, DELIM = 3, 2600, "\n\n"
FEW = f"""with pool as (select row_number() over (order by item_id) - 1 as pos, text from benchmark), n as (select count(*) as p from benchmark),
t as (select doc_id, solution, a, {feistel_sql(f"({SEED} + a)::varchar", 'doc_id', 'p')}, p from f9, n, (select unnest(range(10)) as a)),
k as (select doc_id, solution, a, j, {pick_sql('j', 'p')} as pos from t, (select unnest(range({K + 1})) as j)),
m as (select doc_id, solution, a, j, text, row_number() over (partition by doc_id, a order by j) as rn from k join pool using (pos) where text <> solution),
x as (select doc_id, a, any_value(solution) as solution, string_agg(text, chr(10) || chr(10) order by j) as ctx from m where rn <= {K} group by doc_id, a),
f as (select *, ctx || chr(10) || chr(10) || solution as prompt from x),
c as (select doc_id, coalesce(min(a) filter (where length(prompt) <= {MAXC}), 9) as a from f group by doc_id),
r as (select doc_id, a, {toks_sql('prompt')} as toks from f join c using (doc_id, a))
select doc_id, a as attempt, md5(array_to_string(case when len(toks) > 400 then toks[len(toks) - 399:] else toks end, '')) as digest from r"""


@query("few_shot_sample", "f9", FEW)
def _(spark, sf):
    pool = fx.table(spark, sf, "benchmark")
    df = fewshot.few_shot_sample(fx.f9(spark, sf), "doc_id", "solution", pool, "item_id", "text", K, SEED, MAXC, DELIM, max_tokens=400)
    return df.select("doc_id", big("attempt").alias("attempt"), F.md5("prompt").alias("digest"))


@query("fixed_few_shot_prefix", "f6", f"""with r as (select conv_id, turn, {toks_sql("'Problem: 1+1? Solution: 2. Problem: ' || query_text")} as toks from f6)
select conv_id, turn, array_to_string(case when len(toks) > 50 then toks[len(toks) - 49:] else toks end, '') as prompt from r""")
def _(spark, sf):
    return fx.f6(spark, sf).select("conv_id", "turn", fewshot.fixed_prefix(F.col("query_text"), "Problem: 1+1? Solution: 2. Problem: ", 50).alias("prompt"))


def load_length_model():
    """A deterministic stand-in for a scoring model."""
    return lambda texts: [(len(t) % 100) / 100 for t in texts]


@query("model_score_batch", "f6", "select conv_id, turn, case when turn % 4 = 1 then 0.5::double else (length(full_text) % 100) / 100.0::double end as score from f6")
def _(spark, sf):
    rows = fx.f6(spark, sf).withColumn("score", F.when(F.col("turn") % 4 == 1, 0.5))
    return plugins.model_score_batch(rows, "query_text", "response_text", load_length_model).select("conv_id", "turn", "score")


@query("reward_udf", "f6", "select conv_id, turn, (length(response_text) % 10) / 10.0::double as reward, length(response_text) > 500 as is_unfinished from f6")
def _(spark, sf):
    score = plugins.reward_udf(lambda q, r: ((r.str.len() % 10) / 10.0, r.str.len() > 500))
    return fx.f6(spark, sf).select("conv_id", "turn", score("query_text", "response_text").alias("r")).select("conv_id", "turn", "r.*")
