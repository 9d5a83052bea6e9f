"""All queries of the library, by name, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions import expressions as X
from veritrail.operators import fields, metrics, policies, spans
from veritrail.plans.base import EVENTS, events, query, rounded, table


def ranking_sql(group: str) -> str:
    """AUROC by mid-ranks and step-wise AP, in SQL."""
    part, keys = (f"partition by {group} " if group else ""), (f"{group}, " if group else "")
    return f"""with {EVENTS}, g as (select {keys} score, sum(y) as pos, count(*) as n from e group by {keys} score),
w as (select *, sum(n - pos) over ({part} order by score) - (n - pos) as below, sum(pos) over ({part} order by score desc) as tp, sum(n) over ({part} order by score desc) as seen from g),
a as (select {keys} sum(n)::bigint as n, sum(pos)::bigint as n_pos, sum(pos * (below + (n - pos) / 2.0)) as wins, sum(pos * tp::double / seen) as ap from w {f"group by {group}" if group else ""})
select {keys} n, n_pos, round(case when n_pos > 0 and n_pos < n then wins::double / (n_pos * (n - n_pos)) end, 9) as auroc, round(case when n_pos > 0 then ap / n_pos end, 9) as ap from a"""


def flagship(spark, sf_dir: str) -> DataFrame:
    return stat_auroc_users(spark, sf_dir)


@query(ranking_sql(""))
def stat_auroc(spark, d):
    return rounded(metrics.ranking(events(spark, d), []), "auroc", "ap")


@query(ranking_sql("user_id"))
def stat_auroc_users(spark, d):
    return rounded(metrics.ranking(events(spark, d), ["user_id"]), "auroc", "ap")


@query(f"with {EVENTS} select user_id, round(avg(pow(score / 500.0 - y, 2)), 9) as brier, round(avg((((score / 500.0) > 0.5)::int = y)::int::double), 9) as accuracy from e group by user_id")
def stat_brier(spark, d):
    return rounded(metrics.calibration(events(spark, d).withColumn("p", F.col("score") / 500.0), ["user_id"]), "brier", "accuracy")


@query(f"with {EVENTS}, r as (select user_id, score, row_number() over (partition by user_id order by score desc) as k, count(*) over (partition by user_id) as n from e where y = 1) select user_id, max(score) as threshold from r where k >= ceil(n * 0.8) group by user_id")
def stat_thr(spark, d):
    return metrics.threshold_for_recall(events(spark, d), ["user_id"], 0.8)


@query(f"with {EVENTS} select user_id, row_number() over w::int as cost, sum(y - still) over w::bigint as net from e window w as (partition by user_id order by score desc, event_id rows unbounded preceding) union all select distinct user_id, 0, 0 from e")
def win_curve(spark, d):
    rows = events(spark, d).withColumn("delta", F.col("y") - F.col("still"))
    return policies.curve(rows, [F.desc("score"), F.col("event_id")], ["user_id"], origin=True)


@query(f"""with {EVENTS}, c as (select user_id, row_number() over w as cost, sum(y - still) over w::bigint as net from e window w as (partition by user_id order by score desc, event_id rows unbounded preceding)),
n as (select user_id, max(cost) as n from c group by user_id), b as (select user_id, share, floor(n * share)::int as cost from n, (values (0.1::double), (0.25), (0.5), (1.0)) s(share))
select b.user_id, share, b.cost, coalesce(net, 0)::bigint as net from b left join c on b.user_id = c.user_id and b.cost = c.cost""")
def win_budget(spark, d):
    rows = events(spark, d).withColumn("delta", F.col("y") - F.col("still"))
    return policies.budgets(policies.curve(rows, [F.desc("score"), F.col("event_id")], ["user_id"]), ["user_id"])


TAUS = "(select round(0.05 * i, 2)::double as tau from range(0, 20) r(i)) t"


@query(f"""with {EVENTS}, g as (select tau, count(*) filter (score / 500.0 >= tau) as n_override, count(*) as n, count(*) filter (score / 500.0 >= tau and y > still) as fixed, count(*) filter (score / 500.0 >= tau and y < still) as broke from e, {TAUS} group by tau)
select tau, n_override, round(n_override::double / n, 9) as rate, fixed, broke, fixed - broke as net, round(fixed::double / nullif(fixed + broke, 0), 9) as precision from g""")
def pol_gate(spark, d):
    rows = events(spark, d).select((F.col("score") / 500.0).alias("p"), (F.col("y") - F.col("still")).alias("delta"))
    return rounded(policies.gate(rows, []), "rate", "precision")


HELD = f"""with {EVENTS}, o as (select user_id, tau, count(*) filter (score / 500.0 >= tau and y > still) as fixed, count(*) filter (score / 500.0 >= tau and y < still) as broke from e, {TAUS} group by all),
z as (select *, fixed - broke as net, sum(fixed - broke) over (partition by tau) - (fixed - broke) as others from o), h as (select user_id, tau, fixed, broke, net from (select *, row_number() over (partition by user_id order by others desc, tau) as r from z) where r = 1)"""


def held_out(spark, d):
    return policies.held_out_gate(events(spark, d).select("user_id", (F.col("score") / 500.0).alias("p"), (F.col("y") - F.col("still")).alias("delta")), "user_id")


@query(HELD + " select * from h")
def pol_heldout(spark, d):
    return held_out(spark, d)


@query(HELD + ", t as (select tau, count(*) as n from h group by tau) select t.tau, t.n, count(*) as n_folds, sum(fixed)::bigint as fixed, sum(broke)::bigint as broke, sum(net)::bigint as net from h, t group by t.tau, t.n")
def pol_heldout_sum(spark, d):
    return policies.held_out_summary(held_out(spark, d)).withColumn("x", F.explode("taus")).select("x.tau", "x.n", "n_folds", "fixed", "broke", "net")


@query("""with c as (select l_orderkey as key, l_linenumber as idx, l_discount as p from lineitem), b as (select key, min((p, idx)) as b, 0.15::double as orig_p from c group by key)
select key, b[2] as idx, b[1] as p, orig_p, margin, b[1] <= orig_p - margin as taken from b, (values (0.0::double), (0.05), (0.1), (0.15), (0.2), (0.3)) m(margin)""")
def pol_select(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("idx"), F.col("l_discount").alias("p"), F.lit(0.15).alias("orig_p"))
    return policies.select_candidates(rows)


@query("select page_id, regexp_replace(regexp_replace(lower(trim(url)), '^(https?://)?(www\\.)?', ''), '/$', '') as url from pages")
def fn_url(spark, d):
    return table(spark, d, "pages").select("page_id", X.url(F.col("url")).alias("url"))


@query("select c_custkey, case c_custkey % 3 when 0 then lower(replace(c_name, '#', '@')) when 1 then lower(replace(c_name, '#', '@')) else 'me@a.no' end as email from customer")
def fn_email(spark, d):
    """After mailto:, in a link, and bare."""
    k, plain = F.col("c_custkey") % 3, F.replace("c_name", F.lit("#"), F.lit("@"))
    text = F.when(k == 0, F.concat(F.lit(" mailto:"), plain)).when(k == 1, F.concat(F.lit("["), plain, F.lit("](mailto:x@y.z)"))).otherwise(" Me@A.no ")
    return table(spark, d, "customer").select("c_custkey", X.email(text).alias("email"))


@query("select p_partkey, p_partkey % 4 in (0, 1) as same from part")
def fn_ci(spark, d):
    """Other case and blanks around; another word; a longer one."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(k == 0, F.concat(F.lit(" \t"), F.upper(name))).when(k == 1, F.concat(F.initcap(name), F.lit("\n"))).when(k == 2, F.concat(F.lit("x"), name)).otherwise(F.concat(name, F.lit(" .")))
    return table(spark, d, "part").select("p_partkey", X.same_folded(name, other).alias("same"))


@query("""with t as (select p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_brand), ' '), lambda x: x <> '')) as a, list_distinct(string_split(lower(p_name), ' ')) as b from part)
select p_partkey, len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) >= 0.6 as same from t""")
def fn_fuzzy(spark, d):
    return table(spark, d, "part").select("p_partkey", X.same_fuzzy(F.concat_ws(", ", "p_name", "p_brand"), F.concat("p_name", F.lit(".")), 0.6).alias("same"))


@query("select p_partkey, abs(p_size * 1000 - (p_size * 1000 + p_partkey % 50)) <= 0.01 * (p_size * 1000) as same from part")
def fn_number(spark, d):
    p = F.col("p_size").cast("long") * 1000
    return table(spark, d, "part").select("p_partkey", X.same_number(F.concat(F.lit("$"), F.format_number(p, 0)), (p + F.col("p_partkey") % 50).cast("string")).alias("same"))


@query("select o_orderkey, regexp_matches(o_orderpriority || case o_orderkey % 4 when 0 then ' FY2025' when 1 then ' q3' when 2 then ' H3' else '' end, '(?i)\\b(Q[1-4]|H[12]|FY\\s?\\d{2,4})\\b') as period from orders")
def fn_period(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.concat("o_orderpriority", F.when(k == 0, " FY2025").when(k == 1, " q3").when(k == 2, " H3").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", X.period(text).alias("period"))


@query("select doc_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[ .,;:]+$', '') as span from documents")
def fn_norm_span(spark, d):
    return table(spark, d, "documents").select("doc_id", X.norm_span(F.col("text")).alias("span"))


@query("""with a as (select c_custkey, [lower(c_mktsegment), 'x'] as a, case when c_custkey % 2 = 0 then ['X', c_mktsegment] else [c_name] end as b from customer)
select c_custkey, list_sort(list_distinct(list_transform(a, lambda x: lower(x)))) = list_sort(list_distinct(list_transform(b, lambda x: lower(x)))) as same from a""")
def set_array_eq(spark, d):
    a, b = F.array(F.lower("c_mktsegment"), F.lit("x")), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("X"), F.col("c_mktsegment"))).otherwise(F.array("c_name"))
    return table(spark, d, "customer").select("c_custkey", X.same_set(a, b).alias("same"))


@query("""with v as (select p_partkey, case when p_partkey % 7 > 0 then p_name || case when p_partkey % 2 = 0 then ', A 1,' else '' end end as v from part), c as (select *, coalesce(v, '') as t from v)
select p_partkey, length(t) as n_chars, case when t = '' then 0 else len(string_split(t, ' ')) end as n_words, regexp_matches(t, '[0-9]')::int as has_digit, regexp_matches(t, '[A-Z]')::int as has_upper, (length(t) - length(replace(t, ',', '')))::int as n_commas, 2 as depth, 8 as path_chars from c""")
def fn_handcrafted(spark, d):
    v = F.when(F.col("p_partkey") % 7 > 0, F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ", A 1,").otherwise("")))
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in X.handcrafted(v, F.lit("part.0.n")).items()])


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first from embeddings")
def fn_l2norm(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(X.dot(v, v)), 6).alias("norm"), F.round(X.l2_norm(v)[0], 6).alias("first"))


@query("select vec_id, round(1 / (1 + exp(-list_sum(list_transform(embedding, lambda x: x::double)))), 6) as p from embeddings")
def fn_sigmoid(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(X.sigmoid(X.dot(v, F.transform(v, lambda _: F.lit(1.0)))), 6).alias("p"))


@query("select conv_id, turn, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as start from conversations")
def win_token_starts(spark, d):
    return spans.starts(table(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "start")


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r = 1")
def win_dedup_first(spark, d):
    return fields.first_of(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1")
def top_candidate(spark, d):
    return fields.best_of(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) where r <= 3")
def lim_groups(spark, d):
    return fields.at_most(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 3, "o_orderkey")


@query("select doc_id, lang as path_str, coalesce(quality, -1.0)::double as p_err from documents left join labels using (doc_id)")
def join_pscore(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("path_str"))
    scores = table(spark, d, "labels").join(rows, "doc_id").select("doc_id", "path_str", F.col("quality").cast("double").alias("probe_score"))
    return fields.with_probe_score(rows, scores, -1.0)


@query("""with t as (select vec_id // 16 as doc, layer, vec_id % 16 as step, embedding[1 + 32 * layer : 32 + 32 * layer] as vec from embeddings, range(0, 2) l(layer)),
a as (select doc, layer, max(step) + 1 as have from t group by all), g as (select doc, max(have) + 1 as generated from a group by doc),
s as (select doc, span, (7 * doc + 5 * span) % 20 - 2 as first, (7 * doc + 5 * span) % 20 - 2 + 4 * span as past, generated from g, range(0, 3) r(span)),
c as (select *, greatest(0, least(first, generated - 1)) as lo from s), b as (select *, greatest(lo + 1, least(past, generated)) as hi from c),
w as (select b.doc, layer, span, least(lo, have - 1) as lo, least(hi, have) as hi from b join a on a.doc = b.doc),
v as (select w.doc, span, w.layer, step, hi, unnest(range(0, len(vec))) as pos, unnest(vec)::double as value from w join t on t.doc = w.doc and t.layer = w.layer and step >= lo and step < hi)
select doc, span, layer::integer as layer, 'all' as how, step, pos, round(value, 6) as value from v
union all select doc, span, layer::integer, 'last', step, pos, round(value, 6) from v where step = hi - 1
union all select doc, span, layer::integer, 'mean', null, pos, round(avg(value), 6) from v group by doc, span, layer, pos""")
def agg_span_reduce(spark, d):
    """Last, mean and all of the token vectors of three spans a document, some of them beyond its tokens."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 16").alias("doc"), (F.col("vec_id") % 16).alias("step"), "embedding")
    tokens = e.select("doc", "step", F.explode(F.array(*[F.struct(F.lit(i).alias("layer"), F.slice("embedding", 1 + 32 * i, 32).alias("vec")) for i in range(2)])).alias("x")).select("doc", "x.layer", "step", "x.vec")
    first = (7 * F.col("doc") + 5 * F.col("span")) % 20 - 2
    marks = e.groupBy("doc").agg((F.max("step") + 2).alias("generated")).withColumn("span", F.explode(F.array(*map(F.lit, range(3)))))
    marks = marks.select("doc", "span", first.alias("first"), (first + 4 * F.col("span")).alias("past"), "generated")
    each = [spans.reduce_spans(marks, tokens, how).withColumn("how", F.lit(how)) for how in spans.HOW]
    return rounded(each[0].unionByName(each[1]).unionByName(each[2]), "value", digits=6)


from veritrail.plans import audits, collections, fieldwork, functions, models, probing, trees as _trees, written  # noqa: E402, F401
from veritrail.plans.base import oracle_sql, queries  # noqa: E402, F401
