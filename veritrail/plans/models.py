"""Queries of what stands between models and tables, with stubs for models, and of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import expressions as X
from veritrail.operators import hooks
from veritrail.plans.base import query, rounded, table
from veritrail.sinks.workspace import work_folder
from veritrail.streaming import labels as streaming


@query("""with a as (select c_custkey, '{"name": "' || c_name || '", "seg": "' || c_mktsegment || '"}' as t from customer where c_custkey % 9 > 0)
select c_custkey, substr(t, 1, 60) as text, least(length(t), 60)::int as n_tokens, round(-1.0, 6)::double as last, case when length(t) > 60 then 'length' else 'stop' end as finish_reason from a union all select c_custkey, null, null, null, null from customer where c_custkey % 9 = 0""")
def hook_generate(spark, d):
    """A stub that reads lines of the prompt; some rows have no prompt."""
    user = F.when(F.col("c_custkey") % 9 > 0, F.concat(F.lit("name: "), "c_name", F.lit("\nseg: "), "c_mktsegment"))
    rows = table(spark, d, "customer").select("c_custkey", F.lit("s").alias("system"), user.alias("user"))
    out = hooks.generated(rows, lambda: hooks.StubGenerator(60))
    return rounded(out.select("c_custkey", "text", F.when(F.col("text").isNotNull(), F.size("tokens")).alias("n_tokens"), F.element_at("token_logprobs", -1).alias("last"), "finish_reason"), "last", digits=6)


@query("""with a as (select c_custkey, '{"name": "' || c_name || '", "seg": "' || c_mktsegment || '"}' as t, c_name, c_mktsegment as seg from customer where c_custkey % 9 > 0),
f as (select c_custkey, length(t) as n, t, 'name' as path_str, 10 as s, 10 + length(c_name) as e from a union all select c_custkey, length(t), t, 'seg', 21 + length(c_name), 21 + length(c_name) + length(seg) from a),
l as (select *, layer::int as layer, least(e, n - greatest(0, 2 * (layer - 1))) as h from f, range(1, 4) r(layer)), m as (select *, list_transform(range(s, h), lambda i: ascii(substr(t, i + 1, 1))) as codes from l where h > s)
select c_custkey, path_str, layer, how, round(step, 4) as step, round(code, 4) as code from (select c_custkey, path_str, layer, 'last' as how, (h - 1)::double as step, codes[len(codes)]::double as code from m union all select c_custkey, path_str, layer, 'mean', (s + h - 1) / 2.0::double, list_avg(codes) from m)""")
def extract_activations(spark, d):
    """Documents to activation rows in one pass, by a stub whose states tell their layer, step and token; higher layers lack the last
    steps, which cuts spans."""
    user = F.when(F.col("c_custkey") % 9 > 0, F.concat(F.lit("name: "), "c_name", F.lit("\nseg: "), "c_mktsegment"))
    rows, out = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("s").alias("system"), user.alias("user")), None
    for how in ("last", "mean"):
        found = hooks.activation_rows(hooks.extracted(rows, hooks.StubStates, [1, 2, 3], how), how)
        one = found.select(F.col("doc_id").alias("c_custkey"), "path_str", "layer", F.lit(how).alias("how"), F.col("vec")[1].cast("double").alias("step"), F.col("vec")[2].cast("double").alias("code"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "step", "code", digits=4)


@query("""select o_orderkey::varchar as doc_id, o_orderpriority as value, round(1 / (1 + exp(-(0.1 * length(o_orderpriority) - 0.5 * length(regexp_replace(o_orderpriority, '[^0-9]', '', 'g')) + 0.01 * 7 - 0.2))), 9) as p from orders""")
def pol_reembed(spark, d):
    """Candidates scored by vectors of their own, from a stub of the model."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("p").alias("path_str"), F.col("o_orderpriority").alias("value"))
    weights = spark.createDataFrame([(7, [0.1, -0.5, 0.01], -0.2)], "layer int, beta array<double>, bias double")
    return rounded(hooks.reembedded(rows, hooks.StubEmbedder, weights, 7).select("doc_id", "value", "p"), "p")


@query("""with t as (select p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_brand), ' '), lambda x: x <> '')) as a, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) as b from part)
select p_partkey, round(len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))), 9) as share, len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) >= 0.5 as same from t""")
def set_jaccard(spark, d):
    a, b = X.tokens(F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit("_")))), X.tokens(F.concat_ws(" ", "p_name", "p_type"))
    rows = table(spark, d, "part").select("p_partkey", X.jaccard(a, b).alias("share"))
    return rounded(rows.withColumn("same", F.col("share") >= 0.5), "share")


@query("select date_trunc('hour', ts)::varchar as start, 'd' || (user_id % 3) as domain, count(*) as n_total, count(*) filter (event_type = 'error') as n_errors from events group by all")
def stream_error_rates(spark, d):
    """Events arriving in four files, counted by the hour as they come."""
    source, out, check = (work_folder(spark, n) for n in ("arrivals", "rates", "checks"))
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("arrived"), F.concat(F.lit("d"), F.col("user_id") % 3).alias("domain"), (F.col("event_type") == "error").cast("int").alias("is_error"))
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    rates = streaming.error_rates(stream, late=None).writeStream.outputMode("complete").option("checkpointLocation", check)
    rates.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("string").alias("start"), "domain", "n_total", "n_errors")


REGEN = """rc as (select c_custkey, c_name, c_mktsegment from customer where c_custkey % 9 > 0),
rv as (select c_custkey, 'name' as path_str, '"' || c_name || '"' as new_value, '"' || c_name || '"' as raw from rc union all select c_custkey, 'seg', '"' || c_mktsegment || '"', c_mktsegment from rc union all select c_custkey, 'n', c_custkey::varchar, '`' || c_custkey || '`' from rc)"""


def answerer():
    """A model that looks the blank field up in the document and answers in JSON, bare, or between back-ticks."""
    import re

    class Reader:
        def generate(self, prompts):
            for _, user in prompts:
                key, document = (re.search(rf"# {head}\n+(.*)\n", user)[1] for head in ("Blank field", "Document"))
                value = dict(x.split("=", 1) for x in document.split("|"))[key]
                text = {"name": f'"{value}"', "n": f"`{value}` "}.get(key, value)
                yield text, [text], [-1.0], "stop"

    return Reader


def doubtful(spark, d):
    """Three fields a customer, and documents, of which every ninth has no text."""
    c = table(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 9 > 0, F.concat(F.lit("name="), "c_name", F.lit("|seg="), "c_mktsegment", F.lit("|n="), "c_custkey"))
    schema = '{"properties": {"name": {"type": "string"}, "seg": {"type": "string"}, "n": {"type": "integer"}}}'
    documents = c.select(F.col("c_custkey").cast("string").alias("doc_id"), text.alias("text"), F.lit(schema).alias("schema"), F.when(F.col("c_custkey") % 2 == 0, '{"name": "x"}').alias("parsed"))
    paths = F.explode(F.array(*map(F.lit, ["name", "seg", "n"])))
    return c.select(F.col("c_custkey").cast("string").alias("doc_id"), paths.alias("path_str"), ((F.col("c_custkey") % 10) / 10).alias("probe_score")), documents


@query(f"with {REGEN} select c_custkey::varchar as doc_id, path_str, case when path_str = 'seg' and c_custkey % 4 = 0 then 'old' else new_value end as new_value, case when path_str = 'seg' and c_custkey % 4 = 0 then 'old' else raw end as raw from rv")
def regen_sweep(spark, d):
    """Prompts, answers, values and the cache, some of which a run before had filled; in two lots."""
    from veritrail.operators import regenerate
    from veritrail.sinks.commits import Committed

    candidates, documents = doubtful(spark, d)
    path = work_folder(spark, "sweep")
    old = candidates.join(documents.where("text is not null").select("doc_id"), "doc_id").where("path_str = 'seg' and doc_id % 4 = 0")
    Committed(spark, path, ["doc_id", "path_str"]).append(old.select("doc_id", "path_str", F.lit("old").alias("new_value"), F.lit("old").alias("raw")))
    return regenerate.sweep(candidates, documents, answerer(), path, lots=2)


@query(f"""with {REGEN} select c_custkey::varchar as doc_id, path_str, idx::int as idx, new_value as value, round(1 / (1 + exp(-(0.1 * length(new_value) - 0.5 * length(regexp_replace(new_value, '[^0-9]', '', 'g')) + 0.01 * 7 - 0.2))), 9) as p
from rv, range(0, 2) r(idx) where c_custkey % 10 >= 5""")
def regen_samples(spark, d):
    """Flagged fields asked for twice, each answer scored by its own vector."""
    from veritrail.operators import regenerate

    weights = spark.createDataFrame([(7, [0.1, -0.5, 0.01], -0.2)], "layer int, beta array<double>, bias double")
    out = regenerate.sampled(*doubtful(spark, d), answerer(), hooks.StubEmbedder, weights, 7, n=2)
    return rounded(out.select("doc_id", "path_str", "idx", "value", "p"), "p")


@query("""with a as (select user_id as doc_id, event_id as attempt, event_id // ((select max(event_id) from events) // 3 + 1) as lot, event_type = 'click' as ok, value from events),
b as (select *, max(attempt) over (partition by doc_id) as m from a), r as (select doc_id, attempt, lot, ok, value from a union all select doc_id, attempt, lot + 1, true, -1.0 from a where attempt % 3 = 0 and lot < 2),
n as (select *, coalesce(max(attempt) over (partition by doc_id order by lot range between unbounded preceding and 1 preceding), -1) as newest from r), k as (select distinct doc_id, attempt, lot, ok, value, newest from n where attempt > newest),
c as (select *, row_number() over (partition by doc_id order by lot, attempt) as nth from k), f as (select *, row_number() over (partition by doc_id order by nth) as r from c where ok)
select doc_id, 'good' as verdict, nth::int as attempts, value from f where r = 1""")
def stream_retries(spark, d):
    """Attempts in three lots as they arrive, each lot after the first with a third of the one before again, as if it were good."""
    import time

    from veritrail.streaming import retries

    e = table(spark, d, "events")
    most = e.agg(F.max("event_id")).first()[0]
    rows = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("attempt"), F.col("ts").cast("timestamp").alias("arrived"), (F.col("event_type") == "click").alias("ok"), "value", F.floor(F.col("event_id") / (most // 3 + 1)).alias("lot"))
    again = rows.where("attempt % 3 = 0 and lot < 2").select("doc_id", "attempt", "arrived", F.lit(True).alias("ok"), F.lit(-1.0).alias("value"), (F.col("lot") + 1).alias("lot"))
    path, kind = work_folder(spark, "attempts"), rows.drop("lot").schema
    for lot in range(3):
        rows.unionByName(again).where(F.col("lot") == lot).drop("lot").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)  # files are taken in the order of their times
    out = work_folder(spark, "settled")
    found = retries.settled(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path), patience="3650 days", late="3650 days")
    found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", work_folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
