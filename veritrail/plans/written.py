"""Queries of sinks: each writes under the folder that all machines share and returns what it reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators import fields
from veritrail.plans import base
from veritrail.plans.base import LABELS, PROBE, VECTORS, query, rounded, table
from veritrail.plans.fieldwork import CACHE, KINDS, RUNS, SUMMARY, cache, runs, two_runs
from veritrail.sinks import tables
from veritrail.sinks.commits import Committed
from veritrail.sinks.workspace import work_folder


@query(f"with {RUNS} select doc_id, domain, finish_reason, round(elapsed_seconds, 3) as elapsed_seconds from xd")
def sink_extraction(spark, d):
    path = work_folder(spark, "extractions")
    tables.write_extractions(runs(spark, d)[0], path)
    return spark.read.parquet(path).select("doc_id", "domain", "finish_reason", "elapsed_seconds")


@query(f"with {VECTORS} select doc_id, path_str, layer, len(vec)::int as n, round(vec[1]::double, 6) as first from act where layer = 2")
def sink_activation(spark, d):
    path = work_folder(spark, "activations")
    tables.write_activations(base.activations(spark, d), path)
    return spark.read.parquet(path).where("layer = 2").select("doc_id", "path_str", "layer", F.size("vec").alias("n"), F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@query(f"with {RUNS}, p as (select doc_id, count(*) as n, count(*) filter (is_empty) as empty from xf group by doc_id), s as (select {SUMMARY} from xd left join p using (doc_id)) select xd.doc_id, xd.parse_error is null and coalesce(p.n, 0) > 0 as is_success, coalesce(p.n, 0) as fields_extracted, s.*, (select round(sum(elapsed_seconds), 1) from xd) as total_elapsed_seconds from xd left join p using (doc_id), s")
def sink_extract_summary(spark, d):
    """A row a document, with the sums over all."""
    return tables.extraction_report(*runs(spark, d)).drop("domain", "finish_reason", "generated_tokens", "elapsed_seconds", "parse_error")


@query(f"with {LABELS} select doc_id, count(*) as n_total, sum(is_error)::bigint as n_errors, string_agg(path_str, ' ' order by pos) as paths from lab group by doc_id, domain")
def sink_labels(spark, d):
    """Labels by domain, read again a document a row."""
    path = work_folder(spark, "labels")
    tables.write_labels(base.labels(spark, d).drop("k", "score"), path)
    back = tables.label_documents(spark.read.parquet(path))
    return back.select("doc_id", "n_total", "n_errors", F.array_join(F.transform("labels", lambda x: x["path_str"]), " ").alias("paths"))


@query(f"with {LABELS} select doc_id, {KINDS.replace('9) as error_rate', '3) as error_rate')} from lab group by grouping sets ((doc_id), ())")
def sink_label_summary(spark, d):
    path = work_folder(spark, "summary")
    tables.write_results(tables.label_summary(base.labels(spark, d)), path, files=None)
    kinds = "doc_id string, n_total long, n_errors long, n_hallucinations long, n_omissions long, n_value_mismatches long, n_type_mismatches long, error_rate double"
    return spark.read.schema(kinds).json(path)


@query("select layer::int as layer, 0.25::double * layer as bias, 32 as n, layer = 2 as best from range(1, 3) r(layer)")
def sink_probes(spark, d):
    """Weights a layer, and which of them a run goes on with."""
    back = tables.write_probes(base.weights(spark).withColumn("auroc", F.col("layer") / 10.0), work_folder(spark, "probes"))
    best = tables.best_probe(back).select(F.col("layer").alias("_b"))
    return back.crossJoin(F.broadcast(best)).select("layer", "bias", F.size("beta").alias("n"), (F.col("layer") == F.col("_b")).alias("best"))


@query(f"with {VECTORS}, {PROBE} select layer, count(*) as n, round(avg(p), 6) as mean from ps group by layer")
def sink_results(spark, d):
    from veritrail.operators import probes

    path = work_folder(spark, "results")
    p = probes.full_set_scores(base.activations(spark, d), base.weights(spark))
    tables.write_results(rounded(p.groupBy("layer").agg(F.count("*").alias("n"), F.avg("p").alias("mean")), "mean", digits=6), path)
    return spark.read.schema("layer int, n long, mean double").json(path)


@query(f"with {LABELS}, pl as (select 'a' as source, * from lab where score < 40 union all select 'b', * from lab where score between 30 and 60) select source, count(*) filter (not (source = 'a' and k % 7 = 1)) as kept, count(*) filter (source = 'a' and k % 7 = 1) as dropped, (select count(*) from pl q where q.source = pl.source) as activations from pl group by source")
def sink_pool_copy(spark, d):
    """Labels of two runs without a leaf of one, and what belongs to their documents."""
    path, both = work_folder(spark, "pool"), two_runs(spark, d)
    sources = {name: {"labels": lab, "activations": lab.select("doc_id", "path_str", F.col("score").alias("v"))} for name, lab in both.items()}
    counts = tables.write_pool(sources, spark.createDataFrame([("a", "f1")], "source string, leaf string"), path)
    acts = spark.read.parquet(f"{path}/activations").groupBy("source").agg(F.count("*").alias("activations"))
    return counts.join(acts, "source")


@query(f"with {LABELS}, {CACHE} select 'old' as made, doc_id, path_str from ch union all select 'new', doc_id, path_str from lab where (doc_id, path_str) not in (select (doc_id, path_str) from ch)")
def sink_cache(spark, d):
    """A cache that a second run goes on from, in three lots, and a third finds whole."""
    path = work_folder(spark, "cache")
    Committed(spark, path, fields.FIELD).append(fields.split_key(cache(spark, d)).select(F.lit("old").alias("made"), *fields.FIELD))
    todo = base.labels(spark, d).select(*fields.FIELD)
    work = lambda rows: rows.select(F.lit("new").alias("made"), *fields.FIELD)
    tables.resume(todo, path, work, lots=3)
    return tables.resume(todo, path, work)


@query("select n_regionkey, count(*) as n from nation group by n_regionkey")
def sink_logs(spark, d):
    """What a logger's file holds after two set-ups: each message once."""
    import glob
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # the driver's own log
        tables.log_to(folder)
        log = tables.log_to(folder)
        log.handlers[0].setLevel("CRITICAL")
        for r in table(spark, d, "nation").select("n_regionkey").collect():  # twenty-five nations
            log.info("region %s", r[0])
        for h in log.handlers:
            h.flush()
        lines = [x.rstrip("\n").rsplit(" ", 1)[-1] for p in sorted(glob.glob(f"{folder}/*.log"))[-1:] for x in open(p, encoding="utf-8")]
        for h in list(log.handlers):
            log.removeHandler(h)
            h.close()
    return spark.createDataFrame([(int(x),) for x in lines], "n_regionkey int").groupBy("n_regionkey").agg(F.count("*").alias("n"))
