"""Tables and files that runs write: extractions, activations, labels, probes, results, pools, caches that a run goes on from, logs.

A write is a job: what its tasks committed stands, a task that is lost is run again. Folders are given by the caller.
"""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.operators import fields, reports
from veritrail.sinks.commits import Committed


def write_extractions(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Documents with their fields, a folder a domain; seconds to three places."""
    rows.withColumn("elapsed_seconds", F.round("elapsed_seconds", 3)).write.mode(mode).partitionBy("domain").parquet(path)


def write_activations(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors as arrays of floats, a folder a layer, so that a probe's scan reads one."""
    rows.withColumn("vec", F.col("vec").cast("array<float>")).write.mode(mode).partitionBy("layer").parquet(path)


def write_labels(labels: DataFrame, path: str, mode: str = "append") -> None:
    labels.write.mode(mode).partitionBy("domain").parquet(path)


def label_documents(labels: DataFrame) -> DataFrame:
    """A row a document: its counts, and its labels in order."""
    counts = reports.label_counts(labels, ["doc_id"]).drop("error_rate")
    rest = [c for c in labels.columns if c not in ("doc_id", "domain", "pos")]
    lists = labels.groupBy("doc_id").agg(F.max("domain").alias("domain"), F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("labels"))  # one document's fields
    return counts.join(lists, "doc_id")


def label_summary(labels: DataFrame) -> DataFrame:
    """(doc_id, counts, error_rate to three places), and the sums over all documents, whose doc_id is null."""
    per = reports.label_counts(labels, ["doc_id"])
    whole = reports.label_counts(labels, []).withColumn("doc_id", F.lit(None).cast(labels.schema["doc_id"].dataType))
    return per.unionByName(whole).withColumn("error_rate", F.round("error_rate", 3))


def extraction_report(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """What became of each document, a row a document, with the sums over all (reports.extraction_summary) beside it."""
    per = docs.join(extracted.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("fields_extracted", F.coalesce("n", F.lit(0)))
    done = F.col("parse_error").isNull() & (F.col("fields_extracted") > 0)
    each = per.select("doc_id", "domain", done.alias("is_success"), "finish_reason", "generated_tokens", "fields_extracted", F.round("elapsed_seconds", 2).alias("elapsed_seconds"), "parse_error")
    whole = reports.extraction_summary(docs, extracted).crossJoin(docs.agg(F.round(F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0)), 1).alias("total_elapsed_seconds")))
    return each.crossJoin(F.broadcast(whole))  # one row


def write_probes(probes: DataFrame, path: str) -> DataFrame:
    """A row a layer; returns what was written."""
    probes.write.mode("overwrite").parquet(path)
    return probes.sparkSession.read.parquet(path)


def best_probe(probes: DataFrame, metric: str = "auroc") -> DataFrame:
    """The layer of the best metric, the lowest on ties; null and NaN come last."""
    score = F.coalesce(F.nanvl(F.col(metric), F.lit(-1.0)), F.lit(-1.0))
    return probes.orderBy(score.desc(), "layer").limit(1)


def write_results(rows: DataFrame, path: str, files: int | None = 1) -> None:
    """A report as JSON lines: in one file, as reports are small; with files=None in as many as there are tasks, for one that has a
    row a document."""
    (rows if files is None else rows.coalesce(files)).write.mode("overwrite").json(path)


def write_pool(sources: dict[str, dict[str, DataFrame]], dropped: DataFrame, path: str, allow: DataFrame | None = None) -> DataFrame:
    """labels, activations and extractions of several runs as one, without dropped leaves. Returns (source, kept, dropped)."""
    labels = {name: parts["labels"] for name, parts in sources.items()}
    kept = fields.pooled(labels, dropped, allow)
    kept.write.mode("overwrite").parquet(f"{path}/labels")
    kept = kept.sparkSession.read.parquet(f"{path}/labels")
    for part in ("activations", "extractions"):
        out = None
        for name, parts in sources.items():
            if part in parts:
                rows = fields.of_documents(parts[part], kept.where(F.col("source") == name).select("doc_id").distinct()).withColumn("source", F.lit(name))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is not None:
            out.write.mode("overwrite").parquet(f"{path}/{part}")
    whole = fields.pooled(labels, dropped.limit(0), allow).groupBy("source").agg(F.count("*").alias("n"))
    return whole.join(kept.groupBy("source").agg(F.count("*").alias("kept")), "source", "left").select("source", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def resume(todo: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], lots: int = 1) -> DataFrame:
    """The cache at path (doc_id, path_str, ...) after work(rows) has been done for what of todo it lacks, committed lot by lot, so that
    a run which stops goes on from its last lot, and runs side by side keep one result a field (`Committed`). Lots are by a
    hash of the field. work gives a row a field, with doc_id and path_str. An empty cache of nothing to do is todo's fields."""
    held = Committed(todo.sparkSession, path, fields.FIELD)
    for lot in range(lots):
        seen = held.version()
        rows, cache = todo.where(F.pmod(F.xxhash64(*fields.FIELD), F.lit(lots)) == lot), held.read(0, seen)
        if cache is not None:
            rows = rows.join(cache.select(*fields.FIELD), fields.FIELD, "left_anti")
        held.append(work(rows), seen)
    return held.read()


def log_to(path: str | None = None, name: str = "run", level: str = "INFO") -> logging.Logger:
    """The library's logger, to the console and to a file named after the time in the folder path; calling it again replaces both."""
    log = logging.getLogger("veritrail")
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        os.makedirs(path, exist_ok=True)
        handlers.append(logging.FileHandler(f"{path}/{name}_{time.strftime('%Y%m%d_%H%M%S')}.log", encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    log.setLevel(level)
    log.propagate = False
    return log
