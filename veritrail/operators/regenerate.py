"""Doubtful fields asked for again: prompts from documents and what was read of them, a model's answers, values read from answers,
in a cache that a run goes on from. Models are given by the caller (hooks)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions import expressions as X
from veritrail.functions import model_text as M
from veritrail.operators import hooks
from veritrail.operators.fields import FIELD
from veritrail.sinks import tables

#: Characters of an answer that are kept as they came.
RAW = 200


def correction_prompts(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """candidates (doc_id, path_str, ...) with system and user prompts that ask for the field with its record at hand. documents:
    (doc_id, text, schema, parsed), JSON of the schema and of what was read, null for nothing; candidates of documents
    without text are left out. A text meets its fields only where their prompts are made."""
    some = documents.where("text is not null and text <> ''").select("doc_id", "text", "schema", F.coalesce("parsed", F.lit("{}")).alias("parsed"))
    rows = candidates.join(some, "doc_id").withColumn("_p", M.correction_prompts("text", "parsed", "schema", "path_str"))
    return rows.select(*candidates.columns, "_p.system", "_p.user")


def answered(prompts: DataFrame, factory: Callable[[], hooks.Generator]) -> DataFrame:
    """prompts with new_value, JSON of the value in the model's answer, and raw, the beginning of the answer."""
    out = hooks.generated(prompts, factory).withColumn("_t", X.strip(F.coalesce("text", F.lit(""))))
    rest = [c for c in prompts.columns if c not in ("system", "user")]
    return out.select(*rest, M.parsed_value("_t").alias("new_value"), F.substring("_t", 1, RAW).alias("raw"))


def sweep(candidates: DataFrame, documents: DataFrame, factory: Callable[[], hooks.Generator], path: str, lots: int = 1) -> DataFrame:
    """The cache at path, (doc_id, path_str, new_value, raw), after every candidate that it lacked has been asked for, one answer a
    field. Lots are committed one by one, so a run that stops goes on from its last one."""
    todo = candidates.select(*FIELD).distinct()
    return tables.resume(todo, path, lambda rows: answered(correction_prompts(rows, documents), factory), lots)


def sampled(candidates: DataFrame, documents: DataFrame, factory: Callable[[], hooks.Generator], embedder: Callable[[], hooks.Embedder], weights: DataFrame, layer: int, n: int = 3, flag: float = 0.5) -> DataFrame:
    """candidates (doc_id, path_str, probe_score, ...) that the probe flags, each with n answers: idx, value (JSON) and p, the probe's
    score of that value's own vector; as policies.select_candidates takes them."""
    flagged = candidates.where(F.col("probe_score") >= flag)
    rows = correction_prompts(flagged, documents).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return hooks.reembedded(answered(rows, factory).withColumnRenamed("new_value", "value").drop("raw"), embedder, weights, layer)
