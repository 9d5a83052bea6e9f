"""Counts that say how a run went: labels, extractions, fixability, coverage, causes, outcomes. All are grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import expressions as X
from veritrail.operators.fields import gold_in_text, gold_in_texts
from veritrail.operators.ranges import spread

ERRORS = {"hallucination": "n_hallucinations", "omission": "n_omissions", "value_mismatch": "n_value_mismatches", "type_mismatch": "n_type_mismatches"}


def label_counts(labels: DataFrame, group: list[str]) -> DataFrame:
    """group, n_total, n_errors, a count for each kind of error, and error_rate (0 without labels)."""
    kinds = [F.count_if(F.col("error_type") == k).alias(n) for k, n in ERRORS.items()]
    out = labels.groupBy(*group).agg(F.count("*").alias("n_total"), F.coalesce(F.sum(F.col("is_error").cast("long")), F.lit(0)).alias("n_errors"), *kinds)
    return out.withColumn("error_rate", F.coalesce(F.try_divide("n_errors", "n_total"), F.lit(0.0)))


def label_summary(labels: DataFrame) -> DataFrame:
    """One row over all documents, with their number."""
    docs = labels.agg(F.count_distinct("doc_id").alias("n_documents"))
    return label_counts(labels, []).crossJoin(docs)


def extraction_summary(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """One row of docs (doc_id, parse_error, finish_reason, generated_tokens) and their fields (doc_id, is_empty). A document
    succeeds if it parsed and has a field; one without text counts as a parse failure too."""
    per = fields.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("is_empty").alias("empty"))
    rows = docs.join(per, "doc_id", "left")
    error = F.col("parse_error")
    return rows.agg(
        F.count("*").alias("total_documents"), F.count_if(error.isNull() & (F.coalesce("n", F.lit(0)) > 0)).alias("successful"), F.count_if(error.isNotNull()).alias("parse_failed"),
        F.count_if(F.contains(error, F.lit("document has no text"))).alias("skipped_no_text"), F.count_if(F.col("finish_reason") == "length").alias("finish_length_truncated"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_fields_extracted"), F.coalesce(F.sum("empty"), F.lit(0)).alias("total_empty_fields"), F.coalesce(F.sum(F.col("generated_tokens").cast("long")), F.lit(0)).alias("total_generated_tokens"),
    )


def fixability(labels: DataFrame, texts: DataFrame, longest: int = X.LONG_TEXT, entities: bool = True) -> DataFrame:
    """Errors with gold_in_text (a fixable error's gold stands in the document) and method."""
    found = gold_in_text(labels.where("is_error = 1"), texts, longest, entities)
    return found.withColumnRenamed("present", "gold_in_text")


def findable(fields: DataFrame, texts: DataFrame, longest: int = X.LONG_TEXT, entities: bool = True) -> DataFrame:
    """As gold_in_text; no_text where a document has none."""
    found = gold_in_text(fields, texts, longest, entities)
    return found.withColumn("method", F.when(F.col("method") == "doc_text_unavailable", "no_text").otherwise(F.col("method")))


def fixability_counts(found: DataFrame) -> DataFrame:
    """(method, n, n_fixable), most frequent first."""
    return found.groupBy("method").agg(F.count("*").alias("n"), F.count_if("gold_in_text").alias("n_fixable")).orderBy(F.desc("n"), "method")


def coverage(fields: DataFrame, texts: DataFrame, longest: int = X.LONG_TEXT, entities: bool = True) -> DataFrame:
    """(domain, method, total, n_non_empty, in_text, rate) over domains, methods and all: null is any. Empty gold counts in
    total but not in n_non_empty; rate is in_text of total, null without fields."""
    found = gold_in_text(fields, texts, longest, entities)
    out = found.groupingSets([["domain"], ["method"], []], "domain", "method").agg(F.count("*").alias("total"), F.count_if(F.col("method") != "empty_gold").alias("n_non_empty"), F.count_if("present").alias("in_text"))
    return out.withColumn("rate", F.try_divide("in_text", "total"))


def causes(labels: DataFrame, first: DataFrame, second: DataFrame, longest: int = X.LONG_TEXT, entities: bool = True) -> DataFrame:
    """Errors with methods and presence under two parsers' texts, and the bucket of their cause."""
    errors = gold_in_texts(labels.where("is_error = 1"), {"first": first, "second": second}, longest, entities)
    named = lambda n: F.when(F.col(n) == "doc_text_unavailable", "no_text").otherwise(F.col(n))
    errors = errors.withColumns({f"method_{n}": named(f"method_{n}") for n in ("first", "second")})
    errors = errors.withColumnsRenamed({f"{a}_{n}": f"in_{n}" if a == "present" else f"{n}_method" for n in ("first", "second") for a in ("present", "method")})
    return spread(errors).withColumn("bucket", X.classify(F.col("gold_value"), F.col("extracted_value"), F.col("in_first"), F.col("in_second")))


def bucket_counts(caused: DataFrame) -> DataFrame:
    return caused.groupBy("bucket").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "bucket")


def outcome(was_error: Column, now_ok: Column) -> Column:
    return F.when(was_error & now_ok, "fixed").when(~was_error & ~now_ok, "broke").when(was_error, "still_wrong").otherwise("kept_ok")


def outcomes(rows: DataFrame, mode: str = "strict") -> DataFrame:
    """rows (path_str, gold_value, is_error, new_value) with outcome and delta; leniently only those whose gold can be scored."""
    if mode == "lenient":
        rows = rows.where(X.scorable(F.col("path_str"), F.col("gold_value")))
    judged = spread(rows).withColumn("_ok", X.ok(F.col("gold_value"), F.col("new_value"), mode))  # once: it is dear
    return judged.withColumn("outcome", outcome(F.col("is_error") == 1, F.col("_ok"))).drop("_ok").withColumn("delta", (F.col("outcome") == "fixed").cast("int") - (F.col("outcome") == "broke").cast("int"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("fixed", "broke", "still_wrong", "kept_ok")], F.count("*").alias("n"))


def gold_of_errors(labels: DataFrame) -> DataFrame:
    """One row: labels, errors, and errors whose gold is null or not."""
    error, none = F.col("is_error") == 1, F.col("gold_value").isNull()
    return labels.agg(F.count("*").alias("n_labels"), F.count_if(error).alias("n_errors"), F.count_if(error & none).alias("gold_none"), F.count_if(error & ~none).alias("gold_present"))


def span_lengths(spans: DataFrame, group: list[str]) -> DataFrame:
    """group, n_fields, share of spans of one token at most, and their median length."""
    n = F.greatest(F.col("past") - F.col("start"), F.lit(0))
    return spans.groupBy(*group).agg(F.count("*").alias("n_fields"), F.avg((n <= 1).cast("double")).alias("single_share"), F.percentile(n, 0.5).alias("median_span"))


def vector_shapes(activations: DataFrame) -> DataFrame:
    """(kind, n, mean, median, most, least, n_multi): vectors (vec) and arrays of token vectors (tokens) with their lengths."""
    n = F.size("tokens")
    return activations.groupBy(F.when(F.col("tokens").isNotNull(), 2).otherwise(1).alias("ndim")).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("tokens").isNotNull(), n)).alias("mean"), F.percentile(F.when(F.col("tokens").isNotNull(), n), 0.5).alias("median"),
        F.max(F.when(F.col("tokens").isNotNull(), n)).alias("most"), F.min(F.when(F.col("tokens").isNotNull(), n)).alias("least"), F.count_if(F.col("tokens").isNotNull() & (n > 1)).alias("n_multi"),
    )


def token_class(token: Column) -> Column:
    """whitespace, structural (marks of JSON alone) or content."""
    t = X.strip(token)
    return F.when(t == "", "whitespace").when(t.rlike(r'^["{}\[\],:]+$'), "structural").otherwise("content")


def token_classes(fields: DataFrame, most: int = 600) -> DataFrame:
    """(place, kind, n): of the first `most` fields in order of document and field (doc_id, pos, tokens, past; not empty, their
    end within the tokens), the kinds of the last token of the span and of the one after it, where there is one."""
    inside = fields.where((F.col("past") > 0) & (F.col("past") <= F.size("tokens"))).orderBy("doc_id", "pos").limit(most)
    both = F.array(F.struct(F.lit("last").alias("place"), F.get("tokens", F.col("past") - 1).alias("t")), F.struct(F.lit("after").alias("place"), F.get("tokens", F.col("past")).alias("t")))
    rows = inside.select(F.explode(both).alias("x")).where("x.t is not null")
    return rows.groupBy("x.place", token_class(F.col("x.t")).alias("kind")).count().withColumnRenamed("count", "n")


def key_agreement(pairs: DataFrame, truncated: Column | None = None) -> DataFrame:
    """pairs (doc_id, expected, got: arrays of key paths) with matched, missing, extra (sorted), overlap and a verdict: green if nine in
    ten expected keys are there and no others, amber with others, red below; inconclusive where output was cut off and
    keys are missing but none is other."""
    e, g = F.array_distinct("expected"), F.array_distinct("got")
    out = pairs.withColumn("matched", F.array_sort(F.array_intersect(e, g))).withColumn("missing", F.array_sort(F.array_except(e, g))).withColumn("extra", F.array_sort(F.array_except(g, e)))
    overlap = F.size("matched") / F.greatest(F.size(e), F.lit(1))
    cut = (F.lit(False) if truncated is None else truncated) & (F.size("missing") > 0) & (F.size("extra") == 0)
    verdict = F.when(cut, "inconclusive").when(F.col("overlap") < 0.9, "red").when(F.size("extra") > 0, "amber").otherwise("green")
    return out.withColumn("overlap", overlap).withColumn("verdict", verdict)
