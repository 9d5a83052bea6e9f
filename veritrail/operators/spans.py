"""Reduction of the token vectors of a span: the last one, their mean, or all of them.

Spans are (doc, span, first, past, generated), half-open in generated tokens; tokens are (doc, layer, step, vec).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOW = ("last", "mean", "all")


def clamped(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc, layer, span, lo, hi): spans cut to the generated tokens, one at least, then to the steps a layer has, since the
    last token may lack one. Spans of documents without tokens and spans outside a layer's steps are left out."""
    have = tokens.groupBy("doc", "layer").agg((F.max("step") + 1).alias("have"))
    lo = F.greatest(F.lit(0), F.least(F.col("first"), F.col("generated") - 1))
    cut = spans.withColumn("lo", lo).withColumn("hi", F.greatest(F.col("lo") + 1, F.least("past", "generated"))).join(have, "doc")
    return cut.select("doc", "layer", "span", F.least(F.col("lo"), F.col("have") - 1).alias("lo"), F.least("hi", "have").alias("hi")).where("lo < hi")


def starts(pieces: DataFrame, group: list[str], order: str, text: str = "text") -> DataFrame:
    """pieces with start: where each begins in the text that its group's pieces make in their order."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("start", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)))


def reduce_spans(spans: DataFrame, tokens: DataFrame, how: str) -> DataFrame:
    """(doc, span, layer, step, pos, value) of every span and layer; step is null for means."""
    if how not in HOW:
        raise ValueError(how)
    inside = tokens.join(clamped(spans, tokens), ["doc", "layer"]).where("step >= lo and step < hi")
    if how == "last":
        inside = inside.where("step = hi - 1")
    flat = inside.select("doc", "span", "layer", "step", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))
    if how == "mean":
        flat = flat.groupBy("doc", "span", "layer", "pos").agg(F.avg("value").alias("value")).withColumn("step", F.lit(None).cast(tokens.schema["step"].dataType))
    return flat.select("doc", "span", "layer", "step", "pos", "value")
