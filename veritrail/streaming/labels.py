"""Labels of extractions as they arrive: an extension, for runs whose models write while others wait.

Each micro-batch is labelled and appended under its number, so that a batch which is replayed after a crash replaces what it
had written. Documents that come twice are dropped by a watermark on their arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritrail.operators import trees


def once(arrivals: DataFrame, late: str = "1 day") -> DataFrame:
    """arrivals(doc_id, arrived, ...) without repeats of a document within `late` of each other; state is kept that long."""
    return arrivals.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["doc_id"])


def error_rates(labels: DataFrame, window: str = "1 hour", late: str | None = "1 day") -> DataFrame:
    """(window, domain, n_total, n_errors) of a stream of labels(domain, arrived, is_error); late is None where the stream has a
    watermark already."""
    rows = labels if late is None else labels.withWatermark("arrived", late)
    return rows.groupBy(F.window("arrived", window), "domain").agg(F.count("*").alias("n_total"), F.sum(F.col("is_error").cast("long")).alias("n_errors"))


def label_stream(extractions: DataFrame, gold: DataFrame, path: str, checkpoint: str, once_only: bool = True) -> StreamingQuery:
    """Labels of a stream of extractions (doc_id, extracted) with gold (doc_id, schema, gold), under path, a folder a batch. With
    once_only it ends when what is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        pairs = batch.select("doc_id", "extracted").join(gold, "doc_id")
        trees.label_trees(pairs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = extractions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once_only else out).start()
