"""Checks of an annotated collection before anything is learned from it. Documents are (doc_id, split, text), spans (doc_id,
pos, label, start, end, text); a span's end is exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.operators.ranges import running

# What looks like a date or an amount in a text; words of labels that are about either.
DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b"
MONEY = r"\$\s?\d[\d,]*(?:\.\d{2})?"
DATE_WORDS, MONEY_WORDS = ("date",), ("rate", "amount", "total", "commission")
#: Characters of a piece of a text: a place in a text is found by its piece, not from the text's beginning.
PIECE = 256


def document_counts(docs: DataFrame) -> DataFrame:
    """(split, n) and their sum, whose split is null."""
    return docs.rollup("split").agg(F.count("*").alias("n"))


def label_names(spans: DataFrame) -> DataFrame:
    return spans.where("label is not null and label <> ''").select("label").distinct()


def density(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(label, n_spans, empty_share, least, median, most, flat): spans a document, over documents that have any; flat if
    each of those has one. Documents without a label's spans are counted, not made."""
    per = spans.where("label <> ''").groupBy("label", "doc_id").agg(F.count("*").alias("n"))
    total = F.broadcast(docs.agg(F.count("*").alias("of")))
    out = per.groupBy("label").agg(F.sum("n").alias("n_spans"), F.count("*").alias("populated"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most")).crossJoin(total)
    return out.select("label", "n_spans", (1 - F.try_divide("populated", "of")).alias("empty_share"), "least", "median", "most", ((F.col("least") == 1) & (F.col("most") == 1)).alias("flat"))


def offsets(docs: DataFrame, spans: DataFrame, first: int | None = 60) -> DataFrame:
    """One row: spans checked and those whose place in the text says something else, in the first documents by id; None: all.
    A text is cut to pieces once, so that a span costs what its own pieces cost, however long the text is."""
    some = docs if first is None else docs.orderBy("doc_id").limit(first)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces")
    rows = spans.where("start is not null and end is not null and text is not null").join(some.select("doc_id", pieces), "doc_id")
    start, size = F.col("start"), F.greatest(F.col("end") - F.col("start"), F.lit(0))
    first_, last = F.call_function("div", start, F.lit(PIECE)).cast("int"), F.call_function("div", start + size, F.lit(PIECE)).cast("int")
    near = F.array_join(F.slice("pieces", first_ + 1, last - first_ + 1), "")
    there = F.when(start >= 0, F.substring(near, start - first_ * PIECE + 1, size)).otherwise(F.substring(F.array_join("pieces", ""), start + 1, size))
    return rows.agg(F.count("*").alias("checked"), F.count_if(there != F.col("text")).alias("mismatched"))


def under_annotation(docs: DataFrame, spans: DataFrame, date: str = DATE, money: str = MONEY) -> DataFrame:
    """(kind, in_text, in_gold, ratio): what looks like dates and amounts in all texts against spans of such labels; the ratio
    is infinite without spans. A label about dates is not about money."""
    about = lambda words: F.col("label").rlike("(?i)" + "|".join(words))
    text = docs.agg(*[F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0)).alias(k) for k, p in (("dates", date), ("money", money))])
    gold = spans.agg(F.count_if(about(DATE_WORDS)).alias("gold_dates"), F.count_if(~about(DATE_WORDS) & about(MONEY_WORDS)).alias("gold_money"))
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("in_text"), F.col(f"gold_{k}").alias("in_gold")) for k in ("dates", "money")]))
    rows = text.crossJoin(gold).select(both.alias("x")).select("x.*")
    return rows.withColumn("ratio", F.when(F.col("in_gold") == 0, F.lit(float("inf"))).otherwise(F.col("in_text") / F.col("in_gold")))


def document_coverage(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(n_labels, n_docs, of, coverage): documents by the number of labels they have spans of, from none to all of them; coverage
    is full, some or none."""
    of = label_names(spans).agg(F.count("*").cast("int").alias("of"))
    per = spans.where("label <> ''").groupBy("doc_id").agg(F.count_distinct("label").cast("int").alias("n_labels"))
    found = docs.select("doc_id").join(per, "doc_id", "left").groupBy(F.coalesce("n_labels", F.lit(0)).alias("n_labels")).agg(F.count("*").alias("n_docs"))
    grid = of.select("of", F.explode(F.sequence(F.lit(0), F.col("of"))).alias("n_labels"))
    kind = F.when(F.col("n_labels") == F.col("of"), "full").when(F.col("n_labels") == 0, "none").otherwise("some")
    return grid.join(found, "n_labels", "left").select("n_labels", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "of", kind.alias("coverage"))


def tabular(spans: DataFrame) -> DataFrame:
    """(label, median, repeated, verdict): values a document, and the mean share of them that repeat others; many of both look
    like a table's column, whose values no set can stand for."""
    per = spans.where("label <> ''").groupBy("label", "doc_id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("text", F.lit("None"))).alias("d"))
    out = per.groupBy("label").agg(F.percentile("n", 0.5).alias("median"), F.avg(1 - F.col("d") / F.col("n")).alias("repeated"))
    many = F.col("median") >= 5
    return out.withColumn("verdict", F.when(many & (F.col("repeated") >= 0.2), "tabular").when(many, "many").otherwise("flat"))


def every_nth(docs: DataFrame, n: int) -> DataFrame:
    """n documents spread evenly over the order of ids, which is sorted and numbered by ranges."""
    placed = running(docs.select("doc_id", F.lit(1).cast("long").alias("one")), [], [F.asc("doc_id")], ["one"])
    step = F.greatest(F.lit(1), F.call_function("div", F.col("one_all"), F.lit(n)))
    at = F.col("one_to") - 1
    return docs.join(placed.where((at % step == 0) & (at < step * n)).select("doc_id"), "doc_id", "left_semi")


def review(docs: DataFrame, spans: DataFrame, n: int | None = None, shown: int = 4, width: int = 400) -> DataFrame:
    """(doc_id, split, length, n_spans, label, n, values, window) for reading by eye: of n documents spread over all (None: of all) a row
    a label, with its first values in order and the beginning of the text; documents without spans have a null label."""
    some = docs if n is None else every_nth(docs, n)
    held = spans.where("label is not null and label <> ''").select("doc_id", "label", "pos", "text")
    per = held.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "text"))), 1, shown).alias("first"))  # one document's spans
    rows = some.select("doc_id", "split", F.length("text").alias("length"), F.substring("text", 1, width).alias("window")).join(per, "doc_id", "left")
    total = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id")), F.lit(0))
    return rows.select("doc_id", "split", "length", total.alias("n_spans"), "label", F.coalesce("n", F.lit(0)).alias("n"), F.transform("first", lambda x: x["text"]).alias("values"), "window")
