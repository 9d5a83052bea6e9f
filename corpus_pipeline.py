"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

    language   op 3   drops documents without letters or whose language stays unclear
    lines      op 10  keeps one line of each component of equal or near-equal lines; emptied documents go
    near       op 5   keeps the document of the smallest id of each SimHash component
    mixing     op 1   repeats documents to the sources' target weights, in a global random order
    packing    op 7   packs token pieces into sequences

All stages but the last return the columns of documents. Each stage's docstring says what becomes of nulls, empty texts and
repeated rows; an empty table runs through to an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import langid, lines, mixing, packing, simhash
from veritrail.llm.common import drop_paths, fold, from_rows, lean, scratch, work_path

#: SQL can't express suffix automata, signatures or bin packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents whose crc32 mod 4 is not 2; rejects 'und', which null, empty and letterless texts are,
    and shares of evidence below the operator's limit. Repeated rows and rows without an id fare as their texts do; columns stay
    as they are, whatever their names."""
    parser = langid.learn(docs.where(fold("doc_id", 4) != 2))
    out = langid.judged_rows(docs, parser).where((F.col("lang_pred") != "und") & (F.col("score") >= langid.REJECT_BELOW))
    return from_rows(out, docs.columns)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of equal or near-equal lines stays; documents that lose every line with a word go, those
    without text stay. Rows are told apart by id and text, so another text of the same id, or without one, keeps what it alone
    has; repeated rows lose the same lines."""
    return lines.dedup_lines(docs, short=True)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component stays, and of rows with that id one; null and empty texts are one
    component."""
    return simhash.keep_first(docs)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to shares in proportion to size ** 0.7, over one epoch; sources without text give nothing. Repeated rows
    draw the same count, each for itself; rows without an id are drawn as one id."""
    return mixing.mix_sources(docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece of every row in sequences of 2048; null and empty texts are an end alone. Repeated rows, which mixing makes,
    are packed each."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("lines", line_dedup), ("near", near_dedup), ("mixing", mix), ("packing", pack)]


def run(spark, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage writes on its way, and the table it read, are deleted once its own stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"stage-{name}")
        with scratch(spark), lean(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_paths(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
