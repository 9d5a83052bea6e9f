"""Files that runs leave behind, as tables: extractions, labels, activations, caches, lists of documents, settings."""

from __future__ import annotations

import io
import os
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = "path array<string>, path_str string, is_error int, error_type string, comparison_strategy string, gold_present boolean, extracted_present boolean, gold_value string, extracted_value string"
EXTRACTION = """doc_id string, domain string, prompt_token_count int, generated_token_count int, finish_reason string, elapsed_seconds double, raw_generated_text string,
 parsed_json string, parse_error string, token_logprobs array<double>, captured_layers array<int>, fields array<struct<path array<string>, path_str string, value string, is_empty boolean, token_span array<int>>>"""


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def counts(name: Column) -> Column:
    """Whether a file is a document's: neither hidden by a leading _ nor a summary."""
    return ~F.startswith(name, F.lit("_")) & ~F.contains(name, F.lit("_summary"))


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each JSON file but those whose name begins with _, or holds _summary; doc_id from the file's stem where the body
    has none. Objects where the schema says string stay JSON text."""
    rows = spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*.json").where(counts(F.col("_metadata.file_name")))
    return rows.withColumn("doc_id", F.coalesce("doc_id", stem(F.col("_metadata.file_name"))))


def extractions(spark: SparkSession, path: str) -> DataFrame:
    return json_files(spark, path, EXTRACTION)


def extraction_fields(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, path_str, value, is_empty, start, past) of extractions' fields."""
    each = rows.select("doc_id", F.posexplode("fields").alias("pos", "f"))
    return each.select("doc_id", "pos", "f.path_str", "f.value", "f.is_empty", F.get("f.token_span", F.lit(0)).alias("start"), F.get("f.token_span", F.lit(1)).alias("past"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows (doc_id, domain, pos, ...) of files with one list of them each."""
    kind = ", ".join(f"{c.strip().split(' ', 1)[0]}: {c.strip().split(' ', 1)[1]}" for c in LABEL.split(","))
    rows = json_files(spark, path, f"doc_id string, domain string, labels array<struct<{kind}>>")
    return rows.select("doc_id", "domain", F.posexplode("labels").alias("pos", "l")).select("doc_id", "domain", "pos", "l.*")


def activations(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path_str, layer, vec, tokens) of array files, whose names end in __layer{n}: vec of one vector, tokens of a list
    of them. An array is decoded on its executor."""

    def run(frames):
        for f in frames:
            rows = []
            for name, content in f.itertuples(index=False):
                with np.load(io.BytesIO(content)) as held:
                    for key in held.files:
                        field, _, layer = key.rpartition("__layer")
                        a = held[key].astype(np.float32)
                        rows.append((name.rsplit(".", 1)[0], field, int(layer), a.tolist() if a.ndim == 1 else None, a.tolist() if a.ndim == 2 else None))
            yield pd.DataFrame(rows, columns=["doc_id", "path_str", "layer", "vec", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInPandas(run, "doc_id string, path_str string, layer int, vec array<float>, tokens array<array<float>>")


def cache(spark: SparkSession, path: str, value: str = "struct<new_value: string, raw: string>") -> DataFrame:
    """(key, ...) of a JSON object whose keys are fields, "doc::path"."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {value}>").alias("m"))
    return text.select(F.explode("m").alias("key", "v")).select("key", "v.*")


def candidate_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, orig_p, orig_value, gold_value, is_error, idx, value, p) of a cache of several candidates a field."""
    kind = "struct<orig_p_err: double, orig_value: string, gold_value: string, is_error: int, candidates: array<struct<value: string, p_err: double>>>"
    rows = cache(spark, path, kind).select("key", F.col("orig_p_err").alias("orig_p"), "orig_value", "gold_value", "is_error", F.posexplode("candidates").alias("idx", "c"))
    return rows.select("key", "orig_p", "orig_value", "gold_value", "is_error", "idx", F.col("c.value").alias("value"), F.col("c.p_err").alias("p"))


def document_list(spark: SparkSession, path: str) -> DataFrame:
    """doc_ids of a text file, one a line; blanks are trimmed, blank lines dropped."""
    return listed(spark.read.text(path))


def listed(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("doc_id")).where("doc_id <> ''").distinct()


def settings(path: str, model=None) -> Any:
    """A YAML file of settings, checked by a pydantic model where one is given. Anything but a mapping is an error."""
    import yaml

    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        tree = yaml.safe_load(f)
    if not isinstance(tree, dict):
        raise ValueError(f"{path} holds no mapping")
    return tree if model is None else model.model_validate(tree)
