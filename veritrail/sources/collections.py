"""Annotated collections as tables of documents (doc_id, domain, text, schema, gold, source_path, metadata, extraction_error):
folders of PDF files with gold, tables of annotated spans, and tables of claims.

schema and gold are JSON texts, since every domain has its own shape. What reads PDF files is given by the caller.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veritrail.functions import expressions as X

DOCUMENT = ["doc_id", "domain", "text", "schema", "gold", "source_path", "metadata", "extraction_error"]
#: Characters that no document id may hold.
UNSAFE = r'[/\\:*?"<>|]'
#: Files of a table of spans, in the order that decides which of two rows of one document stays.
SPLITS = ("train", "val", "test")
EMPTY_TEXT = "empty OCR text in RealKIE export"


def checked_domains(known: Iterable[str], asked: Iterable[str] | None) -> list[str]:
    """The domains asked for, or all; unknown ones are an error."""
    known = sorted(known)
    missing = sorted(set(asked or ()) - set(known))
    if missing:
        raise ValueError(f"unknown domains {missing}; there are {known}")
    return sorted(asked) if asked is not None else known


def listing(path: str) -> dict[str, bool] | None:
    """Names in a folder, with whether each is a folder; None if there is no such folder. Of any file system that Spark knows."""
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return None
    return {s.getPath().getName(): s.isDirectory() for s in fs.listStatus(at)}


def checked_path(path: str) -> str:
    if listing(path) is None:
        raise FileNotFoundError(path)
    return path.rstrip("/")


def bad_id(doc_id: Column) -> Column:
    """Whether an id is null, empty or holds a character that file systems refuse."""
    return doc_id.isNull() | (doc_id == "") | doc_id.rlike(UNSAFE)


def validated(docs: DataFrame) -> DataFrame:
    """docs, failing as soon as a row with a bad id is read."""
    checked = F.when(bad_id(F.col("doc_id")), F.raise_error(F.concat(F.lit("bad document id: "), F.coalesce("doc_id", F.lit("null")))).cast("string")).otherwise(F.col("doc_id"))
    return docs.withColumn("doc_id", checked)


def duplicate_ids(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


def first_documents(docs: DataFrame, most: int | None, *order: str) -> DataFrame:
    return docs if most is None else docs.orderBy(*order).limit(most)


# Folders: {path}/{top}/{sub}/{sub}-schema.json and pdf+gold/{stem}.pdf with {stem}.gold.json


def folder_domains(path: str) -> list[str]:
    """top/sub of every folder that has a schema and a folder of files."""
    out = []
    for top, is_folder in sorted((listing(checked_path(path)) or {}).items()):
        for sub in sorted(listing(f"{path}/{top}") or {}) if is_folder else ():
            held = listing(f"{path}/{top}/{sub}") or {}
            if held.get("pdf+gold") and any(f.endswith("-schema.json") for f in held):
                out.append(f"{top}/{sub}")
    return out


def unwrapped_schema(text: str) -> dict:
    """A schema as it is, or out of its wrapping; anything else is an error."""
    tree = json.loads(text)
    inner = tree.get("schema_definition", tree) if isinstance(tree, dict) else tree
    if not isinstance(inner, dict):
        raise ValueError("a schema has to be an object")
    if inner is tree and not {"type", "properties", "$schema"} & set(tree):
        raise ValueError("neither a schema nor a wrapped one")
    return inner


def folder_schema(path: str, domain: str) -> dict:
    """The domain's one schema; an unknown domain is a KeyError, none or several files are errors."""
    at = f"{path}/{domain}"
    if domain not in folder_domains(path):
        raise KeyError(domain)
    files = sorted(f for f in listing(at) or () if f.endswith("-schema.json"))
    if len(files) != 1:
        raise ValueError(f"{at} has {len(files)} schemas")
    return unwrapped_schema(SparkSession.active().read.text(f"{at}/{files[0]}", wholetext=True).first()[0])


def file_stem(path: Column) -> tuple[Column, Column]:
    """domain and stem of a file's path .../top/sub/pdf+gold/name; of gold files without .gold.json."""
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    pattern = r"([^/]+/[^/]+)/pdf\+gold/([^/]+?)(\.gold\.json|\.pdf)$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def paired(gold: DataFrame, files: DataFrame) -> DataFrame:
    """gold (domain, stem, gold) with its file (domain, stem, source_path)."""
    return gold.join(files, ["domain", "stem"])


def unpaired(gold: DataFrame, files: DataFrame) -> DataFrame:
    """(domain, stem, missing): what lacks its file or its gold."""
    lone = gold.select("domain", "stem").join(files, ["domain", "stem"], "left_anti").withColumn("missing", F.lit("file"))
    return lone.unionByName(files.select("domain", "stem").join(gold, ["domain", "stem"], "left_anti").withColumn("missing", F.lit("gold")))


def least_text(text: Column, error: Column, least: int) -> tuple[Column, Column]:
    """(text, error): a text that could not be read, or is shorter than `least` characters, is empty with a reason."""
    short = F.length(F.coalesce(text, F.lit(""))) < least
    why = F.coalesce(error, F.when(text.isNull(), "no text"), F.when(short, F.concat(F.lit("extracted text has fewer than "), F.lit(least), F.lit(" characters"))))
    return F.when(why.isNull(), text).otherwise(""), why


def read_files(rows: DataFrame, read_text: Callable[[bytes], str], read_meta: Callable[[bytes], dict] | None = None, min_chars: int = 1) -> DataFrame:
    """rows (content, ...) with text, extraction_error and metadata in place of content. What read_text raises becomes the error
    of its document; where read_meta raises, the metadata stay empty. Files go to Python in Spark's plain batches of a
    hundred rows, as ten thousand files of an Arrow batch may be of any size."""

    @F.udf("struct<raw string, error string, meta map<string,string>>", useArrow=False)
    def read(content):
        text = error = None
        meta = {}
        try:
            text = read_text(bytes(content))
        except Exception as e:  # whatever the reader raises is the document's error
            error = f"{type(e).__name__}: {e}"
        try:
            meta = {k: str(v) for k, v in read_meta(bytes(content)).items()} if read_meta else {}
        except Exception:
            pass
        return text, error, meta

    done = rows.withColumn("_r", read("content"))
    text, error = least_text(F.col("_r.raw"), F.col("_r.error"), min_chars)
    return done.withColumns({"text": text, "extraction_error": error, "metadata": F.col("_r.meta")}).drop("_r", "content")


def folder_documents(spark: SparkSession, path: str, read_text: Callable[[bytes], str], domains: Iterable[str] | None = None, max_documents: int | None = None, min_chars: int = 1, read_meta: Callable[[bytes], dict] | None = None) -> DataFrame:
    """Documents of a tree of folders; read_text and read_meta get a PDF's bytes on the executors (read_files). The first
    max_documents are by domain and stem."""
    chosen = checked_domains(folder_domains(checked_path(path)), domains)
    schemas = spark.createDataFrame([(d, json.dumps(folder_schema(path, d))) for d in chosen], "domain string, schema string")
    at = f"{path}/{{{','.join(sorted({d.split('/')[0] for d in chosen}))}}}/*/pdf+gold"

    def files(end: str) -> DataFrame:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{end}").load(at)
        domain, stem = file_stem(F.col("path"))
        return rows.select(domain.alias("domain"), stem.alias("stem"), F.col("path").alias("source_path"), "content").where(F.col("domain").isin(*chosen))

    gold = files(".gold.json").select("domain", "stem", F.decode("content", "UTF-8").alias("gold"))
    rows = read_files(first_documents(paired(gold, files(".pdf")), max_documents, "domain", "stem"), read_text, read_meta, min_chars)
    return validated(rows.join(F.broadcast(schemas), "domain").withColumn("doc_id", X.doc_id(F.col("domain"), F.col("stem"))).select(*DOCUMENT))


# Tables of annotated spans


def identified(rows: DataFrame) -> DataFrame:
    """rows (domain, document_path, ...) with doc_id; such without a path or its stem are dropped."""
    stem = F.regexp_replace(F.element_at(F.split("document_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return rows.where(F.trim(F.coalesce("document_path", F.lit(""))) != "").withColumn("doc_id", F.concat_ws("__", "domain", stem)).where(stem != "")


def span_records(rows: DataFrame) -> DataFrame:
    """rows (domain, split, pos, document_path, ...) with doc_id, the first of a document over splits and rows."""
    some = identified(rows)
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    rest = [c for c in some.columns if c != "doc_id"]
    first = some.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(rank, F.col("pos"))).alias("r"))
    return first.select("doc_id", "r.*")


def gold_of_spans(records: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, field, values): for every record and field of its domain the spans' texts, normalised, each once without case, in
    their order; empty arrays stay. records (doc_id, domain, labels: JSON of spans) have a row a document, fields are (domain, label,
    field). Labels that are no list of objects, or belong to no field, give nothing.

    Spans of labels that no field has are dropped before they are normalised. A record's fields go along with its spans as rows at
    place -1, so that records are read once."""
    named = fields.where("domain is not null").groupBy("domain").agg(F.collect_set("field").alias("_all"), F.collect_set(F.when(F.col("label").isNotNull(), F.struct("label", "field"))).alias("_fields"))  # a row a domain
    spans = F.coalesce(F.from_json("labels", "array<struct<label string, text string>>"), F.array().cast("array<struct<label string, text string>>"))
    blank = F.transform("_all", lambda f: F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("text"), f.alias("field")))
    placed = F.filter(F.transform(spans, lambda s, n: F.struct(n.alias("pos"), s["text"].alias("text"), F.filter("_fields", lambda f: f["label"] == s["label"]).alias("fs"))), lambda x: F.size(x["fs"]) > 0)
    held = F.flatten(F.transform(placed, lambda x: F.transform(x["fs"], lambda f: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), f["field"].alias("field")))))
    each = records.select("doc_id", "domain", "labels").join(F.broadcast(named), "domain").select("doc_id", F.explode(F.concat(blank, held)).alias("s")).select("doc_id", "s.field", "s.pos", X.norm_span(F.col("s.text")).alias("value"))
    once = each.where("pos < 0 or value <> ''").groupBy("doc_id", "field", F.lower("value").alias("k")).agg(F.min(F.struct("pos", "value")).alias("v"))
    lists = once.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.when(F.col("v.pos") >= 0, F.col("v")))).alias("v"))
    return lists.select("doc_id", "field", F.transform("v", lambda x: x["value"]).alias("values"))


def span_documents(records: DataFrame, fields: DataFrame, schemas: DataFrame) -> DataFrame:
    """Documents of records; a blank text is an error and empty. schemas is (domain, schema)."""
    gold = gold_of_spans(records, fields).groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "values"))))).alias("gold"))
    blank = F.col("text").isNull() | (X.strip(F.col("text")) == "")
    meta = F.create_map(F.lit("benchmark"), F.lit("real_kie"), F.lit("split"), F.col("split"), F.lit("original_filename"), F.col("original_filename"))
    rows = records.join(gold, "doc_id", "left").join(F.broadcast(schemas), "domain", "left")
    return rows.withColumns({"text": F.when(blank, "").otherwise(F.col("text")), "extraction_error": F.when(blank, EMPTY_TEXT), "metadata": meta, "source_path": F.col("document_path"), "gold": F.coalesce("gold", F.lit("{}"))}).select(*DOCUMENT)


def span_table(spark: SparkSession, path: str, fields: DataFrame, schemas: DataFrame, domains: Iterable[str] | None = None, max_documents: int | None = None) -> DataFrame:
    """Documents of {path}/{domain}/{train,val,test}.csv; splits that are missing are left out."""
    known = [d for d, is_folder in sorted((listing(checked_path(path)) or {}).items()) if is_folder]
    rows = None
    for domain in checked_domains(known, domains):
        held = listing(f"{path}/{domain}") or {}
        for split in SPLITS:
            at = f"{path}/{domain}/{split}.csv"
            if f"{split}.csv" in held:
                csv = spark.read.csv(at, header=True, multiLine=True, escape='"')
                for c in ("text", "labels", "original_filename"):
                    csv = csv if c in csv.columns else csv.withColumn(c, F.lit(None).cast("string"))
                one = csv.select(F.lit(domain).alias("domain"), F.lit(split).alias("split"), F.monotonically_increasing_id().alias("pos"), "document_path", "text", "labels", "original_filename")
                rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise FileNotFoundError(f"no split under {path}")
    return validated(span_documents(first_documents(span_records(rows), max_documents, "domain", "doc_id"), fields, schemas))


# Tables of claims


def parsed_gold(value) -> dict:
    """A record as an object: JSON, or Python's way to write it; {} for all else."""
    for read in (json.loads, ast.literal_eval):
        try:
            out = read(value)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
        if isinstance(out, dict):
            return out
    return {}


@F.pandas_udf(StringType())
def gold_json(value: pd.Series) -> pd.Series:
    return value.map(lambda v: json.dumps(parsed_gold(v), ensure_ascii=False))


def claim_documents(rows: DataFrame, schema: str, domain: str = "insurance", max_documents: int | None = None) -> DataFrame:
    """Documents of rows (index, claim_text, ground_truth); ground_truth is JSON or Python text of an object. The id is that of
    the claim in the gold's header, else the row's number. Two claims may share an id: see duplicate_ids."""
    gold = rows.withColumn("gold", gold_json("ground_truth"))
    claim, number = F.get_json_object("gold", "$.header.claim_id"), F.col("index").cast("string")
    number = F.concat(F.lit("claim"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
    stem = F.when(F.coalesce(claim, F.lit("")) != "", claim).otherwise(number)
    out = first_documents(gold, max_documents, "index").withColumns({"doc_id": X.doc_id(F.lit(domain), stem), "domain": F.lit(domain), "text": F.col("claim_text"), "schema": F.lit(schema), "source_path": F.lit(None).cast("string"), "metadata": F.create_map(F.lit("index"), F.col("index").cast("string")), "extraction_error": F.lit(None).cast("string")})
    return validated(out.select(*DOCUMENT))


LOADERS: dict[str, Callable[..., DataFrame]] = {"extract_bench": folder_documents, "real_kie": span_table, "insurance_claims": claim_documents}


def load(name: str, *args, limit: int | None = None, **options) -> DataFrame:
    """Documents of a registered collection; limit goes before its own max_documents."""
    if name not in LOADERS:
        raise ValueError(f"unknown collection {name!r}; there are {sorted(LOADERS)}")
    return LOADERS[name](*args, **options | ({} if limit is None else {"max_documents": limit}))
