"""Shared helpers: intermediate tables in the cluster's shared folder, sizing from plan statistics, text buffers."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six bytes.
SPACES = b" \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MERGE, MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode
    (tests), else an error: a folder of one machine is nothing that executors elsewhere can read."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            where = set_before.get()
        elif spark.sparkContext.master.startswith("local"):
            where = tempfile.mkdtemp(prefix="veritrail-")
            spark.sparkContext.setCheckpointDir(where)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return where.rstrip("/")


_owned: set[str] = set()
_scratch: list[list[str]] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which the JVM deletes when it ends; inside `scratch`, earlier."""
    home = f"{shared_dir(spark)}/veritrail-{spark.sparkContext.applicationId}"
    if home not in _owned:
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _owned.add(home)
    out = f"{home}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are made within are deleted at its end: what is to outlive it has to be written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        drop_paths(spark, *_scratch.pop())


def write_out(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a written table, which cuts its lineage and survives lost executors; and its path."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    with lean(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def lean(spark: SparkSession):
    """Queries that run within give back their shuffle files as they end, as nothing else would read them, and adaptive execution
    puts shuffled partitions together up to MERGED only, so that a task sorts little at a time."""
    mine = {CLEANUP: "true", MERGE: MERGED}
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drop_paths(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def join_few(rows: DataFrame, few: DataFrame, key: str, most: int = 10_000, salts: int = 16) -> DataFrame:
    """rows joined (inner) with the written table `few`, of one row a key: broadcast if it has at most `most` rows by count,
    else with the rows of a key dealt to `salts` tasks, so that a key with a third of all rows is no hot one."""
    if few.count() <= most:
        return rows.join(F.broadcast(few), key)
    dealt = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    return salted.join(dealt, [key, "_salt"]).drop("_salt")


def join_hot(rows: DataFrame, classes: DataFrame, keys: list[str], n: str, least: int = 10_000) -> DataFrame:
    """rows joined (inner) with the written table `classes`, of one row a key, whose column n says how many rows the key has.

    Keys with over a thousandth of all rows (and over `least`), fewer than 1000 by that bound, are broadcast; rows of all
    other keys are shuffled. Null keys meet nothing."""
    total = classes.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    limit = max(least, total // 1000)
    if total <= limit:
        return rows.join(classes, keys)
    hot = classes.where(F.col(n) > limit)
    cool = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(classes.where(F.col(n) <= limit), keys)
    return cool.unionByName(rows.join(F.broadcast(hot), keys))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def plan_bytes(df: DataFrame) -> int:
    """Size of df by Catalyst's statistics: for a scan, the bytes of its files. No job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def blocks_for(df: DataFrame, mb: int) -> int:
    """How many blocks of about mb MB (as stored) df makes, or as many as it has partitions where its size isn't known;
    at least the session's shuffle partitions."""
    size = plan_bytes(df)
    blocks = math.ceil(size / (mb << 20)) if size < 1 << 56 else df.rdd.getNumPartitions()
    return max(shuffle_parts(df.sparkSession), blocks)


def fold(doc_id: str, m: int) -> Column:
    """crc32(doc_id as text) mod m; 0 for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % m, F.lit(0))


def text_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row begins and ends among them (n + 1 offsets); nulls are empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    if a.null_count:
        a = a.fill_null("")
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    _, ends, data = a.buffers()
    at = np.frombuffer(ends, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def as_rows(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row): columns (default: all) as one struct, so that no name of theirs meets ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"))


def from_rows(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns], *more)


def row_texts(batch) -> tuple[np.ndarray, np.ndarray]:
    """text_parts of the rows' texts."""
    row = batch.column("row")
    names = [f.name for f in row.type]
    return text_parts(row.field(next((i for i, n in enumerate(names) if n == "text"), [n.lower() for n in names].index("text"))))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def runs(a: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a, and its length at the end."""
    if not len(a):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])


def slices(offsets: np.ndarray, most: int):
    """(from, to) row ranges whose bytes stay near most; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
