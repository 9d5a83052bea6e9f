"""Token counts as delta-maintained rollups with idempotent batch commits.

A change is a signed row: an insert (+1 document, +tokens), a delete (-1, -tokens) or a revised count (0, new - old).
A batch of changes is summed by source, language and tokenizer version and committed under its batch id; totals are
the sum of all committed batches. Nothing is read again to apply a batch, and a batch that is there already is left alone.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import drop_paths, text_parts, work_path, write_out
from veritrail.llm.tokens import WordEncoder, vocabulary_path

KEYS = ("source", "lang", "tokenizer_version")
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def signed(rows: DataFrame, docs: int, tokens: Column, version: str) -> DataFrame:
    """Changes (source, lang, tokenizer_version, d_docs, d_tokens) of rows; a null count is 0."""
    return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(docs).cast("long").alias("d_docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("d_tokens"))


def inserts(rows: DataFrame, count: str, version: str) -> DataFrame:
    return signed(rows, 1, F.col(count), version)


def deletes(rows: DataFrame, count: str, version: str) -> DataFrame:
    return signed(rows, -1, -F.col(count), version)


def revisions(rows: DataFrame, old: str, new: str, version: str) -> DataFrame:
    return signed(rows, 0, F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0)), version)


class Rollup:
    """Totals kept as one small table of sums a batch under `path`, a folder that all machines share.

    commit() writes the batch aside and renames it into place, so a batch is there whole or not at all; repeating a
    commit, after a crash or by a second sender, changes nothing. compact() folds all batches into one numbered fold, put
    in place by one rename too: from then on the newest fold counts instead of older folds and of every batch whose
    id it lists, whether or not their folders have been deleted yet, so that a crash at any step loses and doubles
    nothing. Sums are made before the shuffle, so a hot source is no hot key. The file system's rename must be atomic,
    as HDFS's and POSIX's are; plain object stores' are not.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._fs_path(f"{self.path}/batches"))

    def _folder(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch) or batch[0] in "._" or batch.startswith("folded-"):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.path}/batches/{batch}"

    def _listed(self) -> list[str]:
        at = self._fs_path(f"{self.path}/batches")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at))

    def _state(self) -> tuple[str | None, set[str], list[str], list[str]]:
        """The newest fold, the ids it covers, batches that stand beside it, and what is covered but not yet deleted."""
        names = self._listed()
        folds = [n for n in names if n.startswith("folded-")]
        fold = folds[-1] if folds else None
        ids = {r[0] for r in self.spark.read.parquet(f"{self.path}/batches/{fold}/ids").collect()} if fold else set()
        beside = [n for n in names if not n.startswith("folded-") and n not in ids]
        return fold, ids, beside, [n for n in names if n != fold and n not in beside]

    def batches(self) -> set[str]:
        """Ids of all batches applied, folded ones included."""
        _, ids, beside, _ = self._state()
        return ids | set(beside)

    def _into_place(self, aside: str, target: str) -> bool:
        """Renames; False if the target was there already, where some file systems move into it instead."""
        inner = f"{target}/{aside.rsplit('/', 1)[-1]}"
        done = not self._fs.exists(self._fs_path(target)) and self._fs.rename(self._fs_path(aside), self._fs_path(target))
        if not done or self._fs.exists(self._fs_path(inner)):
            drop_paths(self.spark, inner, aside)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies the batch once; False if it had been applied before."""
        target = self._folder(batch)
        if batch in self.batches():
            return False
        aside = work_path(self.spark, "batch")
        sums = changes.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        sums.coalesce(1).write.parquet(f"{aside}/sums")
        return self._into_place(aside, target)

    def compact(self) -> str | None:
        """Folds every batch that is there now into one; its name, or None if another compaction was first."""
        fold, ids, beside, stale = self._state()
        number = int(fold.removeprefix("folded-")) + 1 if fold else 1
        aside = work_path(self.spark, "fold")
        self._sum(([fold] if fold else []) + beside).coalesce(1).write.parquet(f"{aside}/sums")
        self.spark.createDataFrame([(i,) for i in sorted(ids | set(beside))], "id string").coalesce(1).write.parquet(f"{aside}/ids")
        name = f"folded-{number:012d}"
        if not self._into_place(aside, f"{self.path}/batches/{name}"):
            return None
        drop_paths(self.spark, *[f"{self.path}/batches/{old}" for old in [*stale, *beside, *([fold] if fold else [])]])
        return name

    def _sum(self, names: list[str]) -> DataFrame:
        parts = [f"{self.path}/batches/{n}/sums" for n in names]
        rows = self.spark.read.schema(TOTALS).parquet(*parts) if parts else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens); nulls are values of their own; emptied groups are left out."""
        fold, _, beside, _ = self._state()
        return self._sum(([fold] if fold else []) + beside).where("n_docs <> 0 or n_tokens <> 0")


def counted(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, lang, n_words and n_tokens of every whole text (null: none); one pass, no shuffle. Null ids, sources
    and languages are kept; repeated rows are counted each; an empty table gives no rows; other columns are left out."""
    some = docs.select("doc_id", "source", "lang", "text")

    def count(batches):
        encoder = WordEncoder(path)
        for b in batches:
            data, at = text_parts(b.column("text"))
            flat, cuts = data.tobytes(), at.tolist()
            words = [len(flat[s:e].split()) for s, e in zip(cuts, cuts[1:])]
            ids = [len(x) // 4 for x in encoder.encode(data, at)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "source", "lang")], pa.array(words, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "source", "lang", "n_words", "n_tokens"])

    return some.mapInArrow(count, some.drop("text").schema.add("n_words", "long").add("n_tokens", "long"))


def op9_rollup(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Totals after: inserts of all documents by their words, as provisional counts; revisions to their tokens;
    deletes of those labelled of low quality; the revisions sent once more, which must change nothing."""
    version = "word_bpe_49k"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, _ = write_out(counted(docs, path or vocabulary_path()), "counts")
    low = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select("doc_id").distinct()
    rollup = Rollup(spark, work_path(spark, "rollup"))
    rollup.commit("insert", inserts(counts, "n_words", version))
    rollup.commit("revise", revisions(counts, "n_words", "n_tokens", version))
    rollup.commit("delete", deletes(counts.join(low, "doc_id", "left_semi"), "n_tokens", version))
    rollup.commit("revise", revisions(counts, "n_words", "n_tokens", version))
    return rollup.totals()
