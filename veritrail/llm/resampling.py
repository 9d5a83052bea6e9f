"""Importance resampling towards a target distribution: documents are drawn in proportion to how much likelier their n-grams
are among target texts than among all documents.

Words go through an integer dictionary, so that n-grams are tuples of ids: an n-gram is the id of its first n - 1 words'
tuple with the id of its last word. A lot of texts finds its distinct tuples by sorting numbers, hashes the bytes of
each once, and joins counts (or places in documents) back by the tuple's number. Lots and dictionaries are a task's own and of
bounded size: one dictionary of all words would have no size to broadcast it by, and to join every word with it would
shuffle all text. What leaves a task is a count a bucket, or a row a document.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import as_rows, from_rows, slices, text_parts, write_out
from veritrail.operators.ranges import running

#: Buckets of hashed n-grams, the longest n-gram, and the least words of a document that may be drawn.
BUCKETS, LONGEST, LEAST = 10_000, 2, 20
#: Hundredths of those documents that are drawn.
PERCENT = 25
#: Bytes of text whose tuples are told apart together, and words remembered by a task; a full memory is emptied, which changes no count.
LOT, MEMORY = 4 << 20, 500_000


def word_bytes() -> np.ndarray:
    """A-Z in lower case; digits, a-z and bytes of other characters stay; all else parts words."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    some = (t >= 128) | (t >= 48) & (t < 58) | (t >= 97) & (t < 123)
    return np.where(some, t, 32).astype(np.uint8)


class Words(dict):
    """Ids of words in order of arrival; of each its bytes after a blank and the crc32 of its own."""

    def __init__(self):
        self.spaced: list[bytes] = []
        self.crc: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.spaced)
        self.spaced.append(b" " + word)
        self.crc.append(zlib.crc32(word))
        return n

    def forget(self) -> None:
        self.clear()
        self.spaced, self.crc = [], []


class Grams:
    """Buckets of all n-grams of lots of texts, up to `longest` words."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest, self.words, self.table = buckets, longest, Words(), word_bytes()

    def lots(self, data: np.ndarray, at: np.ndarray):
        """For lots of rows i..j: (i, j, words a row, [(owner, tuple, bucket of each distinct tuple) for n = 1, 2, ...]); owner says
        whose row, from i, a tuple is at each place."""
        for i, j in slices(at, LOT):
            if len(self.words) > MEMORY:
                self.words.forget()
            raw = self.table[data[at[i] : at[j]]].tobytes()
            ids = [np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)) for w in (raw[at[x] - at[i] : at[x + 1] - at[i]].split() for x in range(i, j))]
            sizes = np.array([len(x) for x in ids])
            yield i, j, sizes, self.tuples(np.concatenate(ids), np.repeat(np.arange(j - i), sizes))

    def tuples(self, word: np.ndarray, owner: np.ndarray):
        distinct, tuple_ = np.unique(word, return_inverse=True)
        crc = [self.words.crc[k] for k in distinct.tolist()]
        out, last, total = [(owner, tuple_, self.bucket(crc))], word, len(self.words.spaced)
        for _ in range(1, self.longest):
            whole = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)  # of tuples that one more word of the row follows
            last = last[1:]  # the last word of the tuple that begins here
            pair = tuple_[whole] * total + last[whole]
            distinct, tuple_ = np.unique(pair, return_inverse=True)
            before, word = np.divmod(distinct, max(total, 1))
            spaced = self.words.spaced
            crc = [zlib.crc32(spaced[w], crc[b]) for b, w in zip(before.tolist(), word.tolist())]
            owner, last = owner[whole], last[whole]
            out.append((owner, tuple_, self.bucket(crc)))
        return out

    def bucket(self, crc: list[int]) -> np.ndarray:
        return np.array(crc, np.int64) % self.buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; the driver gets one sum a bucket."""

    def count(batches):
        grams, total = Grams(buckets, longest), np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, found in grams.lots(*text_parts(b.column("text"))):
                for _, tuple_, bucket in found:
                    np.add.at(total, bucket, np.bincount(tuple_, minlength=len(bucket)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most `buckets`
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of target to source probability) of each bucket, with one added to every count."""
    n = len(source)
    up, down = (target + 1.0) * (source.sum() + float(n)), (source + 1.0) * (target.sum() + float(n))
    return np.array([math.floor(1000 * math.log(x)) for x in (up / down).tolist()], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the floored mean gain of its n-grams; 0 without any."""
    some = docs.select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weigh(batches):
        grams = Grams(len(held.value), longest)
        for b in batches:
            for i, j, sizes, found in grams.lots(*text_parts(b.column("text"))):
                n, total = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for owner, tuple_, bucket in found:
                    ends = np.searchsorted(owner, np.arange(j - i + 1))
                    sums = np.concatenate([[0], np.cumsum(held.value[bucket][tuple_])])
                    n += np.diff(ends)
                    total += np.diff(sums[ends])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return some.mapInArrow(weigh, some.select("doc_id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long"))


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of sha256; what is drawn by the highest sums with it is
    drawn in proportion to exp(weight / 1000), without replacement."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = 7, buckets: int = BUCKETS, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null unless it is drawn.

    Counts cover all texts of docs and of target (both with text). Of the documents with at least `least` words,
    floor(percent * N / 100) of the highest scores are drawn; ties go to the smaller doc_id, null ids first, and rows of one
    id are drawn one by one. Null and empty texts have no n-grams and weight 0. An empty target leaves the weights to
    the documents' own counts; an empty table gives no rows. Ranks come from a sort by ranges, in no one task.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows, _ = write_out(weighted(docs, gain, longest).withColumn("score", F.col("weight") + noise("doc_id", seed)), "weights")
    able = running(rows.where(F.col("n_words") >= least).withColumn("one", F.lit(1).cast("long")), [], [F.desc("score"), F.asc("doc_id")], ["one"])
    drawn = F.col("one_to") * 100 <= F.col("one_all") * percent
    out = able.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("one_to")).alias("rank"))
    return out.unionByName(rows.where(F.col("n_words") < least).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = 7) -> DataFrame:
    """The documents drawn, with all their columns; every row of an id that is drawn."""
    drawn = ranked(docs, target, percent, seed).where("rank is not null").select(F.col("doc_id").alias("drawn")).distinct()
    rows = as_rows(docs)
    return from_rows(rows.join(drawn, F.col("row.doc_id").eqNullSafe(F.col("drawn")), "left_semi"), docs.columns)


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts, and a draw of a quarter."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return ranked(read("documents").select("doc_id", "text"), read("benchmark").select("text"))


#: crc32 goes byte by byte through its table of 256, which is made from the polynomial, over distinct n-grams.
ORACLE = r"""
with recursive bits as (select i, 0 as k, i::bigint as v from range(0, 256) r(i) union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc_table as (select i, v from bits where k = 8),
texts as (select 'd' as kind, doc_id, text from documents union all select 'b', item_id, text from benchmark),
words as (select kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
grams as (select kind, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from words),
counted as (select kind, doc_id, g, count(*) as n from grams group by all),
distinct_grams as (select g, hex(encode(g)) as h, strlen(g) as size from counted group by g),
walk as (select g, h, size, 0 as pos, 4294967295 as c from distinct_grams union all
  select g, h, size, pos + 1, xor(c >> 8, v) from walk join crc_table
    on i = xor(c, (strpos('0123456789ABCDEF', substr(h, 2 * pos + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * pos + 2, 1)) - 1) & 255 where pos < size),
bucketed as (select g, xor(c, 4294967295) % 10000 as bucket from walk where pos = size),
counts as (select bucket, coalesce(sum(n) filter (kind = 'd'), 0)::bigint as s, coalesce(sum(n) filter (kind = 'b'), 0)::bigint as t from counted join bucketed using (g) group by bucket),
sums as (select sum(s)::bigint as ss, sum(t)::bigint as tt from counts),
gain as (select bucket, floor(1000 * ln(((t + 1)::double * (ss + 10000)::double) / ((s + 1)::double * (tt + 10000)::double)))::bigint as gain from counts, sums),
per as (select doc_id, sum(n)::bigint as n, sum(n * gain)::bigint as total from counted join bucketed using (g) join gain using (bucket) where kind = 'd' group by doc_id),
scored as (select w.doc_id, coalesce(n, 0)::bigint as n_features, case when n > 0 then floor(total::double / n)::bigint else 0 end as weight, len(w) as n_words,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as noise
  from words w left join per on w.doc_id = per.doc_id where kind = 'd'),
able as (select doc_id, row_number() over (order by weight + noise desc, doc_id) as r, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features, weight, weight + noise as score, case when r <= 25 * n // 100 then r end as rank from scored left join able using (doc_id)
"""
