"""Exact top-k by inner product through a pivot-distance index.

Vectors get one more coordinate that makes their norms equal, so that the largest inner products are the least
distances. Each is keyed by its nearest pivot and its distance to it; annuli of a pivot are cut to blocks of bounded
size. A query first expands the annuli nearest to its own distance until they hold enough rows, which bounds its k-th
score; by the triangle inequality only annuli that can beat that bound are opened after. Queries meet blocks, never each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import shuffle_parts, write_out

#: Pivots: a bounded sample of rows, by a hash of their ids. Annuli of a pivot; rows of a block; queries that meet a block at once.
PIVOTS, RINGS, BLOCK, LOT = 64, 24, 8192, 8192
#: Slack on distances, against rounding in their computation: relative to the largest norm.
SLACK = 1e-9
SCALE = 1024
#: Inner products of components up to this are exact in doubles, for up to 2**13 dimensions.
EXACT = 1 << 20


def whole(embedding: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(1024 * x) of every vector with no null or non-finite part, end to end; the rows they are; their lengths."""
    lists = embedding.combine_chunks() if isinstance(embedding, pa.ChunkedArray) else embedding
    rows, values, sizes = [], [], []
    for i, v in enumerate(lists):
        if not v.is_valid:
            continue
        flat = v.values
        if flat is None or flat.null_count:
            continue
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            rows.append(i)
            values.append(np.floor(SCALE * x))
            sizes.append(len(x))
    return np.array(rows, np.int64), np.concatenate(values) if values else np.zeros(0), np.array(sizes, np.int64)


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v array<long>, dim, norm2, most) of the vectors that take part."""

    def convert(batches):
        for b in batches:
            rows, flat, sizes = whole(b.column("v"))
            ids = b.column("id").take(pa.array(rows))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            norm = [float(np.dot(flat[s:e], flat[s:e])) for s, e in zip(ends, ends[1:])]
            most = [float(np.abs(flat[s:e]).max(initial=0)) for s, e in zip(ends, ends[1:])]
            v = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, v, pa.array(sizes.astype(np.int32)), pa.array(norm, pa.float64()), pa.array(most, pa.float64())], ["id", "v", "dim", "norm2", "most"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null").mapInArrow(convert, "id long, v array<long>, dim int, norm2 double, most double")


def matrix(column, dim: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), dim)


class Index:
    """Pivots and the rings about them: what a query needs to bound every block. Its size is fixed by PIVOTS and RINGS."""

    def __init__(self, pivots: np.ndarray, top2: float):
        self.top2, self.pivots = top2, pivots
        self.lift = np.sqrt(np.maximum(0, top2 - (pivots**2).sum(1)))
        self.width = 2 * np.sqrt(top2) / RINGS if top2 > 0 else 1.0
        #: Rows and blocks of each (pivot, ring) that has any.
        self.rings: dict[tuple[int, int], tuple[int, int]] = {}

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Of rows to pivots in lifted space; queries lie at height 0."""
        n2 = (x**2).sum(1)
        height = np.sqrt(np.maximum(0, self.top2 - n2)) if lifted else np.zeros(len(x))
        d2 = (n2 + height**2)[:, None] + self.top2 - 2 * (x @ self.pivots.T + height[:, None] * self.lift[None, :])
        return np.sqrt(np.maximum(0, d2))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least distance of each query (rows) to anything in each ring (columns, in the order of self.rings)."""
        d = self.distances(q, False)
        p = np.array([k[0] for k in self.rings])
        inner = np.array([k[1] for k in self.rings]) * self.width
        slack = SLACK * (1 + np.sqrt(self.top2)) * 1e3
        return np.maximum(0, np.maximum(d[:, p] - (inner + self.width), inner - d[:, p]) - slack)


def best(scores: np.ndarray, ids: np.ndarray, k: int, nth: np.ndarray) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids, then to earlier rows."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((nth[near], ids[near], -scores[near]))[:k]]
    return np.lexsort((nth, ids, -scores))[:k]


FOUND = "q long, query_id long, nth long, vec_id long, score long"


def meet(blocks: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """FOUND: each query's k best rows of each block that it opens; by doubles where these are exact, else by Python's integers."""
    keys = ["dim", "ring", "salt"]
    lots = asks.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / LOT).cast("int"))).alias("lot"))
    left = blocks.join(lots, keys).select(*keys, "lot", "nth", "id", "v")
    size = asks.groupBy(*keys).agg(F.floor((F.count("*") - 1) / LOT + 1).cast("int").alias("of"))
    right = asks.join(size, keys).select(*keys, F.pmod(F.xxhash64("q"), F.col("of")).cast("int").alias("lot"), "q", "id", "v")

    def run(key, rows, queries):
        dim = key[0].as_py()
        n, m = rows.num_rows, queries.num_rows
        out: list[list] = [[], [], [], [], []]
        if n and m:
            x, q = matrix(rows.column("v"), dim), matrix(queries.column("v"), dim)
            nth, ids, asked, qs = (t.column(c).to_numpy() for t, c in ((rows, "nth"), (rows, "id"), (queries, "q"), (queries, "id")))
            exact = dim <= 1 << 13 and max(int(abs(x).max(initial=0)), int(abs(q).max(initial=0))) <= EXACT
            x, q = (x.astype(np.float64), q.astype(np.float64)) if exact else (x.astype(object), q.astype(object))
            for s in range(0, m, 256):
                scores = q[s : s + 256] @ x.T if dim else np.zeros((len(q[s : s + 256]), n))
                for j in range(len(scores)):
                    own = np.flatnonzero(ids != qs[s + j])
                    if exact:
                        top = own[best(scores[j][own], ids[own], k, nth[own])]
                    else:
                        top = np.array(sorted(own.tolist(), key=lambda t: (-int(scores[j][t]), ids[t], nth[t]))[:k], np.int64)
                    for column, values in zip(out, ([int(asked[s + j])] * len(top), [int(qs[s + j])] * len(top), nth[top].tolist(), ids[top].tolist(), [int(y) for y in scores[j][top]])):
                        column += values
        return pa.table([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in FOUND.split(", ")])

    return left.groupBy(*keys, "lot").cogroup(right.groupBy(*keys, "lot")).applyInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best; ties to smaller ids. A group holds at most k rows a block, combined before the shuffle."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "nth")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_length(dims: np.ndarray):
    """Each vector length of a batch and the rows that have it."""
    return [(int(d), np.flatnonzero(dims == d)) for d in np.unique(dims)]


def top_k(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` (a condition on id) holds of, the k other rows of
    the largest integer inner products, all if fewer; ties to smaller ids.

    Exact. Null vectors and such as hold null or non-finite components take no part, nor do null ids. Vectors meet those
    of their own length alone, each length having an index of its own; empty vectors score 0. Repeated rows are candidates
    each; repeated rows among the queries are one query, equal ids with different vectors one each; a query's own id is
    never among its answers. Other columns are left out. Empty tables give no rows. Components are computed exactly,
    beyond doubles too; scores must fit a long.
    """
    spark = vectors.sparkSession
    rows, _ = write_out(integers(vectors, id_col, vec_col).withColumn("nth", F.monotonically_increasing_id()), "vectors")
    tops = {r["dim"]: r["top2"] for r in rows.groupBy("dim").agg(F.max("norm2").alias("top2")).collect()}  # one a length
    w = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "nth")
    picked = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= PIVOTS).select("dim", "v").collect()
    indexes = {d: Index(np.unique(np.array([r["v"] for r in picked if r["dim"] == d], np.float64), axis=0) if d else np.zeros((1, 0)), top2) for d, top2 in tops.items()}
    held = spark.sparkContext.broadcast(indexes)

    def place(batches):
        for b in batches:
            for d, some in by_length(b.column("dim").to_numpy()):
                x, part = held.value[d], b.take(pa.array(some))
                far = x.distances(matrix(part.column("v"), d).astype(np.float64), True)
                p = far.argmin(1)
                ring = np.minimum(RINGS - 1, (far[np.arange(len(p)), p] / x.width).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("dim", "nth", "id", "v")], pa.array(p * RINGS + ring)], ["dim", "nth", "id", "v", "ring"])

    keyed, _ = write_out(rows.select("dim", "nth", "id", "v").mapInArrow(place, "dim int, nth long, id long, v array<long>, ring long"), "index")
    sizes = keyed.groupBy("dim", "ring").count().withColumn("cut", F.ceil(F.col("count") / BLOCK).cast("int"))
    for r in sizes.orderBy("dim", "ring").collect():  # at most PIVOTS * RINGS a length
        indexes[r["dim"]].rings[r["ring"] // RINGS, r["ring"] % RINGS] = r["count"], r["cut"]
    held = spark.sparkContext.broadcast(indexes)
    blocks = keyed.join(F.broadcast(sizes.select("dim", "ring", "cut")), ["dim", "ring"]).withColumn("salt", F.pmod(F.xxhash64("nth"), F.col("cut")).cast("int")).drop("cut").repartition(shuffle_parts(spark), "dim", "ring", "salt")

    def open_rings(asks: DataFrame, first: bool) -> DataFrame:
        """(dim, ring, salt, q, id, v): the first rings of each query, up to twice k rows; or after those, all that may beat its bound."""

        def run(batches):
            for b in batches:
                for d, some in by_length(b.column("dim").to_numpy()):
                    for s in range(0, len(some), 4096):
                        yield from opened(held.value[d], d, b.take(pa.array(some[s : s + 4096])))

        def opened(x, d, part):
            keys = np.array([p * RINGS + r for p, r in x.rings], np.int64)
            held_rows, many = (np.array(c) for c in zip(*x.rings.values()))
            q = matrix(part.column("v"), d).astype(np.float64)
            low = x.bounds(q)
            order = np.argsort(low, axis=1, kind="stable")
            rows_before = np.cumsum(held_rows[order], axis=1) - held_rows[order]
            early = np.zeros(low.shape, bool)
            np.put_along_axis(early, order, rows_before < 2 * k + 1, 1)
            if not first:
                need = np.array([-np.inf if y is None else float(y) for y in part.column("bound").to_pylist()])
                most = ((q**2).sum(1)[:, None] + x.top2 - low**2) / 2
                early = ~early & (most * (1 + 1e-9) + 1e-3 * abs(most) * 1e-6 + 1 >= need[:, None])
            a, c = np.nonzero(early)
            a, c = np.repeat(a, many[c]), np.repeat(c, many[c])
            if not len(a):
                return
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
            nth = np.arange(len(a)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(a)]])))
            whole = part.take(pa.array(a))
            yield pa.RecordBatch.from_arrays([whole.column("dim"), pa.array(keys[c]), pa.array(nth.astype(np.int32)), *[whole.column(n) for n in ("q", "id", "v")]], ["dim", "ring", "salt", "q", "id", "v"])

        return asks.mapInArrow(run, "dim int, ring long, salt int, q long, id long, v array<long>")

    asks = keyed.where(queries(F.col("id"))).groupBy("dim", "id", "v").agg(F.min("nth").alias("q"))
    early, _ = write_out(ranked(meet(blocks, open_rings(asks, True), k), k), "early")
    bound = early.where(F.col("rank") == k).select("q", F.col("score").alias("bound"))
    late = meet(blocks, open_rings(asks.join(bound, "q", "left"), False), k)
    return ranked(early.drop("rank").unionByName(late), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best rows of every vector whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select *, row_number() over (order by vec_id, e) as q from (select distinct vec_id, e from v where vec_id % 100 = 0)),
s as (select q, q.vec_id as query_id, c.vec_id,
  coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0)::bigint as score
  from q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 10
"""
