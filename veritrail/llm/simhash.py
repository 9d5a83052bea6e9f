"""SimHash near-duplicates through pivot distance tables.

A pair at Hamming distance d has |D(x, p) - D(y, p)| <= d for every reference fingerprint p, so a table of
distances to many references discards most pairs cheaply. Distances of 64-bit fingerprints to any reference
have a standard deviation of four, so this test alone cannot say which pairs to look at. Pairs come from
buckets without loss: of five bit blocks, three flipped bits leave at least two untouched, so any linked pair
shares one of ten keys of two blocks each. Within a bucket, pairs go through the table, and what survives is verified.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import as_rows, from_rows, join_hot, lower_table, row_texts, runs, shuffle_parts, text_parts, write_out
from veritrail.llm.components import components

DISTANCE, SEED, PIVOTS = 3, 42, 16
#: Five blocks of 13, 13, 13, 13 and 12 bits; the second table cuts the bits that a crowded bucket leaves open.
BLOCKS, REFINE = 5, 7
#: A bucket with more fingerprints is cut again by further blocks, without loss.
CROWDED = 4096
#: Pairs whose table rows are compared in one vectorised step.
STEP = 1 << 20
#: Groups of over this many fingerprints are probed for neighbours where that is less work than their pairs.
PROBED = 1024


def fingerprint(text: bytes, k: int = 3) -> int:
    """64-bit SimHash of the k-word shingles of text, repeats included; a bit is 1 if set in over half the hashes."""
    words = text.split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(flat, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """docs' doc_id with fp (signed 64-bit). Null and empty texts have fingerprint zero. One pass, no shuffle."""
    some, lower = docs.select("doc_id", "text"), lower_table()

    def make(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), prints(*text_parts(b.column("text")), lower, k)], ["doc_id", "fp"])

    return some.mapInArrow(make, some.select("doc_id").schema.add("fp", "long"))


def prints(data: np.ndarray, at: np.ndarray, lower: np.ndarray, k: int) -> pa.Array:
    flat = lower[data].tobytes()
    return pa.array(np.array([fingerprint(flat[s:e], k) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64).view(np.int64))


def fingerprint_rows(docs: DataFrame, k: int = 3) -> DataFrame:
    """(row, fp): docs' columns as a struct, so that no name clashes, and the text's fingerprint."""
    rows, lower = as_rows(docs), lower_table()

    def make(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), prints(*row_texts(b), lower, k)], ["row", "fp"])

    return rows.mapInArrow(make, rows.select("row").schema.add("fp", "long"))


def masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks of every choice of agree blocks among blocks cut of bits."""
    cut = np.array_split(np.array(bits), blocks)
    return [int(sum(1 << int(i) for x in c for i in cut[x])) for c in combinations(range(blocks), agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_rows(fps: DataFrame, distance: int) -> DataFrame:
    """(table, key, sub, fp): the buckets of every fingerprint. Crowded ones (by an exact count of all keys) are cut
    by `REFINE` blocks of their open bits, any choice that `distance` flips must leave untouched, so nothing is lost."""
    first = masks(list(range(64)), distance + 2, 2)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(first)])).alias("k")).select("fp", "k.table", "k.key")
    crowded = keyed.groupBy("table", "key").count().where(F.col("count") > CROWDED).select("table", "key", F.lit(True).alias("hot"))
    marked = keyed.join(crowded, ["table", "key"], "left")
    subs = F.lit(None)
    for i, m in enumerate(first):
        rest = masks([b for b in range(64) if not m >> b & 1], distance + 4, 4)
        subs = F.when(F.col("table") == i, F.array(*[F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(signed(x)))) for j, x in enumerate(rest)])).otherwise(subs)
    cool, hot = marked.where("hot is null").withColumn("sub", F.lit(0).cast("long")), marked.where("hot").withColumn("sub", F.explode(subs))
    return cool.unionByName(hot).select("table", "key", "sub", "fp")


def references(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**64, n, dtype=np.uint64)


def flips(bits: list[int], distance: int) -> list[int]:
    """All masks of one to `distance` of the bits."""
    return [sum(1 << b for b in c) for d in range(1, distance + 1) for c in combinations(bits, d)]


def near_pairs(fp: np.ndarray, group: np.ndarray, distance: int, pivots: np.ndarray):
    """Linked pairs (positions) among fingerprints in order of their group, in lots.

    Pairs of a group go through the table: one coordinate after another discards those whose distances to a pivot
    differ by more than `distance`; the rest are verified. In a large group whose members differ in few bits only, the
    neighbours of each are looked up instead, which is linear in the group.
    """
    at = runs(group)
    size = np.diff(at)
    probed = np.zeros(len(size), bool)
    for g in np.flatnonzero(size > PROBED).tolist():
        some = fp[at[g] : at[g + 1]]
        vary = int(np.bitwise_or.reduce(some ^ some[0]))
        bits = [b for b in range(64) if vary >> b & 1]
        if sum(math.comb(len(bits), d) for d in range(1, distance + 1)) < len(some) // 2:
            probed[g] = True
            order = np.argsort(some)
            ranked = some[order]
            for mask in flips(bits, distance):
                other = ranked ^ np.uint64(mask)
                where = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
                hit = np.flatnonzero((ranked[where] == other) & (ranked < other))
                if len(hit):
                    yield at[g] + order[hit], at[g] + order[where[hit]]
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
    left = np.repeat(np.where(probed, 0, size), size) - (np.arange(len(fp)) - np.repeat(at[:-1], size))  # members from here on
    i = np.arange(len(fp))
    for shift in range(1, int(np.where(probed, 0, size).max(initial=1))):
        i = i[left[i] > shift]
        for c in range(0, len(i), STEP):
            a = i[c : c + STEP]
            for p in range(table.shape[1]):  # discard by one coordinate after another
                a = a[np.abs(table[a, p] - table[a + shift, p]) <= distance]
            a = a[np.bitwise_count(fp[a] ^ fp[a + shift]) <= distance]
            if len(a):
                yield a, a + shift


def forest(n: int, lots) -> np.ndarray:
    """A spanning forest of pairs over n positions, as rows of two; pairs come in lots, most of which join nothing new."""
    parent, kept = np.arange(n), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    for a, b in lots:
        fresh = parent[a] != parent[b]
        for x, y in zip(a[fresh].tolist(), b[fresh].tolist()):
            u, v = find(x), find(y)
            if u != v:
                parent[max(u, v)] = min(u, v)
                kept.append((x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return np.array(kept, np.int64).reshape(-1, 2)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between different fingerprints that hold together exactly the pairs at `distance` or less: within a
    bucket only a spanning forest of its links is emitted, so that no group's pairs are."""
    rows = bucket_rows(fps, distance).repartition(shuffle_parts(fps.sparkSession), "table", "key", "sub").sortWithinPartitions("table", "key", "sub", "fp")

    def walk(batches):
        pivots, carry = references(), None
        name = ["a", "b"]

        def settle(t, k, s, f):
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
            group = np.cumsum(new)
            size = np.bincount(group)[group]
            some = np.flatnonzero(size > 1)
            if not len(some):
                return None
            fp, g = f[some], group[some]
            edges = forest(len(fp), near_pairs(fp.view(np.uint64), g, distance, pivots))
            if not len(edges):
                return None
            x = edges
            return pa.RecordBatch.from_arrays([pa.array(fp[x[:, 0]]), pa.array(fp[x[:, 1]])], name)

        for b in batches:
            cols = [np.asarray(b.column(c)) for c in ("table", "key", "sub", "fp")]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols)]
            t, k, s, _ = cols
            if not len(t):
                continue
            last = (t == t[-1]) & (k == k[-1]) & (s == s[-1])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            carry = [c[cut:].copy() for c in cols]
            if cut and (out := settle(*[c[:cut] for c in cols])) is not None:
                yield out
        if carry is not None and len(carry[0]) and (out := settle(*carry)) is not None:
            yield out

    return rows.mapInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, k: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of `distance` or fewer bits.

    Exact: equal fingerprints are linked, copies are collapsed to one fingerprint before any comparison, links
    among the rest lose none. Null and empty texts share fingerprint zero and are linked like any other. Null
    ids are kept; a component of nulls alone has a null component_id. Repeated rows come back repeated; other
    columns are left out. An empty table gives no rows.
    """
    fps, _ = write_out(fingerprints(docs, k), "fingerprints")
    least, _ = write_out(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "least")
    comp = components(links(least.select("fp"), distance))
    rooted, _ = write_out(least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    low, _ = write_out(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("m")), "low")
    classes, _ = write_out(join_hot(rooted, low, ["root"], "m").select("fp", "n", "component_id"), "classes")
    return join_hot(fps, classes, ["fp"], "n").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, distance: int = DISTANCE, k: int = 3) -> DataFrame:
    """docs with one document of each component, that of the smallest id; of rows with that id, the one whose text has the
    least hash. Documents with a null id have no place in that order: they stay, one a component and fingerprint,
    unless another of their component has an id. An empty table gives an empty one."""
    classes = near_duplicates(docs, distance, k)
    first = classes.where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    rows = as_rows(docs).withColumn("id", F.col("row.doc_id")).join(first, F.col("id") == F.col("first"), "left_semi")
    out = rows.groupBy("id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row")
    alone = classes.where("component_id is null").select("fp").distinct()
    if not alone.isEmpty():
        null = fingerprint_rows(docs.where("doc_id is null"), k).join(alone, "fp", "left_semi")
        out = out.unionByName(null.groupBy("fp").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row"))
    return from_rows(out, docs.columns)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hex16().alias("fingerprint"), "component_id")
