"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

Trained on every labelled document: in each epoch tasks take steps on their own share of the rows, from the same weights, and their
moves are averaged. A word's embedding is the sum of two hashes' and of its first bytes' hash. For scoring, embeddings and filters are
multiplied out to one table row a bucket, so that a text costs a lookup and a few sums a word. Thresholds are chosen by language, the
language being guessed from the text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import as_rows, fold, from_rows, lower_table, row_texts, scratch, slices, text_parts, write_out
from veritrail.operators.ranges import running

#: Buckets (as powers of two) of words (of two bytes at most), and of the second hash and of prefixes; prefix bytes; size of embeddings; filters a width; widths.
WORD_BITS, PREFIX_BITS, PREFIX, SIZE, FILTERS, WIDTHS = 16, 15, 4, 12, 8, (1, 2, 3)
#: Rows and words of a step at most (a longer text is a step of its own).
EPOCHS, BATCH, BATCH_WORDS, RATE, SEED = 6, 64, 200_000, 0.1, 11
#: Rows that a task of an epoch has at least, where there are several; blocks that weights are cut to when they are averaged.
SHARD, BLOCKS = 4000, 64
#: Bits of the filter of labelled ids: 4 MB, whatever the corpus. A full filter only lets more texts through to the join.
FILTER_BITS = 25
#: One labelled row in so many is kept for thresholds; toxic rows that a language needs there for a threshold of its own. Languages
#: with fewer share one threshold, and one column of the guess, and so do all but the MOST_LANGS with most toxic rows.
VALIDATION, LEAST, MOST_LANGS, REST = 4, 20, 64, "*"
CHUNK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word bucket, and buckets of the second hash and the prefix (two rows), of every word: a run of letters, digits and bytes beyond ASCII, in lower case.

    The hash covers a word's length, its first eight bytes and its last eight.
    """
    low = lower_table()[data]
    part = np.zeros(256, bool)
    part[48:58] = part[97:123] = part[128:] = True
    inside = part[low]
    n = len(low)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros((2, 0), np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False
    after[edges[1:] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    length = end - start
    pad = np.concatenate([low, np.zeros(8, np.uint8)]).astype(np.uint64)
    head, tail = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for k in range(8):
        has = length > k
        head |= np.where(has, pad[start + k], 0).astype(np.uint64) << np.uint64(8 * k)
        tail |= np.where(has, pad[end - 1 - k], 0).astype(np.uint64) << np.uint64(8 * k)
    whole = ((head * MIX) ^ (tail >> np.uint64(3))) * MIX ^ length.astype(np.uint64)
    words = (whole * MIX) >> np.uint64(64 - WORD_BITS)
    prefix = ((head & np.uint64((1 << 8 * PREFIX) - 1)) * MIX) >> np.uint64(64 - PREFIX_BITS)
    second = ((whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - PREFIX_BITS)
    return np.searchsorted(offsets, start, "right") - 1, words.astype(np.int64), np.stack([second, prefix + np.uint64(1 << PREFIX_BITS)]).astype(np.int64)


class Classifier:
    def __init__(self, langs: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.words = r.normal(0, 0.1, (1 << WORD_BITS, SIZE)).astype(np.float32)
        self.prefixes = r.normal(0, 0.1, (2 << PREFIX_BITS, SIZE)).astype(np.float32)
        self.filters = [r.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.shift = 0.0
        self.lang_table = np.zeros((1 << WORD_BITS, max(1, len(langs))), np.float32)
        self.cut = np.zeros(max(1, len(langs)))  # a language's threshold, as a logit
        self.table = self.table_prefix = None

    def convolve(self, parts: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Filter values at every word from the table's columns; words past a text's end count as zeros."""
        ys, col = [], 0
        for w in WIDTHS:
            y = parts[:, col : col + FILTERS].copy()
            for o in range(1, w):
                same = (doc[o:] == doc[:-o])[:, None]
                y[:-o] += parts[o:, col + o * FILTERS : col + (o + 1) * FILTERS] * same
            ys.append(y)
            col += w * FILTERS
        return np.concatenate(ys, 1)

    def compile(self) -> None:
        flat = np.concatenate([f.transpose(1, 0, 2).reshape(SIZE, -1) for f in self.filters], 1)
        self.table = np.concatenate([self.words @ flat, self.lang_table], 1)
        self.table_prefix = self.prefixes @ flat

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and guessed language of each text."""
        n = len(offsets) - 1
        pooled = np.zeros((n, len(self.bias)), np.float32)
        guess = np.zeros(n, np.int64)
        for i, j in slices(offsets, CHUNK):
            doc, words, prefix = word_ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(doc):
                continue
            wide = self.table[words]
            parts = wide[:, : self.table_prefix.shape[1]] + self.table_prefix[prefix[0]]
            parts += self.table_prefix[prefix[1]]
            at = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
            rows = doc[at] + i
            pooled[rows] = np.maximum.reduceat(self.convolve(parts, doc), at, axis=0)
            guess[rows] = np.add.reduceat(wide[:, self.table_prefix.shape[1] :], at, axis=0).argmax(1)
        return np.maximum(0, pooled + self.bias) @ self.out + self.shift, guess

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.5 is the threshold of the guessed language."""
        z, guess = self.logits(data, offsets)
        return 1 / (1 + np.exp(-np.clip(z - self.cut[guess], -40, 40).astype(np.float64)))

    def weights(self) -> dict:
        return {"words": self.words, "prefixes": self.prefixes, "bias": self.bias, "out": self.out, **dict(enumerate(self.filters))}

    def no_sums(self) -> dict:
        """Adagrad's sums of squares before the first step."""
        return {k: np.full(v.shape, 1e-3, np.float32) for k, v in self.weights().items()} | {"shift": np.full(1, 1e-3, np.float32)}

    def flat(self, sums: dict) -> np.ndarray:
        """Weights and sums as one vector."""
        return np.concatenate([*[v.ravel() for v in self.weights().values()], np.array([self.shift], np.float32), *[v.ravel() for v in sums.values()]])

    def set_flat(self, vector: np.ndarray) -> dict:
        """Takes weights over from such a vector, and returns its sums."""
        sums, at = self.no_sums(), 0
        for v in (*self.weights().values(), None, *sums.values()):
            if v is None:
                self.shift, at = float(vector[at]), at + 1
            else:
                v[...], at = vector[at : at + v.size].reshape(v.shape), at + v.size
        return sums

    def train(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, sums: dict | None = None, seed: int = SEED + 1) -> None:
        """Adagrad on the weighted logistic loss; docs are (word ids, prefix ids), none empty. Goes on from sums, if given, and adds to them."""
        r = np.random.default_rng(seed)
        sums = self.no_sums() if sums is None else sums

        def step(key, value, grad, rows=None):
            if rows is None:
                sums[key] += grad**2
                value -= rate * grad / np.sqrt(sums[key])
            else:
                sums[key][rows] += grad**2
                value[rows] -= rate * grad / np.sqrt(sums[key][rows])

        for _ in range(epochs):
            for pick in steps(r.permutation(len(docs)), [len(d[0]) for d in docs]):
                words, prefix = np.concatenate([docs[i][0] for i in pick]), np.concatenate([docs[i][1] for i in pick], 1)
                doc = np.repeat(np.arange(len(pick)), [len(docs[i][0]) for i in pick])
                x = self.words[words] + self.prefixes[prefix[0]] + self.prefixes[prefix[1]]
                flat = np.concatenate([f.transpose(1, 0, 2).reshape(SIZE, -1) for f in self.filters], 1)
                conv = self.convolve(x @ flat, doc)
                at = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
                pooled = np.maximum.reduceat(conv, at, axis=0)
                h = np.maximum(0, pooled + self.bias)
                p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.shift, -40, 40)))
                g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                dh = g[:, None] * self.out * (h > 0)
                f, t = np.nonzero((conv == pooled[doc]).T)
                _, firsts = np.unique(f * len(pick) + doc[t], return_index=True)
                f, t = f[firsts], t[firsts]
                grads = [np.zeros_like(k) for k in self.filters]
                touched, dx = [], []
                for k, w in enumerate(WIDTHS):
                    mine = f // FILTERS == k
                    ff, tt = f[mine] % FILTERS, t[mine]
                    d = dh[doc[tt], f[mine]]
                    for o in range(w):
                        ok = (tt + o < len(doc)) & (d != 0)
                        ok[ok] &= doc[tt[ok] + o] == doc[tt[ok]]
                        u, c, e = tt[ok] + o, ff[ok], d[ok]
                        np.add.at(grads[k][o].T, c, e[:, None] * x[u])
                        touched.append(u)
                        dx.append(e[:, None] * self.filters[k][o].T[c])
                step("out", self.out, h.T @ g)
                step("bias", self.bias, dh.sum(0))
                sums["shift"] += float(g.sum()) ** 2
                self.shift -= rate * float(g.sum()) / float(sums["shift"][0]) ** 0.5
                for k, grad in enumerate(grads):
                    step(k, self.filters[k], grad)
                u, e = np.concatenate(touched), np.concatenate(dx)
                for key, value, ids in (("words", self.words, words), ("prefixes", self.prefixes, prefix[0]), ("prefixes", self.prefixes, prefix[1])):
                    rows, inv = np.unique(ids[u], return_inverse=True)
                    total = np.zeros((len(rows), SIZE), np.float32)
                    np.add.at(total, inv, e)
                    step(key, value, total, rows)

    def set_langs(self, counts: np.ndarray) -> None:
        """Log-likelihood of each word bucket by language, from counts (buckets by languages)."""
        self.lang_table = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * len(counts))).astype(np.float32)
        self.lang_table -= self.lang_table.mean(1, keepdims=True)


def steps(order: np.ndarray, words: list[int]):
    """order cut to lots of at most BATCH rows and BATCH_WORDS words; a longer row stands alone."""
    lot, n = [], 0
    for i in order:
        if lot and (len(lot) == BATCH or n + words[i] > BATCH_WORDS):
            yield np.array(lot)
            lot, n = [], 0
        lot.append(i)
        n += words[i]
    if lot:
        yield np.array(lot)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, lang, held, ids) of every labelled document with words, as a written table: six bytes a word. held are the rows for
    thresholds. Texts don't leave their tasks: a filter of fixed size lets through those that may be labelled, and
    what is joined with the labels is their ids of words."""
    ids = labels.where("toxic in (0, 1)").select("doc_id", "toxic").distinct()
    bit = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    place = F.shiftright(bit, 6).alias("_word")
    words = ids.select(place, F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))").alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))  # at most 2 ** (FILTER_BITS - 6) rows
    some = docs.select("doc_id", "text", "lang", place).join(F.broadcast(words), "_word").where("shiftright(_mask, cast(xxhash64(doc_id) & 63 as int)) & 1 = 1").select("doc_id", "lang", "text")

    def read(batches):
        for b in batches:
            data, at = text_parts(b.column("text"))
            for i, j in slices(at, CHUNK):
                row, x, p = word_ids(data[at[i] : at[j]], at[i : j + 1] - at[i])
                ids, ends = np.concatenate([x[None], p]).astype(np.uint16), np.searchsorted(row, np.arange(j - i + 1))
                keep = np.flatnonzero(np.diff(ends))
                who = pa.array(keep + i, pa.int64())
                held = pa.array([ids[:, ends[k] : ends[k + 1]].tobytes() for k in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(who), b.column("lang").take(who), held], ["doc_id", "lang", "ids"])

    coded = some.mapInArrow(read, some.drop("text").schema.add("ids", "binary")).join(ids, "doc_id")
    return write_out(coded.select("toxic", "lang", (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(VALIDATION)) == 0).alias("held"), "ids"), "labelled")[0]


def coded_docs(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    found = [np.frombuffer(x, np.uint16).reshape(3, -1) for x in batch.column("ids").to_pylist()]
    return [(x[0], x[1:]) for x in found]


def gathered(rows: DataFrame, work: Callable, kind: type, mean: bool = False) -> np.ndarray:
    """What work makes of each task's batches, a vector of one length, added up by blocks in tasks; mean: each number over the tasks
    where it isn't zero. The driver gets one vector."""

    def run(batches):
        parts = np.array_split(work(batches), BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([p.astype(kind).tobytes() for p in parts], pa.binary())], ["block", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = moved = 0
        for x in t.column("part").to_pylist():
            part = np.frombuffer(x, kind)
            total, moved = total + part, moved + (part != 0)
        out = (total / np.maximum(1, moved)).astype(kind) if mean else total
        return pa.table({"block": t.column("block")[:1], "part": pa.array([out.tobytes()], pa.binary())})

    kinds = "block int, part binary"
    out = rows.mapInArrow(run, kinds).groupBy("block").applyInArrow(add, kinds).toArrow().sort_by("block")
    return np.frombuffer(b"".join(out.column("part").to_pylist()), kind)


def trained(model: Classifier, rows: DataFrame, balance: list[float], shards: int) -> None:
    """EPOCHS over all rows (toxic, ids), each by `shards` tasks, whose moves are averaged over those that made one. A task reads its
    rows as a stream, and takes those of a batch in random order."""
    spark, langs = rows.sparkSession, model.langs
    state = model.flat(model.no_sums())
    for epoch in range(EPOCHS):
        held = spark.sparkContext.broadcast(state)

        def work(batches, epoch=epoch, held=held):
            mine = Classifier(langs)
            sums = mine.set_flat(held.value)
            for n, b in enumerate(batches):
                y = b.column("toxic").to_numpy()
                mine.train(coded_docs(b), y.astype(np.float32), np.array(balance, np.float32)[y], 1, sums=sums, seed=SEED + 1 + epoch + EPOCHS * n)
            return mine.flat(sums) - held.value

        state = state + gathered(rows.select("toxic", "ids").coalesce(shards), work, np.float32, mean=True)
        held.destroy()
    model.set_flat(state)


def lang_counts(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """How often each word bucket (a row) is in texts of each language (a column); languages not of their own are REST."""
    at, rest = {k: i for i, k in enumerate(langs)}, langs.index(REST) if REST in langs else None

    def work(batches):
        counts = np.zeros((len(langs), 1 << WORD_BITS), np.int64)
        for b in batches:
            for (words, _), lang in zip(coded_docs(b), b.column("lang").to_pylist()):
                if (k := at.get(lang, rest)) is not None:
                    counts[k] += np.bincount(words, minlength=counts.shape[1])
        return counts.ravel()

    return gathered(rows.select("lang", "ids"), work, np.int64).reshape(len(langs), -1).T


def judged(rows: DataFrame, model: Classifier) -> DataFrame:
    """(guess, z, toxic): language and logit of every row."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        width = m.table_prefix.shape[1]
        for b in batches:
            z, guess = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            for k, (words, prefix) in enumerate(coded_docs(b)):
                wide = m.table[words]
                conv = m.convolve(wide[:, :width] + m.table_prefix[prefix[0]] + m.table_prefix[prefix[1]], np.zeros(len(wide), np.int64))
                z[k] = np.maximum(0, conv.max(0) + m.bias) @ m.out + m.shift
                guess[k] = wide[:, width:].sum(0).argmax()
            yield pa.RecordBatch.from_arrays([pa.array(guess), pa.array(z), b.column("toxic")], ["guess", "z", "toxic"])

    return rows.select("toxic", "ids").mapInArrow(run, "guess int, z double, toxic int")


def thresholds(rows: DataFrame) -> dict[int, tuple[float, int]]:
    """(cut, toxic rows) of each guess in rows (guess, z, toxic), and at -1 of all of them: the logit in the middle of the widest gap that
    reaches the best F1. Rows are sorted and summed by ranges."""
    each = rows.select(F.explode(F.array(F.lit(-1), "guess")).alias("guess"), "z", "toxic")
    points = each.groupBy("guess", "z").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("hit")).withColumn("one", F.lit(1).cast("long"))
    run = write_out(running(points, ["guess"], [F.desc("z")], ["n", "hit", "one"]).select("guess", "z", F.col("one_to").alias("place"), "hit_all", (2 * F.col("hit_to") / (F.col("n_to") + F.col("hit_all"))).alias("f1")), "cuts")[0]
    best = run.groupBy("guess").agg(F.max("f1").alias("best"))  # a row a language
    top = run.join(F.broadcast(best), "guess").where("f1 >= best - 1e-9")
    below = run.select("guess", (F.col("place") - 1).alias("place"), F.col("z").alias("below"))
    gaps = top.join(below, ["guess", "place"], "left").withColumn("below", F.coalesce("below", F.col("z") - 1))
    found = gaps.groupBy("guess").agg(F.max_by((F.col("z") + F.col("below")) / 2, F.struct(F.col("z") - F.col("below"), "z")).alias("cut"), F.max("hit_all").alias("hits"))
    return {r["guess"]: (r["cut"], r["hits"]) for r in found.collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Classifier of docs (doc_id, text, lang) with labels (doc_id, toxic), from all of them. Without both labels it scores all texts
    alike, below 0.5. How rows are dealt to tasks moves weights a little."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = labelled(docs, labels)
        n = {(r["held"], r["toxic"]): r["count"] for r in rows.groupBy("held", "toxic").count().collect()}
        clean, toxic = (n.get((False, y), 0) + n.get((True, y), 0) for y in (0, 1))
        if not clean or not toxic:
            model = Classifier([])
            model.cut[:] = 40
            model.compile()
            return model
        split = len(n) == 4  # both labels on either side, else all rows serve for both
        train, some = (rows.where(~F.col("held")), rows.where("held")) if split else (rows, rows)
        enough = some.where("toxic = 1 and lang is not null").groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
        own = sorted(r["lang"] for r in enough.orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect())
        others = not rows.where(~F.coalesce(F.col("lang").isin(own), F.lit(False))).isEmpty()
        model = Classifier([*own, REST] if others else own)
        shards = sum(k for (held, _), k in n.items() if not (split and held)) // SHARD
        trained(model, train, [(clean + toxic) / (2 * clean), (clean + toxic) / (2 * toxic)], max(1, min(shards, spark.sparkContext.defaultParallelism)))
        model.set_langs(lang_counts(train, model.langs))
        model.compile()
        cuts = thresholds(write_out(judged(some, model), "judged")[0])
        for k in range(len(model.cut)):
            cut, hits = cuts.get(k, (0.0, 0))
            model.cut[k] = cut if hits >= LEAST else cuts[-1][0]
        return model


def score_toxicity(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with score and predicted; one pass over whole texts, no shuffle. Null and empty texts are scored as no words.

    Columns named score or predicted, in any case, are replaced; repeated rows are scored alike; null ids are kept; an
    empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by its buckets
    rows = as_rows(docs, keep)

    def score(batches):
        m = held.value
        for b in batches:
            s = m.scores(*row_texts(b))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    out = rows.mapInArrow(score, rows.select("row").schema.add("score", "double").add("predicted", "integer"))
    return from_rows(out, keep, "score", "predicted")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity; learned from labelled documents whose crc32 mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
