"""Language-model scores by context-tree weighting over binary-decomposed bytes, learned from the whole corpus.

Each byte is eight binary decisions; a decision's contexts are the last 0 to 5 bytes. Every node of that tree keeps a
Krichevsky-Trofimov estimate, and a decision's probability mixes the estimates of all depths by the weights that the
tree's marginal likelihoods give them: w = Pe / (Pe + product of the children's Pw). Counts stay as trained while
scoring, and a node that training never reached predicts as its parent does.

All counts follow from those of six-byte strings. They are counted by blocks of documents, summed over the corpus,
and turned into a code length each; every block then gets back those of its own strings. Words, for the
unigram base, go the same way. Neither table is ever held in one place; both grow with the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import blocks_for, fold, lower_table, runs, shuffle_parts, slices, text_parts, write_out
from veritrail.llm.lines import over_runs

#: Context bytes; a byte that UTF-8 never has stands before and after every text.
DEPTH, EDGE = 5, 0xFF
#: Nodes deeper than MIDDLE are worked out by contexts of one byte more, those above by contexts of two bytes, and those of
#: depths up to TOP on the driver: at most 65,536 pairs of bytes, whatever the corpus.
MIDDLE, TOP = 3, 1
#: Stored MB of a block of documents, and bytes handled in one vectorised step.
BLOCK_MB, CHUNK = 8, 2 << 20
#: Parts that keys are dealt into: as many as blocks, up to PARTS, or more where a part would hold over PART_KEYS of them.
PARTS, PART_KEYS = 4096, 8_000_000
KEYS = "k1 long, k2 long, block int, n long"


def codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte of every text, and its end: last context byte first, the byte itself last (48 bits); and its row."""
    size = np.diff(at)
    n = len(size)
    flat = np.full(len(data) + (DEPTH + 1) * n, EDGE, np.uint8)
    shift = np.repeat(np.arange(n, dtype=np.int64) * (DEPTH + 1) + DEPTH, size)
    flat[np.arange(len(data)) + shift] = data
    begin = at[:-1] + np.arange(n) * (DEPTH + 1)
    out = flat.astype(np.uint64)
    for d in range(1, DEPTH + 1):
        out[d:] |= flat[:-d].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - d))
    keep = np.ones(len(flat), bool)
    for d in range(DEPTH):
        keep[begin + d] = False
    return out[keep], np.repeat(np.arange(n, dtype=np.int32), size + 1)


def word_keys(words: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two longs, the second odd; strings have second 0."""
    k = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2).copy()
    k[:, 1] |= 1
    return k


def block_counts(table: pa.Table) -> pa.Table:
    """Strings and words of a block with their counts in its training texts (0: only in others)."""
    data, at = text_parts(table.column("text"))
    low, trains = lower_table()[data], table.column("trains").to_numpy(zero_copy_only=False)
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    words, others = Counter(), set()
    for i, j in slices(at, CHUNK):
        part, cut = low[at[i] : at[j]], at[i : j + 1] - at[i]
        c, row = codes(part, cut)
        c = (c << np.uint64(1)) | (~trains[i:j])[row]
        c.sort()
        first = np.concatenate([[True], c[1:] != c[:-1]])
        n = np.diff(np.append(np.flatnonzero(first), len(c)))
        c = c[first]
        n[(c & np.uint64(1)) == 1] = 0
        parts.append(c >> np.uint64(1))
        sizes.append(n)
        flat = part.tobytes()
        for k, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            (words.update if trains[i + k] else others.update)(flat[s:e].split())
    strings, counts = np.concatenate(parts), np.concatenate(sizes)
    order = np.argsort(strings)
    strings, counts = strings[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]])) if len(strings) else np.zeros(0, np.int64)
    counts = np.add.reduceat(counts, starts) if len(starts) else counts
    strings = strings[starts]
    others.difference_update(words)
    both = [*words, *others]
    k = word_keys(both)
    k1 = np.concatenate([strings.view(np.int64), k[:, 0]])
    k2 = np.concatenate([np.zeros(len(strings), np.int64), k[:, 1]])
    n = np.concatenate([counts, np.fromiter(words.values(), np.int64, len(words)), np.zeros(len(others), np.int64)])
    block = np.full(len(k1), table.column("block")[0].as_py(), np.int32)
    return pa.table({"k1": k1, "k2": k2, "block": block, "n": n})


def distinct_of(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Distinct strings, in order, and distinct words, in the order of their hashes, with these, of lower-case texts."""
    parts, words = [np.zeros(0, np.uint64)], set()
    for i, j in slices(at, CHUNK):
        part, cut = low[at[i] : at[j]], at[i : j + 1] - at[i]
        c, _ = codes(part, cut)
        c.sort()
        parts.append(c[np.concatenate([[True], c[1:] != c[:-1]])])
        flat = part.tobytes()
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            words.update(flat[s:e].split())
    strings = np.concatenate(parts)
    strings.sort()
    if len(strings):
        strings = strings[np.concatenate([[True], strings[1:] != strings[:-1]])]
    all_words = list(words)
    k = word_keys(all_words)
    order = np.lexsort((k[:, 1], k[:, 0]))
    return strings, [all_words[i] for i in order.tolist()], k[order]


def part_of(k1: np.ndarray, parts: int) -> np.ndarray:
    """pmod(xxhash64(k1), parts) as Spark computes it: XXH64 of eight bytes with seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = (np.uint64(42 + 8) + p5) ^ (turn(k1.view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % parts


def asks(table: pa.Table, parts: int) -> pa.Table:
    """What a block wants to know of each part: its strings, as packed differences, and its words' hashes."""
    data, at = text_parts(table.column("text"))
    strings, _, words = distinct_of(lower_table()[data], at)
    block = table.column("block")[0].as_py()
    of_string, of_word = part_of(strings.view(np.int64), parts), part_of(words[:, 0], parts)
    by_string, by_word = np.argsort(of_string, kind="stable"), np.argsort(of_word, kind="stable")
    cut_s, cut_w = (np.searchsorted(x, np.arange(parts + 1)) for x in (of_string[by_string], of_word[by_word]))
    some = np.flatnonzero((np.diff(cut_s) > 0) | (np.diff(cut_w) > 0)).tolist()
    keys = [zlib.compress(np.diff(strings[by_string[cut_s[p] : cut_s[p + 1]]], prepend=np.uint64(0)).tobytes(), 1) for p in some]
    hashes = [words[by_word[cut_w[p] : cut_w[p + 1]]].tobytes() for p in some]
    return pa.table({"part": pa.array(some, pa.int32()), "block": pa.array([block] * len(some), pa.int32()), "keys": pa.array(keys, pa.binary()), "words": pa.array(hashes, pa.binary())})


class Answers:
    """The values of one part, in memory, and blocks' lists of keys as they stream by."""

    def __init__(self, values: pa.Table):
        k1, k2, value = (values.column(c).to_numpy() for c in ("k1", "k2", "value"))
        is_string = k2 == 0
        strings, cost = k1[is_string], value[is_string].astype(np.float32)
        order = np.argsort(strings)
        self.strings, self.cost = strings[order].view(np.uint64), cost[order]
        word = np.flatnonzero(~is_string)
        word = word[np.lexsort((k2[word], k1[word]))]
        self.w1, self.w2, self.count = k1[word], k2[word], value[word].astype(np.int64)

    def of(self, keys: bytes, hashes: bytes) -> tuple[bytes, bytes]:
        """Values of a block's keys of this part, in the same order."""
        wanted = np.cumsum(np.frombuffer(zlib.decompress(keys), np.uint64))
        h = np.frombuffer(hashes, np.int64).reshape(-1, 2)
        at = np.searchsorted(self.w1, h[:, 0])
        while len(at) and (off := self.w2[at] != h[:, 1]).any():  # equal first halves: the next
            at = at + off
        return zlib.compress(self.cost[np.searchsorted(self.strings, wanted)].tobytes(), 1), zlib.compress(self.count[at].tobytes(), 1)


def answered(batches):
    """From rows sorted by part, a part's values before its blocks' lists: (block, part, costs, counts)."""
    part, held, ready = None, [], None
    for b in batches:
        kinds, parts = b.column("kind").to_numpy(), b.column("part").to_numpy()
        at = np.union1d(runs(kinds), runs(parts)).tolist()
        for s, e in zip(at, at[1:]):
            if parts[s] != part:
                part, held, ready = parts[s], [], None
            some = b.slice(s, e - s)
            if kinds[s] == 0:
                held.append(some.select(["k1", "k2", "value"]))
                continue
            if ready is None:
                ready, held = Answers(pa.Table.from_batches(held)), []
            got = [ready.of(k, h) for k, h in zip(some.column("keys").to_pylist(), some.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([some.column("block"), some.column("part"), *[pa.array(c, pa.binary()) for c in zip(*got)]], ["block", "part", "costs", "counts"])


_lgamma = np.frompyfunc(lgamma, 1, 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Through the distinct values, which are few."""
    u, inv = np.unique(x, return_inverse=True)
    return _lgamma(u).astype(np.float64)[inv] if len(u) else x


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def level(grams: np.ndarray, n: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted (context, byte) grams with counts, at bit t: node ids (context, first t bits), node of each gram, zeros and ones."""
    node = grams >> (8 - t)
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    one = n * ((grams >> (7 - t)) & 1)
    n1 = np.add.reduceat(one, starts)
    n0 = np.add.reduceat(n - one, starts)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
    return node[starts], of, n0, n1


def parent_sums(nodes: np.ndarray, value: np.ndarray, parents: np.ndarray, t: int) -> np.ndarray:
    """Sums of value over the nodes one byte deeper; a node's context ends (low) with its oldest byte."""
    up = ((nodes >> (t + 8)) << t) | (nodes & ((1 << t) - 1))
    return np.bincount(np.searchsorted(parents, up), value, len(parents))


def deeper(grams: np.ndarray, n: np.ndarray):
    """(context one byte shorter, byte) grams, sorted, with counts; and of each input gram its place there."""
    u, inv = np.unique(((grams >> 16) << 8) | (grams & 255), return_inverse=True)
    return u, np.bincount(inv, n, len(u)).astype(np.int64), inv


def tree_levels(grams: np.ndarray, n: np.ndarray, deep: int, low: int, given: tuple[np.ndarray, np.ndarray] | None = None):
    """Of sorted grams (deep context bytes and a byte) whose contexts are whole subtrees from depth `low` on: add, times and
    fill, such that each bit's probability by those depths is add + times * (that of deeper ones, or fill where training
    reached none; fill is nan where it reached not even depth `low`); and log Pw of the nodes at depth `low`, summed by
    their parents. given: ids and sums of the nodes at depth `deep`, from a call for what is deeper."""
    chain, maps = [(grams, n)], [np.arange(len(grams))]
    for _ in range(deep, low, -1):
        u, c, inv = deeper(*chain[-1])
        chain.append((u, c))
        maps.append(inv[maps[-1]])
    add, times, fill = (np.zeros((len(grams), 8)) for _ in range(3))
    up_nodes, up_values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for t in range(8):
        below_nodes = below = None
        stack = []
        for (g, c), where in zip(chain, maps):
            node, of, n0, n1 = level(g, c, t)
            pe, total = kt(n0, n1), n0 + n1
            if below is not None:
                s = parent_sums(below_nodes, below, node, t)
            elif given is not None:
                mine = (given[0] & 7) == t
                order = np.argsort(given[0][mine])
                s = given[1][mine][order][np.searchsorted(given[0][mine][order] >> 3, node)]
            else:
                s = None
            pw = pe if s is None else np.logaddexp(pe, s) - np.log(2)
            w = np.ones(len(node)) if s is None else 1 / (1 + np.exp(np.clip(s - pe, -700, 700)))
            at = of[where]
            bit = ((grams >> (7 - t)) & 1).astype(bool)
            stack.append(((np.where(bit, n1[at], n0[at]) + 0.5) / (total[at] + 1), w[at], total[at] > 0))
            below_nodes, below = node, pw
        a, b, last = np.zeros(len(grams)), np.ones(len(grams)), np.full(len(grams), np.nan)
        for own, w, live in reversed(stack):  # from the root down
            a, b, last = np.where(live, a + b * w * own, a), np.where(live, b * (1 - w), b), np.where(live, own, last)
        add[:, t], times[:, t], fill[:, t] = a, b, last
        if low:
            u, inv = np.unique(((below_nodes >> (t + 8)) << t) | (below_nodes & ((1 << t) - 1)), return_inverse=True)
            up_nodes.append((u << 3) | t)
            up_values.append(np.bincount(inv, below, len(u)))
    return add, times, fill, np.concatenate(up_nodes), np.concatenate(up_values)


def level_rows(grams: np.ndarray, n: np.ndarray, rows: np.ndarray, nodes: np.ndarray, sums: np.ndarray, deep: int, low: int) -> pa.RecordBatch:
    """(kind, k1, n, p): 0, grams with their rows; 1, parents' nodes with sums; 2, grams of low - 1 context bytes with counts."""
    short = ((grams >> (8 * (deep - low + 2))) << 8) | (grams & 255)
    u, inv = np.unique(short, return_inverse=True)
    sizes = [len(grams), len(nodes), len(u)]
    ends = np.concatenate([[0], np.cumsum(np.repeat([rows.shape[1], 1, 0], sizes))]).astype(np.int32)
    p = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([rows.ravel(), sums])))
    counts = np.concatenate([np.zeros(len(grams) + len(nodes), np.int64), np.bincount(inv, n, len(u)).astype(np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1, 2], np.int8), sizes)), pa.array(np.concatenate([grams, nodes, u])), pa.array(counts), p], ["kind", "k1", "n", "p"])


LEVELS = "kind byte, k1 long, n long, p array<double>"


def string_costs(strings: DataFrame) -> DataFrame:
    """(k1, value): log10 of each string's last byte's probability after the others, from (k1, n)."""
    spark = strings.sparkSession

    def deepest(t):
        g, n = t.column("k1").to_numpy(), t.column("n").to_numpy()
        add, times, fill, nodes, sums = tree_levels(g, n, DEPTH, MIDDLE + 1)
        prob = (add + times * fill).astype(np.float32).astype(np.float64)  # nan where training reached nothing
        yield level_rows(g, n, prob, nodes, sums, DEPTH, MIDDLE + 1)

    dealt = strings.select("k1", "n", F.shiftright("k1", 8 * (DEPTH - MIDDLE)).alias("ctx")).repartition(shuffle_parts(spark), "ctx").sortWithinPartitions("ctx", "k1")
    made, _ = write_out(dealt.mapInArrow(lambda batches: over_runs(batches, ["ctx"], [], deepest), LEVELS), "subtrees")

    def middle(t):
        kind, k1 = t.column("kind").to_numpy(), t.column("k1").to_numpy()
        g, n = k1[kind == 2], t.column("n").to_numpy()[kind == 2]
        add, times, fill, nodes, sums = tree_levels(g, n, MIDDLE, TOP + 1, (k1[kind == 1], t.column("s").to_numpy()[kind == 1]))
        yield level_rows(g, n, np.concatenate([add, times, fill], 1), nodes, sums, MIDDLE, TOP + 1)

    grams = made.where("kind = 2").groupBy("k1").agg(F.sum("n").alias("n")).select(F.shiftright("k1", 8 * (MIDDLE - TOP)).alias("ctx"), F.lit(2).alias("kind"), "k1", "n", F.lit(0.0).alias("s"))
    nodes = made.where("kind = 1").groupBy("k1").agg(F.sum(F.col("p")[0]).alias("s")).select(F.expr(f"shiftright(shiftright(k1, 3), cast(k1 & 7 as int) + {8 * (MIDDLE - TOP - 1)})").alias("ctx"), F.lit(1).alias("kind"), "k1", F.lit(0).cast("long").alias("n"), "s")
    dealt = grams.unionByName(nodes).repartition(shuffle_parts(spark), "ctx").sortWithinPartitions("ctx", "kind", "k1")
    mid, _ = write_out(dealt.mapInArrow(lambda batches: over_runs(batches, ["ctx"], [], middle), LEVELS), "middle")
    pairs = mid.where("kind = 2").groupBy("k1").agg(F.sum("n").alias("n")).toArrow().sort_by("k1")  # at most 2**16 rows
    tops = mid.where("kind = 1").groupBy("k1").agg(F.sum(F.col("p")[0]).alias("s")).toArrow()  # at most 2**16 rows
    g = pairs.column("k1").to_numpy()
    if not len(g):
        return spark.createDataFrame([], "k1 long, value double")
    top = (g, *tree_levels(g, pairs.column("n").to_numpy(), TOP, 0, (tops.column("k1").to_numpy(), tops.column("s").to_numpy()))[:3])

    def compose(batches):
        pairs, a0, t0, f0 = top
        f0 = np.where(np.isnan(f0), 0.5, f0)
        for b in batches:
            k1 = b.column("k1").to_numpy()
            if not len(k1):
                continue
            at = np.searchsorted(pairs, ((k1 >> (8 * (MIDDLE - TOP + 1))) << 8) | (k1 & 255))
            a, t, f = b.column("p").flatten().to_numpy().reshape(-1, 3, 8).transpose(1, 0, 2)
            none = np.isnan(f)
            a, t, f = np.where(none, a0[at] + t0[at] * f0[at], a0[at] + t0[at] * a), np.where(none, 0, t0[at] * t), np.where(none, 0, f)
            yield pa.RecordBatch.from_arrays([b.column("k1"), *[pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float64())) for x in (a, t, f)]], ["pair", "a", "t", "f"])

    whole = mid.where("kind = 0").select("k1", "p").mapInArrow(compose, "pair long, a array<double>, t array<double>, f array<double>")
    pair = F.shiftleft(F.shiftright("k1", 8 * (DEPTH - MIDDLE + 1)), 8).bitwiseOR(F.col("k1").bitwiseAND(255))
    rows = made.where("kind = 0").select("k1", "p", pair.alias("pair")).join(whole, "pair")
    value = sum((F.log10(F.col("a")[t] + F.col("t")[t] * F.when(F.isnan(F.col("p")[t]), F.col("f")[t]).otherwise(F.col("p")[t])) for t in range(8)), F.lit(0.0))
    return rows.select("k1", value.alias("value"))


def score_texts(docs: DataFrame, trains) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every whole text,
    learned from the documents that `trains` (a condition) holds of.

    Texts are in lower case (A-Z); a null text is empty, and an empty one is an end alone. Without training texts,
    every decision has probability one half. Null ids are kept; repeated rows are counted, and scored, each. Other columns
    are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = blocks_for(docs, BLOCK_MB)
    blocked = docs.select("doc_id", "text", trains.alias("trains"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")).repartition(n, "block")
    raw = blocked.groupBy("block").applyInArrow(block_counts, KEYS)
    keys, _ = write_out(raw.groupBy("k1", "k2").agg(F.sum("n").alias("n")), "keys")
    ends = docs.where(trains).count()
    word = F.col("k2") != 0
    sums = keys.agg(F.count("*").alias("keys"), F.count_if(word & (F.col("n") > 0)).alias("v"), F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)).alias("n")).first()
    tokens, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    least = np.log10(tokens + distinct + 1.0)
    costs = string_costs(keys.where("k2 = 0").select("k1", "n"))
    values = keys.where("k2 <> 0").select("k1", "k2", F.col("n").cast("double").alias("value")).unionByName(costs.select("k1", F.lit(0).cast("long").alias("k2"), "value"))
    parts = max(min(max(shuffle_parts(spark), n), PARTS), -(-sums["keys"] // PART_KEYS))
    asked = blocked.groupBy("block").applyInArrow(lambda t: asks(t, parts), "part int, block int, keys binary, words binary")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    dealt = values.select(F.pmod(F.xxhash64("k1"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), F.lit(-1).alias("block"), "k1", "k2", "value", *none("binary", "keys", "words"))
    dealt = dealt.union(asked.select("part", F.lit(1).alias("kind"), "block", *none("long", "k1", "k2"), *none("double", "value"), "keys", "words"))
    back = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "kind", "block").mapInArrow(answered, "block int, part int, costs binary, counts binary")
    end_cost = float(np.log10(ends + 1.0) - least)

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        data, at = text_parts(texts.column("text"))
        low, m = lower_table()[data], texts.num_rows
        strings, words, word_hash = distinct_of(low, at)
        cost, count = np.zeros(len(strings)), np.zeros(len(words))
        of_string, of_word = part_of(strings.view(np.int64), parts), part_of(word_hash[:, 0], parts)
        by_string, by_word = np.argsort(of_string, kind="stable"), np.argsort(of_word, kind="stable")
        cut_s, cut_w = (np.searchsorted(x, np.arange(parts + 1)) for x in (of_string[by_string], of_word[by_word]))
        for part, a, b in zip(*(known.column(c).to_pylist() for c in ("part", "costs", "counts"))):
            cost[by_string[cut_s[part] : cut_s[part + 1]]] = np.frombuffer(zlib.decompress(a), np.float32)
            count[by_word[cut_w[part] : cut_w[part + 1]]] = np.frombuffer(zlib.decompress(b), np.int64)
        costs_of = dict(zip(words, (np.log10(count + 1) - least).tolist()))
        unseen = {words[i] for i in np.flatnonzero(count == 0).tolist()}
        total, base, n_tokens, n_known = np.zeros(m), np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for i, j in slices(at, CHUNK):
            for i2 in range(i, j, 1 << 16):
                j2 = min(j, i2 + (1 << 16))
                part, cut = low[at[i2] : at[j2]], at[i2 : j2 + 1] - at[i2]
                c, row = codes(part, cut)
                c = (c << np.uint64(16)) | row.astype(np.uint64)
                c.sort()
                s = c >> np.uint64(16)
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                each = np.repeat(cost[np.searchsorted(strings, s[first])], np.diff(np.append(first, len(s))))
                total[i2:j2] = np.bincount((c & np.uint64(0xFFFF)).astype(np.int64), each, j2 - i2)
                flat = part.tobytes()
                for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()), i2):
                    own = flat[a:b].split()
                    n_tokens[k] = len(own) + 1
                    base[k] = sum(map(costs_of.__getitem__, own)) + end_cost
                    n_known[k] = len(own) - (sum(map(unseen.__contains__, own)) if unseen else 0) + (ends > 0)
        held = pa.array(~texts.column("trains").to_numpy(zero_copy_only=False))
        return pa.table([texts.column("doc_id"), held, pa.array(n_tokens), pa.array(n_known), pa.array(np.full(m, tokens, np.int64)), pa.array(base), pa.array(total)], names=OUT)

    OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)


def op2_ctw(spark, sf_dir: str) -> DataFrame:
    """Every document's code length; learned from those whose crc32 mod 7 is not 2."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), fold("doc_id", 7) != 2)
