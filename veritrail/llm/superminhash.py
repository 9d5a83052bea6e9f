"""Near-duplicate documents by SuperMinHash signatures, banding, verification on whole sets of shingles and union-find.

Every shingle walks through all registers in a random order of its own and offers register number j of that order the
value j plus a random fraction; a register keeps the least offer. Ranks of one shingle are thus tied together, which
gives estimates of lower variance than independent permutations. A text is done as soon as no later step can lower any
of its registers: for texts of many shingles after two or three steps instead of one for each register.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from veritrail.llm.common import join_hot, lower_table, slices, text_parts, write_out
from veritrail.llm.components import components
from veritrail.llm.lines import families, family_links, mix, set_forest

#: Words of a shingle, and the least similarity of copies in hundredths.
WORDS, PERCENT = 5, 85
#: At similarity 0.85 a pair shares no band of four registers with chance (1 - 0.85**4)**24 = 2e-8.
REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
#: Different words remembered by a task; when full the memory is emptied, which changes no result.
MEMORY = 500_000
#: Bytes of text and shingles that are worked on at once.
CHUNK, LOT = 1 << 20, 1 << 17
#: Bits of the filter of candidate texts: 4 MB, whatever the corpus. A full filter only lets more texts through to the join.
FILTER_BITS = 25
GOLDEN = 0x9E3779B97F4A7C15
#: Odd factors of a shingle's words by their place.
PLACES = np.random.default_rng(1).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NOTHING = np.uint64(2**64 - 1)


def times(n: int) -> np.uint64:
    """n times the golden ratio's 64 bits, modulo 2 ** 64."""
    return np.uint64(n * GOLDEN & (2**64 - 1))


class Shingles(dict):
    """Sets of shingles as sorted 64-bit hashes. A dictionary of the words met, each hashed once, to places in a table."""

    def __init__(self, k: int = WORDS):
        self.k, self.table = k, np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros(n, np.uint64)])
        self.table[n] = xxhash.xxh3_64_intdigest(word)
        self[word] = n
        return n

    def of(self, text: bytes) -> np.ndarray:
        """The set of a text in lower case: its k-word shingles; with fewer words, all of them as one; without, empty."""
        words = text.split()
        if len(self) > MEMORY:
            self.clear()
        n = len(words)
        at = np.fromiter(map(self.__getitem__, words), np.int64, n)  # may put a longer table in place
        return self.joined(self.table[at], n)

    def joined(self, h: np.ndarray, n: int) -> np.ndarray:
        if n < self.k:
            flat = np.full(min(n, 1), times(n))
            for t in range(n):
                flat = mix(flat + h[t : t + 1] * PLACES[t])
            return flat
        flat = h[: n - self.k + 1] * PLACES[0]
        for t in range(1, self.k):
            flat = flat + h[t : n - self.k + 1 + t] * PLACES[t]
        return np.unique(mix(flat))


def signatures(members: np.ndarray, at: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SuperMinHash of the sets members[at[i]:at[i + 1]], as rows of numbers: 32 bits of rank, 32 of the fraction.

    All members of all sets take a step together; sets whose registers all hold ranks already taken drop out.
    """
    n = len(at) - 1
    flat, low = np.full(n * registers, NOTHING), np.uint64(0xFFFFFFFF)
    h, owner = members, np.repeat(np.arange(n), np.diff(at))
    order = None
    for step in range(registers):
        u = mix(h + times(step + 1))
        place = step + (((u >> np.uint64(32)) * np.uint64(registers - step)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            register = place
        else:  # the place's register comes now; what stood here waits there
            rows = np.arange(len(h))
            register = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, step]
        np.minimum.at(flat, owner * registers + register, np.uint64(step << 32) | u & low)
        some = np.unique(owner)
        open_ = np.zeros(n, bool)
        open_[some] = flat.reshape(n, registers)[some].max(1) >= np.uint64((step + 1) << 32)
        alive = open_[owner]
        if not alive.any():
            break
        if order is None:
            h, owner = h[alive], owner[alive]
            order = np.tile(np.arange(registers, dtype=np.uint16), (len(h), 1))
            order[np.arange(len(h)), place[alive]] = 0
        elif not alive.all():
            h, owner, order = h[alive], owner[alive], order[alive]
    return flat.reshape(n, registers)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The estimate of two sets' similarity from their signatures: the share of equal registers."""
    return float(np.mean(a == b))


def band_keys(signed: np.ndarray, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((len(signed), signed.shape[1] // rows), np.uint64)
    for b in range(keys.shape[1]):
        h = np.full(len(signed), times(b + 1))
        for r in range(rows):
            h = mix(h + signed[:, b * rows + r] * np.uint64(GOLDEN))
        keys[:, b] = h
    return keys


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit hashes of sets as rows of two longs; the last five bits are those that the set's size has."""
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
    h[:, 1] = h[:, 1] & -32 | np.array([min(31, len(s).bit_length()) for s in sets], np.int64)
    return h


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def signed_docs(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, text_key, bands) of every row; the name of the set is null, and there are no bands, without words."""
    some, lower = docs.select("doc_id", "text"), lower_table()

    def sign(batches):
        memory = Shingles(k)
        for b in batches:
            data, at = text_parts(b.column("text"))
            for i, j in slices(at, CHUNK):
                raw = lower[data[at[i] : at[j]]].tobytes()
                texts = [raw[at[x] - at[i] : at[x + 1] - at[i]] for x in range(i, j)]
                sets = [memory.of(t) for t in texts]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                ends = np.concatenate([[0], np.cumsum(sizes[full])])
                flat = np.concatenate([sets[x] for x in full]) if len(full) else np.zeros(0, np.uint64)
                keys = [band_keys(signatures(flat[ends[s] : ends[e]], ends[s : e + 1] - ends[s])) for s, e in slices(ends, LOT)]
                bands = np.concatenate(keys).view(np.int64).ravel() if keys else np.zeros(0, np.int64)
                names = np.zeros((j - i, 2), np.int64)
                if len(full):
                    names[full] = set_names([sets[x] for x in full])
                none = sizes == 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))]).astype(np.int32)), pa.array(bands))
                text = pa.array([text_key(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(names[:, 0], mask=none), pa.array(names[:, 1], mask=none), text, lists], ["doc_id", "n_shingles", "hi", "lo", "text_key", "bands"])

    out = some.select("doc_id").schema.add("n_shingles", "long").add("hi", "long").add("lo", "long").add("text_key", "long").add("bands", ArrayType(LongType()))
    return some.mapInArrow(sign, out)


def member_sets(docs: DataFrame, keys: DataFrame, k: int = WORDS) -> DataFrame:
    """(hi, lo, shingles) of texts with one of the keys (text_key), from another pass over the texts through a filter of fixed size."""
    spark, bits, lower = docs.sparkSession, (1 << FILTER_BITS) - 1, lower_table()
    bit = F.col("text_key").bitwiseAND(bits)
    words = keys.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(text_key & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    held = spark.sparkContext.broadcast(table)

    def emit(batches):
        table, memory = held.value, Shingles(k)
        for b in batches:
            data, at = text_parts(b.column("text"))
            for i, j in slices(at, CHUNK):
                raw = lower[data[at[i] : at[j]]].tobytes()
                texts = [raw[at[x] - at[i] : at[x + 1] - at[i]] for x in range(i, j)]
                low = np.array([text_key(t) & bits for t in texts])
                sets = [memory.of(texts[x]) for x in np.flatnonzero((table[low >> 6] >> (low & 63)) & 1)]
                sets = [s for s in sets if len(s)]
                if sets:
                    names = set_names(sets)
                    yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["hi", "lo", "shingles"])

    return docs.select("text").mapInArrow(emit, "hi long, lo long, shingles binary").dropDuplicates(["hi", "lo"])


def linked_sets(values: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the sets with 100 * intersection >= percent * union."""
    return set_forest([np.frombuffer(v, np.uint64) for v in values], lambda common, n, m: 100 * common >= percent * (n + m - common))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id reachable over links, kept whether it is the row's own.

    Links join texts whose sets of different k-word shingles (A-Z in lower case; with fewer words, all words as one) have
    100 * intersection >= percent * union, found by bands and confirmed on the whole sets of 64-bit hashes. Texts of equal
    sets are one set throughout. Null and empty texts have no shingles and no links. Rows with a null id are linked like
    any other; a component of nulls alone has a null component_id, and its rows are kept. Repeated rows come back
    repeated. Other columns are left out. An empty table gives no rows.
    """
    rows, _ = write_out(signed_docs(docs, k), "signatures")
    each = rows.where("n_shingles > 0").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.min("text_key").alias("text_key"), F.any_value("bands").alias("bands"))
    each, _ = write_out(each, "sets")
    members, _ = write_out(families(each), "families")
    some = each.join(members.select("hi", "lo").distinct(), ["hi", "lo"], "left_semi").select("text_key")
    comps = components(family_links(members, member_sets(docs, some, k), "shingles", lambda values: linked_sets(values, percent)))
    half = lambda start: F.conv(F.substring("node", start, 16), 16, -10).cast("long")
    each = each.join(comps.select(half(1).alias("hi"), half(17).alias("lo"), "root"), ["hi", "lo"], "left").select("hi", "lo", "n", "low", "root")
    each, _ = write_out(each, "each")
    linked, _ = write_out(each.where("root is not null").groupBy("root").agg(F.min("low").alias("least"), F.count("*").alias("m")), "least")
    shared = join_hot(each.where("root is not null"), linked, ["root"], "m").select("hi", "lo", "n", F.col("least").alias("component_id"))
    classes, _ = write_out(each.where("root is null").select("hi", "lo", "n", F.col("low").alias("component_id")).unionByName(shared), "classes")
    out = join_hot(rows.where("n_shingles > 0").select("doc_id", "n_shingles", "hi", "lo"), classes, ["hi", "lo"], "n").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_superminhash(spark, sf_dir: str) -> DataFrame:
    """Every document's number of shingles, its near-duplicate component, and whether it is the one that stays."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
