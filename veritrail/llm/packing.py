"""Packing token sequences: next fit in order of arrival, then local search by moves and swaps that empties bins.

The search owns the result: next fit leaves a third of the bins to be emptied. A step takes pieces out of an emptier bin
into a fuller one, which keeps them (a move) or hands a shorter piece back (one for one, or one for two), and so
raises the sum of squared fills, which can't go on for ever. Among the bins that could take a piece, the one left with the
least room is found through a list of offers by what they can take, so no place is tried in vain.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import text_parts, work_path
from veritrail.llm.tokens import WordEncoder, vocabulary_path

#: Tokens in a sequence; the id after each document; pieces packed together in one task.
CAPACITY, END, SHARD = 2048, 0, 24_000


def next_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions in order of arrival; a piece that the last bin can't take opens another."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths.tolist()):
        if n > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= n
    return bins


class LocalSearch:
    """Bins of lengths that underfull bins exchange until no step raises the sum of squared fills.

    offers[t]: (bin, pieces back, version) such that the bin can take t tokens if it hands those pieces over: none, one or
    two. An offer stands while its bin's version does; others are thrown away when met. mask has bit t set if
    offers[t] may have any, so that the least t that is enough is found by one look.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.capacity, self.steps = capacity, Counter()
        self.twos = False  # whether two pieces go back too: asked for once single ones have done what they can
        self.size = lengths.tolist()
        self.bins = [sorted(b, key=self.size.__getitem__) for b in bins]
        self.fill = [sum(self.size[i] for i in b) for b in self.bins]
        self.version = [0] * len(bins)
        self.offers: list[list[tuple[int, tuple[int, ...], int]]] = [[] for _ in range(2 * capacity + 1)]
        self.mask = 0
        for b in range(len(bins)):
            self.offer(b)

    def kinds(self, b: int) -> dict[int, int]:
        """A piece of each size of the bin, longest first."""
        out: dict[int, int] = {}
        for i in reversed(self.bins[b]):
            out.setdefault(self.size[i], i)
        return out

    def pairs(self, b: int) -> dict[int, tuple[int, int]]:
        """Two pieces of the bin for each sum that two have."""
        own, out = self.bins[b], {}
        kinds = list(self.kinds(b).items())
        for x, (n, i) in enumerate(kinds):
            for m, j in kinds[x + 1 :]:
                out.setdefault(n + m, (i, j))
        for i, j in zip(own, own[1:]):
            if self.size[i] == self.size[j]:
                out.setdefault(2 * self.size[i], (i, j))
        return out

    def offer(self, b: int) -> None:
        self.version[b] += 1
        room, version = self.capacity - self.fill[b], self.version[b]
        if room and self.bins[b]:
            self.put(room, (b, (), version))
            for n, i in self.kinds(b).items():
                self.put(room + n, (b, (i,), version))
            for n, items in self.pairs(b).items() if self.twos else ():
                self.put(room + n, (b, items, version))

    def put(self, t: int, offer: tuple[int, tuple[int, ...], int]) -> None:
        self.offers[t].append(offer)
        self.mask |= 1 << t

    def find(self, giver: int, n: int, most: int) -> tuple[int, tuple[int, ...], int] | None:
        """The offer with the least room left after n tokens of the giver's, with at most `most` pieces back; less comes
        back than went, and the bin ends up fuller than the giver was, so with less room than the giver has."""
        rest = (self.mask >> n & (1 << self.capacity - self.fill[giver]) - 1) << n
        while rest:
            t = (rest & -rest).bit_length() - 1
            some, aside = self.offers[t], []
            found = None
            while some:
                b, items, version = some[-1]
                if self.version[b] != version:
                    some.pop()
                    continue
                back = t - (self.capacity - self.fill[b])
                if b == giver or len(items) > most or back >= n:
                    aside.append(some.pop())
                else:
                    found = b, items, back
                    break
            some += aside
            if found:
                return found
            if not some:
                self.mask &= ~(1 << t)
            rest &= ~(1 << t)
        return None

    def step(self, giver: int, items: tuple[int, ...], to: tuple[int, tuple[int, ...], int]) -> None:
        b, returned, back = to
        n = sum(self.size[i] for i in items)
        for i in returned:
            self.bins[b].remove(i)
            insort(self.bins[giver], i, key=self.size.__getitem__)
        for i in items:
            self.bins[giver].remove(i)
            insort(self.bins[b], i, key=self.size.__getitem__)
        self.fill[b] += n - back
        self.fill[giver] -= n - back
        self.offer(b)
        self.steps[f"{len(items)} for {len(returned)}"] += 1

    def improve(self, giver: int) -> bool:
        """Takes one step out of the giver: a piece, longest first, for up to two shorter ones, else two pieces for at most one."""
        for n, i in self.kinds(giver).items():
            if (to := self.find(giver, n, 2)) is not None:
                self.step(giver, (i,), to)
                return True
        for n, items in sorted(self.pairs(giver).items(), reverse=True):
            if n <= 2 * self.capacity and (to := self.find(giver, n, 1)) is not None:
                self.step(giver, items, to)
                return True
        return False

    def split(self, open_bins: list[int]) -> bool:
        """Even exchanges with full bins: a piece of an underfull bin for two shorter ones of the same sum. Fills stay as they
        are, but shorter pieces are there to go on with; full bins come to hold longer ones, so this ends too."""
        sums: dict[int, list[tuple[int, tuple[int, int]]]] = {}
        for b, items in enumerate(self.bins):
            if self.fill[b] == self.capacity and len(items) > 1:
                for n, two in self.pairs(b).items():
                    sums.setdefault(n, []).append((b, two))
        done = False
        for giver in open_bins:
            for n, i in self.kinds(giver).items():
                some = sums.get(n, [])
                while some:
                    b, two = some.pop()
                    if all(x in self.bins[b] for x in two):
                        self.step(giver, (i,), (b, two, n))
                        self.offer(giver)
                        done = True
                        break
        return done

    def run(self) -> list[list[int]]:
        """Goes over the bins, emptiest first, until a whole pass takes no step or what is left can't need a bin less."""
        changed = True
        while changed:
            changed = False
            open_bins = [b for b in range(len(self.bins)) if self.bins[b] and self.fill[b] < self.capacity]
            if sum(self.fill[b] for b in open_bins) > (len(open_bins) - 1) * self.capacity:
                break  # no bin can be emptied
            for giver in sorted(open_bins, key=self.fill.__getitem__):
                if self.fill[giver] == self.capacity:
                    continue
                stepped = False
                while self.bins[giver] and self.improve(giver):
                    stepped = True
                if stepped:
                    self.offer(giver)
                    changed = True
            open_bins = [b for b in open_bins if self.bins[b] and self.fill[b] < self.capacity]
            if not changed and not self.twos:
                self.twos = changed = True
                for b in open_bins:
                    self.offer(b)
            changed = changed or self.split(open_bins)
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; no piece may be longer than capacity."""
    bins = LocalSearch(next_fit(lengths, capacity), lengths, capacity).run()
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in sorted(items):
            which[i], offset[i] = b, at
            at += int(lengths[i])
    return which, offset


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and its end; one pass, no shuffle.

    Null and empty texts are their end alone. Texts over capacity are cut into full pieces and a rest.
    """
    some = docs.select("doc_id", "text")

    def cut(batches):
        encoder, end = WordEncoder(path), np.array([END], "<u4").tobytes()
        width = 4 * capacity
        for b in batches:
            data, at = text_parts(b.column("text"))
            row, piece, length, crc = [], [], [], []
            for k, ids in enumerate(encoder.encode(data, at)):
                ids += end
                for n, s in enumerate(range(0, len(ids), width)):
                    part = ids[s : s + width]
                    row.append(k)
                    piece.append(n)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            nth = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(nth), pa.array(nth.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return some.mapInArrow(cut, some.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Every piece of every document with its sequence and offset; sequences hold at most capacity tokens.

    Pieces, without their ids, are written once, then dealt evenly by row number into shards of about `shard`
    pieces that are packed apart; each shard can leave a bin less full, one in thousands. Null texts are empty. Repeated
    rows are packed as often as they come; null ids are kept; other columns are left out. An empty table gives no rows.
    """
    spark, where = docs.sparkSession, work_path(docs.sparkSession, "pieces")
    pieces(docs, path or vocabulary_path(), capacity).withColumn("row", F.monotonically_increasing_id()).write.parquet(where)
    made = spark.read.parquet(where)
    shards = max(1, -(-made.count() // shard))
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    def run(key, table):
        table = table.sort_by("row")
        which, offset = pack(table.column("length").to_numpy(), capacity)
        out = table.drop_columns(["row", "shard"])
        base = key[0].as_py() << 32
        return out.append_column("sequence_id", pa.array(which + base)).append_column("offset", pa.array(offset))

    schema = made.drop("row").schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("shard").applyInArrow(run, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
