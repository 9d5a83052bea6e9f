"""Line deduplication by MinHash: character shingles, one-permutation signatures, bands, exact Jaccard, union-find.

Lines are compared without case and with white space collapsed. Equal lines are one line throughout; its signature
bands key buckets, buckets with the same smallest member are one family, and inside a family pairs are verified on
the sets of shingles themselves. Only a spanning forest of a family's links leaves it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import join_hot, lower_table, runs, shuffle_parts, slices, text_parts, write_out
from veritrail.llm.components import components

#: Characters of a shingle (a power of two), bands and rows of the signature, and the similarity of near copies.
#: At similarity 0.8 a pair meets in a band with chance 1 - (1 - 0.8**4)**12 = 0.998.
SHINGLE, BANDS, ROWS, SIMILAR = 8, 12, 4, 0.8
#: Larger families are verified by chunks of about this many lines and bytes; none is left out.
CROWD, CROWD_BYTES = 4096, 2 << 20
#: Families of up to this many lines are walked pair by pair, larger ones by vectorised rows of pairs.
SMALL = 6
#: Lines remembered by a task so as to sign each once; when full the memory is emptied, which changes no result.
MEMORY = 500_000
#: Bits of the filter of candidate lines: 4 MB, whatever the corpus. A full filter only lets more lines through to the join.
FILTER_BITS = 25
CHUNK = 1 << 19
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def normal(line: bytes) -> bytes:
    """line is in lower case already."""
    return b" ".join(line.split())


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def band_keys(lines: list[bytes]) -> np.ndarray:
    """BANDS keys of each line (rows); lines of under SHINGLE characters have none (all zeros)."""
    points = np.frombuffer(b"\n".join(lines).decode("utf-8", "replace").encode("utf-32-le") + b"\n\0\0\0" * (SHINGLE + 1), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(points == 10)[: len(lines)]
    h, power, w = points, BASE, 1
    while w < SHINGLE:
        h = h[:-w] * power + h[w:]
        power = np.uint64(int(power) ** 2 & (2**64 - 1))
        w *= 2
    inside = np.ones(len(h), bool)  # windows that reach no line's end
    for d in range(SHINGLE):
        inside[np.maximum(0, ends - d)] = False
    inside[ends[-1] :] = False
    m = BANDS * ROWS
    v = mix(h[inside])
    slot = np.repeat(np.arange(len(lines)) * m, np.maximum(0, np.diff(ends, prepend=-1) - SHINGLE))
    slot += (((v >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).view(np.int64)
    empty = np.uint64(2**64 - 1)
    flat = np.full(len(lines) * m, empty, np.uint64)
    v &= np.uint64(0xFFFFFFFF)
    np.minimum.at(flat, slot, v)
    sig = flat.reshape(len(lines), m)
    holes = sig == empty
    some = holes.any(1) & ~holes.all(1)
    if some.any():  # an empty bin borrows from the next full one
        part, gone = sig[some], holes[some]
        out = part.copy()
        for d in range(1, m):
            take = gone & ~np.roll(holes[some], -d, axis=1)
            out[take] = np.roll(part, -d, axis=1)[take] + np.uint64(d) * np.uint64(1 << 33)
            gone = gone & ~take
            if not gone.any():
                break
        sig[some] = out
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(lines), np.uint64(b + 1) * BASE, np.uint64)
        for r in range(ROWS):
            h = mix(h + sig[:, b * ROWS + r] * BASE)
        keys[:, b] = h | np.uint64(1)
    keys[holes.all(1)] = 0
    return keys


def digests(lines: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two longs, the last five bits being those that the line's length has, so that a line's name
    tells its size to within a half."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">i8").astype(np.int64).reshape(-1, 2)
    h[:, 1] = h[:, 1] & -32 | np.array([min(31, len(x).bit_length()) for x in lines], np.int64)
    return h


SIZE = "shiftleft(1L, cast(lo & 31 as int))"


def comparable(data: np.ndarray, at: np.ndarray, least: int = SHINGLE):
    """For lots of rows: (rows' index, line number, normal line) of every line with at least `least` bytes."""
    lower = lower_table()
    for i, j in slices(at, CHUNK):
        flat = lower[data[at[i] : at[j]]].tobytes()
        row, number, lines = [], [], []
        for k in range(i, j):
            for n, line in enumerate(flat[at[k] - at[i] : at[k + 1] - at[i]].split(b"\n")):
                line = normal(line)
                if len(line) >= least:
                    row.append(k)
                    number.append(n)
                    lines.append(line)
        yield row, number, lines


#: What tells rows of one doc_id (or of none) apart: 128 bits of the text.
ROW = ["doc_id", "text_a", "text_b"]


def told_apart(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> list:
    """The columns ROW; rows that agree in them are repeats of one row."""
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_a"), F.xxhash64(F.lit(1), F.col(text)).alias("text_b")]


def signed_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """(*ROW, line_no, hi, lo, bands) of every comparable line; bands only where the task had not met the line before.
    short: also of lines of under SHINGLE bytes, which have no bands: equal ones share their digest."""
    some = docs.select(*told_apart(docs), "text")

    def sign(batches):
        seen: set[bytes] = set()
        for b in batches:
            for row, number, lines in comparable(*text_parts(b.column("text")), 1 if short else SHINGLE):
                new = []
                for k, line in enumerate(lines):
                    if len(line) >= SHINGLE and (d := xxhash.xxh3_64_digest(line)) not in seen:
                        seen.add(d)
                        new.append(k)
                if len(seen) > MEMORY:
                    seen.clear()
                has = np.zeros(len(lines), bool)
                has[new] = True
                keys = band_keys([lines[k] for k in new]) if new else np.zeros((0, BANDS), np.uint64)
                has[np.array(new, np.int64)[(keys == 0).all(1)]] = False
                keys = keys[(keys != 0).any(1)]
                ends = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
                h = digests(lines)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ROW], pa.array(number, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), bands], [*ROW, "line_no", "hi", "lo", "bands"])

    return some.mapInArrow(sign, some.select(*ROW).schema.add("line_no", "integer").add("hi", "long").add("lo", "long").add("bands", ARRAY_OF_LONG))


def _array_of_long():
    from pyspark.sql.types import ArrayType, LongType

    return ArrayType(LongType())


ARRAY_OF_LONG = _array_of_long()


def over_runs(batches, keys: list[str], names: list[str], settle):
    """Calls settle(columns) with whole runs of equal keys from sorted batches; the last, open run is carried over."""
    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        cols = [t.column(k).to_numpy() for k in keys]
        last = np.ones(t.num_rows, bool)
        for c in cols:
            last &= c == c[-1]
        rest = np.flatnonzero(~last)
        cut = int(rest[-1]) + 1 if len(rest) else 0
        carry = t.slice(cut)
        if cut:
            yield from settle(t.slice(0, cut))
    if carry is not None and carry.num_rows:
        yield from settle(carry)


def families(lines: DataFrame) -> DataFrame:
    """(bhi, blo, hi, lo): each bucket's members under its smallest one, (bhi, blo), the family's pivot; buckets of the
    same pivot, as one group of copies makes in many bands, are one family. Only buckets of two or more different
    lines count. A bucket's task sees hashes alone, sorted by the shuffle."""
    rows = lines.where(F.size("bands") > 0).select(F.explode("bands").alias("key"), "hi", "lo")
    rows = rows.repartition(shuffle_parts(lines.sparkSession), "key").sortWithinPartitions("key", "hi", "lo")
    names = ["bhi", "blo", "hi", "lo"]

    def settle(t):
        key, hi, lo = (t.column(c).to_numpy() for c in ("key", "hi", "lo"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        key, hi, lo = key[new], hi[new], lo[new]
        at = runs(key)
        size = np.diff(at)
        some, pivot = np.repeat(size > 1, size), np.repeat(at[:-1], size)
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hi[pivot][some], lo[pivot][some], hi[some], lo[some])], names)

    return rows.mapInArrow(lambda batches: over_runs(batches, ["key"], names, settle), "bhi long, blo long, hi long, lo long").distinct()


def candidate_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(hi, lo, line) of the members, from another pass over the texts through a filter of fixed size."""
    spark, bits = docs.sparkSession, (1 << FILTER_BITS) - 1
    bit = F.col("hi").bitwiseAND(bits)
    words = members.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(hi & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    held = spark.sparkContext.broadcast(table)

    def emit(batches):
        table, seen = held.value, set()
        for b in batches:
            for _, _, lines in comparable(*text_parts(b.column("text"))):
                if not lines:
                    continue
                h = digests(lines)
                low = h[:, 0] & bits
                hit = (table[low >> 6] >> (low & 63)) & 1
                pick = []
                for k in np.flatnonzero(hit).tolist():
                    if lines[k] not in seen:
                        seen.add(lines[k])
                        pick.append(k)
                if len(seen) > MEMORY // 8:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(h[pick, 0]), pa.array(h[pick, 1]), pa.array([lines[k].decode("utf-8", "replace") for k in pick], pa.string())], ["hi", "lo", "line"])

    return docs.select("text").mapInArrow(emit, "hi long, lo long, line string").dropDuplicates(["hi", "lo"])


def shingles(line: str, k: int = SHINGLE) -> set[str]:
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def packed(line: str) -> np.ndarray | None:
    """The set of shingles in order, eight Latin-1 characters being one number; None for other lines."""
    try:
        b = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if len(b) < SHINGLE or SHINGLE != 8:
        return None
    u = np.sort(np.ndarray((len(b) - 7,), "<u8", b, strides=(1,)))
    return u[np.concatenate([[True], u[1:] != u[:-1]])]


def overlap(a, b, x: str, y: str) -> tuple[int, int, int]:
    """Sizes of two sets of shingles and of their intersection."""
    if a is not None and b is not None:
        both = np.concatenate([a, b])
        both.sort()
        return len(a), len(b), int(np.count_nonzero(both[1:] == both[:-1]))
    s, t = shingles(x), shingles(y)
    return len(s), len(t), len(s & t)


def forest(lines: list[str], similar: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is at least `similar`."""
    if len(lines) > SMALL:
        return wide_forest(lines, similar)
    parent, kept = list(range(len(lines))), []
    sets = [packed(x) for x in lines]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for j in range(len(lines)):
        for i in range(j):
            x, y = find(i), find(j)
            if x == y:
                continue
            a, b = sets[i], sets[j]
            if a is not None and b is not None and min(len(a), len(b)) < similar * max(len(a), len(b)):
                continue
            n, m, common = overlap(a, b, lines[i], lines[j])
            if common >= similar * (n + m - common):
                parent[max(x, y)] = min(x, y)
                kept.append((i, j))
    return kept


def wide_forest(lines: list[str], similar: float) -> list[tuple[int, int]]:
    """As forest, over all lines at once."""
    sets = [packed(x) for x in lines]
    if any(x is None for x in sets):
        number: dict[str, int] = {}
        sets = [np.array([number.setdefault(g, len(number)) for g in shingles(x)]) for x in lines]
    return set_forest(sets, lambda common, n, m: common >= similar * (n + m - common))


def set_forest(sets: list[np.ndarray], near) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of non-empty sets for which near(common members, size, sizes) holds.

    From a set to all sets like it that no tree holds yet, and on from those. A set is compared with those left over only,
    all at once, so copies of one template cost one row of pairs."""
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(sizes)
    mark = np.zeros(int(ids.max()) + 1, bool)
    left, kept = np.arange(len(sets)), []
    flat, begins, size = ids, ends - sizes, sizes  # of the lines that are left
    while len(left):
        trees = [int(left[0])]
        keep = np.ones(len(left), bool)
        keep[0] = False
        while trees and len(left):
            if not keep.all():
                flat = flat[np.repeat(keep, size)]
                left, size = left[keep], size[keep]
                begins = np.cumsum(size) - size
                if not len(left):
                    break
            x = trees.pop()
            own = ids[ends[x] - sizes[x] : ends[x]]
            mark[own] = True
            common = np.add.reduceat(mark[flat], begins, dtype=np.int64)
            mark[own] = False
            like = near(common, sizes[x], size)
            kept += [(x, y) for y in left[like].tolist()]
            trees += left[like].tolist()
            keep = ~like
        if len(left) and not keep.all():
            flat = flat[np.repeat(keep, size)]
            left, size = left[keep], size[keep]
            begins = np.cumsum(size) - size
    return kept


def name(hi: str = "hi", lo: str = "lo"):
    return F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0"))


PIVOT = ["bhi", "blo"]


def chunked(members: DataFrame, crowded: DataFrame, column: str, salt: int) -> DataFrame:
    """members of crowded families, dealt to as many chunks as the family's column says."""
    rows = members.join(F.broadcast(crowded) if crowded.count() <= 100_000 else crowded, PIVOT)
    return rows.withColumn("chunk", F.pmod(F.xxhash64("hi", "lo", F.lit(salt)), F.col(column)).cast("int"))


def crowds(members: DataFrame, name: str) -> DataFrame:
    """(pivot, name): the chunks that families of over CROWD lines or CROWD_BYTES are cut to; written."""
    parts = F.ceil(F.greatest(F.count("*") / CROWD, F.sum(F.expr(SIZE)) / CROWD_BYTES)).cast("int")
    return write_out(members.groupBy(*PIVOT).agg(parts.alias(name)).where(F.col(name) > 1), "crowded")[0]


def verified(rows: DataFrame, contents: DataFrame, column: str, links) -> DataFrame:
    """(ahi, alo, bhi, blo): links of a spanning forest of every (pivot, chunk, part) of rows; a pivot's come from itself.
    contents: (hi, lo) and the column from which links(values) tells the pairs of positions."""
    keys = [*PIVOT, "chunk", "part"]
    rows = rows.select(*keys, "hi", "lo").join(contents, ["hi", "lo"]).repartition(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys, "hi", "lo")

    def settle(t):
        at = t.column("bhi").to_numpy()[:0]
        for c in keys:
            at = np.union1d(at, runs(t.column(c).to_numpy())).astype(np.int64)
        hi, lo, text, out = t.column("hi").to_numpy(), t.column("lo").to_numpy(), t.column(column), []
        for s, e in zip(at.tolist(), at[1:].tolist()):
            if e - s > 1:
                out += [(s + i, s + j) for i, j in links(text.slice(s, e - s).to_pylist())]
        if out:
            x = np.array(out)
            yield pa.RecordBatch.from_arrays([pa.array(c[k]) for k in (x[:, 0], x[:, 1]) for c in (hi, lo)], ["ahi", "alo", "bhi", "blo"])

    return rows.mapInArrow(lambda batches: over_runs(batches, keys, [], settle), "ahi long, alo long, bhi long, blo long")


def line_links(docs: DataFrame, lines: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Edges (a, b) between names of different lines that are near copies."""
    members, _ = write_out(families(lines), "families")
    return family_links(members, candidate_texts(docs, members.select("hi")), "line", lambda some: forest(some, similar))


def family_links(members: DataFrame, contents: DataFrame, column: str, links) -> DataFrame:
    """Edges (a, b) between names of members of one family that links(values of column) links; as `verified` takes them.

    Of a crowded family each chunk is verified with the pivot in it. Two members of different chunks that are both like the
    pivot are linked through it; so only those that are not like it remain to be verified with the chunks they are not
    in. They are dealt to chunks themselves, and each pair of chunks is a task's work of bounded size.
    """
    crowded = crowds(members, "chunks")
    zero = F.lit(0).alias("part")
    named = lambda x: x.select(name("ahi", "alo").alias("a"), name("bhi", "blo").alias("b"))
    if crowded.isEmpty():
        return named(verified(members.withColumn("chunk", F.lit(0)).select("*", zero), contents, column, links))
    contents, _ = write_out(contents, "texts")
    small = members.join(crowded, PIVOT, "left_anti").select(*PIVOT, F.lit(0).alias("chunk"), zero, "hi", "lo")
    others = chunked(members.where("hi <> bhi or lo <> blo"), crowded, "chunks", 0)
    pivots = crowded.select(*PIVOT, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), zero, F.col("bhi").alias("hi"), F.col("blo").alias("lo"))
    stars, _ = write_out(verified(small.unionByName(others.select(*PIVOT, "chunk", zero, "hi", "lo")).unionByName(pivots), contents, column, links), "links")
    like = stars.select(F.col("ahi").alias("_h"), F.col("alo").alias("_l"), F.col("bhi").alias("hi"), F.col("blo").alias("lo")).distinct()
    apart = others.join(like, (others["bhi"] == F.col("_h")) & (others["blo"] == F.col("_l")) & (others["hi"] == like["hi"]) & (others["lo"] == like["lo"]), "left_anti")
    apart, _ = write_out(apart.select(*PIVOT, "chunks", "hi", "lo"), "apart")
    if apart.isEmpty():
        return named(stars)
    parts = F.ceil(F.greatest(F.count("*") / CROWD, F.sum(F.expr(SIZE)) / CROWD_BYTES)).cast("int")
    dealt, _ = write_out(apart.groupBy(*PIVOT).agg(parts.alias("parts")), "parts")
    part = F.pmod(F.xxhash64("hi", "lo", F.lit(1)), F.col("parts")).cast("int")
    mine = apart.join(dealt, PIVOT).select(*PIVOT, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), part.alias("part"), "hi", "lo")
    theirs = others.join(dealt, PIVOT).select(*PIVOT, "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "hi", "lo")
    return named(stars.unionByName(verified(mine.unionByName(theirs).distinct(), contents, column, links)))


def judged_lines(docs: DataFrame, similar: float = SIMILAR, short: bool = False) -> DataFrame:
    """(*ROW, line_no, component, first, kept), first being the struct of (*ROW, line_no) that stays of the component.

    What is said of a line is worked out once for each different line, from counts and firsts combined before the
    shuffle; lines that are very common then get it by broadcast.
    """
    lines, _ = write_out(signed_lines(docs, short), "lines")
    comps = components(line_links(docs, lines, similar))
    half = lambda start: F.conv(F.substring("node", start, 16), 16, -10).cast("long")
    comps = comps.select(half(1).alias("hi"), half(17).alias("lo"), "root")
    each = lines.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no", *ROW[1:])).alias("first"))
    each, _ = write_out(each.join(comps, ["hi", "lo"], "left"), "each")
    linked = each.where("root is not null").groupBy("root").agg(F.min("first").alias("low"), F.count("*").alias("m"))
    linked, _ = write_out(linked, "firsts")
    shared = join_hot(each.where("root is not null"), linked, ["root"], "m").select("hi", "lo", "n", F.col("low").alias("first"), "root")
    classes, _ = write_out(each.where("root is null").select("hi", "lo", "n", "first", "root").unionByName(shared), "classes")
    out = join_hot(lines.select(*ROW, "line_no", "hi", "lo"), classes, ["hi", "lo"], "n").withColumn("component", F.coalesce("root", name()))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    for c in ("line_no", *ROW[1:]):
        kept &= F.col(c) == F.col(f"first.{c}")
    return out.select(*ROW, "line_no", "component", "first", kept.alias("kept"))


def duplicate_lines(docs: DataFrame, similar: float = SIMILAR, short: bool = False) -> DataFrame:
    """(doc_id, line_no, component, first_doc, first_line, kept) of every line of at least SHINGLE bytes, blanks collapsed.

    A component is named after its smallest line hash; its line of the smallest (doc_id, line_no) is kept, of several rows
    with that id the one whose text has the smallest hash. Rows of equal id and text are repeats and fare alike. Shorter
    lines are listed with `short`, and equal ones are a component; else they stay. Blank lines are not listed: they
    stay. Null and empty texts have no lines. Null ids come first. Other columns are left out. An empty table gives no rows.
    """
    rows = judged_lines(docs, similar, short)
    return rows.select("doc_id", "line_no", "component", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"), "kept")


def dedup_lines(docs: DataFrame, similar: float = SIMILAR, short: bool = False) -> DataFrame:
    """docs without the lines that duplicate_lines does not keep; n_chars follows, if there. Documents that lose every
    line that isn't blank go; documents without text stay as they are. Lines go by row, told by id and text: another text
    with the same id, or without one, keeps what it alone has; repeated rows lose the same lines. Other columns are
    carried along whatever their names. An empty table gives an empty one."""
    gone = judged_lines(docs, similar, short).where("not kept").groupBy(*ROW).agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of ours meets theirs
    rows = rows.select("row", *[c.alias(f"of_{i}") for i, c in enumerate(told_apart(rows, "row.text", "row.doc_id"))])
    same = F.col("of_0").eqNullSafe(F.col(ROW[0])) & (F.col("of_1") == F.col(ROW[1])) & (F.col("of_2") == F.col(ROW[2]))
    rest = F.array_join(F.filter(F.split("row.text", "\n"), lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n")
    out = rows.join(gone, same, "left").select("row", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(rest).alias("text"), F.col("gone").isNull().alias("whole"))
    out = out.where("whole or text rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]'")
    col = lambda f: F.col("text") if f.name == "text" else F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("text").cast(f.dataType)) if f.name == "n_chars" else F.col(f"row.`{f.name}`")
    return out.select(*[col(f).alias(f.name) for f in docs.schema])


def op10_lines(spark, sf_dir: str) -> DataFrame:
    """Every line of every document that isn't blank, with its component and whether it stays."""
    return duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), short=True)
