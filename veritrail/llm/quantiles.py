"""Mergeable quantile summaries by an exponential hierarchy of blocks.

A group's rows fall into blocks of bounded size. Every block is sorted and pruned; blocks are merged eight at a time and
pruned again, level by level, each level with a smaller local error than the one below, so that all levels together stay
under one bound however many there are. What is left is a summary: points with bounds on their ranks. Summaries of
batches are merged to the summary of the whole without another look at rows.

A point is (x, a, b). In order of x, the sum of a up to a point is a lower bound on the rows at or below it, the sum of b
before it an upper bound on the rows below it. A row that stands for itself c times is (x, c, c), both bounds exact. In
this form a merge is a union whose equal points are summed, and gaps between bounds add up and no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import lean, shuffle_parts, write_out
from veritrail.llm.lines import over_runs
from veritrail.operators.ranges import running

#: Different values of a block, blocks that a level merges.
BLOCK, FAN = 4096, 8
#: Share of a group's rows by which all levels below the last may widen gaps, and cells that a batch's summary is cut to at
#: last: it may widen them by 1 / CELLS more. A group of up to KEPT different values is left as it is.
SHARE, CELLS, KEPT = 0.006, 250, 512
#: The same for the whole, which is merged from batches. The answer's error is at most half of all gaps: 0.0056 of the rows.
WHOLE_CELLS, WHOLE_KEPT = 900, 2000
#: A summary keeps at least so many points, or all different values.
LEAST = 20
#: Groups to be pruned are broadcast up to this number, by count; more are joined by shuffling.
FEW = 10_000


def cells_of(level: int) -> int:
    """Cells that a block of this level is cut to. Their local errors, 1 / cells, sum to SHARE over all levels: SHARE / 2 at
    the lowest, SHARE / 6, SHARE / 12 and so on."""
    return int(np.ceil((level + 1) * (level + 2) / SHARE))


def prune(at: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, cells: np.ndarray, most: np.ndarray):
    """Of runs at[i]:at[i + 1] of points in order of x, of more than most[i] each: the first and the last point of every
    cell, cells being equal stretches of the lower bound, and at least LEAST points. Gives (positions kept, a, b); gaps
    widen by n / cells[i] at most. Other runs stay as they are."""
    size = np.diff(at)
    run = np.repeat(np.arange(len(size)), size)
    first, last = at[:-1], at[1:] - 1
    up, over = np.cumsum(a), np.cumsum(b)
    low = up - (up[first] - a[first])[run]
    high = over - b - (over[first] - b[first])[run]  # of rows below
    n = low[last]
    cell = low * cells[run] // np.maximum(n, 1)[run]
    step = np.concatenate([[True], (cell[1:] != cell[:-1]) | (run[1:] != run[:-1])])
    place, of = np.arange(len(x)) - first[run], size[run]
    keep = step | np.concatenate([step[1:], [True]]) | ((place + 1) * LEAST // of != place * LEAST // of) | (of <= most[run])
    k = np.flatnonzero(keep)
    r, low, high = run[k], low[k], high[k]
    new = np.concatenate([[True], r[1:] != r[:-1]])
    ends = np.concatenate([new[1:], [True]])
    return k, np.where(new, low, low - np.concatenate([[0], low[:-1]])), np.where(ends, n[r], np.concatenate([high[1:], [0]])) - high


def starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        c = t.column(k).combine_chunks()
        new |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]]) if t.num_rows else np.zeros(1, np.int64)


def pruned(rows: DataFrame, keys: list[str], cells: Column, most: Column) -> DataFrame:
    """rows (keys, x, a, b, carried columns) with the points of each run of keys merged and pruned; cells and most are one
    value a run. A run's task holds that run's points, which are bounded by the block or the fan."""
    dealt = rows.withColumns({"_cells": cells.cast("long"), "_most": most.cast("long")}).repartition(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys, "x")

    columns = rows.columns

    def settle(t):
        key = starts(t, keys)
        both = starts(t, [*keys, "x"])
        x, a, b = (t.column(c).to_numpy() for c in ("x", "a", "b"))
        head = both[:-1]
        a, b = np.add.reduceat(a, head), np.add.reduceat(b, head)  # equal values are one point
        at = np.searchsorted(both, key)
        of = [t.column(c).to_numpy()[key[:-1]] for c in ("_cells", "_most")]
        k, a, b = prune(at, x[head], a, b, *of)
        out = t.take(pa.array(head[k])).select(columns)
        for name, values in (("a", a), ("b", b)):
            out = out.set_column(columns.index(name), name, pa.array(values))
        yield from out.combine_chunks().to_batches()

    return dealt.mapInArrow(lambda batches: over_runs(batches, keys, [], settle), rows.schema)


def of_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the written groups' columns, rows of no such group). Few groups, by count, are broadcast."""
    few = groups.count() <= FEW
    held = F.broadcast if few else lambda g: g
    return rows.join(held(groups), keys), rows.join(held(groups.select(*keys)), keys, "left_anti")


def summarise(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, a, b, cut): the summary of every group of entries (keys, x, c), c rows of the value x; values of a group differ.

    Groups of up to KEPT values are their own summary, without Python. Others (cut) are dealt to blocks of about BLOCK values by
    hash, whatever their size, and go up the hierarchy. Between levels points are written to the shared folder.
    """
    sizes = entries.groupBy(*keys).agg(F.count("*").alias("_m")).where(F.col("_m") > KEPT)
    large, _ = write_out(sizes.select(*keys, F.ceil(F.col("_m") / BLOCK).cast("long").alias("blocks")), "large")
    rows, small = of_groups(entries, large, keys)
    done = [small.select(*keys, "x", F.col("c").alias("a"), F.col("c").alias("b"), F.lit(False).alias("cut"))]
    block = F.pmod(F.xxhash64(F.lit(12), "x"), F.col("blocks"))
    level, rows = 0, rows.select(*keys, block.alias("block"), "blocks", "x", F.col("c").alias("a"), F.col("c").alias("b"))
    while True:
        top = F.col("blocks") == 1
        cells, most = F.when(top, CELLS).otherwise(cells_of(level)), F.when(top, KEPT).otherwise(cells_of(level))
        rows, _ = write_out(pruned(rows, [*keys, "block"], cells, most), f"level-{level}")
        done.append(rows.where(top).select(*keys, "x", "a", "b", F.lit(True).alias("cut")))
        rows = rows.where(~top)
        if rows.isEmpty():
            break
        level += 1
        rows = rows.select(*keys, F.floor(F.col("block") / FAN).alias("block"), F.ceil(F.col("blocks") / FAN).alias("blocks"), "x", "a", "b")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def merge(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, a, b, cut): the summary of each group's summaries, from their points alone; those of over WHOLE_KEPT points are
    pruned. cut says whether anything has been left out of it or of them."""
    w = Window.partitionBy(*keys)
    rows = points.groupBy(*keys, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("cut").alias("cut"))
    rows = rows.select(*keys, "x", "a", "b", F.max("cut").over(w).alias("cut"), F.count("*").over(w).alias("m"))
    some = rows.where(F.col("m") > WHOLE_KEPT).select(*keys, "x", "a", "b")
    some = pruned(some, keys, F.lit(WHOLE_CELLS), F.lit(WHOLE_KEPT)).withColumn("cut", F.lit(True))
    return rows.where(F.col("m") <= WHOLE_KEPT).drop("m").unionByName(some)


def answers(points: DataFrame, keys: list[str], parts: int, least: int = 0) -> DataFrame:
    """(keys, i, n, points, answer, n_below, n_upto, cut) for i in 1 .. parts - 1 of every summary of at least `least` rows: the point
    whose bounds are nearest to rank ceil(i * n / parts), the smaller on ties, with these bounds on the rows below it and up to it."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("x")
    rows = points.select(*keys, "x", "cut", F.sum("a").over(up).alias("low"), (F.sum("b").over(up) - F.col("b")).alias("high"), F.sum("a").over(w).alias("n"), F.count("*").over(w).alias("points"))
    rows = rows.select("*", F.lag(F.struct("x", "low", "high")).over(up).alias("left")).where(F.col("n") >= least)
    seen = F.coalesce("left.low", F.lit(0).cast("long"))
    rows = rows.select("*", F.explode(ranks(seen, F.col("low"), F.col("n"), parts)).alias("i"))
    target = rank(F.col("i"), F.col("n"), parts)
    nearer = F.col("left").isNotNull() & (target - F.col("left.low") <= F.greatest(F.lit(0), F.col("high") + 1 - target))
    best = F.when(nearer, F.col("left")).otherwise(F.struct("x", "low", "high"))
    return rows.select(*keys, "i", "n", "points", "cut", best.alias("best")).select(*keys, "i", "n", "points", F.col("best.x").alias("answer"), F.col("best.high").alias("n_below"), F.col("best.low").alias("n_upto"), "cut")


def div(a: Column, b: Column) -> Column:
    """The whole part of a / b, in integers."""
    return F.call_function("div", a, b)


def rank(i: Column, n: Column, parts: int) -> Column:
    """ceil(i * n / parts)."""
    return div(i * n + (parts - 1), F.lit(parts))


def ranks(after: Column, upto: Column, n: Column, parts: int) -> Column:
    """Those i in 1 .. parts - 1 with after < ceil(i * n / parts) <= upto."""
    low, high = div(after * parts, n) + 1, F.least(div(upto * parts, n), F.lit(parts - 1).cast("long"))
    return F.when(low <= high, F.sequence(low, high))


def exact(entries: DataFrame, asked: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """asked (keys, i, points, answer) with n, exact_x, n_below and n_upto, by sorting all rows of its groups: a check that uses
    nothing of the summaries. Answers lie among the rows as marks that count nothing, one before their value and one after it."""
    none = F.lit(None).cast("long")
    marks = asked.select(*keys, F.col("answer").alias("x"), F.lit(0).cast("long").alias("c"), "i", "points", F.explode(F.array(F.lit(0), F.lit(2))).alias("at"))
    rows = entries.select(*keys, "x", "c", none.alias("i"), none.alias("points"), F.lit(1).alias("at")).unionByName(marks)
    rows = running(rows, keys, [F.col("x"), F.col("at"), F.col("i")], ["c"])
    i = F.when(F.col("at") == 1, ranks(F.col("c_to") - F.col("c"), F.col("c_to"), F.col("c_all"), parts)).otherwise(F.array("i"))
    rows = rows.select("*", F.explode(i).alias("of"))
    only = lambda at, v: F.max(F.when(F.col("at") == at, F.col(v)))
    return rows.groupBy(*keys, F.col("of").alias("i")).agg(F.max("c_all").alias("n"), only(1, "x").alias("exact_x"), F.max("points").alias("points"), only(0, "x").alias("answer"), only(0, "c_to").alias("n_below"), only(2, "c_to").alias("n_upto"))


def batch_of(id_: str) -> Column:
    """crc32 of the decimal id mod 16; null ids are in batch 0."""
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 16, F.lit(0)).cast("int")


def scaled(money: str, batch: str = "batch") -> Column:
    return F.floor(F.col(money) * 100 + 0.5) + F.col(batch) * 1000


def finite(money: str) -> Column:
    return F.col(money).isNotNull() & ~F.isnan(money) & (F.abs(money) < float("inf"))


def value_entries(clicks: DataFrame) -> DataFrame:
    """(grp, batch, x, c) of clicks, one row a click_id; where copies of a click differ, its least client and least value count.
    Rows without client or finite value are dropped."""
    one = clicks.select("click_id", "client_id", "value").groupBy("click_id").agg(F.min("client_id").alias("client_id"), F.min("value").alias("value"))
    one = one.where(F.col("client_id").isNotNull() & finite("value")).select("client_id", batch_of("click_id").alias("batch"), "value")
    return one.groupBy("client_id", "batch", scaled("value").alias("x")).agg(F.count("*").alias("c")).select(F.col("client_id").cast("string").alias("grp"), "batch", "x", "c")


def price_entries(sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """(grp, batch, x, c) of all sale lines with an item that has brand and finite price. Lines are counted by item and batch
    before they meet items, so that an item with a third of all rows is no hot key; of an item given twice the least brand
    and price count."""
    some = sale_lines.where("item_id is not null").groupBy("item_id", batch_of("vendor_id").alias("batch")).agg(F.count("*").alias("c"))
    one = items.groupBy("item_id").agg(F.min("brand").alias("grp"), F.min("price").alias("price")).where(F.col("grp").isNotNull() & finite("price"))
    return some.join(one, "item_id").groupBy("grp", "batch", scaled("price").alias("x")).agg(F.sum("c").alias("c")).select("grp", "batch", "x", "c")


KEYS = ["grp", "stream", "batch"]


def batch_quantiles(entries: DataFrame, parts: int = 20, least: int = 20) -> DataFrame:
    """Every (stream, grp, batch)'s summary and, as batch -1, that of all batches of a group merged from them, asked for
    parts - 1 evenly spaced ranks and held against exact ranks; summaries of fewer than `least` rows are not asked.

    A summary that nothing was cut from holds all its rows, so its ranks are exact; the others' rows are sorted. entries: (grp,
    stream, batch, x, c), c rows of each value. No rows give no rows. Ties are one value with a count.
    """
    entries, _ = write_out(entries, "entries")
    group = KEYS[:2]
    points = summarise(entries, KEYS).repartition(shuffle_parts(entries.sparkSession), *group)  # for batches and their merge alike
    whole = merge(points, group).withColumn("batch", F.lit(-1))
    asked = answers(points, KEYS, parts, least).unionByName(answers(whole, group, parts, least).withColumn("batch", F.lit(-1)))
    asked, _ = write_out(asked, "answers")
    cut, _ = write_out(asked.where("cut").select(*KEYS).distinct(), "cut")
    batches, _ = of_groups(entries, cut.where("batch >= 0"), KEYS)
    wholes, _ = of_groups(entries.drop("batch"), cut.where("batch < 0"), group)
    known = asked.where("not cut").select(*KEYS, "i", "n", F.col("answer").alias("exact_x"), "points", "answer", "n_below", "n_upto")
    out = known.unionByName(exact(batches.unionByName(wholes.select(*entries.columns)), asked.where("cut"), KEYS, parts))
    out = out.withColumn("target", rank(F.col("i"), F.col("n"), parts).cast("long"))
    error = F.greatest(F.lit(0), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    out = out.withColumn("rank_error", error.cast("long"))
    return out.select("stream", "grp", "batch", F.col("i").cast("int").alias("i"), "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", (F.col("rank_error") * 1000 <= F.col("n") * 10).alias("within"))


def op12_quantiles(spark, sf_dir: str) -> DataFrame:
    """Twentieths of clicks' values by client and of sold items' prices by brand, batch by batch and whole."""
    read = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    value = value_entries(read("clicks", "click_id", "client_id", "value")).withColumn("stream", F.lit("value"))
    price = price_entries(read("sale_lines", "item_id", "vendor_id"), read("items", "item_id", "brand", "price")).withColumn("stream", F.lit("price"))
    with lean(spark):
        return batch_quantiles(value.unionByName(price))
