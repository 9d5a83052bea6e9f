"""Block hierarchies of quantile summaries against sorted rows: bounds, merges, levels and the query."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from veritrail.llm import quantiles

ROWS = "grp string, stream string, batch int, x long, c long"


def entries(spark, groups):
    return spark.createDataFrame([(g, "s", b, int(x), int(n)) for (g, b), xs in groups.items() for x, n in Counter(xs).items()], ROWS)


def held(points, xs, gap):
    """Checks the bounds of every point against all rows, and that gaps between bounds stay under the limit."""
    xs, low, high, n = sorted(xs), 0, 0, len(xs)
    points = sorted(points)
    assert sum(p[1] for p in points) == sum(p[2] for p in points) == n and points[0][0] == xs[0] and points[-1][0] == xs[-1]
    values = set(xs)
    for x, a, b in points:
        before = low
        low += a
        assert x in values and low <= np.searchsorted(xs, x, "right") and high >= np.searchsorted(xs, x, "left")
        assert high - before <= gap * n
        high += b


@pytest.fixture(scope="module")
def groups():
    r = random.Random(12)
    return {
        ("even", 0): [r.randrange(10**6) for _ in range(30_000)],
        ("even", 1): [r.randrange(100) for _ in range(3000)],
        ("heavy", 0): [7] * 20_000 + list(range(5000)),
        ("heavy", 1): [5] * 20_000 + [10**9 - i for i in range(20)],
        ("steep", 0): [int(math.exp(r.random() * 30)) for _ in range(9000)],
        ("one", 3): [4],
        ("below", 2): [-i for i in range(700)],
    }


def test_levels_keep_bounds(spark, groups, monkeypatch):
    for block in (4096, 300):  # one level, and several
        monkeypatch.setattr(quantiles, "BLOCK", block)
        found = defaultdict(list)
        points = quantiles.summarise(entries(spark, groups), quantiles.KEYS)
        for r in points.collect():
            found[r["grp"], r["batch"]].append((r["x"], r["a"], r["b"]))
        assert set(found) == set(groups)
        for k, xs in groups.items():
            held(found[k], xs, quantiles.SHARE + 1 / quantiles.CELLS)
            assert min(20, len(set(xs))) <= len(found[k]) <= 523
        whole = defaultdict(list)
        for r in quantiles.merge(points, ["grp", "stream"]).collect():
            whole[r["grp"]].append((r["x"], r["a"], r["b"]))
        for g in whole:
            held(whole[g], [x for (h, _), xs in groups.items() if h == g for x in xs], quantiles.SHARE + 1 / quantiles.CELLS + 1 / quantiles.WHOLE_CELLS)


def test_errors_of_all_levels_stay_under_one_bound():
    assert sum(1 / quantiles.cells_of(level) for level in range(1000)) <= quantiles.SHARE
    assert all(quantiles.cells_of(k) < quantiles.cells_of(k + 1) for k in range(40))


def test_pruning_keeps_few_points_and_enough_of_them():
    r = np.random.default_rng(3)
    for c in (np.ones(5000, int), np.concatenate([[10**6], np.ones(5000, int)]), r.integers(1, 10**9, 3000), np.ones(8, int)):
        x, n = np.arange(len(c)), len(c)
        k, a, b = quantiles.prune(np.array([0, n]), x, c, c, np.array([250]), np.array([512]))
        assert min(20, n) <= len(k) <= 523 and a.sum() == b.sum() == c.sum() and k[0] == 0 and k[-1] == n - 1
        up, below = np.cumsum(c), np.cumsum(c) - c
        assert np.cumsum(a).tolist() == up[k].tolist() and (np.cumsum(b) - b).tolist() == below[k].tolist()


def plain(groups, parts=20, least=20):
    both = defaultdict(list)
    for (g, b), xs in groups.items():
        both[g, b] += xs
        both[g, -1] += xs
    out = {}
    for (g, b), xs in both.items():
        xs = sorted(xs)
        for i in range(1, parts) if len(xs) >= least else ():
            t = -(-i * len(xs) // parts)
            out[g, b, i] = (len(xs), t, xs[t - 1])
    return out, {k: sorted(v) for k, v in both.items()}


def held_answers(rows, groups):
    want, all_rows = plain(groups)
    assert {(r["grp"], r["batch"], r["i"]): (r["n"], r["target"], r["exact_x"]) for r in rows} == want and len(rows) == len(want)
    last = {}
    for r in sorted(rows, key=lambda r: r["i"]):
        xs = all_rows[r["grp"], r["batch"]]
        assert (r["n_below"], r["n_upto"]) == (np.searchsorted(xs, r["answer"], "left"), np.searchsorted(xs, r["answer"], "right"))
        assert r["rank_error"] == max(0, r["n_below"] + 1 - r["target"], r["target"] - r["n_upto"]) and r["within"] and 1000 * r["rank_error"] <= 10 * r["n"]
        assert min(20, len(set(xs))) <= r["points"] <= min(len(xs), 2000) and xs[0] <= r["answer"] <= xs[-1]
        assert r["answer"] >= last.get((r["grp"], r["batch"]), r["answer"])
        last[r["grp"], r["batch"]] = r["answer"]


def test_answers_against_sorted_rows(spark, groups):
    held_answers(quantiles.batch_quantiles(entries(spark, groups)).collect(), groups)
    assert quantiles.batch_quantiles(spark.createDataFrame([], ROWS)).count() == 0


def test_many_groups_to_prune_are_joined_without_broadcast(spark, groups, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 0)
    held_answers(quantiles.batch_quantiles(entries(spark, groups)).collect(), groups)


def test_query_against_plain_rows(spark):
    d = "/root/testdata/sf0.001"
    table = lambda n: pq.read_table(f"{d}/{n}.parquet").to_pylist()
    items = {r["item_id"]: r for r in table("items")}
    clicks = {r["click_id"]: r for r in table("clicks")}
    groups = {"value": defaultdict(list), "price": defaultdict(list)}

    def put(stream, grp, id_, money):
        if grp is not None and money is not None:
            batch = zlib.crc32(str(id_).encode()) % 16
            groups[stream][str(grp), batch].append(math.floor(100 * money + 0.5) + 1000 * batch)

    for r in clicks.values():
        put("value", r["client_id"], r["click_id"], r["value"])
    for r in table("sale_lines"):
        item = items.get(r["item_id"]) or {"brand": None, "price": None}
        put("price", item["brand"], r["vendor_id"], item["price"])
    rows = quantiles.op12_quantiles(spark, d).collect()
    for stream in groups:
        held_answers([r for r in rows if r["stream"] == stream], groups[stream])


def test_rows_that_lack_something(spark):
    clicks = spark.createDataFrame([(1, 5, 1.0), (1, 5, 1.0), (2, None, 1.0), (3, 5, None), (4, 5, float("nan")), (None, 5, 2.0)], "click_id long, client_id long, value double").selectExpr("*", "1 as batch", "2 as c")
    assert sorted((r["batch"], r["x"], r["c"]) for r in quantiles.value_entries(clicks).collect()) == [(0, 200, 1), (zlib.crc32(b"1") % 16, 100 + 1000 * (zlib.crc32(b"1") % 16), 1)]
    items = spark.createDataFrame([(1, "b", 2.0), (1, "b", 2.0), (2, None, 1.0), (3, "c", None)], "item_id long, brand string, price double").selectExpr("*", "1 as c")
    lines = spark.createDataFrame([(1, None), (1, None), (2, 1), (3, 1), (None, 1), (9, 1)], "item_id long, vendor_id long").selectExpr("*", "1 as grp")
    assert [tuple(r) for r in quantiles.price_entries(lines, items).collect()] == [("b", 0, 200, 2)]
