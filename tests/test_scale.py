"""What holds at any number of rows, folds and ranges: distributed fits, running sums, pooled curves, needles in texts."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.functions import expressions as X
from veritrail.operators import fields, metrics, newton, policies, probes, ranges


def rows_of(spark, x, y, fold, layer=0):
    """A table of vectors without a Python row each."""
    import pyarrow as pa

    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.asarray(x, float).ravel()))
    kinds = {"id": pa.int64(), "fold": pa.int32(), "layer": pa.int32(), "y": pa.int32()}
    columns = {"id": np.arange(len(y)), "fold": fold, "layer": np.full(len(y), layer), "y": y}
    return spark.createDataFrame(pa.table({k: pa.array(np.asarray(v), kinds[k], safe=False) for k, v in columns.items()} | {"vec": vec}))


def made(n, d, folds, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    y = (r.random(n) < 1 / (1 + np.exp(-(x[:, : min(d, 4)].sum(1) - 1)))).astype(int)
    return x, y, r.integers(0, folds, n)


def test_fits_over_partitions_equal_one_fit_of_all_rows(spark):
    x, y, fold = made(50_000, 32, 5)
    rows = rows_of(spark, x, y, fold).repartition(6)
    (one,) = newton.weights(rows, 0).collect()
    beta, bias = probes.fit_logistic(x, y)
    assert one["n_train"] == 50_000 and np.abs(np.array(one["beta"]) - beta).max() < 1e-6 and abs(one["bias"] - bias) < 1e-6
    held = {r["hold"]: r for r in newton.weights(rows, 1).collect()}
    for k in (0, 3):
        beta, bias = probes.fit_logistic(x[fold != k], y[fold != k])
        assert held[k]["n_train"] == (fold != k).sum() and np.abs(np.array(held[k]["beta"]) - beta).max() < 1e-6


def test_a_thousand_folds(spark):
    x, y, fold = made(4000, 32, 1000)
    rows = rows_of(spark, x, y, fold)
    held = {r["hold"]: r for r in probes.held_out_weights(rows).collect()}
    assert len(held) == len(set(fold)) > 950
    for k in (1, 500, 999):
        beta, bias = probes.fit_logistic(x[fold != k], y[fold != k])
        assert np.abs(np.array(held[k]["beta"]) - beta).max() < 1e-6 and abs(held[k]["bias"] - bias) < 1e-6
    p = probes.held_out_scores(rows)
    assert p.count() == 4000 and 0.8 < metrics.ranking(p, [], "p").first()["auroc"] < 1


def test_paths_of_a_fit_agree(spark):
    """In one task and over partitions; with one and two folds left out, one class missing, and vectors longer than rows are many."""
    x, y, fold = made(300, 3, 6)
    y[fold == 2] = 0
    rows = rows_of(spark, x, y, fold).unionByName(rows_of(spark, x[:40], 0 * y[:40], fold[:40], 1))
    for out in (0, 1, 2):
        a, b = (sorted(map(str, newton.weights(rows, out, both=both, rows_a_task=n).selectExpr("*").drop("beta", "bias").collect())) for both, n in ((True, 10_000), (True, 10)))
        assert a == b
        one, two = ({tuple(r[c] for c in r.__fields__ if c not in ("beta", "bias")): (*r["beta"], r["bias"]) for r in newton.weights(rows, out, rows_a_task=n).collect()} for n in (10_000, 10))
        assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-7) for k in one)
    wide = made(20, 60, 2)
    got = newton.weights(rows_of(spark, *wide), 0).first()
    assert np.allclose(got["beta"], probes.fit_logistic(wide[0], wide[1])[0], atol=1e-6)
    with pytest.raises(ValueError):
        newton.weights(rows_of(spark, np.zeros((30, 2000)), np.arange(30) % 2, np.zeros(30)), 0, rows_a_task=10)
    assert newton.weights(rows.limit(0), 1).count() == 0


def test_nested_choice_against_plain_loops(spark):
    layers = [made(150, 3, 4, seed) for seed in (1, 2)]
    y, fold = layers[0][1], layers[0][2]
    rows = rows_of(spark, layers[0][0], y, fold, 0).unionByName(rows_of(spark, layers[1][0], y, fold, 1))
    want = {}
    for outer in range(4):
        score = []
        for x, *_ in layers:
            found = []
            for inner in set(range(4)) - {outer}:
                train = (fold != outer) & (fold != inner)
                w = probes.fit_logistic(x[train], y[train])
                found.append(probes.auroc(y[fold == inner], x[fold == inner] @ w[0] + w[1]))
            score.append(np.mean([a for a in found if a is not None]))
        want[outer] = int(np.argmax(score))
    assert {r["fold"]: r["layer"] for r in probes.nested_scores(rows).select("fold", "layer").distinct().collect()} == want


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_running_sums_do_not_depend_on_ranges(spark, parts):
    r = random.Random(3)
    data = [(r.choice([None, "a", "a", "a", "b"]), r.randrange(30), i, r.randrange(5) if i % 9 else None) for i in range(600)]
    rows = spark.createDataFrame(data, "g string, s int, id int, v int")
    got = {x["id"]: (x["v_to"], x["v_all"]) for x in ranges.running(rows, ["g"], [F.desc("s"), F.col("id")], ["v"], parts).collect()}
    want = {}
    for g in (None, "a", "b"):
        total = 0
        for _, s, i, v in sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2])):
            total += v or 0
            want[i] = total
        for _, _, i, _ in (x for x in data if x[0] == g):
            want[i] = (want[i], total)
    assert got == want
    assert ranges.running(rows.limit(0), ["g"], [F.col("s")], ["v"], parts).count() == 0
    whole = ranges.running(rows, [], [F.col("s"), F.col("id")], ["v"], parts)
    assert {x["v_all"] for x in whole.collect()} == {sum(x[3] or 0 for x in data)}


def test_a_hot_group_is_spread_over_ranges(spark):
    rows = spark.range(20_000).withColumns({"g": F.lit("hot"), "one": F.lit(1).cast("long")})
    out = ranges.running(rows, ["g"], [F.col("id")], ["one"], 16)
    sizes = [r["count"] for r in spark.read.parquet(*out.inputFiles()).groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16 and out.where("one_to <> id + 1").count() == 0


def test_curves_of_one_collection(spark):
    r = random.Random(5)
    data = [(f"d{i % 7}", f"p{i}", r.choice([0.1, 0.5, float("nan")]), -r.random(), r.randrange(2), r.randrange(-1, 2)) for i in range(300)]
    rows = spark.createDataFrame(data, "doc_id string, path_str string, probe_score double, min_logprob double, is_error int, delta int")
    out = policies.curves(rows, [], which=("oracle", "logprob"))
    for name, key in (("oracle", lambda x: (-x[4], x[0], x[1])), ("logprob", lambda x: (x[3], x[0], x[1]))):
        net, want = 0, [(0, 0)]
        for n, x in enumerate(sorted(data, key=key), 1):
            net += x[5]
            want.append((n, net))
        assert sorted((x["cost"], x["net"]) for x in out.where(F.col("strategy") == name).collect()) == want
    assert {x["strategy"] for x in out.select("strategy").distinct().collect()} == {"oracle", "logprob"}


@pytest.mark.parametrize("spread", [False, True])
def test_metrics_of_groups_however_sorted(spark, spread):
    r = np.random.default_rng(8)
    g, y, p = r.integers(0, 3, 500), r.integers(0, 2, 500), r.integers(0, 25, 500) / 25.0
    rows = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(g, p, y)], "g int, score double, y int")
    for x in metrics.ranking(rows, ["g"], spread=spread, parts=7).collect():
        k = g == x["g"]
        assert x["auroc"] == pytest.approx(probes.auroc(y[k], p[k])) and x["ap"] == pytest.approx(probes.measures(y[k], p[k])["ap"])
    for x in metrics.threshold_for_recall(rows, ["g"], 0.4, spread=spread).collect():
        k = (g == x["g"]) & (y == 1)
        assert x["threshold"] == np.sort(p[k])[::-1][int(np.ceil(0.4 * k.sum())) - 1]


def plain_search(value, text, longest=80):
    """Whether and how a value stands in a text, word by word and rule by rule."""

    def norm(s):
        s = re.sub("­\\s*", "", html.unescape(s).lower())
        s = re.sub("[‐‑‒–—―−]", "-", s).replace(",", "").replace("$", "")
        return re.sub(r"\s+", " ", s).strip()

    if not text:
        return False, "doc_text_unavailable"
    t, raw = norm(text), (value or "").strip()
    if not raw:
        return False, "empty_gold"
    if len(raw) > longest:
        words = [w for w in norm(raw).split() if len(w) > 4]
        return (sum(w in t for w in words) >= 0.6 * len(words), "too_long_wordmatch") if words else (False, "too_long_unchecked")
    v = norm(raw)
    if not v:
        return False, "empty_gold"
    try:
        n = float(v)
    except ValueError:
        return v in t, "normalized_substr"
    return any(c in t for c in {v, str(n), str(int(n)) if n.is_integer() else str(n)}), "numeric"


def test_values_in_texts_with_entities(spark):
    texts = {
        1: "Bread &amp; Butter Ltd.  paid $1,250.00 on the hand­\nwritten bill &lt;no. 7&gt; of caf&eacute; &#8220;Nord&#8221; &copy; 2020",
        2: "a–b  and 3e2 or 300; " + "something distinctive was written here " * 9,
        3: "", 4: None, 5: "AT&T and R&amp;amp;D; " + "x" * 5000 + " the end",
    }
    values = ["Bread & Butter", "bread &amp; butter", "1250", "1,250.00", "$1250", "handwritten", "<no. 7>", "café “nord”", "© 2020", "a-b", "300", "3e2", "3e5", None, " ", "$,", "AT&T", "R&D", "r&amp;d", "the END", "zzz", "something distinctive was written " * 4, "of a b c " * 12, "nothing distinctive wasnt written there " * 4, "7", "x" * 70]
    data = [(d, f"p{i}", v) for d in (1, 2, 3, 4, 5, 6, None) for i, v in enumerate(values)]
    rows = spark.createDataFrame(data, "doc_id int, row string, gold_value string").withColumn("n", F.lit(0))
    got = fields.gold_in_text(rows, spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect()
    assert {(r["doc_id"], r["row"]): (r["present"], r["method"]) for r in got} == {(d, p): plain_search(v, texts.get(d)) for d, p, v in data}
    one = rows.where("doc_id = 1").select("row", X.value_in_text(F.col("gold_value"), F.lit(X.searchable(texts[1]))).alias("r"))
    assert {r["row"]: tuple(r["r"]) for r in one.collect()} == {f"p{i}": plain_search(v, texts[1]) for i, v in enumerate(values)}
