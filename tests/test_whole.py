"""Queries that do the whole job, against plain versions on small tables."""

from collections import Counter

import numpy as np
import pytest

from veritrail.operators import probes, spans
from veritrail.plans import registry

DATA = "/root/testdata/sf0.001"


def test_spans_are_normalised_beyond_80_characters(spark):
    texts = {r["doc_id"]: r["text"] for r in registry.table(spark, DATA, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["span"] for r in registry.queries()["fn_norm_span"](spark, DATA).collect()}
    assert got == {k: None if t is None else " ".join(t.split()).rstrip(" .,;:") for k, t in texts.items()}
    assert any(len(s or "") > 1000 for s in got.values())


def test_reductions_of_spans(spark):
    r = np.random.default_rng(1)
    layers = {(0, 0): r.normal(size=(5, 3)), (0, 1): r.normal(size=(4, 3)), (1, 0): r.normal(size=(1, 3))}
    asked = [(0, 0, 1, 3, 5), (0, 1, -4, 2, 5), (0, 2, 4, 9, 5), (0, 3, 2, 2, 5), (0, 4, 70, 80, 5), (1, 0, 3, 9, 2), (2, 0, 0, 1, 1)]
    tokens = spark.createDataFrame([(d, la, i, [float(x) for x in v]) for (d, la), m in layers.items() for i, v in enumerate(m)], "doc int, layer int, step int, vec array<double>")
    df = spark.createDataFrame(asked, "doc int, span int, first int, past int, generated int")
    want = {how: {} for how in spans.HOW}
    for d, s, first, past, n in asked:
        lo = max(0, min(first, n - 1))
        hi = max(lo + 1, min(past, n))
        for (doc, la), m in layers.items():
            a, b = min(lo, len(m) - 1), min(hi, len(m))
            if doc == d and b > a:
                for i in range(3):
                    want["last"][d, s, la, b - 1, i] = m[b - 1, i]
                    want["mean"][d, s, la, None, i] = m[a:b, i].mean()
                    want["all"] |= {(d, s, la, t, i): m[t, i] for t in range(a, b)}
    for how in spans.HOW:
        got = {tuple(x)[:5]: x["value"] for x in spans.reduce_spans(df, tokens, how).collect()}
        assert got == pytest.approx(want[how]) and got
    with pytest.raises(ValueError):
        spans.reduce_spans(df, tokens, "first")


def auroc(y, p):
    d = np.subtract.outer(p[y == 1], p[y == 0])
    return None if not d.size else float(((d > 0) + (d == 0) / 2).mean())


def layered(seed=3, folds=5, n=14):
    """Two layers, each better in some folds; the last fold is of one class."""
    r = np.random.default_rng(seed)
    fold = np.repeat(np.arange(folds), n)
    y = np.where(fold == folds - 1, 0, r.integers(0, 2, len(fold)))
    x = {k: r.normal(size=(len(y), 3)) + 0.6 * y[:, None] * (fold % 2 == k)[:, None] for k in (0, 1)}
    return fold, y, x


def frame(spark, fold, y, x):
    return spark.createDataFrame([(i, int(fold[i]), int(y[i]), k, [float(z) for z in x[k][i]]) for k in x for i in range(len(y))], "id int, fold int, y int, layer int, vec array<double>")


def score(x, y, train, test):
    beta, bias = probes.fit_logistic(x[train], y[train])
    return 1 / (1 + np.exp(-(x[test] @ beta + bias)))


def test_nested_folds_are_pooled_over_layers(spark):
    fold, y, x = layered()
    p, each, chosen = np.full(len(y), np.nan), [], []
    for f in range(4):
        best = {}
        for k in x:
            found = [auroc(y[fold == g], score(x[k], y, (fold != f) & (fold != g), fold == g)) for g in range(5) if g != f]
            best[k] = np.mean([a for a in found if a is not None])
        chosen.append(max(sorted(best), key=best.get))
        p[fold == f] = score(x[chosen[-1]], y, fold != f, fold == f)
        each.append(auroc(y[fold == f], p[fold == f]))
    assert len(set(chosen)) == 2
    (got,) = probes.nested_ranking(frame(spark, fold, y, x)).collect()
    assert got["n"] == 56 and got["n_folds"] == 4 and got["auroc"] == pytest.approx(auroc(y[fold < 4], p[fold < 4]))
    assert (got["auroc_mean"], got["auroc_std"]) == pytest.approx((np.mean(each), np.std(each)))
    assert [tuple(z) for z in got["layers"]] == sorted(Counter(chosen).items())


def test_conflict_against_the_baseline(spark):
    fold, y, x = layered()

    def held_out(v):
        p = np.zeros(len(y))
        for f in range(5):
            p[fold == f] = score(v, y, fold != f, fold == f)
        return p

    p = {k: held_out(x[k]) for k in x}
    best = max(sorted(p), key=lambda k: auroc(y, p[k]))
    both = np.column_stack([x[best], np.std([p[0], p[1]], axis=0)])
    (got,) = probes.conflict_ranking(frame(spark, fold, y, x)).collect()
    a, b = auroc(y, held_out(x[best])), auroc(y, held_out(both))
    assert (got["best_layer"], got["n"], got["n_pos"]) == (best, 70, y.sum())
    assert (got["auroc_baseline"], got["auroc_conflict"], got["delta"]) == pytest.approx((a, b, b - a))
    assert probes.conflict_ranking(frame(spark, fold, y * 0, x)).count() == 0
