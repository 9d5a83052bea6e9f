"""Every registered query of the library itself against its SQL in DuckDB, and the entry without the optional subpackage."""

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from veritrail.operators import metrics, probes
from veritrail.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def bare(v):
    """Nulls and NaN alike, rows and lists as lists."""
    if isinstance(v, (list, tuple)):
        return [bare(x) for x in v]
    if isinstance(v, dict):
        return [bare(x) for x in v.values()]
    return "" if v is None or isinstance(v, float) and math.isnan(v) else v


def plain(rows):
    return sorted(repr(bare(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain([r[c] for c in cols] for r in df.collect())
    cur = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == plain([r[names.index(c)] for c in cols] for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_pooled_ranking_does_not_depend_on_ranges(spark, ranges):
    r = np.random.default_rng(5)
    y, p = r.integers(0, 2, 400), r.integers(0, 40, 400) / 40.0
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "score double, y int")
    got = metrics.ranking(rows, [], parts=ranges).first()
    assert got["auroc"] == pytest.approx(probes.auroc(y, p)) and got["ap"] == pytest.approx(probes.measures(y, p)["ap"])
    found = metrics.threshold_for_recall(rows, [], 0.3, parts=ranges).first()["threshold"]
    assert found == np.sort(p[y == 1])[::-1][int(np.ceil(0.3 * y.sum())) - 1]
    assert metrics.threshold_for_recall(rows.where("y = 0"), [], 0.3).count() == 0 and metrics.ranking(rows.limit(0), []).first()["auroc"] is None


def test_ranking_of_ties_and_single_classes(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (1, 0.9, 0), (1, 0.4, 1), (1, 0.1, 0), (1, 0.2, 0), (2, 0.5, 1), (3, float("nan"), 1), (3, 0.1, 0)], "g int, score double, y int")
    got = {r["g"]: r for r in metrics.ranking(rows, ["g"]).collect()}
    assert got[1]["auroc"] == 0.75 and got[2]["auroc"] is None and got[3]["auroc"] is None and got[3]["ap"] is None


def test_logistic_gradient_vanishes():
    r = np.random.default_rng(0)
    for n, h in ((60, 5), (20, 40)):
        x, y = r.normal(size=(n, h)), (r.random(n) < 0.3).astype(float)
        y[:2] = 0, 1
        beta, bias = probes.fit_logistic(x, y, 0.7)
        w = 0.7 * np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
        p = 1 / (1 + np.exp(-(x @ beta + bias)))
        assert np.abs(x.T @ (w * (p - y)) + beta).max() < 1e-5 and abs((w * (p - y)).sum()) < 1e-5


def test_entry_stands_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for p in ("__spark_entry__.py", "veritrail"):
        os.symlink(root / p, tmp_path / p) if p.endswith(".py") else None
    (tmp_path / "veritrail").mkdir()
    for p in (root / "veritrail").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "veritrail" / p.name)
    code = "import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); " + code], check=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""})
