"""Queries against their SQL on rows that the smallest tables lack."""

import duckdb
import numpy as np
import pytest

from veritrail.operators import probes
from veritrail.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(map(repr, rows))


def both(spark, at, name, **made):
    """Rows of a query and of its SQL over the tables made, each an SQL text, and those of DATA beside them."""
    db = duckdb.connect()
    for table in ("benchmark", "customer", "documents", "embeddings", "events", "orders", "pages"):
        db.execute(f"create view {table}_all as select * from '{DATA}/{table}.parquet'")
        db.execute(f"copy ({made.get(table, f'select * from {table}_all')}) to '{at}/{table}.parquet'")
        db.execute(f"create view {table} as select * from '{at}/{table}.parquet'")
    df = registry.queries()[name](spark, str(at))
    cur = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    return plain(tuple(r[n] for n in names) for r in df.collect()), plain(cur.fetchall())


@pytest.mark.parametrize("name", ["pol_investigate", "agg_buckets"])
def test_causes_of_short_gold(spark, tmp_path, name):
    texts = ["Erö.", "a", '"ab"', "...", "Q1", "12", "abcd", "'a b'"]
    rows = " union all ".join(f"select * replace ({3 * i} as doc_id, '{t.replace(chr(39), 2 * chr(39))}' as text) from (from documents_all limit 1)" for i, t in enumerate(texts, 1))
    got, want = both(spark, tmp_path, name, documents=rows)
    assert got == want


def test_entities_cut_off(spark, tmp_path):
    pages = "select * replace (case page_id % 4 when 0 then 'a &amp</title> &copy b' when 1 then '&am &lt; &amp;lt;' when 2 then '&amp;amp; & &#38; &quot' else html end as html) from pages_all"
    got, want = both(spark, tmp_path, "fn_norm_text", pages=pages)
    assert got == want


@pytest.mark.parametrize("name", ["src_realkie_row", "src_realkie", "src_realkie_gold", "src_realkie_build"])
def test_records_of_documents_without_text_and_of_long_ids(spark, tmp_path, name):
    texts = "select * replace (case doc_id % 7 when 1 then null when 2 then '' when 3 then ' ' || chr(10) || chr(9) when 4 then '-' when 5 then '=' || text else text end as text) from documents_all"
    long = "select * replace (36028797018963968 + 3 * doc_id as doc_id) from documents_all"
    got, want = both(spark, tmp_path, name, documents=f"{texts} union all {long}")
    assert got == want and len(got) > 150


def test_stacked_model_rests_on_every_row(spark):
    r = np.random.default_rng(3)
    n, folds = 33_000, 3
    x, s, fold = r.normal(size=(n, 2)), r.normal(size=n), np.arange(n) % folds
    y = (x[:, 0] + s + 2 * r.normal(size=n) > 1).astype(int)
    rows = spark.createDataFrame([(i, int(fold[i]), 0, int(y[i]), x[i].tolist(), float(s[i])) for i in range(n)], "id int, fold int, layer int, y int, vec array<double>, s double")
    p, weights = probes.stacked(rows, ["s"])
    assert p.count() == n
    found = {(w["hold"], w["signal"]): w["coefficient"] for w in weights.collect()}
    for f in range(folds):
        train = fold != f
        beta, bias = probes.fit_logistic(x[train], y[train])
        z = np.column_stack([1 / (1 + np.exp(-(x @ beta + bias))), s])
        z = (z - z[train].mean(0)) / z[train].std(0)
        assert [found[f, "probe"], found[f, "s"]] == pytest.approx(probes.fit_logistic(z[train], y[train])[0].tolist(), abs=1e-6)
