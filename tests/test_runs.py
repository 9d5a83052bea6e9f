"""Runs from end to end: hidden states to activation rows, agreement of raw samples, commits of several runs, folders as a data
source, table functions in SQL."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.functions import model_text as M
from veritrail.functions import udtfs
from veritrail.functions.values import compare
from veritrail.operators import fields, hooks, locate, trees
from veritrail.sinks import tables
from veritrail.sinks.commits import Committed
from veritrail.sources.folders import PUSHDOWN, AnnotatedFolders


def model():
    class Model:
        """Answers that are hard to read, in tokens of uneven length, with states by step and layer that stop early."""

        def generate(self, prompts, layers):
            for _, user in prompts:
                r = random.Random(user)
                tokens, at = [], 0
                while at < len(user):
                    n = r.randint(1, 4)
                    tokens.append(user[at : at + n])
                    at += n
                states = {k: [[float(k), float(s), float(r.random())] for s in range(1 + len(tokens) + (2 if k == 9 else -k))] for k in layers}
                yield user, tokens, [-0.5] * len(tokens), "stop", states

    return Model  # nested, so that executors get it by value


ANSWERS = ['Here: ```json\n{"a": "xx", "n": [1, {"b": null, "c": ""}], "t": true}\n``` end', '{"a": "é{", "a2": "a"}', "no object", '{"cut": ', "{}", '{"x": 5}', None]


@pytest.mark.parametrize("position", ["last", "mean", "all"])
def test_documents_become_activation_rows(spark, position):
    layers = [1, 3, 9, 60]
    docs = spark.createDataFrame([(i, "s", t, "kept") for i, t in enumerate(ANSWERS)], "doc_id int, system string, user string, more string")
    out = hooks.extracted(docs, model(), layers, position)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[6]["finish_reason"] == "error" and rows[6]["parse_error"] == "document has no text" and rows[6]["fields"] == [] and rows[0]["more"] == "kept"
    assert rows[2]["parsed_json"] is None and rows[2]["parse_error"] and rows[3]["fields"] == [] == rows[4]["fields"]
    got = {(r["doc_id"], r["path_str"], r["layer"]): r["tokens" if position == "all" else "vec"] for r in hooks.activation_rows(out, position).collect()}
    want = {}
    for i, text in enumerate(ANSWERS[:-1]):
        ((_, tokens, _, _, states),) = model()().generate([("s", text)], layers)
        tree, error, candidate = M.parse_output(text)
        for path, _, _, _, start, past, _, _ in () if error else locate.locate(tree, candidate, tokens):
            for k in layers:
                v = np.array(states[k], np.float32).reshape(-1, 3)[1:][: len(tokens)]
                lo = max(0, min(start, len(tokens) - 1))
                hi = max(lo + 1, min(past, len(tokens)))
                span = v[min(lo, len(v) - 1) : hi] if len(v) else v
                if len(span):
                    want[i, path, k] = span.tolist() if position == "all" else (span[-1] if position == "last" else span.mean(0)).tolist()
    assert got.keys() == want.keys() and len(got) > 12 and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    assert hooks.extracted(docs.limit(0), model(), layers).count() == 0
    with pytest.raises(ValueError):
        hooks.extracted(docs, model(), layers, "first")


def test_agreement_of_raw_samples(spark):
    samples = [(1, '{"a": {"b": "X "}, "l": [1, 2.0]}'), (1, '```json\n{"a": {"b": "x"}}\n```'), (1, ' {"a": {"b": 7}}'), (1, "[1]"), (1, "{"), (1, None), (1, '{"a": []}'), (2, "null"), (None, "{}")]
    data = [(1, "a.b", "x"), (1, "l.1", "2"), (1, "l.7", None), (1, "a", None), (2, "a.b", "x"), (3, "a.b", "x"), (None, "a.b", "x")]
    got = fields.agreement(spark.createDataFrame(data, "doc_id int, path_str string, value string"), spark.createDataFrame(samples, "doc_id int, text string")).collect()
    want = {}
    for d, p, v in data:
        trees_ = []
        for who, t in samples:
            try:
                tree = json.loads((t or "").strip())
            except ValueError:
                continue
            if who == d and d is not None and isinstance(tree, dict):
                trees_.append(tree)
        want[d, p] = (sum(compare(v, M.at_path(t, p), "auto", number_tolerance=0.0) for t in trees_) / len(trees_) if trees_ else None, len(trees_))
    assert {(r["doc_id"], r["path_str"]): (None if np.isnan(r["agreement"]) else r["agreement"], r["n_samples"]) for r in got} == want
    assert want[1, "a.b"][1] == 3 and want[2, "a.b"] == (None, 0)


KEYED = "doc_id string, path_str string, v int"


def keyed(spark, numbers, v):
    return spark.createDataFrame([("d", f"p{i}", v) for i in numbers], KEYED)


def test_commits_of_two_runs_neither_lose_nor_double(spark, tmp_path):
    a, b = (Committed(spark, str(tmp_path / "t"), fields.FIELD) for _ in range(2))
    assert a.version() == 0 and a.read() is None
    assert a.append(keyed(spark, range(4), 1)) == 1
    seen = b.version()
    assert a.append(keyed(spark, range(4, 7), 1)) == 2
    assert b.append(keyed(spark, range(5, 9), 2), seen) == 3  # p5 and p6 were there first
    assert sorted((r["path_str"], r["v"]) for r in a.read().collect()) == [(f"p{i}", 1 if i < 7 else 2) for i in range(9)]
    assert b.read(1, 2).count() == 3 and b.clean() == 0


@pytest.mark.parametrize("step", ["lot", "aside", "rename", "after"])
def test_a_crash_at_any_step_of_a_commit(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    Committed(spark, path, fields.FIELD).append(keyed(spark, range(3), 1))
    todo = keyed(spark, range(6), 2)

    def stop(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if step == "lot":
            m.setattr(Committed, "write_lot", stop)
        elif step == "aside":
            m.setattr(Committed, "_commit", stop)
        elif step == "rename":
            m.setattr(Committed, "_drop", stop)  # the number is taken by another run, then the run ends
            whole = Committed._commit
            m.setattr(Committed, "_commit", lambda self, n, lot: (whole(self, n, self.write_lot(keyed(spark, [8], 3))), whole(self, n, lot))[1])
        else:
            whole = Committed._commit
            m.setattr(Committed, "_commit", lambda self, n, lot: (whole(self, n, lot), stop())[1])
        with pytest.raises(OSError):
            tables.resume(todo, path, lambda rows: rows)
    out = tables.resume(todo, path, lambda rows: rows, lots=2).collect()
    found = sorted((r["path_str"], r["v"]) for r in out)
    assert found == sorted([(f"p{i}", 1 if i < 3 else 2) for i in range(6)] + ([("p8", 3)] if step == "rename" else []))
    assert Committed(spark, path, fields.FIELD).clean() == {"lot": 0, "aside": 1, "rename": 2, "after": 0}[step]
    assert len(tables.resume(todo, path, lambda rows: rows).collect()) == len(out)


def test_folders_as_a_data_source(spark, bench):
    spark.dataSource.register(AnnotatedFolders)
    spark.conf.set(PUSHDOWN, "true")
    read = spark.read.format("annotated_folders").option("path", str(bench)).option("files", 2)
    rows = read.load()
    assert sorted((r["domain"], r["stem"]) for r in rows.collect()) == [(d, s) for d in ("law/lease", "sea/crew") for s in ("a 1", "b", "c")]
    assert all(json.loads(r["schema"])["type"] == "object" and "t" in json.loads(r["gold"]) for r in rows.collect()) and rows.rdd.getNumPartitions() == 4
    some = rows.where("domain = 'sea/crew' and stem > 'a'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["stem"] for r in some.collect()) == ["a 1", "b", "c"] and some.rdd.getNumPartitions() == 2
    assert "sea/crew" not in plan.split("Filter")[-1].split("BatchScan")[0] and "stem" in plan
    assert rows.where("domain in ('sea/crew', 'none')").count() == 3 and rows.where("domain = 'none'").count() == 0
    assert rows.where("domain = 'sea/crew' and domain = 'law/lease'").count() == 0
    (bench / "law/lease/other-schema.json").write_text("{}")
    with pytest.raises(Exception, match="has 2 schemas"):
        read.load().where("domain = 'law/lease'").collect()
    with pytest.raises(Exception, match="path is missing"):
        spark.read.format("annotated_folders").load().collect()


def test_table_functions_equal_their_operators(spark):
    udtfs.register(spark)
    r = random.Random(2)
    leaf = lambda: r.choice([None, "", "x", "X", 1, 1.5, True, "2020-01-02"])

    def tree(depth=0):
        k = r.random()
        return leaf() if depth > 2 or k < 0.3 else [tree(depth + 1) for _ in range(r.randrange(3))] if k < 0.5 else {f"k{i}": tree(depth + 1) for i in range(r.randrange(4))}

    schema = json.dumps({"properties": {"k0": {"evaluation_config": "string_exact"}, "k1": {"anyOf": [{"type": "string"}, {"type": "object", "properties": {"k0": {"evaluation_config": "number_tolerance"}}}]}, "k2": {"x-match-mode": "set_membership"}}})
    rows = [(i, schema, json.dumps({"k0": tree(), "k1": tree(), "k2": tree()}), json.dumps({"k0": tree(), "k1": tree(), "k2": tree()})) for i in range(60)] + [(60, schema, "no json", None)]
    pairs = spark.createDataFrame(rows, "doc_id int, schema string, gold string, extracted string")
    pairs.createOrReplaceTempView("udtf_pairs")
    got = spark.sql("select p.doc_id, l.* from udtf_pairs p, lateral tree_labels(p.schema, p.gold, p.extracted) l")
    labels = trees.label_trees(pairs)
    assert sorted(map(str, got.collect())) == sorted(map(str, labels.select(got.columns).collect())) and got.count() > 100
    counts = spark.sql("select * from tree_label_counts(table(udtf_pairs) partition by doc_id)")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, labels.groupBy("doc_id").agg(F.count("*"), F.sum("is_error")).collect()))
    leaves = spark.sql("select p.doc_id, l.* from udtf_pairs p, lateral tree_leaves(p.gold) l")
    assert sorted(map(str, leaves.collect())) == sorted(map(str, trees.tree_leaves(pairs, "gold").collect()))
    near = spark.sql("""select l.error_type from lateral tree_labels('{"properties": {"n": {"evaluation_config": "number_tolerance"}}}', '{"n": 100}', '{"n": 109}', 0.85D, 0.1D) l""")
    assert [x[0] for x in near.collect()] == ["match"]
    for text, why in (("select * from tree_labels(1, '', '')", "JSON texts"), ("select * from tree_label_counts(table(select 1 as doc_id))", "lacks"), ("select * from tree_labels('', '', '', 0.5D, 0.5D, 0.5D)", "two constants")):
        with pytest.raises(Exception, match=why):
            spark.sql(text).collect()


def test_retries_as_they_arrive(spark, tmp_path):
    """Repeats, late attempts, a document given up when its patience is over, one that comes back, over several starts of one query."""
    from veritrail.streaming import retries

    kind = "doc_id string, attempt long, arrived timestamp, ok boolean, value double"
    hour = lambda n: f"2024-01-0{1 + n // 24} {n % 24:02d}:00:00"
    lots = [
        [("a", 1, hour(1), False, 0.1), ("a", 2, hour(2), True, 0.2), ("b", 1, hour(1), False, 0.3), ("c", 5, hour(1), False, 0.4)],
        [("a", 2, hour(2), True, 9.0), ("b", 1, hour(1), True, 9.0), ("b", 2, hour(3), False, 0.5), ("c", 4, hour(3), True, 9.0)],
        [("b", 3, hour(5), True, 0.6), ("b", 4, hour(5), True, 9.0), ("a", 3, hour(5), True, 9.0)],
        [("d", 1, hour(60), True, 0.7)],
        [("c", 6, hour(70), True, 0.8), ("d", 2, hour(71), False, 0.9)],
    ]
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for lot in lots:
        spark.sql("select 1").count()
        spark.createDataFrame([(d, n, None, ok, v) for d, n, _, ok, v in lot], kind).drop("arrived").join(spark.createDataFrame([(d, n, w) for d, n, w, _, _ in lot], "doc_id string, attempt long, w string"), ["doc_id", "attempt"]).selectExpr("doc_id", "attempt", "cast(w as timestamp) as arrived", "ok", "value").coalesce(1).write.mode("append").parquet(src)
        rows = retries.settled(spark.readStream.schema(kind).parquet(src), patience="12 hours", late="24 hours")
        rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("a", "good", 2, 0.2), ("b", "good", 3, 0.6), ("c", "given_up", 1, None), ("c", "good", 1, 0.8), ("d", "good", 1, 0.7)]
