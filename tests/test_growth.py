"""What keeps a query's dearest task and its dear calls from growing faster than the tables."""

import json
import math

from pyspark.sql import functions as F

from veritrail.functions import model_text, udtfs, values
from veritrail.operators import audit, fields, hooks, ranges, trees
from veritrail.plans import audits
from veritrail.sources import collections


def test_a_row_group_is_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "ENOUGH", 1)
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    df = ranges.spread(spark.read.parquet(f"{tmp_path}/one"))
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 1000 and len(rows) >= 4 and max(rows) < 500


def test_prompts_are_dealt_to_all_cores(spark):
    prompts = spark.range(100).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("s").alias("system"), F.lit("a: b").alias("user"))
    for out in (hooks.extracted(prompts, hooks.StubStates, [1]), hooks.generated(prompts, hooks.StubGenerator)):
        assert out.groupBy(F.spark_partition_id()).count().count() >= 4


def test_scores_of_one_layer_are_not_one_task(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("doc_id"), F.lit("p").alias("path_str"), F.lit("v").alias("value"))
    weights = spark.createDataFrame([(7, [0.1, -0.5, 0.01], -0.2)], "layer int, beta array<double>, bias double")
    out = hooks.reembedded(rows, hooks.StubEmbedder, weights, 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.groupBy(F.spark_partition_id()).count().count() >= 4


def test_a_date_is_read_once(monkeypatch):
    asked, parse = [], values.dateutil_parser.parse
    monkeypatch.setattr(values.dateutil_parser, "parse", lambda s, **k: asked.append(s) or parse(s, **k))
    for _ in range(3):
        assert not values.same_date("value 7123", "other 7123")
    assert len(asked) <= 2


def test_partitions_of_a_table_function_share_schemas(monkeypatch):
    asked, parsed = [], trees.parsed
    monkeypatch.setattr(trees, "parsed", lambda t: asked.append(t) or parsed(t))
    monkeypatch.setattr(udtfs, "parsed", trees.parsed)
    row = {"schema": '{"properties": {"once": {}}}', "gold": '{"once": 1}', "extracted": '{"once": 2}'}
    for doc in range(3):
        counts = udtfs.TreeLabelCounts.func()
        counts.eval({"doc_id": doc, **row})
        assert list(counts.terminate()) == [(doc, 1, 1)]
    assert asked.count(row["schema"]) == 1


def test_documents_are_dealt_before_they_are_words(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    plan = audits.spans(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("RepartitionByExpression")


def test_places_in_a_long_text_are_looked_up_by_piece(spark):
    text = "".join(chr(97 + i % 7) + ("😀" if i % 5 == 0 else "") for i in range(1500))
    data = [(1, i, "x", s, s + n, text[s : s + n] + ("" if i % 3 else "!")) for i, (s, n) in enumerate((s, n) for s in (0, 1, 255, 256, 257, 700, len(text) - 3, len(text)) for n in (0, 1, 2, 256, 600))]
    data += [(1, 90, "x", 5, 3, ""), (1, 91, "x", -3, 0, text[-3:]), (1, 92, "x", None, 3, "a"), (2, 0, "x", 0, 1, ""), (3, 0, "x", 0, 1, "a")]
    spans = spark.createDataFrame(data, "doc_id int, pos int, label string, start int, end int, text string")
    docs = spark.createDataFrame([(1, "train", text), (2, "val", ""), (3, "val", None)], "doc_id int, split string, text string")
    out = audit.offsets(docs, spans, None)
    got = out.first()
    assert got["checked"] == len(data) - 1 and got["mismatched"] == sum(i % 3 == 0 for i in range(40)) + 1
    assert "pieces" in out._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_read_once_for_their_gold(spark, tmp_path):
    rows = [(1, "nda", '[{"label": "L0", "text": " A "}, {"label": "no", "text": "b"}, null, {"label": "L0", "text": "a"}, {"label": "L1"}, {"label": "L1", "text": "c."}, {"text": "d"}]'), (2, "nda", "no json"), (3, "lease", None), (4, "other", "[]")]
    spark.createDataFrame(rows, "doc_id int, domain string, labels string").write.parquet(f"{tmp_path}/records")
    fields = spark.createDataFrame([("nda", "L0", "x"), ("nda", "L1", "x"), ("nda", "L1", "y"), ("lease", "L0", "z"), ("nda", None, "w"), (None, "L0", "v")], "domain string, label string, field string")
    out = collections.gold_of_spans(spark.read.parquet(f"{tmp_path}/records"), fields)
    assert {(r["doc_id"], r["field"]): r["values"] for r in out.collect()} == {(1, "x"): ["A", "c"], (1, "y"): ["c"], (1, "w"): [], (2, "x"): [], (2, "y"): [], (2, "w"): [], (3, "z"): []}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_files_are_read_without_a_batch_of_them_at_hand(spark):
    def held(content):  # MB of the worker that reads, and the file's text
        return str(int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20).rjust(5) + content.decode()

    def most(n):
        files = spark.range(0, n, 1, 1).select("id", F.repeat(F.char(97 + F.col("id") % 26), F.lit(100_000)).cast("binary").alias("content"))
        return collections.read_files(files, held).agg(F.max(F.substring("text", 1, 5).cast("int")), F.count("text")).first()

    few, many = most(10), most(3000)
    assert few[1] == 10 and many[1] == 3000 and many[0] - few[0] < 100


def test_samples_and_fields_meet_in_one_shuffle(spark):
    blank = " \u0085\x1c\n"  # what strip takes off
    texts = ['{"a": %d}', blank + '{"a": "%d", "l": [0, %d]}' + blank, "```json\n{}\n```", '[{"a": %d}]', "{", "\ufeff{}", "{} x", blank, '{"a": NaN}', "{\n}", '{"a": 1}}', '"{}"']
    samples = [(i, t.replace("%d", str(i + n % 3))) for i in range(50) for n, t in enumerate(texts[: i % 13])] + [(None, "{}"), (3, None)]
    data = [(i, p, str(i)) for i in range(60) for p in ("a", "l.1", "l.-1", "b")[: 1 + i % 4]] + [(None, "a", "1"), (7, "b", None)]
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
        want[d, p, v] = (sum(values.compare(v, model_text.at_path(t, p), "auto", number_tolerance=0.0) for t in trees_) / len(trees_) if trees_ else None, len(trees_))
    out = fields.agreement(spark.createDataFrame(data, "doc_id int, path_str string, value string"), spark.createDataFrame(samples, "doc_id int, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "collect_list" not in plan
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("3", before):  # a document may reach over batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = fields.agreement(spark.createDataFrame(data, "doc_id int, path_str string, value string"), spark.createDataFrame(samples, "doc_id int, text string")).collect()
        assert len(got) == len(data) and {(r[0], r[1], r[2]): (None if math.isnan(r["agreement"]) else r["agreement"], r["n_samples"]) for r in got} == want
    assert max(n for _, n in want.values()) > 3
