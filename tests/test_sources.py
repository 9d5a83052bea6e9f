"""Files read, written and watched: collections, artifacts, settings, caches, and labels of a stream; small cases made here."""

import json

import numpy as np
import pytest

from veritrail.functions import expressions as X
from veritrail.functions import model_text as M
from veritrail.functions import values
from veritrail.operators import fields, locate, trees
from veritrail.sinks import tables
from veritrail.sources import artifacts, collections
from veritrail.sources.settings import Settings
from veritrail.streaming import labels as streaming


@pytest.fixture
def reader():
    def read(content):  # nested, so that executors get it by value
        if content.startswith(b"!"):
            raise ValueError("no PDF")
        return content.decode()

    return read


def test_folders_become_documents(spark, bench, reader):
    docs = collections.load("extract_bench", spark, str(bench), reader, min_chars=8, read_meta=lambda c: {"page_count": len(c)})
    got = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(got) == ["law__lease__a_1", "law__lease__b", "law__lease__c", "sea__crew__a_1", "sea__crew__b", "sea__crew__c"]
    assert got["law__lease__a_1"]["text"] == "a long enough text" and got["law__lease__a_1"]["extraction_error"] is None and got["law__lease__a_1"]["metadata"] == {"page_count": "18"}
    assert got["sea__crew__b"]["text"] == "" and got["sea__crew__b"]["extraction_error"] == "ValueError: no PDF" and "fewer than 8" in got["sea__crew__c"]["extraction_error"]
    assert all(json.loads(r["schema"])["type"] == "object" and json.loads(r["gold"]).keys() == {"t"} for r in got.values())
    few = collections.load("extract_bench", spark, str(bench), reader, domains=["sea/crew"], limit=2, max_documents=99)
    assert sorted(r["doc_id"] for r in few.collect()) == ["sea__crew__a_1", "sea__crew__b"]


def test_what_folders_must_have(spark, bench, reader):
    with pytest.raises(ValueError):
        collections.folder_documents(spark, str(bench), reader, domains=["sea/none"])
    with pytest.raises(FileNotFoundError):
        collections.folder_documents(spark, str(bench / "nowhere"), reader)
    with pytest.raises(KeyError):
        collections.folder_schema(str(bench), "law/notes")
    (bench / "law/lease/other-schema.json").write_text("{}")
    with pytest.raises(ValueError):
        collections.folder_schema(str(bench), "law/lease")
    for text in ("[]", '{"schema_definition": []}', '{"version": 1}'):
        with pytest.raises(ValueError):
            collections.unwrapped_schema(text)
    with pytest.raises(ValueError):
        collections.load("nothing")


def test_ids_are_checked_as_rows_are_read(spark):
    good = spark.createDataFrame([("a",)], "doc_id string")
    assert collections.validated(good).count() == 1
    for bad in ("", None, "a/b", "a?"):
        with pytest.raises(Exception, match="bad document id"):
            collections.validated(spark.createDataFrame([(bad,)], "doc_id string")).collect()


def test_tables_of_spans(spark, tmp_path):
    at = tmp_path / "nda"
    at.mkdir()
    quote = lambda spans: json.dumps(spans).replace('"', '""')
    head = "Unnamed: 0,document_path,text,labels,original_filename\n"
    spans = [{"label": "Party", "start": 0, "end": 5, "text": "Alder\nBio, Inc.,"}, {"label": "Party", "text": "ALDER BIO, INC"}, {"label": "Other", "text": "x"}, {"label": "Date", "text": " .,"}]
    (at / "train.csv").write_text(head + f'0,nda/files/h1.pdf,"A ""quoted""\ntext","{quote(spans)}",one.pdf\n1,nda/files/h2.pdf,"  ",no json,two.pdf\n2,,lost,[],x\n')
    (at / "test.csv").write_text(head + f'0,nda/files/h1.pdf,later,"[]",again.pdf\n1,nda/files/h3.pdf,text,"{{}}",three.pdf\n')
    names = spark.createDataFrame([("nda", "Party", "party"), ("nda", "Date", "date")], "domain string, label string, field string")
    schemas = spark.createDataFrame([("nda", "{}")], "domain string, schema string")
    got = {r["doc_id"]: r for r in collections.span_table(spark, str(tmp_path), names, schemas).collect()}
    assert sorted(got) == ["nda__h1", "nda__h2", "nda__h3"]
    assert got["nda__h1"]["text"] == 'A "quoted"\ntext' and got["nda__h1"]["metadata"]["split"] == "train" and json.loads(got["nda__h1"]["gold"]) == {"party": ["Alder Bio, Inc"], "date": []}
    assert got["nda__h2"]["text"] == "" and got["nda__h2"]["extraction_error"] == collections.EMPTY_TEXT and json.loads(got["nda__h2"]["gold"]) == {"party": [], "date": []}
    assert json.loads(got["nda__h3"]["gold"]) == {"party": [], "date": []}


def test_claims(spark):
    rows = spark.createDataFrame([(0, "t", '{"header": {"claim_id": "C 1/2"}}'), (7, "t", "{'header': {'claim_id': None}, 'n': True}"), (1234, None, "neither"), (8, "t", "[1]"), (9, "t", '{"header": {"claim_id": "C 1/2"}}')], "index int, claim_text string, ground_truth string")
    docs = collections.claim_documents(rows, "{}")
    assert sorted(r["doc_id"] for r in docs.collect()) == ["insurance__C_1_2", "insurance__C_1_2", "insurance__claim007", "insurance__claim008", "insurance__claim1234"]
    assert [tuple(r) for r in collections.duplicate_ids(docs).collect()] == [("insurance__C_1_2", 2)]
    assert collections.parsed_gold("{'a': None}") == {"a": None} and collections.parsed_gold(None) == {}


def test_artifacts(spark, tmp_path):
    ex = tmp_path / "ex"
    ex.mkdir()
    body = {"domain": "d", "parsed_json": {"b": [1, {"c": None}]}, "parse_error": None, "token_logprobs": [-0.5, -1.0], "fields": [{"path": ["b", "0"], "path_str": "b.0", "value": "1", "is_empty": False, "token_span": [0, 1]}]}
    (ex / "doc.1.json").write_text(json.dumps(body, indent=1))
    (ex / "named.json").write_text(json.dumps({**body, "doc_id": "other"}))
    (ex / "_summary.json").write_text("{}")
    (ex / "x_summary.json").write_text("{}")
    rows = artifacts.extractions(spark, str(ex))
    assert sorted(r["doc_id"] for r in rows.collect()) == ["doc.1", "other"] and json.loads(rows.first()["parsed_json"]) == body["parsed_json"]
    assert sorted(map(tuple, artifacts.extraction_fields(rows).select("doc_id", "path_str", "start", "past").collect())) == [("doc.1", "b.0", 0, 1), ("other", "b.0", 0, 1)]
    labels = tmp_path / "labels"
    labels.mkdir()
    (labels / "d1.json").write_text(json.dumps({"domain": "d", "labels": [{"path": ["a"], "path_str": "a", "is_error": 1, "error_type": "omission", "gold_value": "x", "extracted_value": None}]}))
    assert [tuple(r) for r in artifacts.labels(spark, str(labels)).select("doc_id", "pos", "path_str", "is_error", "extracted_present").collect()] == [("d1", 0, "a", 1, None)]
    np.savez_compressed(tmp_path / "d1.npz", **{"a.b__layer3": np.arange(3, dtype=np.float16), "c__layer3": np.ones((2, 3), np.float16)})
    acts = {r["path_str"]: r for r in artifacts.activations(spark, str(tmp_path)).collect()}
    assert acts["a.b"]["vec"] == [0, 1, 2] and acts["a.b"]["tokens"] is None and acts["c"]["tokens"] == [[1, 1, 1]] * 2 and acts["c"]["layer"] == 3 and acts["c"]["doc_id"] == "d1"
    (tmp_path / "cache.json").write_text(json.dumps({"d::a::b": {"new_value": "v", "raw": "r"}}))
    assert [tuple(r) for r in fields.split_key(artifacts.cache(spark, str(tmp_path / "cache.json"))).select("doc_id", "path_str", "new_value").collect()] == [("d", "a::b", "v")]
    many = {"d::a": {"orig_p_err": 0.5, "orig_value": "o", "gold_value": "g", "is_error": 1, "candidates": [{"value": "x", "p_err": 0.25}, {"value": "y", "p_err": None}]}}
    (tmp_path / "many.json").write_text(json.dumps(many))
    assert [tuple(r) for r in artifacts.candidate_cache(spark, str(tmp_path / "many.json")).select("key", "idx", "value", "p").collect()] == [("d::a", 0, "x", 0.25), ("d::a", 1, "y", None)]
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    assert sorted(r[0] for r in artifacts.document_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]


def test_settings(tmp_path):
    good = "experiment: {name: run}\ndata: {benchmark: real_kie, path: x}\nactivations: {layers: [9, 4, 9], position: all}\n"
    (tmp_path / "c.yaml").write_text(good)
    s = artifacts.settings(str(tmp_path / "c.yaml"), Settings)
    assert s.activations.layers == [4, 9] and s.artifacts_path == "artifacts/run" and s.labeling.number_tolerance == 0.01
    for bad in (good.replace("real_kie", "sob"), good.replace("[9, 4, 9]", "[]"), good.replace("[9, 4, 9]", "[0]"), good.replace("all", "middle"), good + "labeling: {fuzzy_threshold: 2}\n"):
        (tmp_path / "c.yaml").write_text(bad)
        with pytest.raises(ValueError):
            artifacts.settings(str(tmp_path / "c.yaml"), Settings)
    (tmp_path / "c.yaml").write_text("- a list")
    with pytest.raises(ValueError):
        artifacts.settings(str(tmp_path / "c.yaml"))
    with pytest.raises(FileNotFoundError):
        artifacts.settings(str(tmp_path / "none.yaml"))


def test_json_in_prose():
    whole = '{"a": "} \\" {", "b": {"c": [1]}}'
    for text in (whole, f"So: {whole} and }} more", f"```json\n{whole}\n```", f"```\n{whole}\n``` {{}}", f"<think>{{ no }}</think> {whole}"):
        assert M.strip_to_json(text) == whole
    assert M.balanced('{"a": "}"', 0) is None and M.strip_to_json(" {open ") == "{open" and M.strip_to_json("none") == "none"
    assert M.parse_output(None)[1] == "model produced no text (None)" and M.parse_output(" \n")[1] == "no JSON content found in output" and M.parse_output("{x")[1].startswith("JSONDecodeError: ")
    assert M.parse_value("null") == "null" and M.parse_value("```3```") == 3 and M.parse_value("a b") == "a b" and M.parse_value('"x"') == "x"


def test_places_of_values():
    text = '{"a": "red", "b": {"a": "red"}, "n": null, "z": 0, "t": false, "k": "b", "q": "a\\nb", "e": []}'
    tokens = ["Ok ", *[text[i : i + 4] for i in range(0, len(text), 4)]]
    got = {r[0]: r for r in locate.locate(json.loads(text), text, tokens)}
    assert [*got] == ["a", "b.a", "n", "z", "t", "k"]  # text with an escape is not found
    assert (got["a"][6], got["b.a"][6]) == (3 + text.index("red"), 3 + text.rindex("red")) and got["n"][3] and got["n"][6] == got["n"][7] == got["b.a"][7]
    assert not got["z"][3] and not got["t"][3] and all(r[5] > r[4] for r in got.values())
    joined = "".join(tokens)
    assert all(joined[r[6] : r[7]] in "".join(tokens[r[4] : r[5] + 1]) for r in got.values())
    assert [*locate.locate({"a": 1}, '{"a": 1}', [])] == [("a", "integer", "1", False, 0, 0, 6, 7)]


def test_prompts_say_which_item():
    schema = {"properties": {"crew": {"items": {"properties": {"rank": {"type": "string", "description": "The rank", "enum": ["mate"]}}}}}}
    _, user = M.correction_prompt("doc " * 200_000, {"crew": [{"rank": "x", "name": "Ann"}, {"rank": "y", "name": "Bo"}]}, schema, "crew.1.rank")
    assert "item 2 of 2 of the list crew" in user and '"rank": "<FILL_THIS>"' in user and "Bo" in user and "Ann" not in user and "Description: The rank" in user and 'Allowed values: ["mate"]' in user
    assert len(user) < M.MOST_DOCUMENT + 3000
    assert "# Schema" not in M.extraction_prompt("t")[1] and "# Schema" in M.extraction_prompt("t", schema)[1]
    assert "Type: string" in M.targeted_prompt("t", schema, "crew.0.rank")[1] and "The rank" in M.verification_prompt("t", schema, "crew.0.rank", "mate")[1]


def test_native_comparison_equals_the_typed_one(spark):
    some = ["", "x", "X ", "12", " 12\t", "$ 12", "1_000", "1000", "inf", "nan", "12d", "1e3", "-0.5", "9 May 1987", "1987-05-09", "05/09/1987", "Q1 2020", "May 1987", "Sept 3 2011", "2011-09-03", "July 4, 2020 10:00", "true", "True"]
    df = spark.createDataFrame([(a, b) for a in some for b in some], "g string, e string")
    g, e = X.F.col("g"), X.F.col("e")
    for r in df.select("g", "e", *[X.compare(g, e, s).alias(s) for s in values.STRATEGIES]).collect():
        for s in values.STRATEGIES:
            assert r[s] == values.compare(r["g"], r["e"], s), (s, r["g"], r["e"])
    kinds = [("True", "boolean", "true", "string", True), ("True", "boolean", "1", "integer", False), ("7", "integer", "7", "string", True), ("nan", "number", "nan", "number", False), ("Oslo", "string", "oslo", "string", False)]
    typed = spark.createDataFrame(kinds, "g string, a string, e string, b string, same boolean")
    assert all(r[0] == r[1] for r in typed.select(X.same_exact(g, e, X.F.col("a"), X.F.col("b")), "same").collect())
    with pytest.raises(ValueError):
        X.compare(g, e, "telepathy")
    with pytest.raises(Exception, match="unknown strategy"):
        df.select(X.compare(g, e, X.F.lit("telepathy"))).collect()


def test_resume_and_logs(spark, tmp_path):
    todo = spark.createDataFrame([("d", f"p{i}") for i in range(20)], "doc_id string, path_str string")
    seen = []

    def work(rows):
        seen.append(rows.count())
        if len(seen) == 2:
            raise RuntimeError("stopped")
        return rows.withColumn("v", X.F.lit(len(seen)))

    with pytest.raises(RuntimeError):
        tables.resume(todo, str(tmp_path / "c"), work, lots=3)
    assert tables.resume(todo, str(tmp_path / "c"), work, lots=3).count() == 20 and sum(seen) - seen[1] == 20
    for _ in range(2):
        log = tables.log_to(str(tmp_path / "logs"))
    log.info("once")
    assert sum("once" in p.read_text() for p in (tmp_path / "logs").iterdir()) == 1


def test_labels_of_a_stream(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    kind = "doc_id string, extracted string"
    gold = spark.createDataFrame([("a", "{}", '{"x": 1}'), ("b", "{}", '{"x": 2}')], "doc_id string, schema string, gold string")
    for part in ([("a", '{"x": 1}')], [("b", '{"x": 3}'), ("c", "{}")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(src)
        streaming.label_stream(spark.readStream.schema(kind).parquet(src), gold, out, check).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(out).select("doc_id", "error_type").collect())) == [("a", "match"), ("b", "value_mismatch")]


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d", "2024-01-01 00:10:00", 1), ("a", "d", "2024-01-01 00:11:00", 1), ("b", "d", "2024-01-01 00:50:00", 0), ("c", "d", "2024-01-01 01:10:00", 1), ("z", "d", "2024-01-04 00:00:00", 0)], "doc_id string, domain string, arrived string, is_error int")
    rows.withColumn("arrived", X.F.to_timestamp("arrived")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, domain string, arrived timestamp, is_error int").parquet(str(tmp_path / "in"))
    q = streaming.error_rates(streaming.once(stream), late=None).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {str(r["window"]["start"])[11:16]: (r["n_total"], r["n_errors"]) for r in spark.table("rates").collect()}
    assert got == {"00:00": (2, 1), "01:00": (1, 1)}


def test_unmatched_gold_and_schema_keys():
    walker = trees.Labeller()
    schema = {"properties": {"m": {"x-match-mode": "set_membership", "items": {}}}}
    assert [r["error_type"] for r in walker.label(schema, {"m": ["a", "b", " "]}, {"m": ["A", "a"]})] == ["match", "match"] and walker.unmatched == ["m.gold1"]
    assert trees.schema_paths({"properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {}}}}, "c": {}}}) == {"a", "a[].b", "c"}
