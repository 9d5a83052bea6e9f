"""Importance resampling against its SQL and against a plain count of n-grams."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from veritrail.llm import resampling

from .test_llm import DOCS, low, made, wide


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def grams(t, longest):
    w = words(t)
    return [b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=25, buckets=10_000, longest=2, least=20):
    place = lambda g: zlib.crc32(g) % buckets
    s, t = (Counter(place(g) for x in texts for g in grams(x, longest)) for texts in ([r[1] for r in rows], target))
    ss, tt = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for d, text, *_ in rows:
        g = grams(text, longest)
        weight = sum(math.floor(1000 * math.log((t[place(x)] + 1) * ss / ((s[place(x)] + 1) * tt))) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((d, len(g), weight, score, len(words(text))))
    able = sorted((-x[3], x[0] is not None, x[0] or 0) for x in out if x[4] >= least)
    taken = {k: i + 1 for i, k in enumerate(able[: percent * len(able) // 100])}
    return sorted((str(d), n, w, s, taken.get((-s, d is not None, d or 0)) if k >= least else None) for d, n, w, s, k in out)


@pytest.fixture(scope="module")
def rows():
    return [r for i, r in enumerate(made(seed=21, n=120)) if i < 120 or r[0] != 1]  # no id twice


@pytest.mark.parametrize("longest, buckets", [(2, 10_000), (3, 50)])
def test_ranks_equal_a_plain_count(spark, rows, longest, buckets):
    target = [rows[3][1], "Ba ke-li mo nu", None, "", "Überall 7 ba\x00ba"]
    df = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.ranked(wide(spark.createDataFrame(rows, DOCS)), df, buckets=buckets, longest=longest).collect()
    assert sorted((str(r["doc_id"]), r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) == plain(rows, target, buckets=buckets, longest=longest)
    drawn = sorted(r["rank"] for r in got if r["rank"])
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) > 15


def test_draw_prefers_the_target(spark):
    r = random.Random(4)
    text = lambda words: " ".join(r.choice(words) for _ in range(60))
    near, far = "alpha beta gamma delta epsilon".split(), "one two three four five".split()
    docs = spark.createDataFrame([(i, text(near if i % 4 == 0 else far)) for i in range(400)], "doc_id long, text string")
    out = resampling.resample(docs.selectExpr("*", "1 as drawn", "2 as row"), spark.createDataFrame([(text(near),)], "text string"))
    assert out.columns == ["doc_id", "text", "drawn", "row"] and out.count() == 100
    assert out.where("doc_id % 4 = 0").count() > 75  # a quarter of all without weights


def test_against_sql(spark, rows):
    c = duckdb.connect()
    some = [r for r in rows if r[0] is not None]
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    c.executemany("insert into documents values (?, ?, ?, ?, ?)", some)
    c.execute("create table benchmark as select doc_id as item_id, text from documents where doc_id % 9 = 0")
    docs = spark.createDataFrame(some, DOCS)
    got = [tuple(r) for r in resampling.ranked(docs, docs.where("doc_id % 9 = 0")).collect()]
    assert sorted(got, key=str) == sorted(c.execute(resampling.ORACLE).fetchall(), key=str)


def test_edges(spark, monkeypatch):
    none = spark.createDataFrame([], DOCS)
    assert resampling.ranked(none, none).count() == 0 and resampling.resample(none, none).count() == 0
    docs = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0), (3, "x " * 50_000, None, None, 0)], DOCS)
    got = {r["doc_id"]: r for r in resampling.ranked(docs, none).collect()}
    assert got[1]["n_features"] == got[2]["n_features"] == 0 == got[1]["weight"] and got[3]["n_features"] == 99_999
    before = resampling.bucket_counts(docs).tolist()
    monkeypatch.setattr(resampling, "MEMORY", 0)
    monkeypatch.setattr(resampling, "LOT", 10)
    assert resampling.bucket_counts(docs).tolist() == before
