"""Operators against plain versions where SQL can't express them, and what must hold after crashes, at extremes and for odd names."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from veritrail.llm import common, langid, lines, mixing, packing, quality, rollups, simhash, tokens, topk, toxicity
from veritrail.llm.common import fold

from .test_llm import DOCS, low, made, plain_phrases, plain_print


def test_a_crash_at_any_step_of_a_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    def change(n):
        return spark.createDataFrame([("s", "en", "v", 1, n)], "source string, lang string, tokenizer_version string, d_docs long, d_tokens long")

    for step in range(4):
        roll = rollups.Rollup(spark, str(tmp_path / str(step)))
        for i in range(3):
            assert roll.commit(f"b{i}", change(10**i))
        if step > 1:
            roll.compact()
            assert roll.commit("b3", change(1000))
        want = [("s", "en", "v", 4, 1111) if step > 1 else ("s", "en", "v", 3, 111)]
        names = {f"b{i}" for i in range(4 if step > 1 else 3)}
        with monkeypatch.context() as m:
            if step % 2:  # before the fold is in place; after it, with one folder gone
                m.setattr(rollups.Rollup, "_into_place", lambda *a: (_ for _ in ()).throw(OSError))
            else:
                drop = lambda s, *paths: (common.drop_paths(s, *paths[:1]), (_ for _ in ()).throw(OSError))
                m.setattr(rollups, "drop_paths", drop)
            with pytest.raises(OSError):
                roll.compact()
        for _ in range(2):
            fresh = rollups.Rollup(spark, str(tmp_path / str(step)))
            assert [tuple(r) for r in fresh.totals().collect()] == want and fresh.batches() == names
            assert not any(fresh.commit(b, change(5)) for b in names)
            fresh.compact()
        assert len(list((tmp_path / str(step) / "batches").iterdir())) == 1


def test_rollup_query_against_a_plain_count(spark, tmp_path):
    rows = [(i, t, lang, s, n) for i, (_, t, lang, s, n) in enumerate(made())]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 3)] + [(3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path())
    gone, want = {i for i in range(0, 40, 3) if i % 2 == 0} | {3}, defaultdict(lambda: [0, 0])
    for i, t, lang, s, _ in rows:
        if i not in gone:
            want[s, lang][0] += 1
            want[s, lang][1] += len(plain.encode(t or "", add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in rollups.op9_rollup(spark, str(tmp_path)).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("rate", [0.1, 599.0, 700.0, 800.0, 20_000.0])
def test_poisson_at_any_rate(spark, rate):
    n = 4000
    got = spark.range(n).select(mixing.poisson(mixing.unit(F.lit("t"), F.col("id")), F.lit(rate)).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(got[0] - rate) < 5 * math.sqrt(rate / n) and abs(got[1] / rate - 1) < 5 * math.sqrt((2 + 1 / rate) / n)


def test_tasks_of_crowded_families_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lines, "CROWD", 4)
    sizes = []
    plain = lines.verified

    def watched(rows, *rest):
        sizes.append(rows.groupBy("bhi", "blo", "chunk", "part").count().agg(F.max("count")).first()[0])
        return plain(rows, *rest)

    monkeypatch.setattr(lines, "verified", watched)
    df = spark.createDataFrame([(i, f"the same template of a line that is fairly long, but for number {i:03d}") for i in range(60)], "doc_id long, text string")
    assert lines.duplicate_lines(df).select("component").distinct().count() == 1
    assert len(sizes) == 1 and sizes[0] <= 14  # chunks by hash, four lines each on average, with the pivot


def test_common_lines_meet_their_class_by_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(1 if i < 50 else i, i) for i in range(90)], "k long, x long")
    classes, _ = common.write_out(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("m")), "classes")
    want = sorted((k, x, 49 if k == 1 else x) for k, x in (r[:2] for r in rows.collect()))
    for least in (10, 1000):
        assert sorted((r["k"], r["x"], r["m"]) for r in common.join_hot(rows, classes, ["k"], "n", least).collect()) == want
    for most in (1000, 1):
        assert sorted((r["k"], r["x"], r["m"]) for r in common.join_few(rows, classes, "k", most).collect()) == want


def test_pipeline_keeps_columns_whatever_their_names(spark):
    docs = spark.createDataFrame(made(), DOCS)
    for name in ("Score", "lang_pred", "a.b", "row", "fp", "_salt", "copy", "gone", "node"):
        odd = docs.withColumn(name, F.lit(0.123))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, odd, "")
            assert out.columns == odd.columns and {r[0] for r in out.select(f"`{name}`").collect()} == {0.123}
    for name in ("Score", "a.b", "predicted"):
        df = docs.withColumn(name, F.lit(1))
        langid.predict_languages(df, langid.learn(docs)).collect()
        toxicity.score_toxicity(df, toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))).collect()


def test_special_spellings_as_the_tokenizer_reads_them():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path())
    texts = ["a<|endoftext|>", "<|ENDOFTEXT|> b", "x <|startoftext|><|endoftext|>y", "<|endoftext", "plain Words, here. <|endoftext|> It's"]
    raw = [t.encode() for t in texts]
    got = tokens.WordEncoder(tokens.vocabulary_path()).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_have_the_ids_of_a_plain_count(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path())
    rows = [(i, t) for i, (_, t, *_) in enumerate(made()) if i] + [(500, "a<|endoftext|>b " * 200)]
    want = []
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, n * 256, len(ids[n * 256 : n * 256 + 256]), zlib.crc32(ids[n * 256 : n * 256 + 256].tobytes())) for n in range(-(-len(ids) // 256))]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=256).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)


def test_every_language_is_learned(spark, monkeypatch):
    r = random.Random(2)
    letters = [chr(c) for c in range(0x430, 0x450)] + list("abcdefghijklmnopqrstuvwxyz")
    words = {f"l{k:02d}": ["".join(r.choice(letters) for _ in range(5)) for _ in range(30)] for k in range(70)}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(60)), k) for i, k in enumerate(sorted(words) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "TABLE_BYTES", 1 << 20)
    parser = langid.learn(docs.where("doc_id < 140"))
    assert len(parser.langs) == 70 and len(parser.groups) > 5
    out = langid.predict_languages(docs.where("doc_id >= 140"), parser).collect()
    assert all(x["lang"] == x["lang_pred"] for x in out)
    few = langid.sample(docs, total=7000)
    assert len(few) == 70 and max(map(len, few.values())) <= 100


def test_language_and_score_against_a_plain_parse(spark):
    docs = spark.createDataFrame(made(), DOCS)
    samples = langid.sample(docs)
    parser = langid.CrossParser(samples)
    flat, names = langid.letters_only(), sorted(samples)
    plain = {k: flat[np.frombuffer(samples[k], np.uint8)].tobytes() for k in names}
    for r in langid.predict_languages(docs.where("length(text) < 5000 or text is null"), parser).collect():
        text = (r["text"] or "").encode()
        if not any(map(str.isalpha, text.decode())):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        parsed = flat[np.frombuffer(text, np.uint8)].tobytes()
        bits = [plain_phrases(plain[k], parsed) * math.log2(len(plain[k])) / len(text) for k in names]
        assert r["lang_pred"] == names[int(np.argmin(bits))]
        assert r["score"] == pytest.approx(1 / sum(math.exp(-(b - min(bits)) * min(16, math.sqrt(len(text)))) for b in bits))


def test_vectors_of_mixed_lengths_and_repeats_against_sql(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(r.choice([3, 4, 4, 0]))]) for i in range(0, 700, 20)]
    rows += [rows[0], rows[5], rows[7], (100, [0.5, 0.25, -1.0]), (300, None), (301, [None, 1.0, 1.0]), (302, [float("inf")] * 3), (None, [1.0] * 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(tuple(x) for x in topk.op8_topk(spark, str(tmp_path)).collect()) == sorted(c.execute(topk.ORACLE).fetchall())


def test_rings_are_left_closed_where_vectors_cluster():
    r = np.random.default_rng(3)
    centres = r.normal(size=(32, 16)) * 1000
    v = np.floor(np.repeat(centres, 40, 0) + r.normal(size=(1280, 16)) * 20)
    index = topk.Index(centres, float((v**2).sum(1).max()))
    far = index.distances(v, True)
    p = far.argmin(1)
    ring = np.minimum(topk.RINGS - 1, (far[np.arange(len(p)), p] / index.width).astype(int))
    sizes = Counter(zip(p.tolist(), ring.tolist()))
    index.rings = {k: (n, 1) for k, n in sorted(sizes.items())}
    q = v[::40]
    kth = np.sort(q @ v.T, 1)[:, -11]
    opened = ((q**2).sum(1)[:, None] + index.top2 - index.bounds(q) ** 2) / 2 >= kth[:, None]
    held = np.array([n for n, _ in index.rings.values()])
    assert (opened * held).sum() < 0.5 * len(q) * len(v)
    scores = q @ v.T
    places = [list(index.rings).index(k) for k in zip(p.tolist(), ring.tolist())]
    assert not (scores >= kth[:, None])[~opened[:, places]].any()  # no ring left closed holds an answer


def test_neighbours_of_crowded_groups(monkeypatch):
    r = random.Random(6)
    base = r.getrandbits(64)
    fp = np.array(sorted({base ^ r.getrandbits(9) for _ in range(300)} | {base ^ (1 << 40)}), np.uint64)
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 3}
    for probed in (10, 10**6):
        monkeypatch.setattr(simhash, "PROBED", probed)
        got = [{(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} for a, b in simhash.near_pairs(fp, np.zeros(len(fp)), 3, simhash.references())]
        assert set().union(*got) == want


def test_one_row_of_an_id_stays(spark):
    rows = [(1, "one text of some words", "a"), (1, "another text of other words", "b"), (2, "one text of some words", "c"), (None, "x y z", "d"), (None, "x y z", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    first = sorted(map(str, simhash.keep_first(df).select("doc_id", "text").collect()))
    assert len(first) == 2 and first == sorted(map(str, simhash.keep_first(df.orderBy(F.desc("tag"))).select("doc_id", "text").collect()))


def plain_mcd(x, share, steps):
    """Concentration steps by numpy, with the same bins for the cut and the same floors."""
    p, floor = x.shape[1], np.array(list(quality.STATS.values()))
    factor = share / quality.chi2_cdf(quality.chi2_quantile(share, p), p + 2)
    rank = math.ceil(0.5 * len(x)) - 1
    mean = np.sort(x, 0)[rank]
    inv = np.diag(1 / ((np.sort(abs(x - mean), 0)[rank] * 1.4826) ** 2 + floor**2))
    for _ in range(steps):
        d = x - mean
        bins = np.floor(np.log(np.einsum("ij,jk,ik->i", d, inv, d) + 1e-9) * quality.BINS)
        below = {b: int((bins < b).sum()) for b in set(bins)}
        near = x[[below[b] < len(x) * share for b in bins]]
        before, mean = mean, near.mean(0)
        cov = (near.T @ near / len(near) - np.outer(mean, mean)) * factor
        cov[np.diag_indices(p)] = np.maximum(cov.diagonal(), 0) + floor**2
        inv = np.linalg.inv(cov)
        if (abs(mean - before) <= quality.SETTLED * floor).all():
            break
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, inv, d)


def test_quality_verdict_against_numpy(spark):
    rows = [(i, t, lang, s, n) for i, (_, t, lang, s, n) in enumerate(made(n=500))] + [(2000 + i, "# * " * 40 + " ".join(f"w{i}x{j}" for j in range(60)), "en", "a", 1) for i in range(5)]
    got = quality.judge_quality(spark.createDataFrame(rows, DOCS), least=30).collect()
    by = defaultdict(list)
    for r in got:
        if r["grp"] is not None and not r["base_failed"]:
            by[r["grp"]].append(r)
    limit = quality.chi2_quantile(1 - quality.TAIL, len(quality.STATS))
    stats = {d: quality.statistics((t or "").encode()) for d, t, *_ in rows}
    assert len(by) >= 3
    for some in by.values():
        want = plain_mcd(np.array([stats[r["doc_id"]][5:] for r in some]), quality.SHARE, quality.STEPS)
        assert [r["distance2"] for r in some] == pytest.approx(want.tolist(), rel=1e-6)
        assert [r["kept"] for r in some] == (want <= limit).tolist()


def plain_logit(model, text):
    """The network one word and one filter at a time, from embeddings and filters."""
    raw = text.encode()
    _, words, prefix = toxicity.word_ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    x = [model.words[w] + model.prefixes[p] + model.prefixes[q] for w, p, q in zip(words, *prefix)]
    h = []
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            at = [sum(float(x[i + o] @ model.filters[k][o][:, f]) for o in range(w) if i + o < len(x)) for i in range(len(x))]
            h.append(max(0.0, (max(at) if at else 0.0) + float(model.bias[len(h)])))
    return float(np.dot(h, model.out)) + model.shift


def test_the_network_one_word_at_a_time():
    model = toxicity.Classifier(["en", "*"])
    model.shift = 0.25
    model.bias += np.linspace(-0.1, 0.1, len(model.bias)).astype(np.float32)
    model.compile()
    texts = ["one two three four", "", "x", "Déjà vu, all over AGAIN! and again and again", "a b"]
    raw = [t.encode() for t in texts]
    z, _ = model.logits(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    assert z.tolist() == pytest.approx([plain_logit(model, t) for t in texts], abs=1e-5)


def test_training_follows_the_gradient(monkeypatch):
    """A first Adagrad step moves a parameter by rate * g / sqrt(1e-3 + g ** 2): so g shows, to be held against differences."""
    rate, texts, y, weight = 1e-3, ["ab cd ef gh", "xy zz ab", "q w"], np.array([1, 0, 1], np.float32), np.array([1, 2, 1], np.float32)
    ids = [toxicity.word_ids(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1:] for t in texts]
    loss = lambda m: sum(w * (math.log1p(math.exp(z)) - v * z) for z, v, w in zip((plain_logit(m, t) for t in texts), y.tolist(), weight.tolist())) / 3
    before, after = toxicity.Classifier([]), toxicity.Classifier([])
    after.train(ids, y, weight, epochs=1, rate=rate)
    seen = 0
    places = [("out", (i,)) for i in range(0, 24, 5)] + [("bias", (i,)) for i in range(0, 24, 5)] + [("words", (int(ids[0][0][i]), j)) for i in range(4) for j in (0, 5)] + [("filters", (k, o, 3, f)) for k, w in enumerate(toxicity.WIDTHS) for o in range(w) for f in (0, 6)]
    for name, at in places:
        a, b = (getattr(m, name) if name != "filters" else getattr(m, name)[at[0]] for m in (before, after))
        at = at[1:] if name == "filters" else at
        move = float(a[at]) - float(b[at])
        g = math.copysign(math.sqrt(1e-3 * (move / rate) ** 2 / max(1e-9, 1 - (move / rate) ** 2)), move)
        own, eps = float(a[at]), 1e-3
        a[at] = own + eps
        up = loss(before)
        a[at] = own - eps
        slope = (up - loss(before)) / (2 * eps)
        a[at] = own
        assert g == pytest.approx(slope, abs=2e-3 + 0.02 * abs(slope)), (name, at)
        seen += abs(slope) > 1e-3
    assert seen > 10


def test_thresholds_of_any_number_of_languages(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefgh") * 3 + f"q{i % 30}" for _ in range(15)) + (" vexlum" if i % 4 == 0 else ""), f"l{i % 30}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int"))
    assert model.langs[-1] == toxicity.REST
    got = toxicity.score_toxicity(docs, model).collect()
    assert sum(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in got) > 1480


def plain_stages(rows):
    """Languages, lines and near copies one after another, by plain loops."""
    # language: the stage's own rule on the operator's verdict, which test_language_and_score_against_a_plain_parse covers
    names, sets, where = [], [], defaultdict(list)
    for d, t, *_ in rows:
        for n, x in enumerate((t or "").split("\n")):
            b = b" ".join(low(x).split()).decode()
            if b:
                where[b].append((d, n))
    names = list(where)
    sets = [lines.shingles(x) if len(x) >= 8 else {x, "short"} for x in names]
    parent = list(range(len(names)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if len(names[i]) >= 8 and len(names[j]) >= 8 and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    first = {}
    for i, x in enumerate(names):
        first[find(i)] = min([first.get(find(i), (10**9, 0)), *where[x]])
    gone = {at for i, x in enumerate(names) for at in where[x] if at != first[find(i)]}
    kept = []
    for d, t, *rest in rows:
        left = [x for n, x in enumerate((t or "").split("\n")) if (d, n) not in gone]
        if not t or len(left) == len(t.split("\n")):
            kept.append((d, t))
        elif any(x.strip(" \t\n\x0b\x0c\r") for x in left):
            kept.append((d, "\n".join(left)))
    prints = [plain_print(t) for _, t in kept]
    parent = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(kept):
        least[find(i)] = min(d, least.get(find(i), d))
    return kept, sorted((d, t) for i, (d, t) in enumerate(kept) if least[find(i)] == d)


def test_stages_against_plain_loops(spark):
    rows = [(i, t, lang, s, n) for i, (_, t, lang, s, n) in enumerate(made(seed=3, n=50)) if len(t or "") < 20_000]
    docs = spark.createDataFrame(rows, DOCS)
    after_lines, after_near = plain_stages(rows)
    got = corpus_pipeline.line_dedup(spark, docs, "")
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == sorted((d, t or "") for d, t in after_lines)
    near = corpus_pipeline.near_dedup(spark, got, "").select("doc_id", "text", "source").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in near) == [(d, t or "") for d, t in after_near]
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(near, "doc_id long, text string, source string"), "")
    sizes = Counter()
    for r in near:
        sizes[r["source"]] += len(r["text"] or "")
    weights = {s: n**0.7 for s, n in sizes.items() if n}
    rate = {s: round(w / sum(weights.values()) * sum(sizes.values()) / sizes[s], 9) for s, w in weights.items()}
    want = Counter()
    for r in near:
        import hashlib

        u, k, p = int(hashlib.md5(f"7-count|{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13, 0, math.exp(-rate.get(r["source"], 0))
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate.get(r["source"], 0) / k
            cdf += p
        if k:
            want[r["doc_id"]] = k
    assert Counter(r["doc_id"] for r in mixed.collect()) == want


def test_registered_pipeline_writes_no_table_that_stays(spark, tmp_path):
    spark.createDataFrame(made(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    from pathlib import Path

    home = Path(common.work_path(spark, "x")).parent
    before = {p.name for p in home.iterdir()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert {p.name.rsplit("-", 1)[0] for p in home.iterdir() if p.name not in before} <= {"stage-mixing", "pieces"}


def test_short_lines_that_are_equal_are_one_component(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Home\n\nShare\na line of its own"), (2, "HOME \n \nReply"), (3, "home\n\u00e9\u00e9\u00e9\u00e9"), (4, "\u00e9\u00e9\u00e9\u00e9\nx"), (5, "share"), (6, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line_no"]): (r["first_doc"], r["first_line"], r["kept"]) for r in lines.op10_lines(spark, str(tmp_path)).collect()}
    own = {k: (*k, True) for k in [(1, 0), (1, 2), (1, 3), (2, 2), (3, 1), (4, 1)]}
    assert got == own | {(2, 0): (1, 0, False), (3, 0): (1, 0, False), (4, 0): (3, 1, False), (5, 0): (1, 2, False)}
    rest = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert rest == {1: "Home\n\nShare\na line of its own", 2: " \nReply", 3: "\u00e9\u00e9\u00e9\u00e9", 4: "x", 6: None}


def test_line_dedup_loses_no_line_of_another_text(spark):
    """Rows that share an id, or have none, are rows of their own; only lines that stand elsewhere go."""
    rows = [(1, "a common line of words"), (None, "a unique line without id"), (None, "a common line of words"), (7, "only here stands this sentence"), (7, "a common line of words"), (7, "a common line of words")]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], DOCS)
    got = sorted((str(r["doc_id"]), r["text"]) for r in lines.dedup_lines(docs).collect())
    assert got == [("7", "only here stands this sentence"), ("None", "a common line of words"), ("None", "a unique line without id")]
    first = docs.where("doc_id is not null")
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, first, "").collect()) == [(1, "a common line of words"), (7, "only here stands this sentence")]
    two = spark.createDataFrame([(3, "the same line here\nand another one"), (3, "the same line here\nor something else")], "doc_id long, text string")
    kept = lines.dedup_lines(two).collect()
    assert sorted(x for r in kept for x in r["text"].split("\n")) == ["and another one", "or something else", "the same line here"]


def test_language_and_packing_stages(spark):
    """The stage drops what the operator calls und or unsure, and nothing else; the last packs every token of every row."""
    from tokenizers import Tokenizer

    rows = [(i, *r[1:]) for i, r in enumerate(made(seed=4, n=80))]
    docs = spark.createDataFrame(rows, DOCS)
    kept = sorted(map(tuple, corpus_pipeline.language(spark, docs, "").collect()), key=str)
    judged = {r["doc_id"]: r for r in langid.predict_languages(docs, langid.learn(docs.where(fold("doc_id", 4) != 2))).collect()}
    assert kept == sorted((r for r in rows if judged[r[0]]["lang_pred"] != "und" and judged[r[0]]["score"] >= langid.REJECT_BELOW), key=str) and 0 < len(kept) < len(rows)
    plain, got = Tokenizer.from_file(tokens.vocabulary_path()), defaultdict(list)
    bins = defaultdict(list)
    for r in corpus_pipeline.pack(spark, docs, "").collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, *_ in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert sorted(got[i]) == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    for spans in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)]).tolist()]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 2048


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """Long and short ones, by one task and by several: words that few rows have, wherever they lie, are all known afterwards."""
    monkeypatch.setattr(toxicity, "SHARD", 300)
    r = random.Random(6)
    few = [f"vex{chr(97 + i)}lum" for i in range(20)]
    rows = [(i, " ".join(r.choice("abcdefgh") * 3 + f"q{i % 30}" for _ in range(4500 if i % 40 == 0 else 15)) + (f" {few[i // 4 % 20]}" if i % 4 == 0 else ""), "en") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    kept = toxicity.labelled(docs, labels)
    assert kept.count() == 1600 and kept.agg(F.max(F.length("ids"))).first()[0] == 6 * 4501
    seen = []
    monkeypatch.setattr(toxicity, "trained", lambda model, rows, balance, shards, f=toxicity.trained: seen.append((rows.count(), shards)) or f(model, rows, balance, shards))
    model = toxicity.fit(docs, labels)
    assert seen[0][0] > 1100 and seen[0][1] > 1
    new = spark.createDataFrame([(k, "aaaq1 bbbq2 " + (few[k] if k < 20 else "cccq3")) for k in range(40)], "doc_id long, text string")
    assert sum(x["predicted"] == int(x["doc_id"] < 20) for x in toxicity.score_toxicity(new, model).collect()) >= 38


def test_thresholds_over_ranges_against_a_plain_search(spark):
    r = random.Random(2)
    rows = [(i % 2, round(r.gauss(i % 3, 1), 1), int(i % 3 == 0)) for i in range(400)]
    got = toxicity.thresholds(spark.createDataFrame(rows, "guess int, z double, toxic int"))
    for g in (-1, 0, 1):
        mine = [x for x in rows if g in (-1, x[0])]
        zs, positives = sorted({z for _, z, _ in mine}, reverse=True), sum(y for *_, y in mine)
        f1 = [2 * sum(y for _, z, y in mine if z >= c) / (sum(z >= c for _, z, _ in mine) + positives) for c in zs]
        gaps = [(c - d, c, (c + d) / 2) for c, d, f in zip(zs, [*zs[1:], zs[-1] - 1], f1) if f >= max(f1) - 1e-9]
        assert got[g][1] == positives and got[g][0] == pytest.approx(max(gaps)[2])
