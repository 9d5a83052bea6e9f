"""SuperMinHash near-duplicates against plain signatures and a plain comparison of all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from veritrail.llm import lines, superminhash
from veritrail.llm.superminhash import Shingles, signatures, similarity

from .test_llm import DOCS, low, made, wide


def plain_signature(members, registers):
    """One member after another, each walking to the end of its own order."""
    out = [2**64 - 1] * registers
    for h in members:
        order = list(range(registers))
        for step in range(registers):
            u = int(lines.mix(np.array([h], np.uint64) + superminhash.times(step + 1))[0])
            k = step + ((u >> 32) * (registers - step) >> 32)
            order[step], order[k] = order[k], order[step]
            out[order[step]] = min(out[order[step]], step << 32 | u & 0xFFFFFFFF)
    return out


def test_early_stopping_changes_no_register():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 7, 40, 300, 3000)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = signatures(np.concatenate(sets), at, 16)
    assert got.tolist() == [plain_signature(s.tolist(), 16) for s in sets]
    assert signatures(np.zeros(0, np.uint64), np.zeros(1, np.int64)).shape == (0, 96)


def test_estimates_vary_less_than_independent_ranks():
    r, miss = np.random.default_rng(2), []
    for _ in range(300):
        common, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (20, 10, 10))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        s = signatures(np.concatenate([x, y]), np.array([0, 30, 60]))
        miss.append(similarity(s[0], s[1]) - 0.5)
    assert abs(np.mean(miss)) < 0.02 and np.mean(np.square(miss)) < 0.75 * 0.25 / 96


def plain(rows, percent=85):
    sets = []
    for _, t, *_ in rows:
        w = low(t).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i))), d == least.get(find(i))) for i, ((d, *_), s) in enumerate(zip(rows, sets)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = made(seed=8, n=40)
    for i in range(60):  # copies with a few words changed, near the limit and past it
        w = (out[r.randrange(30)][1] or "").split() * 3
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"w{r.randrange(9)}"
        out.append((5000 + i, " ".join(w), "en", "a", 1))
    return [*out, (6000, "Four words stand here", "en", "a", 1), (6001, "four  WORDS\nstand here", "en", "a", 1), (6002, None, None, None, None)]


@pytest.mark.parametrize("crowd", [4096, 3])
def test_near_duplicates_equal_a_comparison_of_all_pairs(spark, rows, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    got = superminhash.near_duplicates(wide(spark.createDataFrame(rows, DOCS))).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == plain(rows)
    assert len({r["component_id"] for r in got}) < len(rows) - 20


def test_edges(spark):
    assert superminhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, None, None, None, 0), (None, "a b c d e f", None, None, 0), (3, "", None, None, 0), (4, None, None, None, 0)]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == [("3", 0, "3", True), ("4", 0, "4", True), ("None", 0, "None", True), ("None", 2, "None", True)]


def test_memory_of_words_is_bounded(monkeypatch):
    texts = [b"a b c d e f g", b"h i j k l m n a b", b"a b c d e f g"]
    one = [Shingles().of(t).tolist() for t in texts]
    monkeypatch.setattr(superminhash, "MEMORY", 3)
    memory = Shingles()
    assert [memory.of(t).tolist() for t in texts] == one and len(memory) <= 9
