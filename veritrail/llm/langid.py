"""Language ID by cross-parsing: suffix automata of labelled text, longest matches, fewest normalised phrases."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import as_rows, fold, from_rows, lower_table, row_texts, slices

#: Bounds of the labelled sample that the automata are built of: documents and bytes a language, and bytes in all, which
#: languages share where they are many. Every language that has a label is learned.
SAMPLE_DOCS, SAMPLE_BYTES, TOTAL_BYTES = 48, 24_000, 4_000_000
#: Bytes of the tables that a worker holds at once; languages beyond are parsed in groups, one after another.
TABLE_BYTES = 48 << 20
#: Texts are parsed in segments of this many bytes, each from the root; all segments of a text count.
SEGMENT = 1024
#: Bytes parsed in one vectorised step.
CHUNK = 2 << 20
#: Below this share of the evidence the pipeline's language stage rejects a document.
REJECT_BELOW = 0.3


def letters_only() -> np.ndarray:
    """Bytes as they are parsed: ASCII letters in lower case, bytes beyond ASCII as they are, all else a space, so that
    no mark or digit that one sample has by chance speaks for its language."""
    t = lower_table()
    t[:97] = t[123:128] = 32
    t[65:91] = np.arange(97, 123)
    return t


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of text; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur, p = len(go), last
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


class CrossParser:
    """Counts, for many texts at once, the phrases of their greedy parses against each language's sample.

    A phrase is the longest match of the language's sample at its place, or one byte that the sample lacks. Automata are
    kept as lists of transitions, and spread out to tables for a group of languages at a time.
    table[state + class]: the next state's row times two, plus one if a phrase begins there.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        lower = letters_only()
        texts = {k: lower[np.frombuffer(samples[k], np.uint8)].tobytes() for k in self.langs}
        seen = [b for b, _ in Counter(b"".join(texts.values())).most_common()]
        order = np.zeros(256, np.uint8)
        for i, b in enumerate(seen, 1):
            order[b] = min(i, 255)  # letters_only leaves under 200 bytes apart
        self.width = len(seen) + 1
        self.classes = order[lower].astype(np.int32)
        #: Of each language: its number of states; and (from, class, to) of every transition.
        self.states, self.edges = [], []
        for k in self.langs:
            go = suffix_automaton(texts[k])
            self.states.append(len(go))
            self.edges.append(np.array([(s, order[b], to) for s, e in enumerate(go) for b, to in e.items()], np.int32).reshape(-1, 3))
        #: Bits that name a place in the language's sample: what a phrase costs.
        self.cost = np.array([np.log2(max(2, len(texts[k]))) for k in self.langs])
        self.groups, room = [], 0
        for i, n in enumerate(self.states):
            room += 4 * (n + 1) * self.width
            if not self.groups or room > TABLE_BYTES:
                self.groups.append([])
                room = 4 * (n + 1) * self.width
            self.groups[-1].append(i)
        self._held = None

    def __getstate__(self):
        return {**self.__dict__, "_held": None}

    def spread(self, group: int) -> tuple[np.ndarray, np.ndarray]:
        """The table of a group of languages and the rows of their roots."""
        if self._held is None or self._held[0] != group:
            tables, roots, base = [], [], 0
            for i in self.groups[group]:
                n = self.states[i]
                t = np.full((n + 1, self.width), -1, np.int32)  # the last row: after a byte that the sample lacks
                t[self.edges[i][:, 0], self.edges[i][:, 1]] = self.edges[i][:, 2]
                dead, first = t < 0, np.where(t[0] < 0, n, t[0]).astype(np.int32)
                np.copyto(t, first[None, :], where=dead)
                dead[0] = False  # the root stands only before a segment, whose first phrase is counted at its end
                t += base
                t *= self.width * 2
                t += dead
                tables.append(t.ravel())
                roots.append(base * self.width)
                base += len(t)
            self._held = group, np.concatenate(tables), np.array(roots, np.int32)
        return self._held[1:]

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) by each language (columns)."""
        out = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        for g, some in enumerate(self.groups):
            out[:, some] = self.group_phrases(data, offsets, *self.spread(g))
        return out

    def group_phrases(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, roots: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, len(roots)
        out = np.zeros((n, k), np.int64)
        for i, j in slices(offsets, CHUNK):
            size = np.diff(offsets[i : j + 1])
            per = -(-size // SEGMENT)
            owner = np.repeat(np.arange(i, j), per)
            if not len(owner):
                continue
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            begin = offsets[owner] + nth * SEGMENT
            length = np.minimum(SEGMENT, offsets[owner + 1] - begin)
            order = np.argsort(-length, kind="stable")
            owner, begin, length = owner[order], begin[order], length[order]
            lo, hi = offsets[i], offsets[j]
            codes = self.classes[data[lo:hi]]
            steps = int(length[0])
            live = np.searchsorted(-length, -np.arange(steps), "left")
            state = np.repeat((roots * 2)[:, None], len(owner), 1)
            count = np.zeros((k, len(owner)), np.int32)
            at = begin - lo
            for step in range(steps):
                m = live[step]
                now = state[:, :m] >> 1
                now += codes[at[:m] + step]
                got = table.take(now, mode="clip")
                state[:, :m] = got
                got &= 1
                count[:, :m] += got
            for row in range(k):
                out[:, row] += np.bincount(owner, count[row] + 1, n).astype(np.int64)
        return out

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language's index (-1: no letters, or nothing was learned) and its share of the evidence."""
        n = len(offsets) - 1
        letters = has_letter(data, offsets)
        if not self.langs or not n:
            return np.full(n, -1), np.zeros(n)
        size = np.maximum(1, np.diff(offsets))
        bits = self.phrases(data, offsets) * self.cost / size[:, None]
        best = bits.argmin(1)
        evidence = np.exp(-(bits - bits.min(1, keepdims=True)) * np.minimum(16, np.sqrt(size))[:, None])
        score = 1 / evidence.sum(1)
        best[~letters] = -1
        score[~letters] = 0
        return best, score


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter (Unicode's, by str.isalpha)."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    some = np.flatnonzero(np.diff(offsets) > 0)
    found = np.zeros(len(offsets) - 1, bool)
    if len(some):
        found[some] = np.logical_or.reduceat(ascii_letter[data], offsets[some])
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def sample(labelled: DataFrame, docs_a_lang: int = SAMPLE_DOCS, bytes_a_lang: int = SAMPLE_BYTES, total: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Up to docs_a_lang documents of each language, in the order of a hash of their ids, middling ones before longer, cut to
    bytes_a_lang, or to an equal share of `total` where languages are many. No language is left out."""
    each = labelled.where("lang is not null and text is not null and text <> ''")
    keyed = each.select("doc_id", "lang", F.when(F.length("text").between(200, 20_000), 0).otherwise(1).alias("odd"), F.xxhash64("doc_id").alias("h"))
    w = Window.partitionBy("lang").orderBy("odd", "h", "doc_id")
    ids = keyed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= docs_a_lang).select("doc_id", "lang", "r").collect()
    if not ids:
        return {}
    found = Counter(r["lang"] for r in ids)
    most = min(bytes_a_lang, max(64, total // len(found)))
    rows = [(r["doc_id"], r["lang"], r["r"], min(20_000, 4 * most // found[r["lang"]])) for r in ids]
    wanted = labelled.sparkSession.createDataFrame(rows, keyed.select("doc_id", "lang").schema.add("r", "integer").add("most", "integer"))
    same = each["doc_id"].eqNullSafe(F.col("w.doc_id")) & (each["lang"] == F.col("w.lang"))
    rows = each.join(F.broadcast(wanted.alias("w")), same).select(each["lang"], "r", F.substring("text", F.lit(1), F.col("most")).alias("text")).collect()
    by: dict[str, dict] = {}
    for r in sorted(rows, key=lambda x: (x["r"], x["text"])):
        by.setdefault(r["lang"], {}).setdefault(r["r"], r["text"].encode())
    return {k: interleave(list(v.values()), most) for k, v in by.items()}


def interleave(texts: list[bytes], most: int) -> bytes:
    """An equal share of each text, up to most bytes in all."""
    share = max(1, most // max(1, len(texts)))
    out = b"\n".join(t[:share] for t in texts)
    for t in texts:
        if len(out) >= most:
            break
        out += b"\n" + t[share : share + most - len(out)]
    return out[:most]


def judged_rows(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """(row, lang_pred, score): docs' columns as one struct, so that no name of theirs meets ours."""
    held = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by TOTAL_BYTES of sample

    def judge(batches):
        p = held.value
        names = pa.array([*p.langs, "und"])
        for b in batches:
            best, score = p.judge(*row_texts(b))
            yield pa.RecordBatch.from_arrays([b.column("row"), names.take(pa.array(best % (len(p.langs) + 1))), pa.array(score)], ["row", "lang_pred", "score"])

    rows = as_rows(docs)
    return rows.mapInArrow(judge, rows.select("row").schema.add("lang_pred", "string").add("score", "double"))


def predict_languages(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """docs with lang_pred and score. One pass over the texts; no shuffle.

    Null texts and texts without a letter are 'und' with score 0; so is all if nothing was learned. Equal counts
    go to the first language in order. Whole texts count, however long. Repeated rows are judged alike. Columns
    named lang_pred or score, in any case, are replaced; judged_rows keeps them. An empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return from_rows(judged_rows(docs, parser), keep, "lang_pred", "score")


def learn(docs: DataFrame) -> CrossParser:
    return CrossParser(sample(docs))


def op3_langid(spark, sf_dir: str) -> DataFrame:
    """Every document's language; learned from those whose crc32 mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    parser = learn(docs.where(fold("doc_id", 4) != 2))
    out = predict_languages(docs.select("doc_id", "text"), parser)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
