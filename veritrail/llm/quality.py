"""Quality rules: fixed base limits, then robust multivariate outliers by minimum covariance determinant.

Statistics of every text are transformed towards symmetric shapes. For each (language, source) the centre and
scatter of the tightest share of its documents are found by concentration steps over all rows: distances, the
share's quantile by exact counts, moments of the rows within. Documents far by Mahalanobis distance go.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import SPACES, drop_paths, join_few, text_parts, write_out

#: Fixed values of the base rules.
SYMBOLS, MIN_WORDS, MAX_REPEAT_PERCENT = b"#*$%&|<>", 50, 50
#: Share of a group that the estimate rests on, and rows below which groups are pooled. Concentration steps end when no centre
#: moves by more than SETTLED of its floor; that they haven't after STEPS is an error.
SHARE, STEPS, LEAST, SETTLED = 0.75, 100, 200, 0.01
#: Chance that a Gaussian document lies beyond the cutoff.
TAIL = 1e-6
#: Least standard deviation of each statistic, in its transformed scale: what can't matter for quality.
STATS = {"x_length": 0.3, "x_symbols": 0.08, "x_lines": 0.13, "x_repeats": 0.13, "x_upper": 0.06, "x_marks": 0.06, "x_distinct": 0.08}
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *STATS)
#: Bins of ln(distance) a unit, for exact quantiles by counting.
BINS = 64


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first one's included."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    first: dict = {}
    ids = np.array([first.setdefault(g, len(first)) for g in grams])
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(len(words), bool)
    covered[twice] = covered[twice + 1] = covered[twice + 2] = True
    return int(covered.sum())


def statistics(text: bytes) -> tuple:
    words = text.split()
    n = len(words)
    flat = b"".join(words)
    points = np.frombuffer(flat, np.uint8)
    chars = int((points & 0xC0 != 0x80).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeats = repeat_words(words)
    some, letters = max(1, n), max(1, chars)
    upper = int(((points >= 65) & (points <= 90)).sum())
    marks = int(((points >= 33) & (points <= 64) | (points >= 91) & (points <= 96) | (points >= 123) & (points <= 126)).sum())
    distinct = len(set(words))
    shape = (chars / some, math.sqrt(symbols / some), math.sqrt(dup / max(1, lines)), math.sqrt(repeats / some), math.sqrt(upper / letters), math.sqrt(marks / letters), math.log(1 + distinct) / math.log(1 + some) if n else 1.0)
    return n, chars, symbols, dup, repeats, *shape


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of every whole text (null: no words). One pass, no shuffle."""
    some = docs.select("doc_id", "lang", "source", "text")

    def measure(batches):
        for b in batches:
            data, at = text_parts(b.column("text"))
            flat = data.tobytes()
            rows = [statistics(flat[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            cols = list(zip(*rows)) if rows else [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "lang", "source")], *[pa.array(c, pa.int64() if k < 5 else pa.float64()) for k, c in enumerate(cols)]], ["doc_id", "lang", "source", *FIELDS])

    schema = some.drop("text").schema
    for k, f in enumerate(FIELDS):
        schema = schema.add(f, "long" if k < 5 else "double")
    return some.mapInArrow(measure, schema)


def chi2_cdf(x: float, p: int) -> float:
    """By the series of the regularised lower incomplete gamma function."""
    a, z = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a))) if z > 0 else 0.0


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


def grouped(stats: DataFrame, least: int) -> DataFrame:
    """stats with grp: (lang, source) if it has `least` rows that pass the base rules, else the language's small
    sources together, else all that is left together, else null. Null languages and sources are values of their own."""
    sized = stats.where("not base_failed").groupBy("lang", "source").count()
    by_lang = Window.partitionBy("lang", F.col("count") < least)
    small = sized.withColumn("pool", F.sum("count").over(by_lang))
    name = F.when(F.col("count") >= least, F.to_json(F.struct("lang", "source"))).when(F.col("pool") >= least, F.to_json(F.struct("lang", F.lit("*").alias("pooled")))).otherwise("*")
    small, _ = write_out(small.select("lang", "source", "count", name.alias("grp")), "groups")
    rest = small.where("grp = '*'").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    small = small.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "grp")
    few = F.broadcast(small) if small.count() <= 10_000 else small  # else adaptive execution splits a hot pair
    out = stats.join(few, stats["lang"].eqNullSafe(small["_l"]) & stats["source"].eqNullSafe(small["_s"]), "left").drop("_l", "_s")
    return out if rest >= 5 * len(STATS) else out.withColumn("grp", F.when(F.col("grp") != "*", F.col("grp")))


def distance(names: list[str]):
    """Squared Mahalanobis distance from the joined columns mean and inv."""
    p = len(names)
    dev = [F.col(c) - F.col("mean")[i] for i, c in enumerate(names)]
    return sum(F.col("inv")[i * p + j] * dev[i] * dev[j] * (1 if i == j else 2) for i in range(p) for j in range(i, p))


def fitted(moments: DataFrame, names: list[str], factor: float) -> DataFrame:
    """(grp, mean, inv) of moments (grp, n, s, ss). Variances below the floors of STATS are raised to them."""
    p = len(names)
    floor = np.array([STATS[c] for c in names]) ** 2

    def fit(batches):
        for b in batches:
            t = b.to_pylist()
            mean, inv = [], []
            for r in t:
                m = np.array(r["s"]) / r["n"]
                cov = np.zeros((p, p))
                cov[np.triu_indices(p)] = np.array(r["ss"]) / r["n"]
                cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(m, m)
                cov = cov * factor
                cov[np.diag_indices(p)] = np.maximum(cov.diagonal(), 0) + floor
                mean.append(m.tolist())
                inv.append(np.linalg.inv(cov).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column("grp"), pa.array(mean, pa.list_(pa.float64())), pa.array(inv, pa.list_(pa.float64()))], ["grp", "mean", "inv"])

    return moments.mapInArrow(fit, "grp string, mean array<double>, inv array<double>")


def robust_estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(grp, mean, inv) by concentration steps from the medians and absolute deviations of each group's rows, one start a
    group: a start that half of the rows can't move. A step never raises the determinant but for the floors, so centres
    settle; where one hasn't after `steps`, RuntimeError is raised. Centres are one row a group, and meet rows by
    broadcast where few by count, else by salted keys."""
    names, spark = list(STATS), rows.sparkSession
    p = len(names)
    mid, first = write_out(rows.groupBy("grp").agg(F.array(*[F.percentile_approx(c, 0.5, 1000) for c in names]).alias("mean")), "medians")
    off = join_few(rows, mid, "grp").groupBy("grp").agg(F.array(*[F.percentile_approx(F.abs(F.col(c) - F.col("mean")[i]), 0.5, 1000) for i, c in enumerate(names)]).alias("mad"))
    unit = lambda i, j, c: F.lit(0.0) if i != j else 1 / (F.pow(F.col("mad")[i] * 1.4826, 2) + STATS[c] ** 2)
    start = mid.join(off, "grp").select("grp", "mean", F.array(*[unit(i, j, c) for i, c in enumerate(names) for j in range(p)]).alias("inv"))
    now, path = write_out(start, "centres")
    drop_paths(spark, first)
    factor = share / chi2_cdf(chi2_quantile(share, p), p + 2)
    floors = F.array(*[F.lit(SETTLED * STATS[c]) for c in names])
    for _ in range(steps):
        binned = join_few(rows, now, "grp").withColumn("bin", F.floor(F.log(distance(names) + 1e-9) * BINS)).drop("mean", "inv")
        w = Window.partitionBy("grp").orderBy("bin")
        # moments of each bin, so that one pass over the rows gives counts, the cut, and what lies within it
        sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]]
        bins = binned.groupBy("grp", "bin").agg(*sums)
        near = bins.withColumn("below", F.sum("n").over(w) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("grp"))).where(F.col("below") < F.col("all") * share)
        moments = near.groupBy("grp").agg(F.sum("n").alias("n"), F.array(*[F.sum(f"s{i}") for i in range(p)]).alias("s"), F.array(*[F.sum(f"q{i}_{j}") for i in range(p) for j in range(i, p)]).alias("ss"))
        after, new = write_out(fitted(moments, names, factor), "centres")
        moved = F.exists(F.zip_with(F.zip_with("mean", "before", lambda x, y: F.abs(x - y)), floors, lambda d, f: d > f), lambda x: x)
        settled = after.join(now.select("grp", F.col("mean").alias("before")), "grp").where(moved).isEmpty()
        drop_paths(spark, path)
        now, path = after, new
        if settled:
            return now
    raise RuntimeError(f"centres did not settle in {steps} steps")


def judge_quality(docs: DataFrame, tail: float = TAIL, least: int = LEAST) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, grp, distance2 and kept for every document.

    Null and empty texts have no words, so fail the base rules, as does any text under 50 words. Documents of
    groups too small even when all pooled have no distance and are kept. Repeated rows are judged alike; estimates
    rest on all rows that pass the base rules. Null ids are kept; other columns are left out. An empty table gives no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats, _ = write_out(with_statistics(docs).withColumn("base_failed", failed), "statistics")
    rows, _ = write_out(grouped(stats, least), "grouped")
    centres = robust_estimates(rows.where("grp is not null and not base_failed"))
    limit = chi2_quantile(1 - tail, len(STATS))
    known = centres.select("grp").withColumn("known", F.lit(True))
    judged = join_few(rows, centres, "grp").withColumn("distance2", distance(list(STATS))).drop("mean", "inv")
    rest = rows.join(F.broadcast(known) if known.count() <= 10_000 else known, "grp", "left_anti").withColumn("distance2", F.lit(None).cast("double"))
    out = judged.select(*rest.columns).unionByName(rest)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= limit, F.lit(True)))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """The base statistics and the verdict on every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
