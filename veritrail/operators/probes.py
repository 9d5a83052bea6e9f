"""Linear probes on feature vectors: balanced logistic fits, held-out folds, nested choice of layer, transfer, stacking.

Input rows are (id, fold, layer, y, vec). Fits rest on every row and any number of folds (`newton`); scores cover every row,
through a join with the fitted weights, which are one row a fold and layer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.expressions import dot, l2_norm, last_or_mean, sigmoid
from veritrail.operators import newton
from veritrail.operators.metrics import calibration, ranking, threshold_for_recall
from veritrail.operators.ranges import running, written


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 100) -> tuple[np.ndarray, float]:
    """Minimum of c * sum(w * log loss) + |beta|^2 / 2 with class-balanced w and a free intercept, by damped Newton steps.

    Wide inputs are solved in the span of their rows. One class alone gives zero weights.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim == 2 else 0), 0.0
    basis = None
    if x.shape[1] > len(y):
        _, s, v = np.linalg.svd(x, full_matrices=False)
        basis = v[s > s[0] * 1e-12]
        x = x @ basis.T
    w = c * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    a = np.column_stack([x, np.ones(len(y))])
    ridge = np.append(np.ones(x.shape[1]), 0.0)
    theta = np.zeros(a.shape[1])
    cost = lambda t: (w * (np.logaddexp(0, a @ t) - y * (a @ t))).sum() + (ridge * t * t).sum() / 2
    now = cost(theta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -500, 500)))
        grad = a.T @ (w * (p - y)) + ridge * theta
        move = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + np.diag(ridge + 1e-12), grad)
        size = 1.0
        while (after := cost(theta - size * move)) > now and size > 1e-8:
            size /= 2
        theta, gain, now = theta - size * move, now - after, after
        if gain < 1e-12 * (1 + abs(now)):
            break
    beta = theta[:-1] if basis is None else basis.T @ theta[:-1]
    return beta, float(theta[-1])


def fit_layers(rows: DataFrame, c: float = 1.0) -> DataFrame:
    """(layer, beta, bias, n_train) fitted on all rows of a layer; one class alone gives zeros."""
    return newton.weights(rows, 0, c)


def scored(rows: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
    """rows with p by the weights of their keys. A row a layer is broadcast: shuffled by layer, all rows of one would meet in a task."""
    return rows.join(F.broadcast(weights) if on == ["layer"] else weights, on).withColumn("p", sigmoid(dot(F.col("vec"), F.col("beta")) + F.col("bias"))).drop("beta", "bias")


def held_out_weights(rows: DataFrame, c: float = 1.0, both: bool = False) -> DataFrame:
    """(hold, layer, weights) fitted without the rows of fold `hold`; with `both`, where the others have both classes."""
    return newton.weights(rows, 1, c, both)


def inner_weights(rows: DataFrame, c: float = 1.0) -> DataFrame:
    """(outer, fold, layer, weights) fitted without the rows of either fold, where what is left has both classes."""
    return newton.weights(rows, 2, c, both=True)


def held_out_scores(rows: DataFrame, c: float = 1.0, both: bool = False) -> DataFrame:
    """rows with p, each by the probe that never saw its fold; with `both`, without rows whose probe would see one class."""
    return scored(rows, held_out_weights(rows, c, both).withColumnRenamed("hold", "fold"), ["fold", "layer"])


def held_out_ranking(rows: DataFrame, c: float = 1.0) -> DataFrame:
    """Mean and population deviation over folds of both classes, and the pooled AUROC and AP, by layer."""
    return fold_ranking(held_out_scores(rows, c))


def nested_scores(rows: DataFrame, c: float = 1.0) -> DataFrame:
    """Outer fold rows scored at the layer that inner held-out folds rank best (first layer on ties). Outer folds of one
    class are left out, and so are those without an inner fold that can be ranked."""
    mixed = rows.groupBy("fold").agg(F.min("y").alias("low"), F.max("y").alias("high")).where("low < high").select("fold")
    weights = inner_weights(rows, c)
    inner = ranking(scored(rows, weights, ["fold", "layer"]), ["outer", "layer", "fold"], "p").groupBy("outer", "layer").agg(F.avg("auroc").alias("auroc")).where("auroc is not null")
    best = Window.partitionBy("outer").orderBy(F.desc("auroc"), "layer")
    chosen = inner.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("outer").alias("fold"), "layer").join(mixed, "fold")
    return scored(rows.join(chosen, ["fold", "layer"]), held_out_weights(rows, c).withColumnRenamed("hold", "fold"), ["fold", "layer"])


def nested_ranking(rows: DataFrame, c: float = 1.0) -> DataFrame:
    """One row: mean and population deviation of the outer folds' AUROC, AUROC and AP pooled over the rows of all outer
    folds whatever layer each chose, and how many folds chose each layer."""
    p = written(nested_scores(rows, c).select("fold", "layer", "y", "p"), "nested")
    each = ranking(p, ["fold", "layer"], "p").groupBy("layer").agg(F.collect_list("auroc").alias("found"), F.count("*").alias("n_folds"))
    each = each.agg(F.flatten(F.collect_list("found")).alias("found"), F.array_sort(F.collect_list(F.struct("layer", "n_folds"))).alias("layers"))  # bounded: folds are few
    mean = F.aggregate("found", F.lit(0.0), lambda s, x: s + x) / F.size("found")
    std = F.sqrt(F.aggregate("found", F.lit(0.0), lambda s, x: s + F.pow(x - F.col("auroc_mean"), 2)) / F.size("found"))
    each = each.where(F.size("found") > 0).withColumn("auroc_mean", mean).withColumn("auroc_std", std)
    return each.select(F.size("found").alias("n_folds"), "auroc_mean", "auroc_std", "layers").join(ranking(p, [], "p"))


def transfer_scores(train: DataFrame, test: DataFrame, c: float = 1.0, normalise: bool = False) -> DataFrame:
    """test rows with p by probes fitted on train, by layer; vectors as they are or at length one."""
    unit = (lambda d: d.withColumn("vec", l2_norm(F.col("vec")))) if normalise else (lambda d: d)
    return scored(unit(test), fit_layers(unit(train), c), ["layer"])


def conflict(p: DataFrame) -> DataFrame:
    """Deviation of a row's held-out scores across layers; rows with a NaN among them are left out."""
    return p.groupBy("id").agg(F.stddev_pop("p").alias("conflict"), F.max(F.isnan("p").cast("int")).alias("_nan")).where("_nan = 0").drop("_nan")


def conflict_ranking(rows: DataFrame, c: float = 1.0) -> DataFrame:
    """One row: the layer of the best held-out AUROC (first on ties), and the pooled held-out AUROC of its vectors alone and with
    the conflict appended, over the rows that every layer scores. No row where no layer can be ranked."""
    p = written(held_out_scores(rows, c, both=True).select("id", "layer", "y", "p"), "held-out")
    found = [(-r["auroc"], r["layer"]) for r in ranking(p, ["layer"], "p").where("auroc is not null").collect()]  # one a layer
    best = min(found)[1] if found else None
    ids = p.groupBy("id").agg(F.count("p").alias("n")).join(rows.agg(F.count_distinct("layer").alias("of"))).where("n = of").select("id")
    some = rows.where(F.col("layer") == F.lit(best)).join(conflict(p).join(ids, "id"), "id")
    some = written(some.withColumn("vec", F.col("vec").cast("array<double>")), "conflicts")
    with_it = some.withColumn("vec", F.concat("vec", F.array("conflict")))
    rank = lambda r, name: ranking(held_out_scores(r, c, both=True), [], "p").select("n", "n_pos", F.col("auroc").alias(name))
    out = rank(some, "auroc_baseline").join(rank(with_it, "auroc_conflict").select("auroc_conflict"))
    return out.where("n > 0").select(F.lit(best).cast(rows.schema["layer"].dataType).alias("best_layer"), "n", "n_pos", "auroc_baseline", "auroc_conflict", (F.col("auroc_conflict") - F.col("auroc_baseline")).alias("delta"))


def full_set_scores(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows (id, layer, vec) scored by saved weights (layer, beta, bias), the rows they were fitted on included."""
    return scored(rows, weights.select("layer", "beta", "bias"), ["layer"])


def field_scores(labels: DataFrame, activations: DataFrame, weights: DataFrame, layer: int) -> DataFrame:
    """(doc_id, path_str, probe_score) of every label with an activation at the layer, extracted or not; of token vectors
    (tokens) the last counts."""
    vec = F.element_at("tokens", -1) if "tokens" in activations.columns else F.col("vec")
    some = activations.where(F.col("layer") == layer).select("doc_id", "path_str", "layer", vec.alias("vec"))
    p = scored(labels.select("doc_id", "path_str").join(some, ["doc_id", "path_str"]), weights.select("layer", "beta", "bias"), ["layer"])
    return p.select("doc_id", "path_str", F.col("p").alias("probe_score"))


def standardised(rows: DataFrame, columns: list[str], by: DataFrame | None = None, eps: float = 1e-8, add: bool = False) -> DataFrame:
    """z_<column>: by the mean and population deviation of the rows of `by` (default: all); a deviation below eps counts as
    one, or with `add` eps is added to each."""
    stats = (rows if by is None else by).agg(*[f(c).alias(f"_{c}_{n}") for c in columns for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    off = lambda c: F.col(f"_{c}_d") + eps if add else F.when(F.col(f"_{c}_d") < eps, F.lit(1.0)).otherwise(F.col(f"_{c}_d"))
    out = rows.crossJoin(F.broadcast(stats))
    return out.select(*rows.columns, *[((F.col(c) - F.col(f"_{c}_m")) / off(c)).alias(f"z_{c}") for c in columns])


def span_scores(rows: DataFrame, how: str, c: float = 1.0) -> DataFrame:
    """(id, fold, layer, y, p): held-out scores of fields with token vectors (tokens). last and mean make one vector of them;
    max fits on every token, with its field's label, and takes a field's largest score."""
    base = ["id", "fold", "layer", "y"]
    if how != "max":
        return held_out_scores(rows.select(*base, last_or_mean(F.col("tokens"), how).alias("vec")), c, both=True).select(*base, "p")
    tokens = rows.select(*base, F.posexplode("tokens").alias("_t", "vec"))
    keyed = tokens.withColumn("_field", F.col("id")).withColumn("id", F.concat_ws("#", F.col("id").cast("string"), F.col("_t").cast("string")))
    p = held_out_scores(keyed, c, both=True)
    return p.groupBy(F.col("_field").alias("id"), "fold", "layer").agg(F.first("y").alias("y"), F.max("p").alias("p")).select(*base, "p")


def fold_ranking(p: DataFrame) -> DataFrame:
    """(layer, n_folds, auroc_mean, auroc_std, n, n_pos, auroc, ap) of held-out scores: over folds of both classes, and pooled."""
    each = ranking(p, ["layer", "fold"], "p").where("auroc is not null").groupBy("layer").agg(F.count("*").alias("n_folds"), F.avg("auroc").alias("auroc_mean"), F.stddev_pop("auroc").alias("auroc_std"))
    return each.join(ranking(p, ["layer"], "p"), "layer")


def with_features(rows: DataFrame, *features: str) -> DataFrame:
    """rows whose vectors go on with the named numbers."""
    return rows.withColumn("vec", F.concat(F.col("vec").cast("array<double>"), F.array(*[F.col(f).cast("double") for f in features])))


def stacked(rows: DataFrame, signals: list[str], c: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, fold, y, p), held-out scores of a logistic model over the probe's score and the signals, and (hold, signal,
    coefficient).

    For each held-out fold a probe is fitted on the other folds' vectors; its scores of those rows and their signals, all
    standardised by the other folds alone, train the second model, on every row too. Rows with a NaN or null signal are left
    out; folds whose training rows have one class are not scored. Scores and signals of a row go to every fold, its
    vector to none."""
    ok = rows
    for s in signals:
        ok = ok.where(F.col(s).isNotNull() & ~F.isnan(s))
    ok = written(ok.select("id", "fold", "layer", "y", "vec", *signals), "stacked")
    probes_ = held_out_weights(ok, c, both=True).select("hold", F.col("layer").alias("_layer"), "beta", "bias")
    each = ok.join(probes_, F.col("layer") == F.col("_layer")).withColumn("probe", sigmoid(dot(F.col("vec"), F.col("beta")) + F.col("bias")))
    names = ["probe", *signals]
    each = written(each.select("hold", "id", "fold", "y", *[F.col(n).cast("double").alias(n) for n in names]), "stacked-rows")
    stats = each.where("fold <> hold").groupBy("hold").agg(*[f(n).alias(f"_{k}_{n}") for n in names for k, f in (("m", F.avg), ("d", F.stddev_pop))])
    off = lambda n: F.when(F.col(f"_d_{n}") < 1e-8, F.lit(1.0)).otherwise(F.col(f"_d_{n}"))
    vec = F.array(*[(F.col(n) - F.col(f"_m_{n}")) / off(n) for n in names])
    each = each.join(F.broadcast(stats), "hold").select("id", "fold", "y", F.col("hold").alias("layer"), vec.alias("vec"))  # a row a fold
    fits = newton.weights(each.where("fold <> layer"), 0, c, both=True).select("layer", "beta", "bias")
    weights = fits.select(F.col("layer").alias("hold"), F.posexplode("beta").alias("_i", "coefficient"))
    weights = weights.withColumn("signal", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)).select("hold", "signal", "coefficient")
    p = written(scored(each.where("fold = layer"), fits, ["layer"]).select("id", "fold", "y", "p"), "stacked-scores")
    return p, weights


def three_signal_ranking(rows: DataFrame, signals: list[str], c: float = 1.0) -> DataFrame:
    """One row: n, n_pos, mean and deviation of the folds' AUROC, pooled AUROC and AP, and the signals' mean coefficients with
    deviations."""
    p, weights = stacked(rows, signals, c)
    coefs = weights.groupBy("signal").agg(F.avg("coefficient").alias("mean"), F.stddev_pop("coefficient").alias("std")).agg(F.array_sort(F.collect_list(F.struct("signal", "mean", "std"))).alias("coefficients"))
    return fold_ranking(p.withColumn("layer", F.lit(0))).drop("layer").crossJoin(coefs)


def drawn(seed: int):
    """A row's place in a random order: md5 of the seed and its id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))


def places(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """rows with one_to, a row's place from 1 on among those of its keys in a random order, and one_all, how many they are."""
    order = written(rows.withColumn("one", F.lit(1).cast("long")).withColumn("_h", drawn(seed)), "drawn")
    return running(order, keys, [F.col("_h"), F.col("id")], ["one"]).drop("_h", "one")


def shares(rows: DataFrame, parts: int, seed: int, column: str = "part") -> DataFrame:
    """rows with a part from 0 to parts - 1, of equal size a class (and layer) but for one row, in the order of a hash of the id."""
    return places(rows, ["layer", "y"], seed).withColumn(column, ((F.col("one_to") - 1) % parts).cast("int")).drop("one_to", "one_all")


def train_probes(rows: DataFrame, c: float = 1.0, parts: int = 5, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """A probe for each layer, with how well such probes do: layer, beta, bias, n_train (fitted on all rows); fold_auroc, of `parts`
    stratified parts held out in turn, empty where a class has fewer rows than parts; and of one test set of max(1,
    round(test_share * n)) rows drawn by hash: n_test, n_test_errors, auroc, ap, brier, accuracy, threshold_at_50. Null where
    one class makes a measure undefined."""
    some = rows.select("id", "layer", "y", "vec")
    share = F.greatest(F.lit(1), F.bround(F.col("one_all") * test_share))
    dealt = places(shares(some, parts, seed), ["layer"], seed + 1).withColumn("test", (F.col("one_to") <= share).cast("int"))
    dealt = written(dealt.select("id", "layer", "y", "vec", "part", "test"), "dealt")
    few = dealt.groupBy("layer").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).where(F.least("pos", F.col("n") - F.col("pos")) >= parts).select("layer")
    held = ranking(held_out_scores(dealt.withColumn("fold", F.col("part")), c), ["layer", "part"], "p").where("auroc is not null")
    held = held.join(few, "layer").groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("part", "auroc")))["auroc"].alias("fold_auroc"))  # `parts` at most
    tested = written(held_out_scores(dealt.withColumn("fold", F.col("test")).where("test is not null"), c, both=True).where("test = 1").select("layer", "y", "p"), "tested")
    sizes = dealt.groupBy("layer").agg(F.sum("test").alias("n_test"), F.sum(F.col("y") * F.col("test")).alias("n_test_errors"))
    out = fit_layers(dealt, c).join(sizes, "layer").join(held, "layer", "left")
    out = out.join(ranking(tested, ["layer"], "p").select("layer", "auroc", "ap"), "layer", "left").join(calibration(tested, ["layer"]), "layer", "left")
    out = out.join(threshold_for_recall(tested, ["layer"], 0.5, "p").withColumnRenamed("threshold", "threshold_at_50"), "layer", "left")
    found = F.coalesce("fold_auroc", F.array().cast("array<double>")).alias("fold_auroc")
    return out.select("layer", "beta", "bias", "n_train", found, "n_test", "n_test_errors", "auroc", "ap", "brier", "accuracy", "threshold_at_50")


def auroc(y: np.ndarray, p: np.ndarray) -> float | None:
    """Ties count half; None with one class."""
    pos, n = int(y.sum()), len(y)
    if not 0 < pos < n:
        return None
    s, at, size = np.unique(p, return_inverse=True, return_counts=True)
    rank = np.cumsum(size) - (size - 1) / 2
    return float((rank[at][y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos)))


def measures(y: np.ndarray, p: np.ndarray) -> dict:
    """auroc, ap, brier, accuracy at one half, and the score of the positive that makes half of them."""
    order = np.argsort(-p, kind="stable")
    ys, ps, pos = y[order], p[order], int(y.sum())
    last = np.append(ps[1:] != ps[:-1], True)
    tp, seen = np.cumsum(ys)[last], (np.arange(len(ys)) + 1)[last]
    ap = float((np.diff(tp, prepend=0) * tp / seen).sum() / pos) if 0 < pos < len(y) else None
    half = float(np.sort(p[y == 1])[::-1][int(np.ceil(0.5 * pos)) - 1]) if pos else None
    return {"auroc": auroc(y, p), "ap": ap, "brier": float(((p - y) ** 2).mean()), "accuracy": float(((p > 0.5) == y).mean()), "threshold_at_50": half}
