"""Balanced logistic fits of many training sets that share their rows: all rows of a layer, less the folds that a fit leaves out.

Newton steps need a fit's cost, gradient and Hessian, which are sums over rows. For all fits of a layer they are matrix
products: of rows with parameters, of residuals with rows, of curvatures with rows' outer products. Each partition adds up its
own rows; what it sends on is one block of sums a lot of fits, whatever its rows, and the driver solves small systems.
No row is copied for a fold and none is left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.operators.ranges import written

#: Layers of up to so many rows are fitted in one task each; with a larger one, every pass is a Spark job over all rows.
ROWS_A_TASK = 20_000
#: Bytes of sums that a lot of fits may need, numbers of a slice of rows times fits, and the longest vectors whose Hessians are summed.
LOT_BYTES, SLICE, LONGEST = 64 << 20, 1 << 21, 1024
#: Blocks that a lot's sums are cut to, so that several tasks add them up.
BLOCKS = 16


def sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, left: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """A row of sums for each fit: cost, gradient, upper triangle of the Hessian. x ends in a column of ones; left has two
    folds that the fit leaves out (-1: none), weight those of the classes 0 and 1."""
    fits, d = theta.shape
    i, j = np.triu_indices(d)
    out = np.zeros((fits, 1 + d + len(i)))
    step = max(1, SLICE // max(fits, len(i)))
    for s in range(0, len(y), step):
        a, ys, fs = x[s : s + step], y[s : s + step], fold[s : s + step]
        z = a @ theta.T
        w = weight.T[ys]
        for k in range(left.shape[1]):
            w = np.where(fs[:, None] == left[:, k], 0.0, w)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        out[:, 0] += (w * (np.logaddexp(0, z) - ys[:, None] * z)).sum(0)
        out[:, 1 : 1 + d] += (w * (p - ys[:, None])).T @ a
        out[:, 1 + d :] += (w * p * (1 - p)).T @ (a[:, i] * a[:, j])
    return out


def minimise(evaluate, fits: int, d: int, steps: int = 200) -> np.ndarray:
    """Parameters (fits x d, the last a free intercept, the others with |beta|^2 / 2 on top of the summed cost) by damped Newton
    steps. evaluate(which, theta) gives the sums of those fits; a fit that has settled is asked no more."""
    ridge = np.append(np.ones(d - 1), 0.0)
    i, j = np.triu_indices(d)
    best, now = np.zeros((fits, d)), np.full(fits, np.inf)
    move, size = np.zeros((fits, d)), np.ones(fits)
    at = np.arange(fits)
    for _ in range(steps):
        if not len(at):
            break
        trial = best[at] - size[at, None] * move[at]
        got = evaluate(at, trial)
        cost = got[:, 0] + (ridge * trial * trial).sum(1) / 2
        fine = cost <= now[at]
        ok, gain = at[fine], now[at][fine] - cost[fine]
        best[ok], now[ok] = trial[fine], cost[fine]
        h = np.zeros((len(ok), d, d))
        h[:, i, j] = got[fine, 1 + d :]
        h[:, j, i] = got[fine, 1 + d :]
        grad = got[fine, 1 : 1 + d] + ridge * trial[fine]
        if len(ok):
            move[ok] = np.linalg.solve(h + np.diag(ridge + 1e-12), grad[:, :, None])[:, :, 0]
        size[ok] = 1.0
        size[at[~fine]] /= 2
        done = np.zeros(len(at), bool)
        done[fine] = gain < 1e-12 * (1 + np.abs(now[ok]))
        done |= size[at] < 1e-8
        at = at[~done]
    return best


def leaving(folds: int, out: int) -> np.ndarray:
    """The folds that each fit leaves out: none, each one, or each pair."""
    if out == 2:
        return np.array(list(combinations(range(folds), 2)), np.int64).reshape(-1, 2)
    return np.column_stack([np.arange(folds), np.full(folds, -1)]) if out else np.full((1, 2), -1)


def class_weights(left: np.ndarray, n: np.ndarray, pos: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, whether both classes are there, weights of classes 0 and 1) of each fit, from rows and positives by fold."""
    gone = lambda v: v.sum() - sum(np.where(left[:, k] >= 0, v[left[:, k]], 0) for k in range(left.shape[1]))
    n, pos = gone(n), gone(pos)
    mixed = (pos > 0) & (pos < n)
    both = np.column_stack([n - pos, pos])
    return n, mixed, np.where(mixed[:, None], c * n[:, None] / (2.0 * np.maximum(both, 1)), 0.0)


def lots(fits: int, d: int):
    most = max(1, LOT_BYTES // (8 * (1 + d + d * (d + 1) // 2)))
    return (np.arange(s, min(fits, s + most)) for s in range(0, fits, most))


def in_task(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int, out: int, c: float):
    """(left, rows, mixed, parameters) of all fits over one layer's rows. Wide vectors are solved in the span of the rows."""
    left = leaving(folds, out)
    n, mixed, weight = class_weights(left, np.bincount(fold, minlength=folds), np.bincount(fold, y, folds), c)
    basis = None
    if x.shape[1] > len(y):
        _, s, v = np.linalg.svd(x, full_matrices=False)
        basis = v[s > s[0] * 1e-12]
        x = x @ basis.T
    a = np.column_stack([x, np.ones(len(y))])
    theta, some = np.zeros((len(left), a.shape[1])), np.flatnonzero(mixed)
    for lot in lots(len(some), a.shape[1]):
        k = some[lot]
        theta[k] = minimise(lambda at, t, k=k: sums(a, y, fold, left[k[at]], weight[k[at]], t), len(k), a.shape[1])
    beta = theta[:, :-1] if basis is None else theta[:, :-1] @ basis
    return left, n, mixed, beta, theta[:, -1]


def added(data: DataFrame, add, fits: int) -> np.ndarray:
    """Sums of all rows, a row a fit: one Spark job. add(batches) is a partition's own; they are added up in blocks."""

    def blocks(total):
        for block, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()], pa.binary())], ["block", "sums"])

    def own(batches):
        total = add(batches)
        if total is not None:
            yield from blocks({k: part for k, part in enumerate(np.array_split(total, BLOCKS)) if len(part)})

    def up(batches):
        total = {}
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("sums").to_pylist()):
                total[block] = total.get(block, 0) + np.frombuffer(raw)
        yield from blocks(total)

    rows = data.mapInArrow(own, "block long, sums binary").repartition(BLOCKS, "block").mapInArrow(up, "block long, sums binary").collect()  # LOT_BYTES
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["block"])]).reshape(fits, -1)


def vectors(batch) -> np.ndarray:
    x = np.asarray(batch.column("vec").flatten(), float).reshape(batch.num_rows, -1)
    return np.column_stack([x, np.ones(len(x))])


def places(column, place: dict) -> np.ndarray:
    """Places of a column's values, -1 for those that have none."""
    some = column.dictionary_encode()
    return np.array([place.get(v, -1) for v in some.dictionary.to_pylist()], np.int64)[some.indices.to_numpy(zero_copy_only=False)]


def over_partitions(data: DataFrame, folds: list, left: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """`sums` over all rows of one layer, for fits that leave out folds."""
    held = data.sparkSession.sparkContext.broadcast(({v: k for k, v in enumerate(folds)}, left, weight, theta))  # of one lot of fits

    def add(batches):
        place, *fits = held.value
        total = None
        for b in batches:
            part = sums(vectors(b), b.column("y").to_numpy().astype(np.int64), places(b.column("fold"), place), *fits)
            total = part if total is None else total + part
        return total

    out = added(data, add, len(theta))
    held.destroy()
    return out


def over_layers(data: DataFrame, layers: list, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """`sums` of one fit a layer, over all rows of these layers."""
    held = data.sparkSession.sparkContext.broadcast(({v: k for k, v in enumerate(layers)}, weight, theta))  # of one lot of fits

    def add(batches):
        place, weight, theta = held.value
        total = None
        for b in batches:
            at, y = places(b.column("layer"), place), b.column("y").to_numpy().astype(np.int64)
            for k in np.unique(at[at >= 0]):
                mine = np.flatnonzero(at == k)
                part = sums(vectors(b.take(pa.array(mine))), y[mine], np.zeros(len(mine), np.int64), np.full((1, 2), -1), weight[k : k + 1], theta[k : k + 1])
                total = np.zeros((len(theta), part.shape[1])) if total is None else total
                total[k] += part[0]
        return total

    out = added(data, add, len(theta))
    held.destroy()
    return out


def weights(rows: DataFrame, out: int, c: float = 1.0, both: bool = False, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Fits over rows (fold, layer, y, vec), each layer's on its own, as a written table: (layer, beta, bias, n_train) on all rows
    with out = 0; with a column `hold` without the rows of each fold (out = 1); with `outer` and `fold` without the rows of
    each two folds (out = 2), both ways round.

    The minimum of c * sum(w * log loss) + |beta|^2 / 2 with class-balanced w and a free intercept. One class alone gives zeros, or
    with `both` no row. Every row counts: layers of up to `rows_a_task` rows are fitted a layer a task, beyond that all
    partitions add up sums for each step. Folds may be any number (the driver gets a row of counts a fold and layer);
    work grows with rows times fits. Rows with a null label, vector or (with out) fold are left out. Vectors of more than
    LONGEST numbers are fitted in tasks only, which needs layers of up to `rows_a_task` rows: else ValueError.
    """
    fold = F.col("fold") if out else F.lit(0).alias("fold")
    data = written(rows.where(F.col("y").isNotNull() & F.col("vec").isNotNull() & (F.col("fold").isNotNull() if out else F.lit(True))).select("layer", fold, F.col("y").cast("int").alias("y"), F.col("vec").cast("array<double>").alias("vec")), "probe-rows")
    counts = data.groupBy("layer", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.max(F.size("vec")).alias("d")).collect()  # one a fold and layer
    layers, folds = (sorted({r[k] for r in counts}) for k in ("layer", "fold"))
    kind = lambda n: data.schema[n].dataType.simpleString()
    names = {0: [], 1: ["hold"], 2: ["outer", "fold"]}[out]
    columns = [*names, "layer", "beta", "bias", "n_train"]
    schema = ", ".join([*[f"{n} {kind('fold')}" for n in names], f"layer {kind('layer')}", "beta array<double>, bias double, n_train long"])

    def listed(layer, left, n, mixed, beta, bias) -> pd.DataFrame:
        keep = [k for k in range(len(left)) if mixed[k] or not both]
        found = [([folds[f] for f in left[k][:out]], k) for k in keep]
        if out == 2:
            found += [(f[::-1], k) for f, k in found]
        return pd.DataFrame([(*f, layer, beta[k].tolist(), float(bias[k]), int(n[k])) for f, k in found], columns=columns)

    if max((sum(r["n"] for r in counts if r["layer"] == layer) for layer in layers), default=0) <= rows_a_task:
        place = {v: k for k, v in enumerate(folds)}

        def fit(group: tuple, f: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(f["vec"].to_numpy()).astype(float)
            return listed(group[0], *in_task(x, f["y"].to_numpy().astype(np.int64), f["fold"].map(place).to_numpy(np.int64), len(folds), out, c))

        return written(data.groupBy("layer").applyInPandas(fit, schema), "probe-weights")
    if max(r["d"] for r in counts) > LONGEST:
        raise ValueError(f"vectors of over {LONGEST} numbers in a layer of over {rows_a_task} rows")
    left, made = leaving(len(folds), out), []
    if not out:  # a fit a layer: all layers of one length share their passes
        n, pos, size = ({r["layer"]: r[k] for r in counts} for k in ("n", "pos", "d"))
        for d in sorted(set(size.values())):
            these = [layer for layer in layers if size[layer] == d]
            per = [class_weights(left, np.array([n[layer]]), np.array([pos[layer]]), c) for layer in these]
            weight, theta, some = np.concatenate([w for _, _, w in per]), np.zeros((len(these), d + 1)), np.flatnonzero([m[0] for _, m, _ in per])
            mine = data.where(F.size("vec") == d)
            for lot in lots(len(some), d + 1):
                f = some[lot]
                theta[f] = minimise(lambda at, t, f=f: over_layers(mine, [these[k] for k in f[at]], weight[f[at]], t), len(f), d + 1)
            made += [listed(layer, left, *per[k][:2], theta[k : k + 1, :-1], theta[k : k + 1, -1]) for k, layer in enumerate(these)]
        return written(rows.sparkSession.createDataFrame(pd.concat([m for m in made if len(m)] or made[:1]), schema), "probe-weights")
    for layer in layers:
        own = {r["fold"]: r for r in counts if r["layer"] == layer}
        n, pos = (np.array([own[f][k] if f in own else 0 for f in folds]) for k in ("n", "pos"))
        n, mixed, weight = class_weights(left, n, pos, c)
        d = max(r["d"] for r in own.values())
        theta, some = np.zeros((len(left), d + 1)), np.flatnonzero(mixed)
        mine = data.where(F.col("layer") == F.lit(layer)).drop("layer")
        for lot in lots(len(some), d + 1):
            f = some[lot]
            theta[f] = minimise(lambda at, t, f=f: over_partitions(mine, folds, left[f[at]], weight[f[at]], t), len(f), d + 1)
        made.append(rows.sparkSession.createDataFrame(listed(layer, left, n, mixed, theta[:, :-1], theta[:, -1]), schema))
    out_rows = made[0]
    for m in made[1:]:
        out_rows = out_rows.unionByName(m)
    return written(out_rows, "probe-weights")
