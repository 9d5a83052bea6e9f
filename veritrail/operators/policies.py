"""What to do with doubtful fields: budget curves, gated overrides, held-out gates and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import expressions as X
from veritrail.operators.ranges import running, written

TAUS = [round(0.05 * i, 2) for i in range(20)]


def delta(was_error: Column, is_error: Column) -> Column:
    """+1 for an error mended, -1 for a right value broken."""
    return was_error.cast("int") - is_error.cast("int")


def curve(rows: DataFrame, order: list[Column], group: list[str], gain: str = "delta", origin: bool = False) -> DataFrame:
    """Cost (rows spent, in order) and running gain of each group; with origin, group, cost and net alone, from (0, 0) on.
    order must break all ties. Rows are sorted by ranges of (group, order), so a group may be the whole collection."""
    made = running(rows.withColumns({"_one": F.lit(1).cast("long"), "_gain": F.col(gain).cast("long")}), group, order, ["_one", "_gain"])
    out = made.select(*rows.columns, F.col("_one_to").cast("int").alias("cost"), F.col("_gain_to").alias("net"))
    if not origin:
        return out
    zero = rows.select(*group, F.lit(0).alias("cost"), F.lit(0).cast("long").alias("net")).distinct()
    return zero.unionByName(out.select(*group, "cost", "net"))


def orders(seed: int = 42, keys: tuple[str, ...] = ("doc_id", "path_str")) -> dict[str, list[Column]]:
    """Ways to spend a budget: likely errors first, unlikely tokens first, by hash, true errors first; ties by keys. NaN counts
    as the most likely token."""
    ties = [F.col(k) for k in keys]
    return {"probe": [F.desc("probe_score"), *ties], "logprob": [F.asc("min_logprob"), *ties], "random": [F.md5(F.concat_ws("|", F.lit(str(seed)), *[t.cast("string") for t in ties]).cast("binary")), *ties], "oracle": [F.desc("is_error"), *ties]}


def curves(rows: DataFrame, group: list[str], seed: int = 42, keys: tuple[str, ...] = ("doc_id", "path_str"), which: tuple[str, ...] = ("probe", "logprob", "random", "oracle")) -> DataFrame:
    """(group, strategy, cost, net) of the orders named, from (0, 0) on. Rows are worked out once and written; each order asked
    for sorts what it needs."""
    needs = {"probe": ["probe_score"], "logprob": ["min_logprob"], "random": [], "oracle": ["is_error"]}
    used = dict.fromkeys([*group, *keys, "delta", *[c for n in which for c in needs[n]]])
    some, out = written(rows.select(*used), "curves"), None
    for name in which:
        one = curve(some, orders(seed, keys)[name], group, origin=True).select(*group, F.lit(name).alias("strategy"), "cost", "net")
        out = one if out is None else out.unionByName(one)
    return out


def budgets(curved: DataFrame, group: list[str], shares=(0.1, 0.25, 0.5, 1.0)) -> DataFrame:
    """Net at floor(share * n) rows; a budget of no rows has net 0."""
    n = curved.groupBy(*group).agg(F.max("cost").alias("n"))
    asked = n.select(*group, "n", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")).withColumn("cost", F.floor(F.col("n") * F.col("share")).cast("int"))
    return asked.join(curved.select(*group, "cost", "net"), [*group, "cost"], "left").select(*group, "share", "cost", F.coalesce("net", F.lit(0)).alias("net"))


def gate(rows: DataFrame, group: list[str], taus: list[float] = TAUS) -> DataFrame:
    """For each tau: overrides where p >= tau and their rate of all rows, fixed, broke, net and precision = fixed / (fixed +
    broke); taus that nothing reaches have zeros."""
    # a row counts once, for the last tau it reaches; sums from above then give all taus, on one row a group and tau
    place = F.size(F.filter(F.array(*[F.lit(t) for t in taus]), lambda t: F.col("p") >= t))
    each = rows.groupBy(*group, place.alias("_i")).agg(F.count("*").alias("n"), F.count_if(F.col("delta") > 0).alias("fixed"), F.count_if(F.col("delta") < 0).alias("broke"))
    whole = each.groupBy(*group).agg(F.sum("n").alias("of"), F.collect_list(F.struct("_i", "n", "fixed", "broke")).alias("_all"))  # at most one a tau
    grid = whole.select(*group, "of", "_all", F.posexplode(F.array(*[F.lit(t) for t in taus])).alias("_at", "tau"))
    above = lambda name: F.aggregate(F.filter("_all", lambda x: x["_i"] > F.col("_at")), F.lit(0).cast("long"), lambda s, x: s + x[name])
    out = grid.select(*group, "tau", above("n").alias("n_override"), F.col("of"), above("fixed").alias("fixed"), above("broke").alias("broke"))
    out = out.withColumn("rate", F.try_divide("n_override", "of")).withColumn("net", F.col("fixed") - F.col("broke"))
    return out.withColumn("precision", F.try_divide(F.col("fixed"), F.col("fixed") + F.col("broke"))).drop("of")


def held_out_gate(rows: DataFrame, fold: str, taus: list[float] = TAUS) -> DataFrame:
    """For each fold: the tau of the best net on all other folds (lowest on ties), and the fold's own fixed, broke and net there."""
    own = gate(rows, [fold], taus).select(fold, "tau", "fixed", "broke", "net")
    total = own.groupBy("tau").agg(F.sum("net").alias("total"))
    full = own.join(F.broadcast(total), "tau").withColumn("others", F.col("total") - F.col("net"))  # one row a tau
    best = Window.partitionBy(fold).orderBy(F.desc("others"), "tau")
    return full.withColumn("r", F.row_number().over(best)).where("r = 1").select(fold, "tau", "fixed", "broke", "net")


def held_out_summary(chosen: DataFrame) -> DataFrame:
    """One row: sums over folds, and how many folds chose each tau."""
    taus = chosen.groupBy("tau").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("tau", "n"))).alias("taus"))  # one a tau
    return chosen.agg(F.count("*").alias("n_folds"), *[F.sum(c).alias(c) for c in ("fixed", "broke", "net")]).crossJoin(taus)


def select_candidates(rows: DataFrame, margins=(0.0, 0.05, 0.1, 0.15, 0.2, 0.3), carried: tuple[str, ...] = ()) -> DataFrame:
    """Of candidates (key, idx, p, orig_p, carried): the one of least p (first on ties, NaN never), taken at each margin where
    p <= orig_p - margin. The least of a key is combined before the shuffle."""
    some = rows.where(F.col("p").isNotNull() & ~F.isnan("p"))
    best = some.groupBy("key").agg(F.min_by(F.struct("p", "idx", *carried), F.struct("p", "idx")).alias("b"), F.min("orig_p").alias("orig_p"))
    out = best.select("key", "b.*", "orig_p", F.explode(F.array(*[F.lit(m) for m in margins])).alias("margin")).withColumn("taken", F.col("p") <= F.col("orig_p") - F.col("margin"))
    return out.select("key", "idx", "p", "orig_p", "margin", "taken", *carried)


def selection_outcomes(candidates: DataFrame, mode: str, margins=(0.0, 0.05, 0.1, 0.15, 0.2, 0.3)) -> DataFrame:
    """(margin, n_override, rate, fixed, broke, net, precision) of candidates (key, idx, p, orig_p, value, gold_value, is_error):
    each field's best candidate overrides where it beats the original by the margin. rate is of all fields."""
    from veritrail.operators.reports import outcome

    taken = select_candidates(candidates, margins, ("value", "gold_value", "is_error")).where("taken")
    taken = taken.withColumn("_ok", X.ok(F.col("gold_value"), F.col("value"), mode))
    word = outcome(F.col("is_error") == 1, F.col("_ok"))
    total = candidates.agg(F.count_distinct("key").alias("of"))
    per = taken.groupBy("margin").agg(F.count("*").alias("n_override"), F.count_if(word == "fixed").alias("fixed"), F.count_if(word == "broke").alias("broke"))
    grid = total.select("of", F.explode(F.array(*[F.lit(m) for m in margins])).alias("margin")).join(F.broadcast(per), "margin", "left").na.fill(0, ["n_override", "fixed", "broke"])
    out = grid.withColumn("net", F.col("fixed") - F.col("broke")).withColumn("rate", F.try_divide("n_override", "of"))
    return out.withColumn("precision", F.try_divide(F.col("fixed"), F.col("fixed") + F.col("broke"))).drop("of")
