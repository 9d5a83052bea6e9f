"""Ranking and calibration metrics as grouped plans: no row leaves the JVM, no group is gathered.

Rows of equal score are summed first, so only distinct scores are sorted. Groups that are many and small are sorted a group a
task; without groups, or where groups are few and large (spread), scores are dealt by ranges over all tasks (`ranges.running`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.operators.ranges import running


def by_score(rows: DataFrame, group: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Positives and rows of each distinct score; null and NaN scores and null labels are dropped."""
    return rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(y).isNotNull()).groupBy(*group, F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))


def ranking(rows: DataFrame, group: list[str], score: str = "score", y: str = "y", spread: bool = False, parts: int | None = None) -> DataFrame:
    """group, n, n_pos, auroc (ties count half) and ap (step-wise average precision); null where a class is missing. No rows give
    no row of a group, and one of nulls without groups.

    Without a group, or with spread, distinct scores are dealt to `parts` ranges; else a group's are sorted in one task."""
    g = by_score(rows, group, score, y).withColumn("neg", F.col("n") - F.col("pos"))
    if group and not spread:
        up = Window.partitionBy(*group).orderBy("s")
        whole = Window.partitionBy(*group)
        g = g.withColumns({f"{c}_to": F.sum(c).over(up) for c in ("pos", "neg")}).withColumns({f"{c}_all": F.sum(c).over(whole) for c in ("pos", "neg")})
    else:
        g = running(g, group, [F.asc("s")], ["pos", "neg"], parts)
    below = F.col("neg_to") - F.col("neg")
    # seen from above: what is not below
    tp = F.col("pos_all") - F.col("pos_to") + F.col("pos")
    seen = tp + F.col("neg_all") - below
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    out = g.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), wins.alias("w"), F.sum(F.col("pos") * tp / seen).alias("a"))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return out.select(*group, "n", "n_pos", F.when(both, F.col("w") / (F.col("n_pos") * (F.col("n") - F.col("n_pos")))).alias("auroc"), F.when(F.col("n_pos") > 0, F.col("a") / F.col("n_pos")).alias("ap"))


def baseline(rows: DataFrame, group: list[str], score: str, higher_is_error: bool, y: str = "y", spread: bool = False) -> DataFrame:
    """ranking of a scalar that speaks for errors when it is high, or when it is low; auroc and ap are null with one class."""
    out = ranking(rows.withColumn("_score", F.col(score) if higher_is_error else -F.col(score)), group, "_score", y, spread)
    return out.withColumn("ap", F.when(F.col("auroc").isNotNull(), F.col("ap")))


def calibration(rows: DataFrame, group: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Brier score and accuracy at one half."""
    return rows.groupBy(*group).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(((F.col(p) > 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"))


def threshold_for_recall(rows: DataFrame, group: list[str], recall: float, score: str = "score", y: str = "y", spread: bool = False, parts: int | None = None) -> DataFrame:
    """Score of the ceil(recall * positives)-th positive, highest first; groups without positives are left out. spread and parts
    as in `ranking`."""
    g = by_score(rows.where(F.col(y) == 1), group, score, y)
    if group and not spread:
        w = Window.partitionBy(*group)
        g = g.withColumn("n_to", F.sum("n").over(w.orderBy(F.desc("s")))).withColumn("n_all", F.sum("n").over(w))
    else:
        g = running(g, group, [F.desc("s")], ["n"], parts)
    out = g.where(F.col("n_to") >= F.ceil(F.col("n_all") * recall)).groupBy(*group).agg(F.max("s").alias("threshold"))
    return out if group else out.where("threshold is not null")
