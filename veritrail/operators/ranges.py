"""Running sums over rows in a total order, with no group in one task: a sample sort whose ranges carry sums over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.sinks.workspace import work_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that what follows neither plans it again nor loses it with an executor."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table that a task of dear rows gets, by the plan's statistics, and tasks a core at most.
ENOUGH, MOST_TASKS = 4 << 20, 16


def spread(df: DataFrame) -> DataFrame:
    """df for work that is dear by row: dealt evenly to tasks that grow in number with the table, at least one a core. How a file
    is cut when it is read says little: a row group is never cut, and may hold a million rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, min(size // ENOUGH, MOST_TASKS * cores)))


def running(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str], parts: int | None = None) -> DataFrame:
    """rows with, for each of the columns, <column>_to, the sum over the rows of the same keys up to this one in order, and
    <column>_all, the sum over all of them; null keys are a group, null values count as nothing.

    Rows are dealt to `parts` ranges (default: shuffle partitions) of (keys, order), which Spark samples, so that a group of a
    third of all rows is spread over a third of the ranges. Each range sums its own; a group that reaches over several
    takes sums from range to range through a table of at most two rows a range, which is all that is broadcast. Rows
    that agree in keys and order share a range: order should break ties, or the rows be summed before.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    own = Window.partitionBy(*keys, "_range")
    up = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = written(dealt.select("*", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"{c}_to") for c in columns], *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{c}_all") for c in columns]), "ranges")
    per = local.groupBy(*keys, "_range").agg(*[F.max(f"{c}_all").alias(c) for c in columns])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    over = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), F.count("*").over(group).alias("_n"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(c).over(group).alias(f"_w_{c}") for c in columns]).where("_n > 1")
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    sums = [(F.col(f"{c}_to") + F.coalesce(f"_b_{c}", F.lit(0))).alias(f"{c}_to") for c in columns]
    return local.join(F.broadcast(over), same, "left").select(*rows.columns, *sums, *[F.coalesce(f"_w_{c}", f"{c}_all").alias(f"{c}_all") for c in columns])
