"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's mean repetition rate is weight * budget / size, so that in expectation its share of the mixture
is its weight. Each document draws a count from a Poisson distribution of that mean by inverting the
distribution function at a uniform number hashed from its id, is exploded that often, and all copies are
put into one global order by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import shuffle_parts, write_out

#: Hash digits to a number: 13 hexadecimal digits are 52 bits, exact in a double.
DIGITS = 13
#: Rates up to this are summed from zero; exp(-745) is the least double.
FAR = 600.0


def unit(*parts: Column) -> Column:
    """Uniform in [0, 1), from md5 over the parts joined by '|' (a null part is '')."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series; good to 1e-13 of it from k = 20 on."""
    x = k.cast("double") + 1
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def poisson(u: Column, rate: Column) -> Column:
    """Smallest k with P(X <= k) > u, by adding terms over all k within twelve deviations (and 40) of the rate.

    Up to a rate of FAR terms begin at k = 0; beyond, where exp(-rate) would vanish, at that lower end, whose term
    comes from logarithms and below which less than 1e-30 lies.
    """
    reach = F.sqrt(rate) * 12 + 40
    low = F.when(rate <= FAR, 0).otherwise(rate - reach).cast("long")
    p = F.when(rate <= FAR, F.exp(-rate)).otherwise(F.exp(low * F.log(rate) - rate - log_factorial(low)))
    step = lambda s, k: F.struct((s.p * rate / k).alias("p"), (s.c + s.p * rate / k).alias("c"), F.when(s.c <= u, k).otherwise(s.n).alias("n"))
    first = F.struct(p.alias("p"), p.alias("c"), low.alias("n"))
    return F.when(rate > 0, F.aggregate(F.sequence(low + 1, (rate + reach).cast("long")), first, step, lambda s: s.n)).otherwise(0).cast("int")


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(source, rate): weights as given (others 0), or in proportion to size ** alpha; size is characters of text.

    The budget is epochs times all characters. Rates come from totals over every document.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("w", F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(alpha))).otherwise(0.0))
    else:
        given = F.lit(0.0)
        for name, w in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(given)
        sizes = sizes.withColumn("w", given)
    sizes, _ = write_out(sizes, "source-sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("ws")).first()
    if not total["ws"]:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    rate = F.round(F.col("w") / total["ws"] * total["all"] * epochs / F.col("size"), 9)
    return sizes.select("source", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, epochs: float = 1.0, seed: int = 7, parts: int | None = None, annotate: bool = False) -> DataFrame:
    """Documents repeated to the target mixture, in a global random order: partition i holds the i-th stretch, sorted.

    Null sources are a source of their own; a source without text, or of weight 0, gives nothing; rows with the
    same id draw the same count and are all repeated. Other columns are carried along. annotate adds copy (from 0),
    rate and shuffle_key. An empty table gives an empty one.

    The table of sources is joined by the planner, which broadcasts it only under its size limit; else the
    documents' side is salted by the hash of the id, 16 ways, so that a source with a third of the rows is no hot key.
    """
    parts, salts = parts or shuffle_parts(docs.sparkSession), 16
    rates = source_rates(docs, weights, alpha, epochs).select(F.col("source").alias("of"), "rate", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("lot"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of ours meets theirs
    left = left.select("row", F.pmod(F.xxhash64("row.doc_id", F.length("row.text")), F.lit(salts)).cast("int").alias("salt"))
    # the row number, never negative, keeps the optimizer from moving the draw into the join's condition
    drawn = left.join(rates, F.col("row.source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("lot"))).select("row", "rate", F.monotonically_increasing_id().alias("nth"))
    drawn = drawn.select("row", "rate", F.when(F.col("nth") >= 0, poisson(unit(F.lit(f"{seed}-count"), F.col("row.doc_id")), F.col("rate"))).alias("k")).where("k > 0")
    copies = drawn.select("row", "rate", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("copy"))
    copies = copies.withColumn("key", unit(F.lit(f"{seed}-order"), F.col("row.doc_id"), F.col("copy")))
    dealt = copies.repartitionById(parts, F.least((F.col("key") * parts).cast("int"), F.lit(parts - 1))).sortWithinPartitions("key", "row.doc_id", "copy")
    extra = [F.col("copy"), F.col("rate"), F.col("key").alias("shuffle_key")] if annotate else []
    return dealt.select(*[F.col(f"row.`{c}`") for c in docs.columns], *extra)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Whole documents, replicated to weights in proportion to size ** 0.7 over one epoch, in their global order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = mix_sources(docs, annotate=True)
    return out.select("doc_id", "copy", "source", "lang", "text", F.round("rate", 6).alias("rate"), "shuffle_key")


ORACLE = """
with sizes as (select source, sum(coalesce(length(text), 0))::bigint as size from documents group by source),
w as (select source, size, case when size > 0 then pow(size::double, 0.7) else 0.0 end as w from sizes),
t as (select sum(size) as a, sum(w) as ws from w),
rates as (select source, case when size > 0 and ws > 0 then round(w / ws * a * 1.0 / size, 9) else 0.0 end as rate from w, t),
d as (select doc_id, text, lang, d.source, rate,
  ('0x' || substr(md5('7-count|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as u
  from documents d join rates r on d.source is not distinct from r.source where rate > 0),
terms as (select rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by rate order by k) as cdf
  from (select rate, unnest(range(0, (rate + sqrt(rate) * 12 + 41)::bigint)) as k from (select distinct rate from d))),
n as (select d.*, (select count(*) from terms t where t.rate = d.rate and t.cdf <= d.u) as k from d),
c as (select n.*, unnest(range(0, k)) as copy from n where k > 0)
select doc_id, copy::integer as copy, source, lang, text, round(rate, 6) as rate,
  ('0x' || substr(md5('7-order|' || coalesce(doc_id::varchar, '') || '|' || copy::varchar), 1, 13))::bigint / 4503599627370496.0::double as shuffle_key
from c
"""
