"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

#: Largest mean that is inverted at once; a larger one is a sum of equal parts.
PART = 16.0
#: Terms of the distribution function; what lies beyond has less weight than 2 ** -60.
TERMS = 72


def _uniform(*parts: Column | str, seed: str) -> Column:
    """A number in (0, 1) on a grid of 2 ** -48, from the md5 of the parts."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p.cast("string") for p in parts])
    number = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double")
    return (number + 0.5) / F.lit(2.0**48)


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rows, rate): the mean number of copies of a row of each source.

    ``weights`` are relative; a source without one gets none of its rows, and without
    ``weights`` all sources weigh the same. Null is a source of its own, named by the key
    None. The expected size of the mixture is ``epochs`` times that of ``docs``; weights
    of sources that have no rows go to the others in proportion.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("rows"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        if any(not math.isfinite(w) or w < 0 for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        weighed = counts.withColumn("weight", weight)
    weighed = settle(weighed, "source-rows")
    total = weighed.agg(F.sum("rows").alias("all_rows"), F.sum("weight").alias("all_weight"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    return weighed.join(F.broadcast(total)).select(  # one row
        "source", "rows", (share * F.col("all_rows") * F.lit(float(epochs)) / F.col("rows")).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """Each row of ``docs`` as often as a Poisson number with its source's rate says, with
    ``copy`` (1, 2, ...) and ``place`` added, in random global order.

    The number is the inverse of the distribution function at a uniform hash of (seed,
    doc_id), so it is the same under any partitioning; rows that repeat a doc_id get the
    same number. A rate above 16 is split into equal parts with a hash each, which keeps
    the table of the function short; their sum has the same distribution. ``place`` is a
    hash of (seed, doc_id, copy): rows are dealt by it over all partitions and sorted there, so
    reading the stored files in order gives a random order. Null or missing source: see
    ``target_rates``. An empty table stays empty. All columns are kept; if docs has
    columns named copy or place they are replaced.
    """
    docs = docs.drop("copy", "place")
    columns = docs.columns
    rates = target_rates(docs, weights, epochs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    rates = rates.select("source", parts.alias("parts"), (F.col("rate") / parts).alias("mean"))
    # running sums of e^-m m^k / k!, k = 0 ... TERMS
    start = F.struct(F.exp(-F.col("mean")).alias("term"), F.array(F.exp(-F.col("mean"))).alias("sums"))
    table = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, lambda s, k: F.struct(
        (s["term"] * F.col("mean") / k).alias("term"),
        F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + s["term"] * F.col("mean") / k)).alias("sums")))
    rates = settle(rates.select(F.col("source").alias("rate_source"), "parts", table["sums"].alias("sums")), "rates")
    drawn = docs.join(rates, F.col("source").eqNullSafe(F.col("rate_source")))
    u = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: _uniform("doc_id", i, seed=seed))
    counts = F.transform(u, lambda x: F.size(F.filter("sums", lambda c: c <= x)))
    drawn = drawn.withColumn("copies", F.aggregate(counts, F.lit(0), lambda a, b: a + b)).where("copies > 0")
    drawn = drawn.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    placed = drawn.withColumn("place", F.md5(F.concat_ws(
        ":", F.lit(seed + " place"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))))
    return placed.repartition("place").sortWithinPartitions("place")
