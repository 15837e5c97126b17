"""Rank statistics from value-frequency tables.

Rows are first reduced to (group, value, n), so ties and hot values collapse
before anything is ordered. Counts have few distinct values: events are
integers whose sum is the number of rows, so at most sqrt(2 * rows) of them
differ. For continuous scores pass ``buckets`` to cut the values at quantiles into
slices that are ordered in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _sliced(freq: DataFrame, groups: list[str], buckets: int) -> DataFrame:
    """Number the slices of each group's values, which hold about equally many distinct ones:
    splitters are approximate quantiles, so long tails fill no slice. A value is in one slice."""
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    split = freq.groupBy(*groups).agg(F.percentile_approx("value", shares, 100 * buckets).alias("_splits"))
    return freq.join(split, groups).withColumn(
        "_slice", F.size(F.filter("_splits", lambda s: s < F.col("value")))
    ).drop("_splits")


def cumulative(freq: DataFrame, groups: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``before`` (rows with a smaller value) and ``total`` per group.

    With ``buckets``, each slice is summed on its own and shifted by the total
    of the slices below it; whatever the splitters, the ranks are exact.
    """
    if not buckets:
        w = Window.partitionBy(*groups).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        return freq.withColumns(
            {
                "before": F.coalesce(F.sum("n").over(w), F.lit(0)),
                "total": F.sum("n").over(Window.partitionBy(*groups)),
            }
        )
    sliced = _sliced(freq, groups, buckets)
    within = (
        Window.partitionBy(*groups, "_slice")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    below = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*groups, "_slice")
        .agg(F.sum("n").alias("_slice_n"))
        .withColumns(
            {
                "_offset": F.coalesce(F.sum("_slice_n").over(below), F.lit(0)),
                "total": F.sum("_slice_n").over(Window.partitionBy(*groups)),
            }
        )
        .drop("_slice_n")
    )
    local = sliced.withColumn("_local", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return (
        local.join(offsets, [*groups, "_slice"])
        .withColumn("before", F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "_slice")
    )


def mid_rank() -> Column:
    return F.col("before") + (F.col("n") + 1) / 2


def _ranked(pairs: DataFrame, groups: list[str], value: str, out: str, buckets: int) -> DataFrame:
    counts = pairs.groupBy(*groups, F.col(value).alias("value")).agg(F.sum("n").alias("n"))
    cum = cumulative(counts, groups, buckets)
    centred = mid_rank() - (F.col("total") + 1) / 2
    return cum.select(*groups, F.col("value").alias(value), centred.alias(out))


def _rank_within(groups: list[str], value: str) -> Column:
    """Centred mid-rank of a value of the frequency table: rows up to it, less half its ties."""
    upto = Window.partitionBy(*groups).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = F.sum("n").over(Window.partitionBy(*groups, value))
    total = F.sum("n").over(Window.partitionBy(*groups))
    return F.sum("n").over(upto) - (ties - 1) / 2 - (total + 1) / 2


def spearman(df: DataFrame, groups: list[str], x: str, y: str, buckets: int | None = None) -> DataFrame:
    """Rank correlation per group over rows where both values are present.

    The rows become one (x, y) frequency table, from which both ranks follow. Without ``buckets``
    a group's table lies in one task and two windows rank it in place; its size is that
    of the distinct pairs. With ``buckets`` (continuous values) it is joined to two rank lookups.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(*groups, x, y).agg(F.count(F.lit(1)).alias("n"))
    if buckets:
        rx = _ranked(pairs, groups, x, "_rx", buckets)
        ry = _ranked(pairs, groups, y, "_ry", buckets)
        ranked = pairs.join(rx, [*groups, x]).join(ry, [*groups, y])
    else:
        dealt = pairs.repartition(*groups)  # the windows would each ask for layouts of their own
        ranked = dealt.withColumns({"_rx": _rank_within(groups, x), "_ry": _rank_within(groups, y)})
    n, a, b = F.col("n"), F.col("_rx"), F.col("_ry")
    spread = F.sqrt(F.sum(n * a * a)) * F.sqrt(F.sum(n * b * b))
    return ranked.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.try_divide(F.sum(n * a * b), spread).alias("spearman_rho")
    )


def rho_statistic() -> Column:
    """t statistic of a rank correlation on n-2 degrees of freedom."""
    rho, n = F.col("spearman_rho"), F.col("n")
    return rho * F.sqrt(F.try_divide((n - 2).cast("double"), (1 - rho) * (1 + rho)))


def group_rank_sums(df: DataFrame, scope: list[str], group: str, value: str, buckets: int | None = None) -> DataFrame:
    """Per scope and group: size and mid-rank sum in the pooled sample.

    Also carries the pooled size and the tie term of the scope. ``buckets``: see ``cumulative``.
    """
    freq = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*scope, group, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("m"))
    )
    pooled = cumulative(freq.groupBy(*scope, "value").agg(F.sum("m").alias("n")), scope, buckets)
    t = F.col("n").cast("double")
    ties = pooled.groupBy(*scope).agg(F.sum(t * t * t - t).alias("tie_term"))
    return (
        freq.join(pooled, [*scope, "value"])
        .groupBy(*scope, group)
        .agg(
            F.sum("m").alias("group_n"),
            F.sum(F.col("m") * mid_rank()).alias("rank_sum"),
            F.max("total").alias("total_n"),
            F.sum(F.col("m") * (F.col("before") + F.col("n") / 2)).alias("u_vs_all"),
            F.countDistinct("value").alias("group_values"),
        )
        .join(ties, scope)
    )


def kruskal_wallis(sums: DataFrame, scope: list[str]) -> DataFrame:
    """Tie-corrected H over groups; null below two groups or without spread."""
    size = F.max("total_n").cast("double")
    grouped = sums.groupBy(*scope).agg(
        size.alias("_n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("group_n")).alias("_between"),
        F.max("tie_term").alias("_ties"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    n = F.col("_n")
    raw = 12 / (n * (n + 1)) * F.col("_between") - 3 * (n + 1)
    correction = 1 - F.try_divide(F.col("_ties"), n * n * n - n)
    return grouped.select(
        *scope,
        F.when(F.col("n_groups") >= 2, F.try_divide(raw, correction)).alias("kw_statistic"),
        "n_groups",
    )


def rank_biserial(sums: DataFrame) -> DataFrame:
    """Effect of each group against the whole sample, +1 = group higher.

    ``rank_biserial_ref`` keeps the opposite-signed literal form. Undefined
    below two rows; 0 when group and sample are one constant.
    """
    n1, n2 = F.col("group_n"), F.col("total_n")
    effect = 2 * F.col("u_vs_all") / (n1 * n2) - 1
    value = F.when((n1 >= 2) & (n2 >= 2), effect)
    return sums.withColumns({"rank_biserial": value, "rank_biserial_ref": -value})
