"""Cross-cluster and cross-cohort comparison of person-year metrics.

Each test reads its rows once: metrics are unpivoted, every moment a test needs
is one aggregate per (metric, cluster, cohort), and the rest is column algebra.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, tails
from ..functions.scalar import order_by_list, position_in

Metrics = Sequence[tuple[str, str]]


def assemble(features: DataFrame, yearly: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features (with labels) plus columns of the yearly roll-up, by person and year."""
    side = yearly.select("person_id", F.col("period").cast("int").alias("year"), *columns)
    return features.join(side, ["person_id", "year"], "left")


def stack_cohorts(*frames: DataFrame) -> DataFrame:
    """Union of cohorts by name; columns a cohort lacks are null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def metric_rows(df: DataFrame, metrics: Metrics, keep: Sequence[str]) -> DataFrame:
    present = [(label, c) for label, c in metrics if c in df.columns]
    values = df.select(*keep, *[F.col(c).cast("double").alias(label) for label, c in present])
    return values.unpivot(list(keep), [label for label, _ in present], "Metric", "value")


def concept_stats(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Mean concept density per cluster."""
    return df.groupBy(cluster).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def mean_table(df: DataFrame, cluster: str, metrics: Metrics, order: Sequence[str], decimals: int = 1) -> DataFrame:
    """Metric x cluster table of means."""
    rows = metric_rows(df, metrics, [cluster])
    wide = rows.groupBy("Metric").pivot(cluster, list(order)).agg(F.round(F.avg("value"), decimals))
    return order_by_list(wide, "Metric", [label for label, _ in metrics])


def anova(df: DataFrame, cluster: str, metrics: Metrics) -> DataFrame:
    """One-way F per metric from group sizes, means and variances."""
    rows = metric_rows(df, metrics, [cluster]).filter(
        F.col(cluster).isNotNull() & F.col("value").isNotNull()
    )
    groups = rows.groupBy("Metric", cluster).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("value").alias("mean"),
        F.var_samp("value").alias("var"),
    )
    w = Window.partitionBy("Metric")
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    gap = F.col("mean") - F.col("_grand")
    sums = groups.withColumn("_grand", grand).groupBy("Metric").agg(
        (F.count(F.lit(1)) - 1).cast("double").alias("df1"),
        (F.sum("n") - F.count(F.lit(1))).alias("df2"),
        F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)).alias("within"),
    )
    usable = (F.col("df1") >= 1) & (F.col("df2") > 0) & (F.col("within") > 0)
    f = (F.col("between") / F.col("df1")) / (F.col("within") / F.col("df2"))
    return sums.select("Metric", F.when(usable, f).alias("f"), "df1", "df2")


def _rss(c: dict[str, Column]) -> Column:
    """Residual sum of squares of y on (x, m) from centred cross products.

    A regressor without spread, or collinear with the other, drops out.
    """
    det = c["xx"] * c["mm"] - c["xm"] * c["xm"]
    both = c["yy"] - (
        c["xy"] * c["xy"] * c["mm"] - 2 * c["xy"] * c["my"] * c["xm"] + c["my"] * c["my"] * c["xx"]
    ) / det
    only_x = c["yy"] - c["xy"] * c["xy"] / c["xx"]
    only_m = c["yy"] - c["my"] * c["my"] / c["mm"]
    floor = 1e-9
    return (
        F.when(det > floor * c["xx"] * c["mm"], both)
        .when(c["xx"] > floor, only_x)
        .when(c["mm"] > floor, only_m)
        .otherwise(c["yy"])
    )


def cluster_effect(df: DataFrame, cluster: str, metrics: Metrics, cci: str = "prior_year_max_cci") -> DataFrame:
    """Partial F of the cluster given prior comorbidity and its missing flag.

    Cluster intercepts equal centring within clusters, so full and reduced
    residual sums both come from one set of per-cluster cross products.
    """
    rows = metric_rows(df, metrics, [cluster, cci]).filter(
        F.col(cluster).isNotNull() & F.col("value").isNotNull()
    )
    rows = rows.select(
        "Metric", cluster, F.col("value").alias("y"),
        F.coalesce(F.col(cci).cast("double"), F.lit(0.0)).alias("x"),
        F.col(cci).isNull().cast("double").alias("m"),
    )
    pairs = ("yy", "xx", "mm", "xm", "xy", "my")
    sums = rows.groupBy("Metric", cluster).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(v).alias(v) for v in "yxm"],
        *[F.sum(F.col(a[0]) * F.col(a[1])).alias(a) for a in pairs],
    )
    n = F.col("n")
    centred = [F.sum(F.col(a) - F.col(a[0]) * F.col(a[1]) / n).alias(f"w_{a}") for a in pairs]
    total = [
        (F.sum(a) - F.sum(a[0]) * F.sum(a[1]) / F.sum("n")).alias(f"t_{a}") for a in pairs
    ]
    per_metric = sums.groupBy("Metric").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), *centred, *total
    )
    full = _rss({a: F.col(f"w_{a}") for a in pairs})
    reduced = _rss({a: F.col(f"t_{a}") for a in pairs})
    out = per_metric.select(
        "Metric", full.alias("full"), reduced.alias("reduced"),
        (F.col("k") - 1).alias("df1"), (n - F.col("k") - 2).alias("df2"),
    )
    f = ((F.col("reduced") - F.col("full")) / F.col("df1")) / (F.col("full") / F.col("df2"))
    usable = (F.col("df1") > 0) & (F.col("df2") > 0) & (F.col("full") > 0)
    return out.select("Metric", F.when(usable & (f >= 0), f).alias("f"), "df1", "df2")


def with_f_p(stat: DataFrame, out: str = "p_value") -> DataFrame:
    return stat.withColumn(out, tails.f_p_value(F.col("f"), F.col("df1"), F.col("df2")))


def transposed_means(df: DataFrame, cluster: str, metrics: Metrics, order: Sequence[str]) -> DataFrame:
    """Mean table with unadjusted and comorbidity-adjusted p-value bands."""
    plain = with_f_p(anova(df, cluster, metrics)).select(
        "Metric", formats.p_band(F.col("p_value")).alias("p_value_unadjusted")
    )
    adjusted = with_f_p(cluster_effect(df, cluster, metrics)).select(
        "Metric", formats.p_band(F.col("p_value")).alias("p_value_adjusted")
    )
    wide = mean_table(df, cluster, metrics, order)
    joined = wide.join(plain, "Metric", "left").join(adjusted, "Metric", "left")
    return order_by_list(joined, "Metric", [label for label, _ in metrics])


def cohort_effect(df: DataFrame, cohort: str, metrics: Metrics, cohort_a: str = "cohort_1",
                  cohort_b: str = "cohort_2a", cci: str = "prior_year_max_cci",
                  adjust_for_days_observed: bool = False, adjust_for_year: bool = False,
                  y_transform: str = "none") -> DataFrame:
    """Partial F of the cohort given comorbidity and optional days observed and year.

    All cross products of all metrics come from one aggregate; the small normal
    equations are solved on that one row per metric.
    """
    extra = []
    if adjust_for_days_observed:
        extra.append("days_observed")
    if adjust_for_year:
        extra.append("year")
    rows = metric_rows(df, metrics, [cohort, cci, *extra]).filter(
        F.col(cohort).isin(cohort_a, cohort_b) & F.col("value").isNotNull()
    )
    terms = [
        F.lit(1.0),
        F.coalesce(F.col(cci).cast("double"), F.lit(0.0)),
        F.col(cci).isNull().cast("double"),
    ]
    if adjust_for_days_observed:
        terms.append(F.log1p(F.col("days_observed").cast("double")))
    if adjust_for_year:
        terms.append(F.col("year").cast("double") - 2000)  # shift is absorbed by the intercept
    terms.append((F.col(cohort) == cohort_b).cast("double"))
    y = F.log1p("value") if y_transform == "log1p" else F.col("value")
    names = [f"z{i}" for i in range(len(terms) + 1)]
    design = rows.select("Metric", *[t.alias(z) for t, z in zip([*terms, y], names)])
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    moments = design.groupBy("Metric").agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("moments"))
    size = len(names)

    @F.pandas_udf("reduced double, full double")
    def residual_sums(packed: pd.Series) -> pd.DataFrame:
        out = []
        for values in packed:
            s = np.zeros((size, size))
            s[np.triu_indices(size)] = values
            s = s + s.T - np.diag(np.diag(s))

            def rss(p: int) -> float:
                beta = np.linalg.lstsq(s[:p, :p], s[:p, -1], rcond=None)[0]
                return float(s[-1, -1] - s[:p, -1] @ beta)

            out.append((rss(size - 2), rss(size - 1)))
        return pd.DataFrame(out, columns=["reduced", "full"])

    solved = moments.withColumn("r", residual_sums("moments")).select(
        "Metric", "n", "r.*",
        F.lit(1.0).alias("df1"), (F.col("n") - (size - 1)).cast("double").alias("df2"),
    )
    f = (F.col("reduced") - F.col("full")) / (F.col("full") / F.col("df2"))
    usable = (F.col("df2") > 0) & (F.col("full") > 0) & (f >= 0)
    return solved.select("Metric", F.when(usable, f).alias("f"), "df1", "df2")


def _welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> tuple[Column, Column]:
    """(t, Satterthwaite degrees of freedom), null when undefined."""
    a, b = v1 / n1, v2 / n2
    ok = (n1 >= 2) & (n2 >= 2) & (a + b > 0)
    t = F.try_divide(m1 - m2, F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1))
    return F.when(ok, t), F.when(ok, dof)


def welch(df: DataFrame, cohort: str, metrics: Metrics, cohort_a: str = "cohort_1",
          cohort_b: str = "cohort_2a") -> DataFrame:
    """Welch t statistic between two cohorts per metric."""
    rows = metric_rows(df, metrics, [cohort])
    parts = []
    for side, name in (("a", cohort_a), ("b", cohort_b)):
        v = F.when(F.col(cohort) == name, F.col("value"))
        parts += [
            F.count(v).cast("double").alias(f"n_{side}"),
            F.avg(v).alias(f"mean_{side}"),
            F.var_samp(v).alias(f"var_{side}"),
        ]
    s = rows.groupBy("Metric").agg(*parts)
    c = F.col
    t, dof = _welch(c("mean_a"), c("var_a"), c("n_a"), c("mean_b"), c("var_b"), c("n_b"))
    return s.select("Metric", "mean_a", "mean_b", t.alias("t"), dof.alias("dof"))


def with_t_p(stat: DataFrame, t: str = "t", dof: str = "dof", out: str = "p_value") -> DataFrame:
    return stat.withColumn(out, tails.t_p_value(F.col(t), F.col(dof)))


def within_cluster_comparison(df: DataFrame, cohort: str, cluster: str, metrics: Metrics,
                              cohort_a: str = "cohort_1", cohort_b: str = "cohort_2a",
                              cci: str = "prior_year_max_cci", y_transform: str = "none") -> DataFrame:
    """Per metric and cluster: cohort means, their difference, and two Welch statistics.

    The first statistic compares the (optionally log1p) values; the second their
    residuals after one regression on prior comorbidity over both cohorts. Both
    follow from cohort sums, so the rows are read once.
    """
    rows = metric_rows(df, metrics, [cohort, cluster, cci]).filter(
        F.col(cluster).isNotNull() & F.col(cohort).isin(cohort_a, cohort_b)
    )
    y = F.log1p("value") if y_transform == "log1p" else F.col("value")
    base = rows.select(
        "Metric", F.col(cluster).alias("cluster_label"), F.col(cohort).alias("_cohort"), "value",
        y.alias("y"), F.when(y.isNotNull(), F.col(cci).cast("double")).alias("x"),
    )
    parts = []
    for side, name in (("a", cohort_a), ("b", cohort_b)):
        mine = F.col("_cohort") == name
        pair = mine & F.col("x").isNotNull() & F.col("y").isNotNull()

        def total(e: Column, cond: Column = pair) -> Column:
            return F.sum(F.when(cond, e))

        parts += [
            F.count(F.when(mine, F.col("value"))).alias(f"n_{side}"),
            F.avg(F.when(mine, F.col("value"))).alias(f"mean_{side}"),
            F.count(F.when(mine, F.col("y"))).cast("double").alias(f"tn_{side}"),
            F.avg(F.when(mine, F.col("y"))).alias(f"tm_{side}"),
            F.var_samp(F.when(mine, F.col("y"))).alias(f"tv_{side}"),
            F.count_if(pair).cast("double").alias(f"k_{side}"),
            total(F.col("x")).alias(f"x_{side}"),
            total(F.col("y")).alias(f"y_{side}"),
            total(F.col("x") * F.col("x")).alias(f"xx_{side}"),
            total(F.col("x") * F.col("y")).alias(f"xy_{side}"),
            total(F.col("y") * F.col("y")).alias(f"yy_{side}"),
        ]
    s = base.groupBy("Metric", "cluster_label").agg(*parts)
    line = s.selectExpr(
        "*",
        "k_a + k_b AS k",
        "try_divide(xy_a + xy_b - (x_a + x_b) * (y_a + y_b) / nullif(k_a + k_b, 0D), "
        "xx_a + xx_b - (x_a + x_b) * (x_a + x_b) / nullif(k_a + k_b, 0D)) AS slope",
    ).selectExpr("*", "(y_a + y_b - slope * (x_a + x_b)) / nullif(k, 0D) AS cut")
    sides = ("a", "b")
    fitted = line.selectExpr(
        "*",
        *[f"(y_{i} - cut * k_{i} - slope * x_{i}) / nullif(k_{i}, 0D) AS rm_{i}" for i in sides],
        *[
            f"(yy_{i} + cut * cut * k_{i} + slope * slope * xx_{i} - 2 * cut * y_{i} "
            f"- 2 * slope * xy_{i} + 2 * cut * slope * x_{i}) / nullif(k_{i} - 1, 0D) AS rv_{i}"
            for i in sides
        ],
    )
    c = F.col
    plain = _welch(c("tm_a"), c("tv_a"), c("tn_a"), c("tm_b"), c("tv_b"), c("tn_b"))
    spread = (c("tv_a") > 0) & (c("tv_b") > 0)
    resid = _welch(c("rm_a"), c("rv_a"), c("k_a"), c("rm_b"), c("rv_b"), c("k_b"))
    resid_spread = (c("rv_a") > 0) & (c("rv_b") > 0)
    return fitted.select(
        "Metric", "cluster_label",
        c("mean_a").alias(f"mean_{cohort_a}"), c("mean_b").alias(f"mean_{cohort_b}"),
        (c("mean_b") - c("mean_a")).alias("diff_mean"),
        F.nullif(c("n_a"), F.lit(0)).alias(f"n_{cohort_a}"),
        F.nullif(c("n_b"), F.lit(0)).alias(f"n_{cohort_b}"),
        F.when(spread, plain[0]).alias("t"), F.when(spread, plain[1]).alias("dof"),
        F.when(resid_spread, resid[0]).alias("t_adjusted"),
        F.when(resid_spread, resid[1]).alias("dof_adjusted"),
    )


ADJUSTED_P = "p_value_adjusted_for_prior_year_max_cci"


def comparison_p(stats: DataFrame) -> DataFrame:
    both = with_t_p(stats, out="p_value_unadjusted")
    return with_t_p(both, "t_adjusted", "dof_adjusted", ADJUSTED_P)


def cohort_sizes(df: DataFrame, cohort: str, cluster: str, cohorts: Sequence[str],
                 order: Sequence[str] | None = None) -> DataFrame:
    """Rows per cluster and cohort, one column per cohort."""
    kept = df.filter(F.col(cluster).isNotNull() & F.col(cohort).isNotNull())
    wide = (
        kept.groupBy(F.col(cluster).alias("cluster_label")).pivot(cohort, list(cohorts)).agg(F.count(F.lit(1)))
    )
    return order_by_list(wide, "cluster_label", order) if order else wide.orderBy("cluster_label")


def metric_matrix(long: DataFrame, value: str, order: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric x cluster table of one column of a long result."""
    wide = long.groupBy("Metric").pivot("cluster_label", list(order)).agg(F.first(value))
    return wide.orderBy(position_in("Metric", metrics), "Metric")


def publication_matrix(long: DataFrame, order: Sequence[str], metrics: Sequence[str],
                       p: str = ADJUSTED_P, decimals: int = 1, stars: bool = True) -> DataFrame:
    """Metric x cluster table of ``diff (p=...)`` cells."""
    cells = formats.with_diff_cell(long, "diff_mean", p, "cell", decimals, stars)
    return metric_matrix(cells, "cell", order, metrics)
