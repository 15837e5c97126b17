"""Cluster description and separation.

Everything is aggregates per cluster; the only row-level joins are against one
row per cluster, which is what the broadcasts below carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import PROFILE_FEATURES


def valid_clusters(df: DataFrame, cluster: str) -> DataFrame:
    """Rows with a cluster that is not the outlier mark -1."""
    return df.filter(F.col(cluster).isNotNull() & (F.col(cluster).cast("string") != "-1"))


def composition_text(df: DataFrame, cluster: str, label: str, out: str = "archetype_composition") -> DataFrame:
    """``label pct%; ...`` per cluster, largest share first."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * 100 / F.sum("n").over(Window.partitionBy(cluster))
    ranked = counts.withColumn("_share", share)
    entries = F.sort_array(F.collect_list(F.struct((-F.col("_share")).alias("s"), F.col(label).alias("l"))))
    text = F.transform(
        entries, lambda e: F.concat(e["l"], F.lit(" "), F.round(-e["s"], 1).cast("string"), F.lit("%"))
    )
    return ranked.groupBy(cluster).agg(F.array_join(text, "; ").alias(out))


def profiles(df: DataFrame, cluster: str, method: str, label: str | None = None,
             features: Sequence[str] = PROFILE_FEATURES) -> DataFrame:
    """Size, mean/min/max of the features and comorbidity bands of each cluster."""
    rows = df.filter(F.col(cluster).isNotNull())
    cci = F.col("max_cci")
    bands = {
        "None": cci == 0,
        "Low": cci.between(1, 2),
        "Moderate": cci.between(3, 4),
        "High": cci.isNull() | (cci > 4) | (cci < 0),
    }
    aggregates = [F.count(F.lit(1)).alias("n")]
    for f in features:
        aggregates += [F.avg(f).alias(f"{f}_mean"), F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max")]
    aggregates += [(F.count_if(test) * 100 / F.count(F.lit(1))).alias(band) for band, test in bands.items()]
    out = rows.groupBy(cluster).agg(*aggregates)
    if label:
        out = out.join(composition_text(rows, cluster, label), cluster, "left")
    return out.withColumn("method", F.lit(method))


def stats_text(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """``mean (Q1–Q3)`` per cluster and feature."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for f in features:
        q = F.percentile(f, F.array(F.lit(0.25), F.lit(0.75)))
        text = F.format_string("%.2f (%.2f–%.2f)", F.avg(f), q[0], q[1])
        aggregates.append(F.when(F.count(f) > 0, text).otherwise("N/A").alias(f))
    return valid_clusters(df, cluster).groupBy(cluster).agg(*aggregates)


def summary(df: DataFrame, cluster: str, features: Sequence[str] = PROFILE_FEATURES) -> DataFrame:
    """Mean, median and min–max of each feature per cluster."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for f in features:
        bounds = F.format_string("%.0f–%.0f", F.min(f).cast("double"), F.max(f).cast("double"))
        aggregates += [
            F.avg(f).alias(f"{f}_mean"),
            F.percentile(f, 0.5).alias(f"{f}_median"),
            F.when(F.count(f) > 0, bounds).otherwise("N/A").alias(f"{f}_range"),
        ]
    return valid_clusters(df, cluster).groupBy(cluster).agg(*aggregates)


def _variance(n: Column, s: Column, q: Column) -> Column:
    return F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))).otherwise(0.0)


def importance(df: DataFrame, cluster: str, features: Sequence[str], method: str) -> DataFrame:
    """Cohen's d of each cluster against the rest, per feature.

    One aggregation gives count, sum and sum of squares per cluster; the rest
    is the total over clusters minus the cluster itself.
    """
    parts = []
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        parts += [F.sum(x).alias(f"{f}__s"), F.sum(x * x).alias(f"{f}__q")]
    sums = df.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *parts
    )
    entries = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"{f}__s").alias("s"), F.col(f"{f}__q").alias("q"))
            for f in features
        ]
    )
    long = sums.select("cluster", "n", F.inline(entries))
    whole = Window.partitionBy("feature")
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    total = long.withColumns(
        {"tn": F.sum("n").over(whole), "ts": F.sum("s").over(whole), "tq": F.sum("q").over(whole)}
    ).filter(F.col("cluster").isNotNull())
    rest_n, rest_s, rest_q = F.col("tn") - n, F.col("ts") - s, F.col("tq") - q
    mine, rest = _variance(n, s, q), _variance(rest_n, rest_s, rest_q)
    rest_mean = F.coalesce(F.try_divide(rest_s, rest_n), F.lit(0.0))
    pooled = F.sqrt(F.try_divide((n - 1) * mine + (rest_n - 1) * rest, n + rest_n - 2))
    usable = (n > 1) & (rest_n > 1)
    effect = F.abs(F.try_divide(s / n - rest_mean, pooled))
    return total.select(
        F.lit(method).alias("method"),
        "cluster",
        "feature",
        F.when(usable, F.coalesce(effect, F.lit(0.0))).otherwise(0.0).alias("cohens_d"),
        (s / n).alias("cluster_mean"),
        F.sqrt(mine).alias("cluster_std"),
        (F.col("ts") / F.col("tn")).alias("global_mean"),
        F.sqrt(_variance(F.col("tn"), F.col("ts"), F.col("tq"))).alias("global_std"),
        F.when(usable, pooled).otherwise(0.0).alias("pooled_std"),
        rest_mean.alias("rest_mean"),
        F.sqrt(rest).alias("rest_std"),
    )


def centroids(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    return valid_clusters(df, cluster).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("cluster_n"), *[F.avg(f).alias(f"{f}__c") for f in features]
    )


def _squared(features: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for f in features:
        gap = F.col(f) - F.col(f"{f}__c")
        total = total + gap * gap
    return total


def _with_centroid(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Attach each row's own centroid: one broadcast row per cluster."""
    return valid_clusters(df, cluster).join(F.broadcast(centroids(df, cluster, features)), cluster)


def medoids(df: DataFrame, cluster: str, features: Sequence[str], method: str) -> DataFrame:
    """The row nearest to each centroid; ties go to the lowest person and year."""
    near = _with_centroid(df, cluster, features).withColumn("_d", F.sqrt(_squared(features)))
    best = F.min(F.struct(F.round("_d", 9).alias("d"), "person_id", "year"))
    return near.groupBy(cluster).agg(best.alias("b")).select(
        F.lit(method).alias("method"),
        F.col(cluster).cast("string").alias("cluster"),
        "b.person_id",
        "b.year",
        F.col("b.d").alias("distance_to_centroid"),
    )


def davies_bouldin(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / distance_ij."""
    spread = _with_centroid(df, cluster, features).groupBy(cluster).agg(
        F.avg(F.sqrt(_squared(features))).alias("spread"),
        F.array(*[F.first(f"{f}__c") for f in features]).alias("center"),
    )
    table = spread.agg(F.collect_list(F.struct(F.col(cluster).alias("id"), "spread", "center")).alias("all"))

    def distance(a: Column, b: Column) -> Column:
        squares = F.zip_with(a["center"], b["center"], lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))

    def worst(a: Column) -> Column:
        others = F.filter("all", lambda b: b["id"] != a["id"])
        return F.array_max(F.transform(others, lambda b: F.try_divide(a["spread"] + b["spread"], distance(a, b))))

    ratios = F.transform("all", worst)
    k = F.size("all")
    total = F.aggregate(ratios, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return table.select(F.when(k >= 2, total / k).alias("davies_bouldin_index"), k.alias("n_clusters"))


def _weighted_vectors(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return (
        valid_clusters(df, cluster)
        .groupBy(F.col(cluster).cast("string").alias("cluster"), vector.alias("vector"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _silhouette_of(own: Column, other: Column, size: Column) -> Column:
    top = F.greatest(own, other)
    return F.when(size <= 1, 0.0).otherwise(F.coalesce(F.try_divide(other - own, top), F.lit(0.0)))


def silhouette_squared(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Mean silhouette per cluster under squared Euclidean distance.

    The mean squared distance to a cluster follows from its size, mean and mean
    squared norm, so the cost is linear in distinct vectors.
    """
    vectors = _weighted_vectors(df, cluster, features)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    moments = vectors.groupBy("cluster").agg(
        F.sum("n").alias("size"),
        (F.sum(F.col("n") * norm) / F.sum("n")).alias("norm"),
        F.array(
            *[F.sum(F.col("n") * F.col("vector")[i]) / F.sum("n") for i in range(len(features))]
        ).alias("mean"),
    )
    table = moments.agg(
        F.collect_list(F.struct(F.col("cluster").alias("id"), "size", "norm", "mean")).alias("all")
    ).withColumn("scope", F.lit(1))

    def mean_distance(c: Column) -> Column:
        products = F.zip_with("vector", c["mean"], lambda x, y: x * y)
        dot = F.aggregate(products, F.lit(0.0), lambda s, v: s + v)
        return F.greatest(norm - dot * 2 + c["norm"], F.lit(0.0))

    joined = vectors.withColumn("scope", F.lit(1)).join(F.broadcast(table), "scope")
    mine = F.element_at(F.filter("all", lambda c: c["id"] == F.col("cluster")), 1)
    scored = joined.withColumns(
        {
            "own_size": mine["size"],
            "own": mean_distance(mine) * F.try_divide(mine["size"], mine["size"] - 1),
            "other": F.array_min(
                F.transform(F.filter("all", lambda c: c["id"] != F.col("cluster")), mean_distance)
            ),
        }
    )
    return _mean_silhouette(scored)


def _mean_silhouette(scored: DataFrame) -> DataFrame:
    s = _silhouette_of(F.col("own"), F.col("other"), F.col("own_size"))
    return scored.groupBy("cluster").agg(
        (F.sum(s * F.col("n")) / F.sum("n")).alias("silhouette_mean"),
        F.sum("n").alias("cluster_size"),
    )


def analyse(df: DataFrame, cluster: str, method: str, features: Sequence[str],
            label: str | None = None) -> dict[str, DataFrame]:
    """Profiles, medoids, separation and importance of one labelling."""
    separation = silhouette_squared(df, cluster, features).withColumn("scope", F.lit(1)).join(
        F.broadcast(davies_bouldin(df, cluster, features).withColumn("scope", F.lit(1))), "scope"
    )
    return {
        "profiles": profiles(df, cluster, method, label),
        "medoids": medoids(df, cluster, features, method),
        "separation": separation.select(
            F.lit(method).alias("method"), "cluster", "silhouette_mean", "cluster_size",
            "davies_bouldin_index",
        ),
        "importance": importance(df, cluster, features, method),
    }
