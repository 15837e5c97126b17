"""Agreement between labellings, from contingency tables.

Rows are reduced to label-pair counts map-side in one pass for all method
pairs; every measure is then arithmetic on a table of label combinations.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quality, rules
from .quality import valid_clusters


def label_column(method: str, columns: Sequence[str]) -> str | None:
    """Label column of a method: display label, then relabelled, then raw cluster."""
    suffixes = ("_cluster",) if method.startswith("rules") else ("_label", "_relabeled", "_cluster")
    return next((method + s for s in suffixes if method + s in columns), None)


def contingency(df: DataFrame, methods: Mapping[str, str]) -> DataFrame:
    """Counts per (method1, method2, a, b) for every pair of labelled methods.

    Rows where either label is missing or ``Unknown`` are left out of that pair. Equal rows
    of labels are counted first, so that only their combinations are laid out by pair.
    """
    labels = list(dict.fromkeys(methods.values()))
    counted = df.groupBy(*labels).agg(F.count(F.lit(1)).alias("_rows"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(m1).alias("method1"),
                F.lit(m2).alias("method2"),
                F.col(methods[m1]).cast("string").alias("a"),
                F.col(methods[m2]).cast("string").alias("b"),
            )
            for m1, m2 in combinations(methods, 2)
        ]
    )
    return (
        counted.select("_rows", F.inline(pairs))
        .filter((F.col("a") != "Unknown") & (F.col("b") != "Unknown"))
        .groupBy("method1", "method2", "a", "b")
        .agg(F.sum("_rows").alias("n"))
    )


_PAIR = ["method1", "method2"]


def with_margins(cells: DataFrame) -> DataFrame:
    w = Window.partitionBy(*_PAIR)
    return cells.withColumns(
        {
            "row_n": F.sum("n").over(Window.partitionBy(*_PAIR, "a")),
            "col_n": F.sum("n").over(Window.partitionBy(*_PAIR, "b")),
            "total": F.sum("n").over(w),
        }
    )


def confusion(cells: DataFrame) -> DataFrame:
    """Counts with row percentages."""
    return with_margins(cells).select(
        *_PAIR, "a", "b", "n", (F.col("n") * 100 / F.col("row_n")).alias("row_pct")
    )


def _pairs_of(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def pair_scores(cells: DataFrame, min_rows: int = 10) -> DataFrame:
    """Rows, agreement, adjusted Rand index and Cohen's kappa per method pair.

    Each cell feeds its row label and its column label; summing per label gives
    both margins side by side, so one pass over the cells serves every measure.
    """
    n = F.col("n")
    sides = F.array(
        F.struct(F.col("a").alias("label"), n.alias("x"), (n * 0).alias("y"), _pairs_of(n).alias("both"),
                 F.when(F.col("a") == F.col("b"), n).otherwise(0).alias("same")),
        F.struct(F.col("b").alias("label"), (n * 0).alias("x"), n.alias("y"), F.lit(0.0).alias("both"),
                 (n * 0).alias("same")),
    )
    labels = cells.select(*_PAIR, F.inline(sides)).groupBy(*_PAIR, "label").agg(
        *[F.sum(c).alias(c) for c in ("x", "y", "both", "same")]
    )
    x, y = F.col("x"), F.col("y")
    pairs = labels.groupBy(*_PAIR).agg(
        F.sum("x").alias("n_rows"),
        F.sum("both").alias("both"),
        F.sum("same").alias("same"),
        F.sum(_pairs_of(x)).alias("row_pairs"),
        F.sum(_pairs_of(y)).alias("col_pairs"),
        F.sum(x.cast("double") * y).alias("chance"),
    )
    expected = F.try_divide(F.col("row_pairs") * F.col("col_pairs"), _pairs_of(F.col("n_rows")))
    spread = (F.col("row_pairs") + F.col("col_pairs")) / 2 - F.col("expected")
    ari = F.when(spread == 0, 1.0).otherwise(F.try_divide(F.col("both") - F.col("expected"), spread))
    size = F.col("n_rows").cast("double")
    observed, pe = F.col("same") / size, F.col("chance") / (size * size)
    enough = F.col("n_rows") >= min_rows
    return pairs.withColumn("expected", expected).select(
        *_PAIR,
        "n_rows",
        F.when(enough, ari).alias("ari"),
        F.when(enough, observed).alias("agreement"),
        F.when(enough, F.try_divide(observed - pe, 1 - pe)).alias("kappa"),
    )


_EXACT_FACTORIALS = 20
_NEGLIGIBLE = 80.0  # a bound e^-80 on what lies outside the summed range


def stirling_error(n: Column) -> Column:
    """ln(n!) less Stirling's n ln n - n + ln(2 pi n) / 2, for n >= 1: exact for small n, then its series."""
    x = n.cast("double")
    table = F.array(*[
        F.lit(math.lgamma(i + 1) - (i * math.log(i) - i + math.log(2 * math.pi * i) / 2) if i else 0.0)
        for i in range(_EXACT_FACTORIALS)
    ])
    x2 = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x2)) / x2) / x2) / x
    return F.when(n < _EXACT_FACTORIALS, table[n.cast("int")]).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x without the cancellation of its parts near the mean."""
    d = (x - mean) / mean
    near = d * d * (1 / 2 - d * (1 / 6 - d * (1 / 12 - d * (1 / 20 - d * (1 / 30 - d / 42)))))
    far = (1 + d) * F.log1p(d) - d
    return F.when(x == 0, mean).otherwise(mean * F.when(F.abs(d) < 1e-3, near).otherwise(far))


def _log_binomial(k: Column, n: Column, p: Column, q: Column) -> Column:
    """ln of the binomial weight of k of n, from differences that stay small at any n."""
    k, n = k.cast("double"), n.cast("double")
    rest = n - k
    inner = (
        stirling_error(n) - stirling_error(k) - stirling_error(rest)
        - _deviance(k, n * p) - _deviance(rest, n * q)
        - F.log(k * rest / n * (2 * math.pi)) / 2
    )
    return F.when(n == 0, 0.0).when(k == 0, n * F.log(q)).when(rest == 0, n * F.log(p)).otherwise(inner)


def log_cell_weight(k: Column, row: Column, col: Column, total: Column) -> Column:
    """ln of the chance of k in a cell with these margins (hypergeometric), for ``col`` below
    ``total``. Written as binomial weights with the share col / total, so no large logarithms cancel."""
    p, q = col / total.cast("double"), (total - col) / total.cast("double")
    return _log_binomial(k, row, p, q) + _log_binomial(col - k, total - row, p, q) - _log_binomial(col, total, p, q)


def cell_counts(margins: DataFrame, x: str, y: str, total: str, chunk: int) -> DataFrame:
    """A row for every count ``k`` that a cell with margins ``x`` and ``y`` may hold.

    Only counts around the mean are listed: by Bernstein's bound the others together weigh
    less than 2 e^-80, below the rounding of the sum. Ranges are cut into chunks and spread before
    they are expanded, so one large cell is not one task.
    """
    a, b, n = F.col(x), F.col(y), F.col(total)
    mean = a.cast("double") * b / n
    spread = mean * F.least(1 - a / n, 1 - b / n)
    reach = F.ceil(_NEGLIGIBLE / 3 + F.sqrt((_NEGLIGIBLE / 3) ** 2 + 2 * _NEGLIGIBLE * spread))
    low = F.greatest(F.lit(1), a + b - n, F.floor(mean) - reach).cast("bigint")
    high = F.least(a, b, F.ceil(mean) + reach).cast("bigint")
    ranges = margins.withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    starts = ranges.select("*", F.explode(F.sequence("_low", "_high", F.lit(chunk).cast("bigint"))).alias("_start"))
    dealt = starts.repartition(margins.sparkSession.sparkContext.defaultParallelism, x, y, "_start")
    last = F.least(F.col("_start") + (chunk - 1), F.col("_high"))
    return dealt.withColumn("k", F.explode(F.sequence("_start", last))).drop("_low", "_high", "_start")


def adjusted_mutual_information(cells: DataFrame, chunk: int = 65536) -> DataFrame:
    """AMI (arithmetic-mean normaliser) per method pair.

    The expected information sums a hypergeometric term per possible cell
    count, once for each distinct pair of margins.
    """
    n, row, col, total = F.col("n"), F.col("row_n"), F.col("col_n"), F.col("total").cast("double")
    per_pair = with_margins(cells).groupBy(*_PAIR).agg(
        F.sum(n / total * F.log(total * n / (row.cast("double") * col))).alias("mi"),
        (-F.sum(n / total * F.log(row / total))).alias("h_a"),
        (-F.sum(n / total * F.log(col / total))).alias("h_b"),
        F.max("total").alias("total"),
        F.collect_set(F.struct("a", "row_n")).alias("rows"),
        F.collect_set(F.struct("b", "col_n")).alias("cols"),
    )
    carried = [*_PAIR, "mi", "h_a", "h_b", "total"]
    rows = per_pair.select(*carried, "cols", F.explode("rows").alias("r"))
    margins = (
        rows.select(*carried, F.col("r.row_n").alias("x"), F.explode("cols").alias("c"))
        .select(*carried, "x", F.col("c.col_n").alias("y"))
        .groupBy(*carried, "x", "y")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    x, y, k, size = F.col("x"), F.col("y"), F.col("k"), F.col("total").cast("double")
    weight = F.when(F.col("y") == F.col("total"), 1.0).otherwise(F.exp(log_cell_weight(k, x, y, F.col("total"))))
    term = F.col("times") * k / size * F.log(size * k / (x.cast("double") * y)) * weight
    norm = (F.col("h_a") + F.col("h_b")) / 2
    return (
        cell_counts(margins, "x", "y", "total", chunk)
        .groupBy(*carried)
        .agg(F.sum(term).alias("emi"))
        .select(
            *_PAIR, "mi", "emi",
            F.when(norm == F.col("emi"), 1.0)
            .otherwise(F.try_divide(F.col("mi") - F.col("emi"), norm - F.col("emi")))
            .alias("ami"),
        )
    )


def matrices(scores: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Symmetric long matrix of ARI and agreement, with a unit diagonal."""
    from ..functions.local import small_table

    one = scores.select("method1", "method2", "ari", "agreement")
    other = scores.select(F.col("method2").alias("method1"), F.col("method1").alias("method2"), "ari", "agreement")
    diagonal = small_table(
        scores.sparkSession, [(m, m, 1.0, 1.0) for m in methods],
        "method1 string, method2 string, ari double, agreement double",
    )
    return one.unionByName(other).unionByName(diagonal)


def consistency(scores: DataFrame, information: DataFrame, first: str = "rules_vanilla",
                second: str = "rules_adaptive") -> DataFrame:
    """ARI and AMI of two rule runs against each data-driven method, and their change."""
    both = scores.select(*_PAIR, "ari").join(information.select(*_PAIR, "ami"), _PAIR)
    wide = both.filter(
        F.col("method1").isin(first, second) & ~F.col("method2").isin(first, second)
    ).groupBy(F.col("method2").alias("method")).agg(
        *[
            F.max(F.when(F.col("method1") == run, F.col(v))).alias(f"{v}_{name}")
            for v in ("ari", "ami")
            for run, name in ((first, "vanilla"), (second, "adaptive"))
        ]
    )
    return wide.withColumns({f"{v}_delta": F.col(f"{v}_adaptive") - F.col(f"{v}_vanilla") for v in ("ari", "ami")})


# cluster composition ----------------------------------------------------


def composition(df: DataFrame, cluster: str, reference: str) -> DataFrame:
    """Counts and row percentages of reference labels per cluster."""
    counts = (
        valid_clusters(df, cluster)
        .filter(F.col(reference).isNotNull())
        .groupBy(cluster, F.col(reference).alias("reference"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(cluster)))


def relabel(comp: DataFrame, cluster: str, threshold: float = 50.0) -> DataFrame:
    """Name clusters by their reference mix.

    One label at or above the threshold names the cluster; otherwise the top
    two together, if they reach it; otherwise ``Mixed``.
    """
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("pct"), "reference"))
    top = comp.withColumn("_rank", rank).filter("_rank <= 2").groupBy(cluster).agg(
        F.max(F.when(F.col("_rank") == 1, F.col("reference"))).alias("first"),
        F.max(F.when(F.col("_rank") == 1, F.col("pct"))).alias("first_pct"),
        F.max(F.when(F.col("_rank") == 2, F.col("reference"))).alias("second"),
        F.sum("pct").alias("top_pct"),
    )
    dominant = F.when(F.col("first_pct") >= threshold, F.col("first"))
    joint = F.when(
        F.col("top_pct") >= threshold, F.concat_ws(" + ", F.col("first"), F.col("second"))
    )
    return top.select(
        cluster,
        F.coalesce(dominant, joint, F.lit("Mixed")).alias("relabeled"),
        dominant.alias("dominant"),
        F.col("first_pct").alias("purity"),
    )


def apply_labels(df: DataFrame, labels: DataFrame, method: str) -> DataFrame:
    """Add ``<method>_relabeled`` and ``<method>_label`` ("id: name"); Unknown if unmapped."""
    cluster = f"{method}_cluster"
    names = labels.select(cluster, F.col("relabeled").alias("_name"))
    name = F.coalesce(F.col("_name"), F.lit("Unknown"))
    shown = F.concat(F.col(cluster).cast("string"), F.lit(": "), F.col("_name"))
    return df.join(F.broadcast(names), cluster, "left").withColumns(
        {f"{method}_relabeled": name, f"{method}_label": F.coalesce(shown, F.lit("Unknown"))}
    ).drop("_name")


def flow_labels(df: DataFrame, cluster: str, reference: str, minimum: float = 5.0) -> DataFrame:
    """``pct% label + ...``: share of each reference label flowing into the cluster."""
    counts = composition(df, cluster, reference)
    flow = counts.withColumn("flow", F.col("n") * 100 / F.sum("n").over(Window.partitionBy("reference")))
    kept = flow.filter(F.col("flow") >= minimum)
    entries = F.sort_array(F.collect_list(F.struct((-F.col("flow")).alias("f"), "reference")))
    text = F.transform(entries, lambda e: F.concat(F.format_string("%.0f%% ", -e["f"]), e["reference"]))
    named = kept.groupBy(cluster).agg(F.array_join(text, " + ").alias("flow_label"))
    every = counts.select(cluster).distinct()
    return every.join(named, cluster, "left").fillna("Mixed", ["flow_label"])


def split_table(df: DataFrame, coarse: str, fine: str, threshold: float = 15.0) -> DataFrame:
    """How each coarse cluster divides over fine clusters."""
    shares = composition(df, coarse, fine)
    text = F.format_string("GMM7-%s (%.0f%%)", F.col("reference").cast("string"), F.col("pct"))
    major = F.when(F.col("pct") >= threshold, F.struct((-F.col("pct")).alias("p"), "reference", text.alias("t")))
    listed = shares.groupBy(coarse).agg(F.sort_array(F.collect_list(major)).alias("major"))
    size = F.size("major")
    return listed.select(
        coarse,
        F.when(size > 1, "Splits").when(size == 1, "Maps to").otherwise("Diffuse").alias("split_type"),
        F.when(size > 0, F.array_join(F.transform("major", lambda m: m["t"]), ", "))
        .otherwise("Distributed")
        .alias("maps_to"),
    )


def scorecard(df: DataFrame, methods: Mapping[str, str], reference: str, references: Sequence[str],
              separation: DataFrame | None = None, agreement: str | None = None) -> DataFrame:
    """One row per method: coverage, sizes, purity, agreement and separation."""
    total = F.col("_total")
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("method"), F.col(c).cast("string").alias("cluster"),
                F.col(methods[reference]).alias("reference"),
                (F.col(agreement) if agreement else F.lit(None).cast("double")).alias("agree"),
            )
            for m, c in methods.items()
        ]
    )
    cells = df.select(F.inline(entries)).groupBy("method", "cluster", "reference").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("agree").alias("agree_sum"),
        F.count("agree").alias("agree_n"),
        F.count_if(F.col("agree") >= 0.75).alias("agree_high"),
    )
    inlier = F.col("cluster").isNotNull() & (F.col("cluster") != "-1")
    best = F.max(F.when(F.col("reference").isNotNull(), F.col("n")))
    clusters = cells.groupBy("method", "cluster").agg(
        F.sum("n").alias("n"),
        (best * 100 / F.sum(F.when(F.col("reference").isNotNull(), F.col("n")))).alias("purity"),
        F.sum("agree_sum").alias("agree_sum"),
        F.sum("agree_n").alias("agree_n"),
        F.sum("agree_high").alias("agree_high"),
    )
    size = F.when(inlier, F.col("n"))
    purity = F.when(inlier, F.col("purity"))
    cards = clusters.groupBy("method").agg(
        F.sum("n").alias("_total"),
        F.coalesce(F.sum(size), F.lit(0)).alias("person_years_inliers"),
        F.coalesce(F.sum(F.when(F.col("cluster") == "-1", F.col("n"))), F.lit(0)).alias("_outliers"),
        F.count(size).alias("n_clusters"),
        F.percentile(size, 0.5).alias("median_cluster_size"),
        F.min(size).alias("min_cluster_size"),
        F.max(size).alias("max_cluster_size"),
        F.try_divide(F.stddev_samp(size), F.avg(size)).alias("cv_cluster_size"),
        F.avg(purity).alias("mean_cluster_purity_vs_rules"),
        F.percentile(purity, 0.5).alias("median_cluster_purity_vs_rules"),
        F.count_if(purity >= 70).alias("n_pure_clusters_vs_rules"),
        F.try_divide(F.sum(F.when(inlier, F.col("agree_sum"))), F.sum(F.when(inlier, F.col("agree_n")))).alias(
            "mean_patient_agreement"
        ),
        (F.try_divide(F.sum(F.when(inlier, F.col("agree_high"))), F.sum(F.when(inlier, F.col("agree_n")))) * 100).alias(
            "pct_patients_agreement_ge_0_75"
        ),
    )
    out = cards.select(
        "method",
        F.when(F.col("method").startswith("rules"), "rules").otherwise("gmm").alias("method_type"),
        "person_years_inliers",
        (F.col("person_years_inliers") * 100 / total).alias("pct_person_years_inliers"),
        (F.col("_outliers") * 100 / total).alias("pct_person_years_outliers"),
        "n_clusters", "median_cluster_size", "min_cluster_size", "max_cluster_size", "cv_cluster_size",
        "mean_cluster_purity_vs_rules", "median_cluster_purity_vs_rules", "n_pure_clusters_vs_rules",
        (F.col("n_pure_clusters_vs_rules") * 100 / F.col("n_clusters")).alias("pct_pure_clusters_vs_rules"),
        "mean_patient_agreement", "pct_patients_agreement_ge_0_75",
    )
    grid = matrices(pair_scores(contingency(df, methods)), list(methods))
    for ref in references:
        side = grid.filter(F.col("method2") == ref).select(
            F.col("method1").alias("method"),
            F.col("ari").alias(f"ari_vs_{ref}"),
            (F.col("agreement") * 100).alias(f"agree_vs_{ref}_pct"),
        )
        out = out.join(side, "method", "left")
    if separation is not None:
        index = separation.select("method", "davies_bouldin_index").distinct()
        out = out.join(index, "method", "left")
    return out


def run_comparison(agreement: DataFrame, transitions: DataFrame, separation: DataFrame) -> DataFrame:
    """Scorecard of two rule runs from three one-row tables with columns vanilla, adaptive."""

    def card(df: DataFrame, name: str, better: str) -> DataFrame:
        a, v = F.col("adaptive"), F.col("vanilla")
        win = {"tie": F.lit(False), "low": a < v, "high": a > v}[better]
        winner = F.lit("Tie") if better == "tie" else F.when(win, "Adaptive").otherwise("Vanilla")
        return df.select(F.lit(name).alias("dimension"), "vanilla", "adaptive", winner.alias("winner"))

    return (
        card(agreement, "Coverage (Agreement)", "tie")
        .unionByName(card(transitions, "Stability (Transition Rate, lower=better)", "low"))
        .unionByName(card(separation, "Separation (Mean |Cohen d|, higher=better)", "high"))
    )


def compare_runs(vanilla: DataFrame, adaptive: DataFrame, features: Sequence[str], label: str = "archetype") -> DataFrame:
    """Scorecard of two tracked rule runs over the same person-years: their agreement, the
    share of changes from year to year, and the mean effect size of the features."""
    frames = {"vanilla": vanilla, "adaptive": adaptive}
    both = vanilla.select("person_id", "year", F.col(label).alias("a")).join(
        adaptive.select("person_id", "year", F.col(label).alias("b")), ["person_id", "year"])
    same = F.avg((F.col("a") == F.col("b")).cast("int")) * 100
    agreement = both.agg(same.alias("vanilla"), same.alias("adaptive"))

    def one_row(values: dict[str, DataFrame]) -> DataFrame:
        first, second = [df.toDF("v").select(F.lit(run).alias("run"), "v") for run, df in values.items()]
        return first.unionByName(second).agg(*[F.max(F.when(F.col("run") == run, F.col("v"))).alias(run) for run in values])

    moves = {run: rules.transition_rate(df).select("pct_changed") for run, df in frames.items()}
    gaps = {run: quality.importance(df, label, features, run).groupBy("feature").agg(F.avg("cohens_d").alias("d")).agg(F.avg("d"))
            for run, df in frames.items()}
    return run_comparison(agreement, one_row(moves), one_row(gaps))
