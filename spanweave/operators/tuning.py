"""Automatic choice of the irregularity penalty and rule threshold.

One scan per question: a threshold grid becomes a histogram over grid slots
plus cumulative sums, never rows times grid.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import ARCHETYPES
from ..functions.local import small_table
from . import ranks, rules
from .features import with_irregularity_score
from .sampling import one_year_per_person

AGREEMENT_CUTS = (0.3, 0.4, 0.5, 0.6, 0.7)
_SCORED = ("Regular Frequent", "Regular Infrequent", "Irregular Frequent", "Irregular Infrequent")


def grid(low: float, high: float, step: float) -> list[float]:
    step = max(step, 1e-3)
    return [float(t) for t in np.round(np.arange(low, high + step / 2, step), 6)]


def threshold_curve(features: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """Archetype counts at every threshold.

    A row is regular at threshold t when score < t, so it only needs the number
    of grid points at or below its score. Those counts (at most strata x grid)
    are then accumulated along the grid.
    """
    ip, vc, s = F.col("inpatient_visit_count"), F.col("visit_count"), F.col(score)
    stratum = (
        F.when(ip >= 2, "Multiple Complex Episodes")
        .when(ip == 1, "Sporadic Complex Episodes")
        .when(vc <= 1, "Sparse Use")
        .when(vc >= 4, "Frequent")
        .otherwise("Infrequent")
    )
    points = F.array(*[F.lit(t) for t in thresholds])
    slot = F.when(s.isNull(), len(thresholds)).otherwise(F.size(F.filter(points, lambda t: t <= s)))
    counted = features.groupBy(stratum.alias("stratum"), slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n")
    )
    along = counted.select("stratum", "slot", "n", F.posexplode(points).alias("i", "threshold"))
    regular = F.col("slot") <= F.col("i")

    def tally(name: str) -> Column:
        pace, _, kind = name.partition(" ")
        if kind in ("Frequent", "Infrequent"):
            hit = (F.col("stratum") == kind) & (regular if pace == "Regular" else ~regular)
        else:
            hit = F.col("stratum") == name
        return F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(name)

    return along.groupBy("threshold").agg(*[tally(a) for a in ARCHETYPES], F.sum("n").alias("total"))


def _slope(value: Column) -> Column:
    """Central difference along the threshold, one-sided at both ends."""
    w = Window.orderBy("threshold")
    t = F.col("threshold")
    left_v, right_v = F.coalesce(F.lag(value).over(w), value), F.coalesce(F.lead(value).over(w), value)
    left_t, right_t = F.coalesce(F.lag(t).over(w), t), F.coalesce(F.lead(t).over(w), t)
    return F.coalesce(F.try_divide(right_v - left_v, right_t - left_t), F.lit(0.0))


def stability_curve(curve: DataFrame, n_points: int) -> DataFrame:
    """Total absolute change of the score-dependent classes, raw and smoothed.

    The curve has one row per grid point, so its windows are tiny.
    """
    total = F.lit(0.0)
    for name in _SCORED:
        total = total + F.abs(_slope(F.col(f"`{name}`") / F.col("total") * 100))
    width = min(5, max(3, round(n_points * 0.1)))
    near = Window.orderBy("threshold").rowsBetween(-(width // 2), (width - 1) // 2)
    return curve.select("threshold", total.alias("total_derivative")).withColumn(
        "smoothed_derivative", F.avg("total_derivative").over(near)
    )


def widest_plateau(flags: list[bool]) -> tuple[int, int]:
    """First widest run of true flags as (start, end) positions.

    A run that is cut off by a false flag extends onto it; widths compare as
    end - start and the default is the single point (0, 0).
    """
    best, at, last = (0, 0), 0, len(flags) - 1
    for flag, run in groupby(flags):
        size = len(list(run))
        if flag:
            end = min(at + size, last)
            if end - at > best[1] - best[0]:
                best = (at, end)
        at += size
    return best


def search_threshold(features: DataFrame, penalty: str = "L1", step: float = 0.05,
                     low: float = 0.0, high: float = 1.0) -> dict:
    """Threshold at the centre of the most stable stretch of the grid, searched on all rows.

    The grid spans the 1st to 99th percentile of the scores that decide a class; only its
    points come to the driver.
    """
    score = f"irregularity_{penalty.lower()}"
    bounds = (
        features.filter((F.col("inpatient_visit_count") == 0) & (F.col("visit_count") >= 2))
        .agg(F.percentile_approx(score, [0.01, 0.99], 10000).alias("q"))
        .first()["q"]
    )
    if bounds:
        q_low, q_high = max(0.0, bounds[0]), min(1.0, bounds[1])
        if q_low < q_high:
            low, high = q_low, q_high
    points = grid(low, high, step)
    curve = threshold_curve(features, score, points)
    rows = stability_curve(curve, len(points)).orderBy("threshold").collect()
    if not rows:  # no person-years: any point is as stable as another
        return {"threshold": points[0], "points": points, "width": 1, "least": 0.0}
    smooth = np.array([r["smoothed_derivative"] for r in rows])
    flags = smooth <= smooth.min() + max(0.05, float(np.quantile(smooth, 0.1)))
    start, end = widest_plateau(flags.tolist())
    plateau = [r["threshold"] for r in rows[start : end + 1]]
    return {"threshold": plateau[len(plateau) // 2], "points": points, "width": end - start + 1, "least": float(smooth.min())}


def find_threshold(features: DataFrame, penalty: str = "L1", step: float = 0.05,
                   low: float = 0.0, high: float = 1.0) -> dict:
    """The searched threshold with its report.

    The class shares of one year per person at the chosen
    threshold are only compared with those of all rows.
    """
    found = search_threshold(features, penalty, step, low, high)
    chosen, points, width = found["threshold"], found["points"], found["width"]
    full = rules.classify(features, penalty, chosen)
    one_year = rules.classify(one_year_per_person(features), penalty, chosen)
    jsd = js_divergence(one_year, full, "archetype").first()[0]
    shares = full.agg(
        (F.avg(F.col("archetype").startswith("Regular").cast("int")) * 100).alias("r"),
        (F.avg(F.col("archetype").startswith("Irregular").cast("int")) * 100).alias("i"),
    ).first()
    if width >= 3 and jsd < 0.02:
        confidence = "HIGH"
    elif width >= 2 and jsd < 0.05:
        confidence = "MODERATE"
    else:
        confidence = "LOW"
    return {
        "optimal_threshold": chosen,
        "confidence": confidence,
        "regular_pct": shares["r"],
        "irregular_pct": shares["i"],
        "stability_min_derivative": found["least"],
        "stability_plateau_width": width * step,
        "js_divergence_sample_full": float(jsd),
        "threshold_grid_min": points[0],
        "threshold_grid_max": points[-1],
        "threshold_grid_step": step,
    }


def js_divergence(first: DataFrame, second: DataFrame, label: str) -> DataFrame:
    """Jensen-Shannon divergence of two label distributions."""

    def shares(df: DataFrame, out: str) -> DataFrame:
        counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        whole = Window.partitionBy()  # one row per label
        return counts.select(label, (F.col("n") / F.sum("n").over(whole)).alias(out))

    both = shares(first, "p").join(shares(second, "q"), label, "full").fillna(0.0, ["p", "q"])
    floor = F.lit(1e-12)
    p, q = F.greatest(F.col("p"), floor), F.greatest(F.col("q"), floor)
    m = F.greatest((F.col("p") + F.col("q")) / 2, floor)
    return both.agg(
        (F.sum(p * F.log(p / m)) * 0.5 + F.sum(q * F.log(q / m)) * 0.5).alias("js_divergence")
    )


def _valid(features: DataFrame) -> DataFrame:
    return features.filter(
        F.col("irregularity_l1").isNotNull() & F.col("irregularity_l2").isNotNull()
    )


def penalty_stats(features: DataFrame) -> DataFrame:
    """Spread, top-decile spread, correlation and agreement of L1 and L2, one row."""
    valid = _valid(features).withColumn("scope", F.lit("all"))
    l1, l2 = F.col("irregularity_l1"), F.col("irregularity_l2")
    p90 = valid.agg(F.percentile("visit_count", 0.9)).first()[0]
    high = F.col("visit_count") >= (0.0 if p90 is None else p90)
    stats = valid.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"),
        (F.stddev_samp(l1) / F.avg(l1)).alias("l1_cv"),
        (F.stddev_samp(l2) / F.avg(l2)).alias("l2_cv"),
        F.count_if(high).alias("n_high"),
        F.stddev_samp(F.when(high, l1)).alias("l1_high_sd"),
        F.stddev_samp(F.when(high, l2)).alias("l2_high_sd"),
        F.corr(l1, l2).alias("pearson"),
        *[
            F.avg(((l1 > c) == (l2 > c)).cast("int")).alias(f"agree_{round(c * 100)}")
            for c in AGREEMENT_CUTS
        ],
    )
    rho = ranks.spearman(valid, ["scope"], "irregularity_l1", "irregularity_l2", buckets=256)
    rho = rho.select("scope", F.col("spearman_rho").alias("spearman"))
    return stats.join(rho, "scope").drop("scope")


def _plateau_of(shares: list[float], points: np.ndarray) -> tuple[float, float]:
    """(longest low-change run as a width, mean smoothed change) of a share curve."""
    change = np.abs(np.gradient(shares, points))
    smooth = np.array([change[max(0, i - 1) : i + 2].mean() for i in range(len(change))])
    calm = smooth <= np.percentile(smooth, 20)
    longest = max((len(list(run)) for flag, run in groupby(calm.tolist()) if flag), default=0)
    return longest * 0.05, float(smooth.mean())


def choose_penalty(features: DataFrame) -> dict:
    """L1 or L2 by relative spread and top-decile spread; a plateau test breaks a tie."""
    stats = penalty_stats(features).first()
    agreement = float(np.mean([stats[f"agree_{round(c * 100)}"] for c in AGREEMENT_CUTS]))
    criteria: dict = {"robustness": "L1" if stats["l1_cv"] < stats["l2_cv"] else "L2"}
    if stats["n_high"]:
        low = (stats["l1_high_sd"] or 0.0) < (stats["l2_high_sd"] or 0.0)
        criteria["outlier_handling"] = "L1" if low else "L2"
    votes = list(criteria.values())
    split = len(votes) == 2 and votes[0] != votes[1]
    winner = None
    if split:
        points = np.arange(0.2, 0.8, 0.05)
        above = [
            (F.avg(((F.col(f"irregularity_{p}") > float(t)) & (F.col("visit_count") >= 2)).cast("int")) * 100).alias(
                f"{p}_{i}"
            )
            for p in ("l1", "l2")
            for i, t in enumerate(points)
        ]
        row = _valid(features).agg(*above).first()
        (w1, d1), (w2, d2) = (
            _plateau_of([row[f"{p}_{i}"] for i in range(len(points))], points) for p in ("l1", "l2")
        )
        better_first = w1 > w2 if abs(w1 - w2) > 0.05 else d1 < d2
        winner = "L1" if better_first else "L2"
        votes.append(winner)
    first = votes.count("L1")
    if agreement > 0.95 and not split:
        choice, confidence = criteria["robustness"], "HIGH"
    elif split:
        choice, confidence = ("L1" if first >= 2 else "L2"), "HIGH"
    else:
        choice = criteria["robustness"]
        confidence = "HIGH" if first == len(votes) else "MODERATE"
    return {
        "recommendation": choice,
        "confidence": confidence,
        "agreement": agreement,
        "correlation": float(stats["pearson"]),
        "robustness": criteria["robustness"],
        "outlier_handling": criteria.get("outlier_handling"),
        "threshold_stability_winner": winner,
    }


def choice_row(spark: SparkSession, choice: dict) -> DataFrame:
    """A tuning result as a one-row table."""
    schema = ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in choice.items()
    )
    return small_table(spark, [tuple(choice.values())], schema)


def parameter_row(spark: SparkSession, penalty: dict | str, threshold: dict | float,
                  run_timestamp: str) -> DataFrame:
    """Log row of one tuning run; plain values mark a manual choice."""
    auto_p, auto_t = isinstance(penalty, dict), isinstance(threshold, dict)
    row = (
        run_timestamp,
        penalty["recommendation"] if auto_p else penalty,
        "AUTO" if auto_p else "MANUAL",
        penalty["confidence"] if auto_p else "MANUAL",
        float(threshold["optimal_threshold"] if auto_t else threshold),
        "AUTO" if auto_t else "MANUAL",
        threshold["confidence"] if auto_t else "MANUAL",
        threshold["stability_min_derivative"] if auto_t else None,
        threshold["stability_plateau_width"] if auto_t else None,
    )
    return small_table(
        spark,
        [row],
        "run_timestamp string, penalty string, penalty_source string, penalty_confidence string, "
        "threshold double, threshold_source string, threshold_confidence string, "
        "stability_min_derivative double, stability_plateau_width double",
    )


def null_score_audit(features: DataFrame, score: str) -> DataFrame:
    """Missing scores among the person-years whose class depends on the score."""
    relevant = (F.col("inpatient_visit_count") == 0) & (F.col("visit_count") >= 2)
    return features.filter(relevant).agg(
        F.count(F.lit(1)).alias("n_relevant"),
        F.count_if(F.col(score).isNull()).alias("n_null"),
        F.avg(F.col(score).isNull().cast("int")).alias("null_rate"),
    )


def adaptive(features: DataFrame, penalty: str, threshold: float) -> DataFrame:
    """Rules at a tuned threshold, with a distance-based confidence.

    Certain classes score 1.0, a missing score 0.2, otherwise the distance to
    the threshold in units of the stratum's interquartile range, at most 1.
    """
    score, ip, vc = F.col("irregularity_score"), F.col("inpatient_visit_count"), F.col("visit_count")
    classified = rules.classify(features, penalty, threshold)
    frequent, infrequent = (ip == 0) & (vc >= 4), (ip == 0) & vc.between(2, 3)
    quartiles = [0.25, 0.75]
    row = with_irregularity_score(features, penalty).agg(
        F.percentile_approx(F.when(frequent, score), quartiles, 10000).alias("f"),
        F.percentile_approx(F.when(infrequent, score), quartiles, 10000).alias("i"),
    ).first()
    iqr = {k: max(row[k][1] - row[k][0], 0.1) if row[k] else 0.1 for k in ("f", "i")}
    scale = F.when(vc >= 4, iqr["f"]).otherwise(iqr["i"])
    confidence = (
        F.when((ip >= 1) | (vc <= 1), 1.0)
        .when(score.isNull(), 0.2)
        .otherwise(F.least(F.lit(1.0), F.abs(score - threshold) / scale))
    )
    return classified.withColumn("archetype_confidence", confidence)
