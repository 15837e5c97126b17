"""Rule-based utilisation archetypes and their longitudinal tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import RULE_THRESHOLD
from .features import with_irregularity_score


def archetype(
    inpatient: str = "inpatient_visit_count",
    visits: str = "visit_count",
    score: str = "irregularity_score",
    threshold: float = RULE_THRESHOLD,
) -> tuple[Column, Column]:
    """(label, reason) of the seven-class rule; a missing score counts as 1.0."""
    ip, vc = F.col(inpatient), F.col(visits)
    s = F.coalesce(F.col(score), F.lit(1.0))
    regular = s < threshold
    pace = F.when(regular, "regular").otherwise("irregular")
    label = (
        F.when(ip >= 2, "Multiple Complex Episodes")
        .when(ip == 1, "Sporadic Complex Episodes")
        .when(vc <= 1, "Sparse Use")
        .when((vc >= 4) & regular, "Regular Frequent")
        .when(vc >= 4, "Irregular Frequent")
        .when(regular, "Regular Infrequent")
        .otherwise("Irregular Infrequent")
    )
    tail = F.format_string(" visits + %s (score=%.2f)", pace, s)
    reason = (
        F.when(ip >= 2, F.format_string("IP visits >= 2 (n=%d)", ip))
        .when(ip == 1, "1 IP visit")
        .when(vc <= 1, "Single visit or no visits")
        .when(vc >= 4, F.concat(F.lit("≥4"), tail))
        .otherwise(F.concat(F.lit("2-3"), tail))
    )
    return label, reason


def classify(features: DataFrame, penalty: str = "L1", threshold: float = RULE_THRESHOLD) -> DataFrame:
    label, reason = archetype(threshold=threshold)
    return with_irregularity_score(features, penalty).withColumns(
        {
            "is_regular": F.col("irregularity_score") < threshold,
            "archetype": label,
            "archetype_reason": reason,
        }
    )


def track(df: DataFrame, label: str = "archetype") -> DataFrame:
    """Prior-year label, change flag, segment id and tenure within the segment.

    Every window is by person, whose rows are one per year.
    """
    by_year = Window.partitionBy("person_id").orderBy("year")
    so_far = by_year.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_segment = Window.partitionBy("person_id", "segment_id").orderBy("year")
    prior = F.col("prior_year_archetype_rules")
    return (
        df.withColumn("prior_year_archetype_rules", F.lag(label).over(by_year))
        .withColumn(
            "archetype_changed",
            F.when(prior.isNotNull() & (F.col(label) != prior), 1).otherwise(0),
        )
        .withColumn("segment_id", F.sum("archetype_changed").over(so_far))
        .withColumn("years_in_current_archetype", F.row_number().over(in_segment))
    )


def vanilla(features: DataFrame) -> DataFrame:
    """Fixed rule run: L1 penalty, threshold 0.5, full confidence, with tracking."""
    return track(classify(features)).withColumn("archetype_confidence", F.lit(1.0))


def group_counts(df: DataFrame, col: str) -> DataFrame:
    """Person-years and persons per label, largest first."""
    return (
        df.groupBy(col)
        .agg(
            F.count(F.lit(1)).alias("person_years"),
            F.countDistinct("person_id").alias("unique_persons"),
        )
        .orderBy(F.desc("person_years"), col)
    )


def transition_rate(tracked: DataFrame) -> DataFrame:
    with_prior = tracked.filter(F.col("prior_year_archetype_rules").isNotNull())
    n, changed = F.count(F.lit(1)), F.sum("archetype_changed")
    return with_prior.agg(
        n.alias("total_person_years_with_prior"),
        changed.alias("total_changes"),
        (F.try_divide(changed, n) * 100).alias("pct_changed"),
    )


def stability(tracked: DataFrame, label: str = "archetype", out: str = "stability_pct") -> DataFrame:
    """Share of person-years that keep the prior year's label, per prior label."""
    prior = F.col("prior_year_archetype_rules")
    return (
        tracked.filter(prior.isNotNull())
        .groupBy(prior.alias("archetype"))
        .agg((F.avg((F.col(label) == prior).cast("int")) * 100).alias(out))
    )


def compare_stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """Outer-join two tracked runs' per-label stability."""
    a = stability(first, out="vanilla_stability")
    b = stability(second, out="adaptive_stability")
    return (
        a.join(b, "archetype", "full")
        .fillna(0.0, ["vanilla_stability", "adaptive_stability"])
        .withColumn("improvement", F.col("adaptive_stability") - F.col("vanilla_stability"))
    )
