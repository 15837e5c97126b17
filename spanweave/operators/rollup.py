"""Week, month and year roll-ups of the person-date spine.

A roll-up reads days, or the rows of a finer roll-up: months merge into years. Sums add,
maxima and masks combine, date lists join, and the run-length lists merge; their
values also give the distinct concepts, so no period goes back to the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DOMAINS
from ..functions.scalar import age_on, period_label
from . import comorbidity, runs, spine

_SUMMED = [f"{d}_{s}" for d in DOMAINS for s in ("count", "nomatch_ct")]
_DATES = ["dates_with_visits", "dates_with_clinical_concepts"]
_DAYS = ["days_in_period", "active_days", "unique_dates_with_data", "days_with_visits", "days_with_clinical_concepts",
         "visit_count", "hospitalized_days"]


def as_periods(daily_df: DataFrame) -> DataFrame:
    """Days as periods of one day. ``daily_df`` needs its lists."""
    active, clinical = F.col("visit_count") > 0, F.col("has_clinical_concepts") == 1
    dated = F.when(F.col("date").isNotNull(), 1).otherwise(0)
    no_date = F.array().cast("array<date>")
    return daily_df.select(
        "person_id", F.col("date").alias("period_start_date"), F.col("date").alias("period_end_date"),
        dated.alias("days_in_period"), active.cast("int").alias("active_days"), dated.alias("unique_dates_with_data"),
        active.cast("int").alias("days_with_visits"), F.col("has_clinical_concepts").alias("days_with_clinical_concepts"),
        "visit_count", F.col("hospitalized_flag").alias("hospitalized_days"),
        F.when(active, F.array("date")).otherwise(no_date).alias("dates_with_visits"),
        F.when(clinical, F.array("date")).otherwise(no_date).alias("dates_with_clinical_concepts"),
        *_SUMMED, "cci_total", "cci_mask", *runs.LISTS,
    )


def rollup_period(rows: DataFrame, unit: str, dates: bool = True, lists: bool = True) -> DataFrame:
    """Roll days, or periods that lie within one of ``unit``, up to ``week``, ``month`` or ``year``.

    ``rows`` is the daily table with its lists or a roll-up, finalized or not; it is read
    once. Where it lies clustered by person, as :func:`spine.daily` leaves it, no row
    moves. Date lists hold at most the days of the period; leave them or the other lists
    out with ``dates=False`` or ``lists=False``: only distinct concepts are counted then.
    """
    if "period_start_date" not in rows.columns:
        rows = as_periods(rows)
    elif "cci_mask" not in rows.columns:
        rows = rows.withColumn("cci_mask", comorbidity.mask_of_flags())
    concepts = {d: f"{d}_concept_ids" for d in DOMAINS}
    rolled = (
        rows.withColumn("period", period_label("period_start_date", unit))
        .groupBy("person_id", "period")
        .agg(
            F.min("period_start_date").alias("period_start_date"),
            F.max("period_end_date").alias("period_end_date"),
            *[F.sum(c).alias(c) for c in _DAYS],
            *([F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in _DATES] if dates else []),
            F.max("cci_total").alias("cci_total"),
            F.bit_or("cci_mask").alias("cci_mask"),
            *[F.sum(c).alias(c) for c in _SUMMED],
            *[runs.gather(c).alias(c) for c in (runs.LISTS if lists else concepts.values())],
        )
        .withColumns({f"{d}_unique_ct": runs.distinct(c) for d, c in concepts.items()})
    )
    rest = {c: runs.merge(c) for c in runs.LISTS} if lists else {}
    kept = [c for c in rolled.columns if c not in runs.LISTS]
    return rolled.select(*kept, *[c.alias(name) for name, c in rest.items()]).withColumns(spine.totals())


def finalize(rolled: DataFrame, people: DataFrame) -> DataFrame:
    """Attach person columns and fix the published column order; the visit ids, with the
    number of days that each covers, come after it.

    Age is non-decreasing in the date, so the age at the period's first date is
    the minimum daily age; the person table is joined to periods, not to days.
    """
    full = spine.with_cci_flags(rolled.join(people, "person_id", "left")).withColumn(
        "age", age_on(F.col("period_start_date"), F.col("birth_date"))
    )
    order = ["person_id", "period", "period_start_date", "period_end_date", "birth_date", "age",
             "gender", "race", "ethnicity", "days_in_period", "active_days",
             "unique_dates_with_data", "days_with_visits", "days_with_clinical_concepts",
             *_DATES, "visit_count",
             "hospitalized_days", "total_data_points", "total_unique_concepts",
             "total_nomatch_concepts", "cci_total", *comorbidity.flag_columns()]
    for d in DOMAINS:
        order += [c for c in runs.LISTS if c.startswith(f"{d}_")]
        order += [f"{d}_{s}" for s in ("count", "unique_ct", "nomatch_ct")]
    return full.select(*order, "visit_occurrence_ids")
