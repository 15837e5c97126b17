"""Person-date spine: visit days, concept counts and comorbidity per person and day.

Everything is one tagged union and two ``groupBy`` steps. The first groups by
(person, date, tag, key), so one busy person or day is spread over many tasks and
arrives at the second step already counted. Its narrow rows are then clustered by
person once; the days, and the roll-ups and features made from them, stay where they
are. No array is built just to be measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DOMAINS, INPATIENT_VISIT_CONCEPTS
from ..functions.scalar import age_on, birth_date
from . import comorbidity, runs


def visit_days(visits: DataFrame) -> DataFrame:
    """One row per visit and day of its span.

    A missing or reversed end counts as the start day. Spans are never cut;
    :func:`span_audit` reports absurd ones.
    """
    start, end = F.to_date("visit_start_date"), F.to_date("visit_end_date")
    last = F.when(end.isNull() | (end < start), start).otherwise(end)
    return (
        visits.select(
            "person_id",
            "visit_occurrence_id",
            F.when(F.col("visit_concept_id").isin(*INPATIENT_VISIT_CONCEPTS), 1)
            .otherwise(0)
            .alias("is_hospitalized"),
            start.alias("_start"),
            last.alias("_last"),
        )
        .filter(F.col("_start").isNotNull())
        .select(
            "person_id",
            "visit_occurrence_id",
            "is_hospitalized",
            F.explode(F.sequence("_start", "_last")).alias("date"),
        )
    )


def span_audit(visits: DataFrame, limit_days: int = 3660) -> DataFrame:
    """Counts of missing, reversed and over-long visit spans."""
    start, end = F.to_date("visit_start_date"), F.to_date("visit_end_date")
    return visits.agg(
        F.count(F.lit(1)).alias("n_visits"),
        F.count_if(end.isNull()).alias("n_missing_end"),
        F.count_if(end < start).alias("n_reversed_end"),
        F.count_if(F.datediff(end, start) >= limit_days).alias("n_over_limit"),
    )


def person_dates(events: DataFrame, days: DataFrame) -> DataFrame:
    """Distinct (person, date) over visits and all event domains."""
    return (
        events.select("person_id", "date")
        .unionByName(days.select("person_id", "date"))
        .distinct()
    )


#: Rows are grouped by the places of their tags here, which are narrower than names.
_TAGS = (*DOMAINS, "visit", "cci")


def _tag(name: str) -> Column:
    return F.lit(_TAGS.index(name)).cast("tinyint")


def keyed_counts(events: DataFrame, days: DataFrame, lists: bool = False) -> DataFrame:
    """Row counts per (person, date, tag, key): key is a concept or a visit id, tag a place
    in ``_TAGS``, null for rows of other domains, which only keep their days.

    ``lists`` also tells rows apart by the code and vocabulary of their condition, so that
    one row still stands for each event. Without a person there is nothing to attach a row
    to, so it keeps its place on the spine but contributes no counts.
    """
    known = F.col("person_id").isNotNull()
    coded = known & (F.col("domain") == "condition")
    concept_rows = events.select(
        "person_id",
        "date",
        F.coalesce(*[F.when(F.col("domain") == t, _tag(t)) for t in _TAGS]).alias("tag"),
        F.when(known, F.col("concept_id").cast("bigint")).alias("key"),
        F.lit(0).alias("in_hospital"),
        *([F.when(coded, F.col("source_code")).cast("string").alias("code"),
           F.when(coded, F.col("vocab_id")).cast("string").alias("vocab")] if lists else []),
    )
    visit_rows = days.select(
        "person_id",
        "date",
        _tag("visit").alias("tag"),
        F.when(known, F.col("visit_occurrence_id").cast("bigint")).alias("key"),
        F.when(known, F.col("is_hospitalized")).otherwise(0).alias("in_hospital"),
    )
    return (
        concept_rows.unionByName(visit_rows, allowMissingColumns=True)
        .groupBy("person_id", "date", "tag", "key", *(["code", "vocab"] if lists else []))
        .agg(F.count(F.lit(1)).alias("n"), F.max("in_hospital").alias("in_hospital"))
    )


def _domain_aggregates(domain: str) -> list[Column]:
    mine = f"tag = {_TAGS.index(domain)}Y AND key IS NOT NULL"
    return [
        F.expr(f"sum(CASE WHEN {mine} THEN n ELSE 0 END) AS {domain}_count"),
        F.expr(f"count_if({mine}) AS {domain}_unique_ct"),
        F.expr(f"sum(CASE WHEN {mine} AND key = 0 THEN n ELSE 0 END) AS {domain}_nomatch_ct"),
    ]


def totals() -> dict[str, Column]:
    def total(suffix: str) -> Column:
        return F.expr(" + ".join(f"{d}_{suffix}" for d in DOMAINS))

    return {
        "total_data_points": total("count"),
        "total_unique_concepts": total("unique_ct"),
        "total_nomatch_concepts": total("nomatch_ct"),
    }


def daily(events: DataFrame, days: DataFrame, visit_cci: DataFrame | None = None, lists: bool = False) -> DataFrame:
    """The person-date table: visits, per-domain counts, totals and comorbidity.

    ``cci_mask`` holds the comorbidity groups; :func:`with_cci_flags` expands it. ``lists``
    adds the run-length lists of :mod:`runs`, packed from the same counted rows; a
    day without values has empty lists. A visit counts once a day in its list. The rows
    are clustered by person, before they grow wide.
    """
    keyed = keyed_counts(events, days, lists)
    rows = keyed.withColumns(
        {"cci_total": F.lit(0), "cci_mask": F.lit(0).cast("bigint")}
    )
    if visit_cci is not None:
        rows = rows.unionByName(
            visit_cci.filter(F.col("person_id").isNotNull()).select(
                "person_id",
                "date",
                _tag("cci").alias("tag"),
                F.lit(None).cast("bigint").alias("key"),
                F.lit(0).cast("bigint").alias("n"),
                F.lit(0).alias("in_hospital"),
                "cci_total",
                "cci_mask",
            ),
            allowMissingColumns=True,
        )
    of_visit = F.col("tag") == _tag("visit")
    is_visit = of_visit & F.col("key").isNotNull()
    named = F.array(*[F.lit(t) for t in _TAGS])[F.col("tag").cast("int")]
    counted = rows.repartition("person_id").groupBy("person_id", "date").agg(
        F.count_if(is_visit).alias("visit_count"),
        F.max("in_hospital").alias("hospitalized_flag"),
        *[c for d in DOMAINS for c in _domain_aggregates(d)],
        F.max("cci_total").alias("cci_total"),
        F.bit_or("cci_mask").alias("cci_mask"),
        *([runs.collect(F.when(of_visit, 1).otherwise(F.col("n")), named)] if lists else []),
    )
    if lists:  # a concept has a row for each of its codes
        counted = runs.pack(counted).withColumns({f"{d}_unique_ct": runs.distinct(f"{d}_concept_ids") for d in DOMAINS})
    out = counted.withColumns(totals())
    return out.withColumn(
        "has_clinical_concepts", F.when(F.col("total_data_points") > 0, 1).otherwise(0)
    )


def with_cci_flags(df: DataFrame, mask: str = "cci_mask") -> DataFrame:
    return df.withColumns(comorbidity.flag_columns(mask)).drop(mask)


def concept_lists(events: DataFrame, keys: tuple[str, ...] = ("person_id", "date")) -> DataFrame:
    """Concept lists per group and domain in run-length form.

    ``concepts`` is a sorted array of (concept_id, n). Rows are counted per
    concept first, so a list is never longer than the vocabulary, however many
    rows the group holds. :func:`expand_list` gives the plain repeated array.
    """
    counted = (
        events.filter(F.col("concept_id").isNotNull())
        .groupBy(*keys, "domain", "concept_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy(*keys, "domain").agg(
        F.sort_array(F.collect_list(F.struct("concept_id", "n"))).alias("concepts")
    )


def code_lists(events: DataFrame, keys: tuple[str, ...] = ("person_id", "date")) -> DataFrame:
    """Source codes with vocabulary per group, run-length like the concept lists."""
    counted = (
        events.filter(F.col("source_code").isNotNull())
        .groupBy(*keys, "source_code", "vocab_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("source_code", "vocab_id", "n"))).alias("codes")
    )


def visit_ids(days: DataFrame) -> DataFrame:
    """Distinct visits per person and date, one row each."""
    return (
        days.filter(F.col("visit_occurrence_id").isNotNull())
        .select("person_id", "date", "visit_occurrence_id")
        .distinct()
    )


def expand_list(entries: Column, value: str = "concept_id") -> Column:
    """Plain array with repeats from a run-length list."""
    return F.flatten(F.transform(entries, lambda e: F.array_repeat(e[value], e["n"].cast("int"))))


def demographics(person: DataFrame, concepts: DataFrame,
                 asian_pattern: str = "%asians%") -> DataFrame:
    """Decode gender, ethnicity and race, and complete the birth date, per person.

    The concept table is filtered to the ids demographics use before it is
    joined; its side is left to the optimizer, which broadcasts it when small.
    """
    used = person.select(
        F.explode(
            F.array("gender_concept_id", "ethnicity_concept_id", "race_concept_id")
        ).alias("concept_id")
    ).distinct()
    names = concepts.select("concept_id", F.lower("concept_name").alias("name")).join(
        used, "concept_id", "left_semi"
    )

    def lookup(df: DataFrame, id_col: str, out: str) -> DataFrame:
        side = names.select(F.col("concept_id").alias(id_col), F.col("name").alias(out))
        return df.join(side, id_col, "left")

    df = lookup(person, "gender_concept_id", "_gender")
    df = lookup(df, "ethnicity_concept_id", "_ethnicity")
    df = lookup(df, "race_concept_id", "_race")
    race, ethnicity = F.col("_race"), F.col("_ethnicity")
    return df.select(
        "person_id",
        birth_date("year_of_birth", "month_of_birth", "day_of_birth").alias("birth_date"),
        F.when(F.col("_gender") == "female", "Female")
        .when(F.col("_gender") == "male", "Male")
        .otherwise("Unknown")
        .alias("gender"),
        F.when(ethnicity.like("%not hispanic%"), "Not Hispanic or Latino")
        .when(ethnicity.like("%hispanic%"), "Hispanic or Latino")
        .when(ethnicity.isNull(), "Unknown")
        .otherwise("Not Hispanic or Latino")
        .alias("ethnicity"),
        F.when(race.like(asian_pattern), "Asian")
        .when(race.like("%white%"), "White")
        .when(race.like("%black%"), "Black")
        .when(race.like("%american indian%"), "American Indian")
        .when(race.like("%hawaiian%"), "Hawaiian")
        .otherwise("Unknown")
        .alias("race"),
    )


def with_demographics(daily_df: DataFrame, people: DataFrame) -> DataFrame:
    """Left-join decoded persons and add the age on each day."""
    return daily_df.join(people, "person_id", "left").withColumn(
        "age_at_day", age_on(F.col("date"), F.col("birth_date"))
    )


def unified_daily(daily_df: DataFrame, people: DataFrame) -> DataFrame:
    """Person-date table in its published column order. ``daily_df`` needs its lists."""
    full = with_cci_flags(with_demographics(daily_df, people))
    order = ["person_id", "birth_date", "age_at_day", "gender", "ethnicity", "race", "date",
             "visit_count", "visit_occurrence_ids", "hospitalized_flag", "has_clinical_concepts"]
    order += [c for c in runs.LISTS if c not in order]
    order += [f"{d}_count" for d in DOMAINS]
    order += [f"{d}_unique_ct" for d in DOMAINS]
    order += [f"{d}_nomatch_ct" for d in DOMAINS]
    order += ["total_data_points", "total_unique_concepts", "total_nomatch_concepts", "cci_total"]
    order += list(comorbidity.flag_columns())
    return full.select(*order)
