"""Timeline data: merged stays, delimited concepts, person pages, medoid days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import INPATIENT_VISIT_CONCEPTS
from ..functions.scalar import split_tokens, year_fraction


def merge_spans(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Merge overlapping or touching spans per person.

    Spans with one start are reduced to the longest before the window, so a
    person's window holds at most one row per distinct start.
    """
    reduced = spans.groupBy("person_id", start).agg(
        F.max(end).alias(end), F.count(F.lit(1)).alias("n_stays")
    )
    ordered = Window.partitionBy("person_id").orderBy(start)
    seen = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("_seen").isNull() | (F.col(start) > F.col("_seen")), 1).otherwise(0)
    return (
        reduced.withColumn("_seen", seen)
        .withColumn("_island", F.sum(opens).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("person_id", "_island")
        .agg(
            F.min(start).alias("span_start"),
            F.max(end).alias("span_end"),
            F.sum("n_stays").alias("n_stays"),
        )
        .drop("_island")
    )


def merged_stays(visits: DataFrame) -> DataFrame:
    """Inpatient stays per person as disjoint date spans."""
    start, end = F.to_date("visit_start_date"), F.to_date("visit_end_date")
    stays = visits.filter(F.col("visit_concept_id").isin(*INPATIENT_VISIT_CONCEPTS)).select(
        "person_id", start.alias("start"), F.greatest(start, F.coalesce(end, start)).alias("end")
    )
    return merge_spans(stays)


def explode_tokens(df: DataFrame, column: str, out: str, delimiter: str = r"\|") -> DataFrame:
    """One row per trimmed token of a delimited column."""
    return df.withColumn(out, F.explode(split_tokens(F.col(column), delimiter))).drop(column)


#: Persons that are ordered in one place at most, and id ranges that are counted at a time.
ORDERED, RANGES = 10_000, 256


def page(daily_df: DataFrame, page: int, page_size: int) -> DataFrame:
    """Daily rows of one page of persons, with lane number and horizontal position.

    Persons are counted per range of ids, and the range with the page's first person is
    narrowed until it is small, so the ones before the page are counted, never listed; then
    the persons from there on are taken in order, as many as the page has. Persons without an id have no lane.
    ``daily_df`` is read a few times and should be a stored table.
    """
    people = daily_df.select("person_id").where("person_id IS NOT NULL").distinct()
    ends = people.agg(F.min("person_id").alias("low"), F.max("person_id").alias("high"), F.count(F.lit(1)).alias("n")).first()
    skip, before = (page - 1) * page_size, 0
    low, high, held = ends["low"] or 0, ends["high"] or 0, ends["n"]
    if skip >= held:
        held, page_size = 0, 0
    while held > ORDERED and high > low:
        width = -(-(high - low + 1) // RANGES)
        place = F.floor((F.col("person_id") - low) / width)
        counts = people.where(F.col("person_id").between(low, high)).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
        for row in sorted(counts.collect()):  # RANGES rows
            if before + row["n"] > skip:
                break
            before += row["n"]
        low, held = low + row["place"] * width, row["n"]
        high = min(high, low + width - 1)
    first = people.where(F.col("person_id") >= low).orderBy("person_id").limit(skip - before + page_size)
    lanes = [r["person_id"] for r in first.collect()][skip - before :]  # a page
    listed = F.array(*[F.lit(i) for i in lanes]).cast("array<bigint>")
    rows = daily_df.where(F.col("person_id").isin(lanes))
    return rows.withColumns({
        "lane": (F.array_position(listed, F.col("person_id").cast("bigint")) - 1 + skip).cast("int"),
        "x": year_fraction(F.col("date").cast("timestamp")),
    })


def language_mix(person: DataFrame, languages: DataFrame, concepts: tuple[int, ...]) -> DataFrame:
    """Persons per recorded language, with the share of all persons."""
    known = (
        languages.filter(F.col("language_concept_id").isin(*concepts))
        .select("person_id", "value_as_string")
        .distinct()
    )
    joined = (
        person.select("person_id")
        .join(known, "person_id", "left")
        .select("person_id", F.coalesce("value_as_string", F.lit("Not Recorded")).alias("language"))
        .distinct()
    )
    total = person.agg(F.countDistinct("person_id").alias("n")).first()["n"]
    return (
        joined.groupBy("language")
        .agg(F.count(F.lit(1)).alias("patient_count"))
        .withColumn("percentage", F.round(F.col("patient_count") * 100.0 / max(total, 1), 1))
        .orderBy(F.desc("patient_count"), "language")
    )


def medoid_days(daily_df: DataFrame, visits: DataFrame, medoids: DataFrame) -> DataFrame:
    """Daily rows of each medoid's year with the day's first visit concept.

    ``medoids``: person_id, year, cluster_id, cluster_label (one row per cluster).
    """
    keys = medoids.select("person_id", "year", "cluster_id", "cluster_label")
    people = keys.select("person_id").distinct()
    first_concept = visits.join(people, "person_id", "left_semi").groupBy(
        "person_id", F.to_date("visit_start_date").alias("date")
    ).agg(F.min("visit_concept_id").alias("visit_concept_id"))
    mine = daily_df.withColumn("year", F.year("date")).join(keys, ["person_id", "year"])
    return (
        mine.join(first_concept, ["person_id", "date"], "left")
        .withColumn("y_label", F.format_string("%s | %d", "cluster_label", "person_id"))
        .withColumn("day_of_year", F.dayofyear("date"))
    )


def medoid_stays(visits: DataFrame, medoids: DataFrame) -> DataFrame:
    """Inpatient stays of each medoid's year as start and end day of year."""
    start = F.to_date("visit_start_date")
    stays = visits.filter(F.col("visit_concept_id").isin(*INPATIENT_VISIT_CONCEPTS)).select(
        "person_id",
        F.year(start).alias("year"),
        start.alias("start_date"),
        F.coalesce(F.to_date("visit_end_date"), start).alias("end_date"),
    )
    return stays.join(medoids, ["person_id", "year"]).select(
        "person_id",
        "year",
        F.format_string("%s | %d", "cluster_label", "person_id").alias("y_label"),
        F.dayofyear("start_date").alias("start_doy"),
        F.dayofyear("end_date").alias("end_doy"),
    )
