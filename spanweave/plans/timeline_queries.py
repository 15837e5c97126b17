"""Spine, roll-up, feature and source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ARCHETYPES, CCI_NAMES, DOMAINS, LANGUAGE_CONCEPTS
from ..functions.scalar import order_by_list, position_in
from ..operators import comorbidity, features, rollup, runs, spine, timelines
from ..sources import sinks
from .lab import Lab
from .oracle import AGE, SECOND_CASE, compose, group_case
from .registry import query

_FLAGS = ", ".join(f"cci_{n}" for n in CCI_NAMES)
_COUNTS = ", ".join(f"{d}_{s}" for s in ("count", "unique_ct", "nomatch_ct") for d in DOMAINS)


@query("visit_days", compose("visit_day", """
SELECT person_id, date, count(*) AS n_rows, count(DISTINCT visit_occurrence_id) AS visit_count,
       max(is_hospitalized) AS hospitalized_flag
FROM visit_day GROUP BY 1, 2"""))
def visit_days(lab: Lab) -> DataFrame:
    per_visit = lab.days.groupBy("person_id", "date", "visit_occurrence_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("is_hospitalized").alias("h")
    )
    return per_visit.groupBy("person_id", "date").agg(
        F.sum("n").alias("n_rows"),
        F.count("visit_occurrence_id").alias("visit_count"),
        F.max("h").alias("hospitalized_flag"),
    )


@query("visit_day_ids", compose("visit_day", """
SELECT DISTINCT person_id, date, visit_occurrence_id FROM visit_day"""))
def visit_day_ids(lab: Lab) -> DataFrame:
    return spine.visit_ids(lab.days)


@query("span_audit", compose("visit", """
SELECT count(*) AS n_visits, count(*) FILTER (WHERE visit_end_date IS NULL) AS n_missing_end,
       count(*) FILTER (WHERE visit_end_date < visit_start_date) AS n_reversed_end,
       count(*) FILTER (WHERE visit_end_date - visit_start_date >= 3660) AS n_over_limit
FROM visit"""))
def span_audit(lab: Lab) -> DataFrame:
    return spine.span_audit(lab.clinical.visits)


@query("person_date_spine", compose("spine", "SELECT person_id, date FROM spine"))
def person_date_spine(lab: Lab) -> DataFrame:
    return spine.person_dates(lab.clinical.events, lab.days)


@query("spine_daily_counts", compose("daily", f"""
SELECT person_id, date, visit_count, hospitalized_flag, has_clinical_concepts, {_COUNTS},
       total_data_points, total_unique_concepts, total_nomatch_concepts, cci_total
FROM daily"""))
def spine_daily_counts(lab: Lab) -> DataFrame:
    return lab.daily.drop("cci_mask")


@query("daily_concept_lists", compose("event", """
SELECT person_id, date, domain, array_to_string(list(concept_id ORDER BY concept_id), ',') AS concept_ids
FROM event WHERE concept_id IS NOT NULL GROUP BY 1, 2, 3"""))
def daily_concept_lists(lab: Lab) -> DataFrame:
    plain = spine.expand_list(F.col("concepts")).cast("array<string>")
    return spine.concept_lists(lab.clinical.events).select(
        "person_id", "date", "domain", F.array_join(plain, ",").alias("concept_ids")
    )


@query("daily_code_lists", compose("event", """
SELECT person_id, date, string_agg(source_code || '/' || coalesce(vocab_id, '-') || 'x' || n, ','
       ORDER BY source_code, coalesce(vocab_id, '')) AS codes
FROM (SELECT person_id, date, source_code, vocab_id, count(*) AS n FROM event
      WHERE source_code IS NOT NULL GROUP BY 1, 2, 3, 4) AS c GROUP BY 1, 2"""))
def daily_code_lists(lab: Lab) -> DataFrame:
    text = F.transform(
        "codes",
        lambda e: F.concat(
            e["source_code"], F.lit("/"), F.coalesce(e["vocab_id"], F.lit("-")), F.lit("x"),
            e["n"].cast("string"),
        ),
    )
    return spine.code_lists(lab.clinical.events).select(
        "person_id", "date", F.array_join(text, ",").alias("codes")
    )


@query("demographics", compose("people", "SELECT * FROM people"))
def demographics(lab: Lab) -> DataFrame:
    return lab.people


def _lists_sql(keys: str) -> str:
    """One text column per list from rows (keys, list, key, text)."""
    columns = ", ".join(
        f"string_agg(coalesce(CAST(key AS VARCHAR), text) || 'x' || n, ',' ORDER BY key, text) FILTER (list = '{name}') AS {name}"
        for name in runs.LISTS)
    return f"""SELECT {keys}, {columns} FROM (SELECT {keys}, list, key, text, count(*) AS n FROM listed
    GROUP BY {keys}, list, key, text) AS r GROUP BY {keys}"""


_LIST_NAMES = ", ".join(f"coalesce({name}, '') AS {name}" for name in runs.LISTS)


def _lists_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({name: runs.as_text(name) for name in runs.LISTS})


@query("unified_daily", compose("daily people listed", f"""
, lists AS ({_lists_sql("person_id, date")})
SELECT d.person_id, birth_date, {AGE.format(d='d.date', b='birth_date')} AS age_at_day, gender,
       ethnicity, race, d.date, visit_count, hospitalized_flag, has_clinical_concepts, {_COUNTS},
       total_data_points, total_unique_concepts, total_nomatch_concepts, cci_total, {_FLAGS}, {_LIST_NAMES}
FROM daily d LEFT JOIN people p ON d.person_id = p.person_id
LEFT JOIN lists l ON d.person_id = l.person_id AND d.date = l.date"""))
def unified_daily(lab: Lab) -> DataFrame:
    return _lists_as_text(spine.unified_daily(lab.listed_daily, lab.people))


@query("icd_groups", compose("event", f"""
SELECT code, cc_group, cc_second, count(*) AS n FROM (
  SELECT code, CAST({group_case("code")} AS INTEGER) AS cc_group,
         CAST(CASE {SECOND_CASE} END AS INTEGER) AS cc_second
  FROM (SELECT upper(replace(source_code, '.', '')) AS code FROM event
        WHERE source_code IS NOT NULL) AS e) AS g GROUP BY 1, 2, 3"""))
def icd_groups(lab: Lab) -> DataFrame:
    codes = lab.clinical.events.filter(F.col("source_code").isNotNull()).select(
        comorbidity.clean_code(F.col("source_code")).alias("code")
    )
    counted = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return comorbidity.with_groups(counted).select("code", "cc_group", "cc_second", "n")


@query("cci_visit", compose("cci_visit", f"""
SELECT visit_occurrence_id, person_id, date, cci_total, {_FLAGS} FROM cci_visit"""))
def cci_visit(lab: Lab) -> DataFrame:
    return spine.with_cci_flags(lab.visit_cci)


@query("cci_daily", compose("cci_daily", f"SELECT person_id, date, cci_total, {_FLAGS} FROM cci_daily"))
def cci_daily(lab: Lab) -> DataFrame:
    return spine.with_cci_flags(comorbidity.daily_scores(lab.visit_cci))


def _rollup_sql(period: str, unique_period: str) -> str:
    sums = ", ".join(
        f"CAST(sum({d}_{s}) AS BIGINT) AS {d}_{s}" for d in DOMAINS for s in ("count", "nomatch_ct")
    )
    uniques = ", ".join(
        f"count(DISTINCT concept_id) FILTER (WHERE domain = '{d}') AS {d}_unique_ct" for d in DOMAINS
    )
    flags = ", ".join(f"max(cci_{n}) AS cci_{n}" for n in CCI_NAMES)
    uc = ", ".join(f"coalesce({d}_unique_ct, 0) AS {d}_unique_ct" for d in DOMAINS)
    total_u = " + ".join(f"coalesce({d}_unique_ct, 0)" for d in DOMAINS)
    total_n = " + ".join(f"{d}_nomatch_ct" for d in DOMAINS)
    return compose("daily people listed", f"""
, lists AS ({_lists_sql("person_id, period").replace("FROM listed", f"FROM (SELECT *, {period} AS period FROM listed) AS p")}),
u AS (SELECT person_id, {unique_period} AS period, {uniques} FROM event GROUP BY 1, 2),
t AS (SELECT person_id, {period} AS period, min(date) AS period_start_date,
  max(date) AS period_end_date, count(date) AS days_in_period,
  count(*) FILTER (WHERE visit_count > 0) AS active_days,
  count(DISTINCT date) AS unique_dates_with_data,
  count(*) FILTER (WHERE visit_count > 0) AS days_with_visits,
  CAST(sum(has_clinical_concepts) AS BIGINT) AS days_with_clinical_concepts,
  coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (WHERE visit_count > 0), '') AS dates_with_visits,
  coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (WHERE has_clinical_concepts = 1), '') AS dates_with_clinical_concepts,
  CAST(sum(visit_count) AS BIGINT) AS visit_count,
  CAST(sum(hospitalized_flag) AS BIGINT) AS hospitalized_days,
  CAST(sum(total_data_points) AS BIGINT) AS total_data_points,
  max(cci_total) AS cci_total, {flags}, {sums} FROM daily GROUP BY 1, 2)
SELECT t.* REPLACE (t.person_id AS person_id), birth_date,
  {AGE.format(d='period_start_date', b='birth_date')} AS age, gender, race, ethnicity,
  {uc}, {total_u} AS total_unique_concepts, {total_n} AS total_nomatch_concepts, {_LIST_NAMES}
FROM t LEFT JOIN u ON t.person_id = u.person_id AND t.period = u.period
LEFT JOIN lists l ON t.person_id = l.person_id AND t.period = l.period
LEFT JOIN people p ON t.person_id = p.person_id""")


def _published(lab: Lab, rolled: DataFrame) -> DataFrame:
    df = _lists_as_text(rollup.finalize(rolled, lab.people))
    return df.withColumns(
        {
            c: F.array_join(F.col(c).cast("array<string>"), ",")
            for c in ("dates_with_visits", "dates_with_clinical_concepts")
        }
    )


_WEEK = "strftime(date_trunc('week', date), '%Y-%m-%d')"


@query("rollup_week", _rollup_sql(_WEEK, _WEEK))
def rollup_week(lab: Lab) -> DataFrame:
    return _published(lab, rollup.rollup_period(lab.listed_daily, "week"))


@query("rollup_month", _rollup_sql("strftime(date, '%Y-%m')", "strftime(date, '%Y-%m')"))
def rollup_month(lab: Lab) -> DataFrame:
    return _published(lab, lab.months)


@query("rollup_year", _rollup_sql("CAST(year(date) AS INTEGER)", "CAST(year(date) AS INTEGER)"))
def rollup_year(lab: Lab) -> DataFrame:
    return _published(lab, rollup.rollup_period(lab.months, "year"))


@query("rollup_lists", compose("event", """
SELECT person_id, CAST(year(date) AS INTEGER) AS period, domain,
       array_to_string(list(concept_id ORDER BY concept_id), ',') AS concept_ids
FROM event GROUP BY 1, 2, 3"""))
def rollup_lists(lab: Lab) -> DataFrame:
    dated = lab.clinical.events.withColumn("period", F.year("date"))
    plain = spine.expand_list(F.col("concepts")).cast("array<string>")
    return spine.concept_lists(dated, ("person_id", "period")).select(
        "person_id", "period", "domain", F.array_join(plain, ",").alias("concept_ids")
    )


@query("observation_window", compose("volume", """
SELECT person_id, CAST(year AS INTEGER) AS year, year_first_date, year_last_date, days_observed,
       CASE WHEN days_observed >= 300 AND month(year_first_date) <= 2 AND month(year_last_date) >= 11
            THEN 1 ELSE 0 END AS is_full_year FROM volume"""))
def observation_window(lab: Lab) -> DataFrame:
    return features.observation_window(lab.daily.withColumn("year", F.year("date")))


@query("features_core", compose("volume", """
SELECT person_id, CAST(year AS INTEGER) AS year, year_first_date, year_last_date, days_observed,
       visit_count, inpatient_visit_count, hospitalized_days FROM volume"""))
def features_core(lab: Lab) -> DataFrame:
    return lab.features.select(
        "person_id", "year", "year_first_date", "year_last_date", "days_observed", "visit_count",
        "inpatient_visit_count", "hospitalized_days",
    )


@query("inpatient_visits", compose("volume", """
SELECT person_id, CAST(year AS INTEGER) AS year, inpatient_visit_count FROM volume
WHERE inpatient_visit_count > 0"""))
def inpatient_visits(lab: Lab) -> DataFrame:
    return features.inpatient_visits(lab.days)


@query("regularity", compose("feature", """
SELECT f.person_id, CAST(f.year AS INTEGER) AS year, round(f.irregularity_l1, 6) AS irregularity_l1,
       round(f.irregularity_l2, 6) AS irregularity_l2, round(r.central_diff, 6) AS central_diff,
       f.has_valid_regularity,
       CASE WHEN r.person_id IS NOT NULL THEN date_diff('day', g.a, g.b) END AS observation_span_days
FROM feature f LEFT JOIN regularity r ON f.person_id = r.person_id AND f.year = r.year
LEFT JOIN (SELECT person_id, year, min(date) AS a, max(date) AS b FROM gap GROUP BY 1, 2) AS g
  ON f.person_id = g.person_id AND f.year = g.year"""))
def regularity(lab: Lab) -> DataFrame:
    full = features.person_year_features(lab.daily, lab.days, extended=True)
    return full.select(
        "person_id", "year", "irregularity_l1", "irregularity_l2", "central_diff",
        "has_valid_regularity", F.col("observation_span_days").cast("bigint").alias("observation_span_days"),
    )


@query("comorbidity_cumulative", compose("feature", """
SELECT person_id, CAST(year AS INTEGER) AS year, max_cci, has_mi, has_chf, has_diabetes, has_cancer,
       has_ckd FROM feature"""))
def comorbidity_cumulative(lab: Lab) -> DataFrame:
    return lab.features.select(
        "person_id", "year", "max_cci", "has_mi", "has_chf", "has_diabetes", "has_cancer", "has_ckd"
    )


@query("comorbidity_within_year", compose("volume", """
SELECT person_id, CAST(year AS INTEGER) AS year, year_cci AS max_cci, y_mi AS has_mi, y_chf AS has_chf,
       y_diabetes AS has_diabetes, y_cancer AS has_cancer, y_ckd AS has_ckd FROM volume"""))
def comorbidity_within_year(lab: Lab) -> DataFrame:
    df = features.person_year_features(lab.daily, lab.days, cci="within_year")
    return df.select(
        "person_id", "year", "max_cci", "has_mi", "has_chf", "has_diabetes", "has_cancer", "has_ckd"
    )


@query("breadth_total", compose("feature", """
SELECT person_id, CAST(year AS INTEGER) AS year, total_condition_count, total_drug_count,
       total_procedure_count, total_measurement_count FROM feature"""))
def breadth_total(lab: Lab) -> DataFrame:
    return lab.features.select(
        "person_id", "year", "total_condition_count", "total_drug_count", "total_procedure_count",
        "total_measurement_count",
    )


@query("breadth_distinct", compose("volume", """
SELECT v.person_id, CAST(v.year AS INTEGER) AS year,
       coalesce(c, 0) AS unique_condition_count, coalesce(d, 0) AS unique_drug_count,
       coalesce(p, 0) AS unique_procedure_count
FROM volume v LEFT JOIN (
  SELECT person_id, year(date) AS year,
         count(DISTINCT concept_id) FILTER (WHERE domain = 'condition') AS c,
         count(DISTINCT concept_id) FILTER (WHERE domain = 'drug') AS d,
         count(DISTINCT concept_id) FILTER (WHERE domain = 'procedure') AS p
  FROM event GROUP BY 1, 2) AS b ON v.person_id = b.person_id AND v.year = b.year"""))
def breadth_distinct(lab: Lab) -> DataFrame:
    df = features.person_year_features(
        lab.daily, lab.days, lab.clinical.events, breadth="distinct", cci="within_year"
    )
    return df.select(
        "person_id", "year", "unique_condition_count", "unique_drug_count", "unique_procedure_count"
    )


@query("feature_table", compose("feature", """
SELECT * REPLACE (CAST(year AS INTEGER) AS year, round(irregularity_l1, 6) AS irregularity_l1,
                  round(irregularity_l2, 6) AS irregularity_l2),
       lag(max_cci) OVER w AS prior_year_max_cci, lag(visit_count) OVER w AS prior_year_visit_count,
       lag(inpatient_visit_count) OVER w AS prior_year_inpatient_visit_count
FROM feature WINDOW w AS (PARTITION BY person_id ORDER BY year)"""))
def feature_table(lab: Lab) -> DataFrame:
    return features.with_prior_year(lab.features)


@query("prior_year", compose("feature", """
SELECT person_id, CAST(year AS INTEGER) AS year, lag(max_cci) OVER w AS prior_year_max_cci,
       lag(visit_count) OVER w AS prior_year_visit_count,
       lag(inpatient_visit_count) OVER w AS prior_year_inpatient_visit_count
FROM feature WINDOW w AS (PARTITION BY person_id ORDER BY year)"""))
def prior_year(lab: Lab) -> DataFrame:
    return features.with_prior_year(lab.features).select(
        "person_id", "year", "prior_year_max_cci", "prior_year_visit_count",
        "prior_year_inpatient_visit_count",
    )


@query("dq_audit", compose("daily", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE visit_count < 0) AS negative_visits,
       count(*) FILTER (WHERE total_data_points < 0) AS negative_data_points,
       count(*) FILTER (WHERE hospitalized_flag < 0) AS negative_hospital_flags,
       count(*) FILTER (WHERE person_id IS NULL) AS null_persons,
       count(*) FILTER (WHERE date IS NULL) AS null_dates FROM daily"""))
def dq_audit(lab: Lab) -> DataFrame:
    return features.dq_audit(features.load_daily(lab.daily))


@query("cci_monotone_check", compose("feature", """
SELECT count(*) FILTER (WHERE max_cci < b) AS n_violations, count(b) AS n_checked
FROM (SELECT max_cci, lag(max_cci) OVER (PARTITION BY person_id ORDER BY year) AS b FROM feature) AS f"""))
def cci_monotone_check(lab: Lab) -> DataFrame:
    return features.cci_violations(lab.features)


@query("feature_quantiles", compose("feature", """
SELECT feature, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
       min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
       round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
       max(value) AS max
FROM (SELECT CAST(visit_count AS DOUBLE) AS visit_count,
             CAST(inpatient_visit_count AS DOUBLE) AS inpatient_visit_count,
             CAST(hospitalized_days AS DOUBLE) AS hospitalized_days FROM feature) AS f
UNPIVOT (value FOR feature IN (visit_count, inpatient_visit_count, hospitalized_days)) GROUP BY 1"""))
def feature_quantiles(lab: Lab) -> DataFrame:
    long = lab.features.select(
        *[F.col(c).cast("double").alias(c) for c in ("visit_count", "inpatient_visit_count", "hospitalized_days")]
    ).unpivot([], ["visit_count", "inpatient_visit_count", "hospitalized_days"], "feature", "value")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        long.groupBy("feature")
        .agg(
            F.count("value").alias("n"), F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("sd"), F.min("value").alias("min"),
            q.alias("q"), F.max("value").alias("max"),
        )
        .select("feature", "n", "mean", "sd", "min", F.col("q")[0].alias("q1"),
                F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")
    )


@query("language_mix", compose("person event0", """
, l AS (SELECT DISTINCT p.person_id, coalesce(o.value_as_string, 'Not Recorded') AS language
        FROM person p LEFT JOIN (
          SELECT person_id, CASE l_returnflag WHEN 'A' THEN 'English' WHEN 'R' THEN 'Spanish' END AS value_as_string
          FROM event0 WHERE domain = 'observation' AND l_partkey % 11 = 0) AS o
        ON p.person_id = o.person_id)
SELECT language, count(*) AS patient_count,
       round(count(*) * 100.0 / (SELECT count(DISTINCT person_id) FROM person), 1) AS percentage
FROM l GROUP BY 1"""))
def language_mix(lab: Lab) -> DataFrame:
    return timelines.language_mix(lab.clinical.person, lab.clinical.languages, LANGUAGE_CONCEPTS)


@query("inpatient_span_merge", compose("visit", """
, s AS (SELECT person_id, visit_start_date AS a,
          CASE WHEN visit_end_date IS NULL OR visit_end_date < visit_start_date THEN visit_start_date
               ELSE visit_end_date END AS b
        FROM visit WHERE visit_concept_id IN (9201, 262)),
m AS (SELECT *, max(b) OVER (PARTITION BY person_id ORDER BY a, b
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s),
i AS (SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END)
              OVER (PARTITION BY person_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT person_id, min(a) AS span_start, max(b) AS span_end, count(*) AS n_stays
FROM i GROUP BY person_id, island"""))
def inpatient_span_merge(lab: Lab) -> DataFrame:
    return timelines.merged_stays(lab.clinical.visits)


@query("visit_tokens", compose("visit", """
SELECT token, count(*) AS n FROM (
  SELECT UNNEST(string_split(CASE WHEN visit_concept_id IN (9201, 262) THEN 'Inpatient | Stay'
                                  ELSE 'Outpatient' END, ' | ')) AS token FROM visit) AS t GROUP BY 1"""))
def visit_tokens(lab: Lab) -> DataFrame:
    named = lab.clinical.visits.select(
        F.when(F.col("visit_concept_id").isin(9201, 262), "Inpatient | Stay")
        .otherwise("Outpatient")
        .alias("names")
    )
    return timelines.explode_tokens(named, "names", "token").groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("timeline_page", compose("daily", """
SELECT person_id, date, visit_count, CAST(lane AS INTEGER) AS lane,
       round(year(date) + (dayofyear(date) - 1.0)
         / (CASE WHEN year(date) % 4 = 0 AND (year(date) % 100 <> 0 OR year(date) % 400 = 0)
                 THEN 366 ELSE 365 END), 6) AS x
FROM (SELECT *, dense_rank() OVER (ORDER BY person_id) - 1 AS lane FROM daily) AS d
WHERE lane >= 20 AND lane < 30"""))
def timeline_page(lab: Lab) -> DataFrame:
    return timelines.page(lab.stored_daily, page=3, page_size=10).select(
        "person_id", "date", "visit_count", "lane", "x"
    )


@query("suppressed_counts", compose("rule", """
, c AS (SELECT archetype, CAST(year AS INTEGER) AS year, count(*) AS n, count(DISTINCT person_id) AS n_persons
        FROM rule GROUP BY 1, 2)
SELECT archetype, year,
       CASE WHEN n > 0 AND n < 10 THEN '<10' ELSE CAST(n AS VARCHAR) END AS n,
       CASE WHEN n_persons > 0 AND n_persons < 10 THEN '<10' ELSE CAST(n_persons AS VARCHAR) END AS n_persons
FROM c"""))
def suppressed_counts(lab: Lab) -> DataFrame:
    counts = lab.rules.groupBy("archetype", "year").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("n_persons")
    )
    return sinks.suppress_small_cells(counts)


@query("archetype_display_order", compose("rule", """
SELECT archetype, count(*) AS n, CAST(list_position(['Sparse Use', 'Regular Infrequent',
  'Irregular Infrequent', 'Regular Frequent', 'Irregular Frequent', 'Multiple Complex Episodes',
  'Sporadic Complex Episodes'], archetype) AS INTEGER) AS position
FROM rule GROUP BY 1"""))
def archetype_display_order(lab: Lab) -> DataFrame:
    counts = lab.rules.groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.withColumn("position", position_in("archetype", ARCHETYPES).cast("int"))
    return order_by_list(placed, "archetype", ARCHETYPES)
