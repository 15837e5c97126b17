"""Archetype rules, tracking and adaptive tuning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ARCHETYPES
from ..operators import rules, sampling, tuning
from .lab import Lab
from .oracle import TUNED, compose, rule_case
from .registry import query

_YEAR = "CAST(year AS INTEGER) AS year"


@query("archetype_distribution", compose("rule", """
SELECT archetype, count(*) AS person_years, count(DISTINCT person_id) AS unique_persons
FROM rule GROUP BY 1"""))
def archetype_distribution(lab: Lab) -> DataFrame:
    return rules.group_counts(lab.rules, "archetype")


@query("rules_vanilla", compose("rule", f"""
SELECT person_id, {_YEAR}, archetype, irregularity_l1 < 0.5 AS is_regular,
  CASE WHEN inpatient_visit_count >= 2 THEN 'IP visits >= 2 (n=' || inpatient_visit_count || ')'
       WHEN inpatient_visit_count = 1 THEN '1 IP visit'
       WHEN visit_count <= 1 THEN 'Single visit or no visits'
       ELSE CASE WHEN visit_count >= 4 THEN '≥4' ELSE '2-3' END || ' visits + '
            || CASE WHEN coalesce(irregularity_l1, 1.0) < 0.5 THEN 'regular' ELSE 'irregular' END
            || ' (score=' || CAST(CAST(round(CAST(CAST(coalesce(irregularity_l1, 1.0) AS VARCHAR) AS DECIMAL(30, 20)), 2)
                                  AS DECIMAL(20, 2)) AS VARCHAR) || ')' END AS reason
FROM rule"""))
def rules_vanilla(lab: Lab) -> DataFrame:
    """The score's text is the decimal number rounded half up, in the SQL by way of a decimal."""
    return lab.rules.select("person_id", "year", "archetype", "is_regular", F.col("archetype_reason").alias("reason"))


@query("rules_tracking", compose("tracked", f"""
SELECT person_id, {_YEAR}, archetype, prior AS prior_year_archetype_rules, archetype_changed,
       segment_id, CAST(years_in_current_archetype AS INTEGER) AS years_in_current_archetype
FROM tracked"""))
def rules_tracking(lab: Lab) -> DataFrame:
    return rules.vanilla(lab.features).select(
        "person_id", "year", "archetype", "prior_year_archetype_rules", "archetype_changed",
        "segment_id", "years_in_current_archetype",
    )


@query("transition_rate", compose("tracked", """
SELECT count(*) AS total_person_years_with_prior,
       CAST(sum(archetype_changed) AS BIGINT) AS total_changes,
       round(sum(archetype_changed) * 100.0 / count(*), 6) AS pct_changed
FROM tracked WHERE prior IS NOT NULL"""))
def transition_rate(lab: Lab) -> DataFrame:
    return rules.transition_rate(rules.track(lab.rules))


@query("archetype_stability", compose("tracked", """
SELECT prior AS archetype, round(avg(CASE WHEN archetype = prior THEN 100.0 ELSE 0.0 END), 6)
         AS stability_pct
FROM tracked WHERE prior IS NOT NULL GROUP BY 1"""))
def archetype_stability(lab: Lab) -> DataFrame:
    return rules.stability(rules.track(lab.rules))


_ORDER_KEY = """((((person_id % 1000003) * 7919 + year * 104729 + CAST(42 AS BIGINT) * 15485863) % 1299709)
  * (((person_id % 1000003) * 7919 + year * 104729 + CAST(42 AS BIGINT) * 15485863) % 1299709)
  + year * 31) % 1299721"""


@query("training_sample", compose("feature", f"""
SELECT person_id, {_YEAR}, CASE WHEN rn = 1 THEN 1 ELSE 0 END AS training_data
FROM (SELECT person_id, year, row_number() OVER (PARTITION BY person_id
        ORDER BY {_ORDER_KEY}, year) AS rn FROM feature) AS f"""))
def training_sample(lab: Lab) -> DataFrame:
    return sampling.with_training_flag(lab.features).select("person_id", "year", "training_data")



def _sample_sql(needs: str) -> str:
    return compose(needs, f"""
, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id
        ORDER BY {_ORDER_KEY}, year) AS rn FROM feature) AS f WHERE rn = 1)""")


SAMPLE_SQL = _sample_sql("feature")


def _curve_sql(source: str) -> str:
    cells = ", ".join(
        f"count(*) FILTER (WHERE a = '{a}') AS \"{a}\"" for a in ARCHETYPES
    )
    return f"""{SAMPLE_SQL},
g AS (SELECT CAST(i * 0.05 AS DOUBLE) AS threshold FROM range(0, 21) AS r(i)),
c AS (SELECT round(threshold, 6) AS threshold, {rule_case('round(threshold, 6)')} AS a FROM {source}, g)
SELECT threshold, {cells}, count(*) AS total FROM c GROUP BY 1"""


@query("threshold_curve", _curve_sql("feature"))
def threshold_curve(lab: Lab) -> DataFrame:
    return tuning.threshold_curve(lab.features, "irregularity_l1", tuning.grid(0.0, 1.0, 0.05))


@query("threshold_curve_sample", _curve_sql("s"))
def threshold_curve_sample(lab: Lab) -> DataFrame:
    return tuning.threshold_curve(
        sampling.one_year_per_person(lab.features), "irregularity_l1", tuning.grid(0.0, 1.0, 0.05)
    )


_PCT = " ".join(
    f", (\"{a}\" * 100.0 / total) AS p{i}" for i, a in enumerate(ARCHETYPES)
)
_GRAD = " + ".join(
    f"""abs(CASE WHEN lag(p{i}) OVER w IS NULL THEN (lead(p{i}) OVER w - p{i}) / (lead(threshold) OVER w - threshold)
      WHEN lead(p{i}) OVER w IS NULL THEN (p{i} - lag(p{i}) OVER w) / (threshold - lag(threshold) OVER w)
      ELSE (lead(p{i}) OVER w - lag(p{i}) OVER w) / (lead(threshold) OVER w - lag(threshold) OVER w) END)"""
    for i in (1, 2, 3, 4)
)


@query("stability_curve", _curve_sql("feature").replace("SELECT threshold, count", ", k AS (SELECT threshold, count", 1)
       + f""")
, p AS (SELECT threshold {_PCT} FROM k),
d AS (SELECT threshold, {_GRAD} AS total_derivative FROM p WINDOW w AS (ORDER BY threshold))
SELECT threshold, round(total_derivative, 6) AS total_derivative,
       round(avg(total_derivative) OVER (ORDER BY threshold ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6)
         AS smoothed_derivative
FROM d""")
def stability_curve(lab: Lab) -> DataFrame:
    curve = tuning.threshold_curve(lab.features, "irregularity_l1", tuning.grid(0.0, 1.0, 0.05))
    return tuning.stability_curve(curve, n_points=21)


_DIVERGENCE = """(SELECT 0.5 * sum(p * ln(p / m)) + 0.5 * sum(q * ln(q / m))
   FROM (SELECT greatest(coalesce(a.share, 0), 1e-12) AS p, greatest(coalesce(b.share, 0), 1e-12) AS q,
                greatest((coalesce(a.share, 0) + coalesce(b.share, 0)) / 2, 1e-12) AS m
         FROM a FULL JOIN b ON a.c = b.c) AS j)"""


@query("threshold_choice", _sample_sql("tuned") + f""",
a AS (SELECT {rule_case(TUNED)} AS c, count(*) * 1.0 / (SELECT count(*) FROM s) AS share FROM s GROUP BY 1),
b AS (SELECT {rule_case(TUNED)} AS c, count(*) * 1.0 / (SELECT count(*) FROM feature) AS share FROM feature GROUP BY 1)
SELECT threshold AS optimal_threshold,
  CASE WHEN width >= 3 AND jsd < 0.02 THEN 'HIGH' WHEN width >= 2 AND jsd < 0.05 THEN 'MODERATE' ELSE 'LOW' END AS confidence,
  round((SELECT sum(share) * 100 FROM b WHERE c LIKE 'Regular%'), 6) AS regular_pct,
  round((SELECT sum(share) * 100 FROM b WHERE c LIKE 'Irregular%'), 6) AS irregular_pct,
  round(least, 6) AS stability_min_derivative, round(width * CAST(0.05 AS DOUBLE), 6) AS stability_plateau_width,
  round(jsd, 6) AS js_divergence_sample_full, grid_min AS threshold_grid_min, grid_max AS threshold_grid_max,
  CAST(0.05 AS DOUBLE) AS threshold_grid_step
FROM (SELECT *, {_DIVERGENCE} AS jsd FROM tuned) AS t""")
def threshold_choice(lab: Lab) -> DataFrame:
    return tuning.choice_row(lab.spark, tuning.find_threshold(lab.stored_features, "L1"))


@query("null_score_audit", compose("feature", """
SELECT count(*) AS n_relevant, count(*) FILTER (WHERE irregularity_l1 IS NULL) AS n_null,
       round(count(*) FILTER (WHERE irregularity_l1 IS NULL) * 1.0 / count(*), 6) AS null_rate
FROM feature WHERE inpatient_visit_count = 0 AND visit_count >= 2"""))
def null_score_audit(lab: Lab) -> DataFrame:
    return tuning.null_score_audit(lab.features, "irregularity_l1")


@query("adaptive_confidence", compose("feature", f"""
, q AS (SELECT
  (SELECT quantile_disc(irregularity_l1, 0.75) - quantile_disc(irregularity_l1, 0.25) FROM feature
   WHERE inpatient_visit_count = 0 AND visit_count >= 4 AND irregularity_l1 IS NOT NULL) AS f,
  (SELECT quantile_disc(irregularity_l1, 0.75) - quantile_disc(irregularity_l1, 0.25) FROM feature
   WHERE inpatient_visit_count = 0 AND visit_count BETWEEN 2 AND 3 AND irregularity_l1 IS NOT NULL) AS i)
SELECT person_id, {_YEAR}, {rule_case('0.4')} AS archetype, round(
  CASE WHEN inpatient_visit_count >= 1 OR visit_count <= 1 THEN 1.0
       WHEN irregularity_l1 IS NULL THEN 0.2
       ELSE least(1.0, abs(irregularity_l1 - 0.4)
            / greatest(0.1, CASE WHEN visit_count >= 4 THEN f ELSE i END)) END, 6) AS archetype_confidence
FROM feature, q"""))
def adaptive_confidence(lab: Lab) -> DataFrame:
    return tuning.adaptive(lab.stored_features, "L1", 0.4).select(
        "person_id", "year", "archetype", "archetype_confidence"
    )


@query("penalty_stats", compose("feature", """
, v AS (SELECT * FROM feature WHERE irregularity_l1 IS NOT NULL AND irregularity_l2 IS NOT NULL),
c AS (SELECT quantile_cont(visit_count, 0.9) AS p90 FROM v),
r AS (SELECT *, rank() OVER (ORDER BY irregularity_l1) + (count(*) OVER (PARTITION BY irregularity_l1) - 1) / 2.0 AS r1,
             rank() OVER (ORDER BY irregularity_l2) + (count(*) OVER (PARTITION BY irregularity_l2) - 1) / 2.0 AS r2 FROM v)
SELECT count(*) AS n, round(stddev_samp(irregularity_l1) / avg(irregularity_l1), 6) AS l1_cv,
  round(stddev_samp(irregularity_l2) / avg(irregularity_l2), 6) AS l2_cv,
  count(*) FILTER (WHERE visit_count >= p90) AS n_high,
  round(stddev_samp(irregularity_l1) FILTER (WHERE visit_count >= p90), 6) AS l1_high_sd,
  round(stddev_samp(irregularity_l2) FILTER (WHERE visit_count >= p90), 6) AS l2_high_sd,
  round(corr(irregularity_l1, irregularity_l2), 6) AS pearson, round(corr(r1, r2), 6) AS spearman,
  round(avg(CASE WHEN (irregularity_l1 > 0.3) = (irregularity_l2 > 0.3) THEN 1.0 ELSE 0.0 END), 6) AS agree_30,
  round(avg(CASE WHEN (irregularity_l1 > 0.4) = (irregularity_l2 > 0.4) THEN 1.0 ELSE 0.0 END), 6) AS agree_40,
  round(avg(CASE WHEN (irregularity_l1 > 0.5) = (irregularity_l2 > 0.5) THEN 1.0 ELSE 0.0 END), 6) AS agree_50,
  round(avg(CASE WHEN (irregularity_l1 > 0.6) = (irregularity_l2 > 0.6) THEN 1.0 ELSE 0.0 END), 6) AS agree_60,
  round(avg(CASE WHEN (irregularity_l1 > 0.7) = (irregularity_l2 > 0.7) THEN 1.0 ELSE 0.0 END), 6) AS agree_70
FROM r, c"""))
def penalty_stats(lab: Lab) -> DataFrame:
    return tuning.penalty_stats(lab.stored_features)


@query("penalty_choice")
def penalty_choice(lab: Lab) -> DataFrame:
    return tuning.choice_row(lab.spark, tuning.choose_penalty(lab.stored_features))


@query("js_divergence", _curve_sql("s").rsplit("g AS (SELECT CAST", 1)[0] + f"""
a AS (SELECT archetype AS c, count(*) * 1.0 / (SELECT count(*) FROM s) AS share
      FROM (SELECT {rule_case('0.5')} AS archetype FROM s) AS x GROUP BY 1),
b AS (SELECT archetype AS c, count(*) * 1.0 / (SELECT count(*) FROM feature) AS share
      FROM (SELECT {rule_case('0.5')} AS archetype FROM feature) AS x GROUP BY 1),
j AS (SELECT greatest(coalesce(a.share, 0), 1e-12) AS p, greatest(coalesce(b.share, 0), 1e-12) AS q,
             greatest((coalesce(a.share, 0) + coalesce(b.share, 0)) / 2, 1e-12) AS m
      FROM a FULL JOIN b ON a.c = b.c)
SELECT round(0.5 * sum(p * ln(p / m)) + 0.5 * sum(q * ln(q / m)), 6) AS js_divergence FROM j""")
def js_divergence(lab: Lab) -> DataFrame:
    sample = rules.classify(sampling.one_year_per_person(lab.features))
    return tuning.js_divergence(sample, lab.rules, "archetype")


@query("compare_stability", compose("tuned", f"""
, a AS (SELECT person_id, year, {rule_case('0.5')} AS v, {rule_case(TUNED)} AS w FROM feature),
l AS (SELECT *, lag(v) OVER x AS pv, lag(w) OVER x AS pw FROM a
      WINDOW x AS (PARTITION BY person_id ORDER BY year)),
sv AS (SELECT pv AS archetype, avg(CASE WHEN v = pv THEN 100.0 ELSE 0.0 END) AS s FROM l WHERE pv IS NOT NULL GROUP BY 1),
sw AS (SELECT pw AS archetype, avg(CASE WHEN w = pw THEN 100.0 ELSE 0.0 END) AS s FROM l WHERE pw IS NOT NULL GROUP BY 1)
SELECT coalesce(sv.archetype, sw.archetype) AS archetype, round(coalesce(sv.s, 0), 6) AS vanilla_stability,
       round(coalesce(sw.s, 0), 6) AS adaptive_stability,
       round(coalesce(sw.s, 0) - coalesce(sv.s, 0), 6) AS improvement
FROM sv FULL JOIN sw ON sv.archetype = sw.archetype"""))
def compare_stability(lab: Lab) -> DataFrame:
    labels = lab.stored_labels
    return rules.compare_stability(rules.track(labels), rules.track(rules.classify(labels, threshold=lab.tuned_threshold)))
