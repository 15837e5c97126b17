"""Residual, association and cross-cohort queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    ARCHETYPES,
    BREADTH_FEATURES,
    BREADTH_LABELS,
    DENSITY_METRICS,
    DOMAINS,
    GMM4_LABELS,
    GMM4_ORDER,
)
from ..functions.stability import settle
from ..operators import cohorts, features, residuals, rollup
from .lab import Lab
from .oracle import block, compose
from .registry import query

_K = "gmm_4_cluster"
_SHORT = [residuals.short_name(c) for c in BREADTH_FEATURES]

block("resid", "labelled", "SELECT *, " + ", ".join(
    f"{c} - avg({c}) OVER (PARTITION BY gmm_4_cluster) AS domain_resid_{s}"
    for c, s in zip(BREADTH_FEATURES, _SHORT)) + " FROM labelled")
block("outcome", "resid", " UNION ALL ".join(
    f"SELECT person_id, year, gmm_4_cluster, max_cci, '{name}' AS outcome, {expr} AS value FROM resid"
    for s in _SHORT
    for name, expr in ((f"domain_resid_{s}", f"domain_resid_{s}"), (f"domain_abs_resid_{s}", f"abs(domain_resid_{s})"))))
block("domainrow", "labelled", " UNION ALL ".join(
    f"SELECT gmm_4_cluster, '{BREADTH_LABELS[c]}' AS domain, CAST({c} AS DOUBLE) AS value FROM labelled"
    for c in BREADTH_FEATURES))
_NAME = ("CASE gmm_4_cluster WHEN 0 THEN 'Moderate Inpatient' WHEN 1 THEN 'Outpatient Irregular' "
         "WHEN 2 THEN 'Outpatient Regular' ELSE 'High Inpatient' END")


def _with_resid(lab: Lab) -> DataFrame:
    return residuals.with_residuals(lab.stored_labels, _K)


def _outcomes(lab: Lab) -> DataFrame:
    return residuals.outcome_rows(_with_resid(lab), _K, residuals.all_outcomes())


def _domains(lab: Lab) -> DataFrame:
    return residuals.domain_rows(lab.stored_labels, _K)


@query("residuals", compose("resid", f"""
SELECT person_id, CAST(year AS INTEGER) AS year, gmm_4_cluster, {_NAME} AS cluster_label, max_cci, """ + ", ".join(
    f"round(domain_resid_{s}, 6) AS domain_resid_{s}, round(abs(domain_resid_{s}), 6) AS domain_abs_resid_{s}"
    for s in _SHORT) + " FROM resid"))
def residual_table(lab: Lab) -> DataFrame:
    return residuals.with_residuals(lab.stored_labels, _K).select(
        "person_id", "year", _K, F.col("gmm_4_cluster_label").alias("cluster_label"), "max_cci",
        *residuals.all_outcomes(),
    )


@query("residual_spread", compose("outcome", """
SELECT gmm_4_cluster, outcome, round(avg(value), 4) + 0.0 AS mean, round(stddev_samp(value), 4) AS sd
FROM outcome GROUP BY 1, 2"""))
def residual_spread(lab: Lab) -> DataFrame:
    return residuals.residual_spread(_with_resid(lab), _K, residuals.all_outcomes())


@query("residual_class", compose("resid", f"""
SELECT person_id, CAST(year AS INTEGER) AS year, gmm_4_cluster, {_NAME} AS cluster_label,
  gmm_4_cluster = 2 AS is_reference_cluster, max_cci,
  round(({" + ".join(f"domain_resid_{s}" for s in _SHORT)}) / 4, 6) AS avg_cross_domain_residual,
  CASE WHEN ({" + ".join(f"domain_resid_{s}" for s in _SHORT)}) / 4 >= 0 THEN 'above' ELSE 'below' END AS above_below_cluster_mean
FROM resid"""))
def residual_class(lab: Lab) -> DataFrame:
    return residuals.classification(_with_resid(lab), _K, residuals.signed_outcomes()).select(
        "person_id", "year", _K, F.col("gmm_4_cluster_label").alias("cluster_label"),
        "is_reference_cluster", "max_cci", "avg_cross_domain_residual", "above_below_cluster_mean",
    )


def _spearman_sql(keys: str) -> str:
    return compose("outcome", f"""
, r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value)
                  + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2.0 AS rv,
               rank() OVER (PARTITION BY {keys} ORDER BY max_cci)
                  + (count(*) OVER (PARTITION BY {keys}, max_cci) - 1) / 2.0 AS rc FROM outcome)
SELECT {keys}, count(*) AS n, round(corr(rv, rc), 6) AS spearman_rho, count(DISTINCT person_id) AS n_patients
FROM r GROUP BY {keys}""")


def _simpson(density: str, start: str, end: str, steps: int = 2000) -> str:
    """SQL of the integral of ``density`` (of ``u``) by Simpson's rule; nulls give null."""
    at = density.replace("u", f"({start} + ({end} - ({start})) * i / {steps}.0)")
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return f"(({end} - ({start})) / {3 * steps}.0 * (SELECT sum({weight} * {at}) FROM range(0, {steps + 1}) AS g(i)))"


# A t value on f degrees of freedom is sqrt(f) tan(a), so its tail is one of cos(a)^(f - 1), with a = asin(rho)
_REACH = "least(pi() / 2, {} + 12 / sqrt(n - 2))"
_RHO_TAIL = "{} / {}".format(
    _simpson("power(cos(u), n - 3)", "asin(abs(rho))", _REACH.format("asin(abs(rho))")),
    _simpson("power(cos(u), n - 3)", "0.0", _REACH.format("0.0")),
)


@query("spearman_pooled", _spearman_sql("outcome"))
def spearman_pooled(lab: Lab) -> DataFrame:
    return residuals.spearman(_outcomes(lab), ["outcome"])


@query("spearman_by_cluster", _spearman_sql("outcome, gmm_4_cluster"))
def spearman_by_cluster(lab: Lab) -> DataFrame:
    return residuals.spearman(_outcomes(lab), ["outcome", _K])


@query("spearman_p", f"""
SELECT outcome, gmm_4_cluster, n, round(rho, 6) AS spearman_rho, n_patients, round(p, 6) AS p_value, p < 0.05 / 4 AS significant_bonferroni
FROM (SELECT *, {_RHO_TAIL} AS p FROM ({_spearman_sql("outcome, gmm_4_cluster").replace("round(corr(rv, rc), 6) AS spearman_rho", "corr(rv, rc) AS rho")}) AS c) AS t""")
def spearman_p(lab: Lab) -> DataFrame:
    rho = residuals.spearman(_outcomes(lab), ["outcome", _K])
    return residuals.with_bonferroni(residuals.spearman_p(rho))


@query("ols_interaction", compose("outcome", """
, m AS (SELECT outcome, avg(value) AS a, stddev_pop(value) AS s, min(value) AS lo FROM outcome GROUP BY 1),
sk AS (SELECT m.outcome, lo >= 0 AND abs(avg(power((value - a) / s, 3))) > 1 AS logged
       FROM outcome o JOIN m ON o.outcome = m.outcome GROUP BY 1, m.lo),
d AS (SELECT o.*, CASE WHEN logged THEN ln(1 + value) ELSE value END AS y FROM outcome o JOIN sk ON o.outcome = sk.outcome),
l AS (SELECT outcome, gmm_4_cluster, regr_slope(y, max_cci) AS b, regr_intercept(y, max_cci) AS a,
             avg(max_cci) AS mx, var_pop(max_cci) * count(*) AS sxx FROM d GROUP BY 1, 2),
e AS (SELECT d.*, l.b, y - l.a - l.b * max_cci AS res, (max_cci - mx) / sxx * (y - l.a - l.b * max_cci) AS v
      FROM d JOIN l ON d.outcome = l.outcome AND d.gmm_4_cluster = l.gmm_4_cluster),
p AS (SELECT outcome, person_id, sum(CASE WHEN gmm_4_cluster = 2 THEN v ELSE 0 END) AS v2,
             sum(CASE WHEN gmm_4_cluster = 0 THEN v ELSE 0 END) AS v0,
             sum(CASE WHEN gmm_4_cluster = 1 THEN v ELSE 0 END) AS v1,
             sum(CASE WHEN gmm_4_cluster = 3 THEN v ELSE 0 END) AS v3 FROM e GROUP BY 1, 2),
q AS (SELECT outcome, count(*) * 1.0 / (count(*) - 1) AS gc, sum(power(v0 - v2, 2)) AS s0,
             sum(power(v1 - v2, 2)) AS s1, sum(power(v3 - v2, 2)) AS s3 FROM p GROUP BY 1),
t AS (SELECT outcome, count(*) AS n, 1 - sum(res * res) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY 1)
SELECT l.outcome, l.gmm_4_cluster, round(l.b - r.b, 6) AS coef,
  round(sqrt(CASE l.gmm_4_cluster WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s3 END * gc * (n - 1) / (n - 8)), 6) AS se,
  round(r2, 6) AS r_squared, n AS n_obs
FROM l JOIN l r ON l.outcome = r.outcome AND r.gmm_4_cluster = 2 JOIN q ON l.outcome = q.outcome
JOIN t ON l.outcome = t.outcome WHERE l.gmm_4_cluster <> 2"""))
def ols_interaction(lab: Lab) -> DataFrame:
    return residuals.interaction_ols(_outcomes(lab), _K, [0, 1, 2, 3])


@query("ols_interaction_p")
def ols_interaction_p(lab: Lab) -> DataFrame:
    return residuals.interaction_p(residuals.interaction_ols(_outcomes(lab), _K, [0, 1, 2, 3]))


@query("logit_or")
def logit_or(lab: Lab) -> DataFrame:
    return residuals.multinomial_logit(residuals.last_year_counts(lab.labelled, _K), GMM4_LABELS)


@query("last_year_counts", compose("labelled", """
SELECT max_cci, gmm_4_cluster AS cluster, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY year DESC) AS r FROM labelled) AS l
WHERE r = 1 GROUP BY 1, 2"""))
def last_year_counts(lab: Lab) -> DataFrame:
    return residuals.last_year_counts(lab.labelled, _K)


@query("domain_iqr", compose("domainrow", f"""
, d AS (SELECT domain, {_NAME} AS cluster, value FROM domainrow UNION ALL SELECT domain, 'Full Cohort', value FROM domainrow)
SELECT domain, cluster, count(*) AS n, round(quantile_cont(value, 0.5), 1) AS median,
       round(quantile_cont(value, 0.25), 1) AS q1, round(quantile_cont(value, 0.75), 1) AS q3,
       round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1) AS iqr
FROM d GROUP BY 1, 2"""))
def domain_iqr(lab: Lab) -> DataFrame:
    return residuals.domain_quartiles(_domains(lab), _K, GMM4_LABELS)


_RANKED = """
, r AS (SELECT *, rank() OVER (PARTITION BY domain ORDER BY value)
                  + (count(*) OVER (PARTITION BY domain, value) - 1) / 2.0 AS rk,
               count(*) OVER (PARTITION BY domain) AS n FROM domainrow)"""


@query("kruskal_h", compose("domainrow", _RANKED + """
, g AS (SELECT domain, gmm_4_cluster, max(n) AS n, sum(rk) * sum(rk) / count(*) AS part FROM r GROUP BY 1, 2),
t AS (SELECT domain, sum(c * c * c - c) AS tie FROM (SELECT domain, value, CAST(count(*) AS DOUBLE) AS c FROM domainrow GROUP BY 1, 2) AS x GROUP BY 1)
SELECT g.domain, round((12.0 / (max(n) * (max(n) + 1.0)) * sum(part) - 3 * (max(n) + 1))
         / (1 - max(tie) / (power(max(n), 3) - max(n))), 6) AS kw_statistic, count(*) AS n_groups
FROM g JOIN t ON g.domain = t.domain GROUP BY 1"""))
def kruskal_h(lab: Lab) -> DataFrame:
    return residuals.kruskal(_domains(lab), _K)


@query("kruskal_p")
def kruskal_p(lab: Lab) -> DataFrame:
    return residuals.kruskal_p(residuals.kruskal(_domains(lab), _K))


_BISERIAL = """
, f AS (SELECT domain, value, count(*) AS c FROM domainrow GROUP BY 1, 2),
h AS (SELECT *, sum(c) OVER (PARTITION BY domain ORDER BY value) - c AS below FROM f),
n AS (SELECT domain, count(*) AS n2 FROM domainrow GROUP BY 1),
u AS (SELECT d.domain, d.gmm_4_cluster, count(*) AS n1, sum(below + c / 2.0) AS u
      FROM domainrow d JOIN h ON d.domain = h.domain AND d.value = h.value GROUP BY 1, 2),
""" + f"""
b AS (SELECT u.domain, {_NAME} AS cluster, 2 * u / (n1 * 1.0 * n2) - 1 AS rb FROM u JOIN n ON u.domain = n.domain)"""


@query("rank_biserial", compose("domainrow", _BISERIAL + """
SELECT domain, cluster, round(rb, 6) AS rank_biserial, round(-rb, 6) AS rank_biserial_ref,
  CASE WHEN rb > 0.1 THEN 'higher than cohort' WHEN rb < -0.1 THEN 'lower than cohort'
       ELSE 'similar to cohort' END AS direction FROM b"""))
def rank_biserial(lab: Lab) -> DataFrame:
    return residuals.rank_biserial(_domains(lab), _K, GMM4_LABELS)


@query("rank_biserial_matrix", compose("domainrow", _BISERIAL + "SELECT domain, " + ", ".join(
    f"round(max(CASE WHEN cluster = '{c}' THEN rb END), 6) AS \"{c}\"" for c in GMM4_ORDER) + " FROM b GROUP BY 1"))
def rank_biserial_matrix(lab: Lab) -> DataFrame:
    return residuals.effect_matrix(residuals.rank_biserial(_domains(lab), _K, GMM4_LABELS), GMM4_ORDER)


@query("effect_extremes", compose("domainrow", _BISERIAL + """
SELECT cluster, arg_min(domain, {'a': round(rb, 3), 'b': domain}) AS most_under, min(round(rb, 3)) AS under_effect,
       arg_max(domain, {'a': round(rb, 3), 'b': domain}) AS most_over, max(round(rb, 3)) AS over_effect
FROM b GROUP BY 1"""))
def effect_extremes(lab: Lab) -> DataFrame:
    return residuals.effect_extremes(residuals.rank_biserial(_domains(lab), _K, GMM4_LABELS))


@query("association_summary")
def association_summary(lab: Lab) -> DataFrame:
    """All tests of the association analysis as text rows."""
    rows = _outcomes(lab)
    pooled = residuals.spearman_p(residuals.spearman(rows, ["outcome"]))
    by_cluster = residuals.spearman_p(residuals.spearman(rows, ["outcome", _K]))
    terms = residuals.interaction_p(residuals.interaction_ols(rows, _K, [0, 1, 2, 3]))
    odds = residuals.multinomial_logit(residuals.last_year_counts(lab.stored_labels, _K), GMM4_LABELS)
    return residuals.summary_table(pooled, by_cluster, terms, odds, _K, GMM4_LABELS)


# cross-cohort -------------------------------------------------------------

_YEARLY = [c for _, c in DENSITY_METRICS] + ["total_nomatch_concepts"]
_SUMS = ", ".join(f"CAST(sum({d}_{s}) AS BIGINT) AS {d}_{s}" for d in DOMAINS for s in ("count", "nomatch_ct"))
block("yearcount", "daily event", f"""
SELECT s.*, {", ".join(f"coalesce({d}_unique_ct, 0) AS {d}_unique_ct" for d in DOMAINS)},
       {" + ".join(f"coalesce({d}_unique_ct, 0)" for d in DOMAINS)} AS total_unique_concepts
FROM (SELECT person_id, year(date) AS year, {_SUMS}, CAST(sum(total_data_points) AS BIGINT) AS total_data_points,
             CAST(sum(total_nomatch_concepts) AS BIGINT) AS total_nomatch_concepts FROM daily GROUP BY 1, 2) AS s
LEFT JOIN (SELECT person_id, year(date) AS year, {", ".join(
    f"count(DISTINCT concept_id) FILTER (WHERE domain = '{d}') AS {d}_unique_ct" for d in DOMAINS)}
  FROM event GROUP BY 1, 2) AS u ON s.person_id = u.person_id AND s.year = u.year""")
block("charac", "labelled yearcount", f"""
SELECT l.*, lag(l.max_cci) OVER (PARTITION BY l.person_id ORDER BY l.year) AS prior_year_max_cci,
       {", ".join(f"y.{c}" for c in _YEARLY)}, {_NAME} AS gmm_4_named
FROM labelled l LEFT JOIN yearcount y ON l.person_id = y.person_id AND l.year = y.year""")
block("metric", "charac", " UNION ALL ".join(
    f"SELECT person_id, year, days_observed, archetype, gmm_4_named, cohort, prior_year_max_cci, '{m}' AS \"Metric\", "
    f"CAST({c} AS DOUBLE) AS value FROM charac" for m, c in DENSITY_METRICS))


def _characterised(lab: Lab) -> DataFrame:
    yearly = rollup.rollup_period(lab.months, "year", dates=False, lists=False)
    full = cohorts.assemble(features.with_prior_year(lab.labelled), yearly, _YEARLY)
    return full.withColumn("gmm_4_named", F.col("gmm_4_cluster_label"))


def _stored(lab: Lab, *columns: str) -> DataFrame:
    """Columns of the characterised rows behind a checkpoint, for more than one reader."""
    return settle(_characterised(lab).select(*columns))


@query("label_assembly", compose("charac", f"""
SELECT person_id, CAST(year AS INTEGER) AS year, archetype, gmm_4_cluster, gmm_7_cluster, cohort,
       prior_year_max_cci, {", ".join(_YEARLY)} FROM charac"""))
def label_assembly(lab: Lab) -> DataFrame:
    return _characterised(lab).select(
        "person_id", "year", "archetype", "gmm_4_cluster", "gmm_7_cluster", "cohort",
        "prior_year_max_cci", *_YEARLY,
    )


@query("cohort_stack", compose("charac", """
SELECT cohort, count(*) AS n, count(DISTINCT person_id) AS persons, CAST(sum(total_data_points) AS BIGINT) AS points
FROM charac GROUP BY 1"""))
def cohort_stack(lab: Lab) -> DataFrame:
    full = _stored(lab, "person_id", "cohort", "gmm_7_cluster", "total_data_points")
    first = full.filter("cohort = 'cohort_1'")
    second = full.filter("cohort = 'cohort_2a'").drop("gmm_7_cluster")
    return cohorts.stack_cohorts(first, second).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("persons"),
        F.sum("total_data_points").alias("points"),
    )


_UNIQUE = {f"unique_{d}_count": f"{d}_unique_ct" for d in ("condition", "drug", "procedure")}
_STATS = {**_UNIQUE, **{c: c for c in ("total_unique_concepts", "total_data_points", "total_nomatch_concepts")}}


@query("concept_stats", compose("charac", "SELECT gmm_4_named, " + ", ".join(
    f"round(avg({c}), 6) AS mean_{name}" for name, c in _STATS.items()) + " FROM charac GROUP BY 1"))
def concept_stats(lab: Lab) -> DataFrame:
    named = _characterised(lab).withColumnsRenamed({c: name for name, c in _UNIQUE.items()})
    return cohorts.concept_stats(named, "gmm_4_named", list(_STATS))


@query("metric_by_cluster", compose("metric", "SELECT \"Metric\", " + ", ".join(
    f"round(avg(value) FILTER (WHERE archetype = '{a}'), 1) AS \"{a}\"" for a in ARCHETYPES)
    + " FROM metric GROUP BY 1"))
def metric_by_cluster(lab: Lab) -> DataFrame:
    return cohorts.mean_table(_characterised(lab), "archetype", DENSITY_METRICS, ARCHETYPES)


@query("metric_by_cluster_p")
def metric_by_cluster_p(lab: Lab) -> DataFrame:
    rows = _stored(lab, "gmm_4_named", "prior_year_max_cci", *[c for _, c in DENSITY_METRICS])
    return cohorts.transposed_means(rows, "gmm_4_named", DENSITY_METRICS, GMM4_ORDER)


@query("anova_f", compose("metric", """
, g AS (SELECT "Metric", gmm_4_named, count(*) AS n, avg(value) AS m, sum(power(value, 2)) AS q FROM metric GROUP BY 1, 2),
o AS (SELECT "Metric", avg(value) AS gm FROM metric GROUP BY 1),
w AS (SELECT m."Metric", sum(power(value - g.m, 2)) AS ssw FROM metric m JOIN g ON m."Metric" = g."Metric" AND m.gmm_4_named = g.gmm_4_named GROUP BY 1)
SELECT g."Metric", round((sum(n * power(m - gm, 2)) / (count(*) - 1)) / (max(ssw) / (sum(n) - count(*))), 6) AS f,
       CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2
FROM g JOIN o ON g."Metric" = o."Metric" JOIN w ON g."Metric" = w."Metric" GROUP BY 1"""))
def anova_f(lab: Lab) -> DataFrame:
    return cohorts.anova(_characterised(lab), "gmm_4_named", DENSITY_METRICS)


def _rss_sql(centre: str) -> str:
    keys = f"PARTITION BY \"Metric\"{', gmm_4_named' if centre == 'within' else ''}"
    return f"""(SELECT "Metric", sum(y * y) - (power(sum(x * y), 2) * sum(m * m) - 2 * sum(x * y) * sum(m * y) * sum(x * m)
          + power(sum(m * y), 2) * sum(x * x)) / (sum(x * x) * sum(m * m) - power(sum(x * m), 2)) AS rss
   FROM (SELECT "Metric", value - avg(value) OVER w AS y, x - avg(x) OVER w AS x, m - avg(m) OVER w AS m FROM z
         WINDOW w AS ({keys})) AS c GROUP BY 1)"""


@query("partial_f", compose("metric", f"""
, z AS (SELECT "Metric", gmm_4_named, value, CAST(coalesce(prior_year_max_cci, 0) AS DOUBLE) AS x,
          CASE WHEN prior_year_max_cci IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM metric),
k AS (SELECT "Metric", count(DISTINCT gmm_4_named) AS k, count(*) AS n FROM z GROUP BY 1)
SELECT k."Metric", round(((r.rss - f.rss) / (k - 1)) / (f.rss / (n - k - 2)), 6) AS f,
       CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k - 2 AS DOUBLE) AS df2
FROM k JOIN {_rss_sql('within')} AS f ON k."Metric" = f."Metric"
JOIN {_rss_sql('total')} AS r ON k."Metric" = r."Metric" """))
def partial_f(lab: Lab) -> DataFrame:
    return cohorts.cluster_effect(_characterised(lab), "gmm_4_named", DENSITY_METRICS)


@query("cohort_partial_f")
def cohort_partial_f(lab: Lab) -> DataFrame:
    return cohorts.with_f_p(
        cohorts.cohort_effect(
            _characterised(lab), "cohort", DENSITY_METRICS, adjust_for_days_observed=True,
            adjust_for_year=True, y_transform="log1p",
        )
    )


@query("welch_t", compose("metric", """
, s AS (SELECT "Metric", cohort, count(*) AS n, avg(value) AS m, var_samp(value) / count(*) AS e FROM metric GROUP BY 1, 2)
SELECT a."Metric", round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b,
       round((a.m - b.m) / sqrt(a.e + b.e), 6) AS t,
       round(power(a.e + b.e, 2) / (a.e * a.e / (a.n - 1) + b.e * b.e / (b.n - 1)), 6) AS dof
FROM s a JOIN s b ON a."Metric" = b."Metric" AND a.cohort = 'cohort_1' AND b.cohort = 'cohort_2a'"""))
def welch_t(lab: Lab) -> DataFrame:
    return cohorts.welch(_characterised(lab), "cohort", DENSITY_METRICS)


@query("cohort_compare", compose("metric", """
, v AS (SELECT "Metric", archetype, cohort, value, ln(1 + value) AS y, CAST(prior_year_max_cci AS DOUBLE) AS x FROM metric),
s AS (SELECT "Metric", archetype, cohort, count(*) AS n, avg(value) AS mv, avg(y) AS m, var_samp(y) AS s2 FROM v GROUP BY 1, 2, 3),
l AS (SELECT "Metric", archetype, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM v WHERE x IS NOT NULL GROUP BY 1, 2),
e AS (SELECT v."Metric", v.archetype, v.cohort, y - l.a - l.b * x AS r FROM v
      JOIN l ON v."Metric" = l."Metric" AND v.archetype = l.archetype WHERE x IS NOT NULL),
r AS (SELECT "Metric", archetype, cohort, count(*) AS n, avg(r) AS m, sum(r * r) / (count(*) - 1) AS s2 FROM e GROUP BY 1, 2, 3)
SELECT a."Metric", a.archetype AS cluster_label, round(a.mv, 6) AS mean_cohort_1, round(b.mv, 6) AS mean_cohort_2a,
  round(b.mv - a.mv, 6) AS diff_mean, a.n AS n_cohort_1, b.n AS n_cohort_2a,
  round(CASE WHEN a.s2 > 0 AND b.s2 > 0 THEN (a.m - b.m) / sqrt(a.s2 / a.n + b.s2 / b.n) END, 6) AS t,
  round(CASE WHEN a.s2 > 0 AND b.s2 > 0 THEN power(a.s2 / a.n + b.s2 / b.n, 2)
        / (power(a.s2 / a.n, 2) / (a.n - 1) + power(b.s2 / b.n, 2) / (b.n - 1)) END, 6) AS dof,
  round(CASE WHEN c.s2 > 0 AND d.s2 > 0 THEN (c.m - d.m) / sqrt(c.s2 / c.n + d.s2 / d.n) END, 6) AS t_adjusted,
  round(CASE WHEN c.s2 > 0 AND d.s2 > 0 THEN power(c.s2 / c.n + d.s2 / d.n, 2)
        / (power(c.s2 / c.n, 2) / (c.n - 1) + power(d.s2 / d.n, 2) / (d.n - 1)) END, 6) AS dof_adjusted
FROM s a JOIN s b ON a."Metric" = b."Metric" AND a.archetype = b.archetype AND a.cohort = 'cohort_1' AND b.cohort = 'cohort_2a'
LEFT JOIN r c ON c."Metric" = a."Metric" AND c.archetype = a.archetype AND c.cohort = 'cohort_1'
LEFT JOIN r d ON d."Metric" = a."Metric" AND d.archetype = a.archetype AND d.cohort = 'cohort_2a'"""))
def cohort_compare(lab: Lab) -> DataFrame:
    return cohorts.within_cluster_comparison(
        _characterised(lab), "cohort", "archetype", DENSITY_METRICS, y_transform="log1p"
    )


@query("cohort_compare_p")
def cohort_compare_p(lab: Lab) -> DataFrame:
    return cohorts.comparison_p(
        cohorts.within_cluster_comparison(
            _characterised(lab), "cohort", "gmm_4_named", DENSITY_METRICS, y_transform="log1p"
        )
    )


@query("publication_matrix")
def publication_matrix(lab: Lab) -> DataFrame:
    long = cohorts.comparison_p(
        cohorts.within_cluster_comparison(
            _characterised(lab), "cohort", "gmm_4_named", DENSITY_METRICS, y_transform="log1p"
        )
    )
    return cohorts.publication_matrix(long, GMM4_ORDER, [m for m, _ in DENSITY_METRICS])


@query("cohort_sizes", compose("labelled", """
SELECT archetype AS cluster_label, count(*) FILTER (WHERE cohort = 'cohort_1') AS cohort_1,
       count(*) FILTER (WHERE cohort = 'cohort_2a') AS cohort_2a FROM labelled GROUP BY 1"""))
def cohort_sizes(lab: Lab) -> DataFrame:
    return cohorts.cohort_sizes(lab.labelled, "cohort", "archetype", ["cohort_1", "cohort_2a"], ARCHETYPES)
