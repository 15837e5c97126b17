"""Cluster description, separation and concordance queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import GMM4_LABELS, GMM7_LABELS, PROFILE_FEATURES
from ..functions.scalar import cluster_name
from ..functions.stability import settle
from ..operators import concordance, quality, rules, timelines
from .lab import COMPARED_COLUMNS, METHOD_COLUMNS, Lab
from .oracle import compose
from .registry import ORACLES, query

_CORE = ("visit_count", "inpatient_visit_count", "hospitalized_days")


def _profile_columns(features) -> str:
    return ", ".join(
        f"round(avg({f}), 6) AS {f}_mean, min({f}) AS {f}_min, max({f}) AS {f}_max" for f in features
    )


@query("cluster_profiles", compose("labelled", f"""
, k AS (SELECT gmm_4_cluster, archetype, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY gmm_4_cluster) AS pct
        FROM labelled GROUP BY 1, 2),
t AS (SELECT gmm_4_cluster, string_agg(archetype || ' ' || CAST(round(pct, 1) AS VARCHAR) || '%', '; '
             ORDER BY pct DESC, archetype) AS archetype_composition FROM k GROUP BY 1)
SELECT p.*, t.archetype_composition, 'gmm_4' AS method FROM (
SELECT gmm_4_cluster, count(*) AS n, {_profile_columns(PROFILE_FEATURES)},
  round(count(*) FILTER (WHERE max_cci = 0) * 100.0 / count(*), 6) AS "None",
  round(count(*) FILTER (WHERE max_cci BETWEEN 1 AND 2) * 100.0 / count(*), 6) AS "Low",
  round(count(*) FILTER (WHERE max_cci BETWEEN 3 AND 4) * 100.0 / count(*), 6) AS "Moderate",
  round(count(*) FILTER (WHERE max_cci > 4) * 100.0 / count(*), 6) AS "High"
FROM labelled GROUP BY 1) AS p JOIN t ON p.gmm_4_cluster = t.gmm_4_cluster"""))
def cluster_profiles(lab: Lab) -> DataFrame:
    return quality.profiles(lab.stored_labels, "gmm_4_cluster", "gmm_4", "archetype")


@query("profile_export", compose("labelled", """
SELECT gmm_4_cluster, CASE gmm_4_cluster WHEN 0 THEN 'Moderate Inpatient' WHEN 1 THEN 'Outpatient Irregular'
       WHEN 2 THEN 'Outpatient Regular' ELSE 'High Inpatient' END AS cluster_label,
       gmm_4_cluster = 2 AS is_reference, count(*) AS n, round(avg(max_cci), 6) AS max_cci_mean
FROM labelled GROUP BY 1"""))
def profile_export(lab: Lab) -> DataFrame:
    table = quality.profiles(lab.labelled, "gmm_4_cluster", "gmm_4")
    return table.select(
        "gmm_4_cluster", cluster_name("gmm_4_cluster", GMM4_LABELS).alias("cluster_label"),
        (F.col("gmm_4_cluster") == 2).alias("is_reference"), "n", "max_cci_mean",
    )


@query("cluster_stats_text", compose("labelled", """
SELECT archetype, count(*) AS n, """ + ", ".join(
    f"printf('%.2f (%.2f–%.2f)', avg({f}), quantile_cont({f}, 0.25), quantile_cont({f}, 0.75)) AS {f}"
    for f in _CORE) + " FROM labelled GROUP BY 1"))
def cluster_stats_text(lab: Lab) -> DataFrame:
    return quality.stats_text(lab.labelled, "archetype", _CORE)


@query("cluster_summary", compose("labelled", """
SELECT gmm_7_cluster, count(*) AS n, """ + ", ".join(
    f"round(avg({f}), 6) AS {f}_mean, round(quantile_cont({f}, 0.5), 6) AS {f}_median, "
    f"min({f}) || '–' || max({f}) AS {f}_range" for f in PROFILE_FEATURES) + " FROM labelled GROUP BY 1"))
def cluster_summary(lab: Lab) -> DataFrame:
    return quality.summary(lab.labelled, "gmm_7_cluster")


@query("cluster_counts", compose("labelled", """
SELECT gmm_4_cluster, count(*) AS person_years, count(DISTINCT person_id) AS unique_persons
FROM labelled GROUP BY 1"""))
def cluster_counts(lab: Lab) -> DataFrame:
    return rules.group_counts(lab.labelled, "gmm_4_cluster")


@query("cohens_d", compose("labelled", f"""
, u AS (UNPIVOT (SELECT gmm_4_cluster, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in PROFILE_FEATURES)} FROM labelled)
        ON {", ".join(PROFILE_FEATURES)} INTO NAME feature VALUE v),
c AS (SELECT gmm_4_cluster AS k, feature, count(*) AS n, avg(v) AS m, coalesce(var_samp(v), 0) AS s2 FROM u GROUP BY 1, 2),
r AS (SELECT c.k, c.feature, count(*) AS n, avg(v) AS m, coalesce(var_samp(v), 0) AS s2
      FROM (SELECT DISTINCT k, feature FROM c) AS c JOIN u ON u.feature = c.feature AND u.gmm_4_cluster <> c.k GROUP BY 1, 2),
g AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS s FROM u GROUP BY 1)
SELECT 'gmm_4' AS method, CAST(c.k AS VARCHAR) AS cluster, c.feature,
  round(abs(c.m - r.m) / sqrt(((c.n - 1) * c.s2 + (r.n - 1) * r.s2) / (c.n + r.n - 2)), 6) AS cohens_d,
  round(c.m, 6) AS cluster_mean, round(sqrt(c.s2), 6) AS cluster_std, round(g.m, 6) AS global_mean,
  round(g.s, 6) AS global_std,
  round(sqrt(((c.n - 1) * c.s2 + (r.n - 1) * r.s2) / (c.n + r.n - 2)), 6) AS pooled_std,
  round(r.m, 6) AS rest_mean, round(sqrt(r.s2), 6) AS rest_std
FROM c JOIN r ON c.k = r.k AND c.feature = r.feature JOIN g ON c.feature = g.feature"""))
def cohens_d(lab: Lab) -> DataFrame:
    return quality.importance(lab.labelled, "gmm_4_cluster", PROFILE_FEATURES, "gmm_4")


_CENTROID = """
, m AS (SELECT archetype AS k, avg(visit_count) AS c0, avg(inpatient_visit_count) AS c1,
               avg(hospitalized_days) AS c2 FROM labelled GROUP BY 1),
d AS (SELECT l.*, sqrt(power(visit_count - c0, 2) + power(inpatient_visit_count - c1, 2)
        + power(hospitalized_days - c2, 2)) AS dist FROM labelled l JOIN m ON l.archetype = m.k)"""


@query("medoids", compose("labelled", _CENTROID + """
SELECT 'rules' AS method, archetype AS cluster, person_id, CAST(year AS INTEGER) AS year,
       round(dist, 6) AS distance_to_centroid
FROM (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY round(dist, 9), person_id, year) AS r FROM d) AS x
WHERE r = 1"""))
def medoids(lab: Lab) -> DataFrame:
    return quality.medoids(lab.stored_labels, "archetype", _CORE, "rules")


@query("davies_bouldin", compose("labelled", _CENTROID + """
, s AS (SELECT m.*, a.spread FROM m JOIN (SELECT archetype AS k, avg(dist) AS spread FROM d GROUP BY 1) AS a ON m.k = a.k)
SELECT round(avg(w), 6) AS davies_bouldin_index, CAST(count(*) AS INTEGER) AS n_clusters FROM (
  SELECT a.k, max((a.spread + b.spread) / sqrt(power(a.c0 - b.c0, 2) + power(a.c1 - b.c1, 2) + power(a.c2 - b.c2, 2))) AS w
  FROM s a JOIN s b ON a.k <> b.k GROUP BY 1) AS r"""))
def davies_bouldin(lab: Lab) -> DataFrame:
    return quality.davies_bouldin(lab.stored_labels, "archetype", _CORE)


_SILHOUETTE = compose("labelled", """
, v AS (SELECT archetype AS k, visit_count AS x0, inpatient_visit_count AS x1, hospitalized_days AS x2, count(*) AS n
        FROM labelled GROUP BY 1, 2, 3, 4),
z AS (SELECT k, sum(n) AS size FROM v GROUP BY 1),
e AS (SELECT a.k, a.x0, a.x1, a.x2, a.n, b.k AS kb,
             sum(b.n * (power(a.x0 - b.x0, 2) + power(a.x1 - b.x1, 2) + power(a.x2 - b.x2, 2))) AS s
      FROM v a, v b GROUP BY 1, 2, 3, 4, 5, 6),
f AS (SELECT e.k, x0, x1, x2, n, max(CASE WHEN e.k = kb THEN s / (size - 1) END) AS own,
             min(CASE WHEN e.k <> kb THEN s / size END) AS other
      FROM e JOIN z ON e.kb = z.k GROUP BY 1, 2, 3, 4, 5)
SELECT k AS cluster, round(sum(n * (other - own) / greatest(own, other)) / sum(n), 6) AS silhouette_mean,
       CAST(sum(n) AS BIGINT) AS cluster_size FROM f GROUP BY 1""")


@query("silhouette_squared", _SILHOUETTE)
def silhouette_squared(lab: Lab) -> DataFrame:
    return quality.silhouette_squared(lab.stored_labels, "archetype", _CORE)


@query("medoid_timeline", compose("labelled daily visit", _CENTROID + """
, md AS (SELECT archetype, person_id, year FROM (SELECT *, row_number() OVER (PARTITION BY archetype
         ORDER BY round(dist, 9), person_id, year) AS r FROM d) AS x WHERE r = 1)
SELECT md.archetype AS cluster_label, y.person_id, y.date, y.visit_count,
       CAST(dayofyear(y.date) AS INTEGER) AS day_of_year, c.visit_concept_id,
       md.archetype || ' | ' || y.person_id AS y_label
FROM md JOIN daily y ON y.person_id = md.person_id AND year(y.date) = md.year
LEFT JOIN (SELECT person_id, visit_start_date AS date, min(visit_concept_id) AS visit_concept_id
           FROM visit GROUP BY 1, 2) AS c ON c.person_id = y.person_id AND c.date = y.date"""))
def medoid_timeline(lab: Lab) -> DataFrame:
    daily = lab.stored_daily  # read by the labels and by the timeline
    found = quality.medoids(lab.stored_labels, "archetype", _CORE, "rules").withColumns(
        {"cluster_id": F.col("cluster"), "cluster_label": F.col("cluster")}
    )
    return timelines.medoid_days(daily, lab.clinical.visits, found).select(
        "cluster_label", "person_id", "date", "visit_count", "day_of_year", "visit_concept_id", "y_label"
    )


@query("medoid_stays", compose("labelled visit", _CENTROID + """
, md AS (SELECT archetype, person_id, year FROM (SELECT *, row_number() OVER (PARTITION BY archetype
         ORDER BY round(dist, 9), person_id, year) AS r FROM d) AS x WHERE r = 1)
SELECT v.person_id, CAST(md.year AS INTEGER) AS year, md.archetype || ' | ' || v.person_id AS y_label,
       CAST(dayofyear(visit_start_date) AS INTEGER) AS start_doy,
       CAST(dayofyear(coalesce(visit_end_date, visit_start_date)) AS INTEGER) AS end_doy
FROM md JOIN visit v ON v.person_id = md.person_id AND year(v.visit_start_date) = md.year
WHERE visit_concept_id IN (9201, 262)"""))
def medoid_stays(lab: Lab) -> DataFrame:
    found = quality.medoids(lab.stored_labels, "archetype", _CORE, "rules").withColumn(
        "cluster_label", F.col("cluster")
    )
    return timelines.medoid_stays(lab.clinical.visits, found)


_MEDOID_COLUMNS = {"rules_vanilla": "archetype", "rules_adaptive": "archetype_adaptive", "gmm_4": "gmm_4_cluster", "gmm_7": "gmm_7_cluster"}
_CLUSTER_NAMES = {"gmm_4": GMM4_LABELS, "gmm_7": GMM7_LABELS}


def _all_medoids_sql() -> str:
    parts = []
    for method, k in _MEDOID_COLUMNS.items():
        names = _CLUSTER_NAMES.get(method)
        name = "CASE k " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in names.items()) + " END" if names else "k"
        parts.append(f"""
SELECT '{method}' AS method, CAST(k AS VARCHAR) AS cluster_id, person_id, CAST(year AS INTEGER) AS year, {name} AS cluster_label
FROM (SELECT m.k, person_id, year, row_number() OVER (PARTITION BY m.k ORDER BY round(sqrt(power(visit_count - c0, 2)
        + power(inpatient_visit_count - c1, 2) + power(hospitalized_days - c2, 2)), 9), person_id, year) AS r
      FROM relabelled l JOIN (SELECT {k} AS k, avg(visit_count) AS c0, avg(inpatient_visit_count) AS c1,
               avg(hospitalized_days) AS c2 FROM relabelled GROUP BY 1) AS m ON l.{k} = m.k) AS x WHERE r = 1""")
    return compose("relabelled", " UNION ALL ".join(parts))


@query("all_medoids", _all_medoids_sql())
def all_medoids(lab: Lab) -> DataFrame:
    frames = []
    for method, column in _MEDOID_COLUMNS.items():
        found = quality.medoids(lab.relabelled, column, _CORE, method)
        number = found.withColumn("_id", F.expr("try_cast(cluster AS int)"))
        name = cluster_name("_id", _CLUSTER_NAMES[method]) if method in _CLUSTER_NAMES else F.col("cluster")
        frames.append(
            number.select("method", F.col("cluster").alias("cluster_id"), "person_id", "year",
                          name.alias("cluster_label"))
        )
    return reduce(DataFrame.unionByName, frames)


# concordance ------------------------------------------------------------


def _cells(lab: Lab) -> DataFrame:
    return concordance.contingency(lab.keeping(COMPARED_COLUMNS).relabelled, METHOD_COLUMNS)


@query("composition", compose("labelled", """
SELECT gmm_4_cluster, archetype AS reference, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY gmm_4_cluster), 6) AS pct
FROM labelled GROUP BY 1, 2"""))
def composition(lab: Lab) -> DataFrame:
    return concordance.composition(lab.labelled, "gmm_4_cluster", "archetype")


@query("relabel", compose("relabel4 relabel7", """
SELECT 'gmm_4' AS method, gmm_4_cluster AS cluster, relabeled, dominant, round(purity, 6) AS purity FROM relabel4
UNION ALL SELECT 'gmm_7', gmm_7_cluster, relabeled, dominant, round(purity, 6) FROM relabel7"""))
def relabel(lab: Lab) -> DataFrame:
    frames = [
        names.select(F.lit(m).alias("method"), F.col(f"{m}_cluster").alias("cluster"), "relabeled", "dominant", "purity")
        for m, names in lab.relabels.items()
    ]
    return frames[0].unionByName(frames[1])


@query("relabel_applied", compose("relabelled", """
SELECT person_id, CAST(year AS INTEGER) AS year, gmm_4_relabeled,
       gmm_4_cluster || ': ' || gmm_4_relabeled AS gmm_4_label FROM relabelled"""))
def relabel_applied(lab: Lab) -> DataFrame:
    return lab.relabelled.select("person_id", "year", "gmm_4_relabeled", "gmm_4_label")


@query("flow_labels", compose("labelled", """
, f AS (SELECT gmm_4_cluster, archetype, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY archetype) AS flow
        FROM labelled GROUP BY 1, 2)
SELECT c.gmm_4_cluster, coalesce(x.flow_label, 'Mixed') AS flow_label
FROM (SELECT DISTINCT gmm_4_cluster FROM f) AS c LEFT JOIN (
  SELECT gmm_4_cluster, string_agg(printf('%.0f%% ', flow) || archetype, ' + ' ORDER BY flow DESC, archetype) AS flow_label
  FROM f WHERE flow >= 5 GROUP BY 1) AS x ON c.gmm_4_cluster = x.gmm_4_cluster"""))
def flow_labels(lab: Lab) -> DataFrame:
    return concordance.flow_labels(lab.stored_labels, "gmm_4_cluster", "archetype")


@query("split_table", compose("labelled", """
, s AS (SELECT gmm_4_cluster, gmm_7_cluster, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY gmm_4_cluster) AS pct
        FROM labelled GROUP BY 1, 2),
m AS (SELECT gmm_4_cluster, count(*) AS k, string_agg('GMM7-' || gmm_7_cluster || printf(' (%.0f%%)', pct), ', '
             ORDER BY pct DESC, gmm_7_cluster) AS t FROM s WHERE pct >= 15 GROUP BY 1)
SELECT c.gmm_4_cluster, CASE WHEN k > 1 THEN 'Splits' WHEN k = 1 THEN 'Maps to' ELSE 'Diffuse' END AS split_type,
       coalesce(t, 'Distributed') AS maps_to
FROM (SELECT DISTINCT gmm_4_cluster FROM s) AS c LEFT JOIN m ON c.gmm_4_cluster = m.gmm_4_cluster"""))
def split_table(lab: Lab) -> DataFrame:
    return concordance.split_table(lab.labelled, "gmm_4_cluster", "gmm_7_cluster")


@query("confusion", compose("cell", """
SELECT method1, method2, a, b, n, round(n * 100.0 / row_n, 6) AS row_pct FROM cell"""))
def confusion(lab: Lab) -> DataFrame:
    return concordance.confusion(_cells(lab))


@query("ari", compose("ari", """
SELECT method1, method2, n_rows, round(ari, 6) AS ari, round(agreement, 6) AS agreement FROM ari"""))
def ari(lab: Lab) -> DataFrame:
    return concordance.pair_scores(_cells(lab)).drop("kappa")


@query("kappa", compose("cell", """
, e AS (SELECT r.method1, r.method2, sum(r.row_n * 1.0 * c.col_n) AS chance
        FROM (SELECT DISTINCT method1, method2, a, row_n FROM cell) AS r
        JOIN (SELECT DISTINCT method1, method2, b, col_n FROM cell) AS c
          ON r.method1 = c.method1 AND r.method2 = c.method2 AND r.a = c.b GROUP BY 1, 2),
p AS (SELECT method1, method2, sum(n) AS t, coalesce(sum(n) FILTER (WHERE a = b), 0) * 1.0 / sum(n) AS po FROM cell GROUP BY 1, 2)
SELECT p.method1, p.method2, round((po - coalesce(chance, 0) / (t * t)) / (1 - coalesce(chance, 0) / (t * t)), 6) AS kappa
FROM p LEFT JOIN e ON p.method1 = e.method1 AND p.method2 = e.method2"""))
def kappa(lab: Lab) -> DataFrame:
    return concordance.pair_scores(_cells(lab)).select("method1", "method2", "kappa")


@query("ami", compose("cell", """
, i AS (SELECT method1, method2, sum(n * 1.0 / total * ln(total * 1.0 * n / (row_n * 1.0 * col_n))) AS mi FROM cell GROUP BY 1, 2),
ra AS (SELECT DISTINCT method1, method2, a, row_n AS x, total FROM cell),
cb AS (SELECT DISTINCT method1, method2, b, col_n AS y FROM cell),
ha AS (SELECT method1, method2, -sum(x * 1.0 / total * ln(x * 1.0 / total)) AS h FROM ra GROUP BY 1, 2),
hb AS (SELECT c.method1, c.method2, -sum(y * 1.0 / t.total * ln(y * 1.0 / t.total)) AS h FROM cb c
       JOIN (SELECT DISTINCT method1, method2, total FROM cell) AS t
         ON c.method1 = t.method1 AND c.method2 = t.method2 GROUP BY 1, 2),
q AS (SELECT ra.method1, ra.method2, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(total AS BIGINT) AS t
      FROM ra JOIN cb ON ra.method1 = cb.method1 AND ra.method2 = cb.method2),
k AS (SELECT *, UNNEST(generate_series(greatest(1, x + y - t), least(x, y))) AS k FROM q),
e AS (SELECT method1, method2, sum(k * 1.0 / t * ln(t * 1.0 * k / (x * 1.0 * y)) * exp(
        lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1)
        - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS emi FROM k GROUP BY 1, 2)
SELECT i.method1, i.method2, round(mi, 6) AS mi, round(emi, 6) AS emi,
       round((mi - emi) / ((ha.h + hb.h) / 2 - emi), 6) AS ami
FROM i JOIN ha ON i.method1 = ha.method1 AND i.method2 = ha.method2
JOIN hb ON i.method1 = hb.method1 AND i.method2 = hb.method2
JOIN e ON i.method1 = e.method1 AND i.method2 = e.method2"""))
def ami(lab: Lab) -> DataFrame:
    return concordance.adjusted_mutual_information(_cells(lab))


@query("concordance_matrix", compose("ari", """
SELECT method1, method2, round(ari, 6) AS ari, round(agreement, 6) AS agreement FROM ari
UNION ALL SELECT method2, method1, round(ari, 6), round(agreement, 6) FROM ari
UNION ALL SELECT m, m, 1.0, 1.0 FROM (VALUES ('rules_vanilla'), ('rules_adaptive'), ('gmm_4'), ('gmm_7')) AS v(m)"""))
def concordance_matrix(lab: Lab) -> DataFrame:
    return concordance.matrices(concordance.pair_scores(_cells(lab)), list(METHOD_COLUMNS))


def _exact(name: str) -> str:
    """The SQL of a query without the rounding of its last step, for differences."""
    return re.sub(r"round\((.*), 6\) AS (ari|ami)\b", r"\1 AS \2", ORACLES[name])


@query("consistency", f"""
SELECT method, round(ari_vanilla, 6) AS ari_vanilla, round(ari_adaptive, 6) AS ari_adaptive, round(ami_vanilla, 6) AS ami_vanilla,
       round(ami_adaptive, 6) AS ami_adaptive, round(ari_adaptive - ari_vanilla, 6) AS ari_delta, round(ami_adaptive - ami_vanilla, 6) AS ami_delta FROM (
SELECT a.method2 AS method, max(a.ari) FILTER (WHERE a.method1 = 'rules_vanilla') AS ari_vanilla,
  max(a.ari) FILTER (WHERE a.method1 = 'rules_adaptive') AS ari_adaptive,
  max(m.ami) FILTER (WHERE a.method1 = 'rules_vanilla') AS ami_vanilla,
  max(m.ami) FILTER (WHERE a.method1 = 'rules_adaptive') AS ami_adaptive
FROM ({_exact("ari")}) AS a JOIN ({_exact("ami")}) AS m ON a.method1 = m.method1 AND a.method2 = m.method2
WHERE a.method1 LIKE 'rules%' AND a.method2 LIKE 'gmm%' GROUP BY 1) AS c""")
def consistency(lab: Lab) -> DataFrame:
    cells = _cells(lab)
    return concordance.consistency(
        concordance.pair_scores(cells), concordance.adjusted_mutual_information(cells)
    )


_AGREE = ("((CASE WHEN archetype_adaptive = archetype THEN 1.0 ELSE 0.0 END) + (CASE WHEN gmm_4_relabeled = archetype THEN 1.0 ELSE 0.0 END)"
          " + (CASE WHEN gmm_7_relabeled = archetype THEN 1.0 ELSE 0.0 END)) / 3")


def _scorecard_sql() -> str:
    """Agreement with the rule runs is by raw clusters, as their names are not compared; a
    person-year's own agreement is the share of the other methods that name it as the rules do."""
    columns = _MEDOID_COLUMNS
    long = " UNION ALL ".join(
        f"SELECT '{m}' AS method, CAST({c} AS VARCHAR) AS k, archetype, {_AGREE} AS agree, visit_count AS x0, inpatient_visit_count AS x1, "
        f"hospitalized_days AS x2 FROM relabelled" for m, c in columns.items()
    )
    pairs = " UNION ALL ".join(
        f"SELECT '{m}' AS method, '{r}' AS ref, CAST({c} AS VARCHAR) AS a, CAST({columns[r]} AS VARCHAR) AS b FROM relabelled"
        for m, c in columns.items() for r in ("rules_vanilla", "rules_adaptive"))
    return compose("relabelled", f"""
, l AS ({long}),
c AS (SELECT method, k, archetype, count(*) AS n FROM l GROUP BY 1, 2, 3),
s AS (SELECT method, k, sum(n) AS n, max(n) * 100.0 / sum(n) AS purity FROM c GROUP BY 1, 2),
g AS (SELECT method, avg(agree) AS mean_agree, avg(CASE WHEN agree >= 0.75 THEN 100.0 ELSE 0.0 END) AS high FROM l GROUP BY 1),
pc AS (SELECT method, ref, a, b, count(*) AS n FROM ({pairs}) AS p GROUP BY 1, 2, 3, 4),
pr AS (SELECT method, ref, sum(n * (n - 1) / 2.0) AS x FROM (SELECT method, ref, a, sum(n) AS n FROM pc GROUP BY 1, 2, 3) AS q GROUP BY 1, 2),
pk AS (SELECT method, ref, sum(n * (n - 1) / 2.0) AS x FROM (SELECT method, ref, b, sum(n) AS n FROM pc GROUP BY 1, 2, 3) AS q GROUP BY 1, 2),
pa AS (SELECT pc.method, pc.ref, sum(n * (n - 1) / 2.0) AS both_n, sum(n) AS t, coalesce(sum(n) FILTER (WHERE a = b), 0) * 100.0 / sum(n) AS pct,
              max(pr.x) AS rx, max(pk.x) AS kx
       FROM pc JOIN pr ON pc.method = pr.method AND pc.ref = pr.ref JOIN pk ON pc.method = pk.method AND pc.ref = pk.ref GROUP BY 1, 2),
ps AS (SELECT method, ref, (both_n - rx * kx / (t * (t - 1) / 2.0)) / ((rx + kx) / 2.0 - rx * kx / (t * (t - 1) / 2.0)) AS ari, pct FROM pa),
w AS (SELECT method, max(ari) FILTER (WHERE ref = 'rules_vanilla') AS av, max(pct) FILTER (WHERE ref = 'rules_vanilla') AS pv,
             max(ari) FILTER (WHERE ref = 'rules_adaptive') AS aa, max(pct) FILTER (WHERE ref = 'rules_adaptive') AS pd FROM ps GROUP BY 1),
ce AS (SELECT method, k, avg(x0) AS c0, avg(x1) AS c1, avg(x2) AS c2 FROM l GROUP BY 1, 2),
sp AS (SELECT l.method, l.k, avg(sqrt(power(x0 - c0, 2) + power(x1 - c1, 2) + power(x2 - c2, 2))) AS spread, max(c0) AS c0, max(c1) AS c1, max(c2) AS c2
       FROM l JOIN ce ON l.method = ce.method AND l.k = ce.k GROUP BY 1, 2),
db AS (SELECT method, avg(worst) AS db FROM (
         SELECT a.method, a.k, max((a.spread + b.spread) / sqrt(power(a.c0 - b.c0, 2) + power(a.c1 - b.c1, 2) + power(a.c2 - b.c2, 2))) AS worst
         FROM sp a JOIN sp b ON a.method = b.method AND a.k <> b.k GROUP BY 1, 2) AS r GROUP BY 1)
SELECT s.method, CASE WHEN s.method LIKE 'rules%' THEN 'rules' ELSE 'gmm' END AS method_type,
  CAST(sum(n) AS BIGINT) AS person_years_inliers,
  round(sum(n) FILTER (WHERE k <> '-1') * 100.0 / sum(n), 6) AS pct_person_years_inliers,
  round(coalesce(sum(n) FILTER (WHERE k = '-1'), 0) * 100.0 / sum(n), 6) AS pct_person_years_outliers, count(*) AS n_clusters,
  round(quantile_cont(n, 0.5), 6) AS median_cluster_size, CAST(min(n) AS BIGINT) AS min_cluster_size,
  CAST(max(n) AS BIGINT) AS max_cluster_size, round(stddev_samp(n) / avg(n), 6) AS cv_cluster_size,
  round(avg(purity), 6) AS mean_cluster_purity_vs_rules, round(quantile_cont(purity, 0.5), 6) AS median_cluster_purity_vs_rules,
  count(*) FILTER (WHERE purity >= 70) AS n_pure_clusters_vs_rules,
  round(count(*) FILTER (WHERE purity >= 70) * 100.0 / count(*), 6) AS pct_pure_clusters_vs_rules,
  round(max(mean_agree), 6) AS mean_patient_agreement, round(max(high), 6) AS pct_patients_agreement_ge_0_75,
  round(max(av), 6) AS ari_vs_rules_vanilla, round(max(pv), 6) AS agree_vs_rules_vanilla_pct,
  round(max(aa), 6) AS ari_vs_rules_adaptive, round(max(pd), 6) AS agree_vs_rules_adaptive_pct, round(max(db), 6) AS davies_bouldin_index
FROM s JOIN g ON s.method = g.method JOIN w ON s.method = w.method JOIN db ON s.method = db.method GROUP BY 1""")


@query("scorecard", _scorecard_sql())
def scorecard(lab: Lab) -> DataFrame:
    """Each method against both rule runs, with the agreement of the methods on a person-year."""
    named = (METHOD_COLUMNS[m] for m in ("rules_adaptive", "gmm_4", "gmm_7"))
    same = sum((F.when(F.col(c) == F.col("archetype"), 1.0).otherwise(0.0) for c in named), F.lit(0.0))
    rows = settle(lab.relabelled.withColumn("agree", same / 3))
    index = [quality.davies_bouldin(rows, c, _CORE).select(F.lit(m).alias("method"), "davies_bouldin_index") for m, c in _MEDOID_COLUMNS.items()]
    return concordance.scorecard(rows, _MEDOID_COLUMNS, "rules_vanilla", ["rules_vanilla", "rules_adaptive"], reduce(DataFrame.unionByName, index), "agree")


def _run_sql() -> str:
    casts = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in PROFILE_FEATURES)
    runs = {"v": "archetype", "w": "archetype_adaptive"}
    parts = [f"""
o{r} AS (SELECT avg(CASE WHEN {c} <> prior THEN 100.0 ELSE 0.0 END) AS moved
  FROM (SELECT {c}, lag({c}) OVER (PARTITION BY person_id ORDER BY year) AS prior FROM relabelled) AS l WHERE prior IS NOT NULL),
u{r} AS (UNPIVOT (SELECT {c} AS k, {casts} FROM relabelled) ON {", ".join(PROFILE_FEATURES)} INTO NAME feature VALUE v),
c{r} AS (SELECT k, feature, count(*) AS n, avg(v) AS m, coalesce(var_samp(v), 0) AS s2 FROM u{r} GROUP BY 1, 2),
r{r} AS (SELECT c.k, c.feature, count(*) AS n, avg(v) AS m, coalesce(var_samp(v), 0) AS s2
  FROM c{r} c JOIN u{r} u ON u.feature = c.feature AND u.k <> c.k GROUP BY 1, 2),
d{r} AS (SELECT avg(d) AS d FROM (SELECT c.feature,
    avg(abs(c.m - r.m) / sqrt(((c.n - 1) * c.s2 + (r.n - 1) * r.s2) / (c.n + r.n - 2))) AS d
  FROM c{r} c JOIN r{r} r ON c.k = r.k AND c.feature = r.feature GROUP BY 1) AS f)""" for r, c in runs.items()]
    return compose("relabelled", "," + ",".join(parts) + """,
a AS (SELECT avg(CASE WHEN archetype = archetype_adaptive THEN 100.0 ELSE 0.0 END) AS same FROM relabelled)
SELECT 'Coverage (Agreement)' AS dimension, round(same, 6) AS vanilla, round(same, 6) AS adaptive, 'Tie' AS winner FROM a
UNION ALL SELECT 'Stability (Transition Rate, lower=better)', round(ov.moved, 6), round(ow.moved, 6),
  CASE WHEN ow.moved < ov.moved THEN 'Adaptive' ELSE 'Vanilla' END FROM ov, ow
UNION ALL SELECT 'Separation (Mean |Cohen d|, higher=better)', round(dv.d, 6), round(dw.d, 6),
  CASE WHEN dw.d > dv.d THEN 'Adaptive' ELSE 'Vanilla' END FROM dv, dw""")


@query("run_scorecard", _run_sql())
def run_scorecard(lab: Lab) -> DataFrame:
    """Fixed against tuned rules: agreement, transition rate, separation."""
    runs = {"vanilla": "archetype", "adaptive": "archetype_adaptive"}
    df = lab.relabelled
    same = F.avg((F.col("archetype") == F.col("archetype_adaptive")).cast("int")) * 100
    agreement = df.agg(same.alias("vanilla"), same.alias("adaptive"))

    def one_row(frames: dict[str, DataFrame], value: str) -> DataFrame:
        tagged = [f.select(F.lit(r).alias("run"), F.col(value).alias("v")) for r, f in frames.items()]
        both = tagged[0].unionByName(tagged[1])
        return both.agg(*[F.max(F.when(F.col("run") == r, F.col("v"))).alias(r) for r in frames])

    moves = {r: rules.transition_rate(rules.track(df, c)) for r, c in runs.items()}
    gaps = {
        r: quality.importance(df, c, PROFILE_FEATURES, r).groupBy("feature").agg(F.avg("cohens_d").alias("d")).agg(F.avg("d").alias("d"))
        for r, c in runs.items()
    }
    return concordance.run_comparison(agreement, one_row(moves, "pct_changed"), one_row(gaps, "d"))
