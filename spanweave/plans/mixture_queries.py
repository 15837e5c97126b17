"""Mixture preprocessing, training and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import GMM4_LABELS, GMM7_LABELS
from ..functions.local import small_table
from ..operators import mixture, sampling
from ..sources import sinks
from . import fixed_models
from .lab import Lab
from .oracle import compose
from .registry import query
from .rule_queries import SAMPLE_SQL

_COUNTS = ("visit_count", "inpatient_visit_count", "hospitalized_days")


def _winsor_sql() -> str:
    caps = ", ".join(f"quantile_cont({c}, 0.99) AS cap_{c}" for c in _COUNTS)
    rows = []
    for f in fixed_models.FEATURES:
        x = f"ln(1 + least(CAST({f} AS DOUBLE), cap_{f}))" if f in _COUNTS else f"CAST(coalesce({f}, 0) AS DOUBLE)"
        cap = f"max(cap_{f})" if f in _COUNTS else "CAST(NULL AS DOUBLE)"
        rows.append(
            f"SELECT '{f}' AS feature, round({cap}, 6) AS cap, round(avg({x}), 6) AS center, "
            f"round(stddev_pop({x}), 6) AS scale FROM s, c"
        )
    return SAMPLE_SQL + f", c AS (SELECT {caps} FROM s)\n" + "\nUNION ALL ".join(rows)


@query("winsor_scale", _winsor_sql())
def winsor_scale(lab: Lab) -> DataFrame:
    train = sampling.one_year_per_person(lab.stored_features)
    return mixture.preprocessing_table(lab.spark, mixture.fit_preprocessing(train))


def _posterior(k: int, alias: str) -> tuple[str, str]:
    """SQL of the confidence and the entropy of scores ``alias0`` ... in a row."""
    top = f"greatest({', '.join(f'{alias}{c}' for c in range(k))})"
    total = " + ".join(f"exp({alias}{c} - {top})" for c in range(k))
    q = [f"((exp({alias}{c} - {top}) / ({total})) + 1e-10) / (1 + {k}e-10)" for c in range(k)]
    entropy = " - ".join(["0.0"] + [f"({x}) * ln({x})" for x in q])
    return f"round(1 / ({total}), 6)", f"round({entropy}, 6)"


def _posterior_sql(k: int, alias: str, model: str) -> str:
    confidence, entropy = _posterior(k, alias)
    return compose("labelled", f"""
SELECT person_id, CAST(year AS INTEGER) AS year, {model}_cluster, {confidence} AS {model}_confidence,
       {entropy} AS {model}_entropy,
       lag({model}_cluster) OVER (PARTITION BY person_id ORDER BY year) AS prior_year_{model}_cluster
FROM labelled""")


def _scores(lab: Lab, model_id: str, model, labels) -> DataFrame:
    scored = mixture.predict(lab.features, model, model_id, labels)
    return mixture.with_prior_cluster(scored, model_id).select(
        "person_id", "year", f"{model_id}_cluster", f"{model_id}_confidence", f"{model_id}_entropy",
        f"prior_year_{model_id}_cluster",
    )


@query("gmm_score_fixed", _posterior_sql(4, "f", "gmm_4"))
def gmm_score_fixed(lab: Lab) -> DataFrame:
    return _scores(lab, "gmm_4", fixed_models.model_4(), GMM4_LABELS)


@query("gmm7_score_fixed", _posterior_sql(7, "g", "gmm_7"))
def gmm7_score_fixed(lab: Lab) -> DataFrame:
    return _scores(lab, "gmm_7", fixed_models.model_7(), GMM7_LABELS)


@query("gmm_fit")
def gmm_fit(lab: Lab) -> DataFrame:
    """Train on one year per person, then profile the fitted clusters on all rows."""
    train = sampling.one_year_per_person(lab.stored_features)
    model = mixture.fit(train, k=4)
    scored = mixture.predict(lab.stored_features, model, "gmm_4", GMM4_LABELS)
    sizes = scored.groupBy("gmm_4_cluster", "gmm_4_cluster_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("visit_count").alias("visit_count_mean"),
        F.avg("inpatient_visit_count").alias("inpatient_visit_count_mean"),
        F.avg("gmm_4_confidence").alias("mean_confidence"),
    )
    return sizes.withColumns(
        {"mean_log_likelihood": F.lit(model.log_likelihood), "iterations": F.lit(model.iterations),
         "converged": F.lit(model.converged), "bic": F.lit(model.bic)}
    )


@query("gmm_model_table")
def gmm_model_table(lab: Lab) -> DataFrame:
    model = mixture.fit(sampling.one_year_per_person(lab.stored_features), k=4)
    return mixture.model_table(lab.spark, model, "gmm_4")


@query("cluster_label_export", compose("labelled", f"""
SELECT person_id, CAST(year AS INTEGER) AS year, 'gmm_4' AS model_id, gmm_4_cluster AS cluster,
       CASE gmm_4_cluster WHEN 0 THEN 'Moderate Inpatient' WHEN 1 THEN 'Outpatient Irregular'
            WHEN 2 THEN 'Outpatient Regular' ELSE 'High Inpatient' END AS cluster_label,
       {_posterior(4, "f")[0]} AS confidence, {_posterior(4, "f")[1]} AS entropy,
       0 AS is_outlier, 'run-1' AS run_timestamp FROM labelled
UNION ALL
SELECT person_id, CAST(year AS INTEGER), 'rules', NULL, archetype, NULL, NULL, 0, 'run-1' FROM labelled"""))
def cluster_label_export(lab: Lab) -> DataFrame:
    mixed = sinks.label_rows(
        lab.labelled, "gmm_4", "gmm_4_cluster", "run-1", "gmm_4_confidence", "gmm_4_entropy",
        label="gmm_4_cluster_label",
    )
    ruled = sinks.label_rows(lab.labelled, "rules", "archetype", "run-1")
    return mixed.unionByName(ruled)


def _checks_sql() -> str:
    values = [f"CAST({f} AS DOUBLE)" for f in fixed_models.FEATURES]
    zero = " AND ".join(f"coalesce({v}, 0) = 0" for v in values)
    broken = " + ".join(f"count(*) FILTER (WHERE isnan({v}) OR isinf({v}))" for v in values)
    constant = ", ".join(f"CASE WHEN coalesce(stddev_pop({v}), 0) < 1e-10 THEN '{f}' END" for f, v in zip(fixed_models.FEATURES, values))
    return f"""
SELECT count(*) AS n_samples, count(*) FILTER (WHERE {zero}) AS n_all_zero, CAST({broken} AS BIGINT) AS n_not_finite,
       array_to_string(list_filter([{constant}], lambda x: x IS NOT NULL), ',') AS constant_features FROM feature"""


@query("input_checks", compose("feature", _checks_sql()))
def input_checks(lab: Lab) -> DataFrame:
    found = mixture.validate_input(lab.features, fixed_models.FEATURES)
    names = ("n_samples", "n_all_zero", "n_not_finite")
    row = (*(int(found[n]) for n in names), ",".join(found["constant_features"]))
    return small_table(lab.spark, [row], ", ".join(f"{n} bigint" for n in names) + ", constant_features string")
