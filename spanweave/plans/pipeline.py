"""End-to-end runs: every stage is a table, kept while its inputs and parameters are the same.

``run`` builds a training cohort down to its statistics and exports, ``validate`` scores a
cohort with a stored model, ``compare`` holds two cohorts against each other.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import (
    ARCHETYPES,
    BREADTH_FEATURES,
    COUNT_FEATURES,
    DENSITY_METRICS,
    GMM4_LABELS,
    GMM4_LABELS_VALIDATION,
    GMM4_ORDER,
    GMM7_LABELS,
    PROFILE_FEATURES,
)
from ..operators import (
    cohorts,
    comorbidity,
    concordance,
    features,
    mixture,
    quality,
    residuals,
    rollup,
    rules,
    sampling,
    spine,
    tuning,
)
from ..sources import sinks
from ..sources.clinical import Clinical
from ..sources.manifest import Stages

#: Tables with a row per person or person-year; the others hold aggregates.
ROW_LEVEL = {"daily_core", "unified_daily", "unified_weekly", "unified_monthly", "unified_yearly", "archetype_features_yearly",
             "rules_yearly", "rules_adaptive_yearly", "gmm_4_yearly", "gmm_7_yearly", "gmm4_residuals_yearly",
             "residual_classification", "cluster_labels_yearly", "characterised", "cohort_characterised"}
_NAMES = {4: GMM4_LABELS, 7: GMM7_LABELS}
_BY_PERSON_YEAR = partial(sinks.overwrite_clustered, keys=("person_id", "year"))


def _by(column: str):
    return lambda df, table: sinks.overwrite(df, table, column)


def _timeline(stages: Stages, inputs: Clinical, variant: str, breadth: str, cci: str) -> DataFrame:
    """Daily table, period roll-ups (months merge into years) and person-year features."""
    events = stages.source("events", inputs.events)
    visits = stages.source("visits", inputs.visits)
    persons = stages.source("persons", inputs.person, inputs.concepts)
    days = spine.visit_days(inputs.visits)
    people = spine.demographics(inputs.person, inputs.concepts)

    def daily_rows() -> DataFrame:
        scores = comorbidity.visit_scores(inputs.events, inputs.visits, variant)
        return spine.daily(inputs.events, days, scores, lists=True).withColumn("year", F.year("date"))

    core = stages.stage("daily_core", daily_rows, {"variant": variant}, [events, visits], _by("year"))
    stages.stage("unified_daily", lambda: spine.unified_daily(core, people).withColumn("year", F.year("date")), {},
                 ["daily_core", persons], _by("year"))
    finer = {"weekly": ("week", "daily_core"), "monthly": ("month", "daily_core"), "yearly": ("year", "unified_monthly")}
    for name, (unit, source) in finer.items():

        def rolled(unit: str = unit, source: str = source) -> DataFrame:
            rows = stages.spark.table(f"{stages.db}.{source}")
            return rollup.finalize(rollup.rollup_period(rows, unit), people).withColumn("period_year", F.year("period_start_date"))

        stages.stage(f"unified_{name}", rolled, {"unit": unit}, [source, persons], _by("period_year"))

    def yearly() -> DataFrame:
        features.require_clean(core)
        return features.with_prior_year(features.person_year_features(core, days, inputs.events, breadth, cci))

    table = stages.stage("archetype_features_yearly", yearly, {"breadth": breadth, "cci": cci}, ["daily_core", events, visits], _by("year"))
    features.require_complete(table)
    if cci == "cumulative":
        features.require_monotone_cci(table)
    return table


def _rules(stages: Stages, table: DataFrame, run_timestamp: str) -> tuple[DataFrame, DataFrame]:
    """Rules at the fixed threshold, and at the tuned one with its log."""
    source = ["archetype_features_yearly"]
    fixed = stages.stage("rules_yearly", lambda: rules.vanilla(table), {}, source, _BY_PERSON_YEAR)

    def tune() -> DataFrame:
        penalty = tuning.choose_penalty(table)
        row = tuning.parameter_row(stages.spark, penalty, tuning.find_threshold(table, penalty["recommendation"]), run_timestamp)
        row.write.mode("append").format("parquet").saveAsTable(f"{stages.db}.rules_parameters_log")
        return row

    chosen = stages.stage("rules_parameters", tune, {}, source).first()
    tuned = stages.stage("rules_adaptive_yearly", lambda: rules.track(tuning.adaptive(table, chosen["penalty"], chosen["threshold"])), {},
                         [*source, "rules_parameters"], _BY_PERSON_YEAR)
    return fixed, tuned


def _mixture(stages: Stages, table: DataFrame, k: int) -> DataFrame:
    model_id = f"gmm_{k}"
    source = "archetype_features_yearly"

    def fit() -> DataFrame:
        mixture.validate_input(table, list(mixture.clustering_features("BOTH")))
        model = mixture.fit(sampling.one_year_per_person(table), k)
        if not model.converged:
            warnings.warn(f"{model_id} did not converge in {model.iterations} steps", stacklevel=2)
        return mixture.model_table(stages.spark, model, model_id)

    model = mixture.model_from_table(stages.stage(f"{model_id}_model", fit, {"k": k}, [source]), model_id)
    scored = stages.stage(
        f"{model_id}_yearly",
        lambda: mixture.with_prior_cluster(mixture.predict(sampling.with_training_flag(table), model, model_id, _NAMES.get(k, {})), model_id),
        {"labels": _NAMES.get(k, {})}, [source, f"{model_id}_model"], _BY_PERSON_YEAR)
    mixture.validate_result(scored, f"{model_id}_cluster", expected=k)
    return scored


def _analysis(stages: Stages, method: str, table: DataFrame, cluster: str, reads: Sequence[str]) -> None:
    """Profiles, medoids, separation and importance of one labelling, each a stage."""
    if all(c in table.columns for c in ("archetype", cluster)):
        parts = quality.analyse(table, cluster, method, COUNT_FEATURES, "archetype")
    else:
        parts = quality.analyse(table, cluster, method, COUNT_FEATURES)
    stages.stage(f"{method}_cluster_profiles", lambda: parts["profiles"], {"cluster": cluster}, reads)
    stages.stage(f"{method}_medoids", lambda: parts["medoids"], {"cluster": cluster}, reads)
    for name, key in (("cluster_separation_metrics", "separation"), ("feature_importance", "importance")):
        stages.part(name, "method", method, lambda key=key: parts[key], {"cluster": cluster}, reads)


def _comparison(stages: Stages, columns: dict[str, str], frames: dict[str, DataFrame]) -> None:
    """Agreement of all labellings, and the tuned rules against the fixed ones."""
    reads = [f"{m}_yearly" for m in frames]
    base = None
    for method, frame in frames.items():
        part = frame.select("person_id", "year", F.col(columns[method]).cast("string").alias(method))
        base = part if base is None else base.join(part, ["person_id", "year"])
    named = {m: m for m in frames}

    def cells() -> DataFrame:
        return concordance.contingency(base, named)

    stored = stages.stage("label_contingency", cells, {"columns": columns}, reads)
    of = ["label_contingency"]
    stages.stage("label_confusion", lambda: concordance.confusion(stored), {}, of)
    scores = stages.stage("label_agreement", lambda: concordance.pair_scores(stored), {}, of)
    information = stages.stage("label_information", lambda: concordance.adjusted_mutual_information(stored), {}, of)
    stages.stage("label_matrices", lambda: concordance.matrices(scores, list(frames)), {}, ["label_agreement"])
    stages.stage("label_consistency", lambda: concordance.consistency(scores, information, "rules", "rules_adaptive"), {},
                 ["label_agreement", "label_information"])
    stages.stage("rules_stability", lambda: rules.compare_stability(frames["rules"], frames["rules_adaptive"]), {}, ["rules_yearly", "rules_adaptive_yearly"])
    stages.stage("rules_run_scorecard", lambda: concordance.compare_runs(frames["rules"], frames["rules_adaptive"], PROFILE_FEATURES), {},
                 ["rules_yearly", "rules_adaptive_yearly"])

    def card() -> DataFrame:
        agree = sum(((F.col(m) == F.col("rules")).cast("double") for m in frames if m.startswith("rules")), F.lit(0.0))
        shared = base.withColumn("agree", agree / F.lit(float(sum(m.startswith("rules") for m in frames))))
        separation = stages.spark.table(f"{stages.db}.cluster_separation_metrics")
        return concordance.scorecard(shared, named, "rules", ["rules", "rules_adaptive"], separation, "agree")

    stages.stage("method_scorecard", card, {}, [*reads, *(f"cluster_separation_metrics/{m}" for m in frames)])


def _residuals(stages: Stages, scored: DataFrame, clusters: Sequence[int]) -> None:
    """Residuals within mixture clusters and every test on them, down to the summary."""
    group, names = "gmm_4_cluster", GMM4_LABELS
    outcomes = residuals.all_outcomes()

    def rows() -> DataFrame:
        return residuals.with_residuals(scored, group).select(
            "person_id", "year", group, F.col("gmm_4_cluster_label").alias("cluster_label"), "max_cci", *BREADTH_FEATURES, *outcomes)

    table = stages.stage("gmm4_residuals_yearly", rows, {}, ["gmm_4_yearly"], _BY_PERSON_YEAR)
    source = ["gmm4_residuals_yearly"]
    long = residuals.outcome_rows(table, group, outcomes)
    domains = residuals.domain_rows(table, group)
    named = list(GMM4_ORDER)
    stages.stage("residual_classification", lambda: residuals.classification(table, group, residuals.signed_outcomes()).select(
        "person_id", "year", group, "cluster_label", "is_reference_cluster", "max_cci", "avg_cross_domain_residual",
        "above_below_cluster_mean"), {}, source, _BY_PERSON_YEAR)
    stages.stage("residual_spread", lambda: residuals.residual_spread(table, group, outcomes), {}, source)
    pooled = stages.stage("residual_spearman", lambda: residuals.with_bonferroni(residuals.spearman_p(residuals.spearman(long, ["outcome"]))), {}, source)
    by_cluster = stages.stage("residual_spearman_by_cluster", lambda: residuals.with_bonferroni(
        residuals.spearman_p(residuals.spearman(long, ["outcome", group]))), {}, source)
    terms = stages.stage("residual_interactions", lambda: residuals.interaction_p(residuals.interaction_ols(long, group, clusters)), {}, source)
    odds = stages.stage("cluster_odds", lambda: residuals.multinomial_logit(residuals.last_year_counts(table, group), names), {}, source)
    stages.stage("domain_quartiles", lambda: residuals.domain_quartiles(domains, group, names), {}, source)
    stages.stage("domain_kruskal", lambda: residuals.kruskal_p(residuals.kruskal(domains, group)), {}, source)
    effects = stages.stage("domain_effects", lambda: residuals.rank_biserial(domains, group, names), {}, source)
    stages.stage("domain_effect_matrix", lambda: sinks.plain_names(residuals.effect_matrix(effects, named)), {}, ["domain_effects"])
    stages.stage("domain_effect_extremes", lambda: residuals.effect_extremes(effects), {}, ["domain_effects"])
    stages.stage("residual_summary", lambda: residuals.summary_table(pooled, by_cluster, terms, odds, group, names), {},
                 ["residual_spearman", "residual_spearman_by_cluster", "residual_interactions", "cluster_odds"])


def run(spark: SparkSession, inputs: Clinical, db: str, k: int | Sequence[int] = 4, run_timestamp: str = "",
        recompute: bool = False, export_to: str | None = None) -> list[str]:
    """Training cohort: timeline tables, fixed and tuned rules, mixtures of each size in ``k``,
    analyses, agreement, residual statistics, labels. ``export_to``: a folder for the
    tables as CSV, small cells suppressed. Returns the names of the tables."""
    stages = Stages(spark, db, recompute)
    table = _timeline(stages, inputs, "main", "total", "cumulative")
    fixed, tuned = _rules(stages, table, run_timestamp)
    archetype = fixed.select("person_id", "year", "archetype")
    frames, columns = {"rules": fixed, "rules_adaptive": tuned}, {"rules": "archetype", "rules_adaptive": "archetype"}
    _analysis(stages, "rules", fixed, "archetype", ["rules_yearly"])
    _analysis(stages, "rules_adaptive", tuned, "archetype", ["rules_adaptive_yearly"])
    for size in [k] if isinstance(k, int) else k:
        model_id, cluster = f"gmm_{size}", f"gmm_{size}_cluster"
        scored = _mixture(stages, table, size)
        joined = scored.join(archetype, ["person_id", "year"], "left")
        _analysis(stages, model_id, joined, cluster, [f"{model_id}_yearly", "rules_yearly"])
        comp = concordance.composition(joined, cluster, "archetype")
        stages.stage(f"{model_id}_relabel", lambda comp=comp, cluster=cluster: concordance.relabel(comp, cluster), {}, [f"{model_id}_yearly", "rules_yearly"])
        frames[model_id], columns[model_id] = scored, cluster
        if size == 4:
            _residuals(stages, scored, list(range(size)))
    _comparison(stages, columns, frames)
    for method, frame in frames.items():
        cluster = columns[method]
        confidence = None if method == "rules" else "archetype_confidence" if method == "rules_adaptive" else f"{method}_confidence"
        stages.part("cluster_labels_yearly", "model_id", method,
                    lambda m=method, f=frame, c=cluster, q=confidence: sinks.label_rows(f, m, c, run_timestamp, q, f"{m}_entropy", label=f"{c}_label"),
                    {}, [f"{method}_yearly"])
    names = [*dict.fromkeys(n.split("/")[0] for n in stages.names if not n.startswith("<")), "rules_parameters_log"]
    if export_to:
        export(spark, db, names, export_to)
    return names


def export(spark: SparkSession, db: str, names: Sequence[str], folder: str) -> list[str]:
    """Write result tables as CSV, counts of 1 to 9 suppressed. Row-level tables hold no
    counts over persons: of them the classification and the labels go out as they are,
    in several files; the others stay in the database."""
    written = []
    for name in names:
        table = spark.table(f"{db}.{name}")
        if name not in ROW_LEVEL:
            sinks.export_csv(sinks.suppress_small_cells(sinks.flat(table)), f"{folder}/{name}")
        elif name in ("residual_classification", "cluster_labels_yearly"):
            sinks.export_csv(sinks.flat(table), f"{folder}/{name}", one_file=False)
        else:
            continue
        written.append(name)
    return written


def validate(spark: SparkSession, inputs: Clinical, db: str, trained_db: str, k: int | Sequence[int] = 4,
             recompute: bool = False) -> list[str]:
    """Validation cohort: same timeline with its code table, rules, and stored-model scores."""
    stages = Stages(spark, db, recompute)
    table = _timeline(stages, inputs, "validation", "distinct", "within_year")
    stages.stage("rules_yearly", lambda: rules.vanilla(table), {}, ["archetype_features_yearly"], _BY_PERSON_YEAR)
    for size in [k] if isinstance(k, int) else k:
        model_id = f"gmm_{size}"
        stored = spark.table(f"{trained_db}.{model_id}_model")
        labels = GMM4_LABELS_VALIDATION if size == 4 else _NAMES.get(size, {})

        def scored(model_id: str = model_id, stored: DataFrame = stored, labels: dict = labels) -> DataFrame:
            found = mixture.predict(table, mixture.model_from_table(stored, model_id), model_id, labels)
            return mixture.with_prior_cluster(found.withColumn("training_data", F.lit(0)), model_id)

        stages.stage(f"{model_id}_yearly", scored, {"labels": labels}, ["archetype_features_yearly", stages.source(f"{model_id} model", stored)], _BY_PERSON_YEAR)
    return [n for n in stages.names if not n.startswith("<")]


# two cohorts --------------------------------------------------------------

_YEARLY = ["total_data_points", "total_unique_concepts", "total_nomatch_concepts",
           *(c for _, c in DENSITY_METRICS if not c.startswith("total_"))]
BUCKETS = 64


def characterise(stages: Stages, db: str, sizes: Sequence[int], buckets: int = BUCKETS) -> DataFrame:
    """A cohort's person-years with their labels and concept counts, from the tables of ``db``.

    Each of the joined tables is stored in buckets of (person_id, year), so that the join of
    all of them moves no rows.
    """
    spark = stages.spark
    bucketed = partial(sinks.overwrite_bucketed, keys=("person_id", "year"), buckets=buckets)

    def side(name: str, source: str, *columns) -> DataFrame:
        table = spark.table(f"{db}.{source}")
        return stages.stage(f"{db}_{name}", lambda: table.select("person_id", *columns), {"columns": [str(c) for c in columns], "buckets": buckets},
                            [stages.source(f"{db}.{source}", table)], bucketed)

    year = F.col("year").cast("int").alias("year")
    parts = [
        side("years", "archetype_features_yearly", year, "days_observed", "max_cci", "prior_year_max_cci"),
        side("counts", "unified_yearly", F.col("period").cast("int").alias("year"), *_YEARLY),
        side("rules", "rules_yearly", year, "archetype"),
        *[side(f"gmm_{k}", f"gmm_{k}_yearly", year, f"gmm_{k}_cluster", F.col(f"gmm_{k}_cluster_label").alias(f"gmm_{k}_named")) for k in sizes],
    ]
    first, *others = parts
    for other in others:
        first = first.join(other, ["person_id", "year"], "left")
    return first


def compare(spark: SparkSession, db_a: str, db_b: str, db: str, k: Sequence[int] = (4,), recompute: bool = False,
            buckets: int = BUCKETS, export_to: str | None = None) -> list[str]:
    """Two stored cohorts against each other: sizes, means by cluster, effects of cluster and
    cohort, differences within clusters, and their publication tables."""
    stages = Stages(spark, db, recompute)
    sides = [characterise(stages, name, k, buckets).withColumn("cohort", F.lit(name)) for name in (db_a, db_b)]
    reads = [n for n in stages.names if not n.startswith("<")]
    both = stages.stage("cohort_characterised", lambda: cohorts.stack_cohorts(*sides), {"cohorts": [db_a, db_b]}, reads)
    source = ["cohort_characterised"]
    metrics, labels = [m for m, _ in DENSITY_METRICS], [db_a, db_b]
    orders = {"archetype": ARCHETYPES, **{f"gmm_{n}_named": GMM4_ORDER if n == 4 else tuple(_NAMES[n].values()) for n in k}}
    for cluster, order in orders.items():
        def put(name: str, build, of: Sequence[str] = source) -> DataFrame:  # noqa: B023
            return stages.stage(f"{cluster}_{name}", build, {"cluster": cluster, "order": list(order)}, of)  # noqa: B023

        put("sizes", lambda: cohorts.cohort_sizes(both, "cohort", cluster, labels, order))
        put("concept_stats", lambda: cohorts.concept_stats(both, cluster, _YEARLY))
        put("means", lambda: sinks.plain_names(cohorts.transposed_means(both, cluster, DENSITY_METRICS, order)))
        put("effect", lambda: cohorts.with_f_p(cohorts.cluster_effect(both, cluster, DENSITY_METRICS)))
        long = put("differences", lambda: cohorts.comparison_p(cohorts.within_cluster_comparison(
            both, "cohort", cluster, DENSITY_METRICS, db_a, db_b, y_transform="log1p")))
        put("publication", lambda: sinks.plain_names(cohorts.publication_matrix(long, order, metrics)), [f"{cluster}_differences"])
    stages.stage("cohort_welch", lambda: cohorts.with_t_p(cohorts.welch(both, "cohort", DENSITY_METRICS, db_a, db_b)), {}, source)
    stages.stage("cohort_effect", lambda: cohorts.with_f_p(cohorts.cohort_effect(
        both, "cohort", DENSITY_METRICS, db_a, db_b, adjust_for_days_observed=True, adjust_for_year=True, y_transform="log1p")), {}, source)
    names = [n for n in stages.names if not n.startswith("<")]
    if export_to:
        export(spark, db, [n for n in names if n not in reads], export_to)
    return names
