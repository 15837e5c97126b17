"""Within-cluster residuals and their association with comorbidity.

Models are fitted from sufficient statistics: one aggregate per group, then
algebra on rows that number clusters x outcomes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, tails
from ..functions.constants import BASELINE_CLUSTER, BREADTH_FEATURES, BREADTH_LABELS
from ..functions.local import small_table
from ..functions.scalar import cluster_name
from . import ranks


def short_name(column: str) -> str:
    return column.removeprefix("total_").removesuffix("_count")


def signed_outcomes(columns: Sequence[str] = BREADTH_FEATURES, prefix: str = "domain_resid") -> list[str]:
    return [f"{prefix}_{short_name(c)}" for c in columns]


def all_outcomes(columns: Sequence[str] = BREADTH_FEATURES) -> list[str]:
    return signed_outcomes(columns) + signed_outcomes(columns, "domain_abs_resid")


def with_residuals(df: DataFrame, group: str, columns: Sequence[str] = BREADTH_FEATURES) -> DataFrame:
    """Add value minus group mean, and its absolute value; missing counts as 0."""
    filled = df.fillna(0, list(columns))
    means = filled.groupBy(group).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    joined = filled.join(F.broadcast(means), group)  # one row per cluster
    signed = {f"domain_resid_{short_name(c)}": F.col(c) - F.col(f"_mean_{c}") for c in columns}
    out = joined.withColumns(signed)
    out = out.withColumns({n.replace("resid", "abs_resid"): F.abs(F.col(n)) for n in signed})
    return out.drop(*[f"_mean_{c}" for c in columns])


def residual_spread(df: DataFrame, group: str, outcomes: Sequence[str]) -> DataFrame:
    """Mean and SD of each outcome per group, rounded to four places."""
    long = df.unpivot([group], list(outcomes), "outcome", "value")
    return long.groupBy(group, "outcome").agg(
        F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd")
    )


def classification(df: DataFrame, group: str, outcomes: Sequence[str]) -> DataFrame:
    """Mean residual over domains, and whether it lies above the cluster mean."""
    mean = F.expr("(" + " + ".join(outcomes) + f") / {len(outcomes)}")
    return df.withColumn("avg_cross_domain_residual", mean).withColumns(
        {
            "above_below_cluster_mean": F.when(
                F.col("avg_cross_domain_residual") >= 0, "above"
            ).otherwise("below"),
            "is_reference_cluster": F.col(group) == BASELINE_CLUSTER,
        }
    )


def outcome_rows(df: DataFrame, group: str, outcomes: Sequence[str]) -> DataFrame:
    """Long form: person_id, group, max_cci, outcome, value."""
    return df.select("person_id", group, "max_cci", *outcomes).unpivot(
        ["person_id", group, "max_cci"], list(outcomes), "outcome", "value"
    )


def spearman(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rank correlation of every outcome with comorbidity, with rows and persons."""
    keys = list(groups)
    rho = ranks.spearman(rows, keys, "value", "max_cci")
    persons = rows.groupBy(*keys).agg(F.countDistinct("person_id").alias("n_patients"))
    return rho.join(persons, keys)


def spearman_p(rho: DataFrame) -> DataFrame:
    p = tails.t_p_value(ranks.rho_statistic(), F.col("n") - 2)
    return rho.withColumn("p_value", p)


def with_bonferroni(df: DataFrame, m: int = 4, alpha: float = 0.05) -> DataFrame:
    return df.withColumn("significant_bonferroni", F.col("p_value") < alpha / m)


# interaction regression ---------------------------------------------------


def transformed_rows(rows: DataFrame, skew_limit: float = 1.0) -> DataFrame:
    """log1p outcomes that are never negative and strongly skewed."""
    shape = rows.groupBy("outcome").agg(
        F.skewness("value").alias("_skew"), F.min("value").alias("_low")
    )
    logged = (F.abs("_skew") > skew_limit) & (F.col("_low") >= 0)
    choice = shape.select("outcome", F.coalesce(logged, F.lit(False)).alias("logged"))
    y = F.when(F.col("logged"), F.log1p("value")).otherwise(F.col("value"))
    return rows.join(F.broadcast(choice), "outcome").withColumn("y", y)  # one row per outcome


def interaction_ols(rows: DataFrame, group: str, clusters: Sequence[int],
                    reference: int = BASELINE_CLUSTER) -> DataFrame:
    """y ~ max_cci * cluster with person-clustered standard errors.

    The full interaction equals one line per cluster, so slopes come from
    per-cluster moments and an interaction term is a slope difference. A row
    moves its cluster's slope by (x - mean_x) * residual / sxx; summing that
    per person and squaring slope differences gives the sandwich variance.
    """
    data = transformed_rows(rows)
    lines = data.groupBy("outcome", group).agg(
        F.count(F.lit(1)).alias("k_n"),
        F.expr("regr_slope(y, max_cci)").alias("slope"),
        F.expr("regr_intercept(y, max_cci)").alias("intercept"),
        F.expr("regr_sxx(y, max_cci)").alias("sxx"),
        F.expr("regr_syy(y, max_cci)").alias("syy"),
        F.avg("max_cci").alias("mean_x"),
        F.avg("y").alias("mean_y"),
    )
    influence = (
        (F.col("max_cci") - F.col("mean_x"))
        * (F.col("y") - F.col("intercept") - F.col("slope") * F.col("max_cci"))
        / F.col("sxx")
    )
    small = lines.select("outcome", group, "slope", "intercept", "sxx", "mean_x")
    moved = data.join(F.broadcast(small), ["outcome", group]).withColumn("_v", influence)
    persons = moved.groupBy("outcome", "person_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when(F.col(group) == k, F.col("_v")).otherwise(0.0)).alias(f"v{k}") for k in clusters],
    )
    others = [k for k in clusters if k != reference]
    gap = {k: F.col(f"v{k}") - F.col(f"v{reference}") for k in others}
    meat = persons.groupBy("outcome").agg(
        F.count(F.lit(1)).cast("double").alias("_persons"),
        F.sum("n").cast("double").alias("n_obs"),
        F.array(*[F.struct(F.lit(k).alias(group), F.sum(gap[k] * gap[k]).alias("meat")) for k in others]).alias("m"),
    )
    by_outcome = Window.partitionBy("outcome")
    ref_slope = F.max(F.when(F.col(group) == reference, F.col("slope"))).over(by_outcome)
    grand = F.sum(F.col("k_n") * F.col("mean_y")).over(by_outcome) / F.sum("k_n").over(by_outcome)
    lines = lines.withColumns({"_ref": ref_slope, "_grand": grand})
    within = F.sum(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")).over(by_outcome)
    total = F.sum(
        F.col("syy") + F.col("k_n") * (F.col("mean_y") - F.col("_grand")) * (F.col("mean_y") - F.col("_grand"))
    ).over(by_outcome)
    lines = lines.withColumn("r_squared", 1 - F.try_divide(within, total))
    terms = meat.select("outcome", "_persons", "n_obs", F.inline("m"))
    p = 2 * len(clusters)
    correction = F.col("_persons") / (F.col("_persons") - 1) * (F.col("n_obs") - 1) / (F.col("n_obs") - p)
    return terms.join(lines, ["outcome", group]).select(
        "outcome",
        group,
        (F.col("slope") - F.col("_ref")).alias("coef"),
        F.sqrt(F.col("meat") * correction).alias("se"),
        "r_squared",
        F.col("n_obs").cast("bigint").alias("n_obs"),
    )


def interaction_p(terms: DataFrame) -> DataFrame:
    return terms.withColumn("p_value", tails.normal_p_value(F.try_divide(F.col("coef"), F.col("se"))))


# multinomial logit --------------------------------------------------------


def last_year_counts(df: DataFrame, cluster: str) -> DataFrame:
    """(max_cci, cluster, n) over each person's last year; persons without either there are
    left out. Year, score and cluster are packed into one number, so the last year is a plain
    maximum; score and cluster must lie from -1 to 65,000."""
    def code(c: str) -> Column:
        return F.coalesce(F.col(c).cast("bigint") + 2, F.lit(0).cast("bigint"))

    packed = F.shiftleft(F.col("year").cast("bigint"), 32).bitwiseOR(F.shiftleft(code("max_cci"), 16)).bitwiseOR(code(cluster))
    last = df.groupBy("person_id").agg(F.max(packed).alias("last"))
    parts = last.select(F.shiftright("last", 16).bitwiseAND(F.lit(65535)).alias("score"), F.col("last").bitwiseAND(F.lit(65535)).alias("label"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return (parts.where("score > 0 AND label > 0").groupBy("score", "label").agg(F.count(F.lit(1)).alias("n"))
            .select((F.col("score") - 2).cast(kinds["max_cci"]).alias("max_cci"), (F.col("label") - 2).cast(kinds[cluster]).alias("cluster"), "n"))


def _log_likelihood(beta: np.ndarray, design: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    eta = np.column_stack([np.zeros(len(design)), design @ beta.T])
    top = eta.max(1, keepdims=True)
    total = np.log(np.exp(eta - top).sum(1, keepdims=True)) + top
    return float((n * (eta - total)).sum()), np.exp(eta - total)


def _newton(n: np.ndarray, xs: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """Slopes, their standard errors, whether the steps came to an end, and their number.
    ``n``: rows of the table by score and cluster, the reference first. A step that would
    lower the likelihood is halved until it does not."""
    scale = max(1.0, float(np.abs(xs).max()))
    design, size, k = np.column_stack([np.ones_like(xs), xs / scale]), n.sum(1), n.shape[1] - 1
    beta = np.zeros((k, 2))
    value, prob = _log_likelihood(beta, design, n)
    settled = False
    for turn in range(1, max_iter + 1):
        gradient = ((n[:, 1:] - size[:, None] * prob[:, 1:]).T @ design).ravel()
        hessian = np.zeros((2 * k, 2 * k))
        for a in range(k):
            for b in range(k):
                w = size * prob[:, a + 1] * ((a == b) - prob[:, b + 1])
                hessian[2 * a : 2 * a + 2, 2 * b : 2 * b + 2] = (design * w[:, None]).T @ design
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0].reshape(k, 2)
        share = 1.0
        for _ in range(40):
            new_value, new_prob = _log_likelihood(beta + share * step, design, n)
            if new_value >= value - 1e-12 * abs(value):
                break
            share /= 2
        beta, value, prob = beta + share * step, new_value, new_prob
        if np.abs(step).max() < tol:
            settled = True
            break
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hessian)), 0))[1::2]
    return beta[:, 1] / scale, se / scale, settled, turn


def _sides(n: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Numbers of groups of clusters that a score separates, in the order of their scores: all
    scores of one group are at most those of the next. No finite slope fits across a border."""
    low = np.array([xs[c > 0].min() for c in n.T])
    high = np.array([xs[c > 0].max() for c in n.T])
    order = np.lexsort((high, low))
    reach = np.maximum.accumulate(high[order])
    border = np.concatenate([[False], low[order][1:] >= reach[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(border)
    return out


def multinomial_logit(counts: DataFrame, labels: dict[int, str], reference: int = BASELINE_CLUSTER,
                      max_iter: int = 200, tol: float = 1e-10) -> DataFrame:
    """Odds ratios of max_cci for each cluster against the reference.

    The (score, cluster) counts are sufficient and small: the score has at most
    a few dozen values. Newton's method with halved steps runs on that table. ``converged`` says
    whether it came to an end. Where the score separates a cluster from the reference (or has one value only), its
    slope is not finite: ``separated`` is true, and coefficient, ratio, p-value and interval are null. Other
    clusters are fitted among those not separated from the reference. A table without rows of
    the reference gives no rows; one with the reference alone its row.
    """
    rows = counts.where("n > 0 AND max_cci IS NOT NULL AND cluster IS NOT NULL").collect()
    xs = np.array(sorted({float(r["max_cci"]) for r in rows}))
    found = {int(r["cluster"]) for r in rows}
    table: list[tuple] = []
    if reference in found:
        order = [reference] + sorted(found - {reference})
        n = np.zeros((len(xs), len(order)))
        for r in rows:
            n[np.searchsorted(xs, float(r["max_cci"])), order.index(int(r["cluster"]))] += r["n"]
        side = _sides(n, xs) if len(xs) > 1 else np.arange(len(order))
        fitted = [j for j in range(len(order)) if side[j] == side[0]]
        used = n[:, fitted].sum(1) > 0
        slope, se, settled, _ = _newton(n[used][:, fitted], xs[used], max_iter, tol) if len(fitted) > 1 else ([], [], True, 0)
        table.append((reference, labels.get(reference, str(reference)), 1.0, 0.0, None, None, None, True, settled, False))
        for j, cluster in enumerate(order[1:], start=1):
            name = labels.get(cluster, str(cluster))
            if j not in fitted:
                table.append((cluster, name, None, None, None, None, None, False, False, True))
                continue
            coef, error = float(slope[fitted.index(j) - 1]), float(se[fitted.index(j) - 1])
            rounded = round(coef, 4)
            p = tails.normal_tail(coef / error) if error > 0 else None
            low, high = (round(float(np.exp(rounded + z * error)), 4) for z in (-1.96, 1.96))
            table.append((cluster, name, round(float(np.exp(coef)), 4), rounded, p, low, high, False, settled, False))
    out = small_table(
        counts.sparkSession, table,
        "vs_cluster int, vs_label string, odds_ratio double, coef double, p_value double, "
        "ci_lo_95 double, ci_hi_95 double, is_reference boolean, converged boolean, separated boolean",
    )
    sig = F.when(F.col("is_reference"), "ref").when(F.col("p_value").isNull(), "n/a").otherwise(formats.significance(F.col("p_value")))
    return out.withColumn("sig", sig)


# domain characterisation --------------------------------------------------


def domain_rows(df: DataFrame, group: str, columns: Sequence[str] = BREADTH_FEATURES) -> DataFrame:
    """Long form of the raw domain counts with display names."""
    filled = df.fillna(0, list(columns)).select(
        group, *[F.col(c).cast("double").alias(BREADTH_LABELS.get(c, c)) for c in columns]
    )
    return filled.unpivot([group], [BREADTH_LABELS.get(c, c) for c in columns], "domain", "value")


def domain_quartiles(rows: DataFrame, group: str, labels: dict[int, str]) -> DataFrame:
    """Median and quartiles per domain and cluster, plus the full cohort."""
    named = rows.select(
        "domain",
        F.explode(F.array(cluster_name(group, labels), F.lit("Full Cohort"))).alias("cluster"),
        "value",
    )
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = named.groupBy("domain", "cluster").agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return stats.select(
        "domain", "cluster", "n",
        F.round(F.col("q")[1], 1).alias("median"),
        F.round(F.col("q")[0], 1).alias("q1"),
        F.round(F.col("q")[2], 1).alias("q3"),
        F.round(F.col("q")[2] - F.col("q")[0], 1).alias("iqr"),
    )


def kruskal(rows: DataFrame, group: str) -> DataFrame:
    return ranks.kruskal_wallis(ranks.group_rank_sums(rows, ["domain"], group, "value"), ["domain"])


def kruskal_p(stat: DataFrame) -> DataFrame:
    p = tails.chi2_p_value(F.col("kw_statistic"), F.col("n_groups") - 1)
    return stat.withColumn("p_value", p).withColumns(
        {
            "p_text": formats.p_text(F.col("p_value")),
            "sig": F.when(F.col("p_value").isNull(), "n/a").otherwise(formats.significance(F.col("p_value"))),
        }
    )


def rank_biserial(rows: DataFrame, group: str, labels: dict[int, str]) -> DataFrame:
    sums = ranks.rank_biserial(ranks.group_rank_sums(rows, ["domain"], group, "value"))
    rb = F.col("rank_biserial")
    direction = F.when(rb > 0.1, "higher than cohort").when(rb < -0.1, "lower than cohort")
    return sums.select(
        "domain",
        cluster_name(group, labels).alias("cluster"),
        "rank_biserial",
        "rank_biserial_ref",
        direction.otherwise("similar to cohort").alias("direction"),
    )


def effect_matrix(effects: DataFrame, order: Sequence[str]) -> DataFrame:
    """Domain x cluster table of effects."""
    return effects.groupBy("domain").pivot("cluster", list(order)).agg(F.first("rank_biserial"))


def effect_extremes(effects: DataFrame) -> DataFrame:
    """Most under- and over-represented domain per cluster."""
    key = F.struct(F.round("rank_biserial", 3), "domain")
    return effects.groupBy("cluster").agg(
        F.min_by("domain", key).alias("most_under"),
        F.min(F.round("rank_biserial", 3)).alias("under_effect"),
        F.max_by("domain", key).alias("most_over"),
        F.max(F.round("rank_biserial", 3)).alias("over_effect"),
    )


# consolidated summary -----------------------------------------------------


def summary_table(pooled: DataFrame, stratified: DataFrame, terms: DataFrame, odds: DataFrame,
                  group: str, labels: dict[int, str], reference: int = BASELINE_CLUSTER) -> DataFrame:
    """One text row per test over all questions."""
    p = F.col("p_value")

    def shape(df: DataFrame, outcome, question, test: str, n, statistic, wording) -> DataFrame:
        return df.select(
            outcome.alias("outcome"), question.alias("question"), F.lit(test).alias("test"),
            n.cast("bigint").alias("n"), statistic.alias("statistic"),
            formats.p_text(p).alias("p_text"),
            F.when(p.isNull(), "ns").otherwise(formats.significance(p)).alias("sig"),
            wording.alias("interpretation"),
        )

    rho, outcome = F.col("spearman_rho"), F.col("outcome")
    rho_text = F.format_string("rho = %.4f", rho)
    base = labels[reference]
    q1 = shape(pooled, outcome, F.concat(F.lit("Q1: Is higher CCI associated with "), outcome, F.lit("? (pooled)")),
               "Pooled Spearman's rho", F.col("n"), rho_text, formats.rho_wording(rho))
    name = cluster_name(group, labels)
    q1b = shape(stratified, outcome, F.concat(F.lit("Q1b: Within "), name, F.lit(" -- CCI vs "), outcome),
                "Stratified Spearman's rho", F.col("n"), rho_text, formats.rho_wording(rho))
    verdict = F.when(p < 0.05, "slope differs from baseline").otherwise("slope not significantly different")
    q2 = shape(terms, outcome, F.concat(F.lit("Q2: Does the CCI slope differ in "), name, F.lit(" for "), outcome, F.lit("?")),
               "OLS interaction (clustered SE)", F.col("n_obs"), F.format_string("coef = %.4f", F.col("coef")), verdict)
    target, ratio = F.col("vs_label"), F.col("odds_ratio")
    interval = F.coalesce(F.format_string(" [%.2f-%.2f]", F.col("ci_lo_95"), F.col("ci_hi_95")), F.lit(""))
    side = F.when(ratio > 1, "increases").otherwise("decreases")
    q3 = shape(odds, F.lit("cluster_assignment"),
               F.concat(F.lit("Q3: Does CCI predict "), target, F.lit(f" assignment? (vs {base})")),
               "Multinomial Logit (OR for max_cci)", F.lit(None),
               F.when(ratio.isNull(), "OR not finite").otherwise(
                   F.concat(F.format_string("OR = %.4f", ratio), F.when(F.col("ci_lo_95").isNotNull(), interval).otherwise(""))),
               F.when(ratio.isNull(), F.concat(F.lit("CCI separates "), target, F.lit(f" from {base}"))).otherwise(
                   F.concat(F.lit("Higher CCI "), side, F.lit(" odds of "), target, F.lit(f" vs {base}"))))
    return q1.unionByName(q1b).unionByName(q2).unionByName(q3)
