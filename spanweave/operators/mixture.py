"""Tied-covariance Gaussian mixture: preprocessing, distributed EM and scoring.

With one shared covariance every component score is linear in the features, so
posteriors are plain column expressions. Training compresses equal vectors to
weights and runs all restarts in each pass; a pass is one aggregate of a few
numbers per restart and the driver only handles K x features matrices.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import (
    COUNT_FEATURES,
    GMM4_ACUITY,
    GMM7_ACUITY,
    WINSOR_PERCENTILE,
    clustering_features,
)
from ..functions.local import small_table
from ..functions.scalar import cluster_name, finite_or_zero
from ..functions.stability import settle

REGULARIZATION = 1e-6


@dataclass(frozen=True)
class Preprocessing:
    """Winsor caps of the count features, then centre and scale of every feature."""

    features: tuple[str, ...]
    caps: Mapping[str, float]
    center: tuple[float, ...]
    scale: tuple[float, ...]


@dataclass(frozen=True)
class Mixture:
    prep: Preprocessing
    weights: np.ndarray
    means: np.ndarray
    covariance: np.ndarray
    log_likelihood: float = math.nan
    bic: float = math.nan
    iterations: int = 0
    converged: bool = True

    @property
    def k(self) -> int:
        return len(self.weights)

    def linear_scores(self) -> tuple[np.ndarray, np.ndarray]:
        """(slopes K x p, offsets K) of the component scores."""
        slopes = np.linalg.solve(self.covariance, self.means.T).T
        offsets = np.log(self.weights) - 0.5 * np.sum(slopes * self.means, axis=1)
        return slopes, offsets


def validate_input(df: DataFrame, features: Sequence[str], min_rows: int = 10) -> dict:
    """Columns present, enough rows, and which features are constant; one aggregate."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing required features: {missing}")
    cols = {f: F.col(f).cast("double") for f in features}
    zero = F.lit(True)
    for c in cols.values():
        zero = zero & (F.coalesce(c, F.lit(0.0)) == 0)
    bad = [F.count_if(F.isnan(c) | c.isin(float("inf"), float("-inf"))) for c in cols.values()]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(zero).alias("all_zero"),
        sum(bad[1:], bad[0]).alias("not_finite"),
        *[F.stddev_pop(c).alias(f"sd_{f}") for f, c in cols.items()],
    ).first()
    if row["n"] < min_rows:
        raise ValueError(f"insufficient samples: {row['n']} (minimum {min_rows})")
    return {
        "n_samples": row["n"],
        "n_all_zero": row["all_zero"],
        "n_not_finite": row["not_finite"],
        "constant_features": [f for f in features if (row[f"sd_{f}"] or 0.0) < 1e-10],
    }


def validate_result(labelled: DataFrame, cluster: str, expected: int | None = None,
                    min_size: int = 10, max_outlier_rate: float = 0.0) -> dict:
    """Sizes, expected count, outlier rate and id gaps of a clustering."""
    sizes = {
        r[cluster]: r["n"]
        for r in labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    total = sum(sizes.values())
    outliers = sizes.pop(-1, 0)
    rate = outliers / total if total else 0.0
    warnings = [f"cluster {c} has only {n} rows" for c, n in sorted(sizes.items()) if n < min_size]
    if expected is not None and len(sizes) != expected:
        warnings.append(f"found {len(sizes)} clusters, expected {expected}")
    gaps = sorted(set(range(min(sizes), max(sizes) + 1)) - set(sizes)) if sizes else []
    if gaps:
        warnings.append(f"missing cluster labels {gaps}")
    if not sizes:
        raise ValueError("no clusters found")
    if rate > max_outlier_rate:
        raise ValueError(f"outlier rate {rate:.1%} exceeds {max_outlier_rate:.1%}")
    return {"n_samples": total, "cluster_sizes": sizes, "outlier_rate": rate, "warnings": warnings}


def _capped(name: str, caps: Mapping[str, float]) -> str:
    """SQL text: missing or not finite to 0, then cap and log1p for count features."""
    x = f"CAST({name} AS DOUBLE)"
    x = f"CASE WHEN {x} IS NULL OR abs({x}) = double('inf') OR isnan({x}) THEN 0D ELSE {x} END"
    return f"ln(1D + least({x}, {float(caps[name])!r}D))" if name in caps else x


def fit_preprocessing(train: DataFrame, features: Sequence[str] | None = None,
                      percentile: float = WINSOR_PERCENTILE) -> Preprocessing:
    """Caps from exact percentiles of the counts, then mean and population SD."""
    features = tuple(features or clustering_features("BOTH"))
    counts = [f for f in features if f in COUNT_FEATURES]
    cap_row = train.agg(
        *[F.percentile(finite_or_zero(F.col(f).cast("double")), percentile).alias(f) for f in counts]
    ).first()
    caps = {f: float(cap_row[f]) for f in counts}
    row = train.agg(
        *[F.expr(f"avg({_capped(f, caps)}) AS m{i}") for i, f in enumerate(features)],
        *[F.expr(f"stddev_pop({_capped(f, caps)}) AS s{i}") for i, f in enumerate(features)],
    ).first()
    center = tuple(float(row[f"m{i}"]) for i in range(len(features)))
    scale = tuple(float(row[f"s{i}"]) or 1.0 for i in range(len(features)))
    return Preprocessing(features, caps, center, scale)


def scaled_columns(prep: Preprocessing) -> dict[str, str]:
    """SQL text of each preprocessed feature, keyed x0, x1, ..."""
    return {
        f"x{i}": f"({_capped(f, prep.caps)} - {prep.center[i]!r}D) / {prep.scale[i]!r}D"
        for i, f in enumerate(prep.features)
    }


def preprocessing_table(spark: SparkSession, prep: Preprocessing) -> DataFrame:
    rows = [(f, prep.caps.get(f), prep.center[i], prep.scale[i]) for i, f in enumerate(prep.features)]
    return small_table(spark, rows, "feature string, cap double, center double, scale double")


# training ---------------------------------------------------------------


def _moments(vectors: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    n = F.col("n")
    row = vectors.agg(
        F.sum("n").alias("n"),
        *[F.sum(n * F.col(f"x{i}")).alias(f"s{i}") for i in range(p)],
        *[F.sum(n * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs],
    ).first()
    second = np.empty((p, p))
    for i, j in pairs:
        second[i, j] = second[j, i] = row[f"q{i}_{j}"]
    return float(row["n"]), np.array([row[f"s{i}"] for i in range(p)]), second


def _starting_means(vectors: DataFrame, p: int, k: int, n_init: int, seed: int) -> np.ndarray:
    """Per restart, k hash-chosen vectors; one pass, independent of partitioning."""
    x = [F.col(f"x{i}") for i in range(p)]
    picks = [
        F.min_by(F.array(*x), F.xxhash64(*x, F.lit(seed), F.lit(slot))).alias(f"p{slot}")
        for slot in range(n_init * k)
    ]
    row = vectors.agg(*picks).first()
    return np.array(list(row), dtype=float).reshape(n_init, k, p)


def _expectation(vectors: DataFrame, models: dict[int, Mixture], p: int, k: int) -> dict:
    """Responsibility sums of every running restart in one aggregate."""
    structs = []
    for run, model in models.items():
        slopes, offsets = model.linear_scores()
        parts = [f"'run', {run}"]
        for c in range(k):
            parts.append(f"'b{c}', {float(offsets[c])!r}D")
            parts += [f"'w{c}_{i}', {float(slopes[c, i])!r}D" for i in range(p)]
        structs.append(f"named_struct({', '.join(parts)})")
    fanned = vectors.selectExpr(
        *[f"x{i}" for i in range(p)], "n", f"inline(array({', '.join(structs)}))"
    )
    xs = [f"x{i}" for i in range(p)]
    scored = fanned.selectExpr(
        "run", "n", *xs,
        *[f"b{c} + " + " + ".join(f"w{c}_{i} * x{i}" for i in range(p)) + f" AS s{c}" for c in range(k)],
    )
    scored = scored.selectExpr("*", f"greatest({', '.join(f's{c}' for c in range(k))}) AS top")
    scored = scored.selectExpr("run", "n", *xs, "top", *[f"exp(s{c} - top) AS e{c}" for c in range(k)])
    scored = scored.selectExpr("*", " + ".join(f"e{c}" for c in range(k)) + " AS tot")
    scored = scored.selectExpr(
        "run", *xs, "n * (top + ln(tot)) AS ll", *[f"n * e{c} / tot AS r{c}" for c in range(k)]
    )
    sums = [F.sum("ll").alias("ll"), *[F.sum(f"r{c}").alias(f"r{c}") for c in range(k)]]
    sums += [
        F.sum(F.col(f"r{c}") * F.col(f"x{i}")).alias(f"m{c}_{i}") for c in range(k) for i in range(p)
    ]
    return {r["run"]: r for r in scored.groupBy("run").agg(*sums).collect()}


def fit(train: DataFrame, k: int = 4, prep: Preprocessing | None = None, n_init: int = 10,
        max_iter: int = 200, tol: float = 1e-3, seed: int = 42) -> Mixture:
    """Best of ``n_init`` EM runs by mean log-likelihood, with canonical component ids."""
    prep = prep or fit_preprocessing(train)
    p = len(prep.features)
    columns = scaled_columns(prep)
    vectors = settle(
        train.selectExpr(*[f"{c} AS {n}" for n, c in columns.items()])
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    total, first, second = _moments(vectors, p)
    ridge = np.eye(p) * REGULARIZATION
    mean = first / total
    spread = second / total - np.outer(mean, mean) + ridge
    starts = _starting_means(vectors, p, k, n_init, seed)
    running = {
        i: Mixture(prep, np.full(k, 1.0 / k), starts[i], spread, converged=False) for i in range(n_init)
    }
    done: dict[int, Mixture] = {}
    for step in range(1, max_iter + 1):
        sums = _expectation(vectors, running, p, k)
        for run, model in list(running.items()):
            row = sums[run]
            precision = np.linalg.inv(model.covariance)
            log_det = np.linalg.slogdet(model.covariance)[1]
            quadratic = float(np.sum(precision * second))
            likelihood = row["ll"] - 0.5 * quadratic - 0.5 * total * (p * math.log(2 * math.pi) + log_det)
            mean_ll = likelihood / total
            size = np.array([row[f"r{c}"] for c in range(k)]) + 10 * np.finfo(float).eps
            means = np.array([[row[f"m{c}_{i}"] for i in range(p)] for c in range(k)]) / size[:, None]
            shared = (second - (means.T * size) @ means) / total + ridge
            settled = abs(mean_ll - model.log_likelihood) < tol
            updated = Mixture(prep, size / size.sum(), means, shared, mean_ll, math.nan, step, settled)
            running[run] = updated
            if settled or step == max_iter:
                done[run] = running.pop(run)
        if not running:
            break
    best = max(done.values(), key=lambda m: m.log_likelihood)
    free = k * p + p * (p + 1) / 2 + k - 1
    bic = -2 * best.log_likelihood * total + free * math.log(total)
    return canonical(replace(best, bic=bic))


def canonical(model: Mixture) -> Mixture:
    """Number components by acuity (inpatient, then visit level), so labels are stable."""
    names = list(model.prep.features)
    ip, vc = names.index("inpatient_visit_count"), names.index("visit_count")
    order = sorted(range(model.k), key=lambda c: (model.means[c, ip], model.means[c, vc]))
    ids = {4: GMM4_ACUITY, 7: GMM7_ACUITY}.get(model.k, tuple(range(model.k)))
    place = np.empty(model.k, dtype=int)
    for rank, component in enumerate(order):
        place[ids[rank]] = component
    return replace(model, weights=model.weights[place], means=model.means[place])


# scoring ----------------------------------------------------------------


def predict(df: DataFrame, model: Mixture, model_id: str, labels: Mapping[int, str] | None = None) -> DataFrame:
    """Add cluster, confidence, entropy and name columns of one model."""
    slopes, offsets = model.linear_scores()
    ks, p = range(model.k), len(model.prep.features)
    out = df.selectExpr("*", *[f"{c} AS _{n}" for n, c in scaled_columns(model.prep).items()])
    linear = [
        f"{float(offsets[c])!r}D + " + " + ".join(f"{float(slopes[c, i])!r}D * _x{i}" for i in range(p))
        for c in ks
    ]
    out = out.selectExpr("*", *[f"{text} AS _s{c}" for c, text in enumerate(linear)])
    out = out.selectExpr("*", f"greatest({', '.join(f'_s{c}' for c in ks)}) AS _top")
    out = out.selectExpr("*", *[f"exp(_s{c} - _top) AS _e{c}" for c in ks])
    out = out.selectExpr("*", " + ".join(f"_e{c}" for c in ks) + " AS _total")
    smooth = 1 + model.k * 1e-10
    out = out.selectExpr("*", *[f"(_e{c} / _total + 1e-10D) / {smooth!r}D AS _p{c}" for c in ks])
    # ELSE keeps the id provably non-null, so null checks on it fold away
    best = " ".join(f"WHEN _s{c} = _top THEN {c}" for c in ks[:-1]) + f" ELSE {model.k - 1}"
    name = f"{model_id}_cluster"
    return out.selectExpr(
        *df.columns,
        f"CASE {best} END AS {name}",
        f"1 / _total AS {model_id}_confidence",
        "-(" + " + ".join(f"_p{c} * ln(_p{c})" for c in ks) + f") AS {model_id}_entropy",
    ).withColumn(f"{name}_label", cluster_name(name, labels or {}))


def with_prior_cluster(df: DataFrame, model_id: str) -> DataFrame:
    w = Window.partitionBy("person_id").orderBy("year")
    return df.withColumn(f"prior_year_{model_id}_cluster", F.lag(f"{model_id}_cluster").over(w))


# persistence ------------------------------------------------------------


_FIT = ("log_likelihood", "bic", "iterations", "converged")


def model_table(spark: SparkSession, model: Mixture, model_id: str) -> DataFrame:
    """All parameters as (model_id, kind, component, feature, other, value) rows."""
    names, rows = model.prep.features, []
    for i, f in enumerate(names):
        if f in model.prep.caps:
            rows.append((model_id, "cap", -1, f, "", float(model.prep.caps[f])))
        rows.append((model_id, "center", -1, f, "", model.prep.center[i]))
        rows.append((model_id, "scale", -1, f, "", model.prep.scale[i]))
        rows += [(model_id, "mean", c, f, "", float(model.means[c, i])) for c in range(model.k)]
        rows += [
            (model_id, "covariance", -1, f, g, float(model.covariance[i, j]))
            for j, g in enumerate(names)
        ]
    rows += [(model_id, "weight", c, "", "", float(model.weights[c])) for c in range(model.k)]
    rows += [(model_id, "feature_order", i, f, "", float(i)) for i, f in enumerate(names)]
    # how the fit went
    rows += [(model_id, "fit", -1, name, "", float(getattr(model, name))) for name in _FIT]
    return small_table(
        spark, rows,
        "model_id string, kind string, component int, feature string, other string, value double",
    )


def model_from_table(table: DataFrame, model_id: str) -> Mixture:
    rows = table.filter(F.col("model_id") == model_id).collect()
    if not rows:
        raise ValueError(f"no parameters stored for {model_id}")

    def of(kind: str) -> list:
        return [r for r in rows if r["kind"] == kind]

    names = [r["feature"] for r in sorted(of("feature_order"), key=lambda r: r["component"])]
    at = {f: i for i, f in enumerate(names)}
    k = len(of("weight"))
    weights, means = np.empty(k), np.empty((k, len(names)))
    covariance = np.empty((len(names), len(names)))
    for r in of("weight"):
        weights[r["component"]] = r["value"]
    for r in of("mean"):
        means[r["component"], at[r["feature"]]] = r["value"]
    for r in of("covariance"):
        covariance[at[r["feature"]], at[r["other"]]] = r["value"]
    by = {kind: {r["feature"]: r["value"] for r in of(kind)} for kind in ("cap", "center", "scale")}
    prep = Preprocessing(
        tuple(names), by["cap"],
        tuple(by["center"][f] for f in names), tuple(by["scale"][f] for f in names),
    )
    went = {r["feature"]: r["value"] for r in of("fit")}
    return Mixture(prep, weights, means, covariance, went.get("log_likelihood", math.nan), went.get("bic", math.nan),
                   int(went.get("iterations", 0)), bool(went.get("converged", True)))
