import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanweave.functions import formats, tails
from spanweave.operators import cohorts, concordance, mixture, quality, ranks, residuals, sampling, tuning
from spanweave.plans import fixed_models


def test_tail_probabilities_against_tables():
    assert tails.normal_tail(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.t_tail(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_tail(7.814727903, 3) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(0.584374374, 3) == pytest.approx(0.9, abs=1e-8)
    assert tails.f_tail(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.f_tail(1.0, 5, 5) == pytest.approx(0.5, abs=1e-12)


def test_large_degrees_of_freedom_reach_the_normal():
    assert tails.t_tail(2.0, 1e9) == pytest.approx(tails.normal_tail(2.0), rel=1e-6)
    for dof in (1e9, 1e10, 1e12):  # first-order correction to the normal tail
        limit = tails.normal_tail(2.0) + 10 / (2 * dof) * math.exp(-2.0) / math.sqrt(2 * math.pi)
        assert tails.t_tail(2.0, dof) == pytest.approx(limit, rel=1e-9)
        assert tails.f_tail(4.0, 1, dof) == pytest.approx(limit, rel=1e-9)
    assert tails.f_tail(4.0, 1, 1e9) == pytest.approx(tails.normal_tail(2.0), rel=1e-6)


def contingency(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return concordance.contingency(df, {"m1": "a", "m2": "b"})


def test_rand_index_of_equal_permuted_and_crossed_labels(spark):
    base = ["x"] * 6 + ["y"] * 8 + ["z"] * 4
    same = concordance.pair_scores(contingency(spark, list(zip(base, base)))).first()
    assert same["ari"] == 1 and same["kappa"] == 1 and same["agreement"] == 1
    swap = {"x": "y", "y": "z", "z": "x"}
    moved = concordance.pair_scores(contingency(spark, [(v, swap[v]) for v in base])).first()
    assert moved["ari"] == pytest.approx(1) and moved["agreement"] == 0
    crossed = concordance.pair_scores(contingency(spark, [(p, q) for p in "ab" for q in "cd"] * 25)).first()
    assert abs(crossed["ari"]) < 0.05
    few = concordance.pair_scores(contingency(spark, [("a", "b")] * 9)).first()
    assert few["ari"] is None


def test_adjusted_mutual_information(spark):
    base = ["x"] * 6 + ["y"] * 8 + ["z"] * 4
    same = concordance.adjusted_mutual_information(contingency(spark, list(zip(base, base)))).first()
    assert same["ami"] == pytest.approx(1)
    pairs = list(zip(base, base[3:] + base[:3]))
    whole = concordance.adjusted_mutual_information(contingency(spark, pairs)).first()
    chunked = concordance.adjusted_mutual_information(contingency(spark, pairs), chunk=2).first()
    assert whole["emi"] == pytest.approx(chunked["emi"], rel=1e-12)


def test_expected_information_against_all_cell_counts(spark):
    pairs = [("x", "p")] * 40 + [("x", "q")] * 7 + [("y", "p")] * 11 + [("z", "r")] * 25 + [("y", "r")] * 40
    got = concordance.adjusted_mutual_information(contingency(spark, pairs)).first()["emi"]
    n, expect = len(pairs), 0.0
    sizes = [list(pd.Series([p[i] for p in pairs]).value_counts()) for i in (0, 1)]
    for x in sizes[0]:
        for y in sizes[1]:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                chance = math.comb(y, k) * math.comb(n - y, x - k) / math.comb(n, x)
                expect += k / n * math.log(n * k / (x * y)) * chance
    assert got == pytest.approx(expect, rel=1e-11)


def test_cell_weights_sum_to_one_at_any_size(spark):
    margins = [(30, 20, 50), (7, 90, 100), (600, 400, 5000), (10**6, 3 * 10**6, 10**9), (4 * 10**6, 10**10, 10**12),
               (10**7, 5 * 10**11, 10**12), (6 * 10**11, 500_000, 10**12)]
    df = spark.createDataFrame(margins, "x bigint, y bigint, total bigint")
    weight = F.exp(concordance.log_cell_weight(F.col("k"), F.col("x"), F.col("y"), F.col("total")))
    # the count 0 is no term of the information, so its weight is added here
    zero = F.when(F.col("x") + F.col("y") <= F.col("total"),
                  F.exp(concordance.log_cell_weight(F.lit(0), F.col("x"), F.col("y"), F.col("total")))).otherwise(0.0)
    sums = concordance.cell_counts(df, "x", "y", "total", 65536).groupBy("x", "y", "total").agg(F.sum(weight).alias("w"))
    got = sums.withColumn("w", F.col("w") + zero).collect()
    assert len(got) == len(margins)
    for r in got:
        assert r["w"] == pytest.approx(1, abs=1e-9), r


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", "c"], 400), "x": rng.integers(0, 12, 400).astype(float),
        "y": np.round(rng.normal(size=400), 1), "person_id": rng.integers(0, 120, 400),
    })
    pdf["y"] += pdf["x"] * 0.2
    return pdf, spark.createDataFrame(pdf)


def test_spearman_with_ties_and_slices(scores):
    pdf, df = scores
    expect = pdf.groupby("g")[["x", "y"]].apply(lambda t: t["x"].rank().corr(t["y"].rank())).to_dict()
    for buckets in (None, 7):
        got = {r["g"]: r["spearman_rho"] for r in ranks.spearman(df, ["g"], "x", "y", buckets).collect()}
        assert got == pytest.approx(expect, rel=1e-10)


def test_kruskal_and_rank_biserial_against_brute_force(scores):
    pdf, df = scores
    sums = ranks.group_rank_sums(df.withColumn("s", F.lit(1)), ["s"], "g", "y")
    rank, n = pdf["y"].rank(), len(pdf)
    h = 12 / (n * (n + 1)) * sum(rank[pdf["g"] == g].sum() ** 2 / (pdf["g"] == g).sum() for g in "abc") - 3 * (n + 1)
    ties = pdf["y"].value_counts().to_numpy(dtype=float)
    h /= 1 - (ties**3 - ties).sum() / (n**3 - n)
    assert ranks.kruskal_wallis(sums, ["s"]).first()["kw_statistic"] == pytest.approx(h, rel=1e-10)
    for r in ranks.rank_biserial(sums).collect():
        mine = pdf.loc[pdf["g"] == r["g"], "y"].to_numpy()[:, None]
        u = (mine > pdf["y"].to_numpy()).sum() + 0.5 * (mine == pdf["y"].to_numpy()).sum()
        assert r["rank_biserial"] == pytest.approx(2 * u / (len(mine) * n) - 1, abs=1e-12)
        assert r["rank_biserial_ref"] == -r["rank_biserial"]


def test_group_above_cohort_has_positive_effect(spark):
    df = spark.createDataFrame([("hi", 10.0 + i) for i in range(5)] + [("lo", float(i)) for i in range(5)], "g string, v double")
    sums = ranks.group_rank_sums(df.withColumn("s", F.lit(1)), ["s"], "g", "v")
    got = {r["g"]: r for r in ranks.rank_biserial(sums).collect()}
    assert got["hi"]["rank_biserial"] > 0 > got["hi"]["rank_biserial_ref"]


def test_silhouettes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(90, 3)).astype(float)
    k = rng.choice(["a", "b", "c"], 90)
    df = spark.createDataFrame(pd.DataFrame({"k": k, "f0": x[:, 0], "f1": x[:, 1], "f2": x[:, 2]}))

    def expected(distance):
        s = np.zeros(len(x))
        for i in range(len(x)):
            means = {c: distance[i, k == c].sum() / ((k == c).sum() - (c == k[i])) for c in "abc"}
            own, other = means[k[i]], min(v for c, v in means.items() if c != k[i])
            s[i] = (other - own) / max(own, other)
        return {c: s[k == c].mean() for c in "abc"}

    square = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    cols = ["f0", "f1", "f2"]
    got = {r["cluster"]: r["silhouette_mean"] for r in quality.silhouette_squared(df, "k", cols).collect()}
    assert got == pytest.approx(expected(square), rel=1e-9)


def test_importance_keeps_unlabelled_rows_in_the_rest(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 7.0), (None, 100.0)], "k string, v double")
    got = {r["cluster"]: r for r in quality.importance(df, "k", ["v"], "m").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["rest_mean"] == pytest.approx((5 + 7 + 100) / 3)


def test_relabel_rules(spark):
    rows = [(0, "A")] * 6 + [(0, "B")] * 4 + [(1, "A")] * 3 + [(1, "B")] * 3 + [(1, "C")] * 2 + [(1, "D")] * 2
    rows += [(2, c) for c in "ABCDEF"] + [(-1, "A")]
    df = spark.createDataFrame(rows, "k int, r string")
    got = {r["k"]: r["relabeled"] for r in concordance.relabel(concordance.composition(df, "k", "r"), "k").collect()}
    assert got == {0: "A", 1: "A + B", 2: "Mixed"}


def test_posteriors_by_hand(spark):
    model = fixed_models.model_4()
    df = spark.createDataFrame([(1, 2000, 6, 1, 3, 1, 0.4, 0.5), (2, 2000, 1, 0, 0, 0, None, None)],
                               "person_id bigint, year int, visit_count int, inpatient_visit_count int, "
                               "hospitalized_days int, has_valid_regularity int, irregularity_l1 double, irregularity_l2 double")
    for row in mixture.predict(df, model, "m").collect():
        raw = [row[f] or 0.0 for f in fixed_models.FEATURES]
        z = [math.log1p(min(v, model.prep.caps[f])) if f in model.prep.caps else v for f, v in zip(fixed_models.FEATURES, raw)]
        z = (np.array(z) - model.prep.center) / model.prep.scale
        logp = np.log(model.weights) - 0.5 * (((z - model.means) ** 2) / np.diag(model.covariance)).sum(1)
        post = np.exp(logp - logp.max())
        post /= post.sum()
        q = (post + 1e-10) / (post + 1e-10).sum()
        assert row["m_cluster"] == int(post.argmax())
        assert row["m_confidence"] == pytest.approx(post.max())
        assert row["m_entropy"] == pytest.approx(-(q * np.log(q)).sum())


FEATURES = ("visit_count", "inpatient_visit_count", "hospitalized_days")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    centers = np.array([[1, 0, 0], [8, 0, 0], [6, 4, 6], [14, 9, 30]])
    x = np.concatenate([rng.poisson(c + 0.2, size=(250, 3)) for c in centers])
    pdf = pd.DataFrame(x, columns=list(FEATURES))
    pdf["person_id"], pdf["year"] = np.arange(len(pdf)), 2000
    return spark.createDataFrame(pdf)


def test_fit_recovers_groups_and_likelihood_does_not_fall(blobs):
    prep = mixture.fit_preprocessing(blobs, FEATURES)
    short = mixture.fit(blobs, 4, prep, n_init=3, max_iter=2)
    full = mixture.fit(blobs, 4, prep, n_init=3, max_iter=60)
    assert full.converged and full.log_likelihood >= short.log_likelihood
    assert full.weights.sum() == pytest.approx(1)
    scored = mixture.predict(blobs, full, "m")
    assert mixture.validate_result(scored, "m_cluster", expected=4)["warnings"] == []
    ip = {r["m_cluster"]: r["ip"] for r in scored.groupBy("m_cluster").agg(F.avg("inpatient_visit_count").alias("ip")).collect()}
    assert ip[3] > ip[0] > max(ip[1], ip[2])
    again = mixture.fit(blobs.repartition(5), 4, prep, n_init=3, max_iter=60)
    assert again.log_likelihood == pytest.approx(full.log_likelihood, abs=1e-6)


def test_model_survives_its_table(spark, blobs, tmp_path):
    model = mixture.fit(blobs, 4, mixture.fit_preprocessing(blobs, FEATURES), n_init=2, max_iter=5)
    mixture.model_table(spark, model, "gmm_4").write.parquet(str(tmp_path / "model"))
    back = mixture.model_from_table(spark.read.parquet(str(tmp_path / "model")), "gmm_4")
    assert (back.iterations, back.converged, back.bic) == (model.iterations, model.converged, pytest.approx(model.bic))
    a = mixture.predict(blobs, model, "m").groupBy("m_cluster").count()
    b = mixture.predict(blobs, back, "m").groupBy("m_cluster").count()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        mixture.model_from_table(spark.read.parquet(str(tmp_path / "model")), "gmm_7")


def test_input_checks(spark, blobs):
    with pytest.raises(ValueError, match="missing"):
        mixture.validate_input(blobs, ["nope"])
    with pytest.raises(ValueError, match="insufficient"):
        mixture.validate_input(blobs.limit(3), FEATURES)
    found = mixture.validate_input(blobs.withColumn("c", F.lit(1.0)), [*FEATURES, "c"])
    assert found["constant_features"] == ["c"] and found["n_samples"] == 1000


def test_sample_has_one_row_per_person(lab):
    s = sampling.one_year_per_person(lab.features)
    assert s.count() == s.select("person_id").distinct().count() == lab.features.select("person_id").distinct().count()
    flagged = sampling.with_training_flag(lab.features).filter("training_data = 1").select("person_id", "year")
    assert flagged.exceptAll(s.select("person_id", "year")).count() == 0


def test_plateau_rules():
    assert tuning.widest_plateau([False, True, True, False, True, True, True]) == (1, 3)
    assert tuning.widest_plateau([True, True, True]) == (0, 2)
    assert tuning.widest_plateau([False, False]) == (0, 0)
    assert tuning.widest_plateau([True, False, False]) == (0, 1)
    assert tuning.widest_plateau([False, False, True]) == (0, 0)


def test_threshold_search_against_brute_force(lab):
    pdf = lab.features.toPandas()
    found = tuning.find_threshold(lab.features, "L1")
    points = tuning.grid(found["threshold_grid_min"], found["threshold_grid_max"], 0.05)
    assert found["optimal_threshold"] in points
    mid = pdf[pdf["inpatient_visit_count"] == 0]
    shares = []
    for t in points:
        regular = mid["irregularity_l1"] < t
        rows = [mid[(mid["visit_count"] >= 4) & regular], mid[(mid["visit_count"] >= 4) & ~regular],
                mid[mid["visit_count"].between(2, 3) & regular], mid[mid["visit_count"].between(2, 3) & ~regular]]
        shares.append([len(r) / len(pdf) * 100 for r in rows])
    change = np.abs(np.gradient(np.array(shares), points, axis=0)).sum(1)
    smooth = pd.Series(change).rolling(3, center=True, min_periods=1).mean()
    assert found["stability_min_derivative"] == pytest.approx(smooth.min())


def test_penalty_choice_is_consistent(lab):
    got = tuning.choose_penalty(lab.features)
    assert got["recommendation"] in ("L1", "L2") and 0 <= got["agreement"] <= 1
    v = lab.features.toPandas().dropna(subset=["irregularity_l1", "irregularity_l2"])
    cv = {p: v[f"irregularity_{p}"].std() / v[f"irregularity_{p}"].mean() for p in ("l1", "l2")}
    assert got["robustness"] == ("L1" if cv["l1"] < cv["l2"] else "L2")


def test_parameter_row_of_manual_and_tuned_runs(spark, lab):
    auto = tuning.parameter_row(spark, tuning.choose_penalty(lab.features), tuning.find_threshold(lab.features), "t0").first()
    assert auto["penalty_source"] == "AUTO" and auto["stability_plateau_width"] > 0
    manual = tuning.parameter_row(spark, "L2", 0.4, "t1").first()
    assert (manual["penalty"], manual["threshold"], manual["threshold_confidence"]) == ("L2", 0.4, "MANUAL")


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    n = 600
    pdf = pd.DataFrame({
        "person_id": rng.integers(0, 200, n), "year": rng.integers(2000, 2006, n), "g": rng.integers(0, 3, n),
        "cohort": rng.choice(["cohort_1", "cohort_2a"], n), "prior_year_max_cci": rng.integers(0, 9, n).astype(float),
        "days_observed": rng.integers(1, 200, n), "max_cci": rng.integers(0, 9, n),
    })
    pdf["v"] = rng.gamma(2.0, 3.0, n) + pdf["max_cci"] * (0.3 + 0.4 * pdf["g"])
    pdf.loc[rng.random(n) < 0.2, "prior_year_max_cci"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn(
        "prior_year_max_cci", F.expr("nullif(prior_year_max_cci, double('nan'))"))


def test_residuals_centre_on_zero(panel):
    _, df = panel
    out = residuals.with_residuals(df, "g", ["v"])
    assert all(abs(r[1]) < 1e-9 for r in out.groupBy("g").agg(F.avg("domain_resid_v")).collect())


def test_interaction_regression_against_full_design(panel):
    pdf, df = panel
    rows = df.select("person_id", "g", "max_cci", F.lit("v").alias("outcome"), F.col("v").alias("value"))
    y = pdf["v"].to_numpy()
    skew = ((y - y.mean()) ** 3).mean() / y.std() ** 3
    y = np.log1p(y) if abs(skew) > 1 else y
    x, g = pdf["max_cci"].to_numpy(float), pdf["g"].to_numpy()
    design = np.column_stack([np.ones_like(x), g == 0, g == 1, x, x * (g == 0), x * (g == 1)]).astype(float)
    bread = np.linalg.inv(design.T @ design)
    beta = bread @ design.T @ y
    e = y - design @ beta
    scores = pd.DataFrame(design * e[:, None]).groupby(pdf["person_id"].to_numpy()).sum().to_numpy()
    groups, n, p = len(scores), len(y), 6
    cov = bread @ (scores.T @ scores) @ bread * groups / (groups - 1) * (n - 1) / (n - p)
    got = {r["g"]: r for r in residuals.interaction_p(residuals.interaction_ols(rows, "g", [0, 1, 2], 2)).collect()}
    for k, at in ((0, 4), (1, 5)):
        assert got[k]["coef"] == pytest.approx(beta[at], rel=1e-8)
        assert got[k]["se"] == pytest.approx(np.sqrt(cov[at, at]), rel=1e-8)
        assert got[k]["p_value"] == pytest.approx(tails.normal_tail(beta[at] / np.sqrt(cov[at, at])), rel=1e-6)
        assert got[k]["r_squared"] == pytest.approx(1 - (e @ e) / ((y - y.mean()) ** 2).sum(), rel=1e-8)


def test_multinomial_logit_solves_score_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 10, 3000)
    eta = np.column_stack([np.zeros(3000), -1 + 0.3 * x, 0.5 - 0.2 * x])
    prob = np.exp(eta) / np.exp(eta).sum(1, keepdims=True)
    k = np.array([rng.choice(3, p=q) for q in prob])
    counts = spark.createDataFrame(pd.DataFrame({"max_cci": x, "cluster": k})).groupBy("max_cci", "cluster").agg(F.count("*").alias("n"))
    got = {r["vs_cluster"]: r for r in residuals.multinomial_logit(counts, {0: "a", 1: "b", 2: "c"}, 0).collect()}
    assert got[1]["coef"] == pytest.approx(0.3, abs=0.05) and got[2]["coef"] == pytest.approx(-0.2, abs=0.05)
    assert got[0]["is_reference"] and got[0]["sig"] == "ref"
    assert got[1]["ci_lo_95"] < got[1]["odds_ratio"] < got[1]["ci_hi_95"]
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["max_cci"], outputCol="features").transform(
        spark.createDataFrame(pd.DataFrame({"max_cci": x.astype(float), "label": k.astype(float)})))
    fit = LogisticRegression(family="multinomial", maxIter=200, tol=1e-12).fit(rows).coefficientMatrix.toArray()
    assert got[1]["coef"] == pytest.approx(fit[1, 0] - fit[0, 0], abs=2e-4)


def logit_of(spark, rows, reference=0, **kw):
    counts = spark.createDataFrame(rows, "max_cci int, cluster int, n bigint")
    return {r["vs_cluster"]: r for r in residuals.multinomial_logit(counts, {}, reference, **kw).collect()}


def test_multinomial_logit_where_no_finite_slope_fits(spark):
    got = logit_of(spark, [(0, 0, 5), (1, 0, 5), (2, 1, 5), (3, 1, 5), (0, 2, 3), (1, 2, 9)])
    assert got[1]["separated"] and got[1]["odds_ratio"] is None and got[1]["sig"] == "n/a" and not got[1]["converged"]
    assert got[2]["converged"] and got[2]["coef"] == pytest.approx(np.log(3), abs=1e-3)  # odds 3/5 and 9/5
    touching = logit_of(spark, [(0, 0, 5), (1, 0, 5), (1, 1, 5), (2, 1, 5)])
    assert touching[1]["separated"] and touching[0]["is_reference"]
    assert logit_of(spark, [(4, 0, 5), (4, 1, 2)])[1]["separated"]


def test_multinomial_logit_of_one_class_and_of_none(spark):
    assert [r["is_reference"] for r in logit_of(spark, [(0, 0, 5), (3, 0, 1)]).values()] == [True]
    assert logit_of(spark, [(0, 1, 5)]) == {} and logit_of(spark, []) == {}


def test_multinomial_logit_says_when_it_stops_early(spark):
    rows = [(x, k, n) for x in range(6) for k, n in ((0, 10 + x), (1, 3 * x + 1), (2, 20 - 3 * x))]
    assert not logit_of(spark, rows, max_iter=1)[1]["converged"]
    full = logit_of(spark, [(100 * x, k, 1000 * n) for x, k, n in rows])
    assert full[1]["converged"] and full[2]["coef"] < 0 < full[1]["coef"]


def test_last_year_counts_pick_the_last_year(spark):
    df = spark.createDataFrame([(1, 2000, 3, 1), (1, 2002, 4, 2), (2, 2001, 0, 0), (3, 2001, None, 1), (3, 2000, 2, 1), (4, 1999, 65, -1)],
                               "person_id bigint, year int, max_cci int, k int")
    rows = residuals.last_year_counts(df, "k")
    assert sorted(map(tuple, rows.collect())) == [(0, 0, 1), (4, 2, 1), (65, -1, 1)]
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_one_year_per_person_without_sorting_rows(spark):
    from spanweave.operators import sampling

    df = spark.createDataFrame([(p, y, p * y) for p in range(40) for y in range(2000, 2000 + p % 7 + 1)], "person_id bigint, year int, v bigint")
    one, flagged = sampling.one_year_per_person(df), sampling.with_training_flag(df)
    assert one.count() == 40 and flagged.count() == df.count()
    assert flagged.where("training_data = 1").drop("training_data").exceptAll(one).isEmpty()
    assert len({r["year"] for r in one.collect()}) > 3
    for plan in (one, flagged):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in text and "Join" not in text


def rss(design, y):
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    return ((y - design @ beta) ** 2).sum()


def test_partial_f_of_cluster_against_full_design(panel):
    pdf, df = panel
    y, m = pdf["v"].to_numpy(), pdf["prior_year_max_cci"].isna().to_numpy(float)
    x = pdf["prior_year_max_cci"].fillna(0).to_numpy()
    base = np.column_stack([np.ones_like(x), x, m])
    full = np.column_stack([base, pdf["g"] == 0, pdf["g"] == 1]).astype(float)
    expect = ((rss(base, y) - rss(full, y)) / 2) / (rss(full, y) / (len(y) - 5))
    got = cohorts.cluster_effect(df, "g", [("V", "v")]).first()
    assert got["f"] == pytest.approx(expect, rel=1e-8) and got["df1"] == 2 and got["df2"] == len(y) - 5
    no_prior = df.withColumn("prior_year_max_cci", F.lit(None).cast("double"))
    plain = cohorts.cluster_effect(no_prior, "g", [("V", "v")]).first()
    anova = cohorts.anova(df, "g", [("V", "v")]).first()
    assert plain["f"] * (len(y) - 3) / (len(y) - 5) == pytest.approx(anova["f"], rel=1e-8)


def test_partial_f_of_cohort_against_full_design(panel):
    pdf, df = panel
    y, m = np.log1p(pdf["v"].to_numpy()), pdf["prior_year_max_cci"].isna().to_numpy(float)
    x = pdf["prior_year_max_cci"].fillna(0).to_numpy()
    base = np.column_stack([np.ones_like(x), x, m, np.log1p(pdf["days_observed"]), pdf["year"] - 2000.0])
    full = np.column_stack([base, pdf["cohort"] == "cohort_2a"]).astype(float)
    expect = (rss(base, y) - rss(full, y)) / (rss(full, y) / (len(y) - 6))
    got = cohorts.cohort_effect(df, "cohort", [("V", "v")], adjust_for_days_observed=True, adjust_for_year=True,
                                y_transform="log1p").first()
    assert got["f"] == pytest.approx(expect, rel=1e-6) and got["df2"] == len(y) - 6


def test_publication_cells(spark):
    df = spark.createDataFrame([(12.34, 0.00012), (-4.0, 0.2), (None, 0.2), (1.0, None)], "diff double, p double")
    cells = [r[0] for r in df.select(formats.diff_cell(F.col("diff"), F.col("p"))).collect()]
    assert cells == ["+12.3 (p=1.20e-04***)", "-4.0 (p=2.00e-01)", None, None]
    bands = [r[0] for r in spark.createDataFrame([(0.0005,), (0.005,), (0.04,), (0.5,), (None,)], "p double").select(
        formats.p_band(F.col("p"))).collect()]
    assert bands == ["<0.001", "<0.01", "<0.05", "0.50", None]
    words = [r[0] for r in spark.createDataFrame([(0.05,), (-0.2,), (0.4,), (-0.9,)], "r double").select(
        formats.rho_wording(F.col("r"))).collect()]
    assert words == ["negligible", "weak negative", "moderate positive", "strong negative"]


def test_publication_matrix_orders_metrics(panel):
    _, df = panel
    named = df.withColumn("k", F.concat(F.lit("c"), "g"))
    long = cohorts.comparison_p(cohorts.within_cluster_comparison(named, "cohort", "k", [("V", "v"), ("A", "days_observed")]))
    wide = cohorts.publication_matrix(long, ["c2", "c1", "c0"], ["V", "A"])
    assert wide.columns == ["Metric", "c2", "c1", "c0"]
    assert [r["Metric"] for r in wide.collect()] == ["V", "A"]


def test_slices_of_long_tailed_scores_are_even_and_ranks_exact(spark):
    from spanweave.operators import ranks

    rng = np.random.default_rng(4)
    values = np.round(np.exp(3 * rng.normal(size=20_000)), 4)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": values}))
    freq = ranks.frequencies(df, ["g"], "v")
    sizes = [r["count"] for r in ranks._sliced(freq, ["g"], 64).groupBy("_slice").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) == 64
    got = {r["value"]: r["before"] for r in ranks.cumulative(freq, ["g"], 64).collect()}
    ordered = np.sort(values)
    assert all(got[v] == np.searchsorted(ordered, v) for v in values[:500])
    few = ranks.cumulative(spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("b", 5.0, 2)], "g string, value double, n bigint"), ["g"], 64)
    assert {(r["g"], r["value"]): (r["before"], r["total"]) for r in few.collect()} == {("a", 1.0): (0, 4), ("a", 2.0): (3, 4), ("b", 5.0): (0, 2)}


@pytest.mark.parametrize("ordered", [3, 10_000])
def test_pages_of_persons(spark, monkeypatch, ordered):
    from datetime import date

    from spanweave.operators import timelines

    monkeypatch.setattr(timelines, "ORDERED", ordered)
    monkeypatch.setattr(timelines, "RANGES", 4)
    ids = sorted({i * i * 7 for i in range(40)} | {10**12 + i for i in range(25)})
    df = spark.createDataFrame([(i, date(2020, 1, 1)) for i in [*ids, *ids[:3]]] + [(None, date(2020, 1, 1))], "person_id bigint, date date")
    for number in (1, 2, 5, 7, 9):
        rows = timelines.page(df, number, 10).collect()
        wanted = dict(enumerate(ids))
        assert {(r["lane"], r["person_id"]) for r in rows} == {(k, wanted[k]) for k in range(10 * number - 10, 10 * number) if k in wanted}
    assert timelines.page(df.limit(0), 1, 10).count() == 0
    plan = timelines.page(df, 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Broadcast" not in plan


def test_far_tail_of_t_against_its_integral():
    from spanweave.functions import tails

    def integral(start, stop, power, n=4000):
        h = (stop - start) / n
        return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * math.cos(start + i * h) ** power for i in range(n + 1))

    for dof in (300, 1094, 20_000):
        reach = 12 / math.sqrt(dof)
        for t in (0.5, 2.0, 3.5, 4.5, 6.0, 8.5, 9.5):
            start = math.atan(t / math.sqrt(dof))
            expect = integral(start, start + reach, dof - 1) / integral(0.0, reach, dof - 1)
            assert tails.t_tail(t, dof) == pytest.approx(expect, rel=1e-7, abs=1e-300), (dof, t)


def test_cross_cohort_queries_store_no_days_or_months(spark):
    """One reader: nothing is stored. Several readers: only the columns they read are."""
    from spanweave.plans.all_queries import QUERIES

    def plan(name: str) -> str:
        return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

    assert "LogicalRDD" not in plan("label_assembly")
    assert "LogicalRDD" not in plan("cohort_compare")
    stored = [line for line in plan("cohort_stack").splitlines() if "LogicalRDD" in line]
    assert stored and all("condition_count" not in line for line in stored)


def test_label_pairs_are_laid_out_from_counted_rows(spark):
    rows = [("a", 1, "x")] * 5 + [("a", 2, "Unknown")] * 3 + [("b", None, "x")] * 2 + [(None, None, None)] + [("1", 1, "a")]
    df = spark.createDataFrame(rows, "p string, q int, r string")
    methods = {"m1": "p", "m2": "q", "m3": "r", "m4": "p"}
    expected = {}
    for row in rows:
        row = dict(zip("pqr", row))
        for one, two in combinations(methods, 2):
            a, b = row[methods[one]], row[methods[two]]
            if None not in (a, b) and "Unknown" not in (a, b):
                key = (one, two, str(a), str(b))
                expected[key] = expected.get(key, 0) + 1
    cells = concordance.contingency(df, methods)
    assert {tuple(r)[:4]: r["n"] for r in cells.collect()} == expected
    plan = concordance.contingency(df, methods)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate"):]


def test_comparisons_store_only_the_columns_they_read(lab):
    from spanweave.plans.lab import COMPARED_COLUMNS, METHOD_COLUMNS

    wide, narrow = lab.relabelled, lab.keeping(COMPARED_COLUMNS)
    assert narrow.stored_labels.columns == list(COMPARED_COLUMNS) and "archetype_reason" in lab.stored_labels.columns
    assert narrow.tuned_threshold == lab.tuned_threshold
    one, two = [concordance.contingency(df, METHOD_COLUMNS) for df in (wide, narrow.relabelled)]
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
