"""Stages, their reuse, layouts, exports, and whole runs over the smallest tables."""

import csv
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanweave.plans import pipeline
from spanweave.sources import lens, sinks
from spanweave.sources.manifest import PROPERTY, Stages, files_fingerprint

SF = "/root/testdata/sf0.001"


def numbers(spark, n):
    return lambda: spark.range(n).withColumn("x", F.col("id") % 3)


def built(spark, db, n=5, top=2, data=None):
    """A run of three stages in a row over stored input."""
    stages = Stages(spark, db)
    reads = [stages.source("data", data)] if data is not None else []
    one = stages.stage("one", numbers(spark, n), {"n": n}, reads)
    stages.stage("two", lambda: one.groupBy("x").count(), {}, ["one"])
    stages.stage("three", lambda: spark.range(top), {"top": top})
    return stages.built


def test_stages_are_reused_until_something_changes(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    data = spark.read.parquet(path)
    assert built(spark, "reuse_t", data=data) == ["one", "two", "three"]
    assert built(spark, "reuse_t", data=data) == []
    assert built(spark, "reuse_t", top=3, data=data) == ["three"]
    assert built(spark, "reuse_t", n=6, top=3, data=data) == ["one", "two"]
    assert spark.table("reuse_t.two").agg(F.sum("count")).first()[0] == 6
    spark.range(1).write.mode("append").parquet(path)
    assert built(spark, "reuse_t", n=6, top=3, data=spark.read.parquet(path)) == ["one", "two"]


def test_recompute_builds_all_stages(spark):
    built(spark, "again_t")
    stages = Stages(spark, "again_t", recompute=True)
    stages.stage("one", numbers(spark, 5), {"n": 5})
    assert stages.built == ["one"]


def test_a_write_that_breaks_half_way_is_built_again(spark):
    failing = F.raise_error(F.lit("lost"))

    def broken():
        return spark.range(0, 100, 1, 4).withColumn("x", F.when(F.col("id") == 99, failing.cast("bigint")).otherwise(F.col("id")))

    for name, before in (("fresh", False), ("old", True)):
        if before:
            Stages(spark, "broken_t").stage(name, numbers(spark, 4), {"v": 0})
        with pytest.raises(Exception, match="lost"):
            Stages(spark, "broken_t").stage(name, broken, {"v": 1})
        stages = Stages(spark, "broken_t")
        assert stages.stage(name, numbers(spark, 7), {"v": 1}).count() == 7 and stages.built == [name]
        again = Stages(spark, "broken_t")
        again.stage(name, broken, {"v": 1})
        assert again.built == []


def test_a_table_without_a_mark_is_built_again(spark):
    stages = Stages(spark, "mark_t")
    stages.stage("one", numbers(spark, 4))
    spark.sql(f"ALTER TABLE mark_t.one UNSET TBLPROPERTIES ('{PROPERTY}')")
    again = Stages(spark, "mark_t")
    again.stage("one", numbers(spark, 9))
    assert again.built == ["one"] and spark.table("mark_t.one").count() == 9


def test_parts_of_a_table_are_kept_apart(spark):
    def rows(v, n):
        return lambda: spark.range(n).select(F.col("id"), F.lit(v).alias("method"))

    def both(n):
        stages = Stages(spark, "parts_t")
        stages.part("m", "method", "a", rows("a", 2), {})
        stages.part("m", "method", "b", rows("b", n), {"n": n})
        return stages.built

    assert both(3) == ["m/a", "m/b"] and both(3) == [] and both(4) == ["m/b"]
    assert {r[0]: r[1] for r in spark.table("parts_t.m").groupBy("method").count().collect()} == {"a": 2, "b": 4}


def test_fingerprints_see_files_and_rows(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.range(3).write.parquet(path)
    first = files_fingerprint(spark.read.parquet(path))
    assert first == files_fingerprint(spark.read.parquet(path).filter("id > 0"))
    spark.range(3).write.mode("append").parquet(path)
    assert first != files_fingerprint(spark.read.parquet(path))
    rows = [files_fingerprint(spark.createDataFrame([(i, None)], "a int, b string")) for i in (1, 1, 2)]
    assert rows[0] == rows[1] != rows[2]


def touched(spark, table, column, value):
    """Share of the files whose statistics let ``value`` be in ``column``."""
    hits = []
    for name in spark.table(table).inputFiles():
        meta = pq.ParquetFile(name.removeprefix("file:")).metadata
        at = meta.schema.names.index(column)
        stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        hits.append(any(s.min <= value <= s.max for s in stats))
    return sum(hits) / len(hits)


def test_clustered_tables_skip_files_by_person_and_by_year(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS layout_t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(16_000).select((F.col("id") % 1000).alias("person_id"), (F.lit(2010) + F.col("id") % 16).cast("int").alias("year"))
        rows = rows.union(spark.createDataFrame([(None, 2012), (5, None)], "person_id bigint, year int"))
        sinks.overwrite_clustered(rows.distinct(), "layout_t.z", ("person_id", "year"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.table("layout_t.z").count() == rows.distinct().count()
    assert touched(spark, "layout_t.z", "person_id", 700) <= 0.5 and touched(spark, "layout_t.z", "year", 2013) <= 0.5


def test_layouts_of_empty_and_constant_keys(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS layout_t")
    for n in (0, 3):
        rows = spark.range(n).select(F.lit(1).cast("bigint").alias("person_id"), F.lit(2000).alias("year"))
        sinks.overwrite_clustered(rows, f"layout_t.c{n}", ("person_id", "year"))
        assert spark.table(f"layout_t.c{n}").count() == n


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("export"))
    names = pipeline.run(spark, lens.load(spark, SF), "cohort_t", k=(4, 7), run_timestamp="t0", export_to=folder)
    return names, folder


def test_run_stores_every_stage(spark, cohort):
    names, _ = cohort
    wanted = {"unified_daily", "unified_weekly", "unified_monthly", "unified_yearly", "archetype_features_yearly", "rules_yearly", "rules_adaptive_yearly",
              "rules_parameters", "gmm_4_model", "gmm_7_yearly", "rules_medoids", "gmm_4_cluster_profiles", "gmm_7_relabel", "cluster_separation_metrics",
              "feature_importance", "gmm4_residuals_yearly", "residual_classification", "residual_spearman", "residual_spearman_by_cluster",
              "residual_interactions", "cluster_odds", "domain_quartiles", "domain_kruskal", "domain_effects", "residual_summary", "label_confusion",
              "label_agreement", "label_information", "label_consistency", "rules_stability", "rules_run_scorecard", "method_scorecard", "cluster_labels_yearly"}
    assert wanted <= set(names)
    assert all(spark.table(f"cohort_t.{n}").count() > 0 for n in wanted)
    labels = spark.table("cohort_t.cluster_labels_yearly")
    assert {r[0] for r in labels.select("model_id").distinct().collect()} == {"rules", "rules_adaptive", "gmm_4", "gmm_7"}
    assert {"visit_occurrence_ids", "drug_concept_ids", "condition_source_codes"} <= set(spark.table("cohort_t.unified_yearly").columns)


def test_a_second_run_builds_nothing_and_a_changed_one_only_what_follows(spark, cohort, monkeypatch):
    seen = []
    stage, part = Stages.stage, Stages.part

    def watch(method):
        def call(self, *args, **kw):
            before = len(self.built)
            out = method(self, *args, **kw)
            seen.extend(self.built[before:])
            return out
        return call

    monkeypatch.setattr(Stages, "stage", watch(stage))
    monkeypatch.setattr(Stages, "part", watch(part))
    pipeline.run(spark, lens.load(spark, SF), "cohort_t", k=(4, 7), run_timestamp="t1")
    assert seen == []
    spark.sql(f"ALTER TABLE cohort_t.gmm_4_model UNSET TBLPROPERTIES ('{PROPERTY}')")
    pipeline.run(spark, lens.load(spark, SF), "cohort_t", k=(4, 7), run_timestamp="t1")
    assert seen == ["gmm_4_model"]  # the same model again, so what follows it stays


def test_exports_suppress_small_cells_of_aggregates_only(spark, cohort):
    names, folder = cohort
    exported = {p.split("/")[-1] for p in glob.glob(f"{folder}/*")}
    assert "residual_summary" in exported and "unified_daily" not in exported and "residual_classification" in exported
    cells = []
    for path in glob.glob(f"{folder}/*/*.csv"):
        name = path.split("/")[-2]
        with open(path) as f:
            for row in csv.DictReader(f):
                cells += [v for c, v in row.items() if name not in pipeline.ROW_LEVEL and sinks.is_count_column(c)]
    numbers = [float(v) for v in cells if v not in ("", "<10")]
    assert "<10" in cells and numbers and not any(0 < v < 10 for v in numbers)
    written = sum(len(open(p).read().splitlines()) - 1 for p in glob.glob(f"{folder}/residual_classification/*.csv"))
    assert written == spark.table("cohort_t.residual_classification").count()


def test_validation_and_comparison_of_two_cohorts(spark, cohort, tmp_path):
    names = pipeline.validate(spark, lens.load(spark, SF), "cohort_v", "cohort_t", k=(4, 7))
    assert "rules_yearly" in names and spark.table("cohort_v.gmm_4_yearly").filter("gmm_4_cluster is null").count() == 0
    made = pipeline.compare(spark, "cohort_t", "cohort_v", "cohort_x", k=(4, 7), buckets=4, export_to=str(tmp_path / "x"))
    assert {"archetype_differences", "gmm_4_named_publication", "gmm_7_named_sizes", "cohort_welch", "cohort_effect", "archetype_concept_stats"} <= set(made)
    both = spark.table("cohort_x.cohort_characterised")
    assert both.count() == sum(spark.table(f"{db}.archetype_features_yearly").count() for db in ("cohort_t", "cohort_v"))
    assert both.filter("archetype IS NULL OR gmm_7_named IS NULL OR total_data_points IS NULL").count() == 0


def test_labels_of_a_cohort_join_without_moving_rows(spark, cohort):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = pipeline.characterise(Stages(spark, "cohort_p"), "cohort_t", (4, 7), buckets=4)
        joined.count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") >= 4 and "Exchange" not in plan
