import pytest
from pyspark.sql import functions as F

from spanweave.plans import pipeline
from spanweave.sources import clinical, lens, sinks


def test_csv_ingest_strips_prefix_and_uses_declared_types(spark, tmp_path):
    (tmp_path / "V_Person.csv").write_text(
        "person_id,year_of_birth,month_of_birth,day_of_birth,race_concept_id,ethnicity_concept_id,gender_concept_id\n"
        "1,1950,,,8527,0,8507\n")
    (tmp_path / "extra.csv").write_text("a,b\n1,x\n")
    assert sinks.ingest_csv(spark, str(tmp_path), ["V_Person", "extra"], "raw_db") == ["person", "extra"]
    assert dict(spark.table("raw_db.person").dtypes)["person_id"] == "bigint"
    assert dict(spark.table("raw_db.extra").dtypes)["a"] == "int"
    assert sinks.rename_table(spark, "raw_db.extra", "raw_db.other")
    assert not sinks.rename_table(spark, "raw_db.extra", "raw_db.other")
    assert sinks.tables_exist(spark, ["raw_db.person", "raw_db.other"])
    assert sinks.clear_downstream(spark, "raw_db", ["PERSON"]) == []
    assert sinks.clear_downstream(spark, "raw_db", ["PERSON"], enabled=True) == ["other"]
    assert not sinks.tables_exist(spark, ["raw_db.other"])


def test_replace_by_key_keeps_other_methods(spark, tmp_path):
    path = str(tmp_path / "sep")
    sinks.replace_by_key(spark.createDataFrame([("a", 1), ("b", 2)], "method string, v int"), path)
    sinks.replace_by_key(spark.createDataFrame([("a", 9)], "method string, v int"), path)
    assert sorted((r["method"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_append_with_new_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append(spark.createDataFrame([(1,)], "a int"), path)
    sinks.append(spark.createDataFrame([(2, "x")], "a int, b string"), path)
    rows = sorted(map(tuple, sinks.read_evolving(spark, path).select("a", "b").collect()))
    assert rows == [(1, None), (2, "x")]


def test_small_cells(spark):
    df = spark.createDataFrame([(0, 5), (1, 5), (9, 5), (10, 5), (None, 5)], "n int, value int")
    out = sinks.suppress_small_cells(df)
    assert [r["n"] for r in out.collect()] == ["0", "<10", "<10", "10", None]
    assert [r["value"] for r in out.collect()] == [5] * 5
    named = {c: sinks.is_count_column(c) for c in ("n_obs", "N patients", "visit_count", "account", "mean", "sample size")}
    assert named == {"n_obs": True, "N patients": True, "visit_count": True, "account": False, "mean": False, "sample size": True}


def test_export_of_a_small_table(spark, tmp_path):
    sinks.export_csv(spark.range(3), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    path = tmp_path / "v_person.csv"
    path.write_text("person_id,gender_concept_id,extra,year_of_birth,month_of_birth,day_of_birth,race_concept_id,ethnicity_concept_id\n"
                    "7,8507,x,1950,3,,8527,38003564\n8,8532,y,odd,1,2,0,0\n")
    rows = sinks.read_csv(spark, str(path), sinks.SCHEMAS["person"]).orderBy("person_id").collect()
    assert [(r["person_id"], r["gender_concept_id"], r["year_of_birth"], r["month_of_birth"], r["day_of_birth"]) for r in rows] == [
        (7, 8507, 1950, 3, None), (8, 8532, None, 1, 2)]
    assert "extra" not in rows[0].asDict()
    with pytest.raises(ValueError, match="visit_concept_id"):
        sinks.read_csv(spark, str(path), sinks.SCHEMAS["visit_occurrence"])


def test_label_rows_of_outliers(spark):
    df = spark.createDataFrame([(1, 2000, -1, 0.9), (1, 2001, 2, 0.8)], "person_id bigint, year int, k int, c double")
    rows = sinks.label_rows(df, "gmm_4", "k", "t", "c").collect()
    assert [(r["cluster_label"], r["is_outlier"]) for r in rows] == [("Outlier", 1), ("Cluster 2", 0)]


def test_events_from_separate_tables_match_the_lens(spark, lab):
    base = lab.clinical
    tables = {"person": base.person, "visit_occurrence": base.visits, "concept": base.concepts}
    from spanweave.sources.schemas import DOMAIN_TABLES

    for domain, (table, when, concept) in DOMAIN_TABLES.items():
        part = base.events.filter(F.col("domain") == domain)
        cols = [F.col("person_id"), F.col("date").alias(when), F.col("concept_id").alias(concept), F.col("visit_occurrence_id")]
        if domain == "condition":
            cols += [F.col("source_code").alias("condition_source_value"),
                     F.col("vocab_id").alias("condition_source_concept_vocabulary_id"),
                     F.col("type_concept_id").alias("condition_type_concept_id")]
        tables[table] = part.select(*cols)
    rebuilt = clinical.from_tables(tables).events
    assert rebuilt.select(*base.events.columns).exceptAll(base.events).count() == 0
    assert rebuilt.count() == base.events.count()


@pytest.mark.parametrize("name", ["features_core", "spine_daily_counts"])
def test_plans_have_no_python_and_only_small_broadcasts(spark, lab, name):
    from spanweave.plans.all_queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "CartesianProduct" not in plan
    assert plan.count("strategy=broadcast") <= 4  # the fixed code-prefix lookups
