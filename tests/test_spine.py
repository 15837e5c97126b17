from datetime import date

from pyspark.sql import functions as F

from spanweave.functions.scalar import age_on, birth_date
from spanweave.operators import comorbidity, features, rollup, rules, runs, spine, timelines
from helpers import EVENTS, conditions, d, no_events, visits


def person_year(spark, visit_rows, **kw):
    v = visits(spark, visit_rows)
    days = spine.visit_days(v)
    daily = spine.daily(no_events(spark), days)
    return features.person_year_features(daily, days, no_events(spark), **kw)


def test_spans_null_reversed_and_year_crossing(spark):
    v = visits(spark, [(1, 1, 9201, "2020-03-01", None), (2, 1, 9201, "2020-04-10", "2020-04-08"),
                       (3, 1, 9201, "2019-12-30", "2020-01-02")])
    rows = spine.visit_days(v).groupBy("visit_occurrence_id").agg(
        F.count("*").alias("n"), F.countDistinct(F.year("date")).alias("years")).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == {1: (1, 1), 2: (1, 1), 3: (4, 2)}


def test_spans_are_not_cut_and_long_ones_are_reported(spark):
    v = visits(spark, [(1, 1, 9201, "2000-01-01", "2019-12-31")])
    assert spine.visit_days(v).count() == 7305
    assert spine.span_audit(v).first()["n_over_limit"] == 1


def test_same_day_outpatient_counts_as_inpatient_visit(spark):
    row = person_year(spark, [(1, 1, 9201, "2020-05-01", "2020-05-03"), (2, 1, 9202, "2020-05-02", None)]).first()
    assert (row["visit_count"], row["hospitalized_days"], row["inpatient_visit_count"]) == (4, 3, 2)


def test_regularity_needs_three_active_dates(spark):
    two = person_year(spark, [(1, 1, 9202, "2020-01-01", None), (2, 1, 9202, "2020-01-11", None)]).first()
    assert two["irregularity_l1"] is None and two["has_valid_regularity"] == 0
    even = person_year(spark, [(i, 1, 9202, f"2020-01-{1 + 7 * i:02d}", None) for i in range(4)]).first()
    assert even["irregularity_l1"] == 0 and even["irregularity_l2"] == 0
    uneven = person_year(spark, [(1, 1, 9202, "2020-01-01", None), (2, 1, 9202, "2020-01-11", None),
                                 (3, 1, 9202, "2020-02-10", None)]).first()
    assert abs(uneven["irregularity_l1"] - 0.5) < 1e-12 and abs(uneven["irregularity_l2"] - 0.5) < 1e-12
    same_day = person_year(spark, [(i, 1, 9202, "2020-01-01", None) for i in range(3)]).first()
    assert same_day["visit_count"] == 3 and same_day["irregularity_l1"] is None


def groups_of(spark, code, vocab="ICD9CM", variant="main"):
    v = visits(spark, [(1, 1, 9202, "2020-01-05", None)])
    scored = comorbidity.visit_scores(conditions(spark, [(1, "2020-02-01", code, vocab, 1)]), v, variant).collect()
    if not scored:
        return set()
    return {g for g in range(1, 18) if scored[0]["cci_mask"] >> g & 1}


def test_code_groups_first_match_and_double_counts(spark):
    assert groups_of(spark, "342.0") == {6}
    assert groups_of(spark, "344.1") == {6}
    assert groups_of(spark, "362.34") == {3}
    assert groups_of(spark, "457.3") == {4}
    assert groups_of(spark, "404.03") == {2, 13}
    assert groups_of(spark, "zzz") == set()


def test_v_codes_by_vocabulary(spark):
    assert groups_of(spark, "V56.0", "ICD9CM") == {13}
    assert groups_of(spark, "V56.0", "ICD10CM") == set()
    assert groups_of(spark, "V56.0", None) == set()


def test_lung_cancer_only_in_main_code_table(spark):
    assert groups_of(spark, "C34.1", "ICD10CM") == {14}
    assert groups_of(spark, "C34.1", "ICD10CM", "validation") == set()


def test_weights_add_without_hierarchy(spark):
    v = visits(spark, [(i, 1, 9202, "2020-01-05", None) for i in (1, 2, 3)])
    rows = [(1, "250.0", 1), (1, "250.4", 1), (1, "571.2", 2), (1, "572.2", 2), (1, "C50.1", 3), (1, "197.0", 3)]
    c = conditions(spark, [(p, "2020-02-01", code, "ICD9CM", vid) for p, code, vid in rows])
    got = {r["visit_occurrence_id"]: r["cci_total"] for r in comorbidity.visit_scores(c, v).collect()}
    assert got == {1: 3, 2: 4, 3: 8}


def test_condition_from_other_year_is_ignored(spark):
    v = visits(spark, [(1, 1, 9202, "2020-01-05", None)])
    c = conditions(spark, [(1, "2021-02-01", "410.9", "ICD9CM", 1)])
    assert comorbidity.visit_scores(c, v).count() == 0


def test_expanded_code_table_has_each_prefix_once_per_group():
    rows = comorbidity.code_rows()
    assert len(rows) == len(set(rows)) and {g for _, _, g in rows} == set(range(1, 18))
    assert (4, "E148", 10) in rows and (3, "I69", 4) in rows and (5, "40493", 13) in rows
    assert (3, "173", 14) not in rows and (3, "B23", 17) not in rows


def test_demographic_names_and_partial_birth_dates(spark):
    people = spark.createDataFrame(
        [(1, 1950, None, None, 8515, 1, 8507), (2, 1950, 3, None, 8527, 2, 0), (3, 1950, 2, 30, None, None, 8532)],
        "person_id bigint, year_of_birth int, month_of_birth int, day_of_birth int, race_concept_id int, "
        "ethnicity_concept_id int, gender_concept_id int")
    names = spark.createDataFrame([(8515, "Asian"), (8527, "White"), (8507, "MALE"), (8532, "FEMALE"),
                                   (1, "Hispanic or Latino"), (2, "Refused")], "concept_id int, concept_name string")
    got = {r["person_id"]: r for r in spine.demographics(people, names).collect()}
    assert got[1]["birth_date"] == date(1950, 7, 1) and got[2]["birth_date"] == date(1950, 3, 1)
    assert got[3]["birth_date"] is None
    assert [got[i]["race"] for i in (1, 2, 3)] == ["Unknown", "White", "Unknown"]
    assert [got[i]["gender"] for i in (1, 2, 3)] == ["Male", "Unknown", "Female"]
    assert [got[i]["ethnicity"] for i in (1, 2, 3)] == ["Hispanic or Latino", "Not Hispanic or Latino", "Unknown"]
    asian = spine.demographics(people, names, asian_pattern="%asian%").filter("person_id = 1").first()
    assert asian["race"] == "Asian"


def test_age_turns_on_the_birthday(spark):
    df = spark.createDataFrame([(d("2020-05-09"), d("1990-05-10")), (d("2020-05-10"), d("1990-05-10"))], "a date, b date")
    assert [r[0] for r in df.select(age_on(F.col("a"), F.col("b"))).collect()] == [29, 30]


def test_null_concepts_keep_the_date_but_add_no_count(spark):
    e = spark.createDataFrame([(1, d("2020-01-01"), "drug", None, None, None, None, None),
                               (1, d("2020-01-02"), "drug", 0, None, None, None, None),
                               (1, d("2020-01-02"), "drug", 0, None, None, None, None)], EVENTS)
    daily = spine.daily(e, spine.visit_days(visits(spark, [])))
    got = {r["date"].day: r for r in daily.collect()}
    assert got[1]["drug_count"] == 0 and got[1]["has_clinical_concepts"] == 0
    assert (got[2]["drug_count"], got[2]["drug_unique_ct"], got[2]["drug_nomatch_ct"]) == (2, 1, 2)


def test_rows_without_person_stay_on_the_spine_without_counts(spark):
    e = spark.createDataFrame([(None, d("2020-01-01"), "drug", 5, None, None, None, None)], EVENTS)
    v = visits(spark, [(7, None, 9201, "2020-01-01", None)])
    row = spine.daily(e, spine.visit_days(v)).first()
    assert row["person_id"] is None and row["drug_count"] == 0
    assert row["visit_count"] == 0 and row["hospitalized_flag"] == 0


def test_concept_lists_keep_repeats(spark):
    e = spark.createDataFrame([(1, d("2020-01-01"), "drug", c, None, None, None, None) for c in (7, 3, 7)], EVENTS)
    row = spine.concept_lists(e).select(spine.expand_list(F.col("concepts")).alias("ids")).first()
    assert row["ids"] == [3, 7, 7]


def test_daily_sums_match_yearly_rollup(lab):
    daily = lab.stored_listed_daily
    year = rollup.rollup_period(daily, "year").agg(F.sum("visit_count"), F.sum("total_data_points"), F.sum("days_in_period")).first()
    day = daily.agg(F.sum("visit_count"), F.sum("total_data_points"), F.count("*")).first()
    assert tuple(year) == tuple(day)
    week = rollup.rollup_period(daily, "week")
    assert week.agg(F.sum("visit_count")).first()[0] == day[0]
    assert week.filter(F.dayofweek(F.to_date("period")) != 2).count() == 0


def test_years_from_months_equal_years_from_days(lab):
    days = rollup.finalize(rollup.rollup_period(lab.stored_listed_daily, "year"), lab.people)
    months = rollup.finalize(rollup.rollup_period(lab.stored_months, "year"), lab.people)
    published = rollup.finalize(rollup.rollup_period(rollup.finalize(lab.stored_months, lab.people), "year"), lab.people)
    assert days.exceptAll(months).isEmpty() and months.exceptAll(days).isEmpty()
    assert days.exceptAll(published).isEmpty() and days.count() == published.count()


def test_lists_are_counted_sorted_and_empty_rather_than_null(spark):
    rows = [(1, d("2020-01-01"), "drug", c, None, None, None, 5) for c in (7, 3, 7)]
    rows += [(1, d("2020-01-01"), "condition", 4, code, vocab, 1, 5) for code, vocab in (("B", "V"), ("A", "V"), ("B", None), (None, "W"))]
    rows += [(1, d("2020-01-31"), "condition", 9, "B", "V", 1, None), (None, d("2020-01-01"), "drug", 8, None, None, None, None)]
    e = spark.createDataFrame(rows, EVENTS)
    days = spine.visit_days(visits(spark, [(5, 1, 9201, "2020-01-01", "2020-01-02"), (6, 1, 9202, "2020-01-01", None)]))
    daily = spine.daily(e, days, lists=True)
    by_day = {(r["person_id"], r["date"].day): r for r in daily.collect()}
    one = by_day[1, 1]
    assert [tuple(x) for x in one["drug_concept_ids"]] == [(3, 1), (7, 2)] and one["drug_count"] == 3 and one["drug_unique_ct"] == 2
    assert [tuple(x) for x in one["condition_source_codes"]] == [("A", 1), ("B", 2)]
    assert [tuple(x) for x in one["condition_vocab_ids"]] == [("V", 2), ("W", 1)]
    assert [tuple(x) for x in one["visit_occurrence_ids"]] == [(5, 1), (6, 1)] and one["visit_count"] == 2
    assert by_day[1, 2]["drug_concept_ids"] == [] and by_day[1, 2]["condition_source_codes"] == []
    assert by_day[None, 1]["drug_concept_ids"] == []
    month = rollup.rollup_period(daily, "month").filter("person_id = 1").first()
    assert [tuple(x) for x in month["condition_source_codes"]] == [("A", 1), ("B", 3)] and month["condition_unique_ct"] == 2
    assert [tuple(x) for x in month["visit_occurrence_ids"]] == [(5, 2), (6, 1)] and month["procedure_concept_ids"] == []
    plain = rollup.rollup_period(daily, "year").filter("person_id = 1").select(runs.expand(F.col("condition_source_codes")).alias("codes")).first()
    assert plain["codes"] == ["A", "B", "B", "B"]
    assert spine.daily(e, days).drop("x").exceptAll(daily.drop(*runs.LISTS)).isEmpty()


def test_concept_with_several_codes_is_one_value(spark):
    rows = [(1, d("2020-01-01"), "condition", c, code, "V", 1, 5) for c, code in ((4, "A"), (4, "B"), (4, "B"), (0, "A"), (0, None), (9, "C"))]
    e = spark.createDataFrame(rows, EVENTS)
    daily = spine.daily(e, spine.visit_days(visits(spark, [])), lists=True)
    for row in (daily.first(), rollup.rollup_period(daily, "week").first()):
        assert [tuple(x) for x in row["condition_concept_ids"]] == [(0, 2), (4, 3), (9, 1)]
        assert [tuple(x) for x in row["condition_source_codes"]] == [("A", 2), ("B", 2), ("C", 1)]
        assert [tuple(x) for x in row["condition_vocab_ids"]] == [("V", 6)]
        assert (row["condition_count"], row["condition_unique_ct"], row["condition_nomatch_ct"]) == (6, 3, 2)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rollups_move_and_store_no_days(lab):
    """Days lie clustered by person, so months and years of them are made where they are."""
    days = exchanges(lab.listed_daily)
    months = rollup.rollup_period(lab.listed_daily, "month")
    assert exchanges(months) == days
    assert exchanges(rollup.rollup_period(months, "year")) == days
    assert "ExistingRDD" not in lab.months._jdf.queryExecution().executedPlan().toString()


def test_lists_of_an_empty_table(spark):
    daily = spine.daily(no_events(spark), spine.visit_days(visits(spark, [])), lists=True)
    assert daily.count() == 0 and rollup.rollup_period(daily, "week").count() == 0


def test_features_ignore_input_partitioning(lab):
    one = features.person_year_features(lab.daily.coalesce(1), lab.days)
    many = features.person_year_features(lab.daily.repartition(13), lab.days.repartition(5))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_l1_never_exceeds_l2_and_cci_never_falls(lab):
    assert lab.features.filter("irregularity_l1 > irregularity_l2 + 1e-12").count() == 0
    features.require_monotone_cci(lab.features)
    features.require_clean(lab.daily)


def test_merge_touching_spans(spark):
    s = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 7, 8), (1, 1, 2)], "person_id bigint, start int, end int")
    got = sorted((r["span_start"], r["span_end"], r["n_stays"]) for r in timelines.merge_spans(s).collect())
    assert got == [(1, 5, 3), (7, 8, 1)]


def test_tracking_of_changes_and_tenure(spark):
    df = spark.createDataFrame([(1, 2000 + i, a) for i, a in enumerate("AABBA")], "person_id bigint, year int, archetype string")
    rows = rules.track(df).orderBy("year").collect()
    assert [r["archetype_changed"] for r in rows] == [0, 0, 1, 0, 1]
    assert [r["segment_id"] for r in rows] == [0, 0, 1, 1, 2]
    assert [r["years_in_current_archetype"] for r in rows] == [1, 2, 1, 2, 1]


def test_archetype_edges(spark):
    df = spark.createDataFrame([(0, 1, 0.1), (0, 2, None), (0, 4, 0.5), (0, 4, 0.499), (1, 9, 0.1), (2, 2, 0.1), (0, 3, 0.2)],
                               "inpatient_visit_count int, visit_count int, irregularity_score double")
    label, reason = rules.archetype()
    rows = df.select(label.alias("l"), reason.alias("r")).collect()
    assert [r["l"] for r in rows] == [
        "Sparse Use", "Irregular Infrequent", "Irregular Frequent", "Regular Frequent",
        "Sporadic Complex Episodes", "Multiple Complex Episodes", "Regular Infrequent"]
    assert rows[3]["r"] == "≥4 visits + regular (score=0.50)" and rows[5]["r"] == "IP visits >= 2 (n=2)"


def test_birth_date_expression_needs_a_year(spark):
    df = spark.createDataFrame([(None, 1, 1)], "y int, m int, d int")
    assert df.select(birth_date("y", "m", "d")).first()[0] is None


def test_rows_of_other_domains_keep_their_days(spark):
    rows = [(1, d("2020-01-01"), domain, 4, None, None, 1, 5) for domain in ("device", None, "drug")]
    rows += [(1, d("2020-01-02"), "device", 4, "A", "V", 1, 5), (2, d("2020-01-03"), None, 4, None, None, 1, 5)]
    e, days = spark.createDataFrame(rows, EVENTS), spine.visit_days(visits(spark, [(5, 1, 9201, "2020-01-02", None)]))
    assert dict(spine.keyed_counts(e, days).dtypes)["tag"] == "tinyint"  # a name would be most of a row
    for lists in (False, True):
        got = [tuple(r) for r in spine.daily(e, days, lists=lists).orderBy("person_id", "date").select(
            "person_id", F.dayofmonth("date"), "visit_count", "hospitalized_flag", "drug_count", "total_data_points").collect()]
        assert got == [(1, 1, 0, 0, 1, 1), (1, 2, 1, 1, 0, 0), (2, 3, 0, 0, 0, 0)]


def test_codes_are_cleaned_of_all_dots(spark):
    df = spark.createDataFrame([("v56.1.x",), ("..",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(comorbidity.clean_code(F.col("c"))).collect()] == ["V561X", "", "", None]
