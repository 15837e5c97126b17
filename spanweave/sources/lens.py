"""View the star-schema test tables (customer, orders, lineitem) as clinical data.

The expressions are a fixed mapping, mirrored by the SQL oracle. Every value
derives from the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.local import small_table
from .clinical import Clinical

# Fixed values of the mapping.
GENDERS = (8507, 8532, 0)
RACES = (8515, 8516, 8527, 8557, 8657, 0)
ETHNICITIES = (38003563, 38003564, 0, 999)
CONCEPT_NAMES = {
    8507: "MALE",
    8532: "FEMALE",
    8515: "Asian",
    8516: "Black or African American",
    8527: "White",
    8557: "Native Hawaiian or Other Pacific Islander",
    8657: "American Indian or Alaska Native",
    38003563: "Hispanic or Latino",
    38003564: "Not Hispanic or Latino",
    999: "Refused",
}
SOURCE_CODES = (
    "410.9", "428.0", "I50.9", "404.03", "404.13", "443.9", "362.34", "437.3",
    "434.1", "290.1", "490", "344.1", "714.0", "531.0", "070.22", "250.0",
    "250.4", "E11.9", "342.0", "585", "V56.0", "C50.1", "197.0", "457.3", None,
)
V_CODE_VOCABS = ("ICD9CM", "ICD10CM", None)
DOMAIN_OF_LINE = ("observation", "condition", "drug", "measurement", "procedure")


def _pick(values: tuple, index: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[index.cast("int")]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _person(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.alias("person_id"),
        (1930 + key % 60).cast("int").alias("year_of_birth"),
        F.when(key % 10 != 0, 1 + key % 12).cast("int").alias("month_of_birth"),
        F.when(key % 7 != 0, 1 + key % 28).cast("int").alias("day_of_birth"),
        _pick(GENDERS, key % 3).alias("gender_concept_id"),
        _pick(RACES, F.col("c_nationkey") % 6).alias("race_concept_id"),
        _pick(ETHNICITIES, key % 4).alias("ethnicity_concept_id"),
        F.when(key % 3 == 0, "cohort_2a").otherwise("cohort_1").alias("cohort"),
    )


def _visits(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    priority = F.col("o_orderpriority")
    concept = (
        F.when((priority == "1-URGENT") & (key % 2 == 0), 9201)
        .when((priority == "2-HIGH") & (F.col("o_orderstatus") == "P"), 262)
        .when(priority == "2-HIGH", 9203)
        .when(priority == "5-LOW", 581477)
        .otherwise(9202)
    )
    return orders.select(
        key.alias("visit_occurrence_id"),
        F.col("o_custkey").alias("person_id"),
        concept.alias("visit_concept_id"),
        start.alias("visit_start_date"),
        F.when(key % 29 == 0, F.lit(None).cast("date"))
        .when(key % 31 == 0, F.date_sub(start, 2))
        .when(concept.isin(9201, 262), F.date_add(start, (key % 8).cast("int")))
        .otherwise(start)
        .alias("visit_end_date"),
    )


def _event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", "l_returnflag"
    )
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _events(base: DataFrame) -> DataFrame:
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    code = _pick(SOURCE_CODES, part % 25)
    vocab = (
        F.when(code.startswith("V"), _pick(V_CODE_VOCABS, part % 3))
        .when(code.rlike("^[A-Z]"), "ICD10CM")
        .when(code.isNotNull(), "ICD9CM")
    )
    condition = line % 5 == 1
    return base.select(
        F.col("o_custkey").alias("person_id"),
        F.date_add(F.to_date("o_orderdate"), line % 4).alias("date"),
        _pick(DOMAIN_OF_LINE, line % 5).alias("domain"),
        (part % 97).cast("int").alias("concept_id"),
        F.when(condition, code).alias("source_code"),
        F.when(condition, vocab).alias("vocab_id"),
        F.when(condition, F.when(F.col("l_linestatus") == "F", 32840).otherwise(32020)).alias(
            "type_concept_id"
        ),
        F.when(line != 7, F.col("l_orderkey")).alias("visit_occurrence_id"),
    )


def _languages(base: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    return base.filter((F.col("l_linenumber") % 5 == 0) & (F.col("l_partkey") % 11 == 0)).select(
        F.col("o_custkey").alias("person_id"),
        F.lit(4182947).alias("language_concept_id"),
        F.when(flag == "A", "English").when(flag == "R", "Spanish").alias("value_as_string"),
    )


def load(spark: SparkSession, sf_dir: str) -> Clinical:
    base = _event_base(spark, sf_dir)
    concepts = small_table(
        spark, list(CONCEPT_NAMES.items()), "concept_id int, concept_name string"
    )
    return Clinical(
        person=_person(read_table(spark, sf_dir, "customer")),
        visits=_visits(read_table(spark, sf_dir, "orders")),
        events=_events(base),
        concepts=concepts,
        languages=_languages(base),
    )
