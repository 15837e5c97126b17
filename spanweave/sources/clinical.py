"""The clinical inputs every operator starts from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import DOMAIN_TABLES


@dataclass(frozen=True)
class Clinical:
    """Person, visits, and the five event domains as one long table.

    ``events`` columns: person_id, date, domain, concept_id, source_code,
    vocab_id, type_concept_id, visit_occurrence_id.
    """

    person: DataFrame
    visits: DataFrame
    events: DataFrame
    concepts: DataFrame
    languages: DataFrame | None = None


def domain_events(domain: str, table: DataFrame) -> DataFrame:
    """Bring one domain table to the long event shape; rows without a date drop out."""
    _, date_col, concept_col = DOMAIN_TABLES[domain]
    condition = domain == "condition"

    def optional(name: str, type_: str):
        return F.col(name) if condition else F.lit(None).cast(type_)

    return table.select(
        F.col("person_id").cast("bigint").alias("person_id"),
        F.to_date(date_col).alias("date"),
        F.lit(domain).alias("domain"),
        F.col(concept_col).cast("int").alias("concept_id"),
        optional("condition_source_value", "string").alias("source_code"),
        optional("condition_source_concept_vocabulary_id", "string").alias("vocab_id"),
        optional("condition_type_concept_id", "int").alias("type_concept_id"),
        F.col("visit_occurrence_id").cast("bigint").alias("visit_occurrence_id"),
    ).filter(F.col("date").isNotNull())


def from_tables(tables: Mapping[str, DataFrame]) -> Clinical:
    """Build the inputs from separate clinical tables keyed by table name."""
    events = reduce(
        DataFrame.unionByName,
        [domain_events(d, tables[t]) for d, (t, _, _) in DOMAIN_TABLES.items()],
    )
    observation = tables["observation"]
    languages = None
    if "value_as_string" in observation.columns:
        languages = observation.select(
            "person_id",
            F.col("observation_concept_id").alias("language_concept_id"),
            "value_as_string",
        )
    return Clinical(
        tables["person"], tables["visit_occurrence"], events, tables["concept"], languages
    )


def from_catalog(spark: SparkSession, database: str, vocab: str = "vocab") -> Clinical:
    """Catalog scan; unused columns are pruned by the optimizer."""
    names = [t for t, _, _ in DOMAIN_TABLES.values()] + ["person", "visit_occurrence"]
    tables = {n: spark.table(f"{database}.{n}") for n in names}
    tables["concept"] = spark.table(f"{vocab}.concept")
    return from_tables(tables)
