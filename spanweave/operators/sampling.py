"""One seeded year per person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import year_order_key


def _is_first_year(seed: int) -> Column:
    """Whether a person-year comes first in its person's pseudo-random order.

    Order key and year are packed into one number, whose minimum runs over the person's
    years: rows that are together by person stay where they are, and no row is built or
    compared as a struct.
    """
    packed = F.shiftleft(year_order_key(seed=seed).cast("bigint"), 16).bitwiseOR(F.col("year").cast("bigint"))
    return packed == F.min(packed).over(Window.partitionBy("person_id"))


def one_year_per_person(features: DataFrame, seed: int = 42) -> DataFrame:
    """A pseudo-random row per person of a table with one row per person and year."""
    return features.withColumn("_first", _is_first_year(seed)).where("_first").drop("_first")


def with_training_flag(features: DataFrame, seed: int = 42) -> DataFrame:
    """Add ``training_data`` = 1 on each person's sampled year, else 0."""
    return features.withColumn("training_data", F.when(_is_first_year(seed), 1).otherwise(0))
