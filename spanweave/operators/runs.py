"""Run-length lists that merge: sorted arrays of (value, n).

A list of a day, a month or a year is an array of its distinct values with their
numbers, so its length is bounded by the vocabulary, not by the rows. Lists are merged by
laying their runs side by side and adding the numbers of equal values; values are never
repeated in between, and the rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DOMAINS

#: Published list column -> (tag of its rows, type of its values).
LISTS = {
    "visit_occurrence_ids": ("visit", "bigint"),
    "condition_concept_ids": ("condition", "int"),
    "condition_source_codes": ("code", "string"),
    "condition_vocab_ids": ("vocab", "string"),
    **{f"{d}_concept_ids": (d, "int") for d in DOMAINS if d != "condition"},
}


#: Tags of conditions whose values are in a column of their own.
_TEXTS = ("code", "vocab")


def collect(n: Column, tag: Column, out: str = "_entries") -> Column:
    """Aggregate of rows (key, code, vocab) with their tags and n to the one column that :func:`pack` takes apart."""
    return F.collect_list(F.when(
        F.col("key").isNotNull() | F.col("code").isNotNull() | F.col("vocab").isNotNull(),
        F.struct(tag.alias("tag"), "key", *_TEXTS, n.cast("bigint").alias("n")))).alias(out)


def pack(counted: DataFrame, entries: str = "_entries") -> DataFrame:
    """The collected rows of a day as list columns."""
    def of(name: str) -> Column:
        tag, kind = LISTS[name]
        field, tag = (tag, "condition") if tag in _TEXTS else ("key", tag)
        mine = F.filter(entries, lambda e: (e["tag"] == tag) & e[field].isNotNull())
        return F.sort_array(F.transform(mine, lambda e: F.struct(e[field].cast(kind).alias("value"), e["n"].alias("n"))))

    kept = [c for c in counted.columns if c != entries]
    gathered = counted.select(*kept, *[of(name).alias(name) for name in LISTS])
    return gathered.select(*kept, *[merge(name).alias(name) for name in LISTS])


def gather(name: str) -> Column:
    """Aggregate: all runs of a list column in order of their values, equal values side by side."""
    return F.sort_array(F.flatten(F.collect_list(name)))


def distinct(name: str) -> Column:
    """Number of distinct values of a gathered list."""
    return F.size(F.array_distinct(F.col(name)["value"])).cast("bigint")


def merge(name: str) -> Column:
    """A gathered list with the numbers of equal values added up. Each step is one pass over
    the list: first and last place of each value, then the sum between them."""
    runs = F.col(name)
    places = F.transform(runs, lambda r, i: i)

    def differs(i: Column, j: Column) -> Column:
        return ~F.get(runs, i)["value"].eqNullSafe(F.get(runs, j)["value"])

    first = F.filter(places, lambda i: (i == 0) | differs(i, i - 1))
    last = F.filter(places, lambda i: (i == F.size(runs) - 1) | differs(i, i + 1))
    merged = F.zip_with(first, last, lambda a, b: F.struct(
        F.get(runs, a)["value"].alias("value"),
        F.aggregate(F.slice(runs, a + 1, b - a + 1), F.lit(0).cast("bigint"), lambda n, r: n + r["n"]).alias("n")))
    return F.when(distinct(name) == F.size(runs), runs).otherwise(merged)


def expand(entries: Column) -> Column:
    """The plain array, each value as often as its run says."""
    return F.flatten(F.transform(entries, lambda r: F.array_repeat(r["value"], r["n"].cast("int"))))


def as_text(name: str) -> Column:
    """``value x n`` pairs separated by commas, for export and comparison."""
    return F.array_join(F.transform(name, lambda r: F.concat(r["value"].cast("string"), F.lit("x"), r["n"].cast("string"))), ",")
