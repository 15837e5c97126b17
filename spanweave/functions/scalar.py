"""Column helpers shared by the operators (dates, text, maps, ordering)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def birth_date(year: str, month: str, day: str) -> Column:
    """Partial birth date: missing day -> 1st of month, missing month -> 1 July.

    An impossible date gives null instead of an ANSI error.
    """
    known_month = F.col(month).isNotNull()
    text = F.format_string(
        "%04d-%02d-%02d",
        F.col(year),
        F.when(known_month, F.col(month)).otherwise(7),
        F.when(known_month, F.coalesce(F.col(day), F.lit(1))).otherwise(1),
    )
    return F.when(F.col(year).isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def age_on(date: Column | str, birth: Column | str) -> Column:
    return F.floor(F.months_between(date, birth) / 12)


def period_label(date: str, unit: str) -> Column:
    """Period key of a date: Monday of the week, ``yyyy-MM``, or the year."""
    if unit == "week":
        return F.date_format(F.date_trunc("week", date), "yyyy-MM-dd")
    if unit == "month":
        return F.date_format(F.col(date), "yyyy-MM")
    if unit == "year":
        return F.year(date)
    raise ValueError(f"unknown period unit {unit!r}")


def year_fraction(ts: Column) -> Column:
    """Calendar year plus the elapsed share of that year."""
    start = F.date_trunc("year", ts)
    next_start = F.add_months(start.cast("date"), 12).cast("timestamp")
    span = F.unix_timestamp(next_start) - F.unix_timestamp(start)
    return F.year(ts) + (F.unix_timestamp(ts) - F.unix_timestamp(start)) / span


def literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def cluster_name(col: str, labels: Mapping[int, str]) -> Column:
    """Literal label lookup with the ``Cluster <id>`` / ``Outlier`` fallback."""
    c = F.col(col)
    known = F.element_at(literal_map(labels), c) if labels else F.lit(None).cast("string")
    return F.coalesce(
        known,
        F.when(c == -1, F.lit("Outlier")),
        F.concat(F.lit("Cluster "), c.cast("string")),
    )


def position_in(col: str, order: Iterable) -> Column:
    """1-based rank of a value in an explicit list; unlisted values go last."""
    items = list(order)
    pos = F.array_position(F.array(*[F.lit(x) for x in items]), F.col(col))
    return F.when(pos > 0, pos).otherwise(F.lit(len(items) + 1))


def order_by_list(df: DataFrame, col: str, order: Iterable) -> DataFrame:
    return df.orderBy(position_in(col, order), F.col(col))


def fill_zero(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.fillna({c: 0 for c in cols})


def finite_or_zero(col: Column) -> Column:
    """Null, NaN and infinities become 0."""
    bad = col.isNull() | F.isnan(col) | col.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(col)


def split_tokens(col: Column, delimiter: str = r"\|") -> Column:
    """Non-empty trimmed tokens of a delimited text column."""
    parts = F.split(F.coalesce(col, F.lit("")), r"\s*" + delimiter + r"\s*")
    return F.filter(F.transform(parts, F.trim), lambda t: t != "")


def year_order_key(person: str = "person_id", year: str = "year", seed: int = 42) -> Column:
    """Seeded pseudo-random order of a person's years.

    Plain modular arithmetic, so the draw does not depend on partitioning.
    """
    p = F.pmod(F.col(person).cast("bigint"), F.lit(1_000_003).cast("bigint"))
    y = F.col(year).cast("bigint")
    mixed = p * 7_919 + y * 104_729 + F.lit(seed).cast("bigint") * 15_485_863
    step = F.pmod(mixed, F.lit(1_299_709).cast("bigint"))
    return F.pmod(step * step + y * 31, F.lit(1_299_721).cast("bigint"))
