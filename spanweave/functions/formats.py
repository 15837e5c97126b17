"""Publication text formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _null() -> Column:
    return F.lit(None).cast("string")


def significance(p: Column) -> Column:
    """Stars: *** < 0.001, ** < 0.01, * < 0.05, otherwise ns."""
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    )


def p_band(p: Column) -> Column:
    """Banded p-value: <0.001, <0.01, <0.05, else two decimals."""
    return (
        F.when(p.isNull(), _null())
        .when(p < 0.001, "<0.001")
        .when(p < 0.01, "<0.01")
        .when(p < 0.05, "<0.05")
        .otherwise(F.format_string("%.2f", p))
    )


def p_text(p: Column) -> Column:
    """Scientific below 0.001, four decimals otherwise, dash when undefined."""
    return (
        F.when(p.isNull() | F.isnan(p), "—")
        .when(p < 0.001, F.format_string("%.3e", p))
        .otherwise(F.format_string("%.4f", p))
    )


def rho_wording(rho: Column) -> Column:
    size = F.abs(rho)
    side = F.when(rho > 0, "positive").otherwise("negative")
    return (
        F.when(size < 0.1, "negligible")
        .when(size < 0.3, F.concat(F.lit("weak "), side))
        .when(size < 0.5, F.concat(F.lit("moderate "), side))
        .otherwise(F.concat(F.lit("strong "), side))
    )


def signed(value: Column, decimals: int = 1) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%+.{decimals}f", value))


def p_stars(p: Column, stars: bool = True) -> Column:
    """``%.2e`` text with stars appended; null stays null."""
    text = F.format_string("%.2e", p)
    if stars:
        text = F.concat(text, F.when(p < 0.05, significance(p)).otherwise(""))
    return F.when(p.isNotNull(), text)


def diff_cell(diff: Column, p: Column, decimals: int = 1, stars: bool = True) -> Column:
    """``+12.3 (p=1.20e-04***)``; null when either part is missing."""
    return F.concat(signed(diff, decimals), F.lit(" (p="), p_stars(p, stars), F.lit(")"))


def with_formatted_diff(df: DataFrame, diff: str = "diff_mean", out: str = "diff_fmt",
                        decimals: int = 1) -> DataFrame:
    return df.withColumn(out, signed(F.col(diff), decimals))


def with_formatted_p(df: DataFrame, p: str, out: str = "p_fmt", stars: bool = True) -> DataFrame:
    return df.withColumn(out, p_stars(F.col(p), stars))


def with_diff_cell(df: DataFrame, diff: str, p: str, out: str = "cell",
                   decimals: int = 1, stars: bool = True) -> DataFrame:
    return df.withColumn(out, diff_cell(F.col(diff), F.col(p), decimals, stars))
