"""Run registered queries against their SQL oracles and report differences.

usage: python tools/check_oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else f"{v + 0.0:.6f}".replace("-0.000000", "0.000000"))
        else:
            df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NaT or v is pd.NA else str(v).removesuffix(" 00:00:00"))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark_df, duck_rel) -> str:
    left_table, right_table = spark_df.toArrow(), duck_rel.to_arrow_table()
    left = normal(left_table.to_pandas(integer_object_nulls=True))
    right = normal(right_table.to_pandas(integer_object_nulls=True))
    if list(left.columns) != list(right.columns):
        return f"columns differ: {set(left.columns) ^ set(right.columns)}"
    if len(left) != len(right):
        return f"row counts differ: {len(left)} vs {len(right)}"
    notes = []
    for c in left.columns:
        a, b = str(left_table.schema.field(c).type), str(right_table.schema.field(c).type)
        if a != b:
            notes.append(f"type {c}: {a} vs {b}")
        diff = left[c] != right[c]
        if diff.any():
            i = diff.idxmax()
            notes.append(f"{c}: {int(diff.sum())} differ, e.g. {left[c][i]} vs {right[c][i]}")
    return "; ".join(notes[:6]) or f"ok {len(left)} rows"


def main() -> int:
    from spanweave.plans.all_queries import ORACLES, QUERIES

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in args if not a.startswith("/")]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in ORACLES:
                text = compare(df, con.sql(ORACLES[name]))
            else:
                text = f"ok (rows only) {df.toArrow().num_rows} rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            text = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += not text.startswith("ok")
        print(f"{name:28s} {time.time() - start:6.2f}s  {text}", flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
