"""Fixed-size driver-side tables (lookups, model parameters) as DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """An in-plan local relation, so the optimizer knows its exact size."""
    struct = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrow = pa.table(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, to_arrow_schema(struct))],
        schema=to_arrow_schema(struct),
    )
    return spark.createDataFrame(arrow)
