"""Reading and writing result tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import SCHEMAS

# Names of count-like columns and the suppression threshold.
COUNT_COLUMN_PATTERNS = (
    r"^n$",
    r"^n[_\-\s]",
    r"(^|[_\-\s])count($|[_\-\s])",
    r"n_obs",
    r"sample[_\-\s]?size",
)
SUPPRESSION_THRESHOLD = 10


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV scan with header. Declared columns are taken by their names in the header, in any
    order, and cast; a missing one is an error, others are left out. Values that do not fit
    the declared type become null. Without a schema the types are inferred."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    text = reader.csv(path)
    declared = StructType.fromDDL(schema).fields
    found = {c.strip().lower(): c for c in text.columns}
    missing = [f.name for f in declared if f.name.lower() not in found]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return text.select(*[F.col(f"`{found[f.name.lower()]}`").try_cast(f.dataType).alias(f.name) for f in declared])


def ingest_csv(spark: SparkSession, root: str, names: Iterable[str], database: str) -> list[str]:
    """Load CSV files ``<root>/<name>.csv`` into tables, stripping a ``v_`` prefix."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    written = []
    for name in names:
        table = name.lower().removeprefix("v_")
        df = read_csv(spark, f"{root}/{name}.csv", SCHEMAS.get(table))
        overwrite(df, f"{database}.{table}")
        written.append(table)
    return written


def rename_table(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a misspelt table if it exists."""
    if not spark.catalog.tableExists(old):
        return False
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
    return True


def overwrite(df: DataFrame, table: str, partition_by: str | None = None) -> None:
    clear_leftovers(df.sparkSession, table)
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(table)


def clear_leftovers(spark: SparkSession, table: str) -> None:
    """Delete the files that a broken write has left in the folder of a table that is not there."""
    if spark.catalog.tableExists(table):
        return
    database, name = table.rsplit(".", 1) if "." in table else (spark.catalog.currentDatabase(), table)
    folder = f"{spark.catalog.getDatabase(database).locationUri}/{name.lower()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def interleaved(df: DataFrame, keys: Sequence[str], bits: int = 10) -> Column:
    """The bits of two or more numeric keys, each scaled to its range in ``df``, in turn: rows
    that are near in all keys are near in this one. Nulls count as the smallest value."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(keys) for n, f in (("low", F.min), ("high", F.max))]).first()
    scaled = []
    for i, c in enumerate(keys):
        low, high = ends[f"low{i}"] or 0.0, ends[f"high{i}"] or 0.0
        place = (F.col(c).cast("double") - low) / ((high - low) or 1.0) * ((1 << bits) - 1)
        scaled.append(F.coalesce(place, F.lit(0.0)).cast("bigint"))
    code = F.lit(0).cast("bigint")
    for bit in range(bits):
        for i, place in enumerate(scaled):
            code = code + F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1)), len(keys) * bit + len(keys) - 1 - i)
    return code


def overwrite_clustered(df: DataFrame, table: str, keys: Sequence[str] = ("person_id",)) -> None:
    """Range-partition and sort by a key, or by the interleaved bits of several, so that file
    statistics let a filter on any of them skip files. The rows are read twice with several keys."""
    if len(keys) == 1:
        overwrite(df.repartitionByRange(*keys).sortWithinPartitions(*keys), table)
        return
    coded = df.withColumn("_code", interleaved(df, keys))
    overwrite(coded.repartitionByRange("_code").sortWithinPartitions("_code", *keys).drop("_code"), table)


def overwrite_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """Hash buckets of the keys, one file each: tables with the same buckets join without
    moving rows."""
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def append(df: DataFrame, path: str) -> None:
    """Append; columns may be added over time (see :func:`read_evolving`)."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def replace_by_key(df: DataFrame, path: str, key: str = "method") -> None:
    """Replace the rows of the keys present in ``df``; other keys stay."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def replace_partitions(df: DataFrame, table: str, key: str) -> None:
    """Replace a table's partitions for the keys in ``df``; create the table if absent."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        overwrite(df, table, key)
        return
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")  # insertInto takes the mode from the session only
    try:
        df.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(setting, before)


def tables_exist(spark: SparkSession, names: Iterable[str]) -> bool:
    return all(spark.catalog.tableExists(n) for n in names)


def clear_downstream(spark: SparkSession, database: str, keep: Iterable[str],
                     enabled: bool = False) -> list[str]:
    """Drop every table outside the keep-list; does nothing unless enabled."""
    if not enabled:
        return []
    kept = {k.lower() for k in keep}
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    doomed = sorted(n for n in names if n.lower() not in kept)
    for name in doomed:
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
    return doomed


def plain_names(df: DataFrame) -> DataFrame:
    """Column names that every table format and CSV reader takes: words joined by underscores."""
    return df.toDF(*[re.sub(r"[^0-9A-Za-z]+", "_", c).strip("_") for c in df.columns])


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats without them."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def export_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """Write a result table as CSV with header; only small tables as one file."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def is_count_column(name: str) -> bool:
    return any(re.search(p, name, re.IGNORECASE) for p in COUNT_COLUMN_PATTERNS)


def suppress_small_cells(df: DataFrame, threshold: int = SUPPRESSION_THRESHOLD) -> DataFrame:
    """Replace counts from 1 to threshold-1 by ``<threshold`` in count-like columns."""
    cols = {}
    for name in df.columns:
        if is_count_column(name):
            text = F.col(name).cast("string")
            number = F.expr(f"try_cast(`{name}` AS double)")
            small = (number > 0) & (number < threshold)
            cols[name] = F.when(small, f"<{threshold}").otherwise(text)
    return df.withColumns(cols) if cols else df


def label_rows(df: DataFrame, model_id: str, cluster: str, run_timestamp: str,
               confidence: str | None = None, entropy: str | None = None,
               outlier: str | None = None, label: str | None = None) -> DataFrame:
    """Cluster labels of any method in the common export schema."""
    rules = model_id.startswith("rules")

    def optional(name: str | None, type_: str):
        if name and name in df.columns:
            return F.col(name).cast(type_)
        return F.lit(None).cast(type_)

    number = F.lit(None).cast("int") if rules else F.col(cluster).cast("int")
    if rules:
        text = F.col(cluster)
    elif label and label in df.columns:
        text = F.col(label)
    else:
        text = F.when(F.col(cluster) == -1, "Outlier").otherwise(
            F.concat(F.lit("Cluster "), F.col(cluster).cast("string"))
        )
    if outlier and outlier in df.columns:
        flag = F.col(outlier).cast("int")
    else:
        flag = F.lit(0) if rules else F.when(F.col(cluster) == -1, 1).otherwise(0)
    return df.select(
        "person_id",
        "year",
        F.lit(model_id).alias("model_id"),
        number.alias("cluster"),
        text.alias("cluster_label"),
        optional(confidence, "double").alias("confidence"),
        optional(entropy, "double").alias("entropy"),
        flag.alias("is_outlier"),
        F.lit(run_timestamp).alias("run_timestamp"),
    )
