"""Stages of a run, stored as tables and reused only while what made them is the same.

A stage's fingerprint is a digest of its name, its parameters, the fingerprints of the stages
it reads and of the files behind its inputs. It is written to the table's properties after
the data. A table that a broken write has left, or that other parameters, other inputs or
another earlier stage have made, bears no fingerprint or another one, and is built again, as
is everything that follows from it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

PROPERTY = "stage.fingerprint"


def files_fingerprint(df: DataFrame) -> str:
    """A digest of the files that ``df`` reads: names, sizes and times of change. Listing and
    hashing are a Spark job over the folders; contents are not read. A frame without
    files, such as one made from local rows, is hashed by its rows."""
    schema = df.schema.simpleString()
    files = df.inputFiles()
    if files:
        folders = sorted({f.rsplit("/", 1)[0] for f in files})
        listed = df.sparkSession.read.format("binaryFile").load(folders)
        one = F.xxhash64("path", "length", "modificationTime")
    else:
        listed = df.select(F.to_json(F.struct(*df.columns)).alias("row")) if df.columns else df.select(F.lit("").alias("row"))
        one = F.xxhash64("row")
    row = listed.agg(F.count(F.lit(1)), F.bit_xor(one), F.sum(one.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{schema}|{tuple(map(str, row))}".encode()).hexdigest()


class Stages:
    """The stages of one run over database ``db``. ``recompute`` builds all of them again."""

    def __init__(self, spark: SparkSession, db: str, recompute: bool = False):
        self.spark, self.db, self.recompute = spark, db, recompute
        self.prints: dict[str, str] = {}
        self.built: list[str] = []
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")

    @property
    def names(self) -> list[str]:
        return list(self.prints)

    def source(self, name: str, *frames: DataFrame) -> str:
        """Take inputs from outside the run into account under ``name``."""
        digests = [files_fingerprint(df) for df in frames]
        self.prints[f"<{name}>"] = hashlib.sha256("|".join(digests).encode()).hexdigest()
        return f"<{name}>"

    def fingerprint(self, name: str, parameters: Mapping, reads: Iterable[str]) -> str:
        what = {"stage": name, "parameters": {k: repr(v) for k, v in parameters.items()}, "reads": {r: self.prints[r] for r in reads}}
        return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()

    def _stored(self, table: str, key: str) -> str | None:
        if not self.spark.catalog.tableExists(table):
            return None
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == key).collect()
        return rows[0]["value"] if rows else None

    def _mark(self, table: str, key: str, value: str) -> None:
        self.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{key}' = '{value}')")

    def stage(self, name: str, build: Callable[[], DataFrame], parameters: Mapping | None = None,
              reads: Iterable[str] = (), write: Callable[[DataFrame, str], None] = sinks.overwrite) -> DataFrame:
        """The table of a stage; ``build`` runs only if its fingerprint is not there."""
        table = f"{self.db}.{name}"
        wanted = self.fingerprint(name, parameters or {}, reads)
        if self.recompute or self._stored(table, PROPERTY) != wanted:
            write(build(), table)  # replaces the table, and with it an old fingerprint
            self._mark(table, PROPERTY, wanted)
            self.built.append(name)
        self.prints[name] = wanted
        return self.spark.table(table)

    def part(self, name: str, column: str, value: str, build: Callable[[], DataFrame],
             parameters: Mapping | None = None, reads: Iterable[str] = ()) -> DataFrame:
        """The rows of one ``value`` of a table that several stages share, one partition each."""
        table, key = f"{self.db}.{name}", f"{PROPERTY}.{value}"
        wanted = self.fingerprint(f"{name}/{value}", parameters or {}, reads)
        if self.recompute or self._stored(table, key) != wanted:
            if self._stored(table, key) is not None:
                self.spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ('{key}')")
            sinks.replace_partitions(build(), table, column)
            self._mark(table, key, wanted)
            self.built.append(f"{name}/{value}")
        self.prints[f"{name}/{value}"] = wanted
        return self.spark.table(table).where(F.col(column) == value)
