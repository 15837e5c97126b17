"""Exact deduplication by a 128-bit content hash, with a byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle


def exact_groups(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5, keep: str = "min") -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as an empty one. Of equal
    texts the row with the smallest doc_id stays, or the largest one with ``keep="max"``.
    A row without a doc_id stays only where its whole group has none (kept is then true
    for each of them, as nothing tells them apart); rows that repeat the kept doc_id with
    the same text are all kept. An empty table gives an empty result; other columns are
    ignored.

    Rows are grouped by (hash, text): equal texts of one task collapse before anything is
    shuffled, and the grouping itself compares bytes, so texts whose hashes collide stay
    apart. Only hashes that stand for more than one row go back to the rows, by hash alone
    where one text has the hash, by hash and text where several have it.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", content_hash("text"))
    texts = rows.groupBy("hash", "text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    hashes = texts.groupBy("hash").agg(
        F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    repeated = settle(hashes.where("group_size > 1"), "repeated-hashes")
    clashing = repeated.where("texts > 1").select("hash")

    plain = rows.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256"))
    one_text = repeated.select("hash", "keep_id", "group_size", "texts")
    simple = plain.join(one_text, "hash", "left").where("texts IS NULL OR texts = 1").select(
        "doc_id", F.when(F.col("texts").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    out = simple
    if not clashing.isEmpty():
        apart = settle(rows.join(clashing, "hash", "left_semi"), "clashing-rows")
        heads = settle(apart.groupBy("hash", "text").agg(
            pick("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "clashing-texts")
        out = out.unionByName(apart.join(heads, ["hash", "text"]).select(
            "doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
