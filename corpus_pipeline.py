"""A training corpus from ``documents``: rated, deduplicated, mixed and tokenised.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. Each stage's result is stored and read again by the next one.

All stages but the last return the columns of ``docs``, whatever names they have. Stages
decide on rows: a null or repeated doc_id does not make one row answer for another. Null and
empty texts pass every stage that does not reject them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import exact, jaccard, mixing, quality
from spanweave.llm.queries import set_aside, tokens_and_back
from spanweave.llm.scratch import discard, settle, table


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose probability of the highest grade is quality.CUT or more. The
    model is fitted on rated documents of the whole table, not on what reaches the stage."""
    model = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    aside, back = set_aside(docs, "text")
    return back(quality.rate(aside, model).where(F.col("p_least") >= quality.CUT))


def _digest() -> F.Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One of the rows with equal ``keys``: the first in the order of their JSON."""
    others = [c for c in rows.columns if c not in keys]
    row = F.struct(*others)
    return rows.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("first_of_them")).select(*keys, "first_of_them.*").select(*rows.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (null: empty) keep one: that of the smallest doc_id, any
    doc_id before none; of those that repeat it the first in the order of their JSON."""
    aside, back = set_aside(docs, "doc_id", "text")
    keys = ["doc_id", "digest"]
    groups = exact.exact_groups(aside.select("doc_id", "text")).withColumnRenamed("text_sha256", "digest")
    groups = settle(groups.where("group_size > 1").groupBy(*keys, "kept").agg(F.count("*").alias("rows")), "copies")
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone"))
    again = groups.where("kept AND rows > 1").select(F.col("doc_id").alias("again_id"), F.col("digest").alias("again"))
    rows = aside.withColumn("digest", _digest())
    left = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone")), "left_anti")
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again"))
        left = settle(left, "left-rows")
        left = left.join(again, same, "left_anti").unionByName(_one_of_each(left.join(again, same, "left_semi"), keys))
    return back(left)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard similarity of 0.8 or more of their five-word shingles keep
    the one of the smallest doc_id, any doc_id before none. Where doc_ids are null or repeat,
    rows are numbered in the order of doc_id and text digest, and compared by these numbers;
    rows equal in both and with words are one."""
    aside, back = set_aside(docs, "doc_id", "text")
    if aside.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        rows = aside.withColumn("row", F.col("doc_id"))
    else:
        keyed = aside.withColumn("digest", _digest())
        numbers = keyed.select("doc_id", "digest").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "digest")
        numbers = settle(numbers.withColumn("row", F.monotonically_increasing_id()), "row-numbers")
        numbers = numbers.select(F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest"), "row")
        rows = keyed.join(numbers, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest")))
        rows = settle(rows.drop("digest", "its_id", "its_digest"), "numbered-rows")
    groups = jaccard.jaccard_groups(rows.select(F.col("row").alias("doc_id"), "text"), words=5, percent=80)
    decided = settle(groups.groupBy(F.col("doc_id").alias("row"), (F.col("component_id") == F.col("doc_id")).alias("stays"))
                     .agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n_shingles")).where("NOT stays OR rows > 1"), "near-copies")
    left = rows.join(decided.where("NOT stays").select("row"), "row", "left_anti")
    again = decided.where("stays AND n_shingles > 0").select("row")
    if not again.isEmpty():
        left = left.join(again, "row", "left_anti").unionByName(_one_of_each(left.join(again, "row", "left_semi"), ["row"]))
    return back(left)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that all sources weigh the same, in random order."""
    aside, back = set_aside(docs, "doc_id", "text", "source")
    return back(mixing.poisson_mix(aside))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` but for text, with n_tokens and digests of the ids and the bytes
    that they decode to (given columns of these names are replaced), for each row, repeated
    ones too."""
    return tokens_and_back(docs)


STAGES = [
    ("quality", rate_quality),
    ("exact_dedup", drop_copies),
    ("jaccard_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The quality model and the near-duplicate components have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        past, docs = docs, settle(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            discard(past)
    return docs
