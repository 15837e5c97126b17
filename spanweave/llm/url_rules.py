"""URL filtering by association rules that Spark's FP-growth mines from labelled urls."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

#: What stands for the label among the tokens of a url; no token begins so.
_LABEL = "label="


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. Both are empty where the
    url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (host suffix, path prefix, verdict) that fits, else
    nulls. Length counts the written rule; of equally long ones the first in order of text."""
    rule = verdict = F.lit(None).cast("string")
    for suffix, prefix, kind in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(suffix + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: its scheme, host and host suffixes, path segments with
    their place, and names of query parameters. Numbers in a path count as one token."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    names = F.transform(F.slice(labels, 1, 1), lambda x: F.concat(F.lit("first="), x))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    places = F.transform(segments, lambda s, i: F.concat(
        F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(s, r"[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    parameters = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(
        F.lit("query="), F.regexp_extract(s, r"^[^=]*", 0)))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*", 0))))
    return F.array_distinct(F.concat(scheme, names, suffixes, places, parameters))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules (rule_id, tokens, verdict, confidence, support) from ``labelled`` (tokens, verdict).

    A rule says that urls with all of ``tokens`` have ``verdict`` in at least
    ``min_confidence`` of cases; tokens and verdict occur together in at least
    ``min_support`` of the rows. Rules to which a rule on a part of their tokens gives the
    same verdict with no less confidence are left out: what beats them is carried from
    rules of one token upwards, as every part of a frequent set is frequent itself. No labelled rows
    give no rules.
    """
    spark = labelled.sparkSession
    out = "rule_id bigint, tokens array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return spark.createDataFrame([], out)
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    total = F.lit(float(labelled.count()))
    sets = settle(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "frequent-sets")
    is_label = lambda x: x.startswith(_LABEL)
    found = sets.where(F.exists("items", is_label)).select(
        F.filter("items", lambda x: ~is_label(x)).alias("tokens"),
        F.substring(F.filter("items", is_label)[0], len(_LABEL) + 1, 1000).alias("verdict"), F.col("freq").alias("both"))
    found = found.where(F.size("tokens") > 0)
    rules = found.join(sets.select(F.col("items").alias("tokens"), "freq"), "tokens").select(
        "tokens", "verdict", (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / total).alias("support"))
    # all sets, also those that are no rule: a weak set passes on what its parts have
    rules = settle(rules.withColumn("size", F.size("tokens")), "rules")
    key = F.xxhash64("tokens", "verdict")
    levels = rules.agg(F.max("size")).first()[0] or 0
    past, kept = None, []
    for size in range(1, levels + 1):
        level = rules.where(F.col("size") == size)
        if past is None:
            judged = level.withColumn("beaten_by", F.lit(-1.0))
        else:
            parts = level.select(F.col("tokens").alias("whole"), "verdict", F.explode(_one_fewer(F.col("tokens"))).alias("tokens"))
            best = parts.join(past, ["tokens", "verdict"]).groupBy(F.col("whole").alias("tokens"), "verdict").agg(F.max("best").alias("beaten_by"))
            judged = level.join(best, ["tokens", "verdict"], "left").fillna(-1.0, ["beaten_by"])
        judged = settle(judged, "judged-rules")
        kept.append(judged.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("beaten_by"))))
        past = judged.select("tokens", "verdict", F.greatest("confidence", "beaten_by").alias("best"))
    if not kept:
        return spark.createDataFrame([], out)
    every = reduce(DataFrame.unionByName, kept)
    return settle(every.select(key.alias("rule_id"), "tokens", "verdict", "confidence", "support"), "kept-rules")


def _one_fewer(tokens: Column) -> Column:
    """All arrays that lack one of the tokens."""
    return F.transform(tokens, lambda t: F.array_remove(tokens, t))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict, confidence) of the best rule that fits each of ``urls`` (tokens).

    The inverted index lists a rule under one token only, its rarest among the rules. A url
    meets the rules listed under its tokens, and those whose other tokens it has as well
    fit. The most confident rule decides, then the best supported, then block.
    """
    uses = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    listed = rules.select("*", F.explode("tokens").alias("token")).join(uses, "token")
    index = settle(listed.groupBy("rule_id").agg(
        F.min_by("token", F.struct("uses", "token")).alias("token"), F.first("tokens").alias("needed"),
        F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support")), "rule-index")
    asked = urls.select("tokens", F.explode("tokens").alias("token"))
    hits = asked.join(index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    order = F.struct("confidence", "support", (F.col("verdict") == "block").alias("blocks"))
    return hits.groupBy("tokens").agg(F.max_by("verdict", order).alias("verdict"), F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], min_support: float = 0.002,
               min_confidence: float = 0.8, otherwise: str = "allow") -> DataFrame:
    """For each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, confidence.

    Where a written rule (host, path, ``allow`` or ``block``) fits, it decides; these urls
    are the labelled ones from which association rules are mined. All others get the
    verdict of the best mined rule, or ``otherwise`` if none fits. confidence is that of
    the mined rule, else null. A null or malformed url has an empty host and path. Rows that
    repeat a page_id or url are judged alike; an empty table gives an empty result; other
    columns are ignored.

    Matching sees each combination of tokens once, so a host with a third of all pages is no
    hot key there. Mining reads every labelled page; an item of very many pages is
    counted in all tasks, and its conditional trees are grouped by token, not by page.
    """
    host, path = url_parts(F.col("url"))
    parted = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    rows = settle(parted.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("written"), tokens.alias("tokens")), "urls")
    labelled = rows.where("written IS NOT NULL").select("tokens", F.col("written").alias("verdict"))
    mined = mine(labelled, min_support, min_confidence)
    open_ = rows.where("written IS NULL").select("tokens").distinct()
    found = settle(match(open_, mined), "verdicts")
    out = rows.join(found.withColumnRenamed("verdict", "mined"), "tokens", "left")
    mined_ = F.col("written").isNull()
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("written", "mined", F.lit(otherwise)).alias("verdict"),
                      F.when(mined_, F.col("confidence")).alias("confidence"))
