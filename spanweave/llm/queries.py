"""The registered queries of the corpus operators, and SQL for those that SQL can state."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, exact, jaccard, language, mixing, near_vectors, quality, simple8b, spelling, toxicity, url_rules
from .scratch import shared_folder, table

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
LEVEL_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
#: Ids of LEVEL_FILE (without its special token) and PIECE_FILE.
ALIGNED_IDS = (50_256, 32_000)
#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _remainder(parts: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but the ``needed`` ones under other names, which no operator
    uses, and a function that selects the columns of ``docs`` that a result still has, and new ones."""
    names = {c: c if c in needed else f"given_{i}" for i, c in enumerate(docs.columns)}
    aside = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()])

    def back(df: DataFrame, **new: F.Column) -> DataFrame:
        return df.select(*[F.col(name).alias(c) for c, name in names.items() if name in df.columns], *[e.alias(c) for c, e in new.items()])

    return aside, back


def tokens_and_back(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with n_tokens and the sha256 of ids and of decoded bytes;
    given columns of these names are replaced."""
    made = {"n_tokens": (F.octet_length("ids") / 4).cast("bigint"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}
    aside, back = set_aside(docs.drop(*made), "text")
    return back(bpe.encode_and_decode(aside, BYTE_RANKS, public_tokenizers.PATTERN), **made)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_and_back(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn(docs.where(_remainder(4) != 2))
    return language.identify(docs, profiles).withColumn("held_out", _remainder(4) == 2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources weigh the same; the mixture is as large as the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.poisson_mix(docs)
    return mixed.select("doc_id", "source", "copy", "place", F.md5("text").alias("text_md5"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = toxicity.labelled_sample(docs, labels.where(_remainder(3) != 1))
    scored = toxicity.score(docs, toxicity.train(sample.texts, sample.labels))
    return scored.withColumns({"held_out": _remainder(3) == 1, "predicted": (F.col("score") >= 0.7).cast("int")})


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.rate(docs, model).drop("text").withColumn("kept", F.col("p_least") >= quality.CUT)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"

    def tokens(texts: list[str]):
        return simple8b.word_tokens(WORD_FILE, 2)(texts)

    files = simple8b.write_files(table(spark, sf_dir, "documents"), folder, tokens)
    return simple8b.read_files(files, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), letters=6, least=5, damage=199)
    return spelling.spelling_groups(words, factor=5)


def aligned_digests(docs: DataFrame) -> DataFrame:
    """The alignment of ``docs`` (doc_id, text), its groups as a digest (none: empty)."""
    aligned = alignment.align(docs, partial(alignment.byte_level, LEVEL_FILE, public_tokenizers.PATTERN),
                              partial(alignment.piece_model, PIECE_FILE), ALIGNED_IDS)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).when(F.col("n_a") == 0, "")
    return alignment.link_counts(aligned.withColumn("groups_sha256", digest).drop("groups"), ALIGNED_IDS)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    marked = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_chats(chat.format_chats(turns.unionByName(marked)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_vectors, op2_byte_bpe, op3_exact_dedup, op4_language_id, op5_mixing, op6_url_rules,
                            op7_jaccard_join, op8_toxicity, op9_quality, op10_token_files,
                            op11_spelling, op12_token_alignment, op13_chat_format)
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op5_mixing": """
        WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        totals AS (SELECT sum(n)::DOUBLE AS all_rows, count(*)::DOUBLE AS all_weight FROM sizes),
        rates AS (SELECT source, (1.0::DOUBLE / all_weight) * all_rows * 1.0::DOUBLE / n AS rate FROM sizes, totals),
        means AS (SELECT source, greatest(1, ceil(rate / 16.0::DOUBLE))::INT AS parts,
                         rate / greatest(1, ceil(rate / 16.0::DOUBLE))::INT AS mean FROM rates),
        terms AS (SELECT source, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS total FROM means
                  UNION ALL
                  SELECT source, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1)
                  FROM terms WHERE k < 72),
        draws AS (SELECT doc_id, source, text, i,
                         (('0x' || substr(md5('mix:' || doc_id || ':' || i), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
                  FROM (SELECT d.doc_id, d.source, d.text, unnest(range(1, parts + 1)) AS i
                        FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source)),
        copies AS (SELECT doc_id, d.source, any_value(d.text) AS text, count(t.k) AS n
                   FROM draws d LEFT JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.total <= d.u
                   GROUP BY doc_id, d.source),
        each AS (SELECT doc_id, source, text, unnest(range(1, n + 1))::INT AS copy FROM copies WHERE n > 0)
        SELECT doc_id, source, copy, md5('mix place:' || doc_id || ':' || copy) AS place, md5(text) AS text_md5 FROM each""",
    "op11_spelling": r"""
        WITH RECURSIVE steps AS (
            SELECT i, 0 AS k, i AS c FROM range(256) r(i)
            UNION ALL
            SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS codes FROM steps WHERE k = 8),
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
        found AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
        coded AS (
            SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS digits FROM found WHERE length(run) >= 6),
        hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                       range(1, length(digits), 2), lambda i: ('0x' || substr(digits, i, 2))::BIGINT)),
                       lambda c, b: xor(c // 256, codes[xor(c, b) % 256 + 1]))) AS h FROM coded, crc),
        kept AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        cut AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS masked, left(word, i - 1) || substr(word, i + 1) AS shorter FROM places),
        near AS (
            SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.masked = b.masked AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.shorter = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.shorter = b.word),
        firsts AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word),
        judged AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
                   CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN firsts USING (word)),
        chain AS (
            SELECT word, word AS root, form AS next FROM judged
            UNION ALL
            SELECT c.word, j.word, j.form FROM chain c JOIN judged j ON c.next = j.word)
        SELECT word, form, root, n, n_near, form_n FROM judged JOIN chain USING (word) WHERE next IS NULL""",
    "op13_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, length(regexp_replace(text, '([\[<])(\\*)((?:/?(?:SYS|INST|TURN)|ANSWER|/ROLE)\]|/?s>)', '\1\\\2\3', 'g'))
                      + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 13
                        ELSE 22 + length(regexp_replace(role, '([\[<])(\\*)((?:/?(?:SYS|INST|TURN)|ANSWER|/ROLE)\]|/?s>)', '\1\\\2\3', 'g')) END AS chars
            FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
}
