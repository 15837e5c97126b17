"""The operators on small tables: null, empty, tied, repeated and missing rows."""

import importlib.util
import os
import re
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import bpe, exact, graph, jaccard, language, mixing, near_vectors, quality, scratch, simple8b, toxicity, url_rules
from spanweave.llm.queries import BYTE_RANKS, ORACLES, QUERIES, URL_RULES, WORD_FILE

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from check_oracle import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, copy string, score string"
PROSE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    """Null and empty texts, copies, a repeated row, a near copy, a long text; clashing columns."""
    rows = [(1, None), (2, ""), (3, "  \n"), (4, PROSE), (5, PROSE), (5, PROSE), (6, PROSE + " more"), (7, "short one"),
            (8, "other text " * 30_000), (None, "no id")]
    return spark.createDataFrame([(i, t, None if i in (1, 7) else "en", "s" if i != 4 else None, 0, "x", "y", "z") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck.sql(ORACLES[name])).startswith("ok")


def test_exact_groups(docs, none):
    rows = {(r["doc_id"], r["text_sha256"]): r for r in exact.exact_groups(docs, keep="max").collect()}
    by_id = {k[0]: r for k, r in rows.items()}
    assert (by_id[1]["keep_id"], by_id[1]["group_size"], by_id[1]["kept"]) == (2, 2, False)
    assert (by_id[4]["keep_id"], by_id[4]["group_size"]) == (5, 3) and by_id[5]["kept"]
    assert by_id[None]["keep_id"] is None and by_id[None]["kept"]
    assert exact.exact_groups(docs).count() == docs.count() and exact.exact_groups(none).count() == 0


def test_exact_groups_with_colliding_hashes(docs):
    plain = exact.exact_groups(docs).orderBy("doc_id", "text_sha256").collect()
    clashing = exact.exact_groups(docs, content_hash=lambda t: F.lit("same")).orderBy("doc_id", "text_sha256").collect()
    assert plain == clashing


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in sets}


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_groups_against_brute_force(spark, words, percent):
    draw = np.random.default_rng(words)
    base = [f"w{i}" for i in draw.integers(0, 500, 120)]
    rows = []
    for i in range(160):  # copies of one text with unrelated changes, around the threshold
        text = list(base)
        for at in draw.integers(0, 120, int(draw.integers(0, 9))):
            text[at] = f"x{draw.integers(0, 10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, " ".join(f"w{j}" for j in draw.integers(0, 30, int(draw.integers(0, 12))))) for i in range(60)]
    rows += [(300, None), (301, "")]
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words, percent).collect()
    sets = {i: shingles(t, words) for i, t in rows}
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(sets, percent)


def test_jaccard_groups_of_odd_rows(docs, none):
    rows = [(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_groups(docs, 3, 90).collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 4), (7, 7), (8, 8), (None, None)], key=str)
    assert jaccard.jaccard_groups(none).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 90)] + [(200, i) for i in range(201, 240)] + [(300, 300), (None, 1), (301, 302), (302, 301)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 1 for i in range(1, 91)} | {i: 200 for i in range(200, 240)} | {301: 301, 302: 301}


def test_near_vectors(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(120, 8))
    x[60:90] = x[:30] + 0.02 * draw.normal(size=(30, 8))
    x[100] = 3 * x[5]
    x[101:106] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [float("inf")] + [1.0] * 7), (204, [None] + [1.0] * 7),
             (205, []), (206, [1.0, 2.0]), (207, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r for r in near_vectors.near_vectors(df, shard=40).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    parent = brute_components({i: set(np.flatnonzero(near[i])) | {i} for i in range(120)}, 100)  # same neighbours: same group here
    assert [found[i]["n_links"] for i in range(120)] == (near.sum(1) - 1).tolist()
    assert all(found[i]["component_id"] <= parent[i] for i in range(120))
    assert all((found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True) for i in range(200, 206))
    assert found[207]["component_id"] == 206 and not found[207]["kept"]
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_with_repeated_ids(spark):
    draw = np.random.default_rng(12)
    x = draw.normal(size=(60, 16))
    rows = [(i + 10, v.tolist()) for i, v in enumerate(x)]
    # 20 again, far from its first embedding and near that of 40; 30 again, near its first one
    rows += [(20, (x[30] + 0.02 * draw.normal(size=16)).tolist()), (30, (x[20] + 0.02 * draw.normal(size=16)).tolist())]
    rows += [(5, (x[45] + 0.02 * draw.normal(size=16)).tolist()), (55, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df).collect())
    linked = [(20, 0, 20, True), (20, 1, 20, True), (40, 1, 20, False), (30, 1, 30, True), (30, 1, 30, True),
              (5, 1, 5, True), (55, 1, 5, False), (55, 1, 10, False), (10, 1, 10, True)]
    plain = [(i, 0, i, True) for i in range(10, 70) if i not in (10, 20, 30, 40, 55)]
    assert found == sorted(linked + plain)


def test_regions_hold_all_links_that_brute_force_finds(spark, monkeypatch):
    """Evenly spread vectors, crowds over the borders of regions, lengths apart; regions compared whole,
    in parts with a core, and by graphs."""
    draw = np.random.default_rng(14)
    groups = draw.normal(size=(60, 1, 32)) + 0.13 * draw.normal(size=(60, 6, 32))
    crowd = draw.normal(size=32) + 0.11 * draw.normal(size=(500, 32))
    x = np.concatenate([draw.normal(size=(1200, 32)), groups.reshape(-1, 32), crowd])[draw.permutation(2060)]
    y = np.concatenate([x[:40, :9], x[:40, :9] + 0.01])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    other = y / np.linalg.norm(y, axis=1, keepdims=True)
    near = np.zeros((2140, 2140), bool)
    near[:2060, :2060], near[2060:, 2060:] = unit @ unit.T >= 0.95, other @ other.T >= 0.95
    label = np.arange(2140)
    while (new := np.where(near, label, 2140).min(1)).tolist() != label.tolist():
        label = new
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *y])]
    df = spark.createDataFrame([*rows, rows[3]], "vec_id bigint, embedding array<double>")
    links = near.sum(1) - 1 + near[3]  # row 3 is there twice
    called, by_graphs = [], near_vectors._met_by_graphs
    monkeypatch.setattr(near_vectors, "_met_by_graphs", lambda *given: called.append(name) or by_graphs(*given))
    for name, sizes in {"whole": {}, "parts": {"whole": 150}, "graphs": {"whole": 80, "shard": 15}}.items():
        found = {r["vec_id"]: r for r in near_vectors.near_vectors(df, **({"region": 50} | sizes)).collect()}
        count = np.array([found[i]["n_links"] for i in range(2140)])
        assert (count <= links).all() and (count != links).mean() <= (0.01 if name == "graphs" else 0.002), name
        assert np.mean([found[i]["component_id"] != label[i] for i in range(2140)]) <= 0.002, name
    assert called == ["graphs"]


def test_near_vectors_compares_a_small_part_of_all_pairs(spark, monkeypatch):
    """Work grows with the rows, not with their square: each vector reaches few regions."""
    draw = np.random.default_rng(15)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(6000, 64)))], "vec_id bigint, embedding array<float>")
    pairs = []
    settle = near_vectors.settle

    def counted(table, name):
        made = settle(table, name)
        if name == "vector-routes":
            sizes = made.groupBy("region").count().withColumnRenamed("region", "place")
            reach = made.select(F.explode(F.concat("visits", F.array("region"))).alias("place"))
            pairs.append(reach.join(sizes, "place").agg(F.sum("count")).first()[0])
        return made

    monkeypatch.setattr(near_vectors, "settle", counted)
    assert near_vectors.near_vectors(df, region=60).count() == 6000
    assert pairs[-1] < 0.12 * 6000**2


def test_bpe_round_trip(docs, none):
    import public_tokenizers

    made = bpe.decode(bpe.encode(docs, BYTE_RANKS, public_tokenizers.PATTERN), BYTE_RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") and r["score"] == "z" for r in made.collect())
    assert bpe.encode(none, BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_language(spark, docs, none):
    known = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("hund katze", None)] * 3)], "doc_id bigint, text string, lang string")
    profiles = language.learn(known)
    rows = {r["doc_id"]: r for r in language.identify(known, profiles).collect()}
    assert [rows[i]["lang_pred"] for i in range(4)] == ["en", "de", "und", "de"]
    assert language.identify(docs, profiles).count() == docs.count()
    assert language.learn(none).languages == [] and language.identify(none, profiles).count() == 0


def test_poisson_mix(spark, docs, none):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 400 == 1, None).otherwise("b").alias("source"),
                                    F.lit("old").alias("copy"))
    counts = {r["source"]: r["count"] for r in mixing.poisson_mix(many, {"a": 2.0, None: 1.0}).groupBy("source").count().collect()}
    assert set(counts) == {"a", None}  # b has no weight
    assert counts["a"] == pytest.approx(4000 * 2 / 3, rel=0.06) and counts[None] == pytest.approx(4000 / 3, rel=0.1)
    again = mixing.poisson_mix(many.repartition(7), {"a": 2.0, None: 1.0})
    assert {r["source"]: r["count"] for r in again.groupBy("source").count().collect()} == counts
    assert mixing.poisson_mix(none).count() == 0 and set(mixing.poisson_mix(docs).columns) == {*docs.columns, "place"}
    with pytest.raises(ValueError):
        mixing.target_rates(docs, {"s": -1.0})


URLS = [(1, "https://www.example.org/es/1"), (2, "http://EXAMPLE.org/en/19?x=1"), (3, "https://a.org/x"), (4, "http://b.com/de/7"),
        (5, "http://b.com/fr"), (6, None), (7, "no scheme"), (8, "http://b.net/de/9"), (9, "https://other.net"), (9, "https://other.net"),
        (10, "http://notexample.org/es/1"), (11, "x://a.org#/f"), (12, "http://c.com/de/8")]


def test_urls(spark):
    pages = spark.createDataFrame(URLS, "page_id bigint, url string").withColumn("verdict", F.lit("clash"))
    rows = {r["page_id"]: r for r in url_rules.judge_urls(pages, URL_RULES, min_support=0.1).collect()}
    assert {i: rows[i]["rule"] for i in range(1, 12)} == {
        1: "example.org/es/", 2: "example.org/en/1", 3: "org/", 4: "com/de/", 5: None, 6: None, 7: None, 8: None, 9: None, 10: "org/", 11: None}
    assert (rows[2]["host"], rows[2]["path"], rows[6]["host"], rows[11]["host"], rows[11]["path"]) == ("example.org", "/en/19", "", "a.org", "")
    assert rows[8]["verdict"] == "block" and rows[8]["confidence"] == 1.0  # learned from /de/ elsewhere
    assert rows[1]["verdict"] == "block" and rows[3]["verdict"] == "allow" == rows[6]["verdict"]
    assert url_rules.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_mined_rules_against_counting(spark):
    draw = np.random.default_rng(6)
    data = [([t for t in "abcde" if draw.random() < 0.5], "block" if draw.random() < 0.4 else "allow") for _ in range(200)]
    data = [(t, "block" if {"a", "b"} <= set(t) else v) for t, v in data]
    found = {(tuple(r["tokens"]), r["verdict"]): r for r in url_rules.mine(
        spark.createDataFrame(data, "tokens array<string>, verdict string"), 0.05, 0.7).collect()}
    from itertools import combinations

    rules = {}
    for n in range(1, 6):
        for c in combinations("abcde", n):
            hit = [v for t, v in data if set(c) <= set(t)]
            for verdict in ("block", "allow"):
                k = hit.count(verdict)
                if k >= 0.05 * len(data) and k >= 0.7 * len(hit):
                    rules[c, verdict] = k / len(hit)
    kept = {r for r in rules if not any(v == r[1] and set(c) < set(r[0]) and rules[c, v] >= rules[r] for c, v in rules)}
    assert set(found) == kept and all(found[r]["confidence"] == pytest.approx(rules[r]) for r in kept)


def test_a_rule_may_need_many_tokens(spark):
    rows = [(list("abcdef"), "block")] * 10 + [([t for t in "abcdef" if t != gone], "allow") for gone in "abcdef"] * 10
    found = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.9).collect()
    assert [r["tokens"] for r in found if r["verdict"] == "block"] == [list("abcdef")]


def test_verdicts_against_all_rules(spark):
    draw = np.random.default_rng(9)
    words = ["de", "fr", "es", "en", "a1", "b2", "x" * 5000]
    urls = [f"{draw.choice(['http', 'https'])}://{draw.choice(['www', 'm'])}.{draw.choice(['one', 'two', 'three'])}.{draw.choice(['com', 'net', 'org'])}"
            f"/{draw.choice(words)}/{draw.choice(words)}?{draw.choice(['q', 'r'])}=1" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    host, path = url_rules.url_parts(F.col("url"))
    parted = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    tokens = {r["page_id"]: set(r["t"]) for r in parted.select("page_id", url_rules.url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("t")).collect()}
    found = {r["page_id"]: r for r in url_rules.judge_urls(pages, URL_RULES, min_support=0.05, min_confidence=0.6).collect()}
    written = {i: r["verdict"] for i, r in found.items() if r["rule"]}
    for i, r in found.items():
        rule = max((w for w in URL_RULES if ("." + r["host"]).endswith("." + w[0]) and r["path"].startswith(w[1])), key=lambda w: len(w[0] + w[1]), default=None)
        assert (r["rule"], written.get(i)) == ((rule[0] + rule[1], rule[2]) if rule else (None, None))
    labelled = spark.createDataFrame([(sorted(tokens[i]), v) for i, v in written.items()], "tokens array<string>, verdict string")
    rules = [(set(r["tokens"]), r["confidence"], r["support"], r["verdict"] == "block") for r in url_rules.mine(labelled, 0.05, 0.6).collect()]
    assert rules and len(found) == 300
    for i in set(found) - set(written):
        best = max((r[1:] for r in rules if r[0] <= tokens[i]), default=None)
        assert found[i]["verdict"] == ("allow" if best is None else "block" if best[2] else "allow")
        assert found[i]["confidence"] == (best and pytest.approx(best[0]))


def test_quality_and_toxicity_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(4, 2, 0), (7, 0, 1), (8, 1, 0), (99, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")
    model = quality.learn(docs, labels)
    assert model.grades == [0.0, 1.0, 2.0]
    rows = quality.rate(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["expected_grade"] <= 2 and 0 <= r["p_least"] <= 1 and r["score"] == "z" for r in rows)
    assert quality.rate(none, quality.learn(none, labels)).count() == 0
    sample = toxicity.labelled_sample(docs, labels)
    assert sorted(sample.labels) == [0.0, 0.0, 1.0]
    scores = toxicity.score(docs, toxicity.train(sample.texts, sample.labels, rounds=1)).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score(none, toxicity.train([], np.zeros(0))).count() == 0


def test_token_files(spark, docs, none):
    folder = scratch.shared_folder(spark) + "/files-of-test"
    named = docs.where("doc_id IS NOT NULL")

    def tokens(texts):
        return simple8b.word_tokens(WORD_FILE, 2)(texts)

    read = simple8b.read_files(simple8b.write_files(named, folder, tokens), folder)
    rows = read.orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert [r["n_tokens"] for r in rows[:3]] == [1, 1, 1] and bytes(rows[0]["ids"]) == b"\x02\0\0\0"
    assert simple8b.read_files(simple8b.write_files(none, folder, tokens), folder).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    docs = scratch.table(spark, SF, "documents")
    labels = {r["doc_id"]: r["quality"] for r in scratch.table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        past = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = scratch.settle(stage(spark, docs, SF), "test-stage")
        left = [r["doc_id"] for r in docs.collect()]
        assert set(left) <= set(past)
        if name == "quality":
            assert all(i in left for i in past if labels.get(i) == 1) and not any(labels.get(i) == 0 for i in left)
        if name == "exact_dedup":
            first = {}
            for i in sorted(past):
                first.setdefault(past[i], i)
            assert sorted(left) == sorted(first.values())
        if name == "jaccard_dedup":
            groups = brute_components({i: shingles(t, 5) for i, t in past.items()}, 80)
            assert sorted(left) == sorted(set(groups.values()))
        if name == "byte_bpe":
            assert len(left) == docs.count() and docs.where("n_tokens = 0").count() == 0


def test_token_files_are_read_in_as_many_tasks_as_there_are_files(spark, docs):
    folder = scratch.shared_folder(spark) + "/files-of-tasks"
    named = docs.where("doc_id IS NOT NULL")
    parts = [simple8b.write_files(some, folder, lambda texts: [np.zeros(3, "<u4") for _ in texts]) for some in (named, named.limit(2), named.limit(1))]
    read = simple8b.read_files(parts[0].union(parts[1]).union(parts[2]), folder)
    assert read.rdd.getNumPartitions() == 3 and read.count() == named.count() + 3


GIVEN = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, p_least double, expected_grade string, "
         "copy string, place string, ids string, digest string, row string, gone string, again string, given_0 string, kept string")
LONG_RUN = " ".join(f"word{i}" for i in range(80))


def given(*rows):
    return [(i, t, lang, "s", None, "t", 9.5, "e", "c", "p", "i", "d", "r", "g", "a", "0", "k") for i, t, lang in rows]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
class TestStages:
    def run(self, spark, name, *rows):
        import corpus_pipeline

        docs = scratch.settle(spark.createDataFrame(given(*rows), GIVEN), "test-given")
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        assert name == "byte_bpe" or out.columns == docs.columns
        return out.collect()

    def test_copies_are_rows_not_ids(self, spark):
        rows = self.run(spark, "exact_dedup", (0, "a", None), (1, "a", None), (1, "b", None), (None, "c", "y"), (None, "c", "x"), (5, "z", "e"), (5, "z", "e"),
                        (6, None, None), (7, "", None), (None, "a", None), (8, "q", "u"), (8, "r", "u"))
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["lang"] or "") for r in rows) == [
            (-1, "c", "x"), (0, "a", ""), (1, "b", ""), (5, "z", "e"), (6, "", ""), (8, "q", "u"), (8, "r", "u")]
        assert all(r["digest"] == "d" and r["again"] == "a" for r in rows)

    def test_near_copies_are_rows_not_ids(self, spark):
        rows = self.run(spark, "jaccard_dedup", (0, LONG_RUN, None), (1, LONG_RUN + " more", None), (1, "all alone", None), (None, LONG_RUN + " other", None),
                        (None, "no id", "b"), (None, "no id", "a"), (4, None, None), (4, None, None), (5, "", None))
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "", r["lang"] or "") for r in rows) == [
            (-1, "no id", "a"), (0, LONG_RUN, ""), (1, "all alone", ""), (4, "", ""), (4, "", ""), (5, "", "")]
        assert all(r["row"] == "r" and r["kept"] == "k" for r in rows)
        plain = self.run(spark, "jaccard_dedup", (3, LONG_RUN, None), (2, LONG_RUN + " more", None), (4, None, None))
        assert sorted(r["doc_id"] for r in plain) == [2, 4]

    def test_given_columns_of_any_name_pass(self, spark):
        text = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").first()["text"]
        (rated,) = self.run(spark, "quality", (1, text, None))
        assert (rated["p_least"], rated["expected_grade"], rated["given_0"]) == (9.5, "e", "0")
        mixed = self.run(spark, "mixing", *[(i, "x", None) for i in range(30)])
        assert mixed and all((r["copy"], r["place"]) == ("c", "p") for r in mixed)
        (coded,) = self.run(spark, "byte_bpe", (1, "two words", None))
        assert coded["n_tokens"] == 2 and coded["ids"] == "i" and coded["p_least"] == 9.5 and "text" not in coded.asDict()

    @pytest.mark.parametrize("name", ["quality", "exact_dedup", "jaccard_dedup", "mixing", "byte_bpe"])
    def test_nothing_gives_nothing(self, spark, name):
        assert self.run(spark, name) == []
