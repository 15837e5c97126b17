"""The numpy parts against brute force."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanweave.llm import bpe, hashing, jaccard, language, near_vectors, quality, simple8b, toxicity
from spanweave.llm.queries import BYTE_RANKS, WORD_FILE


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary(BYTE_RANKS, public_tokenizers.PATTERN)


def test_bpe_equals_the_library(words):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    draw = random.Random(3)
    texts = ["", " ", "a b", "a  b \n c\t", "it's  we'll", "x" * 3000, "ab" * 400, "日本語" * 300, "<|endoftext|> a",
             "".join(draw.choice("abcdefgh") for _ in range(2000)), "".join(chr(draw.randrange(32, 0x3000)) for _ in range(3000)),
             *["".join(draw.choice(["the", " ", ",", "\n", "é", "ing", "9", "\x1c", " "]) for _ in range(draw.randrange(60))) for _ in range(300)]]
    got = words.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [words.decode(g).decode() for g in got] == texts


def test_pair_table_finds_all_pairs_and_no_others(words):
    left = np.array([words.ranks[b"t"], words.ranks[b"t"], 0])
    right = np.array([words.ranks[b"h"], words.ranks[b"\x00"], 0])
    expected = [words.ranks.get(words.tokens[a] + words.tokens[b], 2**31 - 1) for a, b in zip(left.tolist(), right.tolist())]
    assert words.pairs(left, right).tolist() == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=90), max_size=6))
def test_simple8b_round_trip(documents):
    ids = [np.array(d, np.uint64) for d in documents]
    back = list(simple8b.unpack(simple8b.pack(list(range(-2, len(ids) - 2)), ids)))
    assert [d for d, _ in back] == list(range(-2, len(ids) - 2))
    assert [b.tolist() for _, b in back] == [list(d) for d in documents]


@pytest.mark.parametrize("n", [1, 59, 60, 61, 4095, 4096, 4097, 20000, 300000])
def test_simple8b_block_borders(n):
    values = np.random.default_rng(n).integers(0, 50000, n).astype(np.uint64)
    values[n // 2 :: 97] = 2**61
    (_, back), = simple8b.unpack(simple8b.pack([1], [values]))
    assert (back == values).all()
    with pytest.raises(ValueError):
        list(simple8b.unpack(b"something else"))


def test_word_tokens_equal_the_library():
    library = Tokenizer.from_file(WORD_FILE)
    library.encode_special_tokens = True
    texts = ["", "Plain words, and Stops. End.", "it's we'll!, ok", "é́, İSTANBUL ΣΑΣ\x1cx\n\n y", "<|endoftext|> .,. a.b,c 12,5."]
    got = simple8b.WordTokens(WORD_FILE, 2)(texts)
    assert [g.tolist() for g in got] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_word_tokens_of_the_query_equal_the_untouched_library():
    library = Tokenizer.from_file(WORD_FILE)
    draw = random.Random(4)
    bits = ["a page ", "Stop. ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "H\u0331", "h\u0331 ", "E\u0301, ", "\u0338 ", "=", "<",
            "\u212a", "\u037e ", "\n", " ", "'s", "W\u030a.", ". ", ",", "12", "İ", "ΣΑΣ ", "é. ", "日本", "\x1c", "\u00a0", "\u0301", "don't ", "|>"]
    texts = ["a page <|endoftext|> more", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|>y. <|startoftext|>, z", "H\u0331 AH\u0331, Up"]
    texts += ["".join(draw.choice(bits) for _ in range(draw.randrange(12))) for _ in range(3000)]
    got = simple8b.word_tokens(WORD_FILE, 2)(texts)
    assert [g.tolist() for g in got] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert got[0].tolist().count(49407) == 1 and got[1].tolist() == [49406, 49407, 2]


def test_words_with_punctuation_and_latin_letters_cost_no_library_call_of_their_own():
    draw = random.Random(5)
    letters = "aBz" + "".join(map(chr, range(0xC0, 0x100)))
    texts = ["".join(draw.choice(letters) for _ in range(8)) + draw.choice(["", ".", "$$$", ",%%%", "!?", "'s.", "'", ".'t"]) for _ in range(3000)]
    texts += ["é\u0301. ", "t\u0308, T\u0308, ", "a\u0301\u0301.. ", "e.\u0301 ", "ª. µ, º!", "1. 2, x9.", "\u0301.", "..", "ß$ ÿ$ ×. ÷.", "“a.” “.", " \n \n", "a\n.b"]
    library = Tokenizer.from_file(WORD_FILE)
    library.encode_special_tokens = True
    own = simple8b.WordTokens(WORD_FILE, 2)
    assert [g.tolist() for g in own(texts)] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]

    class Counted:
        calls = 0

        def encode_batch_fast(self, words, **options):
            Counted.calls += len(words)
            return library.encode_batch_fast(words, **options)

    own.library, plain = Counted(), [t + "$$$" for t in ("qué", "ÉTÉ", "words", "naïf")]
    own(plain * 3 + ["más. ", "otras, más"])
    assert Counted.calls <= 3
    assert simple8b.WordTokens(WORD_FILE, None)(["", "a"])[0].tolist() == []


def test_portions_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(simple8b, "CALL_CHARS", 5)
    texts = ["abc", "", "defghi", "j", "", "klmnopqr", "s", ""]
    runs = list(simple8b._portions(texts))
    assert [t for a, b in runs for t in texts[a:b]] == texts and len(runs) == 3
    assert list(simple8b._portions([])) == []


def test_shingles_follow_their_definition():
    texts = [b"", b" \n", b"One", b"one two", b"a b c a b c a", b"A  b\tC"]
    sets = hashing.shingle_sets(texts, 3)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 3, 1]
    assert sets[5][0] in sets[4]


@pytest.mark.parametrize("words", [3, 5])
@pytest.mark.parametrize("n", range(7))
def test_shingles_of_runs_of_few_words(n, words):
    text = [b"w%d" % i for i in range(n)]
    each = max(0, n - words + 1) or min(n, 1)
    assert [len(s) for s in hashing.shingle_sets([b" ".join(text)], words)] == [each]
    assert [len(s) for s in hashing.shingle_sets([b"", *text, b" "], words)] == [0, *[1] * n, 0]
    assert [s.tolist() for s in hashing.shingle_sets([b" ".join(text)], words)] == [
        s.tolist() for s in hashing.shingle_sets([b" ".join(text), b"more words after these " * 3], words)[:1]]


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_similar_sets_share_a_signature(percent):
    draw = np.random.default_rng(percent)
    bands = jaccard.Bands(percent)
    for _ in range(400):
        size = int(draw.integers(1, 120))
        a = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
        most = int(len(a) * (100 - percent) / 100) + 1
        gone, extra = int(draw.integers(0, most + 1)), int(draw.integers(0, most + 1))
        b = np.unique(np.concatenate([a[gone:], draw.integers(0, 2**64, extra, dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
            assert np.intersect1d(bands.signatures(a), bands.signatures(b)).size


@pytest.mark.parametrize("percent", [80, 90])
def test_pairs_inside_signatures_of_unlike_sets_grow_with_the_rows(percent):
    draw = np.random.default_rng(percent)
    bands, pairs, seen = jaccard.Bands(percent), {}, {}
    for n in range(10_000):
        signatures = bands.signatures(draw.integers(0, 2**64, int(draw.integers(60, 600)), dtype=np.uint64))
        for s in signatures.tolist():
            seen[s] = seen.get(s, 0) + 1
        if n + 1 in (1000, 10_000):
            pairs[n + 1] = sum(k * (k - 1) // 2 for k in seen.values())
    assert pairs[10_000] <= 10_000 and pairs[10_000] <= 10 * max(pairs[1000], 100)


def test_sets_with_many_empty_cells_keep_their_empty_signatures():
    few = jaccard.Scheme(3, 60)
    a, b = np.arange(5, dtype=np.uint64), np.arange(100, 105, dtype=np.uint64)
    assert np.intersect1d(few.signatures(a), few.signatures(b)).size  # they differ in 10 <= 60


def test_sketches_of_all_sizes_bound_the_difference_from_below():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 2**64, n, dtype=np.uint64)) for n in (3, 900, 1100, 5000, 30_000)]
    sets += [np.concatenate([s[len(s) // 9 :], draw.integers(0, 2**64, len(s) // 9 + 1, dtype=np.uint64)]) for s in sets]
    left, right = zip(*[(a, b) for a in sets for b in sets])
    apart = jaccard._apart([jaccard._sketch(a) for a in left], [jaccard._sketch(b) for b in right])
    true = np.array([len(np.setxor1d(a, b)) for a, b in zip(left, right)])
    assert (apart <= true).all() and apart[4 * len(sets) + 3] > 15_000


def test_graph_search_finds_what_brute_force_finds():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 16))
    x = np.concatenate([draw.normal(size=(600, 16)), (centres[:, None] + 0.05 * draw.normal(size=(40, 12, 16))).reshape(-1, 16)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    level = near_vectors._levels(700)
    order = np.argsort(-level, kind="stable")
    shard, level = x[:700][order], level[order]
    built = near_vectors.Hierarchy(shard, level)
    stored = near_vectors.Hierarchy(shard, level, built.stored_links())
    assert all((a.links == b.links).all() for a, b in zip(built.layers, stored.layers))
    own = np.full(len(x), -1)
    own[order] = np.arange(700)
    found = near_vectors._Found(np.arange(len(x)), order, np.ones(700, np.int64))
    near_vectors._links_in(stored, shard, x, own, 0.95, near_vectors.BEAM, near_vectors.RECALL, found)
    truth = (x @ shard.T >= 0.95) & (np.arange(len(x))[:, None] != order)
    count = truth.sum(1)
    assert (found.count <= count).all() and found.count.sum() >= 0.98 * count.sum()


def test_crowds_of_vectors_are_counted_whole():
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(size=(200, 16)), draw.normal(size=16) + 0.1 * draw.normal(size=(600, 16))])
    x = near_vectors._unit(x[draw.permutation(800)] * 1e200)
    level = near_vectors._levels(800)
    order = np.argsort(-level, kind="stable")
    own = np.argsort(order)
    found = near_vectors._Found(np.arange(800), order, np.ones(800, np.int64))
    near_vectors._links_in(near_vectors.Hierarchy(x[order], level[order]), x[order], x, own, 0.95, near_vectors.BEAM, 1.0, found)
    near = x @ x.T >= 0.95
    assert (found.count == near.sum(1) - 1).mean() > 0.999
    child, top = near_vectors._forest(np.concatenate(found.a), np.concatenate(found.b))
    assert set(child) | set(top) == set(np.flatnonzero(near.sum(1) > 1))


def _near_counts(x, shard_size, beam):
    """(found, true) counts of other vectors linked with each of x, of which the first are the shard."""
    level = near_vectors._levels(shard_size)
    order = np.argsort(-level, kind="stable")
    own = np.full(len(x), -1)
    own[order] = np.arange(shard_size)
    found = near_vectors._Found(np.arange(len(x)), order, np.ones(shard_size, np.int64))
    index = near_vectors.Hierarchy(x[:shard_size][order], level[order])
    near_vectors._links_in(index, x[:shard_size][order], x, own, 0.95, beam, near_vectors.RECALL, found)
    return found.count, (x @ x[:shard_size].T >= 0.95).sum(1) - (own >= 0)


def _tight(draw, groups, size, width):
    centres = draw.normal(size=(groups, 1, width))
    return (centres + 0.05 * draw.normal(size=(groups, size, width))).reshape(-1, width)


def test_small_groups_beside_a_crowd_are_found():
    draw = np.random.default_rng(9)
    crowd = draw.normal(size=24) + 0.05 * draw.normal(size=(700, 24))
    pairs = _tight(draw, 400, 2, 24)
    x = near_vectors._unit(np.concatenate([crowd, pairs, draw.normal(size=(500, 24))]))[draw.permutation(2000)]
    found, true = _near_counts(x, 1200, 1)
    few = (true > 0) & (true < 24)
    assert few.sum() > 300 and (found <= true).all()
    assert (found[few] / true[few]).mean() >= 0.97 and found[true >= 24].sum() >= 0.97 * true[true >= 24].sum()


def test_rare_links_are_found():
    draw = np.random.default_rng(10)
    x = near_vectors._unit(np.concatenate([draw.normal(size=(2964, 24)), _tight(draw, 18, 2, 24)]))[draw.permutation(3000)]
    found, true = _near_counts(x, 2000, 1)
    assert true.sum() and found.sum() >= 0.95 * true.sum() and (found <= true).all()


def test_an_audit_draws_until_enough_queries_are_linked(monkeypatch):
    draw = np.random.default_rng(11)
    crowd = draw.normal(size=24) + 0.05 * draw.normal(size=(700, 24))
    x = near_vectors._unit(np.concatenate([crowd, _tight(draw, 100, 2, 24), draw.normal(size=(1100, 24))]))[draw.permutation(2000)]
    own = np.arange(2000)
    audit = near_vectors._Audit(x, x, own, own, 0.95, 24)
    true = (x @ x.T >= 0.95).sum(1) - 1
    assert audit.enough and audit.kinds[0] >= near_vectors.ENOUGH and audit.kinds[1] >= near_vectors.ENOUGH
    assert (audit.truth.sum(1) == true[audit.rows]).all()
    lost = audit.truth.copy()
    lost[: audit.kinds[0]] = False
    assert audit.recalls(audit.truth) == [1.0, 1.0] and audit.recalls(lost) == [0.0, 1.0]
    assert (lost & audit.truth).sum() >= 0.99 * audit.truth.sum()
    monkeypatch.setattr(near_vectors, "DRAWN", 300)
    assert not near_vectors._Audit(x, x, own, own, 0.95, 24).enough


def test_forest_joins_the_same_nodes():
    draw = np.random.default_rng(2)
    a, b = draw.integers(0, 60, 50), draw.integers(0, 60, 50)
    parent = {i: i for i in range(60)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in zip(a, b):
        lo, hi = sorted((root(int(x)), root(int(y))))
        parent[hi] = lo
    child, top = near_vectors._forest(a, b)
    assert all(root(int(c)) == t for c, t in zip(child, top))
    assert set(child) | set(top) >= {i for i in set(a) | set(b) if root(int(i)) != i}


def test_language_profiles():
    profiles = language.Profiles({"aa": [1, 2, 3], "bb": [3, 2, 9]}, ranks=3)
    assert profiles.distances(np.array([3, 2, 1])).tolist() == [2 + 0 + 2, 0 + 0 + 3]
    assert profiles.predict(None) == ("und", 0.0) == profiles.predict("12 !?")
    assert language.Profiles({}).predict("text") == ("und", 0.0)
    codes, counts = language.ngrams("Ab, ab")
    assert counts.sum() == len("abab") + len(" ab ab ") - 1 + len(" ab ab ") - 2


def test_gradients_by_difference():
    net = {k: v.astype(float) for k, v in toxicity.new_network().items()}
    vocab = toxicity.Vocab([b"a bad day for you", b"nice words", b""])
    _, ids = vocab.windows()
    ids, label = ids[:, :6], np.array([1.0, 0.0, 1.0])
    _, g = toxicity.gradients(net, vocab, ids, label)
    for name in net:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was, loss = net[name][at], []
        for step in (1e-2, -1e-2):
            net[name][at] = was + step
            loss.append(toxicity.gradients(net, vocab, ids, label)[0])
        net[name][at] = was
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[name][at], rel=2e-2, abs=1e-7)


def test_toxicity_forward_against_plain_loops():
    net = {k: v.astype(float) for k, v in toxicity.new_network(3).items()}
    vocab = toxicity.Vocab([b"what a bad bad day"])
    _, ids = vocab.windows()
    gate = lambda v: 1 / (1 + np.exp(-v))
    words, n, states = vocab.inputs(net), toxicity.STATE, {}
    for way, order in (("f", range(5)), ("b", range(4, -1, -1))):
        h = np.zeros(n)
        for t in order:
            x, r = words[ids[0, t]] @ net[f"x_{way}"] + net[f"c_{way}"], h @ net[f"u_{way}"]
            z, reset = gate(x[:n] + r[:n]), gate(x[n : 2 * n] + r[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + reset * r[2 * n :])
            states[way, t] = h
    whole = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(5)])
    focus = np.exp(np.tanh(whole @ net["attend"]) @ net["focus"])
    logit = (focus / focus.sum()) @ whole @ net["out"] + net["bias"][0]
    assert toxicity.forward(net, vocab.inputs(net), ids)[0] == pytest.approx(logit)


def test_toxicity_is_told_apart_in_documents_that_were_not_seen():
    import zlib

    import duckdb

    rows = duckdb.sql("SELECT doc_id, text, toxic FROM '/root/testdata/sf0.01/documents.parquet' JOIN '/root/testdata/sf0.01/labels.parquet' "
                      "USING (doc_id) WHERE toxic IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    parts = {k: [(t.encode(), y) for i, t, y in rows if (zlib.crc32(str(i).encode()) % 3 == 1) == k] for k in (False, True)}
    net = toxicity.train([t for t, _ in parts[False]], np.array([y for _, y in parts[False]], float))
    score, label = toxicity.score_texts(net, [t for t, _ in parts[True]]), np.array([y for _, y in parts[True]])
    assert label.sum() == 18 and (score[label == 1] >= 0.7).sum() >= 12 and (score[label == 0] >= 0.7).sum() <= 3


def test_runs_of_half_a_window_lie_whole_in_some_window():
    vocab = toxicity.Vocab([b" ".join(b"w%d" % i for i in range(500))])
    _, ids = vocab.windows()
    windows = [set(row[row >= 0].tolist()) for row in ids]
    runs = [set(vocab.number[i : i + toxicity.STRIDE].tolist()) for i in range(500 - toxicity.STRIDE + 1)]
    assert all(any(run <= w for w in windows) for run in runs)


def test_toxicity_learns_a_word_and_looks_at_all_windows():
    draw = random.Random(1)
    plain = [" ".join(draw.choice(["sun", "rain", "wind", "tree", "road"]) for _ in range(150)) for _ in range(80)]
    bad = [t.split() for t in plain[:40]]
    for i, t in enumerate(bad):
        t[(37 * i) % 150] = "awful"
    net = toxicity.train([" ".join(t).encode() for t in bad] + [t.encode() for t in plain[40:]], np.array([1.0] * 40 + [0.0] * 40), rounds=20, batch=8)
    scores = toxicity.score_texts(net, [b"sun rain " * 400 + b"awful", b"sun rain " * 400, b""])
    assert scores[0] > 0.7 > 0.3 > scores[1] and 0 <= scores[2] <= 1


def test_windows_cover_every_word_and_overlap():
    vocab = toxicity.Vocab([b" ".join(b"w%d" % i for i in range(n)) for n in (0, 1, 64, 65, 121, 300)])
    text, ids = vocab.windows()
    for i, n in enumerate((0, 1, 64, 65, 121, 300)):
        own = ids[text == i]
        assert len(own) >= 1 and len(np.unique(own[own >= 0])) == n


def test_ordinal_regression_on_four_grades():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(3000, 3)).astype(np.float32)
    score = x @ np.array([2.0, -1.0, 0.0])
    noise = np.log(1 / draw.random(3000) - 1)
    grade = np.digitize(score + noise, [-2.0, 0.0, 1.5]) + 1.0
    model = quality.fit(x, grade, rounds=400)
    assert model.grades == [1.0, 2.0, 3.0, 4.0] and (np.diff(model.thresholds) > 0).all()
    assert model.weights == pytest.approx([2, -1, 0], abs=0.25) and model.thresholds == pytest.approx([-2, 0, 1.5], abs=0.25)
    tails = model.tails(np.array([0.0]))
    assert model.expected(tails)[0] == pytest.approx(1 + tails.sum())
    one = quality.fit(x, np.full(3000, 2.0))
    assert one.grades == [2.0] and one.expected(one.tails(np.zeros(2))).tolist() == [2.0, 2.0]


def test_quality_features_are_of_whole_texts():
    row, column, value = quality.features([b"", b"word", b"word word !! " * 50])
    assert set(row) == {0, 1, 2} and np.isfinite(value).all()
    assert value[(row == 0) & (column == quality.SIZE - 1)].tolist() == [1.0]


def test_rank_file_is_read_as_given(words):
    with open(BYTE_RANKS, "rb") as lines:
        first = next(lines).split()
    assert words.ranks[base64.b64decode(first[0])] == int(first[1])
