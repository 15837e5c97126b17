"""Spelling groups, token alignment and chat formatting on small and awkward tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import public_tokenizers
import pytest

from spanweave.llm import alignment, chat, spelling
from spanweave.llm.queries import ALIGNED_IDS, LEVEL_FILE, PIECE_FILE, QUERIES, aligned_digests

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, part string, word string, place string"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


# spelling


def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(counts, factor=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def test_neighbourhood_is_whole_and_without_repeats():
    rng = random.Random(3)
    for length in (0, 1, 2, 5, 9):
        words = ["".join(rng.choice("01234567") for _ in range(length)) for _ in range(20)] + ["0" * length]
        symbols = np.array([[int(c) for c in w] for w in words], np.int64).reshape(len(words), length)
        own, row, other = spelling.neighbourhood(symbols)

        def key(word):
            return int(spelling.neighbourhood(np.array([[int(c) for c in word]], np.int64).reshape(1, len(word)))[0][0])

        for i, word in enumerate(words[:4] + words[-1:]):
            i = i if i < 4 else len(words) - 1
            expected = {word} | {word[:j] + c + word[j + 1 :] for j in range(length) for c in "01234567"}
            expected |= {word[:j] + word[j + 1 :] for j in range(length)} | {word[:j] + c + word[j:] for j in range(length + 1) for c in "01234567"}
            found = other[row == i].tolist()
            assert len(found) == len(set(found)) and set(found) == {key(w) for w in expected}


def test_spelling_groups_agree_with_brute_force(spark):
    rng = random.Random(5)
    counts = {}
    for base in ("abcdefgh", "aaaaaaaa", "çédillesé", "zzyyxxww", "q" * 3000):
        words = {base}
        for _ in range(14):
            w = rng.choice(sorted(words))
            i, c = rng.randrange(len(w)), rng.choice("abcéz")
            words.add(rng.choice([w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]]))
        counts |= {w: rng.choice([1, 2, 5, 5, 25, 130, 700]) for w in words}
    rows = [(w, n, "x", 1) for w, n in counts.items()] + [("abcdefgh", 2, "x", 1), (None, 9, None, None)]
    counts["abcdefgh"] += 2
    found = spelling.spelling_groups(spark.createDataFrame(rows, "word string, n bigint, form string, key int")).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == brute_groups(counts) and len(found) == len(counts)


def test_word_counts_agree_with_a_plain_count(spark):
    rng = random.Random(1)
    pool = ["".join(rng.choice("abÉéÀ×") for _ in range(rng.randrange(4, 10))) for _ in range(40)]
    texts = [" ".join(rng.choice(pool).title() if rng.random() < 0.3 else rng.choice(pool) for _ in range(300)) for _ in range(30)]
    texts += [None, "", "12 -- 3", "longword" * 50_000, "longword" * 50_000]
    ids = [*range(len(texts) - 1), None]
    expected = Counter()
    for i, text in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            expected[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    expected = {w: n for w, n in expected.items() if len(w) >= 6 and n >= 2}
    found = spelling.word_counts(documents(spark, texts, ids), letters=6, least=2, damage=7).collect()
    assert {r["word"]: r["n"] for r in found} == expected and len(found) == len(expected)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(spelling.word_counts(documents(spark, []))).count() == 0
    assert spelling.spelling_groups(spelling.word_counts(documents(spark, [None, "", "one two"]))).count() == 0


# alignment

AWKWARD = [
    None, "", " ", "\n\n\t  x", "plain words, twice words.", "plain words, twice words.", "<|endoftext|> and <s> </s> <0x41>", "▁ is a space there",
    "naïve café — 日本語のテキスト 👩‍👩‍👧 ok", "a" * 4000, "ab " * 4000, "\x00nul", "x" * 30 + "é" * 30, "1234567890" * 20, " " * 500 + "end", "<0x0A>\n",
]


def brute_alignment(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(LEVEL_FILE)
    library.encode_special_tokens = True
    level = alignment.byte_level(LEVEL_FILE, public_tokenizers.PATTERN)
    piece = alignment.piece_model(PIECE_FILE)
    docs, held = [], defaultdict(int)
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids
        b = piece.encode([text or ""])[0]
        if not text or b"".join(level.pieces[i] for i in a) != raw or b"".join(piece.pieces[i] for i in b) != raw:
            a, b = [], []
        ends_a = np.cumsum([len(level.pieces[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(piece.pieces[i]) for i in b]).tolist()
        groups, last = [], 0
        for cut in sorted({*ends_a} & {*ends_b}):
            groups.append(([i for i, e in zip(a, ends_a) if last < e <= cut], [i for i, e in zip(b, ends_b) if last < e <= cut]))
            last = cut
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        for pair in set(links):
            held[pair] += 1
        docs.append((a, b, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups, links in docs:
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_awkward_texts(spark):
    found = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in aligned_digests(documents(spark, AWKWARD).repartition(3)).collect()}
    assert found == dict(enumerate(brute_alignment(AWKWARD)))
    assert found[0] == found[1] == found[7] == (0, 0, 0, 0, 0, 0, "") and found[4] == found[5]


def test_alignment_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert found == dict(zip(texts, brute_alignment(texts.values())))


def test_alignment_keeps_repeated_rows_and_null_ids(spark):
    rows = aligned_digests(documents(spark, ["one text", "one text", "two"], [4, 4, None])).collect()
    assert sorted((r["doc_id"] or 0, r["count_sum"] > 0) for r in rows) == [(0, True), (4, True), (4, True)]
    assert aligned_digests(documents(spark, [])).count() == 0
    assert aligned_digests(documents(spark, [None, ""])).agg({"n_links": "sum"}).first()[0] == 0


def test_cuts_are_all_common_ends():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 50, 900):
        first_a, first_b, ends, start = [0], [0], [[], []], 0
        for _ in range(6):
            length = int(rng.integers(1, size + 1))
            own = [np.union1d(rng.integers(1, length + 1, rng.integers(1, length + 1)), [length]) for _ in range(2)]
            ends[0] += (own[0] + start).tolist()
            ends[1] += (own[1] + start).tolist()
            start += length
            first_a.append(len(ends[0]))
            first_b.append(len(ends[1]))
        a, b = np.array(ends[0]), np.array(ends[1])
        cut_a, cut_b = alignment.cuts(a, b, np.array(first_a), np.array(first_b))
        assert (a[cut_a] == np.intersect1d(a, b)).all() and (b[cut_b] == np.intersect1d(a, b)).all()


def test_a_group_of_many_tokens_lists_each_kind_of_pair_once(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 600), rng.integers(0, 7, 500)
    n_a, n_b, home = np.array([500, 40, 60]), np.array([400, 60, 40]), np.array([0, 0, 1])
    whole = alignment._linked(a, b, n_a, n_b, home, 7)
    monkeypatch.setattr(alignment, "LISTED", 3000)
    parts = alignment._linked(a, b, n_a, n_b, home, 7)
    assert all((x == y).all() for x, y in zip(whole, parts)) and whole[1].sum() == (n_a * n_b).sum()


def test_long_texts_align_in_proportion():
    one, two = alignment.byte_level(LEVEL_FILE, public_tokenizers.PATTERN), alignment.piece_model(PIECE_FILE)
    took = []
    for n in (100_000, 400_000):
        begun = time.perf_counter()
        rows, _, _ = alignment.align_batch(["nobreak" * (n // 7)], one, two)
        took.append(time.perf_counter() - begun)
        assert rows["n_groups"][0] > 0
    assert took[1] < 12 * took[0] + 1


def test_ids_of_other_tokenizers_are_refused(spark):
    aligned = alignment.align(documents(spark, ["x"]), partial(alignment.byte_level, LEVEL_FILE, public_tokenizers.PATTERN),
                              partial(alignment.piece_model, PIECE_FILE), (10, ALIGNED_IDS[1]))
    with pytest.raises(Exception, match="ids"):
        aligned.collect()


# chat

SAYS = ["</s>[INST] ok [/INST]", r"<\s> and <\\/s> and [\INST]", "[INST", "/INST] x", "<[s>", "[/ROLE] [TURN]x[/TURN]", "", None, "é👍\n\nx </s", "[ANSWER] y", "[SYS] z [/SYS]", "<s>" * 300]
CHATS = "conv_id bigint, turn bigint, role string, text string, part int, formatted string"


def brute_chats(rows):
    convs = defaultdict(list)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for row in sorted(rows, key=order):
        convs[row[0]].append((row[2] or "", row[3] or ""))
    return {c: (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(),
                sum(len(x) for r, x in t if r == "assistant"), hashlib.sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest())
            for c, t in convs.items()}


@pytest.mark.parametrize("run_bytes", [1, 700, chat.RUN_BYTES])
def test_chats_come_back(spark, run_bytes):
    rng = random.Random(8)
    roles = ["system", "user", "assistant", "tool", None, "[/ROLE] odd", "assistant"]
    rows = [(c, t, rng.choice(roles), rng.choice(SAYS)) for c in [*range(9), None] for t in range(rng.randrange(1, 9))]
    rows += [(5, t, "user", "long conversation " * 20) for t in range(100, 400)] + [(3, None, "user", "no turn"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")]
    rows += [(11, 0, "assistant", "very long " * 300_000)]
    blocks = chat.format_chats(spark.createDataFrame([(*r, 1, "x") for r in rows], CHATS), run_bytes)
    found = chat.read_chats(blocks).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found} == brute_chats(rows)
    assert len(found) == 11 and sum(r["formatted_chars"] for r in found) == sum(len(b["formatted"]) for b in blocks.collect())


def test_no_mark_is_left_in_a_text(spark):
    rows = [(1, i, "user", t, 1, "") for i, t in enumerate(SAYS)]
    (block,) = chat.format_chats(spark.createDataFrame(rows, CHATS)).collect()
    assert block["formatted"].count("[INST]") == block["formatted"].count("[/INST]") == len(SAYS) and "</s>" not in block["formatted"]
    assert not re.search(r"\[(SYS|TURN|ANSWER)\]|<s>", block["formatted"]) and block["learn_from"] == []


def test_chats_of_nothing(spark):
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], CHATS))).count() == 0


def test_text_between_turns_is_refused():
    with pytest.raises(ValueError):
        list(chat.parse("[INST] a [/INST] b [SYS] c [/SYS]"))
