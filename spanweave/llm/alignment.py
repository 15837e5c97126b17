"""Alignment of two tokenizers over the same texts.

Both tokenizers split the bytes of a text. Where a token of each ends at the same byte the
text can be cut; between two cuts lies a group of tokens that cover the same bytes. Cuts are
found by divide and conquer: a common end near the middle of an interval, found by bisection
in the ends of the one and of the other in turn, then both halves. All intervals of a
batch of texts are divided together, level by level. An interval without a common end is a
group.

``align`` gives one row per text and rows of id pairs that are linked (their tokens share a
group), ``link_counts`` adds to every text how common its links are in all of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, settle

#: A batch is closed at so many bytes of text or documents.
BATCH_BYTES, BATCH_DOCS = 1_500_000, 4096
#: Pairs are dealt by their first id to so many parts.
PARTS = 16
#: A part's packed pairs are looked up in slices of about so many bytes.
SLICE_BYTES = 64_000_000
#: Token pairs that are listed at a time.
LISTED = 4_000_000
#: Distinct pairs that a task counts before it passes them on.
HELD = 6_000_000


class Tokens:
    """A tokenizer: ``encode(texts)`` gives ids, ``pieces`` the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones
    themselves, the others, in order, the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters.values())}
    return letters


@cache
def byte_level(path: str, pattern: str) -> Tokens:
    """A byte-level BPE file of the tokenizers library, space put before each text, special
    tokens as plain text. Its merges are in the order of their ids (checked), so the
    ids are ranks, and the rank encoder, several times as fast, gives the same ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in merges]
    if made != list(range(256, 256 + len(made))):
        raise ValueError("merges are not in the order of ids")
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(made)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(model["vocab"].values()) + 1)
    for token, i in model["vocab"].items():
        pieces[i] = bytes(letters[c] for c in token) if i < 256 + len(made) else token.encode()
    return Tokens(lambda texts: [encoding.encode_ordinary(" " + t) for t in texts], pieces)


@cache
def piece_model(path: str) -> Tokens:
    """A sentencepiece model that puts a space before each text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def bytes_of(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    return Tokens(lambda texts: model.encode(texts, num_threads=1), [bytes_of(model.id_to_piece(i)) for i in range(model.get_piece_size())])


def _near_middle(ends_a, ends_b, lo_a, hi_a, lo_b):
    """For intervals of A tokens lo_a ... hi_a and B tokens from lo_b on, which end together:
    tokens of both that end together near the middle, before the end; -1 where none do.

    From the middle A end, bisect for the next B end, from that for the next A end, and so on
    until they are the same; where the interval ends first, the same way to the left."""
    found_a, found_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
    middle = (lo_a + hi_a - 2) // 2
    rows, at = np.arange(len(lo_a)), middle
    missed = []
    while len(rows):
        b = np.searchsorted(ends_b, ends_a[at])
        hit = ends_b[b] == ends_a[at]
        found_a[rows[hit]], found_b[rows[hit]] = at[hit], b[hit]
        rows, at = rows[~hit], np.searchsorted(ends_a, ends_b[b[~hit]])
        inside = at < hi_a[rows] - 1
        missed.append(rows[~inside])
        rows, at = rows[inside], at[inside]
    rows = np.sort(np.concatenate(missed)) if missed else rows
    at = middle[rows] - 1
    rows, at = rows[at >= lo_a[rows]], at[at >= lo_a[rows]]
    while len(rows):
        b = np.searchsorted(ends_b, ends_a[at], "right") - 1
        inside = b >= lo_b[rows]
        rows, at, b = rows[inside], at[inside], b[inside]
        hit = ends_b[b] == ends_a[at]
        found_a[rows[hit]], found_b[rows[hit]] = at[hit], b[hit]
        rows, at = rows[~hit], np.searchsorted(ends_a, ends_b[b[~hit]], "right") - 1
        inside = at >= lo_a[rows]
        rows, at = rows[inside], at[inside]
    return found_a, found_b


def cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A tokens and which B tokens end a group. ``ends``: the byte at which each token
    ends, over all texts of a batch; ``first``: each text's first token (and the number of all
    tokens). A text has tokens of both or of neither, and both end at its end."""
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    full = np.diff(first_a) > 0
    lo_a, hi_a, lo_b, hi_b = first_a[:-1][full], first_a[1:][full], first_b[:-1][full], first_b[1:][full]
    cut_a[hi_a - 1] = True
    cut_b[hi_b - 1] = True
    while len(lo_a):
        parts = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)
        lo_a, hi_a, lo_b, hi_b = lo_a[parts], hi_a[parts], lo_b[parts], hi_b[parts]
        a, b = _near_middle(ends_a, ends_b, lo_a, hi_a, lo_b)
        found = a >= 0
        a, b, lo_a, hi_a, lo_b, hi_b = a[found], b[found], lo_a[found], hi_a[found], lo_b[found], hi_b[found]
        cut_a[a] = True
        cut_b[b] = True
        halves = lambda left, right: np.stack([left, right], axis=1).ravel()
        lo_a, hi_a, lo_b, hi_b = halves(lo_a, a + 1), halves(a + 1, hi_a), halves(lo_b, b + 1), halves(b + 1, hi_b)
    return cut_a, cut_b


def _tally(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def _linked(a, b, n_a, n_b, home, width):
    """Distinct (pair, text) of linked ids as pair * BATCH_DOCS + text, in order, and how
    often each is linked. ``n_a``, ``n_b``: tokens of each group; ``home``: its text."""
    from_a, from_b, links = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    found = []
    large = links > LISTED
    for g in np.flatnonzero(large):  # each id once with its number, so that no more pairs arise than there are kinds
        ids_a, times_a = np.unique(a[from_a[g] : from_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[from_b[g] : from_b[g] + n_b[g]], return_counts=True)
        step = max(1, LISTED // len(ids_b))
        for i in range(0, len(ids_a), step):
            pairs = (ids_a[i : i + step, None].astype(np.int64) * width + ids_b) * BATCH_DOCS + home[g]
            found.append((pairs.ravel(), (times_a[i : i + step, None] * times_b).ravel()))
    small = np.flatnonzero(~large)
    runs = np.cumsum(links[small]) // LISTED
    for some in np.split(small, np.flatnonzero(np.diff(runs)) + 1) if len(small) else []:
        each = links[some]
        group = np.repeat(some, each)
        turn = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        down = turn // n_b[group]
        pairs = a[from_a[group] + down] * width + b[from_b[group] + turn - down * n_b[group]]
        keys, times = np.unique(pairs * BATCH_DOCS + home[group], return_counts=True)
        found.append((keys, times))
    if len(found) == 1:
        return found[0]
    return _tally(*(np.concatenate([f[i] for f in found]) for i in (0, 1))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@cache
def _written(n_a: int, n_b: int) -> list[str]:
    """The decimal ids of both sides followed by ',', then '|' or ';', then nothing."""
    a, b = [str(i) for i in range(n_a)], [str(i) for i in range(n_b)]
    return [f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b] + b


def _groups_text(a, b, cut_a, cut_b, first_a, first_b, n_a, n_b, sizes) -> list[str]:
    """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
    group_a = np.cumsum(cut_a) - cut_a
    group_b = np.cumsum(cut_b) - cut_b
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = a + sizes[0] * cut_a
    last = np.zeros(len(b), bool)
    last[first_b[1:][np.diff(first_b) > 0] - 1] = True
    order[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = 2 * sizes[0] + b + sizes[1] * (cut_b.astype(np.int64) + last)
    words = list(map(_written(*sizes).__getitem__, order.tolist()))
    edges = (first_a + first_b).tolist()
    return ["".join(words[i:j]) for i, j in zip(edges[:-1], edges[1:])]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
    return np.fromiter((i for each in ids for i in each), np.int64, int(first[-1])), first


def align_batch(texts: list[str | None], first: Tokens, second: Tokens) -> tuple[dict[str, list | np.ndarray], np.ndarray, np.ndarray]:
    """Columns n_a, n_b, n_groups, n_links, groups of at most BATCH_DOCS texts, and what
    ``_linked`` gives. A text that is null or empty, or is not what the tokens of both spell
    with a space before it, has no tokens."""
    held = [t or "" for t in texts]
    ids = [tokens.encode(held) for tokens in (first, second)]
    for i, text in enumerate(held):
        raw = (" " + text).encode("utf-8", "surrogatepass")
        if not text or any(b"".join(map(tokens.pieces.__getitem__, each[i])) != raw for tokens, each in zip((first, second), ids)):
            ids[0][i] = ids[1][i] = []
    (a, first_a), (b, first_b) = _flat(ids[0]), _flat(ids[1])
    cut_a, cut_b = cuts(np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b]), first_a, first_b)
    stop_a, stop_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    n_a, n_b = np.diff(stop_a, prepend=-1), np.diff(stop_b, prepend=-1)
    home = np.searchsorted(first_a, stop_a, "right") - 1
    upto = np.concatenate([[0], np.cumsum(n_a * n_b)])
    edges = np.concatenate([[0], np.cumsum(cut_a)])[first_a]
    rows = {"n_a": np.diff(first_a), "n_b": np.diff(first_b), "n_groups": np.diff(edges), "n_links": np.diff(upto[edges]),
            "groups": _groups_text(a, b, cut_a, cut_b, first_a, first_b, n_a, n_b, (len(first.pieces), len(second.pieces)))}
    return rows, *_linked(a, b, n_a, n_b, home, len(second.pieces))


_TEXT = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())]
_PACK = [("part", pa.int32()), ("pairs", pa.binary()), ("texts_of", pa.binary()), ("texts", pa.binary()), ("times", pa.binary())]


def _packs(keys: np.ndarray, times: np.ndarray, width: int) -> Iterator[tuple]:
    """Part, distinct pairs, texts of each, those texts, and their numbers of links."""
    pairs, texts = keys // BATCH_DOCS, keys % BATCH_DOCS
    parts = pairs // width % PARTS
    for part in range(PARTS):
        here = parts == part
        if here.any():
            own, where, count = np.unique(pairs[here], return_index=True, return_counts=True)
            yield (part, own.astype("<i8").tobytes(), count.astype("<u2").tobytes(), texts[here].astype("<u2").tobytes(),
                   times[here].astype("<i8" if times.max() >= 2**16 else "<u2").tobytes())


def align(docs: DataFrame, first: Callable[[], Tokens], second: Callable[[], Tokens], ids: tuple[int, int]) -> DataFrame:
    """The alignment of ``docs`` (doc_id, text) by two tokenizers with so many ``ids``.

    A row per document, repeated ones too: doc_id, batch, place, n_a and n_b (tokens),
    n_groups, n_links (token pairs that share a group) and groups, their ids as
    ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and texts that the tokens of one side do not
    spell byte by byte after a space, have no tokens and empty groups. Further rows, with a
    ``part``, hold the distinct linked id pairs of a batch, packed, for ``link_counts``.
    Extra columns are dropped; an empty table gives no rows. A batch holds
    BATCH_BYTES of text, more only if one text has more.
    """
    if ids[0] * ids[1] * BATCH_DOCS >= 2**63:
        raise ValueError("the ids are too many for a 64-bit key")
    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", None), ("batch", pa.int64()), ("place", pa.int32()), *_TEXT, *_PACK]

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one, two = first(), second()
        if (len(one.pieces), len(two.pieces)) != tuple(ids):
            raise ValueError(f"the tokenizers have {len(one.pieces)} and {len(two.pieces)} ids")
        batch = TaskContext.get().partitionId() << 32

        def record(n: int, doc_type: pa.DataType, **columns) -> pa.RecordBatch:
            types = [doc_type if t is None else t for _, t in fields]
            return pa.RecordBatch.from_arrays([columns[name] if isinstance(columns.get(name), pa.Array) else pa.array(columns[name], t) if name in columns else pa.nulls(n, t)
                                               for (name, _), t in zip(fields, types)], [name for name, _ in fields])

        for chunk in chunks:
            doc_ids, texts = chunk.column("doc_id"), chunk.column("text").to_pylist()
            start, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size >= BATCH_BYTES or i + 1 - start == BATCH_DOCS or i + 1 == len(texts):
                    n = i + 1 - start
                    rows, keys, times = align_batch(texts[start : i + 1], one, two)
                    yield record(n, doc_ids.type, doc_id=doc_ids.slice(start, n), batch=[batch] * n, place=range(n), **rows)
                    for pack in _packs(keys, times, len(two.pieces)):
                        yield record(1, doc_ids.type, batch=[batch], **{name: [value] for (name, _), value in zip(_PACK, pack)})
                    batch, start, size = batch + 1, i + 1, 0

    schema = (f"doc_id {kind.simpleString()}, batch bigint, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
              "part int, pairs binary, texts_of binary, texts binary, times binary")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _pair_counts(packs: DataFrame) -> DataFrame:
    """(pair, n): the number of texts that hold each linked id pair."""
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def tally():
            return _tally(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        def out(pairs, n):
            for i in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["pair", "n"])

        for chunk in chunks:
            for pairs, n in zip(chunk.column("pairs"), chunk.column("texts_of")):
                held.append((np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(n.as_buffer(), "<u2").astype(np.int64)))
                size += len(held[-1][0])
                if size > HELD:
                    held = [tally()]
                    size = 2 * len(held[0][0])  # so that a task whose pairs are all different passes them on
                    if size > HELD:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*tally())

    return packs.select("pairs", "texts_of").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _look_up(packs: pa.Table, counts: pa.Table) -> pa.Table:
    """For each text of the packs of a part: links by pairs that are their first id's most
    common, and the sum of the counts of all links."""
    pairs = counts.column("pair").to_numpy()
    order = np.argsort(pairs)
    pairs, n, best = pairs[order], counts.column("n").to_numpy()[order], counts.column("best").to_numpy()[order]
    found = []
    for batch, own, texts_of, texts, times in zip(*(packs.column(c) for c in ("batch", "pairs", "texts_of", "texts", "times"))):
        at = np.searchsorted(pairs, np.frombuffer(own.as_buffer(), "<i8"))
        at = np.repeat(at, np.frombuffer(texts_of.as_buffer(), "<u2"))
        texts = np.frombuffer(texts.as_buffer(), "<u2").astype(np.int64)
        raw = times.as_buffer()
        times = np.frombuffer(raw, "<i8" if raw.size == 8 * len(texts) else "<u2").astype(np.int64)
        where = np.argsort(texts, kind="stable")
        texts, times, at = texts[where], times[where], at[where]
        first = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
        found.append((np.full(len(first), batch.as_py()), texts[first].astype(np.int32),
                      np.add.reduceat(times * best[at], first), np.add.reduceat(times * n[at], first)))
    names = ["batch", "place", "n_best", "count_sum"]
    if not found:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names)
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names)


def link_counts(aligned: DataFrame, ids: tuple[int, int]) -> DataFrame:
    """The document rows of ``align`` with n_best and count_sum: links whose id pair is held
    linked by the most documents of all pairs of its first id (ties included), and the sum over
    links of the number of documents that hold their pair linked.

    Columns added to ``aligned`` are kept. Pairs never travel one by one: packs of a batch
    are dealt by first id, a part that holds more in as many slices as its size asks for, each
    with the counts of the part.
    """
    stored = settle(aligned, "aligned")
    packs = stored.where("part IS NOT NULL").select("batch", "part", "pairs", "texts_of", "texts", "times")
    texts = stored.where("part IS NULL").drop("part", "pairs", "texts_of", "texts", "times")
    counts = settle(_pair_counts(packs).withColumn("first", F.expr(f"pair DIV {ids[1]}")), "pair-counts")
    best = counts.groupBy("first").agg(F.max("n").alias("most"))
    size = F.octet_length("pairs") + F.octet_length("texts_of") + F.octet_length("texts") + F.octet_length("times")
    slices = packs.groupBy("part").agg(F.ceil(F.sum(size.cast("bigint")) / SLICE_BYTES).cast("int").alias("slices"))
    slices = F.broadcast(settle(slices, "slices"))  # PARTS rows
    sent = packs.join(slices, "part").withColumn("slice", F.pmod(F.xxhash64("batch"), F.col("slices")).cast("int")).drop("slices")
    # as many rows as the first tokenizer has ids, whatever the input
    known = counts.join(F.broadcast(best), "first").select(
        F.pmod("first", F.lit(PARTS)).cast("int").alias("part"), "pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    known = known.join(slices, "part").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    sums = (sent.groupBy("part", "slice").cogroup(known.groupBy("part", "slice"))
            .applyInArrow(_look_up, "batch bigint, place int, n_best bigint, count_sum bigint"))
    sums = sums.groupBy("batch", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (texts.join(sums, ["batch", "place"], "left").drop("batch", "place")
            .fillna(0, ["n_best", "count_sum"]))
