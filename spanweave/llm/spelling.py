"""Spelling variants: words one edit apart, found over a reduced alphabet.

Every letter is hashed to one of SYMBOLS symbols. Two words one edit apart have reduced
words that are equal or one edit apart, so each reduced word generates its whole one-edit
neighbourhood, as 64-bit hashes; the hashes that are hashes of a reduced word of the
vocabulary give pairs of reduced words, and their words are compared as they are written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import _power_tables, mix
from .scratch import discard, settle

SYMBOLS = 8
#: Words that a task counts before it passes their counts on.
HELD = 300_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_VALUES = mix(np.arange(SYMBOLS, dtype=np.uint64), 11)


def words_of(text: str, doc_id: int | None, letters: int, damage: int) -> Counter:
    """How often a text has each word of ``letters`` code points or more, see word_counts."""
    found = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    if not damage:
        return Counter({w: n for w, n in found.items() if len(w) >= letters})
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = Counter()
    for word, n in found.items():
        if len(word) >= letters:
            h = zlib.crc32(word.encode(), start)
            if h % damage == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < letters:
                    continue
            out[word] += n
    return out


def word_counts(docs: DataFrame, letters: int = 6, least: int = 5, damage: int = 0) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) and how often they occur overall.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, only A-Z lower-cased, of at least
    ``letters`` code points and ``least`` occurrences. ``damage`` > 0 deletes a code point of
    one run in so many, chosen by the crc32 of ``<doc_id>:<run>``, as a test of what the
    groups find. Null texts have no words, a null doc_id counts as an empty one, repeated rows
    count each. Tasks count before they pass words on, so a common word is one row a task.
    """
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for chunk in chunks:
            for doc_id, text in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist()):
                if text:
                    held.update(words_of(text, doc_id, letters, damage))
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    partial = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equally long words, and their code points as a matrix."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, 100_000 // max(1, int(length)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            codes = "".join([words[j] for j in part]).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(codes, "<u4").reshape(len(part), int(length))


def _finish(totals: np.ndarray, length: int) -> np.ndarray:
    return mix(totals ^ mix(np.array([length], np.uint64), 5)[0], 12)


def neighbourhood(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For equally long reduced words (a matrix of symbols): the hash of each, and (row,
    hash) of every reduced word at most one edit from it, itself included, each once.

    The hash is a polynomial one, so a neighbour costs a few operations whatever its length.
    """
    rows, length = symbols.shape
    up, down = _power_tables(length + 2)
    values = _VALUES[symbols]
    sums = np.zeros((rows, length + 1), np.uint64)
    np.cumsum(values * up[:length], axis=1, out=sums[:, 1:])
    whole = sums[:, -1:]
    own = _finish(whole[:, 0], length)
    every = np.arange(SYMBOLS)
    changed = whole[:, :, None] + (_VALUES - values[:, :, None]) * up[:length, None]
    at, place, symbol = np.nonzero(every != symbols[:, :, None])
    found = [(np.arange(rows), own), (at, _finish(changed[at, place, symbol], length))]
    if length:
        shorter = sums[:, :-1] + (whole - sums[:, 1:]) * down[1]
        last_of_run = np.ones((rows, length), bool)
        last_of_run[:, :-1] = symbols[:, :-1] != symbols[:, 1:]
        at, place = np.nonzero(last_of_run)
        found.append((at, _finish(shorter[at, place], length - 1)))
    longer = sums[:, :, None] + _VALUES * up[: length + 1, None] + ((whole - sums) * up[1])[:, :, None]
    new = np.ones((rows, length + 1, SYMBOLS), bool)
    new[:, :length] = every != symbols[:, :, None]
    at, place, symbol = np.nonzero(new)
    found.append((at, _finish(longer[at, place, symbol], length + 1)))
    return own, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def reduce_words(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with its reduced word as digits and the hash of it."""
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            texts = chunk.column("word").to_pylist()
            reduced, keys = [""] * len(texts), np.zeros(len(texts), np.uint64)
            for rows, codes in _by_length(texts):
                symbols = ((codes.astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(7)) % np.uint64(SYMBOLS)
                up, _ = _power_tables(codes.shape[1] + 1)
                keys[rows] = _finish((_VALUES[symbols.astype(np.int64)] * up[: codes.shape[1]]).sum(axis=1, dtype=np.uint64), codes.shape[1])
                digits = (symbols + 48).astype(np.uint8)
                for row, line in zip(rows, digits):
                    reduced[row] = line.tobytes().decode()
            yield pa.RecordBatch.from_arrays([chunk.column("word"), chunk.column("n"), pa.array(reduced, pa.string()), pa.array(keys.view(np.int64))],
                                             ["word", "n", "reduced", "key"])

    return words.select("word", F.col("n").cast("bigint").alias("n")).mapInArrow(run, "word string, n bigint, reduced string, key bigint")


def _neighbours(reduced: DataFrame) -> DataFrame:
    """(key, other) for each reduced word and each hash of its neighbourhood that is not
    smaller than its own: the neighbourhood is symmetric, so every pair comes once."""
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            for _, codes in _by_length(chunk.column("reduced").to_pylist()):
                own, row, other = neighbourhood(codes.astype(np.int64) - 48)
                mine = own[row]
                up = other >= mine
                yield pa.RecordBatch.from_arrays([pa.array(mine[up].view(np.int64)), pa.array(other[up].view(np.int64))], ["key", "other"])

    return reduced.mapInArrow(run, "key bigint, other bigint")


def near_words(reduced: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of all pairs of words exactly one edit apart, each pair once, of
    ``reduced`` (word, n, reduced, key). Equal hashes of other reduced words only add
    candidates; every pair is compared as it is written."""
    keys = reduced.select("key").distinct()
    pairs = _neighbours(reduced.select("reduced").distinct()).join(keys.withColumnRenamed("key", "other"), "other", "left_semi").distinct()
    left = reduced.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = reduced.select(F.col("key").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = pairs.join(left, "key").join(right, "other")
    near = near.where((F.col("key") != F.col("other")) | (F.col("a") < F.col("b")))
    near = near.where(F.abs(F.char_length("a") - F.char_length("b")) <= 1)
    return near.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): where the forms of a word lead. A form occurs
    more often than its word, so there are no rings; pointers double in length each round."""
    roots = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        over = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = settle(roots.join(over, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(roots)
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            return roots


def spelling_groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n), one row per word.

    n_near: the words exactly one inserted, deleted or replaced code point away. form: of
    them the one of largest n, of equal ones the smallest in code-point order, if its n
    is at least ``factor`` (2 or more) times the word's, else null, as is its form_n. root: the
    end of the chain of forms, the word itself if it has none. Null words are left out, of
    repeated ones the n are added; other columns have no effect; an empty table stays empty.
    """
    if factor < 2:
        raise ValueError("a factor below 2 does not order words by their forms")
    counted = words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    reduced = settle(reduce_words(counted), "spelling-words")
    near = near_words(reduced)
    both = near.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")).alias("first")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("form")).alias("first")),
    )).alias("x")).select("x.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("first").alias("first"))
    fits = -F.col("first.less") >= F.lit(factor) * F.col("n")
    best = settle(best.select("word", "n_near", F.when(fits, F.col("first.form")).alias("form"),
                              F.when(fits, -F.col("first.less")).alias("form_n")), "spelling-near")
    roots = _roots(best.where("form IS NOT NULL"))
    whole = reduced.select("word", "n").join(best, "word", "left").join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
