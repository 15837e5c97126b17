"""Quality classifier: cumulative-link regression on graded ratings of hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .hashing import Words, batches, mix

#: Rated documents that a model is fitted on, at most.
SAMPLE = 6000
#: A document stays if its probability of the wanted grade is this or more.
CUT = 0.5
#: Hash buckets of words, of word shapes, and of shapes of neighbouring words.
WORDS, SHAPES, PAIRS = 2048, 512, 512
#: Further features: share of words that repeat the one before, share of words that occur
#: before in the text, logarithm of the number of words, no words at all.
FURTHER = 4
SIZE = WORDS + SHAPES + PAIRS + FURTHER

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")  # bytes of letters beyond ASCII, mostly


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value) of the features that are not zero, over whole texts.

    Words and shapes count by the square root of their share of the text. A shape is a word
    with letters, capitals and digits put for any of their kind and runs of one kind as one.
    """
    found = Words(texts)
    n = np.diff(found.first)
    owner = np.repeat(np.arange(len(texts)), n)
    word = found.hashes()
    kind = _CLASS[found.data].copy()
    run = np.concatenate([[False], kind[1:] == kind[:-1]])
    kind[run] = 0  # of a run only the first counts
    shape = mix(_sums(found, kind), 5)
    follows = np.concatenate([[False], owner[1:] == owner[:-1]])[: len(word)]
    pair = mix(shape[1:] * np.uint64(3) + shape[:-1], 6) % np.uint64(PAIRS)
    column = [word % np.uint64(WORDS), WORDS + shape % np.uint64(SHAPES), WORDS + SHAPES + pair[follows[1:]]]
    rows = [owner, owner, owner[1:][follows[1:]]]
    key = np.concatenate([r.astype(np.int64) * SIZE + c.astype(np.int64) for r, c in zip(rows, column)])
    key, count = np.unique(key, return_counts=True)
    row, at = key // SIZE, key % SIZE
    value = np.sqrt(count / n[row])
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & follows[1:]
    order = np.lexsort((word, owner))
    old = np.zeros(len(word), bool)
    old[order[1:]] = (word[order[1:]] == word[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    some = np.maximum(n, 1)
    more = np.stack([np.bincount(owner, again, len(texts)) / some, np.bincount(owner, old, len(texts)) / some,
                     np.log1p(n) / 8, n == 0], 1)
    return (np.concatenate([row, np.repeat(np.arange(len(texts)), FURTHER)]),
            np.concatenate([at, np.tile(np.arange(SIZE - FURTHER, SIZE), len(texts))]),
            np.concatenate([value, more.ravel()]))


def _sums(found: Words, codes: np.ndarray) -> np.ndarray:
    """For each word a hash of the codes of its bytes in order, zeros left out."""
    before = np.concatenate([[0], np.cumsum(codes > 0)])
    ends = np.append(found.start[1:], len(codes))
    lead = found.start[0] if len(found.start) else len(codes)
    nth = before[:-1] - np.concatenate([np.zeros(lead, np.int64), np.repeat(before[found.start], ends - found.start)])
    part = mix(codes.astype(np.uint64), 3) * (mix(nth.astype(np.uint64), 4) | np.uint64(1))
    part[codes == 0] = 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
    return total[found.end] - total[found.start]


@dataclass
class OrdinalModel:
    """P(grade <= grades[j]) = sigmoid(thresholds[j] - weights . features)."""

    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """For each score the probabilities of exceeding each grade but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit(x: np.ndarray, grade: np.ndarray, penalty: float = 2e-5, rounds: int = 200, step: float = 0.05) -> OrdinalModel:
    """Maximum likelihood of the cumulative logit model by Adam, from zero weights.

    All grades share the weights; thresholds are a first one and positive gaps, so they stay
    in order. One grade alone needs neither.
    """
    grades, level = np.unique(grade, return_inverse=True)
    k = len(grades)
    w = np.zeros(x.shape[1])
    if k < 2:
        return OrdinalModel(grades.tolist() or [0.0], w, np.zeros(0))
    below = np.cumsum(np.bincount(level, minlength=k))[:-1] / len(level)
    start = np.log(below / (1 - below))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    p = np.concatenate([w, theta])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(level)
    for t in range(1, rounds + 1):
        w, theta = p[:-k + 1], p[-k + 1 :]
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        score = (x @ w.astype(x.dtype)).astype(float)
        upper = np.concatenate([cuts, [np.inf]])[level] - score
        lower = np.concatenate([[-np.inf], cuts])[level] - score
        su, sl = _sigmoid(upper), _sigmoid(lower)
        du, dl = su * (1 - su), sl * (1 - sl)
        mass = np.maximum(su - sl, 1e-12)
        g_score = (du - dl) / mass / n
        g_cut = np.zeros(k - 1)
        np.add.at(g_cut, level[level < k - 1], -(du / mass / n)[level < k - 1])
        np.add.at(g_cut, level[level > 0] - 1, (dl / mass / n)[level > 0])
        back = np.cumsum(g_cut[::-1])[::-1]
        g_theta = np.concatenate([back[:1], back[1:] * np.exp(theta[1:])])
        g = np.concatenate([(g_score.astype(x.dtype) @ x).astype(float) + penalty * w, g_theta])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w, theta = p[: -k + 1], p[-k + 1 :]
    return OrdinalModel(grades.tolist(), w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def learn(docs: DataFrame, ratings: DataFrame, grade: str = "quality", sample: int = SAMPLE) -> OrdinalModel:
    """A model of the column ``grade`` of ``ratings`` (doc_id, grade) on the texts of ``docs``.

    ``sample`` bounds the rated rows used: the first ones in the order of a hash of doc_id.
    Their features come to the driver, as many rows as the bound. Rows without a grade or
    document teach nothing; without any rated document, all get grade 0.
    """
    rated = ratings.select("doc_id", F.col(grade).cast("double").alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            for at, raw in batches(chunk.column("text").to_pylist()):
                row, column, value = features(raw)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(len(raw) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    chunk.column("grade").slice(at, len(raw)),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(column[order].astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(value[order].astype(np.float32))),
                ], names=["grade", "feature", "value"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade")  # `sample` rows at most
    got = rows.mapInArrow(run, "grade double, feature array<int>, value array<float>").toArrow().combine_chunks()
    x = np.zeros((got.num_rows, SIZE), np.float32)
    for i, (feature, value) in enumerate(zip(got.column("feature"), got.column("value"))):
        x[i, feature.values.to_numpy()] = value.values.to_numpy()
    grade_ = got.column("grade").to_numpy()
    order = np.lexsort((x.sum(1), grade_))  # the same sums whatever order the rows came in
    return fit(x[order], grade_[order])


def rate(docs: DataFrame, model: OrdinalModel, least: float | None = None) -> DataFrame:
    """``docs`` with expected_grade and p_least, the probability of grade ``least`` or more
    (default: the highest), from whole texts in the column text.

    A null or empty text is rated by the feature of having no words. Rows are rated one by
    one, repeated ones alike; an empty table gives an empty result; all columns pass, but
    for existing ones of the two names, which are replaced.
    """
    at = len(model.grades) - 1 if least is None else int(np.searchsorted(model.grades, least))
    docs = docs.drop("expected_grade", "p_least")

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            for first, raw in batches(chunk.column("text").to_pylist()):
                row, column, value = features(raw)
                tails = model.tails(np.bincount(row, model.weights[column] * value, len(raw)))
                p = np.ones(len(raw)) if at == 0 else tails[:, at - 1] if at <= tails.shape[1] else np.zeros(len(raw))
                part = chunk.slice(first, len(raw))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.expected(tails)), pa.array(p)],
                                                 names=[*part.schema.names, "expected_grade", "p_least"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("expected_grade", "double").add("p_least", "double"))
