"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle

#: N-grams in a profile.
RANKS = 400
#: Documents of each language that a profile is made from, on average.
PER_LANGUAGE = 3000


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of one to three characters of a whole text: lower-case
    letters, words set off by single blanks. A code packs the characters, 21 bits each."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.int64)
    blank = points == 32
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
    two = points[:-1] << 21 | points[1:]
    three = points[:-2] << 42 | two[1:]
    return np.unique(np.concatenate([points[points != 32], two, three]), return_counts=True)


def top_ranks(codes: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent codes in order; of equally frequent ones the smaller code first."""
    return codes[np.argsort(-counts, kind="stable")[:ranks]]


class Profiles:
    """For each language the place of each of its most frequent n-grams."""

    def __init__(self, ordered: dict[str, list[int]], ranks: int = RANKS):
        self.languages = sorted(ordered)
        self.ranks = ranks
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.array(ordered[x], np.int64) for x in self.languages]]))
        self.places = np.full((len(self.languages), len(self.codes)), -1)
        for i, language in enumerate(self.languages):
            self.places[i, np.searchsorted(self.codes, ordered[language])] = np.arange(len(ordered[language]))

    def distances(self, found: np.ndarray) -> np.ndarray:
        """Out-of-place distance of ranked codes to each profile: the sum of differences in
        rank, a code that is not in the profile counting as ``ranks``."""
        at = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
        hit = self.codes[at] == found
        places = self.places[:, at[hit]]
        apart = np.where(places >= 0, np.abs(places - np.flatnonzero(hit)), self.ranks)
        return apart.sum(1) + self.ranks * int((~hit).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, how much nearer it is than the next one); ties: first by name."""
        found = top_ranks(*ngrams(text or ""), self.ranks)
        if not len(found) or not self.languages:
            return "und", 0.0
        far = self.distances(found)
        best = int(far.argmin())
        rest = np.delete(far, best)
        other = float(rest.min()) if len(rest) else float(self.ranks * len(found))
        return self.languages[best], (other - float(far[best])) / other if other else 0.0


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, ranks: int = RANKS) -> Profiles:
    """Profiles of the languages in ``docs`` (doc_id, text, lang).

    ``per_language`` bounds the sample that a profile is made from: of a language with more
    documents, a share is drawn by a hash of doc_id so that this many are expected. Their
    n-grams are counted in tasks, summed by Spark, and the ``ranks`` most frequent of each
    language come to the driver. Rows with null lang or text teach nothing.
    """
    docs = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = settle(docs.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")  # so its size is known to the join
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = docs.join(sizes, "lang").where(draw * F.col("n") < per_language).select("text", "lang")

    def count(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            by: dict[str, list] = {}
            for text, lang in zip(chunk.column("text").to_pylist(), chunk.column("lang").to_pylist()):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, found in by.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()),
                                                  "code": pa.array(codes), "n": pa.array(n)})

    counted = sample.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    ordered: dict[str, list] = {}
    for row in ranked.select("lang", "rank", "code").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")]).to_pylist():
        ordered.setdefault(row["lang"], []).append(row["code"])
    return Profiles(ordered, ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) for each row of ``docs`` (doc_id, text).

    The whole text is profiled; score tells how much nearer the best profile is than the
    next one. A null text or one without letters gets ``und`` and 0, as does every text if
    no language was learned. Rows are judged one by one, repeated ones alike; other columns
    are ignored.
    """
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            found = [profiles.predict(text) for text in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
