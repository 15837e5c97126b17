"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its word shingles. Sets whose sizes lie in one band, or in two
neighbouring bands, can only be similar enough if they differ in at most ``k`` shingles,
with ``k`` fixed by the band. The shingle domain is cut into ``n1`` parts of ``n2`` cells;
some part then holds at most ``k // n1`` of the differences, and leaving out that many of
its cells leaves equal content. So two similar sets agree on one (part, subset of cells).
A hash of the content of each such subset is a signature; sets that share a signature are
candidates. A candidate pair is dropped if the counts of its sets in hash bins differ by
more than similar sets may, and else compared exactly.

A subset without shingles says nothing, yet all sets of a band that have none there would
share its signature. So there are a few more parts than the differences call for. Similar
sets then agree on several subsets, and a set with fewer empty ones than these leaves the empty
ones out: it still shares one that has shingles. Only a set with more keeps all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .hashing import batches, mix, shingle_sets
from .scratch import discard, settle

#: Up to this many differences, cells are enumerated in pairs out of three, which tells
#: small sets better apart; beyond it, singly, which needs the fewest signatures.
FINE = 16
#: Parts, as a multiple of those that the differences call for.
SPARE = 1.15
#: Bins of the sketch of a set of up to 4096 shingles; they double with the size beyond.
BINS = 256
#: Sets of one signature that are compared with each other at once.
BLOCK = 1000
#: Shingles of the documents that are compared by their texts in one place, about.
SHINGLES = 100_000


@dataclass(frozen=True)
class Scheme:
    """One use of the method: all pairs of sets that can differ in at most ``k`` shingles."""

    salt: int
    k: int

    @property
    def n1(self) -> int:
        return math.ceil(SPARE * (self.k + 1) / 2) if self.k else 1

    @property
    def n2(self) -> int:
        return 1 if self.k == 0 else 3 if self.k < FINE else 2

    def subsets(self) -> list[tuple[int, ...]]:
        """All cells of a part but one: n1 is more than k / 2, so some part holds one
        difference at most."""
        return list(combinations(range(self.n2), self.n2 - (self.k > 0)))

    def _may_drop(self, empty: np.ndarray) -> bool:
        """Whether a similar set must share a subset with shingles; ``empty``: which subsets
        of which part have none.

        Cells taken singly: at most k differ, so all but k agree. Pairs out of three: at
        most k // 2 parts hold two differences or more, the others agree on a pair.
        """
        if self.n2 == 2:
            return int(empty.sum()) < 2 * self.n1 - self.k
        return int(empty.any(0).sum()) < self.n1 - self.k // 2

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        cells = self.n1 * self.n2
        at = (mix(shingles, 11) >> np.uint64(33)) * np.uint64(cells) >> np.uint64(31)
        value, at = mix(shingles, 12), at.astype(np.int64)
        low = np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(float), cells).astype(np.uint64)
        high = np.bincount(at, (value >> np.uint64(32)).astype(float), cells).astype(np.uint64)
        content = ((high << np.uint64(32)) + low).reshape(self.n1, self.n2)
        held = np.bincount(at, minlength=cells).reshape(self.n1, self.n2)
        part = np.arange(self.n1, dtype=np.uint64)
        every = np.stack([
            mix(content[:, list(s)].sum(1, dtype=np.uint64) + mix(part, 1000 * self.salt + j))
            for j, s in enumerate(self.subsets())
        ])
        empty = np.stack([held[:, list(s)].sum(1) == 0 for s in self.subsets()])
        return every[~empty] if self._may_drop(empty) else every.ravel()


class Bands:
    """Size bands and their schemes for similarity ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]

    def _reach(self, size: int) -> int:
        while self.low[-1] <= size:
            last = self.low[-1]
            self.low.append(max(last + 1, -(-last * max(150, -(-10000 // self.percent)) // 100)))
        return int(np.searchsorted(self.low, size, "right")) - 1

    def _differences(self, sizes: int) -> int:
        return sizes * (100 - self.percent) // (100 + self.percent)

    def schemes(self, size: int) -> list[Scheme]:
        """Those that a set of this size takes part in: its own band, and the border to
        a neighbouring band where sets over there are near enough in size."""
        band = self._reach(size)
        self._reach(self.low[band + 1])
        top = self.low[band + 1] - 1
        out = [Scheme(2 * band, self._differences(2 * top))]
        for border in (band - 1, band):
            if border < 0:
                continue
            below = self.low[border + 1] - 1
            above = below * 100 // self.percent
            near = size <= above if border < band else size * 100 >= self.percent * self.low[border + 1]
            if near and above > below:
                out.append(Scheme(2 * border + 1, self._differences(below + above)))
        return out

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        return np.concatenate([s.signatures(shingles) for s in self.schemes(len(shingles))])


def _sketch(shingles: np.ndarray) -> bytes:
    """Counts of a set in its bins, at most 255 each: a bound from below on how far sets differ."""
    bits = 8 + max(0, math.ceil(math.log2(max(1, len(shingles)) / 4096)))
    found = np.bincount((mix(shingles, 13) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def _sketches(words: int, percent: int):
    fields = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
              ("sketch", pa.binary()), ("signatures", pa.list_(pa.int64()))]

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for chunk in chunks:
            ids, texts = chunk.column("doc_id"), chunk.column("text").to_pylist()
            for at, raw in batches(texts):
                sets = shingle_sets(raw, words)
                h1 = [int(mix(s, 21).sum(dtype=np.uint64)) for s in sets]
                h2 = [int(mix(s, 22).sum(dtype=np.uint64)) for s in sets]
                found = [bands.signatures(s) if len(s) else s for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(raw)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.array([_sketch(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ], schema=pa.schema(fields))

    return run


def _counts(sketches: list[bytes]) -> np.ndarray:
    """The counts of all in the bins of the shortest: bins are leading bits of a hash, so those
    of a longer sketch add up to those of a shorter one."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width), np.int16)  # sketches of one signature are of like sizes
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        own = np.frombuffer(b"".join([sketches[i] for i in rows]), np.uint8).reshape(len(rows), width, length // width)
        out[rows] = np.minimum(own.sum(2, dtype=np.int64), 32767)
    return out


def _differences(counts: np.ndarray, x: int, rows: np.ndarray) -> np.ndarray:
    """How far row ``x`` is from others, a bounded number of bins at a time."""
    step = max(1, 1_000_000 // counts.shape[1])
    parts = [np.abs(counts[rows[i : i + step]] - counts[x]).sum(1, dtype=np.int64) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For pairs of sketches a number of shingles in which their sets differ at least."""
    out = np.zeros(len(left), np.int64)
    shorter = np.fromiter((min(len(a), len(b)) for a, b in zip(left, right)), np.int64, len(left))
    for width in np.unique(shorter):
        rows = np.flatnonzero(shorter == width)
        for i in range(0, len(rows), max(1, 1_000_000 // int(width))):
            part = rows[i : i + max(1, 1_000_000 // int(width))]
            both = _counts([left[r] for r in part] + [right[r] for r in part])
            out[part] = np.abs(both[: len(part)] - both[len(part) :]).sum(1, dtype=np.int64)
    return out


def _may_link(apart: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b that differ in at least ``apart`` shingles can link."""
    return (apart * (100 + percent) <= (a + b) * (100 - percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave a link possible."""
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            apart = _apart(chunk.column("sa").to_pylist(), chunk.column("sb").to_pylist())
            ok = _may_link(apart, chunk.column("na").to_numpy(), chunk.column("nb").to_numpy(), percent)
            yield chunk.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a = sketches.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _runs(chunks: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted rows, whole even where they span chunks."""
    rest = None
    for chunk in chunks:
        table = pa.Table.from_batches([chunk])
        rest = table if rest is None else pa.concat_tables([rest, table])
        key = np.stack([rest.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts[:-1]], cuts):
            yield rest.slice(a, b - a)
        if len(cuts):
            rest = rest.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _across(members: DataFrame, found: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that share a signature but not a component and whose sketches leave a
    link possible.

    The sets of a signature are dealt to blocks of about BLOCK; each two blocks meet in one
    task, which compares the sketches as matrices and returns only the pairs that pass. So
    copies of one text with unrelated changes are told apart without forming their pairs,
    and a signature of any number of sets is spread over tasks of bounded size.
    """
    keys = ["signature", "i", "j"]

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(chunks, keys):
            rows = rows.combine_chunks()
            head, part, size, block = (rows.column(c).to_numpy() for c in ("head", "component", "n_shingles", "block"))
            within = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
            if (part == part[0]).all():
                continue
            counts = _counts(rows.column("sketch").to_pylist())
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x in range(len(head)):
                y = np.flatnonzero((head > head[x]) & (part != part[x]) & (within | (block != block[x])))
                y = y[_may_link(np.zeros(1), size[x], size[y], percent)]
                y = y[_may_link(_differences(counts, x, y), size[x], size[y], percent)]
                left.append(np.full(len(y), head[x]))
                right.append(head[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    now = members.select("signature", "head").join(found.withColumnRenamed("node", "head"), "head", "left")
    now = settle(now.select("signature", "head", F.coalesce("component", "head").alias("component")), "placed")
    mixed = now.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = now.join(mixed.select("signature", blocks.alias("blocks")), "signature")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("signature", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "head", "component")
    dealt = dealt.join(sketches.withColumnRenamed("doc_id", "head"), "head")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _comparer(words: int, percent: int):
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(chunks, ["clump", "i", "j"]):
            texts = rows.filter(rows.column("b").is_null())
            ids, kept = texts.column("a").to_pylist(), {}
            for at, raw in batches(texts.column("text").to_pylist()):
                for key, found in zip(ids[at : at + len(raw)], shingle_sets(raw, words)):
                    kept.setdefault(key, []).append(found)
            pairs = rows.filter(rows.column("b").is_valid()).select(["a", "b"])
            near = []
            for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
                near.append(any(_near(s, t, percent) for s in kept[x] for t in kept[y]))
            yield from pairs.filter(pa.array(near, pa.bool_())).to_batches()
            del rows, texts, kept, pairs
        pa.default_memory_pool().release_unused()  # the worker idles on while others work

    return run


def _near(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if not len(s) or not len(t):
        return False
    shared = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
    return 100 * shared >= percent * (len(s) + len(t) - shared)


def _links(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared by their whole texts.

    The documents that pairs connect are one clump, dealt to blocks of about SHINGLES
    shingles. The pairs between two blocks are compared in one place, so a text travels
    once for each block that it has pairs with and not once for each pair.
    """
    keys = ["clump", "i", "j"]
    sizes = sketches.select(F.col("doc_id").alias("node"), "n_shingles")
    nodes = settle(components(pairs).join(sizes, "node"), "clumps")
    blocks = nodes.groupBy("component").agg(F.ceil(F.sum("n_shingles") / SHINGLES).alias("blocks"))
    placed = settle(nodes.join(blocks, "component").select(
        "node", F.col("component").alias("clump"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")), "placed-nodes")
    a = placed.select(F.col("node").alias("a"), "clump", F.col("block").alias("at_a"))
    b = placed.select(F.col("node").alias("b"), F.col("block").alias("at_b"))
    dealt = settle(pairs.join(a, "a").join(b, "b").select(
        "clump", F.least("at_a", "at_b").alias("i"), F.greatest("at_a", "at_b").alias("j"), "a", "b"), "dealt-pairs")
    texts = settle(docs.join(placed.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), "texts")
    needed = dealt.select(*keys, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    rows = texts.join(needed, "doc_id").select(*keys, F.col("doc_id").alias("a"), F.lit(None).cast("bigint").alias("b"), "text")
    rows = rows.unionByName(dealt.withColumn("text", F.lit(None).cast("string")))
    links = settle(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _comparer(words, percent), "a bigint, b bigint"), "links")
    discard(nodes, placed, dealt, texts)
    return links


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Rows link when 100 * shared >= ``percent`` * united shingles of ``words`` words (A-Z
    lower-cased; a text of fewer words is one shingle). component_id is the smallest doc_id
    that links reach. Null or wordless texts have no shingles and link with nothing; so do
    rows without a doc_id (component_id null). Rows that repeat a doc_id count as one
    document in links. An empty table gives an empty result; other columns are ignored.

    Equal sets are one class from the start. Of the classes that share a signature, each
    is first compared with the smallest one; what is then still apart is looked through in
    blocks of sketches, and compared where these allow a link. So groups of any size lose
    no link and yet are not expanded into all their pairs.
    """
    docs = docs.select("doc_id", "text")
    full = settle(docs.mapInArrow(_sketches(words, percent), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, "
                                  "sketch binary, signatures array<bigint>"), "sets")
    rows = settle(full.drop("signatures", "sketch"), "sizes")
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["h1", "h2", "n_shingles"]
    classes = settle(some.groupBy(*same).agg(F.min("doc_id").alias("head"), F.count("*").alias("size")), "classes")
    heads = classes.select(F.col("head").alias("doc_id"))
    kept = settle(full.where("n_shingles > 0").drop("h1", "h2").join(heads, "doc_id", "left_semi"), "signatures")
    discard(full)
    sketches = kept.select("doc_id", "n_shingles", "sketch")
    signed = kept.select(F.col("doc_id").alias("head"), F.explode("signatures").alias("signature"))
    shared = settle(signed.groupBy("signature").agg(F.min("head").alias("low"), F.max("head").alias("high"),
                                                    F.count("*").alias("n")).where("low <> high"), "shared")
    large = shared.where("n > 2").select("signature", "low")
    members = settle(signed.join(large, "signature").select("signature", "low", "head"), "members")
    stars = members.where("head <> low").select(F.col("low").alias("a"), F.col("head").alias("b"))
    pairs = shared.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(stars).distinct()
    pairs = settle(_plausible(pairs, sketches, percent), "pairs")
    links = _links(pairs, docs, sketches, words, percent)
    found = components(links)
    more = settle(_across(members, found, sketches, percent).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    if not more.isEmpty():
        found = components(links.unionByName(_links(more, docs, sketches, words, percent)))

    home = classes.join(found.withColumnRenamed("node", "head"), "head", "left").where("size > 1 OR component IS NOT NULL")
    home = settle(home.select(*same, F.coalesce("component", "head").alias("component")), "homes")
    discard(kept, shared, members, pairs, more)
    out = rows.join(home, same, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
