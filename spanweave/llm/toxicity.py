"""Toxicity by a small bidirectional gated recurrent network over word and character inputs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, batches, mix

#: Labelled documents of either label that the network is trained on, at most.
SAMPLE = 1500
#: Words in a window, and from one window's start to the next one's.
WINDOW, STRIDE = 64, 32
#: Training documents that hold a word for it to count among those that are tested.
KNOWN = 3
#: Share of the words of a batch whose inputs are left out in training.
DROPPED = 0.3
#: Power of the number of other windows for each toxic one with which these weigh: 0, as they are; 1, both alike.
BALANCE = 0.6
#: Steps of a round, about, where there are windows for more.
STEPS = 40
#: How much of the mean over the steps stays at each step.
MEMORY = 0.995
#: Spread of the first word and trigram vectors; share of a step by which parameters decay.
SMALL, DECAY = 0.02, 0.1
#: Hash buckets of words and of character trigrams; sizes of their vectors and of a state.
WORD_BUCKETS, CHAR_BUCKETS, WIDTH, STATE, ATTENTION = 1 << 14, 1 << 12, 8, 8, 8
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER[9:14] = 32


def new_network(seed: int = 7) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    shapes = {"word": (WORD_BUCKETS, WIDTH), "char": (CHAR_BUCKETS, WIDTH), "attend": (2 * STATE, ATTENTION),
              "focus": (ATTENTION,), "out": (2 * STATE,), "bias": (1,)}
    for way in "fb":
        shapes |= {f"x_{way}": (2 * WIDTH, 3 * STATE), f"u_{way}": (STATE, 3 * STATE), f"c_{way}": (3 * STATE,)}
    net = {k: (draw.normal(0, SMALL if k in ("word", "char") else 0.3, s) if k not in ("bias", "c_f", "c_b") else np.zeros(s)).astype(np.float32)
           for k, s in shapes.items()}
    return net | {"known": np.ones(WORD_BUCKETS, np.float32)}


#: Set before the training, not by it.
_FIXED = ("known",)


class Vocab:
    """The distinct words of some texts: their word bucket, and the buckets of their character
    trigrams (one for each byte, with its neighbours)."""

    def __init__(self, texts: list[bytes]):
        found = Words(texts)
        self.first = found.first
        self.hashed, place, self.number = np.unique(found.hashes(), return_index=True, return_inverse=True)
        self.bucket = (self.hashed % np.uint64(WORD_BUCKETS)).astype(np.int64)
        low = _LOWER[found.data]
        before, after = np.concatenate([[np.uint64(32)], low[:-1]]), np.concatenate([low[1:], [np.uint64(32)]])
        code = before << np.uint64(16) | low << np.uint64(8) | after
        start, length = found.start[place], (found.end - found.start)[place]
        self.cut = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(start - self.cut[:-1], length) + np.arange(self.cut[-1])
        self.trigram = (mix(code[at], 31) % np.uint64(CHAR_BUCKETS)).astype(np.int64)
        self.length = length.astype(np.float32)

    def inputs(self, net: dict[str, np.ndarray]) -> np.ndarray:
        chars = np.add.reduceat(net["char"][self.trigram], self.cut[:-1], 0) if len(self.bucket) else np.zeros((0, WIDTH), np.float32)
        return np.concatenate([net["word"][self.bucket] * net["known"][self.bucket, None], chars / self.length[:, None]], 1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(text number, word numbers or -1) of all overlapping windows; a text has one at least."""
        n = np.diff(self.first)
        count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        at = (self.first[:-1][text] + nth * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < self.first[1:][text][:, None]
        padded = np.append(self.number, -1)
        return text, padded[np.where(inside, at, len(self.number))]


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run_way(px: np.ndarray, ids: np.ndarray, u: np.ndarray, steps, keep: list | None) -> np.ndarray:
    """The states of one direction; px: what each word adds to the gates."""
    s = STATE
    h = np.zeros((len(ids), s), np.float32)
    out = np.zeros((len(ids), ids.shape[1], s), np.float32)
    for t in steps:
        on = ids[:, t] >= 0
        x = px.take(ids[:, t], 0, mode="wrap")  # -1: the last row
        r_in = h @ u
        zr = _gate(x[:, : 2 * s] + r_in[:, : 2 * s])
        z, r = zr[:, :s], zr[:, s:]
        n = np.tanh(x[:, 2 * s :] + r * r_in[:, 2 * s :])
        new = n + z * (h - n)
        if not on.all():
            new = np.where(on[:, None], new, h)
        if keep is not None:
            keep.append((t, on, h, z, r, n, r_in[:, 2 * s :]))
        h = out[:, t] = new
    return out


def forward(net: dict[str, np.ndarray], inputs: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window (row of word numbers, -1: none)."""
    inputs = np.concatenate([inputs, np.zeros((1, 2 * WIDTH), np.float32)])  # for -1
    steps = range(ids.shape[1])
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    states = np.concatenate([_run_way(inputs @ net[f"x_{w}"] + net[f"c_{w}"], ids, net[f"u_{w}"], order, kept[w])
                             for w, order in (("f", steps), ("b", steps[::-1]))], 2)
    on = ids >= 0
    hidden = np.tanh(states @ net["attend"])
    weight = np.where(on, hidden @ net["focus"], -1e9)
    weight = np.exp(weight - weight.max(1, keepdims=True)) * on
    weight = weight / np.maximum(weight.sum(1, keepdims=True), 1e-9)
    pooled = np.einsum("bt,bts->bs", weight, states)
    if keep is not None:
        keep |= {"kept": kept, "states": states, "hidden": hidden, "weight": weight, "pooled": pooled, "inputs": inputs}
    return pooled @ net["out"] + net["bias"][0]


def gradients(net: dict[str, np.ndarray], vocab: Vocab, ids: np.ndarray, label: np.ndarray,
              weight: np.ndarray | None = None, mask: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean log loss of the windows and its gradient in all parameters. ``mask``
    multiplies the inputs of each word."""
    keep: dict = {}
    share = np.full(len(label), 1 / len(label)) if weight is None else weight / weight.sum()
    inputs = vocab.inputs(net)
    logit = forward(net, inputs if mask is None else inputs * mask[:, None], ids, keep)
    loss = float(((np.logaddexp(0, logit) - label * logit) * share).sum())
    d = ((1 / (1 + np.exp(-logit)) - label) * share).astype(np.float32)
    states, hidden, weight, pooled = keep["states"], keep["hidden"], keep["weight"], keep["pooled"]
    g = {"bias": np.array([d.sum()]), "out": pooled.T @ d}
    d_pooled = d[:, None] * net["out"]
    d_states = weight[:, :, None] * d_pooled[:, None, :]
    d_weight = np.einsum("bts,bs->bt", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
    g["focus"] = np.einsum("bt,bta->a", d_score, hidden)
    d_hidden = d_score[:, :, None] * net["focus"] * (1 - hidden**2)
    g["attend"] = np.einsum("bts,bta->sa", states, d_hidden)
    d_states += d_hidden @ net["attend"].T
    d_inputs = np.zeros_like(keep["inputs"])
    s = STATE
    for way, side in (("f", slice(0, s)), ("b", slice(s, 2 * s))):
        u = net[f"u_{way}"]
        d_px = np.zeros((len(keep["inputs"]), 3 * s), np.float32)
        g_u = np.zeros_like(u)
        d_h = np.zeros((len(ids), s), np.float32)
        for t, on, h, z, r, n, un in reversed(keep["kept"][way]):
            d_new = d_h + d_states[:, t, side]
            live = d_new * on[:, None]
            d_n, d_z = live * (1 - z) * (1 - n**2), live * (h - n) * z * (1 - z)
            d_r = d_n * un * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r, d_n], 1)
            d_rec = np.concatenate([d_z, d_r, d_n * r], 1)
            np.add.at(d_px, ids[:, t], d_gates)
            g_u += h.T @ d_rec
            d_h = d_rec @ u.T + live * z + d_new * ~on[:, None]
        d_px[-1] = 0
        g[f"u_{way}"], g[f"c_{way}"] = g_u, d_px.sum(0)
        g[f"x_{way}"] = keep["inputs"].T @ d_px
        d_inputs += d_px @ net[f"x_{way}"].T
    d_inputs = d_inputs[:-1] if mask is None else d_inputs[:-1] * mask[:, None]
    g["word"], g["char"] = np.zeros_like(net["word"]), np.zeros_like(net["char"])
    np.add.at(g["word"], vocab.bucket, d_inputs[:, :WIDTH] * net["known"][vocab.bucket, None])
    per_trigram = d_inputs[:, WIDTH:] / vocab.length[:, None]
    np.add.at(g["char"], vocab.trigram, np.repeat(per_trigram, np.diff(vocab.cut), 0))
    return loss, g


@dataclass(frozen=True)
class _Windows:
    """The windows of labelled documents: their words, documents and word numbers."""

    words: Vocab
    text: np.ndarray
    ids: np.ndarray
    labels: np.ndarray

    def holders(self) -> np.ndarray:
        """For each document and each word bucket in it one (bucket, document) pair."""
        on = self.ids >= 0
        return np.unique(self.words.bucket[self.ids[on]] * len(self.labels) + np.repeat(self.text, on.sum(1)))

    def best(self, scores: np.ndarray) -> np.ndarray:
        """Of each document's windows the one that scores highest."""
        order = np.lexsort((scores, self.text))
        return order[np.append(self.text[order][1:] != self.text[order][:-1], True)]


def _surprise(toxic: np.ndarray, all_: np.ndarray, share: float) -> np.ndarray:
    """How far the share of toxic documents among those that hold a word is from the share of
    all, in standard deviations (as told from the Chernoff bound of its chance); 0 where so
    much would be met by chance among as many words as there are."""
    p = np.clip(toxic / np.maximum(all_, 1), 1e-12, 1 - 1e-12)
    bound = all_ * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
    return np.where(bound >= np.log(max(2, (all_ >= KNOWN).sum())), np.sign(p - share) * np.sqrt(2 * np.maximum(bound, 0)), 0)


def _fit(held: _Windows, rounds: int, batch: int, step: float, seed: int) -> dict[str, np.ndarray]:
    """A network for labelled documents. A toxic document is stood for by the window that
    scores highest, at first by how much more often its words occur in toxic documents; of
    the others any window is an example, so two more are drawn. Only words that tell the labels
    apart beyond chance have a vector of their own, which starts from how much they do; words are
    left out at random, the rarer label weighs more, parameters decay: else a network learns by
    heart which rare words stood in the few toxic documents."""
    net, draw = new_network(seed), np.random.default_rng(seed)
    pairs = held.holders()
    bucket, doc = pairs // len(held.labels), pairs % len(held.labels)
    toxic = held.labels[doc] > 0
    with_, without = np.bincount(bucket[toxic], minlength=WORD_BUCKETS), np.bincount(bucket[~toxic], minlength=WORD_BUCKETS)
    more = _surprise(with_, with_ + without, (held.labels > 0).mean())
    net["known"] = (more != 0).astype(np.float32)
    net["word"][:, 0] += np.clip(more / 4, -3, 3)
    told = np.maximum(more, 0)[held.words.bucket]
    scores = np.append(told, 0)[held.ids].max(1)
    toxic_rows, plain = np.flatnonzero(held.labels[held.text] > 0), np.flatnonzero(held.labels[held.text] == 0)
    slot = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in net.items() if k not in _FIXED}
    mean = {k: p.copy() for k, p in net.items()}  # over the last steps: steadier than any one of them
    t = 0
    for turn in range(rounds):
        nth = np.lexsort((draw.random(len(plain)), held.text[plain]))
        place = np.arange(len(plain)) - np.searchsorted(held.text[plain][nth], held.text[plain][nth])
        use = np.union1d(held.best(scores), plain[nth[place < 2]])
        use = draw.permutation(use)
        label = held.labels[held.text[use]]
        weight = np.where(label > 0, max(1, (label == 0).sum()) / max(1, (label > 0).sum()), 1.0) ** BALANCE
        size = max(batch, len(use) // STEPS)
        for i in range(0, len(use), size):
            some, local = _subset(held.words, held.ids[use[i : i + size]])
            mask = (draw.random(len(some.bucket)) >= DROPPED).astype(np.float32)
            _, g = gradients(net, some, local, label[i : i + size].astype(np.float32), weight[i : i + size], mask)
            t += 1
            for k, (m, v) in slot.items():
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] ** 2 - v)
                net[k] -= step * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7) + (DECAY * net[k] if k not in ("bias", "c_f", "c_b") else 0))
                mean[k] += max(1 - MEMORY, 1 / (t + 1)) * (net[k] - mean[k])
        again = toxic_rows if turn % 3 else np.arange(len(scores))  # the windows of other documents are many, and each an example
        scores[again] = _in_blocks(mean, held.words.inputs(mean), held.ids[again])
    return mean


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 8, batch: int = 16, step: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """A network for documents whose label says whether any part of them is toxic.

    The rarer label weighs more in the training, so a score is a probability among documents
    of which more are toxic than among those given. A step takes ``batch`` windows, or more where there are many. Documents
    of one label alone give that label's share as the score of every text. Adam, fixed seed.
    """
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        net = new_network(seed)
        share = labels.mean() if len(labels) else 0.0
        net["out"][:] = 0
        net["bias"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    return _fit(_Windows(*_all_windows(texts), labels), rounds, batch, step, seed)


def _all_windows(texts: list[bytes], size: int = 400_000) -> tuple[Vocab, np.ndarray, np.ndarray]:
    """The words of all texts, and the text and word numbers of all windows. Texts are taken
    about ``size`` bytes at a time, as hashing them needs many times their own memory."""
    parts, text, ids, words, at = [], [], [], 0, 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= size):
            held += len(texts[end])
            end += 1
        part = Vocab(texts[at:end])
        nth, local = part.windows()
        text.append(nth + at)
        ids.append(np.where(local >= 0, local + words, -1).astype(np.int32))
        words += len(part.bucket)
        del part.number
        parts.append(part)
        at = end
    every = object.__new__(Vocab)
    every.bucket, every.length = (np.concatenate([getattr(p, k) for p in parts]) for k in ("bucket", "length"))
    every.trigram = np.concatenate([p.trigram for p in parts])
    every.cut = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.cut) for p in parts]))])
    _, place, number = np.unique(np.concatenate([p.hashed for p in parts]), return_index=True, return_inverse=True)
    ids = np.concatenate(ids)
    ids = np.where(ids >= 0, np.append(number, -1)[ids], -1).astype(np.int32)
    return _words(every, place), np.concatenate(text), ids


def _words(vocab: Vocab, words: np.ndarray) -> Vocab:
    some = object.__new__(Vocab)
    some.bucket, some.length = vocab.bucket[words], vocab.length[words]
    size = np.diff(vocab.cut)[words]
    some.cut = np.concatenate([[0], np.cumsum(size)])
    some.trigram = vocab.trigram[np.repeat(vocab.cut[:-1][words] - some.cut[:-1], size) + np.arange(some.cut[-1])]
    return some


def _subset(vocab: Vocab, ids: np.ndarray) -> tuple[Vocab, np.ndarray]:
    """The words of some windows alone, and the windows in their numbers."""
    words = np.unique(ids[ids >= 0])
    return _words(vocab, words), np.where(ids >= 0, np.searchsorted(words, ids), -1)


def _in_blocks(net: dict[str, np.ndarray], inputs: np.ndarray, ids: np.ndarray, rows: int = 4096) -> np.ndarray:
    return np.concatenate([forward(net, inputs, ids[i : i + rows]) for i in range(0, len(ids), rows)])


def score_texts(net: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """For each text the highest probability among all its windows."""
    vocab = Vocab(texts)
    text, ids = vocab.windows()
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, text, _in_blocks(net, vocab.inputs(net), ids))
    return 1 / (1 + np.exp(-np.clip(best, -60, 60)))


@dataclass(frozen=True)
class Sample:
    texts: list[bytes]
    labels: np.ndarray


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", size: int = SAMPLE) -> Sample:
    """Texts and labels of at most ``size`` documents of either label, the first ones in the
    order of a hash of doc_id. Null labels and texts are left out."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL")
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    got = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # 2 * size rows at most
    found = sorted((r["doc_id"], r["label"], r["text"]) for r in got.toArrow().to_pylist())
    return Sample([t.encode("utf-8", "surrogatepass") for _, _, t in found], np.array([k for _, k, _ in found], float))


def score(docs: DataFrame, net: dict[str, np.ndarray]) -> DataFrame:
    """doc_id and score (0 to 1) for each row of ``docs`` (doc_id, text): the score of the
    most toxic window of the whole text. Null and empty texts are one window without words.
    Rows are scored one by one, repeated ones alike; other columns are ignored."""
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            for at, raw in batches(chunk.column("text").to_pylist(), 1_500_000):
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc_id").slice(at, len(raw)), pa.array(score_texts(net, raw))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
