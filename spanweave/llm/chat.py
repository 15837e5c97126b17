"""Conversations as marked text with a mask of what a model is to learn.

A formatted turn is its head, its text and its foot:

    [SYS] text [/SYS]       [INST] text [/INST]       [ANSWER] text</s>       [TURN]role[/ROLE] text [/TURN]

for the roles system, user, assistant and any other. A mark that a text or a role holds
itself, with any number of backslashes after its bracket, gets one backslash more, so that
no text holds a mark and taking one backslash away gives the text again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle

# Fixed values of the template.
HEADS = {"system": "[SYS] ", "user": "[INST] ", "assistant": "[ANSWER] "}
FEET = {"system": " [/SYS]", "user": " [/INST]", "assistant": "</s>"}
OTHER_HEAD, ROLE_END, OTHER_FOOT = "[TURN]", "[/ROLE] ", " [/TURN]"
#: A mark with any number of backslashes, as in RE2, Java and Python.
MARK = r"([\[<])(\\*)((?:/?(?:SYS|INST|TURN)|ANSWER|/ROLE)\]|/?s>)"
_WRITTEN = re.compile(r"([\[<])\\(\\*(?:(?:/?(?:SYS|INST|TURN)|ANSWER|/ROLE)\]|/?s>))")
_TURN = re.compile(r"\[SYS\] (.*?) \[/SYS\]|\[INST\] (.*?) \[/INST\]|\[ANSWER\] (.*?)</s>|\[TURN\](.*?)\[/ROLE\] (.*?) \[/TURN\]", re.S)
_ROLES = ("system", "user", "assistant")
#: Bytes of text that a task formats at a time.
RUN_BYTES = 4_000_000
#: Segments of at least so many bytes are copied as slices, shorter ones by their indices.
SLICE = 4096


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, MARK, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _WRITTEN.sub(r"\1\2", text)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each string starts (and the last ends)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns (string arrays without nulls) in one buffer: its bytes, where
    each turn starts (and the last ends), and where its text starts and ends.

    A turn has three segments. Their lengths give, by a running sum, the place of each in
    the result, and with the place of each source the index of every byte of it.
    """
    places = np.array([_ROLES.index(r) if r in _ROLES else 3 for r in pc.unique(roles).to_pylist()])
    kind = places[pc.index_in(roles, pc.unique(roles)).to_numpy(zero_copy_only=False)] if len(roles) else np.zeros(0, np.int64)
    named = pc.binary_join_element_wise(OTHER_HEAD, escape(roles), ROLE_END, "")
    heads = pc.if_else(pa.array(kind == 3, pa.bool_()), named, pa.array([*HEADS.values(), ""]).take(pa.array(kind)))
    feet = pa.array([*FEET.values(), OTHER_FOOT])
    sources = [_bytes_of(heads), _bytes_of(escape(texts)), _bytes_of(feet)]
    starts, lengths = np.zeros((len(kind), 3), np.int64), np.zeros((len(kind), 3), np.int64)
    base = 0
    for i, (data, offsets) in enumerate(sources):
        take = kind if i == 2 else slice(None)
        starts[:, i], lengths[:, i] = offsets[:-1][take] + base, np.diff(offsets)[take]
        base += len(data)
    pool = np.concatenate([data for data, _ in sources])
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape) if len(kind) else lengths
    out = np.empty(int(ends[-1, -1]) if len(kind) else 0, np.uint8)
    begins = ends - lengths
    short = lengths < SLICE
    span = lengths[short]
    within = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
    out[np.repeat(begins[short], span) + within] = pool[np.repeat(starts[short], span) + within]
    for row, part in zip(*np.nonzero(~short)):
        out[begins[row, part] : ends[row, part]] = pool[starts[row, part] : starts[row, part] + lengths[row, part]]
    return out, np.append(begins[:, 0], len(out)), np.stack([begins[:, 1], ends[:, 1]], axis=1)


_BLOCK = "conv_id bigint, part int, number int, alone boolean, formatted string, learn_from array<int>, learn_to array<int>"


def _runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of text, and at least one row."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    yield from ((i, j) for i, j in zip(edges[:-1], edges[1:]) if j > i)


def format_chats(turns: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The formatted conversations of ``turns`` (conv_id, turn, role, text), stored and read
    back, in blocks: conv_id, part and number (which order a conversation's blocks), alone
    (it certainly has no other block), formatted, and the mask: learn_from and learn_to, the
    code points of ``formatted`` between which assistant texts lie.

    Rows are ordered by conv_id and turn, equal ones by role and text; null conv_id is a
    conversation of its own, a null turn comes first, a null role counts as an empty one and
    a null text as empty. Other columns are dropped; an empty table gives no block. Rows are
    ranged by (conv_id, turn) and a task formats ``run_bytes`` at a time, so a conversation of
    any length is formatted by many tasks in many blocks.
    """
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for chunk in chunks:
            ids, roles, texts = chunk.column("conv_id"), pc.fill_null(chunk.column("role"), ""), pc.fill_null(chunk.column("text"), "")
            for i, j in _runs(texts, run_bytes):
                out, starts, spans = assemble(roles[i:j], texts[i:j])
                keys = ids[i:j].to_pylist()
                begin = np.array([0, *(k for k in range(1, j - i) if keys[k] != keys[k - 1])])
                edges = np.append(starts[begin], len(out))
                points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
                learned = np.flatnonzero(pc.equal(roles[i:j], "assistant").to_numpy(zero_copy_only=False))
                home = np.searchsorted(begin, learned, "right") - 1
                counts = pa.array(np.append(np.searchsorted(learned, begin), len(learned)), pa.int32())
                mask = [pa.ListArray.from_arrays(counts, pa.array(points[spans[learned, k]] - points[edges[home]], pa.int32())) for k in (0, 1)]
                alone = np.ones(len(begin), bool)
                alone[[0, -1]] = False  # these may go on in the run or task before or after
                formatted = pa.StringArray.from_buffers(len(begin), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[k] for k in begin], pa.int64()), pa.array(np.full(len(begin), part, np.int32)),
                     pa.array(np.arange(number, number + len(begin), dtype=np.int32)), pa.array(alone), formatted, *mask],
                    ["conv_id", "part", "number", "alone", "formatted", "learn_from", "learn_to"])
                number += len(begin)

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return settle(ordered.select("conv_id", "role", "text").mapInArrow(run, _BLOCK), "chat-blocks")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of formatted conversations."""
    at = 0
    for hit in _TURN.finditer(formatted):
        if hit.start() != at:
            raise ValueError("text between turns")
        at = hit.end()
        i = hit.lastindex
        if i <= 3:
            yield _ROLES[i - 1], unescape(hit.group(i))
        else:
            yield unescape(hit.group(4)), unescape(hit.group(5))
    if at != len(formatted):
        raise ValueError("text after the turns")


def read_chats(blocks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each
    conversation in the blocks of ``format_chats``: turns and texts as parsed from the
    formatted text, the loss text as cut out by the mask.

    Blocks that are alone are read where they lie. The others are dealt by conv_id and
    read in order; digests run on from block to block, so a task holds one block at a time.
    """
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def out():
            rows = [(i, n, a.hexdigest(), c, b.hexdigest(), p) for i, n, a, c, b, p in done]
            columns = [[row[k] for row in rows] for k in range(6)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for chunk in chunks:
            names = ("conv_id", "alone", "formatted", "learn_from", "learn_to")
            for conv_id, alone, formatted, begins, ends in zip(*(chunk.column(n).to_pylist() for n in names)):
                if state is None or alone or state[0] != conv_id:
                    if state is not None:
                        done.append(state)
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for i, j in zip(begins, ends):
                    learned = unescape(formatted[i:j])
                    state[3] += len(learned)
                    state[4].update(learned.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
            if len(done) > 1000:
                yield out()
                done = []
        if state is not None:
            done.append(state)
            yield out()

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    parted = blocks.where("NOT alone").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return blocks.where("alone").mapInArrow(run, schema).unionByName(parted.mapInArrow(run, schema))
