"""Token ids in binary files: Simple-8b words in blocks that decode without a loop per word.

File layout, all little-endian:

    8 bytes   magic
    3 x u64   documents, ids, blocks
    per document: i64 doc_id, u64 ids
    per block:    u64 place of its first 64-bit word, u32 words, u32 escaped values
    blocks:       coded words, then the escaped values as plain u64

A block holds BLOCK ids of the file's one run of ids (the last block fewer). The top four
bits of a word are its selector. Selector s > 0 says that COUNTS[s] values of WIDTHS[s]
bits follow, lowest first; a word may stand for more values than its block has left, the
rest being zero. Selector 0 stands for one value of more than 60 bits, kept after the words.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import byte_letters
from .scratch import settle

#: Letters of ASCII and Latin-1, in UTF-8: none of them is composed further.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: ASCII punctuation but the apostrophe, which may belong to letters after it.
_STOPS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Such punctuation between a letter and a blank.
_STOP = r"([A-Za-z])([!-&(-/:-@\[-`{-~]+) "
#: The letter by which byte-level files write each byte.
_BYTE_LETTERS = {byte: letter for letter, byte in byte_letters().items()}
_NO_IDS = np.zeros(0, "<u4")
MAGIC = b"S8BTOK01"
# Fixed values of the coding: values per word and bits per value, by selector.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_STEPS = WIDTHS[1:]
#: Ids of a block.
BLOCK = 4096
#: A file is closed after the document that brings it to so many ids.
FILE_IDS = 4_000_000
#: Texts are tokenized together until they have so many characters.
CALL_CHARS = 6_000_000


def _classes(values: np.ndarray) -> np.ndarray:
    """The place in ``_STEPS`` of the least width that holds each value; the last: none."""
    if not len(values) or values.max() < 2**32:
        values = values.astype(np.uint32)
    out = np.zeros(values.shape, np.int8)
    for width in _STEPS:
        if width < 8 * values.itemsize:
            out += values >= values.dtype.type(1 << int(width))
    return out


def encode_blocks(values: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(64-bit words with the escaped values at their end, number of those) of each block.

    A word takes as many values as fit, from the left. The widest class in each window
    of values decides the selector at every place; all blocks then walk along their choices
    together. Blocks are padded with zeros, which fit everywhere.
    """
    n = len(values)
    if not n:
        return []
    blocks, most = -(-n // BLOCK), int(COUNTS.max())
    padded = np.zeros((blocks, BLOCK + most), np.uint64)
    for i in range(blocks):
        part = values[i * BLOCK : (i + 1) * BLOCK]
        padded[i, : len(part)] = part
    need = _classes(padded)
    choice = np.zeros((blocks, BLOCK), np.int8)
    window, reach = need.copy(), 1  # the largest need among so many places from here on
    for s in range(len(COUNTS) - 1, 0, -1):
        while reach < COUNTS[s]:
            step = min(reach, int(COUNTS[s]) - reach)
            window[:, :-step] = np.maximum(window[:, :-step], window[:, step:])
            reach += step
        np.copyto(choice, s, where=window[:, :BLOCK] < s)
    stop = np.full(blocks, BLOCK)
    stop[-1] = n - BLOCK * (blocks - 1)
    block, at, starts, owners = np.arange(blocks), np.zeros(blocks, np.int64), [], []
    while len(at):
        starts.append(at)
        owners.append(block)
        at = at + COUNTS[choice[block, at]]
        on = at < stop[block]
        at, block = at[on], block[on]
    starts, owners = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts, owners = starts[order], owners[order]
    selector = choice[owners, starts].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    flat, place = padded.ravel(), owners * padded.shape[1] + starts
    for s in np.unique(selector[selector > 0]):
        own = np.flatnonzero(selector == s)
        word, first = words[own], place[own]
        for j in range(COUNTS[s]):
            word |= flat[first + j] << np.uint64(j * WIDTHS[s])
        words[own] = word
    cuts = np.searchsorted(owners, np.arange(blocks + 1))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        escaped = flat[place[a:b][selector[a:b] == 0]]
        out.append((np.concatenate([words[a:b], escaped]), len(escaped)))
    return out


def decode_blocks(words: np.ndarray, sizes: np.ndarray, escapes: np.ndarray, ids: int) -> np.ndarray:
    """The values of consecutive blocks. words: of all of them, one after the other; sizes
    and escapes: words and escaped values of each block; ids: values in all of them."""
    total = sizes + escapes
    block = np.repeat(np.arange(len(total)), total)
    inside = np.arange(len(words)) - np.repeat(np.cumsum(total) - total, total)
    coded = inside < sizes[block]
    code, owner = words[coded], block[coded]
    selector = (code >> np.uint64(60)).astype(np.int64)
    # a word that says more values than its block has left is cut there
    count = COUNTS[selector]
    filled = np.cumsum(count)
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    wanted = np.full(len(last), BLOCK)
    wanted[-1] = ids - BLOCK * (len(last) - 1)
    over = np.diff(filled[last], prepend=0) - wanted
    count[last] -= over
    begin = np.cumsum(count) - count
    out = np.zeros(ids, np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == 0:
            out[begin[own]] = words[~coded]  # escaped values stand in the same order
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(COUNTS[s]):
            some = own[count[own] > j]
            out[begin[some] + j] = code[some] >> np.uint64(j * WIDTHS[s]) & mask
    return out


def pack(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    """The content of one file."""
    lengths = np.fromiter(map(len, ids), np.uint64, len(ids))
    blocks = encode_blocks(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint64))
    head = np.array([len(ids), lengths.sum(), len(blocks)], "<u8")
    documents = np.stack([np.array(doc_ids, "<i8").view("<u8"), lengths.astype("<u8")], 1) if ids else np.zeros((0, 2), "<u8")
    index = np.zeros(len(blocks), [("at", "<u8"), ("words", "<u4"), ("escapes", "<u4")])
    if blocks:
        total = np.array([len(w) for w, _ in blocks])
        index["escapes"] = [e for _, e in blocks]
        index["words"] = total - index["escapes"]
        index["at"] = np.cumsum(total) - total
    return b"".join([MAGIC, head.tobytes(), documents.tobytes(), index.tobytes(), *[w.astype("<u8").tobytes() for w, _ in blocks]])


def unpack(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of each document of a file, blocks being decoded sixty-four at a time."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    documents, total, blocks = np.frombuffer(data, "<u8", 3, 8).tolist()
    table = np.frombuffer(data, "<u8", 2 * documents, 32).reshape(-1, 2)
    index = np.frombuffer(data, [("at", "<u8"), ("words", "<u4"), ("escapes", "<u4")], blocks, 32 + 16 * documents)
    words = np.frombuffer(data, "<u8", -1, 32 + 16 * documents + 16 * blocks)
    held, next_block = np.zeros(0, np.uint64), 0
    for doc_id, length in zip(table[:, 0].view("<i8").tolist(), table[:, 1].tolist()):
        parts = [held]
        have = len(held)
        while have < length:
            part = index[next_block : next_block + 64]
            first, end = int(part["at"][0]), int(part["at"][-1]) + int(part["words"][-1]) + int(part["escapes"][-1])
            count = min(total - next_block * BLOCK, len(part) * BLOCK)
            parts.append(decode_blocks(words[first:end], part["words"].astype(np.int64), part["escapes"].astype(np.int64), count))
            have += count
            next_block += len(part)
        run = np.concatenate(parts) if len(parts) > 1 else held
        yield doc_id, run[:length]
        held = run[length:]


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts that are tokenized together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CALL_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def write_files(docs: DataFrame, folder: str, tokens: Callable[[list[str]], list[np.ndarray]]) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to files in ``folder`` in ascending doc_id
    order and return their list: file, part, number, documents, ids, start.

    ``tokens`` gives the ids of whole texts (null counts as empty). Rows are ranged by
    doc_id and sorted, equal doc_ids by text; a null doc_id is an error. start is the number
    of ids in all files before. An empty table writes no file. ``folder`` is a URI that
    pyarrow reaches from every executor. A task that runs twice writes files of other
    names; the list names those of the run that Spark took, and only these are read.
    """
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        doc_ids, ids, held, number, listed = [], [], 0, 0, []

        def close():
            nonlocal doc_ids, ids, held, number
            name = f"{root}/tokens-{part:06d}-{number:06d}-{uuid.uuid4().hex}.s8b"
            with place.open_output_stream(name) as out:
                out.write(pack(doc_ids, ids))
            listed.append({"file": name, "part": part, "number": number, "documents": len(ids), "ids": held})
            doc_ids, ids, held, number = [], [], 0, number + 1

        for chunk in chunks:
            keys, texts = chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist()
            texts = [t or "" for t in texts]
            for i, end in _portions(texts):
                for key, some in zip(keys[i:end], tokens(texts[i:end])):
                    if key is None:
                        raise ValueError("a document without doc_id has no place in the files")
                    doc_ids.append(key)
                    ids.append(some)
                    held += len(some)
                    if held >= FILE_IDS:
                        close()
        if ids:
            close()
        if listed:
            yield pa.RecordBatch.from_pylist(listed, schema=pa.schema(
                [("file", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())]))

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = settle(ordered.mapInArrow(run, "file string, part bigint, number bigint, documents bigint, ids bigint"), "token-files")
    # one row for each FILE_IDS ids: this list is small beside what it lists
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (as little-endian unsigned 32-bit
    integers) of every document in the files of a ``write_files`` list."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = fs.FileSystem.from_uri(folder)
        for chunk in chunks:
            for name, start in zip(chunk.column("file").to_pylist(), chunk.column("start").to_pylist()):
                with place.open_input_stream(name) as data:
                    rows, size = [], 0
                    for doc_id, ids in unpack(data.read()):
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(raw), raw))
                        start += len(ids)
                        size += len(raw)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))

    # a task for each file; without a number Spark would take so few rows for one partition
    dealt = files.select("file", "start").repartition(max(1, files.count()), "file")
    return dealt.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


class WordTokens:
    """Ids by a tokenizer file of the tokenizers library, followed by ``end``.

    For files that lower-case, drop white space and part letters from punctuation: there
    the library works between blanks and line breaks independently, and on ASCII punctuation
    without an apostrophe after a letter apart from that letter. So each worker asks it once
    for each distinct part of a word, and its model alone where that is plain letters of ASCII
    or Latin-1, which the steps before the model only lower-case and write byte by byte. Words
    of ASCII are lower-cased before; others are asked as they are, as the file may compose
    letters before it lower-cases them. The words of a call are told apart and their ids
    gathered by Arrow. It remembers up to REMEMBERED words.

    ``special``: the file's special tokens in a text count as such, as by the library's
    default; else they are text like any other.
    """

    REMEMBERED = 1_000_000

    def __init__(self, path: str, end: int | None, special: bool = False):
        self.path, self.end, self.special = path, end, special
        self.known: dict[bytes, bytes] | None = None

    def _ask(self, parts: list[bytes]) -> None:
        other = []
        for part in parts:
            if _LETTERS.fullmatch(part):
                written = part.decode().lower()
                if not written.isascii():
                    written = written.encode().decode("latin-1").translate(_BYTE_LETTERS)
                self.known[part] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written)])
            else:
                other.append(part)
        for i in range(0, len(other), 20_000):
            some = other[i : i + 20_000]
            found = self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)
            for part, ids in zip(some, found):
                self.known[part] = np.array(ids.ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        cuts = {word: parts for word in words if (parts := _cut(word)) != (word,)}
        asked = {word for word in words if word not in cuts}.union(*cuts.values())
        self._ask([part for part in asked if part not in self.known])
        for word, parts in cuts.items():
            self.known[word] = b"".join([self.known[part] for part in parts])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.known is None:
            from tokenizers import Tokenizer

            self.known = {}
            self.library = Tokenizer.from_file(self.path)
            added = self.library.get_added_tokens_decoder()
            if self.special and any(not t.special or t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
                raise ValueError("only special tokens that stand for themselves can be cut out of a text")
            self.marks = {t.content: i for i, t in added.items()} if self.special else {}
            self.mark = re.compile("|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))))
            self.library.encode_special_tokens = True  # texts are cut at them before; lower-cased words may look like one
            self.model = self.library.model
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        cut = [self._parts(text) for text in texts]
        raw = [part.encode("utf-8", "replace").replace(b"\n", b" ") for parts in cut for part, _ in parts]
        apart = pc.replace_substring_regex(pa.array(raw, pa.large_binary()), _STOP, r"\1 \2 ")
        words = pc.split_pattern(apart, " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn([word for word in distinct if word not in self.known])
        ids = pa.array(list(map(self.known.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
        _, places, data = ids.buffers()
        flat = np.frombuffer(data, "<u4") if data is not None and data.size else np.zeros(0, "<u4")
        ends = np.frombuffer(places, "<i8")[words.offsets.to_numpy()] // 4 if len(ids) else np.zeros(len(raw) + 1, int)
        out, at = [], 0
        for parts in cut:
            run = []
            for _, mark in parts:
                run += [flat[ends[at] : ends[at + 1]], mark]
                at += 1
            out.append(np.concatenate([*run, self._closing]))
        return out

    @cached_property
    def _closing(self) -> np.ndarray:
        return np.array([] if self.end is None else [self.end], "<u4")

    def _parts(self, text: str) -> list[tuple[str, np.ndarray]]:
        """(text, id of the special token after it or nothing), part by part."""
        if not any(mark in text for mark in self.marks):
            return [(text, _NO_IDS)]
        out, at = [], 0
        for hit in self.mark.finditer(text):
            out.append((text[at : hit.start()], np.array([self.marks[hit.group()]], "<u4")))
            at = hit.end()
        return [*out, (text[at:], _NO_IDS)]


def _cut(word: bytes) -> tuple[bytes, ...]:
    """The parts of a word that the library treats apart, lower-cased where they are ASCII."""
    if _LETTERS.fullmatch(word):
        return (word.lower() if word.isascii() else word,)
    head = word.rstrip(_STOPS)
    if len(head) < len(word) and (head[-1:].isalpha() or _LETTERS.fullmatch(head)):
        parts = (head, word[len(head) :])
    else:
        parts = (word,)
    return tuple([part.lower() if part.isascii() else part for part in parts])


@cache
def word_tokens(path: str, end: int | None) -> WordTokens:
    """One per worker process."""
    return WordTokens(path, end, special=True)
