"""Bounded-space online best-fit packing of token sequences.

A task keeps at most OPEN_BINS open bins, found through a bitset keyed by free space: bit f is set while
some open bin has f free slots, so the best bin for a piece of n tokens is the lowest set bit at or
above n. When one bin too many is open, the fullest (the lowest set bit) closes first.

Bins still open at the end of a task are its remainder. Their rows (no text, no ids) are packed again as
whole units by few tasks, so that small tasks don't leave part-filled sequences behind.

Edge cases: a null text is empty and gives one piece that holds only the end token; a document longer
than a sequence is cut at multiples of the capacity; repeated rows are packed as often as they occur;
a null doc_id is carried as null; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.bpe import TEXT_CHARS, WindowMerger, byte_alphabet
from corpusmill.llm.common import MARK, RARE_SPACE, Memo, map_batches, own, plain_word, release, short_and, stored

CAPACITY = 4096
OPEN_BINS = 1024
END_ID = 1
#: Remainder pieces that one task of the second round packs.
PIECES_A_TASK = 100_000
#: Words whose ids a worker remembers, and the longest of them.
MEMO_WORDS = 300_000
MEMO_CHARS = 48


#: What a Latin-1 text without rare white space lacks.
_NOT_PLAIN = rf"[^\x00-\x{{ff}}]|[{RARE_SPACE}]"


class BestFit:
    """Open bins by free space in a bitset; put() returns (bin, offset), and closed bins are gone for good."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.next_bin = 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            where = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, where = self.capacity, self.next_bin
            self.next_bin += 1
        left = free - length
        if left:
            self.by_free[left].append(where)
            self.bits |= 1 << left
            self.count += 1
        return where, self.capacity - free

    def open(self) -> dict[int, int]:
        """bin: tokens in it, of all open bins."""
        return {b: self.capacity - free for free, bins in self.by_free.items() for b in bins}


class WordTokens:
    """Ids of whole texts by the tokenizers library, remembered word by word.

    The vocabulary's pre-tokenizer never joins what ASCII white space separates, so a text's ids are those
    of its words in order. Words new to the memo are merged here in batches if they are plain, else encoded by the
    library.
    """

    _SPLIT = re.compile("[ \t\n\r]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = Memo(MEMO_WORDS, MEMO_CHARS)
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.merger = WindowMerger(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        symbols = {b: c for c, b in byte_alphabet().items()}
        self.start = np.array([model["vocab"][symbols[b]] for b in range(256)], np.int32)
        self.last = np.array([model["vocab"][symbols[b] + model["end_of_word_suffix"]] for b in range(256)], np.int32)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words: plain ones merged here as a batch, others by the library."""
        plain, other = [], []
        for word in words:
            (plain if plain_word(word) and len(word) <= MEMO_CHARS // 2 else other).append(word)
        low = [word.lower().encode() for word in plain]  # all that the normaliser does to them
        out = dict(zip(plain, self.merger.ids(low, self.start, self.last)))
        for word, found in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False)):
            out[word] = np.array(found.ids, "<u4").tobytes()
        return out

    def portions(self, text: str) -> Iterator[list[str]]:
        """The words of a text, TEXT_CHARS of it at a time; one word may be longer."""
        at = 0
        while at < len(text):
            m = self._SPLIT.search(text, at + TEXT_CHARS) if len(text) - at > TEXT_CHARS else None
            yield self._SPLIT.split(text[at : m.start()] if m else text[at:])
            at = m.end() if m else len(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text of any length (little-endian unsigned 32-bit), a portion at a time."""
        return b"".join([b"".join(self.memo.values(words, self.learn)) for words in self.portions(text)])

    def encode_array(self, texts: pa.Array) -> pa.BinaryArray:
        """Ids of each text. Latin-1 texts are cut all at once, in lower case; marks behind a word are a word."""
        texts = pc.fill_null(texts, "")
        plain = short_and(texts, _NOT_PLAIN, TEXT_CHARS)
        some = texts if plain.all() else pc.if_else(pa.array(plain), texts, "")
        some = pc.utf8_lower(pc.replace_substring_regex(some, pattern=MARK, replacement=r"\1 \2\3"))
        out = self.memo.joined(pc.ascii_split_whitespace(some), self.learn)
        if plain.all():
            return out
        return pc.replace_with_mask(out, pa.array(~plain), pa.array([self.encode(texts[int(i)].as_py()) for i in np.flatnonzero(~plain)], pa.binary()))


_WORDS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One memo a Python worker, kept between its tasks."""
    own("packing", _WORDS.clear)
    if path not in _WORDS:
        _WORDS[path] = WordTokens(path)
        release(True)  # the files that it was read from
    return _WORDS[path]


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, open boolean, used bigint"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _pack_texts(tokenizer: str, capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_tokens(tokenizer), BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple]] = defaultdict(list)  # rows of bins that may still be open
        for batch in batches:
            done = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode_array(batch.column(1)).to_pylist()):
                ids += END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(ids[start * 4 : (start + length) * 4])
                    where, offset = packer.put(length)
                    held[where].append((doc_id, piece, start, length, crc, base + where, offset, False, 0))
            still = packer.open()
            for where in [b for b in held if b not in still]:
                done += held.pop(where)
            yield _record(done)
        still = packer.open()
        yield _record([(*row[:7], True, still[where]) for where, rows in held.items() for row in rows])

    return run


def _pack_bins(capacity: int, open_bins: int):
    """Rows in the order of their bin: whole bins are the pieces of this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at, where, shift = BestFit(capacity, open_bins), None, 0, 0
        base = (1 << 62) | (TaskContext.get().partitionId() << 32)
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[5] != at:
                    at = row[5]
                    where, shift = packer.put(row[8])
                out.append((*row[:5], base + where, row[6] + shift, False, 0))
            yield _record(out)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = stored(map_batches(source, _pack_texts(tokenizer, capacity, open_bins), _PIECES), "packed")
    left = first.where("open")
    tasks = max(1, -(-left.count() // PIECES_A_TASK))
    # neighbouring tasks' remainders share a task, whole bins stay together and arrive in order
    again = left.repartitionByRange(tasks, "bin").sortWithinPartitions("bin", "offset") if tasks > 1 else left.coalesce(1).sortWithinPartitions("bin", "offset")
    both = first.where("NOT open").unionByName(map_batches(again, _pack_bins(capacity, open_bins), _PIECES))
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
