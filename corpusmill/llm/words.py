"""Words of Arrow UTF-8 buffers: bytes are classed by a table, borders are differences of classes.

A word is a run of digits, letters a to z (A to Z are lowered first) and bytes outside ASCII. As no ASCII
byte occurs inside another code point, classes of bytes give the same words as classes of code points.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is cut between two words.
BLOCK = 8 << 20

#: What each byte is lowered to, and whether it belongs to words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True


@dataclass
class Block:
    """Words of some texts, or of a part of one: their lowered bytes, borders, and the row that each belongs to.

    The words from `counted` on come again in the next block, which goes on with the same text.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    counted: int

    @property
    def lengths(self) -> np.ndarray:
        return self.ends - self.starts

    def strings(self) -> pa.Array:
        """The words as an Arrow array."""
        places = np.zeros(len(self.starts) + 1, np.int32)
        np.cumsum(self.lengths, out=places[1:])
        letters = self.data[INSIDE[self.data]]
        return pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(places), pa.py_buffer(letters)])


def _block(raw: np.ndarray, offsets: np.ndarray, first_row: int) -> Block:
    inside = INSIDE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # where a text begins, a word may begin and must end
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    row = np.searchsorted(offsets, starts, "right") - 1 + first_row
    return Block(LOWER[raw], starts, ends, row, len(starts))


def blocks(texts: pa.Array, again: int = 0, most: int = BLOCK) -> Iterator[Block]:
    """Blocks of the words of an array of texts; nulls have none.

    Where a long text is cut, the last `again` words of a block begin the next one, too.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        raw = whole[offsets[low] : offsets[high]]
        if len(raw) <= most:
            yield _block(raw, offsets[low : high + 1] - offsets[low], low)
        else:  # one long text
            yield from _parts(raw, low, again, most)
        low = high


def _parts(raw: np.ndarray, row: int, again: int, most: int) -> Iterator[Block]:
    at, size = 0, most
    while True:
        end = at + size
        if end < len(raw):
            gaps = np.flatnonzero(~INSIDE[raw[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else at  # behind the last byte that is in no word
        out = _block(raw[at:end], np.zeros(1, np.int64), row)
        if end >= len(raw):
            yield out
            return
        if len(out.starts) <= again:  # words as long as blocks: a larger one
            size *= 2
            continue
        size = most
        out.counted = len(out.starts) - again
        yield out
        at = at + int(out.starts[out.counted]) if again else end


#: Bytes that all starts advance together; what is longer goes on by itself.
STEPS = 40


def _table() -> np.ndarray:
    """Changes of the reflected CRC-32 by one byte, from its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


TABLE = _table()
ALL = np.uint32(0xFFFFFFFF)


def step(state: np.ndarray, byte) -> np.ndarray:
    """CRC states after one more byte each."""
    return TABLE[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def advance(state: np.ndarray, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after the length[i] bytes from at[i]. Starts are ordered by length, so those still on are a prefix."""
    short = np.minimum(length, STEPS + 1).astype(np.uint8)
    order = np.argsort(STEPS + 1 - short, kind="stable")  # small whole numbers: sorted by radix
    on, place = state[order], at[order]
    alive = np.cumsum(np.bincount(short, minlength=STEPS + 2)[::-1])[::-1]  # alive[k]: starts of at least k bytes
    for k in range(STEPS):
        n = int(alive[k + 1])
        if not n:
            break
        on[:n] = step(on[:n], data[place[:n] + k])
    for i in range(int(alive[STEPS + 1])):
        j = order[i]
        on[i] = zlib.crc32(data[at[j] + STEPS : at[j] + length[j]], int(on[i] ^ ALL)) ^ 0xFFFFFFFF
    out = np.empty_like(on)
    out[order] = on
    return out
