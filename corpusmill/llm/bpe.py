"""Byte-pair encoding as a bounded-lookahead streaming transducer, and an incremental decoder.

Lookahead. Let the bytes from some place on be unknown. Merging in rank order, what is unknown spreads to
the left only when a rule (A, B) joins the known token A, which ends where the unknown part begins, to a
B that begins there; it spreads by len(A). A later rule (A2, B2) spreads it on only if its rank is
higher and the token that now begins at the border, A, lies on the left edge of B2. So the heaviest chain
of rules with rising ranks, each A on the left edge of the next B, bounds how far to the left unknown
bytes can change tokens: `sufficient_lookahead` computes that bound from the merge list. A stream's known bytes
are its state: the tokens of a chain must stand before its border one after the other, so `Lookahead` follows
the chains that these bytes allow, and how far the farthest one gets is all that the state needs; mostly a few bytes.

Transducer. Streams of bytes, each a pre-token with its end, run side by side, a row each. In every step a row
reads on until its window is full or its end is read; the windows are merged; tokens that end at least the row's
lookahead before the window's end are stable, all of them if the end is read. Stable tokens are emitted and their bytes
leave. No merge crosses the border of a final token, so the rest can be merged by itself in the next step. A row
that has nothing stable reads on with a wider window. Windows are bounded by twice the sufficient lookahead, so
memory is constant in the length of texts.

Edge cases: a null text is empty and has no tokens; special tokens written in a text become their ids, as
the library does by default; repeated rows are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import MARK, RARE_SPACE, Memo, array_udf, own, plain_word, release, short_and

#: Bytes merged at a time beyond the lookahead.
BLOCK_BYTES = 512
#: Chunks whose ids a worker remembers.
MEMO_SIZE = 800_000
#: Longest chunk that is worth remembering.
MEMO_CHARS = 48
#: Widths of window batches; longer pre-tokens take several windows.
WIDTHS = (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64)
#: Windows merged at a time: their matrices stay in a core's cache.
ROWS = 4096
#: Characters of a text, and of a chunk without a cut, read at a time.
TEXT_CHARS = 1 << 20
PORTION_CHARS = 1 << 14
#: Characters at a portion's end on which the cut before them can depend.
MARGIN = 8


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet, extra = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            alphabet[chr(extra)] = b
            extra += 1
    return alphabet


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes after a token's end that decide it for good, whatever it is: the heaviest chain of rules (see above)."""
    left_of = {a + b: a for a, b in merges}
    best: dict[str, int] = {}
    for a, b in merges:  # in rank order: chains through earlier rules are complete
        chain, edge = 0, b
        while edge is not None:
            chain = max(chain, best.get(edge, 0))
            edge = left_of.get(edge)
        best[a] = max(best.get(a, 0), len(a) + chain)
    return max(best.values(), default=0)


class Lookahead:
    """How far before the end of known bytes what follows them can change tokens."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]]):
        """tokens: id of each token's bytes; merges: left, right and joined id of each rule, in rank order."""
        self.tokens, self.longest = tokens, max(map(len, tokens), default=0)
        self.first: dict[int, int] = {}  # the least rank of the rules that a token is the left side of
        self.onward: dict[int, list[int]] = {}  # ranks of the rules (A2, B2) with A on the left edge of B2, by A2 and A
        left_of = {joined: left for left, _, joined in merges}
        for rank, (left, right, _) in enumerate(merges):
            self.first.setdefault(left, rank)
            edge: int | None = right
            while edge is not None:
                self.onward.setdefault(left << 32 | edge, []).append(rank)
                edge = left_of.get(edge)

    def _before(self, known: bytes, end: int) -> Iterator[tuple[int, int]]:
        """Where a token begins that ends there, and its id."""
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            if (token := self.tokens.get(known[start:end])) is not None:
                yield start, token

    def of(self, known: bytes) -> int:
        """The bytes that the farthest chain covers: of each place and token only the least rank needs to go on."""
        least: dict[tuple[int, int], int] = {}
        todo = [(start, token, self.first[token]) for start, token in self._before(known, len(known)) if token in self.first]
        while todo:
            at, token, rank = todo.pop()
            if least.get((at, token), rank + 1) <= rank:
                continue
            least[at, token] = rank
            for start, before in self._before(known, at):
                ranks = self.onward.get(before << 32 | token)
                if ranks and ranks[-1] > rank:
                    todo.append((start, before, ranks[bisect_right(ranks, rank)]))
        return len(known) - min((at for at, _ in least), default=len(known))


class Vocabulary:
    """A byte-level BPE vocabulary file: ids, ranks, special tokens and the lookahead of its merge list."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        alphabet = byte_alphabet()
        self.lookahead = sufficient_lookahead(merges)
        self.of_byte = {b: c for c, b in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(alphabet[c] for c in token) for token, i in self.ids.items()}
        self.bytes |= {i: token.encode() for token, i in self.special.items()}


class Transducer:
    """Streams of bytes to ids. run() takes many whole streams, a row each; feed() and finish() one, a portion at a time.

    `emitted` counts the ids of the emission step, through which every id comes.
    """

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK_BYTES):
        self.vocabulary, self.limit = vocabulary, vocabulary.lookahead + block
        self.start = [vocabulary.ids[vocabulary.of_byte[b]] for b in range(256)]
        self.sizes = np.zeros(max(vocabulary.bytes) + 2, np.int32)  # the last is that of padding
        for i, raw in vocabulary.bytes.items():
            self.sizes[i] = len(raw)
        self.rules = {(vocabulary.ids[a], vocabulary.ids[b]): (rank, vocabulary.ids[a + b]) for (a, b), rank in vocabulary.rank.items()}
        self.windows = WindowMerger(vocabulary.ids, list(vocabulary.rank))
        self._starts = np.array(self.start, np.int32)
        self.buffer, self.emitted, self.widest = b"", 0, 0

    def merge(self, window: bytes) -> list[int]:
        """Merges in rank order, equal ranks from the left: a heap of places over a linked list. For wide windows."""
        tokens: list = [self.start[b] for b in window]
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rules = self.rules
        heap = [(rule[0], i, pair, rule[1]) for i, pair in enumerate(zip(tokens, tokens[1:])) if (rule := rules.get(pair))]
        heapify(heap)
        while heap:
            _, i, (left, right), joined = heappop(heap)
            j = after[i]
            if tokens[i] != left or j >= n or tokens[j] != right:
                continue  # one of the two is gone
            tokens[i], tokens[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if rule := rules.get((joined, tokens[k])):
                    heappush(heap, (rule[0], i, (joined, tokens[k]), rule[1]))
            if (h := before[i]) >= 0 and (rule := rules.get((tokens[h], joined))):
                heappush(heap, (rule[0], h, (tokens[h], joined), rule[1]))
        return [t for t in tokens if t is not None]

    @cached_property
    def states(self) -> Lookahead:
        """Made when a stream is longer than its window, for the first time."""
        ids = self.vocabulary.ids
        tokens = {raw: i for i, raw in self.vocabulary.bytes.items() if i not in self.vocabulary.special.values()}
        return Lookahead(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in self.vocabulary.rank])

    def lookahead(self, known: bytes) -> int:
        """How far before their end bytes that follow these can change tokens."""
        return self.states.of(known)

    def emit(self, tokens: np.ndarray, until: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The emission step: of merged rows (padded with -1) the ids of the tokens that end by `until`, and their bytes' number."""
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes, 1)
        stable = (tokens >= 0) & (ends <= until[:, None])
        counts = stable.sum(1)
        self.emitted += int(counts.sum())
        raw, width = tokens.astype("<u4").tobytes(), tokens.shape[1] * 4
        read = np.where(counts > 0, ends[np.arange(len(tokens)), np.maximum(counts - 1, 0)], 0)
        return [raw[k * width : k * width + n * 4] for k, n in enumerate(counts.tolist())], read

    def _step(self, windows: list[bytes], until: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Merges windows and emits what ends by `until`."""
        out: list[bytes] = [b""] * len(windows)
        read = np.zeros(len(windows), np.int64)
        lengths = np.array([len(w) for w in windows])
        self.widest = max(self.widest, int(lengths.max(initial=0)))
        for chosen, tokens in self.windows.merged(windows, self._starts):
            ids, done = self.emit(tokens, until[chosen])
            read[chosen] = done
            for i, x in zip(chosen.tolist(), ids):
                out[i] = x
        for i in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            ids, done = self.emit(np.array([self.merge(windows[i])], np.int64), until[i : i + 1])
            out[i], read[i] = ids[0], done[0]
        return out, read

    def run(self, streams: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each whole stream."""
        out: list[list[bytes]] = [[] for _ in streams]
        first = lambda raw: WIDTHS[-1] if len(raw) <= 4 * WIDTHS[-1] else self.limit
        rows = [(i, 0, first(raw)) for i, raw in enumerate(streams) if raw]  # stream, place, width of the window
        while rows:
            windows = [streams[i][at : at + width] for i, at, width in rows]
            ended = np.array([at + len(w) == len(streams[i]) for (i, at, _), w in zip(rows, windows)])
            until = np.array([len(w) for w in windows])
            for k in np.flatnonzero(~ended).tolist():
                until[k] -= self.lookahead(windows[k])
            ids, read = self._step(windows, until)
            more = []
            for k, ((i, at, width), x, n) in enumerate(zip(rows, ids, read.tolist())):
                out[i].append(x)
                if not ended[k]:
                    more.append((i, at + n, width if n else 2 * width))
            rows = more
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def feed(self, raw: bytes) -> bytes:
        """Ids that no later byte can change, of one stream."""
        out: list[bytes] = []
        for k in range(0, len(raw), BLOCK_BYTES):
            self.buffer += raw[k : k + BLOCK_BYTES]
            while len(self.buffer) > self.limit:
                window = self.buffer[: self.limit]
                ids, read = self._step([window], np.array([len(window) - self.lookahead(window)]))
                out += ids
                self.buffer = self.buffer[int(read[0]) :]
        return b"".join(out)

    def finish(self) -> bytes:
        """The rest of the stream that was fed."""
        out = self.run([self.buffer])[0]
        self.buffer = b""
        return out


class WindowMerger:
    """Merges many short windows at once: one matrix row a window, one merge a row and step, lowest rank first.

    Rules are found through an open-addressing table over pairs of ids.
    """

    _SLOTS = 18

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]):
        self.none = np.int32(2**31 - 1)
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.uint64)
        self.joined = np.array([ids[a + b] for a, b in merges], np.int32)
        size = 1 << self._SLOTS
        self.keys, self.ranks = np.full(size, np.uint64(2**64 - 1)), np.full(size, self.none, np.int32)
        rank, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(rank):  # each round places the first of those that want a free slot; the rest move on
            free = self.keys[at] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[slots], self.ranks[slots] = keys[rank[chosen]], rank[chosen]
            rest = np.ones(len(rank), bool)
            rest[chosen] = False
            rank, at = rank[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._SLOTS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; `none` where there is no rule or a side is padding (-1)."""
        out = np.full(left.shape, self.none, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[todo].astype(np.uint64) << np.uint64(32)) | right.ravel()[todo].astype(np.uint64)
        at, flat = self._slot(keys), out.reshape(-1)
        while len(todo):
            there = self.keys[at]
            hit = there == keys
            flat[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (there != np.uint64(2**64 - 1))
            todo, keys, at = todo[more], keys[more], (at[more] + 1) & ((1 << self._SLOTS) - 1)
        return out

    def merge(self, tokens: np.ndarray) -> np.ndarray:
        """tokens: a row a window, padded with -1; the rows after all merges, padded likewise."""
        done = np.full(tokens.shape, -1, np.int32)
        rows, width = np.arange(len(tokens)), tokens.shape[1]
        if width < 2:
            return tokens
        ranks, columns = self.rank(tokens[:, :-1], tokens[:, 1:]), np.arange(width)
        while True:
            at = ranks.argmin(1)
            least = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            live = least != self.none
            if not live.all():
                done[rows[~live]] = tokens[~live]
                rows, tokens, ranks, at, least = rows[live], tokens[live], ranks[live], at[live], least[live]
            if not len(rows):
                return done
            each = np.arange(len(rows))
            source = columns[None, :] + (columns[None, :] > at[:, None])
            source[source == width] = 0
            tokens = np.take_along_axis(tokens, source, 1)
            tokens[:, -1] = -1
            tokens[each, at] = self.joined[least]
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], width - 2), 1)
            ranks[:, -1] = self.none
            ranks[each, np.minimum(at, width - 2)] = self.none
            inner = at < width - 1
            ranks[each[inner], at[inner]] = self.rank(tokens[each[inner], at[inner]], tokens[each[inner], at[inner] + 1])
            first = at > 0
            ranks[each[first], at[first] - 1] = self.rank(tokens[each[first], at[first] - 1], tokens[each[first], at[first]])

    def merged(self, windows: list[bytes], start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows of bytes merged, those of about one width at a time: their numbers, and rows of ids padded with -1."""
        lengths = np.array([len(w) for w in windows])
        for low, high in zip((0, *WIDTHS), WIDTHS):
            chosen = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in (chosen[i : i + ROWS] for i in range(0, len(chosen), ROWS)):
                size = lengths[part]
                tokens = np.full((len(part), int(size.max())), -1, np.int32)
                tokens[np.arange(tokens.shape[1])[None, :] < size[:, None]] = start[np.frombuffer(b"".join([windows[i] for i in part]), np.uint8)]
                yield part, self.merge(tokens)

    def ids(self, windows: list[bytes], start: np.ndarray, last: np.ndarray | None = None) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of windows of bytes; start: id of each byte, last: id of a final byte."""
        out: list[bytes] = [b""] * len(windows)
        lengths = np.array([len(w) for w in windows])
        for low, high in zip((0, *WIDTHS), WIDTHS):
            chosen = np.flatnonzero((lengths > low) & (lengths <= high))
            if not len(chosen):
                continue
            size = lengths[chosen]
            flat = np.frombuffer(b"".join([windows[i] for i in chosen]), np.uint8)
            tokens = np.full((len(chosen), int(size.max())), -1, np.int32)
            tokens[np.arange(tokens.shape[1])[None, :] < size[:, None]] = start[flat]
            if last is not None:
                tokens[np.arange(len(chosen)), size - 1] = last[flat[np.cumsum(size) - 1]]
            tokens = np.concatenate([self.merge(tokens[i : i + ROWS]) for i in range(0, len(tokens), ROWS)])
            raw, width, kept = tokens.astype("<u4").tobytes(), tokens.shape[1] * 4, (tokens >= 0).sum(1) * 4
            for k, (i, n) in enumerate(zip(chosen.tolist(), kept.tolist())):
                out[i] = raw[k * width : k * width + n]
        return out


#: Marks a chunk key that is the chunk itself.
RAW = "\0"
#: What a text of single spaces and line ends between words lacks; < may begin a special token.
_UNEVEN = rf"[{RAW}\t\r<{RARE_SPACE}]|  |\n\n| \n|\n "
#: White space that can be cut before a space and a word.
_SAFE = re.compile(r" (?=\S)")


class Encoder:
    """Ids of whole texts, as the library gives them.

    A text is cut before each space that a non-space follows, where the pre-tokenizer always cuts too. What
    the transducer emitted for a short chunk is remembered (memo=0: nothing is); other chunks are cut into
    pre-tokens (plain ones here, others by the library's pre-tokenizer), which run through the transducer. Texts and
    chunks without a cut are read a portion at a time.
    """

    def __init__(self, path: str, block: int = BLOCK_BYTES, memo: int = MEMO_SIZE):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.transducer = Transducer(self.vocabulary, block)
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.memo = Memo(memo, MEMO_CHARS) if memo else None
        special = self.vocabulary.special
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._byte = {c: bytes([b]) for b, c in self.vocabulary.of_byte.items()}

    def _raw(self, symbols: str) -> bytes:
        return b"".join([self._byte[c] for c in symbols])

    def _streams(self, keys: list[str]) -> tuple[dict[int, bytes], dict[int, list[bytes]]]:
        """By place: ids of chunks that are read a portion at a time, and the pre-tokens of all others."""
        done: dict[int, bytes] = {}
        cut: dict[int, list[bytes]] = {}
        for i, key in enumerate(keys):
            if plain_word(key):
                cut[i] = [b" " + key.encode()]
                continue
            bare = key[:1] == RAW
            chunk = key[1:] if bare else " " + key
            if bare and plain_word(chunk):
                cut[i] = [chunk.encode()]
            elif len(chunk) > PORTION_CHARS:
                done[i] = b"".join(self.unbroken(chunk))
            else:
                cut[i] = [self._raw(symbols) for symbols, _ in self.pre.pre_tokenize_str(chunk)]
        return done, cut

    def learn(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks that the memo lacks; each distinct pre-token runs once."""
        done, cut = self._streams(keys)
        new = list(dict.fromkeys(chain.from_iterable(cut.values())))
        known = dict(zip(new, self.transducer.run(new)))
        out = {keys[i]: ids for i, ids in done.items()}
        for i, parts in cut.items():
            out[keys[i]] = known[parts[0]] if len(parts) == 1 else b"".join([known[raw] for raw in parts])
        return out

    def each(self, keys: list[str]) -> list[bytes]:
        """Ids of chunks without a memo: every pre-token of every chunk runs, however often it occurs."""
        done, cut = self._streams(keys)
        ids = iter(self.transducer.run(list(chain.from_iterable(cut.values()))))
        return [done[i] if i in done else b"".join([next(ids) for _ in cut[i]]) for i in range(len(keys))]

    def unbroken(self, chunk: str) -> Iterator[bytes]:
        """Ids of a chunk of any length, a portion at a time.

        What ends in a portion's last characters may go on in the next one. A pre-token that does is fed as
        far as is sure; its last characters start the next portion, whose first pre-token goes on with it.
        """
        at, going = 0, False
        while at < len(chunk):
            portion = chunk[at : at + PORTION_CHARS]
            final = at + len(portion) == len(chunk)
            whole: list[bytes] = []
            nxt = at + len(portion)
            for symbols, (a, b) in self.pre.pre_tokenize_str(portion):
                if not final and b > len(portion) - MARGIN:
                    yield from self.transducer.run(whole)
                    whole = []
                    if len(portion) - a > 3 * MARGIN:
                        b = len(portion) - 2 * MARGIN
                        if going and a:
                            yield self.transducer.finish()
                        yield self.transducer.feed(portion[a:b].encode())
                        going, nxt = True, at + b
                    else:
                        if going and a:
                            yield self.transducer.finish()
                        going, nxt = going and not a, at + a
                    break
                if going and not a:
                    yield self.transducer.feed(self._raw(symbols))
                    yield self.transducer.finish()
                    going = False
                else:
                    whole.append(self._raw(symbols))
            yield from self.transducer.run(whole)
            at = nxt

    @staticmethod
    def cut(text: str) -> list[str]:
        """Keys of the text's chunks: a chunk after RAW, or one that begins with a space without that space.

        Python's white space holds the pre-tokenizer's, so where in doubt there is no cut.
        """
        keys: list[str] = []
        parts = text.split(" ")
        held = RAW + parts[0]
        for part in parts[1:]:
            if part and not part[0].isspace():
                keys.append(held)
                held = RAW + " " + part
            else:
                held += " " + part
        keys.append(held)
        return keys

    def portions(self, text: str) -> Iterator[list[str]]:
        """Keys of a text's chunks, TEXT_CHARS of it at a time; one chunk may be longer."""
        at = 0
        while at < len(text):
            m = _SAFE.search(text, at + TEXT_CHARS) if len(text) - at > TEXT_CHARS else None
            end = m.start() if m else len(text)
            yield self.cut(text[at:end])
            at = end

    def encode(self, text: str) -> bytes:
        """Ids of a text of any length (little-endian unsigned 32-bit), a portion at a time."""
        if self._special is not None and "<" in text and self._special.search(text):
            parts = enumerate(self._special.split(text))
            return b"".join([self.vocabulary.special[p].to_bytes(4, "little") if i % 2 else self.encode(p) for i, p in parts])
        return b"".join([b"".join(self.memo.values(keys, self.learn) if self.memo is not None else self.each(keys)) for keys in self.portions(text)])

    def encode_array(self, texts: pa.Array) -> pa.BinaryArray:
        """Ids of each text. Texts with nothing but single spaces and line ends between words are cut all at once:
        a line end is a chunk, and so are a word and the marks behind it."""
        texts = pc.fill_null(texts, "")
        if self.memo is None:
            return pa.array([self.encode(text) for text in texts.to_pylist()], pa.binary())
        even = short_and(texts, _UNEVEN, TEXT_CHARS)
        plain = texts if even.all() else pc.if_else(pa.array(even), texts, "")
        plain = pc.replace_substring_regex(plain, pattern=MARK, replacement=rf"\1 {RAW}\2\3")
        plain = pc.replace_substring(plain, pattern="\n", replacement=f" {RAW}\n {RAW}")
        out = self.memo.joined(pc.split_pattern(pc.binary_join_element_wise(RAW, plain, ""), " "), self.learn)
        if even.all():
            return out
        return pc.replace_with_mask(out, pa.array(~even), pa.array([self.encode(texts[int(i)].as_py()) for i in np.flatnonzero(~even)], pa.binary()))


class Decoder:
    """Byte-to-text state machine: ids in any portions become text as soon as their bytes are complete.

    Bytes that are not UTF-8 become U+FFFD, as in the library's lossy decoding.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = [vocabulary.bytes.get(i, b"") for i in range(max(vocabulary.bytes) + 1)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


_ENCODERS: dict[str, Encoder] = {}
DECODE_PORTION = 4096


def _encoder(path: str) -> Encoder:
    own("bpe", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        release(True)  # the files that it was read from
    return _ENCODERS[path]


def encoded(text: Column, path: str) -> Column:
    """ids of each text as bytes (little-endian unsigned 32-bit); of null, as of an empty text."""

    def run(texts: pa.Array) -> pa.Array:
        return _encoder(path).encode_array(texts)

    return array_udf(run, "binary")(text.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """The text of each ids column that `encoded` made."""

    def run(column: pa.Array) -> pa.Array:
        decoder, out = Decoder(_encoder(path).vocabulary), []
        for raw in column.to_pylist():
            values = np.frombuffer(raw or b"", "<u4")
            text = [decoder.feed(values[i : i + DECODE_PORTION].tolist()) for i in range(0, len(values), DECODE_PORTION)]
            out.append("".join([*text, decoder.finish()]))
        return pa.array(out, pa.string())

    return array_udf(run, "string")(ids)


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the ids of each whole text."""
    return docs.withColumn(out_col, encoded(F.col(text_col), path))
