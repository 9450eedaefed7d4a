"""Exact deduplication with counting quotient filters.

Every text is normalised (each run of ASCII white space becomes one space) and given a 64-bit
fingerprint (xxhash, by Spark). Its first bits name a block; of the rest, the high bits, the quotient, name a slot of the
block's filter, and the low bits, the remainder, are stored in that slot or, where it is taken, further on:
remainders of one quotient form a sorted run, runs stand in the order of their quotients, and three bits a slot
(occupied, continuation, shifted) tell whose a remainder is. A count above one takes further slots of the run for its
digits, told by a fourth bit.

A filter has as many quotient bits as its content needs: at most LOAD of its slots are taken. One that gets fuller
is resized, which moves a bit of every remainder into the quotient and loses nothing. Each partition builds
filters, bulk-loaded from sorted fingerprints; filters of a block merge without loss, after they have been brought
to one geometry, by walking their sorted remainders and adding counts. What travels are blocks of remainders, never
whole fingerprints. Fingerprints whose merged count is above one are the only ones whose texts are moved; those
texts are compared byte by byte.

Edge cases: a null text counts as empty; empty texts are equal to each other; a null doc_id sorts
last, so it stays only in a group without any id; of rows that repeat one doc_id and text exactly one
stays; an empty table gives an empty result; other columns pass through untouched, whatever their names,
but for those named like a result (_keep_id, _group_size, _kept, _text_sha256), which give way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import join_checked, map_batches, own, packed, stored, unpacked

#: Share of slots that may be taken, and quotient bits of the smallest filter.
LOAD, LEAST_QUOTIENT_BITS = 0.95, 4
#: Bits that name a block: at least the first number, at most the second, and so many that a merged block has about BLOCK_PRINTS.
BLOCK_BITS, MOST_BLOCK_BITS, BLOCK_PRINTS = 8, 24, 1 << 20
#: Fingerprints held before a partition emits its filter and starts anew.
FILTER_CAPACITY = 1_000_000
#: Bytes of distinct texts a task keeps while it pre-aggregates; beyond that it emits and starts anew.
COMBINE_BYTES = 8_000_000

#: Tasks that combine the partial rows of one text before they meet.
SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; nothing is trimmed. Single spaces are left where they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


@dataclass
class CountingQuotientFilter:
    """Slots with metadata bits for the fingerprints of a block.

    There are 2**quotient_bits slots and a few more, for runs that the last ones shift out. remainders[i] is the
    slot's content; occupied[q] says that quotient q has a run, continuation that a slot's run goes on
    from the slot before, shifted that the slot isn't its quotient's own, counter that it holds a digit
    of the count (less one) of the remainder before it, lowest digit first. A free slot has no bit set but
    perhaps occupied. Inside a block a fingerprint is a key: its quotient and remainder side by side.
    """

    block: int
    block_bits: int
    quotient_bits: int
    remainders: np.ndarray
    occupied: np.ndarray
    continuation: np.ndarray
    shifted: np.ndarray
    counter: np.ndarray
    used: np.ndarray

    @property
    def remainder_bits(self) -> int:
        return 64 - self.block_bits - self.quotient_bits

    @property
    def load(self) -> float:
        return float(self.used.sum()) / (1 << self.quotient_bits)

    @staticmethod
    def geometry(slots: int) -> int:
        """Quotient bits of a filter with so many slots taken."""
        return max(LEAST_QUOTIENT_BITS, (math.ceil(slots / LOAD) - 1).bit_length())

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray, block: int = 0, block_bits: int = 0) -> CountingQuotientFilter:
        """Of sorted distinct fingerprints (uint64) of a block and their counts."""
        mask = np.uint64((1 << (64 - block_bits)) - 1)
        return cls.of_keys(prints & mask, counts, block, block_bits)

    @classmethod
    def of_keys(cls, keys: np.ndarray, counts: np.ndarray, block: int, block_bits: int, least: int = 0) -> CountingQuotientFilter:
        """Of sorted distinct keys; with at least so many quotient bits."""
        bits = max(least, cls.geometry(len(keys)))
        while True:  # counts take slots, too: their digits depend on the remainder's width
            digits = _digits(counts, 64 - block_bits - bits)
            needed = cls.geometry(len(keys) + int(digits.sum()))
            if needed <= bits:
                return cls._placed(keys, counts, digits, block, block_bits, bits)
            bits = needed

    @classmethod
    def _placed(cls, keys, counts, digits, block: int, block_bits: int, bits: int) -> CountingQuotientFilter:
        width = 64 - block_bits - bits
        quotient, value, more = _slots(keys, counts, digits, width)
        place = _places(quotient)
        slots = max(1 << bits, int(place[-1]) + 1 if len(place) else 0)
        out = cls(block, block_bits, bits, np.zeros(slots, np.uint64), *(np.zeros(k, bool) for k in (1 << bits, slots, slots, slots, slots)))
        out._put(quotient, value, more, place)
        return out

    def _put(self, quotient, value, more, place) -> None:
        self.occupied[quotient] = True
        self.remainders[place] = value
        self.used[place] = True
        self.counter[place] = more
        self.shifted[place] = place != quotient
        self.continuation[place] = False
        self.continuation[place[1:]] = quotient[1:] == quotient[:-1]

    def keys(self, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and their counts in slots low to high (cluster borders), read from slots and bits: the k-th run
        is the k-th occupied quotient's."""
        place = np.flatnonzero(self.used[low:high]) + low
        if not len(place):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        width = np.uint64(self.remainder_bits)
        quotient = (np.flatnonzero(self.occupied[low:]) + low)[np.cumsum(~self.continuation[place]) - 1]
        value, digit = self.remainders[place], self.counter[place]
        heads = np.flatnonzero(~digit)
        depth = np.arange(len(place)) - heads[np.cumsum(~digit) - 1] - 1
        weight = np.where(digit, value << (np.maximum(depth, 0).astype(np.uint64) * width), np.uint64(1))
        return (quotient[heads].astype(np.uint64) << width) | value[heads], np.add.reduceat(weight, heads).astype(np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        keys, counts = self.keys()
        return keys | np.uint64(self.block << (64 - self.block_bits) if self.block_bits else 0), counts

    def __len__(self) -> int:
        return int((self.used & ~self.counter).sum())

    def _run(self, quotient: int) -> tuple[int, int]:
        """Where the cluster of an occupied quotient begins, and where its run does: runs are skipped, one for each occupied quotient."""
        start = quotient
        while self.shifted[start]:
            start -= 1
        at = of = start
        while of < quotient:
            at += 1
            while at < len(self.used) and self.continuation[at]:
                at += 1
            of += 1
            while not self.occupied[of]:
                of += 1
        return start, at

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint of the block was counted: a walk along its run."""
        key = fingerprint & ((1 << (64 - self.block_bits)) - 1)
        quotient, remainder = key >> self.remainder_bits, key & ((1 << self.remainder_bits) - 1)
        if not self.occupied[quotient]:
            return 0
        _, at = self._run(quotient)
        while True:
            if not self.counter[at] and int(self.remainders[at]) == remainder:
                n, depth = 1, 0
                while at + 1 + depth < len(self.used) and self.counter[at + 1 + depth]:
                    n += int(self.remainders[at + 1 + depth]) << (depth * self.remainder_bits)
                    depth += 1
                return n
            at += 1
            if at >= len(self.used) or not self.continuation[at]:
                return 0

    def insert(self, fingerprint: int, times: int = 1) -> CountingQuotientFilter:
        """The filter with a fingerprint counted so many times more: this one, its cluster moved on, or a larger one."""
        key = np.uint64(fingerprint & ((1 << (64 - self.block_bits)) - 1))
        quotient = int(key >> np.uint64(self.remainder_bits))
        low = quotient
        while low < len(self.used) and self.shifted[low]:
            low -= 1
        high = max(low, quotient)
        while True:
            while high < len(self.used) and self.used[high]:
                high += 1
            keys, counts = self.keys(low, high)
            keys, counts = _joined(keys, counts, np.array([key]), np.array([times]))
            digits = _digits(counts, self.remainder_bits)
            slots = _slots(keys, counts, digits, self.remainder_bits)
            place = _places(slots[0])
            grown = int(place[-1]) + 1 - len(self.used)
            if grown > 0:
                self.remainders = np.concatenate([self.remainders, np.zeros(grown, np.uint64)])
                self.continuation, self.shifted, self.counter, self.used = (np.concatenate([x, np.zeros(grown, bool)]) for x in (self.continuation, self.shifted, self.counter, self.used))
            if int(place[-1]) < high or not self.used[high : int(place[-1]) + 1].any():
                break
            high = int(place[-1]) + 1  # the cluster runs into the next one: both move
        for x in (self.continuation, self.shifted, self.counter, self.used):
            x[low:high] = False
        self._put(*slots, place)
        return self if self.load <= LOAD else self.resized(self.quotient_bits + 1)

    def resized(self, quotient_bits: int) -> CountingQuotientFilter:
        """The same content with more quotient bits."""
        return self.of_keys(*self.keys(), self.block, self.block_bits, quotient_bits)

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All filters of one block in one. Two at a time are brought to one geometry and their sorted remainders walked
        side by side, equal ones adding their counts."""
        while len(filters) > 1:
            pairs = [filters[i : i + 2] for i in range(0, len(filters), 2)]
            filters = [p[0] if len(p) == 1 else cls._two(*p) for p in pairs]
        return filters[0]

    @classmethod
    def _two(cls, a: CountingQuotientFilter, b: CountingQuotientFilter) -> CountingQuotientFilter:
        bits = max(a.quotient_bits, b.quotient_bits)
        a, b = (f if f.quotient_bits == bits else f.resized(bits) for f in (a, b))
        return cls.of_keys(*_joined(*a.keys(), *b.keys()), a.block, a.block_bits, bits)

    def packed(self) -> tuple[int, int, bytes, bytes, bytes, bytes]:
        """Block, quotient bits, occupied bits, continuation and counter bits of the used slots, and their remainders in
        whole bytes; places follow from these."""
        size = -(-self.remainder_bits // 8)
        raw = self.remainders[self.used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        return (self.block, self.quotient_bits, np.packbits(self.occupied).tobytes(), np.packbits(self.continuation[self.used]).tobytes(), np.packbits(self.counter[self.used]).tobytes(), raw.tobytes())

    @classmethod
    def unpacked(cls, block_bits: int, block: int, bits: int, occupied: bytes, continuation: bytes, counter: bytes, remainders: bytes) -> CountingQuotientFilter:
        """The filter that was packed."""
        size = -(-(64 - block_bits - bits) // 8)
        n = len(remainders) // size
        value = np.zeros((n, 8), np.uint8)
        value[:, :size] = np.frombuffer(remainders, np.uint8).reshape(n, size)
        goes_on, digit = (np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b in (continuation, counter))
        has_run = np.unpackbits(np.frombuffer(occupied, np.uint8), count=1 << bits).astype(bool)
        quotient = np.flatnonzero(has_run)[np.cumsum(~goes_on) - 1] if n else np.zeros(0, np.int64)
        place = _places(quotient)
        slots = max(1 << bits, int(place[-1]) + 1 if n else 0)
        out = cls(block, block_bits, bits, np.zeros(slots, np.uint64), np.zeros(1 << bits, bool), *(np.zeros(slots, bool) for _ in range(4)))
        if n:
            out._put(quotient, value.view("<u8")[:, 0], digit, place)
        return out


def _digits(counts: np.ndarray, width: int) -> np.ndarray:
    """Slots that the counts (less one) take, in digits of `width` bits."""
    out, rest = np.zeros(len(counts), np.int64), counts.astype(np.uint64) - np.uint64(1)
    while (rest > 0).any():
        out += rest > 0
        rest >>= np.uint64(width)
    return out


def _slots(keys: np.ndarray, counts: np.ndarray, digits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotient, content and counter bit of the slots of sorted keys: each its remainder, then its count's digits."""
    shift, mask = np.uint64(width), np.uint64((1 << width) - 1)
    n = digits + 1
    quotient = np.repeat((keys >> shift).astype(np.int64), n)
    heads = np.cumsum(n) - n
    more = np.ones(len(quotient), bool)
    more[heads] = False
    value = np.repeat(keys & mask, n)
    if len(heads) < len(quotient):
        depth = (np.arange(len(quotient)) - np.repeat(heads, n) - 1)[more].astype(np.uint64)
        value[more] = (np.repeat(counts.astype(np.uint64) - np.uint64(1), n)[more] >> (depth * shift)) & mask
    return quotient, value, more


def _places(quotient: np.ndarray) -> np.ndarray:
    """Slots of sorted quotients: each the first free one from its own on."""
    at = np.arange(len(quotient))
    return np.maximum.accumulate(quotient - at) + at if len(at) else at


def _joined(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct keys as one; equal ones add their counts."""
    at = np.searchsorted(a, b) + np.arange(len(b))  # where b's keys stand among both
    keys, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
    own = np.ones(len(keys), bool)
    own[at] = False
    keys[at], counts[at] = b, b_counts
    keys[own], counts[own] = a, a_counts
    return _added(keys, counts)


def _added(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted prints, with the sums of their counts."""
    if not len(prints):
        return prints, counts
    starts = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
    return prints[starts], np.add.reduceat(counts, starts)


_BLOCKS = "block int, quotient_bits int, occupied binary, continuation binary, counter binary, remainders binary"


def _build(block_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("exact dedup")
        names = [c.split()[0] for c in _BLOCKS.split(", ")]

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            prints = np.sort(np.concatenate(parts))
            prints, counts = _added(prints, np.ones(len(prints), np.int64))
            block = (prints >> np.uint64(64 - block_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            rows = [CountingQuotientFilter.of(prints[a:b], counts[a:b], int(block[a]), block_bits).packed() for a, b in zip(cuts, np.r_[cuts[1:], len(block)])]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i in range(6)], names)

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= FILTER_CAPACITY:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


#: Blocks merged at a time.
MERGE_AT_ONCE = 32


def _merge(block_bits: int):
    """Blocks arrive in block order; each is merged and its repeated fingerprints are emitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("exact dedup")
        at, levels = None, []  # filters merged of as many others each, by halves

        def out() -> pa.RecordBatch:
            prints, counts = CountingQuotientFilter.merged([f for level in levels for f in level]).entries()
            more = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(prints[more].view(np.int64)), pa.array(counts[more])], ["fp", "n"])

        for batch in batches:
            for block, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    if levels:
                        yield out()
                    at, levels = block, []
                more = CountingQuotientFilter.unpacked(block_bits, block, *parts)
                for level in levels:
                    level.append(more)
                    if len(level) < MERGE_AT_ONCE:
                        break
                    more = CountingQuotientFilter.merged(level)
                    level.clear()
                else:
                    levels.append([more])
        if levels:
            yield out()

    return run


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """fp, n of every fingerprint that occurs more than once in the single bigint column of `prints` (of `rows` rows)."""
    bits = min(MOST_BLOCK_BITS, max(BLOCK_BITS, (rows // BLOCK_PRINTS).bit_length()))
    blocks = map_batches(prints, _build(bits), _BLOCKS)
    return map_batches(blocks.repartition("block").sortWithinPartitions("block"), _merge(bits), "fp bigint, n bigint")


_CLASSES = "fp bigint, sha string, norm binary, keep_id bigint, group_size bigint, n_keep bigint"


def _lowest(a, b):
    """Smaller of two (id, how often) with None last; equal ids add up."""
    if a[0] == b[0]:
        return (a[0], a[1] + b[1])
    if a[0] is None or (b[0] is not None and b[0] < a[0]):
        return b
    return a


def _classes(groups: dict) -> pa.RecordBatch:
    rows = [(fp, sha, norm, low[0], n, low[1]) for (fp, sha, norm), (low, n) in groups.items()]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["fp", "sha", "norm", "keep_id", "group_size", "n_keep"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text (compared by bytes) of a task, before its rows are shuffled."""
    own("exact dedup")
    groups, held = {}, 0
    for batch in batches:
        for fp, sha, norm, keep, n, n_keep in zip(*(batch.column(i).to_pylist() for i in range(6))):
            key = (fp, sha, norm)
            if key not in groups:
                held += len(norm) + 200
                groups[key] = ((keep, n_keep), n)
            else:
                low, size = groups[key]
                groups[key] = (_lowest(low, (keep, n_keep)), size + n)
        if held > COMBINE_BYTES:
            yield _classes(groups)
            groups, held = {}, 0
    if groups:
        yield _classes(groups)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial rows in (fp, sha) order become one row a text; texts of one digest are compared by bytes."""

    def out(groups: dict) -> pa.RecordBatch:
        if len({(fp, sha) for fp, sha, _ in groups}) != len(groups):
            raise ValueError("different texts share a 64-bit fingerprint and a SHA-256 digest")
        return _classes({(fp, sha, b""): v for (fp, sha, _), v in groups.items()})

    groups: dict = {}
    for batch in batches:
        for fp, sha, norm, keep, n, n_keep in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if groups and (fp, sha) != next(iter(groups))[:2]:
                yield out(groups)
                groups = {}
            low, size = groups.get((fp, sha, norm), ((keep, 0), 0))
            groups[fp, sha, norm] = (_lowest(low, (keep, n_keep)), size + n)
    if groups:
        yield out(groups)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Every row of docs (its `columns`, all by default) with _keep_id, _group_size, _kept and _text_sha256."""
    names = list(docs.columns if columns is None else columns)
    marked = docs.select(packed(docs, names).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id"), normalised(F.col(f"`{text_col}`").cast("string")).alias("norm"))
    marked = marked.select("row", "id", "norm", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha"))
    repeated = stored(repeated_fingerprints(marked.select("fp"), docs.count()), "repeated")
    routed = join_checked(marked.select("id", "norm", "fp", "sha"), repeated.select("fp"), "fp", "left_semi")
    one = F.lit(1).cast("bigint")
    partial = map_batches(routed.select("fp", "sha", F.col("norm").cast("binary").alias("norm"), F.col("id").alias("keep_id"), one.alias("group_size"), one.alias("n_keep")), _combine, _CLASSES)
    # a text that many tasks hold meets in SALTS tasks first, so that the last one gets few rows of it
    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("fp", "salt").drop("salt")
    partial = map_batches(salted, _combine, _CLASSES)
    classes = stored(map_batches(partial.repartition("fp").sortWithinPartitions("fp", "sha", "norm"), _verify, _CLASSES).drop("norm").where("group_size > 1"), "classes")
    classes = classes.select(F.col("fp").alias("c_fp"), F.col("sha").alias("c_sha"), F.col("keep_id").alias("c_keep"), F.col("group_size").alias("c_size"), F.col("n_keep").alias("c_n"))

    on = (F.col("fp") == F.col("c_fp")) & (F.col("sha") == F.col("c_sha"))
    out = join_checked(marked.select("row", "id", "fp", "sha"), classes, on, "left")
    alone = F.col("c_size").isNull()
    out = out.select(
        "row",
        F.when(alone, F.col("id")).otherwise(F.col("c_keep")).alias("keep_id"),
        F.coalesce("c_size", F.lit(1).cast("bigint")).alias("size"),
        (alone | F.col("id").eqNullSafe(F.col("c_keep"))).alias("kept"),
        "sha",
        (F.coalesce("c_n", F.lit(0)) > 1).alias("tied"),
    )
    if classes.where("c_n > 1").limit(1).count():
        # some kept id repeats with its text: exactly one such row of each group stays
        out = stored(out.withColumn("place", F.monotonically_increasing_id()), "tied")
        chosen = stored(out.where("tied and kept").groupBy("sha").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("chosen")), "chosen")
        out = join_checked(out, chosen, "place", "left")
        out = out.withColumn("kept", F.col("kept") & (~F.col("tied") | F.col("chosen").isNotNull()))
    return unpacked(out, "row", names, _keep_id=F.col("keep_id"), _group_size=F.col("size"), _kept=F.col("kept"), _text_sha256=F.col("sha"))
