"""N-gram Jaccard self-join with PartEnum signatures, and the components of its links.

Sets of word shingles are dealt into size bands. Two sets that link at similarity t differ in at most
k = (a + b)(1 - t)/(1 + t) shingles, a and b their sizes. In a band the shingle domain is hashed into
parts, each of them into sub-parts; a signature is the content of one subset of a part's sub-parts that
leaves `spoilt` of them out, and all such subsets are enumerated. One difference spoils one sub-part, so
among floor(k/(spoilt+1)) + 1 parts one has a subset that both sets share whole. A set gives the
signatures of its first parts, as many as hold that number of parts in which every subset has a shingle;
empty subsets give none. A set that can link into the next band also gives signatures there. Hence two
linked sets always share a signature. Bands of small sets can't fill two levels with certainty and have
one: each part is its only subset, spoilt is 0.

Sets that share one are candidates: first each with the smallest of its bucket; then, of the pairs between
components that this leaves apart and that sizes and a parity sketch don't rule out, a spanning forest of
each bucket, nearest pairs first; then every such pair that is left. Candidates are verified on their whole
sets, and links merge components before the next step, so a group of near copies costs few more pairs than
it has members. Exact copies of a set are one class throughout, so groups of copies never multiply.

Hot buckets: a task sends one row a signature to its bucket's task; its other rows of that signature have
that one as their smallest and are dealt by id as well. A bucket to be compared whole is cut into blocks of
SPLIT rows, and each pair of blocks is a group of its own, so no task holds more than two blocks.

Shingles are 64-bit hashes (xxh3 of words, mixed): two of n shingles of a pair of sets meet with a chance
below n^2 / 2^64.

Edge cases: a null or empty text has an empty set and links with nothing; with fewer words than a
shingle the whole sequence is one shingle; a null id links with nothing; rows that repeat an id are one
node, which has the links of all its texts; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb, exp, lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import array_udf, join_checked, map_batches, own, stored
from corpusmill.llm.components import components

#: Sets up to this size are one band whose parts hold single shingles; above, bands grow by RATIO.
SMALL = 48
SMALL_PARTS = 1 << 16
RATIO = 1.6
#: Sub-parts of a part, and how many of them a subset leaves out (PartEnum's second level), above the smallest sets.
SUB_PARTS, SPOILT = 3, 1
#: Chance that a set shows too few parts, and seeds of the partition tried before that ends the join.
RISK = 1e-13
SEEDS = 8
_EMPTY = "a set leaves too many parts empty under this seed"
#: Rows compared at a time inside a group, words of sketches at a time, and rows of a block of a bucket.
BLOCK, SKETCH_CELLS, SPLIT = 1024, 1 << 20, 4096
#: Signatures that a task holds before it sends them.
HELD = 1 << 20
#: Keys by which a task's repeated signatures are dealt.
SPREAD = 64

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """For each text the xxh3 hashes of its words, A-Z in lower case, in order. Each distinct word is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words = lists.flatten().dictionary_encode()
    known = words.dictionary.cast(pa.binary()).to_pylist()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[words.indices.to_numpy()]
    real = np.fromiter(map(len, known), np.int64, len(known))[words.indices.to_numpy()] > 0  # white space at an end gives an empty word
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return [hashed[a:b][real[a:b]] for a, b in zip(ends, ends[1:])]


def shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Distinct word shingles of each whole text as sorted 64-bit hashes."""
    out = []
    for hashed in word_hashes(texts):
        n = len(hashed)
        if n < words:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashed.tobytes())], np.uint64) if n else hashed)
            continue
        rolled = np.zeros(n - words + 1, np.uint64)
        for i in range(words):
            rolled = mix(rolled + hashed[i : n - words + 1 + i]) + np.uint64(_BASE)
        out.append(np.unique(rolled))
    return out


@dataclass(frozen=True)
class Join:
    """Similarity as a fraction num/den, words of a shingle, a seed for the partition of the domain, and
    the chance with which a set may show too few parts under it."""

    words: int
    num: int
    den: int
    seed: int = 0
    risk: float = RISK

    def most_partner(self, size: int) -> int:
        return size * self.den // self.num

    def differences(self, a, b):
        """Most differing shingles of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def needed(self, size: int, band: int) -> int:
        """Parts without an empty subset that a set of this size must show."""
        return self._needed(size, self.levels(band)[1])

    def _needed(self, size: int, spoilt: int) -> int:
        return self.differences(size, self.most_partner(size)) // (spoilt + 1) + 1

    def bands(self, size: int) -> list[tuple[int, int]]:
        """(band, its parts) in which a set of this size gives signatures: its own, and the next if it links into it."""
        edges = _edges()
        own = int(np.searchsorted(edges, size))
        return [(b, self.parts(b)) for b in ([own, own + 1] if self.most_partner(size) > edges[own] else [own])]

    def parts(self, band: int) -> int:
        return SMALL_PARTS if band == 0 else _plan(self.num, self.den, band, self.risk)[0]

    def levels(self, band: int) -> tuple[int, int]:
        """Sub-parts and left-out ones of a band's parts."""
        return (1, 0) if band == 0 else _plan(self.num, self.den, band, self.risk)[1:]

    def signatures(self, found: np.ndarray) -> tuple[np.ndarray, bool]:
        """Signatures of a set, and whether each of its bands showed the needed parts (else try another seed)."""
        out, whole = [], True
        for band, parts in self.bands(len(found)):
            subs, spoilt = self.levels(band)
            number = band * 1_000_003 + self.seed * 7919 + 17
            salt = np.uint64(number)
            spread = mix(found ^ np.uint64(number * _BASE % 2**64))
            part = ((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            sub = part * np.uint64(subs) + spread % np.uint64(subs)
            order = np.argsort(sub, kind="stable")
            sub, value = sub[order], mix(found[order] + np.uint64(_BASE))
            first = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])
            content, which = np.add.reduceat(value, first), sub[first]
            of_part = which // np.uint64(subs)
            starts = np.flatnonzero(np.r_[True, of_part[1:] != of_part[:-1]])
            full = np.diff(np.r_[starts, len(of_part)]) > spoilt  # sub-parts with shingles: no subset is empty
            enough = np.flatnonzero(np.cumsum(full) >= self.needed(len(found), band))
            whole &= bool(len(enough))
            last = int(enough[0]) + 1 if len(enough) else len(starts)
            if subs == 1:
                out.append(mix(content[:last] ^ mix(which[:last] + salt)))
                continue
            # a row a part, a column a sub-part; each subset leaves one column out
            row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(of_part)]))
            held = row < last
            column = (which[held] % np.uint64(subs)).astype(np.int64)
            grid, there = np.zeros((last, subs), np.uint64), np.zeros((last, subs), bool)
            grid[row[held], column], there[row[held], column] = content[held], True
            subset = grid.sum(1, dtype=np.uint64)[:, None] - grid
            name = (of_part[starts[:last]] * np.uint64(subs))[:, None] + np.arange(subs, dtype=np.uint64)[None, :]
            some = there.sum(1)[:, None] > there
            out.append(mix(subset[some] ^ mix(name[some] + salt)))
        return np.concatenate(out), whole

    def links(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)


def _short(size: int, parts: int, need: int, subs: int, spoilt: int) -> float:
    """Bound of the chance that a set of so many shingles shows fewer than `need` parts with more than `spoilt` sub-parts filled.

    Then all shingles lie in need - 1 parts and in `spoilt` sub-parts of every other: the sum over all choices
    of those.
    """
    if parts < need:
        return 1.0
    full = need - 1
    share = (full * subs + (parts - full) * spoilt) / (parts * subs)
    if not share:
        return 0.0 if size else 1.0
    choices = lgamma(parts + 1) - lgamma(full + 1) - lgamma(parts - full + 1) + (parts - full) * log(comb(subs, spoilt))
    return exp(min(0.0, choices + size * log(share)))


@lru_cache(maxsize=None)
def _plan(num: int, den: int, band: int, risk: float) -> tuple[int, int, int]:
    """Parts of a band, their sub-parts, and how many of those a subset leaves out.

    The fewest parts (the most shingles a signature) with which a set of any size that gives signatures in
    the band falls short with a chance of at most `risk`; two levels if that can be.
    """
    join, edges = Join(1, num, den), _edges()
    low = max(2, int(edges[band - 1]) * num // den)  # smaller ones don't link into the band
    sizes = sorted({int(x) for x in np.geomspace(low, int(edges[band]), 9)})
    for subs, spoilt in ((SUB_PARTS, SPOILT), (1, 0)):
        needs = [join._needed(size, spoilt) for size in sizes]
        step = max(1, needs[-1] // 100)
        for parts in range(needs[-1], 6 * needs[-1] + 20, step):
            if max(_short(size, parts, need, subs, spoilt) for size, need in zip(sizes, needs)) <= risk:
                return parts, subs, spoilt
    return SMALL_PARTS, 1, 0


@lru_cache(maxsize=1)
def _edges() -> np.ndarray:
    """Largest size of each band."""
    out = [SMALL]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * RATIO))
    return np.array(out)


#: Most 64-bit words of a sketch; a larger set's sketch only rules out less.
SKETCH_WORDS = 2048


def sketch(found: np.ndarray) -> bytes:
    """Parities of the set's hashes, about two bits a shingle: two sets differ in at least as many shingles as bits.

    A sketch folds to half its size by the exclusive or of its halves.
    """
    words = min(SKETCH_WORDS, 1 << max(0, (2 * len(found) - 1) // 64).bit_length())
    bits = np.bincount((mix(found + np.uint64(99)) & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """A row of 64-bit words for each sketch, all folded to the smallest one's size."""
    least = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), least), np.uint64)
    for i, raw in enumerate(sketches):
        row = np.frombuffer(raw, np.uint64)
        while len(row) > least:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


def _describe(words: int):
    def run(texts: pa.Array) -> pa.Array:
        own("near dedup")
        rows = [(len(found), xxhash.xxh3_128_digest(found.tobytes()), sketch(found)) for found in shingles(texts, words)]
        types = (("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], [n for n, _ in types])

    return run


#: Set digests a task remembers so as not to give a copy's signatures again.
SEEN = 200_000
_SIGNED = "sig bigint, deal int, id bigint, pivot bigint"


def _record(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _emit(join: Join):
    """Signatures of distinct sets, combined within a task.

    Of a task's rows of one signature the first (deal 0) goes to the signature's bucket, with its own id as
    pivot if others follow and -2^63 if not; the others know their pivot and may go anywhere.
    """

    def combined(sig: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        new = np.r_[True, sig[1:] != sig[:-1]]
        starts = np.flatnonzero(new)
        pivot = ids[starts][np.cumsum(new) - 1]
        alone = np.diff(np.r_[starts, len(sig)]) == 1
        pivot[starts[alone]] = _NONE
        deal = np.where(new, 0, 1 + (mix(ids.view(np.uint64)) % np.uint64(SPREAD)).astype(np.int64)).astype(np.int32)
        return _record(sig=sig, deal=deal, id=ids, pivot=pivot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("near dedup")
        seen: set[bytes] = set()
        ids, sigs, held = [], [], 0
        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), shingles(batch.column(1), join.words)):
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if not len(found) or digest in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                made, whole = join.signatures(found)
                if not whole:
                    raise ValueError(_EMPTY)
                ids.append(np.full(len(made), doc_id, np.int64))
                sigs.append(made.view(np.int64))
                held += len(made)
            if held > HELD:
                yield combined(np.concatenate(sigs), np.concatenate(ids))
                ids, sigs, held = [], [], 0
        if held:
            yield combined(np.concatenate(sigs), np.concatenate(ids))

    return run


_NONE = -(1 << 63)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (sig, deal, id) order: those whose signature another row also has, with the smallest id known to have it.

    Rows that know their pivot from their task keep it. Holds one row between batches, however many rows
    share a signature.
    """
    own("near dedup")
    held: tuple | None = None  # the last first row of a signature: sig, id, pivot, bucket's smallest id, whether one came before it
    for batch in batches:
        sig, deal, ids, pivot = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        done = deal > 0
        if done.any():
            yield _record(sig=sig[done], id=ids[done], pivot=pivot[done])
            sig, ids, pivot = sig[~done], ids[~done], pivot[~done]
        if not len(sig):
            continue
        if held is not None:
            sig, ids, pivot = np.r_[held[0], sig], np.r_[held[1], ids], np.r_[held[2], pivot]
        new = np.r_[True, sig[1:] != sig[:-1]]
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        before = ~new
        if held is not None:
            least[sig == sig[0]] = held[3]
            before[0] = held[4]
        kept = before | np.r_[~new[1:], False] | (pivot != _NONE)
        kept[-1] = False  # decided with the next batch
        yield _record(sig=sig[kept], id=ids[kept], pivot=least[kept])
        held = (sig[-1], ids[-1], pivot[-1], least[-1], bool(before[-1]))
    if held is not None and (held[4] or held[2] != _NONE):
        yield _record(sig=np.array(held[:1]), id=np.array(held[1:2]), pivot=np.array(held[3:4]))


def _spanning(parent: np.ndarray, x: np.ndarray, y: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Places of pairs (x, y) that join trees of the forest `parent`, which grows: each tree's nearest pair, until none is left."""
    chosen: list[int] = []
    at = np.argsort(near, kind="stable")

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    while True:
        roots = np.array([root(k) for k in range(len(parent))])
        p, q = roots[x[at]], roots[y[at]]
        at, p, q = at[p != q], p[p != q], q[p != q]
        if not len(at):
            return np.array(chosen, np.int64)
        for k in np.unique(np.concatenate([np.unique(side, return_index=True)[1] for side in (p, q)])):
            a, b = root(p[k]), root(q[k])
            if a != b:
                parent[max(a, b)] = min(a, b)
                chosen.append(at[k])


def _across(join: Join, whole: bool):
    """Groups in (sig, i, j) order: pairs from different components, one of block i and one of block j, that sizes and sketches
    allow; all of them if whole, else a spanning forest of the group's components."""

    def pairs(side: np.ndarray, ids: np.ndarray, label: np.ndarray, size: np.ndarray, sketches: list[bytes], within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(size, kind="stable")
        side, ids, label, size = side[order], ids[order], label[order], size[order]
        bits = folded([sketches[i] for i in order])
        step = max(1, SKETCH_CELLS // bits.shape[1])
        names, label = np.unique(label, return_inverse=True)
        parent = np.arange(len(names))
        for i in range(0, len(ids), BLOCK):
            a = slice(i, min(i + BLOCK, len(ids)))
            last = int(np.searchsorted(size, join.most_partner(int(size[a][-1])), "right"))
            for j in range(i, last, BLOCK):
                b = slice(j, min(j + BLOCK, last))
                open_ = (label[a][:, None] != label[b][None, :]) & (size[b][None, :] * join.num <= size[a][:, None] * join.den)
                x, y = np.nonzero(open_ if within else open_ & (side[a][:, None] != side[b][None, :]))
                x, y = x + i, y + j
                x, y = x[x < y], y[x < y]
                for k in range(0, len(x), step):
                    p, q = x[k : k + step], y[k : k + step]
                    far = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64)
                    near = far <= join.differences(size[p], size[q])
                    p, q, far = p[near], q[near], far[near]
                    if not whole and len(p):
                        chosen = _spanning(parent, label[p], label[q], far)
                        p, q = p[chosen], q[chosen]
                    yield np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("near dedup")
        held: list[np.ndarray] = []
        marks: list[bytes] = []
        at = None

        def flush():
            if held:
                side, ids, label, size = np.concatenate(held, 1)
                if len(np.unique(label)) > 1:
                    for a, b in pairs(side, ids, label, size, marks, at[1] == at[2]):
                        if len(a):
                            yield _record(a=a, b=b)
            held.clear()
            marks.clear()

        for batch in batches:
            sig, i, j, *rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            if not len(sig):
                continue
            sketches, rest = batch.column(7).to_pylist(), np.stack(rest)
            cuts = np.r_[0, np.flatnonzero((sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, len(sig)]
            for a, b in zip(cuts, cuts[1:]):
                if (sig[a], i[a], j[a]) != at:
                    yield from flush()
                    at = (sig[a], i[a], j[a])
                held.append(rest[:, a:b])
                marks += sketches[a:b]
        yield from flush()

    return run


def _verify(join: Join):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([p, q])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(join.links(common, len(p), len(q)))
        return pa.array(out, pa.bool_())

    return run


def _set_bytes(words: int):
    def run(texts: pa.Array) -> pa.Array:
        own("near dedup")
        return pa.array([found.tobytes() for found in shingles(texts, words)], pa.binary())

    return run


def _likely(join: Join):
    """Whether sizes and sketches of two sets allow a link."""

    def run(a: pa.Array, b: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        own("near dedup")
        out = []
        for m, n, p, q in zip(a.to_pylist(), b.to_pylist(), x.to_pylist(), y.to_pylist()):
            ok = min(m, n) * join.den >= max(m, n) * join.num
            if ok:
                left, right = folded([p, q])
                ok = int(np.bitwise_count(left ^ right).sum(dtype=np.int64)) <= join.differences(m, n)
            out.append(ok)
        return pa.array(out, pa.bool_())

    return run


def verified(docs: DataFrame, about: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """Those pairs (a, b) of ids, of a stored table, that have texts whose whole sets link.

    Sizes and sketches rule most other pairs out first; whole sets are made and moved for the rest only.
    Joins are on single ids, so a pivot with many partners is split as a skewed key.
    """

    def those(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
        """rows whose id is in a pair; a pair has two ids, which bounds what is broadcast."""
        ids = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return join_checked(rows, ids, "id", "left_semi", 2 * n)

    sizes = those(about.where("n > 0"), pairs, pairs.count()).dropDuplicates(["id", "digest"])
    side = lambda c, n, x: sizes.select(F.col("id").alias(c), F.col("n").alias(n), F.col("sketch").alias(x))
    both = pairs.join(side("a", "m", "p"), "a").join(side("b", "n", "q"), "b")
    pairs = stored(both.where(array_udf(_likely(join), "boolean")("m", "n", "p", "q")).select("a", "b").distinct(), "likely")
    rows = those(docs, pairs, pairs.count()).select("id", "text", F.sha2("text", 256).alias("sha")).dropDuplicates(["id", "sha"])
    sets = stored(rows.select("id", array_udf(_set_bytes(join.words), "binary")("text").alias("found")), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")
    return both.where(array_udf(_verify(join), "boolean")("x", "y")).select("a", "b").distinct()


def _signed(docs: DataFrame, words: int, num: int, den: int, risk: float) -> tuple[DataFrame, Join]:
    """sig, id, pivot of every signature that more than one distinct set has, and the join that made them."""
    for seed in range(SEEDS):
        join = Join(words, num, den, seed, risk)
        rows = map_batches(docs.where("id IS NOT NULL"), _emit(join), _SIGNED)
        shared = map_batches(rows.repartition("sig", "deal").sortWithinPartitions("sig", "deal", "id"), _shared, "sig bigint, id bigint, pivot bigint")
        try:
            return stored(shared, "shared"), join
        except PythonException as e:  # all signatures are of one seed, so all sets try the next
            if _EMPTY not in str(e) or seed == SEEDS - 1:
                raise
    raise AssertionError("unreachable")


def _open_members(members: DataFrame, found: DataFrame) -> DataFrame | None:
    """sig, id, label, blocks of the buckets (members: sig, id) that hold more than one component; None if none does."""
    named = found.select(F.col("node").alias("id"), "label")
    tagged = join_checked(members, named, "id", "left", found.count()).select("sig", "id", F.coalesce("label", "id").alias("label"))
    apart = tagged.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("k")).where("low <> high")
    apart = stored(apart.select("sig", F.ceil(F.col("k") / SPLIT).cast("int").alias("blocks")), "apart")
    n_apart = apart.count()
    return stored(join_checked(tagged, apart, "sig", "inner", n_apart).distinct(), "open") if n_apart else None


def _open_pairs(about: DataFrame, members: DataFrame, join: Join, whole: bool) -> DataFrame:
    """Pairs (a, b) of ids that may link, from different components of an open bucket."""
    sizes = about.where("n > 0").join(members.select("id").distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id", "digest"]).select("id", "n", "sketch")
    rows = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").cast("bigint").alias("side"), "id", "label")
    rows = rows.join(sizes, "id").select("sig", "i", "j", "side", "id", "label", "n", "sketch")
    return map_batches(rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j"), _across(join, whole), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", risk: float = RISK) -> DataFrame:
    """id, n_shingles, class_id (smallest id with the same set), component_id of every document."""
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    about = docs.select("id", array_udf(_describe(words), "struct<n:bigint,digest:binary,sketch:binary>")("text").alias("s"))
    about = stored(about.select("id", "s.n", "s.digest", "s.sketch"), "sets-about")
    real = about.where("n > 0 AND id IS NOT NULL").select("id", "digest")
    # ids whose set a smaller id also has; an id with several texts is tied to all of its classes by links below
    classes = real.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").select("digest", "rep")
    same = stored(real.join(classes, "digest").where("id <> rep").select("id", "rep").distinct(), "copies")
    copies = same.groupBy("id").agg(F.min("rep").alias("rep"))
    n_copies = same.count()

    def represented(rows: DataFrame, column: str) -> DataFrame:
        """rows with the ids in column replaced by the smallest id of the same set."""
        named = copies.select(F.col("id").alias(column), "rep")
        return join_checked(rows, named, column, "left", n_copies).withColumn(column, F.coalesce("rep", column)).drop("rep")

    shared, join = _signed(docs, words, num, den, risk)
    pairs = shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = represented(represented(pairs, "a"), "b").where("a <> b")
    star = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
    # an id with several texts is in several classes, which are one component
    again = same.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id").unionByName(same.select(F.col("rep").alias("id"))).distinct()
    tied = same.join(again, "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    tied = tied.unionByName(represented(tied, "b")).where("a <> b")
    links = stored(verified(docs, about, star, join).unionByName(tied), "links")
    found = components(links)
    members, tested = represented(shared.select("sig", "id"), "id"), star
    # between components that the stars left apart: a spanning forest of each bucket, then every pair that can still link
    for whole in (False, True):
        open_ = _open_members(members, found)
        if open_ is None:
            break
        members = open_.select("sig", "id")  # a bucket of one component stays one
        more = stored(_open_pairs(about, open_, join, whole).join(tested, ["a", "b"], "left_anti"), "more")
        if more.limit(1).count():
            links = stored(links.unionByName(verified(docs, about, more, join)), "links")
            tested = tested.unionByName(more)
            found = components(links)

    result = join_checked(about.select("id", "n"), copies, "id", "left", n_copies)
    result = join_checked(result.withColumn("rep", F.coalesce("rep", "id")), found.select(F.col("node").alias("rep"), "label"), "rep", "left")
    return result.select("id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component_id"))
