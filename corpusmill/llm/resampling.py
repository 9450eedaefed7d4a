"""Importance resampling towards a target distribution, by hashed runs of one to three words.

Buckets of features are counted over all raw and all target texts. A bucket's gain is the logarithm of the
ratio of its smoothed shares; a document's weight is the sum over its features. Adding a Gumbel variate that
depends on the id alone and taking the highest scores draws without replacement, in proportion to weights.

Bytes of whole Arrow batches are classed by a table, words found by differences of classes, and CRC-32
states advance over all word starts at once: through the first word of a run, then the second, then the third.

Edge cases: null and empty texts have no features and weight 0; a null id counts as an empty one in the hash and
sorts first; repeated rows count each and stand side by side in the order; without enough documents
nothing is drawn; an empty target or an empty table only leaves the smoothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import array_udf, map_batches, stored
from corpusmill.llm.words import ALL, Block, advance, blocks, step

#: Words of the longest run, buckets, scale of gains, and least words of a document that may be drawn.
RUN, BUCKETS, SCALE, LEAST_WORDS = 3, 10_000, 1000, 20


def features(block: Block, run: int = RUN, buckets: int = BUCKETS):
    """Bucket numbers and first words of all runs of 1, 2, ... `run` words that begin among the counted words."""
    n, lengths = len(block.starts), block.lengths
    state = np.full(n, ALL, np.uint32)
    first = np.arange(n)
    for size in range(run):
        if size:
            inside = first + size < n
            inside[inside] = block.row[first[inside] + size] == block.row[first[inside]]
            first, state = first[inside], step(state[inside], np.uint32(32))
        state = advance(state, block.data, block.starts[first + size], lengths[first + size])
        own = first < block.counted
        yield ((state[own] ^ ALL) % np.uint32(buckets)).astype(np.int64), first[own]


def bucket_counts(texts: DataFrame, column: str, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: counted in each task, then summed."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), run - 1):
                for bucket, _ in features(block, run, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    each = map_batches(texts.select(F.col(column).cast("string")), count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Gain of each bucket, as whole numbers: floor(scale * ln((t+1)(S+m) / ((s+1)(T+m)))), in doubles."""
    m, every, wanted = float(len(raw)), float(raw.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((float(t) + 1) * (every + m) / ((float(s) + 1) * (wanted + m)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(text: Column, gain: np.ndarray, run: int = RUN) -> Column:
    """Struct of words, n_features and weight of each text."""
    kind = pa.struct([("words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(texts: pa.Array) -> pa.Array:
        words, found, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
        for block in blocks(texts, run - 1):
            words += np.bincount(block.row[: block.counted], minlength=len(texts))
            for bucket, first in features(block, run, len(gain)):
                row = block.row[first]
                found += np.bincount(row, minlength=len(texts))
                weight += np.bincount(row, gain[bucket], len(texts)).astype(np.int64)  # whole numbers below 2^53
        return pa.StructArray.from_arrays([pa.array(x) for x in (words, found, weight)], fields=list(kind))

    return array_udf(weigh, "struct<words: bigint, n_features: bigint, weight: bigint>")(text)


def noise(key: Column, seed: int, scale: int = SCALE) -> Column:
    """floor(-scale * ln(-ln(u))), u from the first 32 bits of a digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(u)))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with _place, from 1 in that order: sorted by ranges, numbered by the ranges' sizes (one number each on the driver)."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_range", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = stored(placed, "ranges")
    sizes = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, base = 0, []
    for number, n in sizes:
        base += [F.lit(number), F.lit(before)]
        before += n
    start = F.element_at(F.create_map(*base), F.col("_range")) if base else F.lit(0)
    return placed.withColumn("_place", (start + F.col("_at") + 1).cast("bigint")).drop("_range", "_at")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """_id, words, n_features, weight, score and rank of every document; rank is null unless it is drawn.

    Drawn are floor(share * N) of the N documents with LEAST_WORDS words or more. Other columns aren't
    carried: join by id.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), weighed(F.col(f"`{text_col}`").cast("string"), gain).alias("_w"))
    rows = rows.select("_id", "_w.*").withColumn("score", F.col("weight") + noise(F.col("_id"), seed))
    rows = stored(rows, "scored")
    able = F.col("words") >= LEAST_WORDS
    drawn = rows.where(able).count() * share[0] // share[1]
    order = numbered(rows.where(able), F.col("score").desc(), F.col("_id").asc_nulls_first(), F.col("weight").desc(), F.col("n_features"))
    ranked = order.withColumn("rank", F.when(F.col("_place") <= drawn, F.col("_place"))).drop("_place")
    return ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("bigint")))
