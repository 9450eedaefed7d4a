"""Shared runs of words between a large table of texts and a small one, found by hashes and proved on the words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

#: Hashes of the smaller side up to which they are broadcast (16 bytes each); they are counted first.
BROADCAST_HASHES = 1_000_000


def hashed_runs(rows: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, h of every distinct run of n English words of each text. Runs are hashed where they stand: no run is moved."""
    return rows.select(key, F.explode(T.shingle_hashes(T.english_words(F.col(text)), n)).alias("h"))


def shared_runs(texts: DataFrame, items: DataFrame, key: str, item: str, text: str = "text", n: int = 10) -> DataFrame:
    """key, item of every pair that shares a run of n English words.

    Hashes propose pairs: 16 bytes a run of the items, broadcast if they are few, else both sides meet on the
    hash. The words of the few proposed pairs are then compared, so that no collision counts.
    """
    wanted = hashed_runs(items, item, text, n)
    few = wanted.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    hits = hashed_runs(texts, key, text, n).join(F.broadcast(wanted) if few else wanted, "h").select(key, item).distinct()
    both = hits.join(texts.select(key, F.col(text).alias("__t")), key).join(items.select(item, F.col(text).alias("__i")), item)
    return both.where(T.copied(F.col("__i"), F.col("__t"), n)).select(key, item)
