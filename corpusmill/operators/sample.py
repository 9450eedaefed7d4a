"""Exact stratified samples, replacements, and balanced batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import checkpointed


def draw_order(seed: str, key: Column) -> Column:
    """A seed-stable uniform order: the digest of seed and key."""
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def stratified_sample(rows: DataFrame, strata: list[str], per_stratum: int, seed: str, key: str = "identity") -> DataFrame:
    """Exactly per_stratum rows of each stratum (all of a smaller one), without replacement.

    Spark keeps at most per_stratum rows of a stratum in each task before the shuffle.
    """
    order = Window.partitionBy(*strata).orderBy(draw_order(seed, F.col(key)), F.col(key))
    return rows.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= per_stratum)


def short_strata(rows: DataFrame, strata: list[str], per_stratum: int) -> DataFrame:
    """Strata with too few rows, with their population."""
    return rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("population")).where(F.col("population") < per_stratum)


def strata_counts(rows: DataFrame, sample: DataFrame, strata: list[str]) -> DataFrame:
    """Population and sample size of each stratum."""
    return rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("population")).join(sample.groupBy(*strata).agg(F.count(F.lit(1)).alias("sampled")), strata, "left").fillna(0, ["sampled"])


def replacement_sample(rows: DataFrame, ready: DataFrame, attempted: DataFrame, strata: list[str], per_stratum: int, seed: str, round_: int, key: str = "identity") -> DataFrame:
    """Ready rows stay; what a stratum lacks is drawn from rows never attempted, under a seed of round and stratum."""
    kept = rows.join(ready.select(key).distinct(), key, "left_semi")
    lacking = rows.select(*strata).distinct().join(kept.groupBy(*strata).agg(F.count(F.lit(1)).alias("_kept")), strata, "left").select(*strata, (F.lit(per_stratum) - F.coalesce("_kept", F.lit(0))).alias("_lacking"))
    fresh = rows.join(attempted.select(key).distinct(), key, "left_anti")
    salted = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(round_), *[F.col(s).cast("string") for s in strata], F.col(key).cast("string")), 256)
    order = Window.partitionBy(*strata).orderBy(salted, F.col(key))
    drawn = fresh.withColumn("_draw", F.row_number().over(order)).where(F.col("_draw") <= per_stratum).join(lacking, strata).where(F.col("_draw") <= F.col("_lacking"))
    return kept.withColumn("origin", F.lit("kept")).unionByName(drawn.drop("_draw", "_lacking").withColumn("origin", F.lit("replacement")))


def balanced_batches(rows: DataFrame, order: list[Column], batches: int = 3) -> DataFrame:
    """batch 1..n of each row: contiguous in `order`, sizes apart by one at most, the larger first.

    For a queue of any size: rows are numbered by ranges (offsets of a bounded number of partitions) and the
    batch follows from the number, so the queue is never ordered in one task.
    """
    numbered = with_positions(rows, order)
    total = F.lit(rows.count())
    small, extra = F.floor(total / batches), total % batches
    at = F.col("position") - 1
    head = extra * (small + 1)
    return numbered.withColumn("batch", F.when(at < head, F.floor(at / (small + 1)) + 1).otherwise(extra + F.floor((at - head) / F.greatest(small, F.lit(1))) + 1).cast("int"))


def with_positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """position: 1-based place of each row in the total order of `order`, by range partitions and their sizes."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part, inside = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part).withColumn("_inside", inside).drop("_id")
    placed = checkpointed(placed)  # ranges are sampled: every use must see the same ones
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    offset, starts = 0, []
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(offset)]
        offset += sizes[p]
    base = F.element_at(F.create_map(*starts), F.col("_part")) if starts else F.lit(0)
    return placed.withColumn("position", (base + F.col("_inside") + 1).cast("bigint")).drop("_part", "_inside")
