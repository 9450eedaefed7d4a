"""Keep-best, day by day: a table of winners in buckets of their keys, of which a merge reads and writes those it touches.

A day's rows are reduced to one candidate a key, then merged with the winners of the buckets that the candidates fall
into. Merging day after day gives what keep-longest gives on all days at once: the longest abstract, of equally long
ones the earliest place, and the key's first place of all days. Merging a day again changes nothing.

Each merge writes its buckets to a place of its own and then records them; the latest record of a bucket counts.
A merge that breaks off has recorded nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.session import exists, remove

#: Buckets of a table: as many parts as a merge can leave untouched.
BUCKETS = 256
_RECORD = "bucket int, generation bigint, place string"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def candidates(rows: DataFrame, key: str = "identity", text: str = "abstract", position: tuple[str, ...] = ("_source_index", "_source_pos")) -> DataFrame:
    """One row a key: its columns as they won (struct best), its length, place and first place."""
    place = F.struct(*position)
    back = F.struct(*[(-F.col(p)).alias(p) for p in position])
    order = F.struct(F.length(T.clean(F.col(text))).alias("n"), back.alias("back"))
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(F.col(key).alias("key")).agg(F.max_by(row, order).alias("best"), F.max(order).alias("order"), F.min(place).alias("first_position"))


def _records(spark: SparkSession, path: str) -> dict[int, tuple[int, str]]:
    """The latest record of each bucket: at most a row a bucket reaches the driver."""
    if not exists(spark, f"{path}/records"):
        return {}
    rows = spark.read.schema(_RECORD).parquet(f"{path}/records")
    last = rows.groupBy("bucket").agg(F.max(F.struct("generation", "place")).alias("r")).select("bucket", "r.*")
    return {r.bucket: (r.generation, r.place) for r in last.collect()}


def _read(spark: SparkSession, known: dict[int, tuple[int, str]], only: list[int] | None = None) -> DataFrame | None:
    places = sorted(f"{place}/bucket={b}" for b, (_, place) in known.items() if only is None or b in only)
    return spark.read.parquet(*places) if places else None


def merge(rows: DataFrame, path: str, buckets: int = BUCKETS, **how) -> list[int]:
    """Merges rows into the winners at path; returns the buckets that were read and written anew."""
    spark, place = rows.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    new = candidates(rows, **how).withColumn("bucket", bucket_of(F.col("key"), buckets))
    aside = f"{path}/_aside/{uuid.uuid4().hex}"
    new.write.partitionBy("bucket").parquet(aside)  # evaluated once; its folders tell which buckets are touched
    new = spark.read.schema(new.schema).parquet(aside)
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most `buckets` numbers
    if touched:
        known = _records(spark, path)
        old = _read(spark, known, touched)
        both = new.drop("bucket") if old is None else old.select(*[c for c in new.columns if c != "bucket"]).unionByName(new.drop("bucket"))
        best = both.groupBy("key").agg(F.max_by("best", "order").alias("best"), F.max("order").alias("order"), F.min("first_position").alias("first_position"))
        best.withColumn("bucket", bucket_of(F.col("key"), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(place)
        generation = 1 + max((g for g, _ in known.values()), default=0)
        spark.createDataFrame([(b, generation, place) for b in touched], _RECORD).coalesce(1).write.mode("append").parquet(f"{path}/records")
    remove(spark, aside)
    return touched


def winners(spark: SparkSession, path: str) -> DataFrame | None:
    """The winning rows with first_position; None before the first merge."""
    rows = _read(spark, _records(spark, path))
    return None if rows is None else rows.select("best.*", "first_position")
