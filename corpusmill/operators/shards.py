"""Daily shards: manifests, what is missing or stale, closed and provisional days, atomic publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.dedup import keep_best

SCHEMA_VERSION = 2
#: Closed days that are read again for late records, and how old such a reading may be.
RECHECK_DAYS, RECHECK_AGE = 3, 1.0


def day_range(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS day")


def months_back(as_of: Column, months: int = 6) -> Column:
    """The same day so many months before, or that month's last."""
    return F.add_months(as_of, -months)


def fresh(fetched_at: Column, now: Column, days: float) -> Column:
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(fetched_at)) <= F.lit(days * 86400.0), F.lit(False))


def with_status(days: DataFrame, as_of: Column, day: str = "day") -> DataFrame:
    """closed: before as_of, complete and immutable; provisional otherwise."""
    closed = F.col(day) < as_of
    return days.withColumn("complete", closed).withColumn("provisional", ~closed).withColumn("temporal_status", F.when(closed, "closed").otherwise("provisional"))


def usable(manifest: DataFrame, source: str, as_of: Column, now: Column, policy: str = "reuse", max_age_days: float = 7.0) -> DataFrame:
    """Shards that need no new reading: valid, complete, closed, and fresh enough for their source.

    One source's closed days expire; the other's only while late records may still come, and those must show
    that their reading was exhausted.
    """
    rows = manifest.where((F.col("source") == source) & (F.col("schema_version") == SCHEMA_VERSION) & F.col("complete") & ~F.col("provisional") & (F.col("date") < as_of))
    if policy == "refresh":
        return rows.limit(0)
    if source == "biorxiv":
        rows = rows.where(F.col("exhaustion_proof").isNotNull() & (F.col("server_total") == F.col("row_count")))
        if policy == "only":
            return rows
        late = F.datediff(as_of, F.col("date")) <= RECHECK_DAYS
        return rows.where(~late | fresh(F.col("fetched_at"), now, min(max_age_days, RECHECK_AGE)))
    return rows if policy == "only" else rows.where(fresh(F.col("fetched_at"), now, max_age_days))


def missing_days(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return wanted.join(present.select(*on).distinct(), on, "left_anti")


def month_chunks(days: DataFrame, day: str = "day") -> DataFrame:
    """Missing days as one range a month: month, first_day, last_day, n_days."""
    return days.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n_days"))


def manifest_of(rows: DataFrame, wanted: DataFrame, as_of: Column, keys: list[str]) -> DataFrame:
    """A manifest row for every wanted shard, empty days too: row_count and status."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return with_status(wanted.join(counts, keys, "left").fillna(0, ["row_count"]), as_of)


def publish(rows: DataFrame, manifest: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces only the partitions that rows hold, then records every shard, empty ones too.

    The manifest is a log: a shard's latest record supersedes the ones before (see manifest), so publishing
    again changes nothing but the time of recording.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/data")
    manifest.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest record of every published shard."""
    return keep_best(spark.read.parquet(f"{path}/manifest"), keys, [F.col("recorded_at").desc()]).drop("recorded_at")


def read_range(spark: SparkSession, path: str, first: str, last: str, day: str = "day") -> DataFrame:
    """Only the day partitions asked for are listed and read."""
    return spark.read.parquet(f"{path}/data").where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def bisect(counts: dict[str, int], first: int, last: int, days: list[str], ceiling: int = 10_000, whole_days: bool = False) -> list[tuple[str, str]]:
    """Day ranges below the ceiling, halving what is above. A single day above it is an error, as a server gives no more
    at once, or with whole_days a range of its own, as for days that are here already. For partition planning."""
    total = sum(counts.get(d, 0) for d in days[first : last + 1])
    if total < ceiling or (whole_days and first == last):
        return [(days[first], days[last])]
    if first == last:
        raise ValueError(f"{days[first]} alone has {total} rows")
    middle = (first + last) // 2
    return bisect(counts, first, middle, days, ceiling, whole_days) + bisect(counts, middle + 1, last, days, ceiling, whole_days)


def cache_inventory(listing: DataFrame) -> DataFrame:
    """layout, files, bytes from a file listing with path and length."""
    layout = F.coalesce(F.nullif(F.regexp_extract("path", r"/(arxiv|biorxiv|venues|fulltext)/", 1), F.lit("")), F.lit("other"))
    return listing.groupBy(layout.alias("layout")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def recovered(receipts: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Catalogs of old runs that a complete receipt of the same venue, year and count vouches for."""
    good = receipts.where("status = 'complete' AND complete_catalog").select("venue", "year", F.col("count").alias("row_count")).distinct()
    return catalogs.where("metadata_completeness_ok").join(good, ["venue", "year", "row_count"], "left_semi")

