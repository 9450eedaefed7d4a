"""Run state as an append-only log and its fold, rolling quotas, and requeueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.scans import rolling_count
from corpusmill.session import checkpointed


def warning_history(snapshots: DataFrame) -> DataFrame:
    """run_id, at, stage, action, message: what each snapshot raised and resolved against the one before."""
    before = F.coalesce(F.lag("warnings").over(Window.partitionBy("run_id").orderBy("at", "seq")), F.array().cast("array<string>"))
    rows = snapshots.withColumn("_before", before)
    each = lambda action, a, b: rows.select("run_id", "at", "stage", F.lit(action).alias("action"), F.explode(F.array_except(a, b)).alias("message"))
    return each("raised", "warnings", "_before").unionByName(each("resolved", "_before", "warnings"))


def run_state(events: DataFrame) -> DataFrame:
    """Latest stage, status and warnings of each run, with counts merged: the last value of each name.

    events: run_id, at, seq, stage, status, counts map<string,bigint>, warnings.
    """
    order = F.struct("at", "seq")
    last = events.groupBy("run_id").agg(*[F.max_by(c, order).alias(c) for c in ("stage", "status", "warnings")], F.max("at").alias("updated_at"))
    each = events.select("run_id", "at", "seq", F.explode("counts").alias("name", "value"))
    counts = each.groupBy("run_id", "name").agg(F.max_by("value", order).alias("value"))
    merged = counts.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("counts"))
    return last.join(merged, "run_id", "left")


def next_index(history: DataFrame) -> DataFrame:
    """invocation_index of the next round of each run."""
    return history.groupBy("run_id").agg((F.max("invocation_index") + 1).alias("invocation_index"))


def append_round(rounds: DataFrame, path: str) -> None:
    rounds.write.mode("append").parquet(path)


def lineage(runs: DataFrame) -> DataFrame:
    """run_id, ancestor, distance along parent_run_id, however long the chain; a run that is its own ancestor is an error.

    Paths double in each round: what is known up to distance 2^k, carried on from the ancestor at that distance,
    is known up to 2^(k+1). A chain of a thousand takes ten rounds. An ancestor that is no run ends its chain.
    """
    step = runs.where("run_id IS NOT NULL AND parent_run_id IS NOT NULL").select("run_id", F.col("parent_run_id").alias("ancestor"), F.lit(1).cast("bigint").alias("distance")).distinct()
    paths, reach = checkpointed(step), 1
    while True:
        looped = paths.where("run_id = ancestor").select("run_id").distinct().orderBy("run_id").limit(5).collect()
        if looped:
            raise ValueError("runs that are their own ancestors: " + ", ".join(str(r.run_id) for r in looped))
        jump = paths.where(F.col("distance") == reach).select("run_id", F.col("ancestor").alias("_at"))
        onward = paths.select(F.col("run_id").alias("_at"), "ancestor", (F.col("distance") + reach).alias("distance"))
        more = checkpointed(jump.join(onward, "_at").select("run_id", "ancestor", "distance").distinct())
        if more.isEmpty():
            return paths
        paths, reach = checkpointed(paths.unionByName(more)), 2 * reach


def inherited(settings: DataFrame, ancestors: DataFrame) -> DataFrame:
    """run_id, name, value, origin: settings that a run's ancestors locked; of one name the nearest one's.

    settings: run_id, name, value, locked. A run's own settings are not among them: see broken_locks.
    """
    held = settings.where("locked").select(F.col("run_id").alias("ancestor"), "name", "value")
    each = ancestors.join(held, "ancestor")
    order = F.struct("distance", "ancestor", "value")
    return each.groupBy("run_id", "name").agg(F.min_by("value", order).alias("value"), F.min_by("ancestor", order).alias("origin"))


def broken_locks(settings: DataFrame, ancestors: DataFrame) -> DataFrame:
    """run_id, name of inherited settings that a run's own plan sets otherwise, or not at all."""
    own = settings.select("run_id", "name", F.col("value").alias("_own"))
    return inherited(settings, ancestors).join(own, ["run_id", "name"], "left").where("NOT (_own <=> value)").select("run_id", "name")


def rolling_quota(requests: DataFrame, by: list[str], at: str = "ts", limit: int = 60) -> DataFrame:
    """requests with in_last_hour (this one included) and whether the quota was kept; a busy service is many tasks."""
    return rolling_count(requests, by, at).withColumn("within_quota", F.col("in_last_hour") <= limit)


def retry_after(value: Column, now: Column, cap: int = 86400) -> Column:
    """Seconds of a Retry-After value: a whole number, or an HTTP date against now; capped, never negative."""
    seconds = F.coalesce(value.try_cast("bigint"), F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))) - F.unix_timestamp(now))
    return F.least(F.greatest(seconds, F.lit(0)), F.lit(cap))


def requeue(items: DataFrame) -> DataFrame:
    """Items that one more serial pass may still get."""
    return items.where("retryable_after_cooldown AND NOT full_text_available")
