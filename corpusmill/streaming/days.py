"""Structured Streaming forms of the daily shards: closed days by watermark, provisional ones by updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late a record may come.
LATENESS = "3 days"


def event_time(rows: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less times as UTC instants: a watermark needs the timestamp type."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def daily_counts(rows: DataFrame, by: list[str], column: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """day, by, row_count. In append mode a day comes out once it is closed; in update mode while provisional, too."""
    day = F.window(column, "1 day")
    counted = event_time(rows, column).withWatermark(column, lateness).groupBy(day.alias("w"), *by).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.to_date("w.start").alias("day"), *by, "row_count")


def distinct_incidents(rows: DataFrame, key: str = "incident_id", column: str = "at", lateness: str = LATENESS) -> DataFrame:
    """Each incident once, however often it is reported within the lateness."""
    return event_time(rows, column).withWatermark(column, lateness).dropDuplicatesWithinWatermark([key])


def warning_log(snapshots: DataFrame) -> DataFrame:
    """action (raised or resolved), message, stage, at from snapshots of active warnings (run_id, at, stage, warnings).

    A state for each run: the warnings of its last snapshot. For snapshots that come in order; see ordered_warnings.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        before = list(state.get[0]) if state.exists else []
        out = []
        for frame in frames:
            for row in frame.sort_values("at").itertuples():
                now = list(row.warnings)
                out += [(key[0], "raised", m, row.stage, row.at) for m in now if m not in before]
                out += [(key[0], "resolved", m, row.stage, row.at) for m in before if m not in now]
                before = now
        state.update((before,))
        yield pd.DataFrame(out, columns=["run_id", "action", "message", "stage", "at"])

    schema = "run_id string, action string, message string, stage string, at timestamp"
    return snapshots.groupBy("run_id").applyInPandasWithState(step, schema, "active array<string>", "append", GroupStateTimeout.NoTimeout)


#: Snapshots that wait in one entry of a state.
SNAPSHOTS_AN_ENTRY = 1000


def _warnings_processor():
    """Built where it is used: the class travels to the workers."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    columns = {"at": LongType(), "seq": LongType(), "stage": StringType(), "warnings": ArrayType(StringType())}
    waiting = StructType([StructField(n, ArrayType(t)) for n, t in columns.items()])  # many snapshots an entry: each entry has its price
    change = Row("run_id", "action", "message", "stage", "at_us")
    active = StructType([StructField("warnings", ArrayType(StringType())), StructField("n", IntegerType())])

    def entries(snapshots):
        return [tuple(map(list, zip(*snapshots[i : i + SNAPSHOTS_AN_ENTRY]))) for i in range(0, len(snapshots), SNAPSHOTS_AN_ENTRY)]

    class Warnings(StatefulProcessor):
        """Snapshots wait, as a list in state, until the watermark says that none before them can come; a timer then
        tells them apart from the one before, in their order. A timer stands for the earliest of many, so the list is
        written once a batch and read once for all that are ready."""

        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", waiting)
            self.active = handle.getValueState("active", active)

        def handleInputRows(self, key, rows, timerValues):
            new = [(r.at_us, r.seq, r.stage, list(r.warnings or [])) for r in rows]
            if new:
                self.waiting.appendList(entries(new))
                self.handle.registerTimer(-(-min(x[0] for x in new) // 1000))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            until = timerValues.getCurrentWatermarkInMs() * 1000
            held = sorted(x for entry in self.waiting.get() for x in zip(*entry))
            ready = [x for x in held if x[0] <= until]
            if not ready:
                return
            before = list(self.active.get()[0]) if self.active.exists() else []
            for at, _, stage, now in ready:
                for action, here, there in (("raised", now, before), ("resolved", before, now)):
                    for message in dict.fromkeys(here):
                        if message not in there:
                            yield change(key[0], action, message, stage, at)
                before = now
            self.active.update((before, len(before)))
            rest = held[len(ready) :]
            if rest:
                self.waiting.put(entries(rest))
                self.handle.registerTimer(-(-rest[0][0] // 1000))  # beyond the watermark
            else:
                self.waiting.clear()

        def close(self):
            pass

    return Warnings()


#: The state store that list state and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ordered_warnings(snapshots: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """run_id, action, message, stage, at from snapshots (run_id, at, seq, stage, warnings) that come in any order within the lateness.

    A snapshot counts once the watermark has passed it; those of one time go by seq. What the batch form
    (runs.warning_history) says of the same snapshots comes out, each change once. One later than the lateness is
    dropped. The session needs STATE_STORE as its provider.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField(n, LongType() if n == "at_us" else StringType()) for n in ("run_id", "action", "message", "stage", "at_us")])
    rows = event_time(snapshots, "at").withWatermark("at", lateness)
    rows = rows.select(F.col("run_id").cast("string").alias("run_id"), "at", F.unix_micros("at").alias("at_us"), F.col("seq").cast("bigint").alias("seq"), F.col("stage").cast("string").alias("stage"), "warnings")
    out = rows.groupBy("run_id").transformWithState(_warnings_processor(), schema, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")
