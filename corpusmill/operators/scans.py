"""Running values over a total order, by ranges: every group of any size is many tasks.

Rows are dealt into ranges of their order. Each range makes its own running values, and one row of totals for
each group in it; totals of earlier ranges are carried on. No group is ever ordered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import checkpointed

HOUR = 3600


def in_ranges(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with __range, the number of the range that each row fell into; written once, since ranges are sampled."""
    return checkpointed(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))


def _carried(ranged: DataFrame, by: list[str], totals: list[Column], carry: list[tuple[str, Column, bool]]) -> DataFrame:
    """ranged with what is carried on from earlier ranges of the same group: name, expression over totals, and whether
    it runs over the earlier ranges' rows (then null without any) or is made in a row."""
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    each = ranged.groupBy("__range", *by).agg(*totals)
    for name, value, runs in carry:
        each = each.withColumn(name, value.over(before) if runs else value)
    each = each.select(F.col("__range").alias("__r"), *[F.col(b).alias(f"__{b}") for b in by], *[n for n, _, _ in carry])
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.col("__range") == F.col("__r"))
    return ranged.join(each, same).drop("__r", *[f"__{b}" for b in by])


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    """rows with the sum of `value` up to and with each row, in each group; `order` must tell a group's rows apart."""
    ranged = _carried(in_ranges(rows, by, order), by, [F.sum(value).alias("__t")], [("__before", F.sum("__t"), True)])
    local = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn(name, F.coalesce("__before", F.lit(0)) + F.sum(value).over(local)).drop("__range", "__before")


def rolling_count(rows: DataFrame, by: list[str], at: str = "ts", seconds: int = HOUR, name: str = "in_last_hour") -> DataFrame:
    """rows with how many rows of their group lie in the `seconds` up to each one's second, its own included.

    Rows of one second count as one entry. The count is a difference of two running sums: up to the row's second,
    and before the second at which the frame begins, which stands as an entry of its own in the same order.
    """
    second = F.unix_timestamp(F.col(at).cast("timestamp"))
    marked = rows.withColumn("__s", second)
    counts = marked.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__n"))
    kind = lambda k, s, n: F.struct(F.lit(k).alias("__kind"), s.alias("__at"), n.alias("__v"))
    # a frame's beginning comes before the rows of that second
    entries = counts.select(*by, F.col("__s"), F.explode(F.array(kind(1, F.col("__s"), F.col("__n")), kind(0, F.col("__s") - seconds, F.lit(0).cast("bigint")))).alias("e"))
    entries = running_sum(entries.select(*by, "__s", "e.*"), by, ["__at", "__kind"], "__v", "__sum")
    ends = entries.groupBy(*[F.col(b).alias(f"__{b}") for b in by], F.col("__s").alias("__second")).agg((F.max("__sum") - F.min("__sum")).alias(name))
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.col("__s").eqNullSafe(F.col("__second")))
    return marked.join(ends, same).drop("__s", "__second", *[f"__{b}" for b in by])


def next_allowed(rows: DataFrame, by: list[str], order: list[str], add: str, floor: str, name: str = "allowed") -> DataFrame:
    """rows with the state after each: state = max(state + add, floor), from nothing, in each group; null floors don't count.

    Such steps compose: with A the running sum of `add`, the state is A plus the running maximum of floor - A.
    A range's sum and that maximum are all that later ranges need of it.
    """
    local = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = in_ranges(rows, by, order).withColumn("__a", F.sum(add).over(local)).withColumn("__b", F.col(floor) - F.col("__a"))
    totals = [F.sum(add).alias("__t"), F.max("__b").alias("__m")]
    carry = [("__sum", F.sum("__t"), True), ("__rest", F.col("__m") - F.coalesce("__sum", F.lit(0)), False), ("__most", F.max("__rest"), True)]
    ranged = _carried(ranged, by, totals, carry)
    sum_ = F.coalesce("__sum", F.lit(0))
    state = sum_ + F.col("__a") + F.greatest(F.col("__most"), F.max("__b").over(local) - sum_)
    return ranged.withColumn(name, state).drop("__range", "__a", "__b", "__sum", "__rest", "__most")


def governed_starts(requests: DataFrame, by: list[str], gap: Column, cooldown: Column, at: str = "ts", key: str = "request_id") -> DataFrame:
    """requests with starts_at and waited (microseconds): when each may start, `gap` microseconds after the one before.

    A request starts when it comes, or else once `gap` has passed since the start before it in its group and no
    cooldown lasts. cooldown: microseconds, from the request's time, for which its answer holds the group back;
    null if it doesn't. Requests take their turns by time, then key, and an answer counts before the next turn.
    One that waits longer than its caller would keeps its turn; `waited` tells.
    """
    entry = lambda k, add, floor: F.struct(F.lit(k).alias("__kind"), add.cast("bigint").alias("__add"), floor.cast("bigint").alias("__floor"))
    time = F.col("__t")
    rows = requests.withColumn("__t", F.unix_micros(F.col(at).cast("timestamp")))
    rows = rows.withColumn("__e", F.explode(F.array(entry(0, F.lit(0), time), entry(1, gap, time + cooldown)))).select("*", "__e.*").drop("__e")
    out = next_allowed(rows, by, ["__t", key, "__kind"], "__add", "__floor", "starts_at").where("__kind = 0")
    return out.withColumn("waited", F.col("starts_at") - time).drop("__t", "__kind", "__add", "__floor")
