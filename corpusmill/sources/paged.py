"""Staged pages of paged listings: which are valid, whether a range is whole, where reading goes on.

A staged page is one row: key (what was asked for), start (rows before it), total (as the server told it),
schema_version, items (array of structs). Pages stay until their range is published; reading goes on where
the valid pages of a range end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_VERSION = 1


def valid_pages(pages: DataFrame, item_ok: Column | None = None, declared: str | None = None) -> DataFrame:
    """Pages of the known version that hold a list, as many items as they declare, and only items that pass.

    item_ok: of a single item, told as a lambda over the array's elements.
    """
    ok = (F.col("schema_version") == PAGE_VERSION) & F.col("key").isNotNull() & (F.col("start") >= 0) & F.col("items").isNotNull()
    if declared is not None:
        ok = ok & (F.col(declared) == F.size("items"))
    if item_ok is not None:
        ok = ok & F.forall("items", item_ok)
    return pages.where(F.coalesce(ok, F.lit(False)))


def ranges(pages: DataFrame, growing: bool = False) -> DataFrame:
    """key, pages, rows, total, error of every range: rows counts the pages that follow each other without a gap.

    growing: the total may rise while the listing is read (then its maximum counts), else it must not change.
    error: total_changed, gap (a page is missing before another), short (the listing goes on), or empty.
    """
    order = Window.partitionBy("key").orderBy("start")
    before = F.coalesce(F.sum(F.size("items")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = pages.withColumn("__joined", F.col("start") == before)
    each = each.withColumn("__whole", F.min(F.col("__joined").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    out = each.groupBy("key").agg(
        F.count(F.lit(1)).alias("pages"),
        F.coalesce(F.sum(F.when(F.col("__whole"), F.size("items"))), F.lit(0)).alias("rows"),
        F.max("total").alias("total"),
        (F.max("total") != F.min("total")).alias("__changed"),
        (~F.min("__whole")).alias("__gap"),
        F.max((F.size("items") == 0) & F.col("__whole")).alias("__ended"),
    )
    changed = F.lit(False) if growing else F.col("__changed")
    ended = F.col("__ended") if growing else F.lit(False)  # an empty last page ends a growing listing
    error = F.when(changed, "total_changed").when(F.col("__gap"), "gap").when((F.col("rows") < F.col("total")) & ~ended, "short").otherwise("")
    return out.withColumn("error", error).drop("__changed", "__gap", "__ended")


def rows_of(pages: DataFrame, state: DataFrame) -> DataFrame:
    """key and fields of every item of the ranges without an error; a page read twice counts once."""
    whole = state.where("error = ''").select("key")
    once = pages.dropDuplicates(["key", "start"]).join(whole, "key", "left_semi")
    return once.select("key", "start", F.posexplode("items").alias("__pos", "item")).select("key", (F.col("start") + F.col("__pos")).alias("position"), "item.*")


def still_to_read(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """key, start from which reading of a wanted range goes on; whole ranges are gone, failed totals start anew."""
    known = state.select("key", "rows", "error")
    start = F.when(F.col("error") == "total_changed", F.lit(0)).otherwise(F.coalesce("rows", F.lit(0)))
    return wanted.select("key").distinct().join(known, "key", "left").where("error IS NULL OR error <> ''").select("key", start.cast("bigint").alias("start"))


def receipts(state: DataFrame, by: Column) -> DataFrame:
    """Receipts of ranges rolled up: server total, rows and pages of each group, and whether all its ranges are whole."""
    return state.groupBy(by.alias("group")).agg(
        F.sum("total").alias("server_total"), F.sum("rows").alias("fetched"), F.sum("pages").alias("requests"), F.count(F.lit(1)).alias("chunks"), F.bool_and(F.col("error") == "").alias("exhausted")
    )
