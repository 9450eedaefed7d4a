"""Keep-best and first-of-key operators. Every choice has a total order, so ties never depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.session import checkpointed


def keep_best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in `order`; Spark limits each task's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def keep_longest_abstract(rows: DataFrame, key: str = "identity", text: str = "abstract", position: list[str] | None = None) -> DataFrame:
    """The row with the longest abstract of each identity, ties to the earliest; first_position is the key's first place.

    A place (`position`) names one row, the same in every evaluation: a column of a stored table. A grouped maximum of lengths and places finds each key's winner; it is
    combined before its shuffle, so a key with many rows is no hot task, and moves no texts. The winners' other
    columns are then fetched by place: only those that are used later.
    """
    position = position or ["_source_index", "_source_pos"]
    place = F.struct(*position)
    # largest length first, then the smallest place: max over (length, negated place)
    back = [(-F.col(p)).alias(f"_{i}") for i, p in enumerate(position)]
    best = rows.groupBy(F.col(key).alias("__key")).agg(
        F.max_by(place, F.struct(F.length(T.clean(F.col(text))).alias("_n"), *back)).alias("__place"), F.min(place).alias("first_position")
    )
    best = best.select("__key", F.col("first_position"), *[F.col(f"__place.{p}").alias(f"__{p}") for p in position])
    same = F.col(key).eqNullSafe(F.col("__key"))
    for p in position:
        same = same & (F.col(p) == F.col(f"__{p}"))
    return rows.join(best, same).select(*rows.columns, "first_position")


def latest_version(rows: DataFrame, key: str = "identity", version: str = "version") -> DataFrame:
    """The highest whole-number version of each key, then the latest date, then the longest abstract, then the earliest row."""
    number = F.coalesce(F.expr(f"try_cast({version} AS int)"), F.lit(0))
    return keep_best(rows, [key], [number.desc(), F.col("published").desc_nulls_last(), F.length(T.clean(F.col("abstract"))).desc(), F.col("_source_index"), F.col("_source_pos")])


def newest_complete(copies: DataFrame) -> DataFrame:
    """Of each venue and year the complete copy fetched last, then the one with more rows."""
    return keep_best(copies.where("complete"), ["venue", "year"], [F.col("fetched_at").desc(), F.col("row_count").desc(), F.col("path")])


def first_of_key(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; rows without a key are dropped."""
    return keep_best(rows.withColumn("__key", key).where(F.coalesce(F.col("__key").cast("string"), F.lit("")) != ""), ["__key"], order).drop("__key")


def union_sources(sources: list[DataFrame], stored: bool = True) -> DataFrame:
    """UNION ALL in plan order: _source_index and _source_pos make 'first' mean something.

    Places that are made here hold for one evaluation: the rows are written once, unless the caller does that
    itself (stored=False) before anything else.
    """
    out = None
    for i, source in enumerate(sources):
        rows = source.withColumn("_source_index", F.lit(i))
        if "_source_pos" not in source.columns:
            rows = rows.withColumn("_source_pos", F.monotonically_increasing_id())
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return checkpointed(out) if stored and any("_source_pos" not in s.columns for s in sources) else out


def duplicate_sections(sections: DataFrame, least: int = 120) -> DataFrame:
    """identity, section of every section of `least` or more characters without spaces that another identity has too.

    sections: identity, section, body. Grouped by a digest; a section of copies never meets in one task.
    """
    marked = sections.withColumn("_norm", F.regexp_replace(T.text(F.col("body")), T.SPACES, "")).where(F.length("_norm") >= least).withColumn("_d", F.sha2("_norm", 256))
    shared = marked.groupBy("section", "_d").agg(F.min("identity").alias("a"), F.max("identity").alias("b")).where("a <> b").select("section", "_d")
    return marked.join(shared, ["section", "_d"], "left_semi").select("identity", "section").distinct()
