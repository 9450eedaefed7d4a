"""Filling of missing fields by exact identities: titles, DOIs, both; one equi join a source, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.dedup import keep_best

FILLED = ("authors", "url", "pdf_url", "abstract")
#: Shortest abstract that an index may fill in.
LEAST_ABSTRACT = 80


def filled(rows: DataFrame, field: str, *more: Column) -> Column:
    """The row's own value, else the first of `more` that is not empty."""
    if dict(rows.dtypes)[field].startswith("array"):
        empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    else:
        empty = T.missing
    return F.coalesce(*[F.when(~empty(c), c) for c in (F.col(field), *more)], F.col(field))


def _one_a_key(pool: DataFrame, key: Column) -> DataFrame:
    """The pool's last row of each key in its own order, longest abstract first where there is one."""
    length = F.length(T.clean(F.col("abstract"))).desc() if "abstract" in pool.columns else F.lit(0)
    order = [length, F.col("_pos")] if "_pos" in pool.columns else [length, F.xxhash64(*pool.columns)]
    return keep_best(pool.withColumn("_k", key).where("_k <> ''"), ["_k"], order)


def merge_titles(primary: DataFrame, pool: DataFrame) -> DataFrame:
    """primary with missing fields filled from the pool's row of the same title; pool rows of other titles follow."""
    one = _one_a_key(pool, T.title_key(F.col("title")))
    named = one.select("_k", *[F.col(c).alias(f"_p_{c}") for c in pool.columns])
    rows = primary.withColumn("_k", T.title_key(F.col("title")))
    out = rows.join(named, "_k", "left")
    fields = [f for f in FILLED if f in primary.columns and f in pool.columns]
    merged = out.withColumns({f: filled(primary, f, F.col(f"_p_{f}")) for f in fields})
    if "identifiers" in primary.columns and "identifiers" in pool.columns:
        known = F.map_filter(F.coalesce("identifiers", F.create_map().cast("map<string,string>")), lambda _, v: ~T.missing(v))
        offered = F.map_filter(F.coalesce("_p_identifiers", F.create_map().cast("map<string,string>")), lambda k, v: ~T.missing(v) & ~F.map_contains_key(known, k))
        merged = merged.withColumn("identifiers", F.map_concat(known, offered))
    merged = merged.withColumn("official_title_observed", F.col("_p_title").isNotNull()).select(*primary.columns, "official_title_observed")
    alone = one.join(rows.select("_k").distinct(), "_k", "left_anti").drop("_k").withColumn("official_title_observed", F.lit(True))
    return merged.unionByName(alone, allowMissingColumns=True)


def fill_by_doi_and_title(rows: DataFrame, index: DataFrame, fields=("abstract", "pdf_url")) -> DataFrame:
    """Fields from the index row with the same DOI and the same title."""
    keyed = index.withColumn("_d", F.lower(T.clean(F.col("doi")))).withColumn("_t", T.title_key(F.col("title"))).where("_d <> '' AND _t <> ''")
    one = keep_best(keyed, ["_d", "_t"], [F.length(T.clean(F.col("abstract"))).desc(), F.xxhash64(*index.columns)])
    one = one.select("_d", "_t", *[F.col(f).alias(f"_i_{f}") for f in fields])
    left = rows.withColumn("_d", F.lower(T.clean(F.col("doi")))).withColumn("_t", T.title_key(F.col("title")))
    out = left.join(one, ["_d", "_t"], "left")
    return out.withColumns({f: filled(rows, f, F.col(f"_i_{f}")) for f in fields}).select(*rows.columns)


def _row_key(rows: DataFrame) -> Column:
    """128 bits of a row's values; rows that are equal throughout share a key, and are filled alike."""
    values = [F.to_json(c) if "map" in t else F.col(c) for c, t in rows.dtypes]
    return F.struct(F.xxhash64(F.lit(1), *values), F.xxhash64(F.lit(2), *values))


def fill_by_title(rows: DataFrame, index: DataFrame, fields=("abstract", "pdf_url"), authors_overlap: bool = False) -> DataFrame:
    """Fields from the index row with the same title whose DOI doesn't differ (and, if asked, with a common author).

    The residual is checked before the best row of a title is chosen: the smallest _pos, else the longest abstract.
    """
    position = F.col("_i__pos") if "_pos" in index.columns else F.lit(0)
    right = index.select(T.title_key(F.col("title")).alias("_t"), *[F.col(c).alias(f"_i_{c}") for c in index.columns]).where("_t <> ''")
    left = rows.withColumn("_t", T.title_key(F.col("title"))).withColumn("_row", _row_key(rows))
    own, other = F.lower(T.clean(F.col("doi"))), F.lower(T.clean(F.col("_i_doi")))
    fits = (own == "") | (other == "") | (own == other)
    if authors_overlap:
        fits = fits & F.arrays_overlap(T.family_names(F.col("authors")), T.family_names(F.col("_i_authors")))
    usable = F.length(T.clean(F.col("_i_abstract"))) >= LEAST_ABSTRACT
    found = left.join(right, "_t").where(fits & usable).select("_row", *[F.col(f"_i_{f}") for f in fields], F.struct(-position, F.length(T.clean(F.col("_i_abstract"))), F.xxhash64(*[F.col(f"_i_{f}") for f in fields])).alias("_o"))
    best = found.groupBy("_row").agg(*[F.max_by(f"_i_{f}", "_o").alias(f"_i_{f}") for f in fields])
    out = left.join(best, "_row", "left")
    return out.withColumns({f: filled(rows, f, F.col(f"_i_{f}")) for f in fields}).select(*rows.columns)


def fill_by_title_or_doi(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Abstract by title, else by DOI; differing DOIs never match. Two equi joins, never one with OR."""
    by_title = fill_by_title(rows, index)
    one = _one_a_key(index.where(F.length(T.clean(F.col("abstract"))) >= LEAST_ABSTRACT), F.lower(T.clean(F.col("doi")))).select("_k", F.col("abstract").alias("_a"), F.col("pdf_url").alias("_u"))
    out = by_title.withColumn("_k", F.lower(T.clean(F.col("doi")))).join(one, "_k", "left")
    lacks = T.missing(F.col("abstract"))
    return out.withColumn("pdf_url", F.when(lacks, filled(by_title, "pdf_url", F.col("_u"))).otherwise(F.col("pdf_url"))).withColumn("abstract", filled(by_title, "abstract", F.col("_a"))).select(*rows.columns)


def restore_checkpoints(rows: DataFrame, saved: DataFrame, fields: list[str], key: str = "title") -> DataFrame:
    """Fields that an earlier run had completed, by title."""
    one = keep_best(saved.withColumn("_k", T.title_key(F.col(key))).where("_k <> ''"), ["_k"], [F.col("saved_at").desc(), F.xxhash64(*saved.columns)])
    out = rows.withColumn("_k", T.title_key(F.col(key))).join(one.select("_k", *[F.col(f).alias(f"_s_{f}") for f in fields]), "_k", "left")
    return out.withColumns({f: filled(rows, f, F.col(f"_s_{f}")) for f in fields}).select(*rows.columns)


def alias_lookup(papers: DataFrame, aliases: DataFrame) -> DataFrame:
    """identity, cache_dir of the first of a paper's aliases that the alias table knows. papers: identity, aliases."""
    each = papers.select("identity", F.posexplode("aliases").alias("pos", "alias"))
    found = each.join(aliases.select("alias", "cache_dir"), "alias")
    return found.groupBy("identity").agg(F.min_by(F.struct("cache_dir", "alias"), F.struct("pos", "cache_dir")).alias("x")).select("identity", "x.cache_dir", F.col("x.alias").alias("cache_alias"))
