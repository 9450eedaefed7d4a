"""Where a paper's full text may be: ordered candidate links, official ones first, then open-access lookups.

Lookups are tables of earlier answers, joined by DOI or by exact title; a fuzzy title never counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.dedup import keep_best
from corpusmill.operators.records import pdf_candidates

CANDIDATE = "array<struct<url:string,kind:string>>"


def _one(lookup: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """The lookup's first answer for each key, by its own position, else the smallest link."""
    order = [F.col("_pos")] if "_pos" in lookup.columns else [F.col(f) for f in fields]
    return keep_best(lookup.withColumn("__k", key).where("__k <> ''"), ["__k"], order).select("__k", *[F.col(f).alias(f"__{f}") for f in fields])


def with_lookup(papers: DataFrame, lookup: DataFrame, name: str, by: str, fields: dict[str, str]) -> DataFrame:
    """papers with candidates (column `__found`) from a lookup's answer, by 'doi' or 'title'; fields: column to kind."""
    doi = lambda c: F.lower(T.clean(c))
    own = doi(F.col("identifiers")["doi"]) if by == "doi" else T.title_key(F.col("title"))
    theirs = doi(F.col("doi")) if by == "doi" else T.title_key(F.col("title"))
    one = _one(lookup, theirs, list(fields))
    out = papers.withColumn("__k", own).join(one, "__k", "left")
    found = F.array(*[F.struct(T.clean(F.col(f"__{c}")).alias("url"), F.lit(kind).alias("kind")) for c, kind in fields.items()])
    before = F.col("__found") if "__found" in papers.columns else F.array().cast(CANDIDATE)
    return out.select(*[c for c in papers.columns if c != "__found"], F.concat(before, found).alias("__found"))


def candidates(papers: DataFrame, lookups: list[tuple[DataFrame, str, str, dict[str, str]]] = (), repository_urls: str | None = None) -> DataFrame:
    """papers with `candidates`: distinct links in order, each with its kind.

    papers: title, url, pdf_url, identifiers, channel. Official links of the channel come first, then the
    record's own link, then repository pages, then each lookup's answer in the order given.
    """
    official = F.transform(pdf_candidates(F.col("channel")), lambda u: F.struct(u.alias("url"), F.lit("conference_official_pdf").alias("kind")))
    own = F.array(F.struct(T.clean(F.col("pdf_url")).alias("url"), F.lit("metadata_pdf").alias("kind")))
    parts = [official, own]
    if repository_urls is not None:
        pages = F.coalesce(F.col(repository_urls), F.array().cast("array<string>"))
        parts.append(F.transform(pages, lambda u: F.struct(T.clean(u).alias("url"), F.lit("repository_page").alias("kind"))))
    rows = papers.withColumn("__found", F.concat(*[p.cast(CANDIDATE) for p in parts]))
    rows = reduce(lambda out, x: with_lookup(out, *x), lookups, rows)
    links = F.filter("__found", lambda c: c["url"].startswith("http"))
    first = F.aggregate(
        links,
        F.array().cast(CANDIDATE),
        lambda kept, c: F.when(F.exists(kept, lambda k: k["url"] == c["url"]), kept).otherwise(F.concat(kept, F.array(c))),
    )
    return rows.withColumn("candidates", first).drop("__found")
