"""Venues whose catalog is put together: a bibliography's volumes, an official title pool, and index enrichment.

The steps of `composed` are joins and filters on tables, in a fixed order; every one fills only what is missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import enrich
from corpusmill.operators.dedup import first_of_key, keep_best
from corpusmill.sources import indexes, pages

#: Pages of an archive that are followed at most; an archive that goes on is an error.
MOST_ARCHIVE_PAGES = 200


def volume_links(index_pages: DataFrame, venue: str, year: int) -> DataFrame:
    """url of the XML of every volume of a venue's year that its index pages (url, html) link to; a year may have several."""
    links = pages_links(index_pages)
    path = F.regexp_replace(pages.absolute(F.col("page"), F.col("href")), r"[?#].*$", "")
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    found = links.withColumn("path", path).withColumn("name", name)
    found = found.where(F.col("path").contains(f"/db/conf/{venue}/") & F.lower("path").endswith(".html") & F.col("name").contains(str(year)) & (F.col("name") != "index.html"))
    return found.select(F.regexp_replace("path", r"(?i)\.html$", ".xml").alias("url")).distinct()


def pages_links(index_pages: DataFrame) -> DataFrame:
    """page, pos, href, text of every link of pages (url, html)."""
    rows = index_pages.select(F.col("url").alias("page"), F.posexplode(pages.parsed(F.col("html"))["links"]).alias("pos", "x"))
    return rows.select("page", "pos", "x.href", "x.text")


@dataclass(frozen=True)
class TitlePool:
    """An official list of accepted titles: which elements hold them, and the fewest that make it credible."""

    link_pattern: str = r"."
    least: int = 1


def title_pool(index_pages: DataFrame, pool: TitlePool) -> DataFrame:
    """title, url of an official list's pages; empty if it holds too few to be believed."""
    links = pages_links(index_pages).where(F.col("href").rlike(pool.link_pattern) & T.looks_like_title(F.col("text")))
    one = first_of_key(links, T.title_key(F.col("text")), [F.col("page"), F.col("pos")])
    rows = one.select(T.clean(F.col("text")).alias("title"), pages.absolute(F.col("page"), F.col("href")).alias("url"))
    enough = rows.agg((F.count(F.lit(1)) >= pool.least).alias("__enough")).where("__enough")
    return rows.join(F.broadcast(enough), F.lit(True), "left_semi")  # one row at most


def composed(
    seed: DataFrame, pool: DataFrame | None = None, saved: DataFrame | None = None, by_identity: list[DataFrame] = (), by_title: list[DataFrame] = (), by_author: list[DataFrame] = ()
) -> DataFrame:
    """A venue's rows: the bibliography's titles joined with the official pool, restored, then enriched.

    seed: title, abstract, authors, url, pdf_url, doi, one row a title. pool adds titles that the seed lacks.
    saved holds what an earlier, broken-off run had completed (with saved_at). by_identity are indexes that
    match by title and DOI both, by_title those that match by title unless the DOIs differ, by_author those
    that need a common author as well. seed_only tells a row that nothing has confirmed yet.
    """
    rows = first_of_key(seed, T.title_key(F.col("title")), [F.col("url"), F.col("title")])
    if pool is not None:
        rows = enrich.merge_titles(rows, pool)
    else:
        rows = rows.withColumn("official_title_observed", F.lit(False))
    names = [c for c in rows.columns if c != "official_title_observed"]
    observed = rows.select(T.title_key(F.col("title")).alias("__t"), "official_title_observed")
    rows = rows.select(*names).fillna("", [c for c in ("abstract", "pdf_url", "doi") if c in names])
    if saved is not None:
        rows = enrich.restore_checkpoints(rows, saved, ["abstract", "pdf_url"])
    for index in by_identity:
        rows = enrich.fill_by_doi_and_title(rows, index)
    for index in by_title:
        rows = enrich.fill_by_title_or_doi(rows, index)
    for index in by_author:
        rows = enrich.fill_by_title(rows, index, authors_overlap=True)
    rows = rows.withColumn("__t", T.title_key(F.col("title"))).join(observed, "__t").drop("__t")
    return rows.withColumn("seed_only", ~F.col("official_title_observed") & T.missing(F.col("abstract")))


def from_first(proceedings: DataFrame, valid: Column, otherwise: DataFrame) -> DataFrame:
    """A proceedings page whose every row is valid makes the catalog by itself; else the composed one does."""
    return indexes.first_with_rows(indexes.all_or_nothing(proceedings, valid), otherwise)


def checkpoints(rows: DataFrame) -> DataFrame:
    """Rows worth saving between broken-off runs: title and what is complete by now."""
    return rows.where(~T.missing(F.col("abstract"))).select("title", "abstract", "pdf_url", F.current_timestamp().alias("saved_at"))


def issues(archive_pages: DataFrame, year: int) -> DataFrame:
    """label, url of a year's issues in an archive's pages (url, html, n: place in the chain of pages).

    Pages are in order, newest first: once issues of the year have come, the first page without one ends the
    list. An archive of more than MOST_ARCHIVE_PAGES pages is an error.
    """
    many = archive_pages.agg(F.max("n").alias("m")).select(F.when(F.col("m") >= MOST_ARCHIVE_PAGES, F.raise_error(F.lit("the archive has too many pages"))).otherwise(F.lit(True)).alias("__ok"))
    links = pages_links(archive_pages).where(F.col("href").contains("/issue/view/") & F.col("text").contains(str(year)))
    links = links.join(archive_pages.select(F.col("url").alias("page"), "n"), "page")
    after = archive_pages.select(F.col("url").alias("page"), "n").join(links.select("page").distinct(), "page", "left_anti")
    first = links.agg(F.min("n").alias("__first"))
    end = after.join(F.broadcast(first), F.col("n") > F.col("__first")).agg(F.min("n").alias("__end"))  # one row each
    kept = links.join(F.broadcast(end), F.coalesce(F.col("n") < F.col("__end"), F.lit(True))).join(F.broadcast(many.where("__ok")), F.lit(True), "left_semi")
    found = kept.select(F.coalesce(F.nullif(T.clean(F.col("text")), F.lit("")), F.lit(str(year))).alias("label"), pages.absolute(F.col("page"), F.col("href")).alias("url"), "n", "pos")
    return keep_best(found, ["label", "url"], [F.col("n"), F.col("pos")]).select("label", "url")


def articles(issue_pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """title, url, issue of every article of wanted issues (label, url), from issue pages (url, html); one row a title."""
    links = pages_links(issue_pages).join(wanted.select(F.col("url").alias("page"), F.col("label").alias("issue")), "page")
    links = links.where(F.col("href").rlike(pages.INDEX_LINKS["aaai"]) & T.looks_like_title(F.col("text")))
    one = first_of_key(links, T.title_key(F.col("text")), [F.col("page"), F.col("pos")])
    return one.select(T.clean(F.col("text")).alias("title"), pages.absolute(F.col("page"), F.col("href")).alias("url"), "issue")


def archive(archive_pages: DataFrame, issue_pages: DataFrame, detail_pages: DataFrame, year: int) -> DataFrame:
    """Archive to issues to articles to their details: title, abstract, authors, url, pdf_url, issue, identifiers."""
    rows = articles(issue_pages, issues(archive_pages, year)).join(pages.details(detail_pages), "url", "left")
    return rows.select("title", F.coalesce("abstract", F.lit("")).alias("abstract"), "authors", "url", "pdf_url", "issue", F.create_map(F.lit("doi"), F.coalesce("doi", F.lit(""))).alias("identifiers"))
