"""Dumps of bibliographic indexes, as rows for the enrichment joins: title, doi, abstract, pdf_url, authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.session import scratch

WORK = "struct<doi:string,title:string,abstract_inverted_index:map<string,array<int>>,best_oa_location:struct<pdf_url:string>,authorships:array<struct<author:struct<display_name:string>>>>"
PIDS = "array<struct<scheme:string,value:string>>"
PRODUCT = f"struct<type:string,mainTitle:string,descriptions:array<string>,pids:{PIDS},instances:array<struct<urls:array<string>,alternateIdentifiers:{PIDS}>>>"
PDF = r"(?i)\.pdf(?:$|[?#])"


def inverted(spark: SparkSession, path: str) -> DataFrame:
    """Works whose abstracts are inverted indexes ({"results": [...]})."""
    return inverted_rows(spark.read.schema(f"results array<{WORK}>").option("multiLine", True).json(path).select(F.explode("results").alias("w")).select("w.*"))


def inverted_rows(rows: DataFrame) -> DataFrame:
    """Works of the type WORK as index rows."""
    return rows.select(
        T.clean(F.col("title")).alias("title"),
        T.doi(F.col("doi")).alias("doi"),
        T.clean(F.when(F.col("abstract_inverted_index").isNotNull(), T.from_inverted_index(F.col("abstract_inverted_index")))).alias("abstract"),
        F.col("best_oa_location.pdf_url").alias("pdf_url"),
        T.clean_authors(F.transform("authorships", lambda a: a["author"]["display_name"])).alias("authors"),
    )


def flat(spark: SparkSession, path: str) -> DataFrame:
    """Papers given as a plain list of objects with externalIds and openAccessPdf."""
    paper = "title string, abstract string, externalIds struct<DOI:string>, openAccessPdf struct<url:string>, authors array<struct<name:string>>"
    rows = spark.read.schema(paper).option("multiLine", True).json(path)
    return rows.select(T.clean(F.col("title")).alias("title"), F.lower(T.clean(F.col("externalIds.DOI"))).alias("doi"), T.clean(F.col("abstract")).alias("abstract"), F.col("openAccessPdf.url").alias("pdf_url"), T.clean_authors(F.transform("authors", lambda a: a["name"])).alias("authors"))


def scalars(json: Column) -> Column:
    """Values of JSON that stands for XML: one scalar or a list, each bare or as {"$": value}."""
    listed = F.when(F.ltrim(json).startswith("["), F.from_json(json, "array<string>")).otherwise(F.array(json))
    return F.filter(F.transform(listed, lambda v: T.clean(F.coalesce(F.get_json_object(v, "$['$']"), v))), lambda v: v != "")


def publications(spark: SparkSession, path: str) -> DataFrame:
    """Research products ({"results": [...]}) of type publication: every DOI of theirs is one row."""
    return publication_rows(spark.read.schema(f"results array<{PRODUCT}>").option("multiLine", True).json(path).select(F.explode("results").alias("w")).select("w.*"))


def publication_rows(rows: DataFrame) -> DataFrame:
    """Products of the type PRODUCT as index rows."""
    pid = PIDS
    rows = rows.where("type = 'publication'")
    none = F.array().cast(pid)
    ids = F.concat(F.coalesce("pids", none), F.coalesce(F.flatten(F.transform("instances", lambda i: F.coalesce(i["alternateIdentifiers"], none))), none))
    dois = F.array_distinct(F.transform(F.filter(ids, lambda p: F.lower(T.clean(p["scheme"])) == "doi"), lambda p: F.lower(T.clean(p["value"]))))
    arxiv = F.transform(F.filter(F.coalesce("pids", none), lambda p: (F.lower(T.clean(p["scheme"])) == "arxiv") & ~T.missing(p["value"])), lambda p: F.concat(F.lit("https://arxiv.org/pdf/"), T.clean(p["value"])))
    urls = F.array_distinct(F.concat(arxiv, F.coalesce(F.flatten(F.transform("instances", lambda i: F.coalesce(i["urls"], F.array().cast("array<string>")))), F.array().cast("array<string>"))))
    direct = F.get(F.filter(urls, lambda u: u.rlike(PDF)), F.lit(0))
    # of several descriptions the longest, ties to the smallest
    longest = F.get(F.array_sort(F.transform(F.coalesce("descriptions", F.array().cast("array<string>")), T.clean), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(0))
    return rows.select(T.clean(F.col("mainTitle")).alias("title"), F.explode_outer(dois).alias("doi"), longest.alias("abstract"), F.coalesce(direct, F.get(arxiv, F.lit(0))).alias("pdf_url"), F.array().cast("array<string>").alias("authors"))


def first_with_rows(*readers: DataFrame) -> DataFrame:
    """The first of several sources that has any row."""
    for rows in readers[:-1]:
        if rows.limit(1).count():
            return rows
    return readers[-1]


def all_or_nothing(rows: DataFrame, valid: Column) -> DataFrame:
    """The rows if every one is valid, else none."""
    broken = rows.where(~F.coalesce(valid, F.lit(False))).limit(1).select(F.lit(True).alias("_broken"))
    return rows.join(F.broadcast(broken), F.lit(True), "left_anti")  # one row at most


def program_titles(lines: DataFrame, track_pattern: str = r"^(?:Session|Track)\b", least: int = 100) -> DataFrame:
    """title, track of a conference program's text lines (n, line): each line under the last track heading before it.

    Too few titles mean that the layout wasn't understood: then there are none.
    """
    from pyspark.sql import Window

    heading = F.col("line").rlike(track_pattern)
    # a program is one document: its lines are one ordered group
    track = F.last(F.when(heading, F.col("line")), ignorenulls=True).over(Window.partitionBy("document").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    titles = lines.withColumn("track", track).where(~heading & T.looks_like_title(F.col("line"))).select("document", T.clean(F.col("line")).alias("title"), "track")
    enough = titles.groupBy("document").count().where(F.col("count") >= least)
    return titles.join(enough, "document", "left_semi")


# Marks that end a paper's title in a program, days, and lines that belong to no paper.
_TRACK = r"(?i)\[(Full|Short|Industry|Resource|Reproducibility|Demo|Low-Resource|Perspective|TOIS)\]\s*$"
_DAYS = "(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
_RUNNING = r"(?i)^(?:SIGIR\s*\d{4}|Program|\d+)$"
#: Lines in which authors may stand, and least characters of an abstract.
AUTHOR_LINES, LEAST_ABSTRACT = 40, 80


def program_papers(blocks: DataFrame, least: int = 100) -> DataFrame:
    """document, title, track, authors, abstract, page of the papers in a program's paragraphs (path, page, n, lines).

    A program may be several files: then blocks have its name as `document`, and no paper goes on in the next file. Papers
    are stored once they are found, as programs are judged by all of theirs and reading files twice is what costs.

    A title ends with its track's mark; its paragraph begins a paper. Authors follow, each with an affiliation in
    parentheses, up to the first line at which all parentheses are closed and no further author is announced;
    the rest is the abstract, up to the next session's line. A program with too few papers, or one without
    authors, wasn't understood: then it gives none.
    """
    from pyspark.sql import Window

    blocks = blocks if "document" in blocks.columns else blocks.withColumn("document", F.col("path"))
    order = Window.partitionBy("document", "path").orderBy("page", "n").rowsBetween(Window.unboundedPreceding, 0)  # a file is one ordered group
    flat = T.clean(F.array_join("lines", " "))
    title = T.clean(F.regexp_replace(flat, _TRACK, ""))
    rows = blocks.withColumn("_title", F.when(flat.rlike(_TRACK) & T.looks_like_title(title), title)).withColumn("_track", F.regexp_extract(flat, _TRACK, 1))
    rows = rows.withColumn("_paper", F.count("_title").over(order)).where("_paper > 0")
    heads = F.struct("page", "n", "_title", "_track")
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("_title").isNull(), F.struct("page", "n", "lines")))), lambda b: b["lines"])
    papers = rows.groupBy("document", "path", "_paper").agg(F.min(F.when(F.col("_title").isNotNull(), heads)).alias("h"), F.flatten(body).alias("lines"))
    papers = papers.withColumn("lines", F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != ""))

    lines = F.col("lines")
    count = lambda value, mark: F.length(value) - F.length(F.replace(value, F.lit(mark), F.lit("")))

    def closed(k: Column) -> Column:
        told, line = F.array_join(F.slice(lines, 1, k), " "), F.get(lines, k - 1)
        return told.contains("(") & (count(told, "(") == count(told, ")")) & line.rlike(r"\)\s*$")

    places = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.least(F.size(lines), F.lit(AUTHOR_LINES)))).otherwise(F.array().cast("array<int>"))
    papers = papers.withColumn("_end", F.coalesce(F.get(F.filter(places, closed), F.lit(0)), F.lit(0)))
    said = F.array_join(F.slice(lines, 1, F.when(F.col("_end") > 0, F.col("_end")).otherwise(F.least(F.size(lines), F.lit(AUTHOR_LINES)))), " ")
    authors = F.filter(F.transform(F.split(said, ";"), lambda a: T.clean(F.substring_index(a, "(", 1))), lambda a: a != "")
    rest = F.slice(lines, F.col("_end") + 1, F.size(lines))
    session = rf"(?i)·\s*[^·]+\s*·\s*{_DAYS}\b"
    stop = F.coalesce(F.array_min(F.filter(F.transform(rest, lambda x, i: F.when(x.rlike(session), i)), lambda i: i.isNotNull())), F.size(rest))
    kept = F.filter(F.slice(rest, F.lit(1), stop), lambda x: ~x.rlike(_RUNNING))
    abstract = T.clean(F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), r"(?i)^\\begin\{abstract\}\s*", ""), r"(?i)\\end\{abstract\}\s*$", ""))
    out = papers.select("document", F.col("h._title").alias("title"), F.col("h._track").alias("track"), authors.alias("authors"), F.when(F.length(abstract) >= LEAST_ABSTRACT, abstract).otherwise("").alias("abstract"), F.col("h.page").alias("page"))
    at = scratch(out.sparkSession, "papers")
    out.write.parquet(at)
    out = out.sparkSession.read.schema(out.schema).parquet(at)
    understood = out.groupBy("document").agg(F.count(F.lit(1)).alias("_n"), F.min(F.size("authors")).alias("_least")).where((F.col("_n") >= least) & (F.col("_least") > 0))
    return out.join(understood, "document", "left_semi")
