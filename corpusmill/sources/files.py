"""File-backed sources: JSON, JSONL, XML and text dumps of paper catalogs, decoded with DataFrame functions.

Every reader takes a path that Spark can list, keeps the file name, and yields rows for records.normalize.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.entities import unescape
from corpusmill.session import exists

JSON_SCORE = "identity string, metadata_score string, components struct<topic_fit:string,transferability_potential:string,abstract_specificity:string>, reason string, uncertainty string"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects line by line, blank lines aside; a line that is no object fails the query and names itself."""
    return jsonl_rows(spark.read.text(path), schema)


def jsonl_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Objects of lines (value)."""
    lines = lines.where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.ltrim("value").startswith("{") & F.col("r").isNotNull() & F.col("r._bad").isNull()
    failed = F.raise_error(F.concat(F.lit("invalid JSONL line: "), F.substring("value", 1, 80))).cast("boolean")
    return parsed.where(F.when(good, F.lit(True)).otherwise(failed)).select("r.*").drop("_bad")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file; a missing path or broken document gives no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """Score rows of a file that is a list, or an object with scores, papers or items."""
    return score_rows(spark.read.text(path, wholetext=True))


def score_rows(whole: DataFrame) -> DataFrame:
    """Score rows of documents (value), each in one of those forms."""
    item = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in _split(JSON_SCORE))}>>"
    as_list = F.from_json("value", item)
    keyed = [F.from_json(F.get_json_object("value", f"$.{k}"), item) for k in ("scores", "papers", "items")]
    rows = F.when(F.ltrim("value").startswith("["), as_list).otherwise(F.coalesce(*keyed))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def _split(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


ATOM = (
    "id string, title string, summary string, published string, author array<struct<name:string>>, "
    "link array<struct<_href:string,_title:string,_rel:string>>, category array<struct<_term:string>>, `arxiv:doi` string"
)


def atom(spark: SparkSession, path: str, keep_archive: bool = True) -> DataFrame:
    """Entries of Atom feeds. keep_archive: old identifiers keep their archive prefix."""
    return atom_rows(spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path), keep_archive)


def atom_rows(rows: DataFrame, keep_archive: bool = True) -> DataFrame:
    """Entries of the schema ATOM as papers."""
    pattern = r"abs/(.+?)(?:v\d+)?/?$" if keep_archive else r"([^/]+?)(?:v[^/]*)?/?$"
    arxiv_id = F.regexp_extract(T.clean(F.col("id")), pattern, 1)
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    return rows.select(
        "title",
        F.col("summary").alias("abstract"),
        F.transform("author", lambda a: a["name"]).alias("authors"),
        T.date_text(F.col("published")).alias("published"),
        T.clean(F.col("id")).alias("url"),
        F.coalesce(pdf, F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id)).alias("pdf_url"),
        F.lit("arXiv").alias("venue"),
        F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.create_map(F.lit("arxiv_id"), arxiv_id, F.lit("doi"), T.clean(F.col("`arxiv:doi`"))).alias("identifiers"),
    )


PREPRINTS = "array<struct<doi:string,title:string,authors:string,date:string,version:string,category:string,abstract:string>>"


def preprint_json(spark: SparkSession, path: str) -> DataFrame:
    """Items of paged preprint listings ({"collection": [...]})."""
    return preprint_rows(spark.read.schema(f"collection {PREPRINTS}").option("multiLine", True).json(path).select(F.explode("collection").alias("i")).select("i.*"))


def preprint_rows(rows: DataFrame) -> DataFrame:
    """Listed items as papers."""
    version = F.coalesce(F.nullif(T.clean(F.col("version")), F.lit("")), F.lit("1"))
    page = F.concat(F.lit("https://www.biorxiv.org/content/"), T.clean(F.col("doi")), F.lit("v"), version)
    return rows.select(
        T.clean(F.col("title")).alias("title"),
        T.clean(F.col("abstract")).alias("abstract"),
        T.clean(F.col("authors")).alias("authors"),
        T.date_text(F.col("date")).alias("published"),
        page.alias("url"),
        F.concat(page, F.lit(".full.pdf")).alias("pdf_url"),
        F.lit("bioRxiv").alias("venue"),
        T.clean(F.col("category")).alias("category"),
        version.alias("version"),
        F.create_map(F.lit("doi"), T.clean(F.col("doi")), F.lit("biorxiv_version"), version).alias("identifiers"),
    )


def unwrap(json: Column, path: str) -> Column:
    """A value that may be wrapped as {"value": ...}; an object without one is none."""
    bare = F.get_json_object(json, path)
    return F.when(F.ltrim(bare).startswith("{"), F.get_json_object(json, f"{path}.value")).otherwise(bare)


def openreview(spark: SparkSession, path: str, venue: str, year: int) -> DataFrame:
    """Notes of review-platform pages ({"notes": [{"id", "content": {...}}]}); values may be wrapped."""
    return openreview_rows(spark.read.text(path, wholetext=True), venue, year)


def openreview_rows(documents: DataFrame, venue: str, year: int) -> DataFrame:
    """Notes of documents (value) as papers."""
    notes = documents.select(F.explode(F.from_json(F.get_json_object("value", "$.notes"), "array<string>")).alias("n"))
    names = F.coalesce(F.from_json(unwrap(F.col("n"), "$.content.authors"), "array<string>"), F.array(unwrap(F.col("n"), "$.content.authors")))
    words = F.coalesce(F.from_json(unwrap(F.col("n"), "$.content.keywords"), "array<string>"), F.array().cast("array<string>"))
    note = F.get_json_object("n", "$.id")
    out = notes.select(
        T.clean(unwrap(F.col("n"), "$.content.title")).alias("title"),
        T.clean(unwrap(F.col("n"), "$.content.abstract")).alias("abstract"),
        F.array_distinct(T.clean_authors(names)).alias("authors"),
        F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("published"),
        F.concat(F.lit("https://openreview.net/forum?id="), note).alias("url"),
        F.concat(F.lit("https://openreview.net/pdf?id="), note).alias("pdf_url"),
        F.lit(venue).alias("venue"),
        F.array_distinct(F.array_compact(words)).alias("categories"),
        F.create_map(F.lit("openreview_id"), note).alias("identifiers"),
    )
    return out.where("title <> ''")


ANTHOLOGY = (
    "_id string, title string, abstract string, url string, doi string, "
    "author array<struct<first:string,middle:string,last:string>>"
)


def anthology(spark: SparkSession, path: str, venue: str, year: int, volume: str = "main") -> DataFrame:
    """Papers of an anthology's XML volumes."""
    return anthology_rows(spark.read.format("xml").option("rowTag", "paper").schema(ANTHOLOGY).load(path), venue, year, volume)


def anthology_rows(rows: DataFrame, venue: str, year: int, volume: str = "main") -> DataFrame:
    """Entries of the schema ANTHOLOGY as papers."""
    own = F.coalesce(F.nullif(T.clean(F.col("url")), F.lit("")), F.concat(F.lit(f"{year}.{venue.lower()}-{volume}."), F.col("_id")))
    page = F.concat(F.lit("https://aclanthology.org/"), F.regexp_replace(own, "^/+|/+$", ""), F.lit("/"))
    name = lambda a: F.array_join(F.filter(F.array(T.clean(a["first"]), T.clean(a["middle"]), T.clean(a["last"])), lambda x: x != ""), " ")
    out = rows.select(
        T.clean(F.col("title")).alias("title"),
        T.clean(F.col("abstract")).alias("abstract"),
        F.filter(F.transform("author", name), lambda x: x != "").alias("authors"),
        F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("published"),
        page.alias("url"),
        F.concat(F.regexp_replace(page, "/$", ""), F.lit(".pdf")).alias("pdf_url"),
        F.lit(venue).alias("venue"),
        F.create_map(F.lit("doi"), T.clean(F.col("doi")), F.lit("acl_anthology_id"), own).alias("identifiers"),
    )
    return out.where("title <> ''").dropDuplicates(["url"])


def anthology_with_findings(spark: SparkSession, main_path: str, findings_path: str, year: int) -> DataFrame:
    """Main volumes and the findings volume of the same conference."""
    return anthology(spark, main_path, "EMNLP", year).unionByName(anthology(spark, findings_path, "EMNLP", year, "findings")).dropDuplicates(["url"])


DBLP = "_key string, title string, year string, author array<string>, ee array<string>"


def dblp(spark: SparkSession, path: str, venue: str, year: int) -> DataFrame:
    """Proceedings entries of a bibliography dump, one a title; a seed without abstracts."""
    return dblp_rows(spark.read.format("xml").option("rowTag", "inproceedings").schema(DBLP).load(path), venue, year)


def dblp_rows(rows: DataFrame, venue: str, year: int) -> DataFrame:
    """Entries of the schema DBLP as a venue's titles."""
    rows = rows.where((F.coalesce("year", F.lit("")) == "") | (T.clean(F.col("year")) == str(year))).where(T.looks_like_title(F.col("title")))
    links = F.coalesce(F.transform("ee", T.clean), F.array().cast("array<string>"))
    doi = F.regexp_replace(F.regexp_extract(F.array_join(links, " "), r"(?i)doi\.org/(10\.\d{4,9}/\S+)", 1), r"[.,)]+$", "")
    pdf = F.get(F.filter(links, lambda u: u.rlike(r"(?i)\.pdf(?:$|[?#])")), F.lit(0))
    from corpusmill.operators.dedup import first_of_key

    rows = first_of_key(rows, T.title_key(F.col("title")), [F.col("_key")])
    return rows.select(
        T.clean(F.col("title")).alias("title"),
        F.lit("").alias("abstract"),
        T.clean_authors(F.col("author")).alias("authors"),
        F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("published"),
        F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("url"),
        F.coalesce(pdf, F.lit("")).alias("pdf_url"),
        F.lit(venue).alias("venue"),
        F.create_map(F.lit("doi"), doi, F.lit("dblp_key"), T.clean(F.col("_key"))).alias("identifiers"),
    )


def article_xml(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each XML article: all character data, tags as line ends."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), article_text(F.col("value")).alias("text"))


def article_text(value: Column) -> Column:
    """Character data of an XML article, tags as line ends; entities decoded, CDATA sections as they stand."""
    escaped = lambda part: F.replace(F.replace(F.replace(part, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.split(value, r"<!\[CDATA\[")
    inside = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(escaped(F.substring_index(p, "]]>", 1)), F.when(F.instr(p, F.lit("]]>")) > 0, F.substring(p, F.instr(p, F.lit("]]>")) + 3, F.length(p))).otherwise("")))
    plain = F.concat(F.get(parts, F.lit(0)), F.array_join(inside, ""))
    bare = F.regexp_replace(F.regexp_replace(plain, r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!DOCTYPE[^\[>]*(?:\[[\s\S]*?\]\s*)?>|<![^>]*>", " "), r"<[^>]+>", "\n")
    lines = T.strip(F.regexp_replace(F.regexp_replace(bare, r"[ \t\x0b\f\r]+", " "), r"\s*\n\s*", "\n"))
    return unescape(lines)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, length of every file below path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def search_catalog(catalog: DataFrame, query: str) -> DataFrame:
    """Rows whose JSON holds the query, whatever its case."""
    return catalog.where(F.lower(F.to_json(F.struct(*catalog.columns))).contains(query.lower()))
