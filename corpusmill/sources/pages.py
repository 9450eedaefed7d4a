"""HTML catalog pages: one Arrow-batched parse of a page into a struct, then DataFrame adapters on that struct."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T

PAGE = "struct<meta:map<string,array<string>>,links:array<struct<href:string,text:string>>,abstract:string,ld_authors:array<string>,organizers:array<string>,text:string>"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROPPED = {"script", "style", "nav", "header", "footer", "aside"}
_ABSTRACT_IDS = {"abstract"}
_ABSTRACT_CLASSES = {"abstract", "abstractInFull", "paper-abstract", "acl-abstract"}


class _Page(HTMLParser):
    """Meta fields, links, abstract, structured authors and running text of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, list[str]] = {}
        self.links: list[tuple[str, list[str]]] = []
        self.stack: list[tuple[str, str]] = []
        self.abstract: list[str] = []
        self.organizers: list[str] = []
        self.json: list[str] = []
        self.main: dict[str, list[str]] = {"article": [], "main": [], "": []}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("name") or a.get("property")
            if name and " ".join(a.get("content", "").split()):
                self.meta.setdefault(name.lower(), []).append(" ".join(a["content"].split()))
        if tag in _VOID:
            return
        kind = ""
        classes = set(a.get("class", "").split())
        if a.get("id") in _ABSTRACT_IDS or classes & _ABSTRACT_CLASSES or a.get("itemprop") == "description":
            kind = "abstract"
        elif "event-organizers" in classes:
            kind = "organizers"
        elif tag == "script" and a.get("type") == "application/ld+json":
            kind = "json"
        if tag == "a" and "href" in a:
            self.links.append((a["href"], []))
        self.stack.append((tag, kind))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        tags, kinds = {t for t, _ in self.stack}, {k for _, k in self.stack}
        if "json" in kinds:
            self.json.append(data)
            return
        if "a" in tags and self.links:
            self.links[-1][1].append(data)
        if "abstract" in kinds:
            self.abstract.append(data)
        if "organizers" in kinds:
            self.organizers.append(data)
        if data.strip() and not tags & _DROPPED and "head" not in tags:
            for where in ("article", "main", ""):
                if not where or where in tags:
                    self.main[where].append(data)


def _names(raw: str) -> list[str]:
    try:
        value = json.loads(raw or "null")
    except ValueError:
        return []
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, dict):
            people = item.get("author") or item.get("creator") or []
            names = [" ".join(str(p.get("name") if isinstance(p, dict) else p).split()) for p in (people if isinstance(people, list) else [people])]
            if any(names):
                return [n for n in names if n]
    return []


def _one(page: str | None) -> dict:
    p = _Page()
    p.feed(page or "")
    p.close()
    body = p.main["article"] or p.main["main"] or p.main[""]
    flat = lambda parts: " ".join(" ".join(parts).split())
    return {
        "meta": list(p.meta.items()),
        "links": [{"href": h, "text": flat(t)} for h, t in p.links],
        "abstract": re.sub(r"^abstract\s*[:—-]?\s*", "", flat(p.abstract), flags=re.I),
        "ld_authors": _names("".join(p.json)),
        "organizers": [x for x in (" ".join(x.split()) for x in re.split(r"\s*[⋅·;]\s*", " ".join(p.organizers))) if x],
        "text": "\n".join(line for part in body for line in (x.strip() for x in part.splitlines()) if line),
    }


_ARROW = pa.struct(
    [
        ("meta", pa.map_(pa.string(), pa.list_(pa.string()))),
        ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))),
        ("abstract", pa.string()),
        ("ld_authors", pa.list_(pa.string())),
        ("organizers", pa.list_(pa.string())),
        ("text", pa.string()),
    ]
)


def _parse(pages: pa.Array) -> pa.Array:
    return pa.array([_one(p) for p in pages.to_pylist()], _ARROW)


def parsed(page: Column) -> Column:
    return F.arrow_udf(_parse, PAGE)(page.cast("string"))


def _join(bases: pa.Array, links: pa.Array) -> pa.Array:
    return pa.array([urljoin(b or "", x or "") for b, x in zip(bases.to_pylist(), links.to_pylist())], pa.string())


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from its page."""
    return F.when(F.coalesce(link, F.lit("")) == "", "").when(link.rlike("^https?://"), link).otherwise(F.arrow_udf(_join, "string")(base, link))


def read(spark: SparkSession, path: str) -> DataFrame:
    """url, html of saved pages: the path below the folder is the address without its scheme."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.concat(F.lit("https://"), F.regexp_extract(F.col("_metadata.file_path"), r"/pages/(.+?)(?:\.html?)?$", 1)).alias("url"), F.col("value").alias("html"))


def first_meta(page: Column, *names: str) -> Column:
    return F.coalesce(*[F.get(F.try_element_at(page["meta"], F.lit(n.lower())), F.lit(0)) for n in names], F.lit(""))


def authors(page: Column) -> Column:
    """Citation fields, else a creator field, else structured data, else the organizers' line."""
    cited = F.try_element_at(page["meta"], F.lit("citation_author"))
    creator = F.filter(F.transform(F.split(first_meta(page, "dc.creator", "author"), r"\s*(?:;|,\s+and\s+)\s*"), T.clean), lambda x: x != "")
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(some(cited), some(creator), some(page["ld_authors"]), page["organizers"])


def abstract(page: Column, start: str = "Abstract", ends: list[str] | None = None) -> Column:
    """The citation field if long enough, the element of that role, else what follows the marker."""
    cited = F.regexp_replace(first_meta(page, "citation_abstract"), r"(?i)^abstract\s*[:—-]?\s*", "")
    marked = T.clean(T.between(page["text"], start, ends or ["\nVideo\n", "\nSpotlight\n", "\nPoster\n", "\nName Change Policy\n", "\nChat is not available", "\nSuccessful Page Load"]))
    return F.when(F.length(cited) >= 80, cited).when(F.length(page["abstract"]) >= 80, page["abstract"]).otherwise(marked)


def pdf(page: Column, base: Column) -> Column:
    label = lambda x: F.lower(T.clean(x["text"])).isin("pdf", "paper", "download pdf")
    linked = F.get(F.filter(page["links"], lambda x: x["href"].rlike(r"(?i)\.pdf(?:$|[?#])") | label(x)), F.lit(0))["href"]
    return absolute(base, F.coalesce(F.nullif(first_meta(page, "citation_pdf_url"), F.lit("")), linked))


def details(pages: DataFrame) -> DataFrame:
    """url, abstract, authors, pdf_url, doi of detail pages (url, html)."""
    rows = pages.withColumn("p", parsed(F.col("html")))
    p = F.col("p")
    return rows.select("url", abstract(p).alias("abstract"), authors(p).alias("authors"), pdf(p, F.col("url")).alias("pdf_url"), T.doi(first_meta(p, "citation_doi", "dc.identifier")).alias("doi"))


def index(pages: DataFrame, link_pattern: str) -> DataFrame:
    """title, url, presentation_type of every link of index pages (url, html) whose address matches; one row an address."""
    rows = pages.withColumn("p", parsed(F.col("html"))).select(F.col("url").alias("index_url"), F.posexplode("p.links").alias("pos", "x"))
    rows = rows.where(F.col("x.href").rlike(link_pattern)).select("index_url", "pos", F.col("x.text").alias("title"), F.col("x.href").alias("href"))
    kind = F.when(F.col("href").contains("/oral/"), "oral").when(F.col("href").contains("/spotlight/"), "spotlight").when(F.col("href").contains("/poster/"), "poster").otherwise("paper")
    rows = rows.withColumn("url", absolute(F.col("index_url"), F.col("href"))).withColumn("presentation_type", kind).where(T.looks_like_title(F.col("title")))
    from corpusmill.operators.dedup import keep_best

    return keep_best(rows, ["url"], [F.col("index_url"), F.col("pos")]).select("title", "url", "presentation_type", "index_url")


#: Link patterns of index pages by channel.
INDEX_LINKS = {
    "neurips": r"/paper_files/paper/\d{4}/hash/",
    "icml": r"/(?:poster|oral|paper|spotlight)/",
    "eccv": r"/(?:poster|oral|paper|spotlight)/",
    "cvpr": r"/content/.+/html/.+\.html$",
    "iccv": r"/content/.+/html/.+\.html$",
    "aaai": r"/article/view/\d+",
    "ijcai": r"/proceedings/\d{4}/\d+$",
    "acm": r"/doi/(?:abs/|full/)?10\.",
}


def catalog(index_pages: DataFrame, detail_pages: DataFrame, channel: str, venue: str, year: int) -> DataFrame:
    """A conference catalog: its index joined with its detail pages by address."""
    rows = index(index_pages, INDEX_LINKS[channel]).join(details(detail_pages), "url", "left")
    return rows.select(
        "title",
        "abstract",
        "authors",
        F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("published"),
        F.lit(year).alias("year"),
        "url",
        "pdf_url",
        F.lit(venue).alias("venue"),
        "presentation_type",
        F.create_map(F.lit("doi"), F.coalesce("doi", F.lit(""))).alias("identifiers"),
    )


def _payload(pages: pa.Array) -> pa.Array:
    """Rows of a page whose state is a JSON list of values that refer to each other by place."""
    out = []
    for page in pages.to_pylist():
        m = re.search(r"<script[^>]*id=[\"']__NUXT_DATA__[\"'][^>]*>(.*?)</script>", page or "", re.S)
        try:
            cells = json.loads(m[1]) if m else []
        except ValueError:
            cells = []
        cells = cells if isinstance(cells, list) else []

        def follow(ref, cells=cells):
            seen = set()
            while True:
                if type(ref) is int and 0 <= ref < len(cells) and ref not in seen:
                    seen.add(ref)
                    ref = cells[ref]
                elif isinstance(ref, list) and len(ref) == 2 and ref[0] in ("ShallowReactive", "Reactive", "Ref", "ShallowRef"):
                    ref = ref[1]
                else:
                    return " ".join(str(ref if ref is not None else "").split())

        out.append([{k: follow(c.get(k)) for k in ("title", "abstract", "id", "source_id", "article_url", "pdf_url")} for c in cells if isinstance(c, dict) and {"title", "abstract"} <= set(c)])
    return pa.array(out, pa.list_(pa.struct([(k, pa.string()) for k in ("title", "abstract", "id", "source_id", "article_url", "pdf_url")])))


def state_rows(pages: DataFrame) -> DataFrame:
    """title, abstract, doi, url, pdf_url of pages (html) that carry their rows as a reference graph."""
    kind = "array<struct<title:string,abstract:string,id:string,source_id:string,article_url:string,pdf_url:string>>"
    rows = pages.select(F.posexplode(F.arrow_udf(_payload, kind)(F.col("html"))).alias("_pos", "r")).select("_pos", "r.*")
    title = F.regexp_replace(F.col("title"), r"^\d+\.\s*", "")
    url = F.when(F.col("id").rlike(r"^\d+$"), F.concat(F.lit("https://chatpaper.com/paper/"), F.col("id"))).otherwise("")
    out = rows.select(title.alias("title"), F.when(F.length("abstract") >= 80, F.col("abstract")).otherwise("").alias("abstract"), T.doi(F.concat_ws(" ", "source_id", "article_url")).alias("doi"), url.alias("url"), "pdf_url", "_pos")
    from corpusmill.operators.dedup import first_of_key

    return first_of_key(out, T.title_key(F.col("title")), [F.col("_pos"), F.col("url")])


def main_text(page: Column) -> Column:
    """Running text of the article, else main, else body, without scripts, navigation, header, footer and asides."""
    return parsed(page)["text"]
