"""Paper records: normalisation, identity keys, aliases, routing, candidate links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.entities import clean_decoded

PAPER_SCHEMA = (
    "title string, abstract string, authors array<string>, published date, year int, url string, pdf_url string, venue string, source_type string, "
    "categories array<string>, category string, version string, identifiers map<string,string>, _source_index int, _source_pos bigint"
)
IDENTIFIERS = ("doi", "arxiv_id", "openreview_id", "pmcid")

# Channels, their aliases, conference labels, link markers and service hosts.
CONFERENCES = ["neurips", "iclr", "icml", "kdd", "sigir", "cikm", "aaai", "iccv", "www", "cvpr", "acl", "ijcai", "eccv", "emnlp"]
CHANNELS = [*CONFERENCES, "arxiv", "biorxiv"]
ALIASES = {"nips": "neurips", "sigkdd": "kdd", "thewebconference": "www", "thewebconf": "www", "webconference": "www", "webconf": "www"}
URL_MARKERS = [
    ("arxiv.org", "arxiv"),
    ("biorxiv.org", "biorxiv"),
    ("aclanthology.org", "acl"),
    ("openaccess.thecvf.com", "cvpr"),
    ("ijcai.org", "ijcai"),
    ("ecva.net", "eccv"),
    ("aaai.org", "aaai"),
    ("neurips.cc", "neurips"),
]
SERVICES = [
    ("arxiv.org", "arxiv"),
    ("biorxiv.org", "biorxiv"),
    ("medrxiv.org", "biorxiv"),
    ("openreview.net", "openreview"),
    ("crossref.org", "crossref"),
    ("openalex.org", "openalex"),
    ("europepmc.org", "europepmc"),
    ("ebi.ac.uk", "europepmc"),
    ("unpaywall.org", "unpaywall"),
    ("dl.acm.org", "acm"),
    ("semanticscholar.org", "semantic_scholar"),
    ("openaire.eu", "openaire"),
    ("archives-ouvertes.fr", "hal"),
]
DBLP_HOSTS = ["dblp.org", "www.dblp.org", "dblp.uni-trier.de", "dblp.dagstuhl.de"]
ARXIV_CATEGORIES = ["cs.AI", "cs.LG", "cs.CL", "cs.CV", "cs.IR", "cs.MA", "cs.NE", "cs.RO", "cs.HC", "stat.ML"]

# Pages of publishers whose papers have a PDF beside them.
PAGES = {
    "neurips": r"(?:papers\.nips\.cc|proceedings\.neurips\.cc)/paper_files/paper/(\d{4})/hash/([A-Za-z0-9]+)-Abstract-([^\"'<>\s/]+)\.html",
    "pmlr": r"proceedings\.mlr\.press/(v\d+)/([A-Za-z0-9_.-]+)\.html",
    "acl": r"aclanthology\.org/([0-9]{4}\.[A-Za-z0-9-]+\.\d+)/?",
    "cvf": r"openaccess\.thecvf\.com/content/([^/]+)/html/([^\"'<>\s]+)\.html",
    "ijcai": r"ijcai\.org/proceedings/(\d{4})/(\d+)",
    "ecva": r"ecva\.net/papers/eccv_(\d{4})/papers_ECCV/html/(\d+)_ECCV_(\d{4})_paper\.php",
}


def identifier(name: str) -> Column:
    return F.lower(T.clean(F.col("identifiers")[name]))


def title_identity(title: Column, first_author: Column, year: Column, unicode_keys: bool = False) -> Column:
    key = T.unicode_title_key if unicode_keys else T.title_key
    return F.concat(F.lit("title:"), key(title), F.lit("|author:"), key(first_author), F.lit("|year:"), T.text(year))


def identity(unicode_keys: bool = False) -> Column:
    """The first identifier there is, else title, first author and year; never null."""
    found = [F.when(identifier(k) != "", F.concat(F.lit(f"{k}:"), identifier(k))) for k in IDENTIFIERS]
    return F.coalesce(*found, title_identity(F.col("title"), F.get("authors", F.lit(0)), F.coalesce(F.col("year"), F.year("published")), unicode_keys))


def normalize(papers: DataFrame, source_type: str, unicode_keys: bool = False) -> DataFrame:
    """Canonical rows with their identity; authors may be an array or one string, published a date or text."""
    kinds = dict(papers.dtypes)
    authors = T.split_authors(F.col("authors")) if kinds["authors"] == "string" else T.clean_authors(F.col("authors"))
    out = papers.withColumns(
        {
            "title": clean_decoded(F.col("title")),
            "abstract": T.clean_abstract(F.col("abstract")),
            "authors": authors,
            "published": T.date_text(F.col("published")),
            "source_type": F.lit(source_type),
        }
    )
    out = out.withColumn("year", F.coalesce(F.col("year"), F.year("published")) if "year" in kinds else F.year("published"))
    if "identifiers" not in kinds:
        out = out.withColumn("identifiers", F.create_map().cast("map<string,string>"))
    return out.withColumn("identity", identity(unicode_keys))


def canonical_channel(value: Column) -> Column:
    token = F.regexp_replace(F.lower(T.text(value)), "[^a-z0-9]+", "")
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, token), token)


def channel(names: list[Column], urls: list[Column]) -> Column:
    """Channel of a paper: an exact name, else a name that begins with a conference, else a marker in its links."""
    found = []
    for name in names:
        token = canonical_channel(name)
        found.append(F.when(token.isin(CHANNELS), token))
        found += [F.when(token.startswith(c), c) for c in CONFERENCES]
    blob = F.lower(F.concat_ws(" ", *[T.text(u) for u in urls]))
    found += [F.when(blob.contains(marker), c) for marker, c in URL_MARKERS]
    return F.coalesce(*found)


def dblp_mirrors(url: Column) -> Column:
    """A bibliography link on each of its hosts, its own first; any other link by itself."""
    own = F.regexp_replace(F.regexp_extract(url_host(url), r"^(?:[^@]*@)?([^:]*)", 1), r"^www\.dblp\.org$", "dblp.org")
    hosts = F.array_distinct(F.concat(F.array(own), F.array(*[F.lit(h) for h in DBLP_HOSTS if not h.startswith("www.")])))
    rest = F.regexp_replace(T.strip(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(own.isin(DBLP_HOSTS), F.transform(hosts, lambda h: F.concat(F.lit("https://"), h, rest))).otherwise(F.array(url))


def arxiv_id(url: Column) -> Column:
    """The identifier at a link's end, without its version."""
    return F.regexp_extract(T.clean(url), r"([^/]+?)(?:v\d+)?/?$", 1)


def arxiv_query(category: Column, first: Column, last: Column) -> Column:
    """What a preprint server is asked for a category's days."""
    day = lambda d: F.date_format(d, "yyyyMMdd")
    return F.concat(F.lit("cat:"), category, F.lit(" AND submittedDate:["), day(first), F.lit("0000 TO "), day(last), F.lit("2359]"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(T.text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def service(url: Column) -> Column:
    """Service that a link belongs to; other hosts are services of their own."""
    host = url_host(url)
    own = F.regexp_replace(F.regexp_extract(host, "^[^:]*", 0), "[^a-z0-9.-]+", "_")
    routed = [F.when(host.contains(marker), name) for marker, name in SERVICES[:4]]
    routed.append(F.when(host.isin(DBLP_HOSTS), "dblp"))
    routed += [F.when(host.contains(marker), name) for marker, name in SERVICES[4:]]
    routed.append(F.when((host == "chatpaper.com") | host.endswith(".chatpaper.com"), "chatpaper"))
    return F.coalesce(*routed, F.when(own != "", F.concat(F.lit("host-"), own)), F.lit("generic"))


def cache_aliases(channel_name: Column) -> Column:
    """Every name under which a full text may be stored, qualified by its channel, in order, distinct."""
    ids = [F.when(identifier(k) != "", F.concat(F.lit(f"{k}:"), identifier(k))) for k in IDENTIFIERS]
    links = [F.when(~T.missing(F.col(c)), F.concat(F.lit(f"{c}:"), T.clean(F.col(c)))) for c in ("url", "pdf_url")]
    by_title = F.when(T.title_key(F.col("title")) != "", title_identity(F.col("title"), F.get("authors", F.lit(0)), F.coalesce(F.col("year"), F.year("published"))))
    return F.transform(F.array_distinct(F.array_compact(F.array(*ids, *links, by_title))), lambda a: F.concat(F.lit("channel:"), channel_name, F.lit("|"), a))


def alias_hit(wanted: Column, stored: Column) -> Column:
    """Some alias is shared, and no kind of identifier that both have is disjoint."""
    clash = F.lit(False)
    for kind in IDENTIFIERS:
        of_kind = lambda array, k=kind: F.filter(array, lambda a: a.contains(f"|{k}:"))
        clash = clash | ((F.size(of_kind(wanted)) > 0) & (F.size(of_kind(stored)) > 0) & ~F.arrays_overlap(of_kind(wanted), of_kind(stored)))
    return F.arrays_overlap(wanted, stored) & ~clash


def _all(blob: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(blob, F.lit(pattern), F.lit(group))


def pdf_candidates(channel_name: Column) -> Column:
    """Ordered, distinct links to a paper's PDF: official patterns of its channel and explicit links."""
    doi, note = T.clean(F.col("identifiers")["doi"]), T.clean(F.col("identifiers")["openreview_id"])
    blob = F.concat_ws(" ", T.clean(F.col("url")), T.clean(F.col("pdf_url")), doi)
    explicit = F.filter(F.array(T.clean(F.col("pdf_url"))), lambda u: u.startswith("http"))

    def rewritten(pattern: str, build) -> Column:
        return F.transform(_all(blob, f"(?i){pattern}", 0), build)

    part = lambda m, pattern, i: F.regexp_extract(m, f"(?i){pattern}", i)
    patterns = {
        "neurips": rewritten(PAGES["neurips"], lambda m: F.format_string("https://proceedings.neurips.cc/paper_files/paper/%s/file/%s-Paper-%s.pdf", *[part(m, PAGES["neurips"], i) for i in (1, 2, 3)])),
        "icml": F.flatten(
            rewritten(
                PAGES["pmlr"],
                lambda m: F.array(
                    F.format_string("https://proceedings.mlr.press/%s/%s/%s.pdf", part(m, PAGES["pmlr"], 1), part(m, PAGES["pmlr"], 2), part(m, PAGES["pmlr"], 2)),
                    F.format_string("https://raw.githubusercontent.com/mlresearch/%s/main/assets/%s/%s.pdf", part(m, PAGES["pmlr"], 1), part(m, PAGES["pmlr"], 2), part(m, PAGES["pmlr"], 2)),
                ),
            )
        ),
        "acl": rewritten(PAGES["acl"], lambda m: F.format_string("https://aclanthology.org/%s.pdf", part(m, PAGES["acl"], 1))),
        "cvpr": rewritten(PAGES["cvf"], lambda m: F.format_string("https://openaccess.thecvf.com/content/%s/papers/%s.pdf", part(m, PAGES["cvf"], 1), part(m, PAGES["cvf"], 2))),
        "ijcai": rewritten(PAGES["ijcai"], lambda m: F.format_string("https://www.ijcai.org/proceedings/%s/%s.pdf", part(m, PAGES["ijcai"], 1), F.lpad(F.regexp_replace(part(m, PAGES["ijcai"], 2), "^0+(?=.)", ""), 4, "0"))),
        "eccv": F.transform(
            F.filter(_all(blob, f"(?i){PAGES['ecva']}", 0), lambda m: part(m, PAGES["ecva"], 1) == part(m, PAGES["ecva"], 3)),
            lambda m: F.format_string("https://www.ecva.net/papers/eccv_%s/papers_ECCV/papers/%s.pdf", part(m, PAGES["ecva"], 1), F.lpad(F.regexp_replace(part(m, PAGES["ecva"], 2), "^0+(?=.)", ""), 5, "0")),
        ),
    }
    patterns["emnlp"], patterns["iccv"] = patterns["acl"], patterns["cvpr"]
    none = F.array().cast("array<string>")
    arxiv, version = T.clean(F.col("identifiers")["arxiv_id"]), T.clean(F.col("identifiers")["biorxiv_version"])
    first = (
        F.when((channel_name == "iclr") & (note != ""), F.array(F.concat(F.lit("https://openreview.net/pdf?id="), note)))
        .when(channel_name.isin("kdd", "sigir", "cikm", "www") & doi.startswith("10.1145/"), F.array(F.concat(F.lit("https://dl.acm.org/doi/pdf/"), doi)))
        .otherwise(none)
    )
    last = none
    for name, urls in patterns.items():
        last = F.when(channel_name == name, urls).otherwise(last)
    only = (
        F.when((channel_name == "arxiv") & (arxiv != ""), F.array(F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)))
        .when((channel_name == "biorxiv") & (doi != ""), F.array(F.concat(F.lit("https://www.biorxiv.org/content/"), doi, F.lit("v"), F.when(version == "", "1").otherwise(version), F.lit(".full.pdf"))))
        .when(channel_name.isin("arxiv", "biorxiv"), none)
    )
    return F.coalesce(only, F.array_distinct(F.concat(first, explicit, last)))


def source_label(venue: Column, published: Column) -> Column:
    """Venue with the year for a conference, with the whole date otherwise."""
    source = F.when(T.missing(venue), "来源未提供").otherwise(T.clean(venue))
    year = F.regexp_extract(T.clean(published), r"\b(?:19|20)\d{2}\b", 0)
    key = T.title_key(source)
    return F.trim(F.concat_ws(" ", source, F.when(key.isin([*CONFERENCES, "nips", "sigkdd"]) & (year != ""), year).otherwise(T.clean(published))))


def html_route_allowed(url: Column, channel_name: Column) -> Column:
    """Whether an HTML page may be a paper's full text: no poster, abstract, forum, conference or arXiv page."""
    detail = F.lower(T.clean(url)).rlike(r"/(?:poster|abstract)(?:/|[-_.])|openreview\.net/forum")
    return ~detail & ~F.coalesce(channel_name.isin([*CONFERENCES, "arxiv"]), F.lit(False))
