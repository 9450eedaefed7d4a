"""Queries of records: links, aliases, labels, fillings from indexes, audits and checks of external scores and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import acquire, audit, catalogs, dedup, enrich, fulltext, reads, records, score, winners
from corpusmill.plans.catalog import REAL, query
from corpusmill.session import scratch, spread, table
from corpusmill.sources import channels

KINDS = ["neurips", "icml", "acl", "cvpr", "ijcai", "eccv", "iclr", "kdd", "arxiv", "biorxiv"]
#: A paper's page, by its channel's place in KINDS.
PAPER_URL = """CASE p_partkey % 10 WHEN 0 THEN 'https://papers.nips.cc/paper_files/paper/2023/hash/ab' || p_partkey || '-Abstract-Conference.html'
    WHEN 1 THEN 'https://proceedings.mlr.press/v200/x' || p_partkey || '.html' WHEN 2 THEN 'https://aclanthology.org/2024.acl-long.' || p_partkey || '/'
    WHEN 3 THEN 'https://openaccess.thecvf.com/content/CVPR2024/html/A' || p_partkey || '.html' WHEN 4 THEN 'https://www.ijcai.org/proceedings/2024/' || (p_partkey % 1000)
    WHEN 5 THEN 'https://www.ecva.net/papers/eccv_2024/papers_ECCV/html/' || (p_partkey % 10000) || '_ECCV_2024_paper.php' END"""


def _linked(spark, sf):
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 10
    names = {"openreview_id": 6, "doi": 7, "arxiv_id": 8}
    ids = F.create_map(*[x for name, n in names.items() for x in (F.lit(name), F.when(kind == n, F.concat(F.lit("10.1145/" if n == 7 else "n"), key)))])
    ids = F.when(kind == 9, F.create_map(F.lit("doi"), F.concat(F.lit("10.1101/"), key), F.lit("biorxiv_version"), F.lit("2"))).otherwise(ids)
    url, channel = F.expr(PAPER_URL), F.element_at(F.array(*[F.lit(k) for k in KINDS]), (kind + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), url.alias("url"), F.lit(None).cast("string").alias("pdf_url"), ids.alias("identifiers"), channel.alias("channel"))
    return rows


LINKS = """CASE p_partkey % 10 WHEN 0 THEN 'https://proceedings.neurips.cc/paper_files/paper/2023/file/ab' || p_partkey || '-Paper-Conference.pdf'
    WHEN 1 THEN 'https://proceedings.mlr.press/v200/x' || p_partkey || '/x' || p_partkey || '.pdf https://raw.githubusercontent.com/mlresearch/v200/main/assets/x' || p_partkey || '/x' || p_partkey || '.pdf'
    WHEN 2 THEN 'https://aclanthology.org/2024.acl-long.' || p_partkey || '.pdf' WHEN 3 THEN 'https://openaccess.thecvf.com/content/CVPR2024/papers/A' || p_partkey || '.pdf'
    WHEN 4 THEN 'https://www.ijcai.org/proceedings/2024/' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 4, '0') || '.pdf'
    WHEN 5 THEN 'https://www.ecva.net/papers/eccv_2024/papers_ECCV/papers/' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 5, '0') || '.pdf'
    WHEN 6 THEN 'https://openreview.net/pdf?id=n' || p_partkey WHEN 7 THEN 'https://dl.acm.org/doi/pdf/10.1145/' || p_partkey
    WHEN 8 THEN 'https://arxiv.org/pdf/n' || p_partkey ELSE 'https://www.biorxiv.org/content/10.1101/' || p_partkey || 'v2.full.pdf' END"""


@query(f"SELECT p_partkey, {LINKS} AS pdf FROM part")
def official_links(spark, sf):
    """Official PDF links of ten channels."""
    return _linked(spark, sf).select("p_partkey", F.array_join(records.pdf_candidates(F.col("channel")), " ").alias("pdf"))


@query(
    f"""SELECT p_partkey, {LINKS} || CASE WHEN p_partkey % 10 IN (7) THEN ' https://u/' || p_partkey || '.pdf' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' https://s/' || regexp_replace(p_name, '[^a-z]', '', 'g') || '.pdf' ELSE '' END AS links FROM part"""
)
def acquisition_candidates(spark, sf):
    """Ordered links with open-access answers: by DOI for every link of that registry, by exact title for every third paper's."""
    papers = _linked(spark, sf)
    papers = papers.withColumn("title", F.when(F.col("p_partkey") % 3 == 0, F.col("title")).otherwise(F.concat("title", F.lit(" II"))))
    by_doi = table(spark, sf, "part").select(F.expr("concat('10.1145/', p_partkey)").alias("doi"), F.expr("concat('https://u/', p_partkey, '.pdf')").alias("pdf"))
    title = table(spark, sf, "part").select(F.upper("p_name").alias("title"), F.expr("concat('https://s/', regexp_replace(p_name, '[^a-z]', ''), '.pdf')").alias("pdf")).distinct()
    out = acquire.candidates(papers, [(by_doi, "unpaywall", "doi", {"pdf": "unpaywall_pdf"}), (title, "semantic", "title", {"pdf": "exact_title_pdf"})])
    return out.select("p_partkey", F.array_join(F.transform("candidates", lambda c: c["url"]), " ").alias("links"))


@query("SELECT CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END AS channel, count(*) AS papers, CAST(sum(CASE p_partkey % 10 WHEN 1 THEN 2 ELSE 1 END) AS BIGINT) AS links FROM part GROUP BY 1")
def routed_channels(spark, sf):
    """Papers by owning channel, with the links that its rule gives."""
    papers = _linked(spark, sf).withColumn("venue", F.when(F.col("channel") == "neurips", "NIPS").when(F.col("channel") == "kdd", "SIG KDD").otherwise(F.col("channel"))).drop("channel")
    return channels.routed(papers).groupBy("channel").agg(F.count(F.lit(1)).alias("papers"), F.sum(F.size("pdf_links")).cast("bigint").alias("links"))


@query(
    """SELECT p_partkey, 'channel:acl|doi:10.1/k' || p_partkey || ' channel:acl|url:https://x/' || p_partkey || ' channel:acl|title:' || regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || '|author:ada|year:2024' AS aliases,
    p_partkey % 3 <> 1 AS hit FROM part"""
)
def full_text_aliases(spark, sf):
    """Names under which a text may be stored, and whether a stored one is the paper's: not if an identifier differs."""
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.expr("map('doi', concat('10.1/K', p_partkey), 'arxiv_id', ' ')").alias("identifiers"), F.expr("concat('https://x/', p_partkey)").alias("url"), F.lit("").alias("pdf_url"),
        F.array(F.lit("Ada")).alias("authors"), F.lit(2024).alias("year"), F.lit(None).cast("date").alias("published"),
    )
    own = records.cache_aliases(F.lit("acl"))
    other = F.when(F.col("p_partkey") % 3 == 1, F.lit("channel:acl|doi:10.1/else")).when(F.col("p_partkey") % 3 == 2, F.lit("channel:acl|pmcid:1"))
    stored = F.array_compact(F.array(other, F.concat(F.lit("channel:acl|url:"), F.col("url"))))
    return rows.select("p_partkey", F.array_join(own, " ").alias("aliases"), records.alias_hit(own, stored).alias("hit"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ACL ' || year(o_orderdate) WHEN 1 THEN 'Some Journal ' || strftime(o_orderdate, '%Y-%m-%d') ELSE '来源未提供 ' || strftime(o_orderdate, '%Y-%m-%d') END AS label,
    o_orderkey % 4 IN (0) AS html FROM orders"""
)
def source_labels(spark, sf):
    """How a read names its source, and whether a page can be a full text."""
    venue = F.expr("CASE o_orderkey % 3 WHEN 0 THEN ' ACL' WHEN 1 THEN 'Some  Journal' ELSE ' ' END")
    url = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'https://j/full/1' WHEN 1 THEN 'https://j/poster/1' WHEN 2 THEN 'https://openreview.net/forum?id=1' ELSE 'https://j/full/2' END")
    channel = F.when(F.col("o_orderkey") % 4 == 3, "acl")
    return table(spark, sf, "orders").select("o_orderkey", records.source_label(venue, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("label"), records.html_route_allowed(url, channel).alias("html"))


@query(
    """SELECT s_suppkey, 'https://dblp.org/db/' || s_suppkey || ' https://dblp.uni-trier.de/db/' || s_suppkey || ' https://dblp.dagstuhl.de/db/' || s_suppkey AS mirrors, '2401.' || s_suppkey AS arxiv_id,
    'cat:cs.AI AND submittedDate:[202401010000 TO ' || strftime(DATE '2024-01-01' + CAST(s_suppkey AS INT), '%Y%m%d') || '2359]' AS asked FROM supplier"""
)
def link_rewrites(spark, sf):
    """A bibliography's mirrors, an identifier from a link, what a preprint server is asked for."""
    key = F.col("s_suppkey").cast("string")
    rows = table(spark, sf, "supplier")
    first = F.lit("2024-01-01").cast("date")
    return rows.select(
        "s_suppkey", F.array_join(records.dblp_mirrors(F.concat(F.lit("http://www.dblp.org/db/"), key)), " ").alias("mirrors"), records.arxiv_id(F.concat(F.lit("http://arxiv.org/abs/2401."), key, F.lit("v3"))).alias("arxiv_id"),
        records.arxiv_query(F.lit("cs.AI"), first, F.date_add(first, F.col("s_suppkey").cast("int"))).alias("asked"),
    )


def _index(spark, sf):
    cust = table(spark, sf, "customer")
    return cust.select(
        F.lower("c_name").alias("title"), F.expr("concat('D', c_custkey)").alias("doi"), F.repeat("c_mktsegment", 12).alias("abstract"), F.expr("concat('https://p/', c_custkey)").alias("pdf_url"),
        F.array(F.concat(F.lit("Ann "), F.col("c_mktsegment"))).alias("authors"),
    )


def _lacking(spark, sf, title, doi, author="'Nobody'"):
    cust = table(spark, sf, "customer")
    return cust.select("c_custkey", F.expr(title).alias("title"), F.expr(doi).alias("doi"), F.lit("").alias("abstract"), F.lit(None).cast("string").alias("pdf_url"), F.array(F.expr(author)).alias("authors"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN repeat(c_mktsegment, 12) ELSE '' END AS abstract, CASE WHEN c_custkey % 2 = 0 THEN 'https://p/' || c_custkey END AS pdf_url FROM customer")
def fill_by_doi_and_title(spark, sf):
    """Abstracts where DOI and title both agree."""
    rows = _lacking(spark, sf, "c_name", "CASE c_custkey % 4 WHEN 1 THEN '' WHEN 3 THEN 'd-1' ELSE concat('d', c_custkey) END")
    return enrich.fill_by_doi_and_title(rows, _index(spark, sf)).select("c_custkey", "abstract", "pdf_url")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE repeat(c_mktsegment, 12) END AS abstract, CASE WHEN c_custkey % 3 <> 2 THEN 'https://p/' || c_custkey END AS pdf_url FROM customer")
def fill_by_title_or_doi(spark, sf):
    """Abstracts by title, else by DOI; a differing DOI never matches."""
    rows = _lacking(spark, sf, "CASE c_custkey % 3 WHEN 1 THEN 'Another title' ELSE c_name END", "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('d', c_custkey) ELSE 'x' END")
    return enrich.fill_by_title_or_doi(rows, _index(spark, sf)).select("c_custkey", "abstract", "pdf_url")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN repeat(c_mktsegment, 12) ELSE '' END AS abstract FROM customer")
def fill_by_title_and_author(spark, sf):
    """Abstracts by title where an author's family name agrees as well."""
    rows = _lacking(spark, sf, "c_name", "''", "CASE c_custkey % 3 WHEN 0 THEN concat('Z. ', lower(c_mktsegment)) ELSE 'Ann Nobody' END")
    return enrich.fill_by_title(rows, _index(spark, sf), authors_overlap=True).select("c_custkey", "abstract")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'late ' || c_custkey ELSE '' END AS abstract FROM customer")
def restored_checkpoints(spark, sf):
    """What a broken-off run had completed, its latest state."""
    cust = table(spark, sf, "customer").where("c_custkey % 2 = 0")
    saved = [cust.select(F.upper("c_name").alias("title"), F.concat(F.lit(f"{word} "), F.col("c_custkey").cast("string")).alias("abstract"), F.lit(at).cast("timestamp").alias("saved_at")) for word, at in (("late", "2024-01-02"), ("early", "2024-01-01"))]
    rows = _lacking(spark, sf, "c_name", "''")
    return enrich.restore_checkpoints(rows, saved[0].unionByName(saved[1]), ["abstract"]).select("c_custkey", "abstract")


def _preprints(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", "source", F.lit("A title").alias("title"), F.col("text").alias("abstract"), F.when(F.col("doc_id") % 5 != 0, F.array("lang")).alias("authors"),
        F.create_map(F.lit("arxiv_id"), F.floor(F.col("doc_id") / 2).cast("string")).alias("identifiers"), F.lit("2024-01-02").alias("published"), F.array(F.lit("cs.AI")).alias("categories"), F.lit("").alias("version"),
    )


PAPER_TEXT = "trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract"


@query(
    f"""WITH p AS (SELECT doc_id, source, {PAPER_TEXT} FROM documents)
    SELECT source, count(*) FILTER (NOT {REAL} OR doc_id % 5 = 0) AS invalid_records, count(*) - count(DISTINCT doc_id // 2) AS duplicate_records FROM p GROUP BY source"""
)
def preprint_shards(spark, sf):
    """Invalid and repeated rows of each shard."""
    rows = _preprints(spark, sf)
    return audit.preprint_violations(rows, "arxiv", ["source"], F.lit("2024-01-02").cast("date"), F.lit("cs.AI"))


@query(
    f"""WITH p AS (SELECT doc_id, {PAPER_TEXT} FROM documents), a AS (SELECT count(*) AS n, bool_and({REAL}) AS r FROM p)
    SELECT n AS record_count, true AS receipt_ok, true AS payload_binding_ok, true AS receipt_binding_ok, true AS row_binding_ok, true AS minimum_ok, true AS adapter_ok, r AS metadata_completeness_ok, r AS complete FROM a"""
)
def catalog_contract(spark, sf):
    """The contract of a catalog that is to be kept, rule by rule."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("identity"), F.lit("A title").alias("title"), F.col("text").alias("abstract"), F.array("lang").alias("authors"), F.lit("https://x").alias("url"), F.lit("").alias("pdf_url"), F.lit(2024).alias("year"), F.lit(None).cast("date").alias("published"), F.lit("ACL").alias("venue"), F.lit("Venue").alias("source_type"))
    n, years = F.count(F.lit(1)), F.array(F.lit(2024))
    receipt = docs.agg(n.alias("count"), n.alias("discovered_count")).select("*", F.lit("complete").alias("status"), F.lit(True).alias("complete_catalog"), F.lit("every page").alias("exhaustion_proof"), years.alias("requested_years"), years.alias("effective_years"), F.lit("acl").alias("channel"), F.lit(1).alias("schema_version"), F.lit("a").alias("adapter"))
    return audit.catalog_contract(rows, receipt, "acl", 2024, minimum=1)


_BROKEN = {
    "whole": "", "receipt": "receipt_ok", "channel": "payload_binding_ok", "count": "receipt_binding_ok", "year": "row_binding_ok", "minimum": "minimum_ok", "adapter": "adapter_ok", "abstract": "metadata_completeness_ok",
}
_RULES = ("receipt_ok", "payload_binding_ok", "receipt_binding_ok", "row_binding_ok", "minimum_ok", "adapter_ok", "metadata_completeness_ok")


@query(
    """WITH n AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 9 = 0) AS odd, count(*) FILTER (c_custkey % 4 = 0) AS bare FROM customer), v(variant) AS (VALUES ('whole'), ('receipt'), ('channel'), ('count'), ('year'), ('minimum'), ('adapter'), ('abstract')),
    r AS (SELECT variant, n AS record_count, variant <> 'receipt' AS receipt_ok, variant <> 'channel' AS payload_binding_ok, n = CASE variant WHEN 'count' THEN n + 1 ELSE n END AS receipt_binding_ok,
        CASE variant WHEN 'year' THEN odd ELSE 0 END = 0 AS row_binding_ok, n >= CASE variant WHEN 'minimum' THEN n + 1 ELSE 1 END AS minimum_ok, variant <> 'adapter' AS adapter_ok, CASE variant WHEN 'abstract' THEN bare ELSE 0 END = 0 AS metadata_completeness_ok FROM n, v)
    SELECT *, receipt_ok AND payload_binding_ok AND receipt_binding_ok AND row_binding_ok AND minimum_ok AND adapter_ok AND metadata_completeness_ok AS complete FROM r"""
)
def broken_contracts(spark, sf):
    """The contract of a catalog, whole and with each of its rules broken once."""
    cust = table(spark, sf, "customer")
    n, out = cust.count(), None
    for variant in _BROKEN:
        is_ = lambda name, yes, no, variant=variant: yes if variant == name else no
        key = F.col("c_custkey")
        abstract = F.when((key % 4 == 0) & F.lit(variant == "abstract"), "").otherwise("This is a real abstract with many more than eight words and over fifty characters.")
        rows = cust.select(
            key.alias("identity"), F.col("c_name").alias("title"), abstract.alias("abstract"), F.array(F.lit("A")).alias("authors"), F.lit("https://x").alias("url"), F.lit("").alias("pdf_url"),
            F.when((key % 9 == 0) & F.lit(variant == "year"), 2023).otherwise(2024).alias("year"), F.lit(None).cast("date").alias("published"), F.lit("ACL").alias("venue"), F.lit("venue").alias("source_type"),
        )
        told = n + is_("count", 1, 0)
        receipt = spark.createDataFrame(
            [(is_("receipt", "partial", "complete"), True, "all pages", told, told, [2024], [2024], is_("channel", "EMNLP", "ACL"), 1, is_("adapter", "other", "acl"))],
            "status string, complete_catalog boolean, exhaustion_proof string, count long, discovered_count long, requested_years array<int>, effective_years array<int>, channel string, schema_version int, adapter string",
        )
        one = audit.catalog_contract(rows, receipt, "acl", 2024, minimum=is_("minimum", n + 1, 1), adapter="acl").withColumn("variant", F.lit(variant))
        out = one if out is None else out.unionByName(one)
    return out.select("variant", "record_count", *_RULES, "complete")


@query(
    """SELECT c_nationkey, count(*) FILTER (c_custkey % 3 = 0) AS wrong_year_count, count(*) FILTER (c_custkey % 5 = 0) AS wrong_venue_count, count(*) FILTER (c_custkey % 7 = 0) AS wrong_type_count FROM customer WHERE c_nationkey < 4 GROUP BY 1"""
)
def binding_counts(spark, sf):
    """Rows of a wrong year, venue or type in catalogs that are meant to hold one of each."""
    key, out = F.col("c_custkey"), None
    for nation in range(4):
        rows = table(spark, sf, "customer").where(F.col("c_nationkey") == nation).select(
            F.when(key % 2 == 0, F.when(key % 3 == 0, 2020).otherwise(2024)).alias("year"), F.when(key % 2 != 0, F.when(key % 3 != 0, F.lit("2024-05-01").cast("date"))).alias("published"),
            F.when(key % 5 != 0, " a.C-l ").alias("venue"), F.when(key % 7 == 0, "preprint").otherwise(" Venue").alias("source_type"),
        )
        one = audit.binding_audit(rows, 2024, "acl").withColumn("c_nationkey", F.lit(nation))
        out = one if out is None else out.unionByName(one)
    return out.select("c_nationkey", "wrong_year_count", "wrong_venue_count", "wrong_type_count")


@query(
    f"""WITH p AS (SELECT doc_id, {PAPER_TEXT} FROM documents), r AS (SELECT doc_id, {REAL} AS ok FROM p), n AS (SELECT count(*) AS n, count(*) FILTER (ok) AS good, count(*) FILTER (ok AND doc_id % 4 = 0) AS odd FROM r)
    SELECT 'whole' AS catalog, 'complete' AS status, '' AS broken, good AS record_count, good AS kept FROM n
    UNION ALL SELECT 'short', CASE WHEN good < n THEN 'incomplete' ELSE 'complete' END, CASE WHEN good < n THEN 'abstracts,completeness' ELSE '' END, n, CASE WHEN good < n THEN 0 ELSE n END FROM n
    UNION ALL SELECT 'missing', 'incomplete', 'discovered', good, 0 FROM n UNION ALL SELECT 'foreign', CASE WHEN odd > 0 THEN 'refused' ELSE 'complete' END, CASE WHEN odd > 0 THEN 'binding' ELSE '' END, good, CASE WHEN odd > 0 THEN 0 ELSE good END FROM n
    UNION ALL SELECT 'empty', 'authoritative_empty', '', 0, 0"""
)
def published_catalogs(spark, sf):
    """Catalogs audited by the pass that writes them: kept, or removed with the rules that they break."""
    at, docs = scratch(spark, "catalogs"), table(spark, sf, "documents")
    rows = docs.select(
        F.col("doc_id").alias("identity"), F.lit("A title").alias("title"), F.col("text").alias("abstract"), F.array(F.lit("A")).alias("authors"), F.lit("https://x").alias("url"), F.lit(None).cast("string").alias("pdf_url"),
        F.lit(2024).alias("year"), F.lit(None).cast("date").alias("published"), F.lit("ACL").alias("venue"),
    )
    good = rows.where(T.abstract_is_real(F.col("abstract")))
    n = good.count()
    tried = {
        "whole": (good, catalogs.Receipt()), "short": (rows, catalogs.Receipt()), "missing": (good, catalogs.Receipt(discovered=n + 1)), "empty": (rows.where("identity < 0"), catalogs.Receipt(minimum=5)),
        "foreign": (good.withColumn("year", F.when(F.col("identity") % 4 == 0, 2023).otherwise(2024)), catalogs.Receipt()),
    }
    out = []
    for name, (some, receipt) in tried.items():
        got = catalogs.publish(some, f"{at}/{name}", "acl", 2024, receipt, F.lit("2024-06-01").cast("timestamp"))
        kept = catalogs.current(spark, f"{at}/{name}", "acl", 2024)
        out.append((name, got.status, ",".join(got.broken), got.metrics["record_count"], kept.count() if kept is not None else 0))
    return spark.createDataFrame(out, "catalog string, status string, broken string, record_count long, kept long")


@query(
    """WITH p AS (SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n, source || '|' || (length(text) % 97) AS identity FROM documents),
    r AS (SELECT identity, doc_id, min(doc_id) OVER (PARTITION BY identity) AS first, row_number() OVER (PARTITION BY identity ORDER BY n DESC, doc_id) AS place FROM p)
    SELECT identity, doc_id, first FROM r WHERE place = 1"""
)
def merged_winners(spark, sf):
    """Keep-longest day by day, in four days, the third of them twice: the same winners and first places as at once."""
    at, docs = scratch(spark, "winners"), table(spark, sf, "documents")
    rows = docs.select(F.concat_ws("|", "source", (F.length("text") % 97).cast("string")).alias("identity"), "doc_id", F.col("text").alias("abstract"), F.lit(0).alias("_source_index"), F.col("doc_id").alias("_source_pos"))
    for day in (2, 0, 3, 1, 3):
        winners.merge(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == day), at, 64)
    return winners.winners(spark, at).select("identity", "doc_id", F.col("first_position._source_pos").alias("first"))


@query(
    f"""WITH p AS (SELECT doc_id, {PAPER_TEXT} FROM documents), b AS (SELECT 'T' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS t FROM p WHERE NOT {REAL} ORDER BY t LIMIT 5)
    SELECT (SELECT count(*) FROM p) AS record_count, (SELECT coalesce(string_agg(t, ' ' ORDER BY t), '') FROM b) AS examples"""
)
def invalid_abstract_examples(spark, sf):
    """The first five titles whose abstracts are none."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("identity"), F.expr("concat('T', lpad(doc_id, 12, '0'))").alias("title"), F.col("text").alias("abstract"), F.array("lang").alias("authors"), F.lit("https://x").alias("url"), F.lit("").alias("pdf_url"))
    return audit.venue_audit(rows).select("record_count", F.array_join("invalid_abstract_examples", " ").alias("examples"))


@query("SELECT o_custkey AS c_custkey FROM orders GROUP BY 1 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def uncovered_keys(spark, sf):
    """Wanted keys that a table lacks."""
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return audit.uncovered(wanted, table(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey")


@query(
    """WITH c AS (SELECT doc_id FROM labels), d AS (SELECT doc_id FROM documents)
    SELECT doc_id AS identity, 'sum_differs' AS violation FROM c WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'missing_limitations' FROM c WHERE doc_id % 7 = 0
    UNION ALL SELECT doc_id, 'wrong_full_text_path' FROM c WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'no_validated_read' FROM c WHERE doc_id % 13 = 0
    UNION ALL SELECT doc_id, 'wrong_read_path' FROM c WHERE doc_id % 17 = 0 AND doc_id % 13 <> 0 UNION ALL SELECT doc_id, 'missing_identity' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM c)"""
)
def evidence_checks(spark, sf):
    """Evidence cards against the ready texts and validated reads that they cite."""
    key = F.col("doc_id")
    match, transfer = (F.col("quality") * 6 + key % 4).cast("double"), (F.lit(10) - F.col("toxic") * 5 - key % 3).cast("double")
    cards = table(spark, sf, "labels").select(
        key.alias("identity"), match.alias("match_score"), transfer.alias("transferability_score"), (match + transfer + F.when(key % 5 == 0, 0.5).otherwise(0.0)).alias("final_score"), F.lit("s").alias("summary"),
        F.array(F.lit("d")).alias("decisive_evidence"), F.when(key % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("l"))).alias("limitations"), F.array(F.lit("b")).alias("borrowable_elements"), F.lit("high").alias("confidence"),
        F.when(key % 11 == 0, "/else").otherwise(F.expr("concat('/t/', doc_id)")).alias("full_text_path"), F.when(key % 17 == 0, "/else").otherwise(F.expr("concat('/r/', doc_id)")).alias("read_path"),
    )
    docs = table(spark, sf, "documents")
    ready = docs.select(key.alias("identity"), F.expr("concat('/t/', doc_id)").alias("text_path"))
    seen = docs.where("doc_id % 13 <> 0").select(key.alias("identity"), F.expr("concat('/r/', doc_id)").alias("read_path"))
    return score.evidence_violations(cards, ready, seen)


@query("SELECT c_custkey AS identity FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def whole_payloads(spark, sf):
    """Payloads whose every file is there with its size and digest."""
    cust = table(spark, sf, "customer")
    file = lambda n: F.struct(F.expr(f"concat('/p/', c_custkey, '/{n}')").alias("path"), F.sha2(F.concat("c_name", F.lit(n)), 256).alias("sha256"), F.length("c_name").cast("bigint").alias("size"))
    payloads = cust.select(F.col("c_custkey").alias("identity"), F.array(file("a"), file("b")).alias("files"))
    there = payloads.select("identity", F.explode("files").alias("f")).select("identity", "f.*")
    there = there.where("NOT (identity % 5 = 0 AND path LIKE '%b')").withColumn("size", F.col("size") + F.when(F.col("identity") % 7 == 0, 1).otherwise(0))
    return fulltext.files_valid(payloads, there).select("identity")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'https://p/' || event_id WHEN 1 THEN 'https://own' ELSE '' END AS pdf_url FROM events")
def accepted_pdf_links(spark, sf):
    """The link of the first accepted PDF attempt, else the record's own."""
    attempt = lambda url, ok: F.struct(F.lit("pdf").alias("kind"), url.alias("url"), F.lit(200).alias("status_code"), F.lit(ok).alias("accepted"), *[F.lit(None).cast("string").alias(n) for n in ("reason", "status", "error_type", "message")])
    tries = F.array(attempt(F.lit("https://no"), False), attempt(F.lit(" "), True), attempt(F.expr("concat('https://p/', event_id)"), True))
    attempts = F.create_map(F.when(F.col("event_id") % 3 == 0, "pdf").otherwise("html"), tries)
    return table(spark, sf, "events").select("event_id", fulltext.accepted_pdf_url(attempts, F.when(F.col("event_id") % 3 == 1, " https://own")).alias("pdf_url"))


@query("SELECT CAST(max(event_id % 97) AS BIGINT) AS max_cooldown_seconds FROM events")
def longest_cooldown(spark, sf):
    return fulltext.max_cooldown(table(spark, sf, "events").select((F.col("event_id") % 97).alias("cooldown_seconds")))


@query(
    """SELECT o_orderpriority AS venue, CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS row_count FROM orders WHERE o_orderstatus = 'F'
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
)
def newest_complete_catalogs(spark, sf):
    """Of each venue and year the complete copy fetched last."""
    copies = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("venue"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").alias("fetched_at"), F.col("o_orderkey").alias("row_count"), (F.col("o_orderstatus") == "F").alias("complete"), F.lit("p").alias("path"))
    return dedup.newest_complete(copies).select("venue", "year", "row_count")


READ = {"摘要": "本文研究图神经网络的方法与应用。", "动机与核心创新": "动机：" + "动" * 100 + "核心创新：" + "新" * 110, "方法": "方" * 320 + " $x=1$ ", "实验结果": "果" * 40, "优缺点总结": "优" * 40}


def _reads(spark, sf, *changes: tuple[str, str]):
    """A read for every part, titled by it; the n-th change is made where the key's remainder is n (0: none)."""
    body = "\n- **来源：** ACL 2024\n- **论文链接：** URL：u；PDF：p\n" + "".join(f"## {k}\n{v}\n" for k, v in READ.items())
    bodies = [body, *(body.replace(a, b) for a, b in changes)]
    text = F.concat(F.lit("# "), F.initcap("p_name"), F.element_at(F.array(*[F.lit(b) for b in bodies]), (F.col("p_partkey") % len(bodies) + 1).cast("int")))
    return spread(table(spark, sf, "part")).select("p_partkey", F.col("p_name").alias("title"), text.alias("text"))


@query(
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN 'source_line' WHEN 2 THEN 'link_line' WHEN 3 THEN 'method_formula' WHEN 4 THEN 'results_length' WHEN 5 THEN 'sections,verdict_empty,verdict_little_chinese' WHEN 6 THEN 'bare_latex' ELSE '' END AS errors FROM part"""
)
def read_checks(spark, sf):
    """Rules that a read breaks."""
    found = _reads(spark, sf, ("- **来源：** ACL 2024", "- 来源"), ("URL：u", "u"), ("$x=1$", ""), ("果" * 40, "果" * 160), ("## 优缺点总结", "## 其他"), ("$x=1$", r"$x=1$ \alpha"))
    return found.select("p_partkey", F.array_join(reads.read_errors(F.col("text"), F.col("title"), F.lit("An English abstract.")), ",").alias("errors"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'paper_differs' WHEN 2 THEN 'not_complete' WHEN 3 THEN 'read_digest' WHEN 4 THEN 'not_whole_text' WHEN 5 THEN 'map_count' ELSE '' END AS errors FROM part"""
)
def receipt_checks(spark, sf):
    """Rules that a reading receipt breaks."""
    found, key = _reads(spark, sf), F.col("p_partkey")
    abstract, zh = F.lit("We study graphs. It works."), ["本文研究图神经网络的方法", "与应用。"]
    body = READ["摘要"]
    zh = [body[:8], body[8:]]
    whole = F.repeat("title", 50)
    mapped = F.array(*[F.struct(F.sha2(F.lit(s), 256).alias("source_sha256"), F.lit(t).alias("translation_zh")) for s, t in zip(("We study graphs.", "It works."), zh)])
    receipt = F.struct(
        F.when(key % 6 == 2, "partial").otherwise("complete").alias("status"), F.lit(True).alias("subagent_deep_read"), F.when(key % 6 == 1, "x").otherwise(key.cast("string")).alias("paper_id"), F.col("title").alias("title"), F.lit("s").alias("source"),
        F.struct(
            F.sha2(whole, 256).alias("full_text_sha256"), F.sha2(abstract, 256).alias("source_abstract_sha256"), F.when(key % 6 == 3, "0").otherwise(F.sha2("text", 256)).alias("read_sha256"),
            (F.length(whole) - F.when(key % 6 == 4, 1).otherwise(0)).alias("evidence_chars"),
        ).alias("deep_read_audit"),
        F.when(key % 6 == 5, F.slice(mapped, 1, 1)).otherwise(mapped).alias("abstract_sentence_map"),
    )
    return found.select("p_partkey", F.array_join(reads.receipt_errors(receipt, key.cast("string"), F.col("title"), abstract, F.col("text"), whole), ",").alias("errors"))


@query(
    """SELECT p_partkey, '# ' || p_brand || chr(10) || '- **来源：** ACL 2024' || chr(10) || '- **论文链接：** URL：[论文页面](https://u)；PDF：none' || chr(10) || '## 摘要' AS head FROM part"""
)
def front_matter(spark, sf):
    """Title, source and link lines rewritten."""
    out = reads.normalize_front_matter(F.col("text"), F.col("p_brand"), F.lit("ACL"), F.lit("2024-03-01"), F.lit("https://u"), F.lit("none"))
    rows = _reads(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    return rows.select("p_partkey", F.array_join(F.slice(F.split(out, "\n"), 1, 4), "\n").alias("head"))


@query(
    """SELECT n, '## ' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || '. ' || p_name AS heading FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_name FROM part)"""
)
def aggregated_reads(spark, sf):
    """All reads as the numbered parts of one document."""
    rows = table(spark, sf, "part").select(F.concat(F.lit("# "), F.col("p_name"), F.lit("\n## 方法\nx")).alias("text"), F.col("p_partkey").alias("position"))
    return reads.aggregate_reads(rows).select(F.col("n").cast("bigint").alias("n"), F.get(F.split("part", "\n"), F.lit(0)).alias("heading"))


@query("SELECT event_id AS identity, 'https://u/' || event_id AS paper_url, 'ACL 2024' AS source FROM events WHERE event_id % 2 = 0 AND event_id % 3 = 0")
def failed_reading_queue(spark, sf):
    """What readers get of ready items, only those that failed before."""
    items = table(spark, sf, "events").select(
        F.col("event_id").alias("identity"), F.lit("t").alias("title"), F.lit("/t").alias("text_path"), F.lit("ACL").alias("venue"), F.lit("2024").alias("published"), F.expr("concat(' https://u/', event_id)").alias("url"),
        (F.col("event_id") % 2 == 0).alias("full_text_available"), F.col("event_id").alias("position"),
    )
    failures = table(spark, sf, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("identity"))
    return reads.only_failed(reads.reading_queue(items), failures).select("identity", "paper_url", "source")
