"""Queries of the sources' decoders, over documents made of the tables' rows, and of composed venues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.plans.catalog import query
from corpusmill.session import checkpointed, conf, pushed_filters, scratch, spread, table
from corpusmill.sources import files, indexes, pages, pdf, pdf_made, scholarly, venues


def _xml(rows: DataFrame, document: str, schema: str) -> DataFrame:
    """Entries of a schema, from XML made by a SQL expression."""
    return rows.select(F.from_xml(F.expr(document), schema).alias("r")).select("r.*")


@query(
    """SELECT p_name AS title, 'Ada Lovelace|Alan Turing' AS authors, '2024-01-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') AS published, 'cond-mat/' || p_partkey AS arxiv_id,
    CASE WHEN p_partkey % 2 = 0 THEN 'http://arxiv.org/pdf/' || p_partkey ELSE 'https://arxiv.org/pdf/cond-mat/' || p_partkey END AS pdf_url, 'cs.AI|cs.LG' AS categories FROM part"""
)
def atom_entries(spark, sf):
    """Entries of a preprint feed."""
    document = """concat('<entry><id>http://arxiv.org/abs/cond-mat/', p_partkey, 'v2</id><title>', p_name, '</title><summary>s</summary><published>2024-01-', lpad(1 + p_partkey % 28, 2, '0'),
        'T10:00:00Z</published><author><name>Ada Lovelace</name></author><author><name>Alan Turing</name></author>', CASE WHEN p_partkey % 2 = 0 THEN concat('<link href="http://arxiv.org/pdf/', p_partkey, '" title="pdf" rel="related"/>') ELSE '' END,
        '<link href="http://x" rel="alternate"/><category term="cs.AI"/><category term="cs.LG"/></entry>')"""
    out = files.atom_rows(_xml(table(spark, sf, "part"), document, files.ATOM))
    return out.select("title", F.array_join("authors", "|").alias("authors"), F.col("published").cast("string").alias("published"), F.col("identifiers")["arxiv_id"].alias("arxiv_id"), "pdf_url", F.array_join("categories", "|").alias("categories"))


@query(
    """SELECT c_name AS title, 'https://www.biorxiv.org/content/10.1101/' || c_custkey || 'v' || CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '3' END AS url, CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '3' END AS version,
    CASE WHEN c_custkey % 3 = 0 THEN '2024-02-01' END AS published, lower(c_mktsegment) AS category FROM customer"""
)
def preprint_items(spark, sf):
    """Items of a preprint listing; a missing version is the first, a day that doesn't exist is none."""
    document = F.to_json(F.struct(F.array(F.struct(F.expr("concat('10.1101/', c_custkey)").alias("doi"), F.expr("concat(' ', c_name)").alias("title"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '3' END").alias("version"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN '2024-02-01' ELSE '2024-02-31' END").alias("date"), F.lower("c_mktsegment").alias("category"))).alias("collection")))
    items = table(spark, sf, "customer").select(F.explode(F.from_json(document, f"collection {files.PREPRINTS}")["collection"]).alias("i")).select("i.*")
    return files.preprint_rows(items).select("title", "url", "version", F.col("published").cast("string").alias("published"), "category")


@query("SELECT 'n' || c_custkey AS note, c_name AS title, c_mktsegment AS abstract, 'P|Q' AS authors, CASE WHEN c_custkey % 2 = 0 THEN 'k' ELSE '' END AS categories FROM customer WHERE c_custkey % 5 <> 0")
def review_notes(spark, sf):
    """Notes of a review platform, values bare or wrapped; a note without a title is none."""
    wrap = lambda c: F.struct(c.alias("value"))
    title = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    content = F.struct(wrap(title).alias("title"), F.col("c_mktsegment").alias("abstract"), wrap(F.array(F.lit("P"), F.lit("Q "), F.lit("P"))).alias("authors"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("k"), F.lit("k"))).alias("keywords"))
    page = F.to_json(F.struct(F.array(F.struct(F.expr("concat('n', c_custkey)").alias("id"), content.alias("content"))).alias("notes")))
    out = files.openreview_rows(table(spark, sf, "customer").select(page.alias("value")), "ICLR", 2024)
    return out.select(F.col("identifiers")["openreview_id"].alias("note"), "title", "abstract", F.array_join("authors", "|").alias("authors"), F.array_join("categories", "|").alias("categories"))


@query(
    """SELECT p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'https://aclanthology.org/2024.acl-long.' || p_partkey ELSE 'https://aclanthology.org/2024.acl-main.' || p_partkey END || '.pdf' AS pdf_url, 'Ada B Lovelace' AS authors FROM part"""
)
def anthology_papers(spark, sf):
    """Papers of an anthology's volumes, with their own address or one made of volume and number."""
    document = "concat('<paper id=\"', p_partkey, '\"><title>', p_name, '</title><author><first>Ada</first><middle>B</middle><last>Lovelace</last></author><author><last> </last></author>', CASE WHEN p_partkey % 2 = 0 THEN concat('<url>2024.acl-long.', p_partkey, '</url>') ELSE '' END, '</paper>')"
    return files.anthology_rows(_xml(table(spark, sf, "part"), document, files.ANTHOLOGY), "ACL", 2024).select("title", "pdf_url", F.array_join("authors", "|").alias("authors"))


@query(
    """SELECT c_name || ' a title' AS title, '10.1145/' || c_custkey AS doi, 'conf/kdd/' || c_custkey AS dblp_key, CASE WHEN c_custkey % 2 = 0 THEN 'https://h/' || c_custkey || '.pdf' ELSE '' END AS pdf_url FROM customer WHERE c_custkey % 4 <> 3"""
)
def bibliography_titles(spark, sf):
    """Titles of a bibliography's volumes, of their year, each once."""
    document = """concat('<inproceedings key="conf/kdd/', c_custkey, '"><author>A B</author><title>', c_name, ' a title', '</title><year>', CASE WHEN c_custkey % 4 = 3 THEN '2023' ELSE '2024' END,
        '</year><ee>https://doi.org/10.1145/', c_custkey, '.</ee>', CASE WHEN c_custkey % 2 = 0 THEN concat('<ee>https://h/', c_custkey, '.pdf</ee>') ELSE '' END, '</inproceedings>')"""
    cust = table(spark, sf, "customer")
    again = cust.select((F.col("c_custkey") + 0).alias("c_custkey"), F.upper("c_name").alias("c_name"))
    rows = _xml(cust.select("c_custkey", "c_name"), document, files.DBLP).unionByName(_xml(again, document.replace("conf/kdd/", "conf/zzz/"), files.DBLP))
    out = files.dblp_rows(rows, "KDD", 2024)
    return out.select("title", F.col("identifiers")["doi"].alias("doi"), F.col("identifiers")["dblp_key"].alias("dblp_key"), "pdf_url")


@query("SELECT conv_id, turn, sha256('Head' || chr(10) || regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\x0b\\f\\r]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS body FROM conversations")
def article_texts(spark, sf):
    """Character data of XML articles."""
    page = F.concat(F.lit("<?xml version='1.0'?><!-- no --><article><title>Head</title><p>"), F.col("text"), F.lit("</p></article>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(files.article_text(page), 256).alias("body"))


@query(
    """SELECT c_custkey AS k, 'Über ' || c_name || chr(10) || 'x < ' || c_custkey || ' & y > z' || chr(10) || 'kept <b>' || lower(c_mktsegment) || '</b> &amp; as it stands' || chr(10) || 'joined, not parted' || chr(10) || 'after' AS text FROM customer"""
)
def article_entities(spark, sf):
    """Character data of XML articles: entities named, decimal and hexadecimal, CDATA sections, comments and instructions."""
    page = F.expr(
        """concat('<?xml version="1.0"?><!DOCTYPE article [<!ELEMENT p ANY>]><article><title>&#220;ber ', c_name, '</title><!-- a <p>comment</p> --><p>x &lt; ', c_custkey, ' &amp; y &#x3E; z</p>',
        '<p><![CDATA[kept <b>', lower(c_mktsegment), '</b> &amp; as it stands]]></p><p>joined<![CDATA[, not]]> parted</p><?go on?><p>after<![CDATA[]]></p></article>')"""
    )
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), files.article_text(page).alias("text"))


@query(
    """SELECT page_id, 'Heading of ' || page_id || chr(10) || 'It says "a < b" &  more.' || chr(10) || url AS text, length(url) > 0 AS has FROM pages"""
)
def made_main_text(spark, sf):
    """Running text of pages with menus, scripts and notices around their article, or in main, or in the body alone."""
    kind = F.element_at(F.array(F.lit("article"), F.lit("main"), F.lit("section")), (F.col("page_id") % 3 + 1).cast("int"))
    body = F.concat(F.lit("<h1>Heading of "), F.col("page_id").cast("string"), F.lit("</h1>\n<script>var a = '<p>no</p>';</script><p>It says &quot;a &lt; b&quot; &amp;  more.</p><aside>Not this</aside><p>"), F.col("url"), F.lit("</p>"))
    html = F.concat(
        F.lit("<html><head><title>T</title><style>p {}</style></head><body><nav><a href='/'>Home</a></nav><header><p>Top</p></header><"), kind, F.lit(">"), body, F.lit("</"), kind,
        F.lit("><footer><p>Bottom</p></footer></body></html>"),
    )
    return table(spark, sf, "pages").select("page_id", pages.main_text(html).alias("text"), (F.length("url") > 0).alias("has"))


@query("SELECT event_type AS kind, CAST(sum(length(CAST(event_id AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM events GROUP BY 1")
def run_inventory(spark, sf):
    """Files below a folder and their sizes, contents unread."""
    at = scratch(spark, "inventory")
    table(spark, sf, "events").select("event_type", F.col("event_id").cast("string").alias("value")).write.partitionBy("event_type").text(at)
    found = files.inventory(spark, at).where("path LIKE '%/part-%'")
    return found.groupBy(F.regexp_extract("path", "event_type=(\\w+)/", 1).alias("kind")).agg(F.sum("length").alias("bytes"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer")
def object_lines(spark, sf):
    """Objects line by line, blank lines aside."""
    lines = table(spark, sf, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))).alias("value"))
    blank = table(spark, sf, "region").select(F.lit("  ").alias("value"))
    return files.jsonl_rows(lines.unionByName(blank), "k bigint, name string")


@query("SELECT CAST(doc_id AS VARCHAR) AS identity, CAST(quality AS VARCHAR) AS metadata_score, CAST(toxic AS VARCHAR) AS topic_fit FROM labels")
def score_documents(spark, sf):
    """Score rows of documents that are a list, or an object that holds one under one of three names."""
    item = F.struct(F.col("doc_id").cast("string").alias("identity"), F.col("quality").cast("string").alias("metadata_score"), F.struct(F.col("toxic").cast("string").alias("topic_fit")).alias("components"))
    rows = table(spark, sf, "labels").select((F.col("doc_id") % 4).alias("form"), F.to_json(F.array(item)).alias("one"))
    names = F.element_at(F.array(F.lit("scores"), F.lit("papers"), F.lit("items")), F.greatest(F.col("form"), F.lit(1)).cast("int"))
    value = F.when(F.col("form") == 0, F.col("one")).otherwise(F.concat(F.lit('{"'), names, F.lit('": '), F.col("one"), F.lit("}")))
    return files.score_rows(rows.select(value.alias("value"))).select("identity", "metadata_score", F.col("components.topic_fit").alias("topic_fit"))


@query("SELECT c_name AS title, '10.1234/' || c_custkey AS doi, 'we study ' || lower(c_mktsegment) AS abstract, 'Ada' AS authors FROM customer")
def indexed_works(spark, sf):
    """Works of an index whose abstracts are inverted."""
    index = F.create_map(F.lit("study"), F.array(F.lit(1)), F.lower("c_mktsegment"), F.array(F.lit(2)), F.lit("we"), F.array(F.lit(0)))
    work = F.struct(F.expr("concat('https://doi.org/10.1234/', c_custkey)").alias("doi"), F.col("c_name").alias("title"), index.alias("abstract_inverted_index"), F.array(F.struct(F.struct(F.lit("Ada").alias("display_name")).alias("author"))).alias("authorships"))
    rows = table(spark, sf, "customer").select(F.from_json(F.to_json(work), indexes.WORK).alias("w")).select("w.*")
    return indexes.inverted_rows(rows).select("title", "doi", "abstract", F.array_join("authors", "|").alias("authors"))


@query(
    """SELECT c_name AS title, '10.1/' || c_custkey AS doi, 'a longer text' AS abstract, CASE WHEN c_custkey % 2 = 0 THEN 'https://h/x.pdf' ELSE 'https://arxiv.org/pdf/' || c_custkey END AS pdf_url FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_name, '10.2/' || c_custkey, 'a longer text', CASE WHEN c_custkey % 2 = 0 THEN 'https://h/x.pdf' ELSE 'https://arxiv.org/pdf/' || c_custkey END FROM customer WHERE c_custkey % 3 <> 0"""
)
def research_products(spark, sf):
    """Publications among research products, a row for each DOI, with the longest description and a direct PDF if there is one."""
    key = F.col("c_custkey").cast("string")
    pid = lambda scheme, value: F.struct(F.lit(scheme).alias("scheme"), value.alias("value"))
    item = F.struct(
        F.when(F.col("c_custkey") % 3 == 0, "dataset").otherwise("publication").alias("type"), F.col("c_name").alias("mainTitle"), F.array(F.lit("short"), F.lit("a longer  text")).alias("descriptions"),
        F.array(pid("DOI", F.concat(F.lit("10.1/"), key)), pid("arXiv", key)).alias("pids"),
        F.array(F.struct(F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("https://h/x.pdf"))).alias("urls"), F.array(pid("doi", F.concat(F.lit("10.2/"), key))).alias("alternateIdentifiers"))).alias("instances"),
    )
    rows = table(spark, sf, "customer").select(F.from_json(F.to_json(item), indexes.PRODUCT).alias("w")).select("w.*")
    return indexes.publication_rows(rows).select("title", "doi", "abstract", "pdf_url")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) || '|x' WHEN 1 THEN lower(c_mktsegment) ELSE 'y' END AS found FROM customer")
def scalar_values(spark, sf):
    """Values of JSON that stands for XML: one or several, bare or wrapped."""
    raw = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('[{\"$\": \" ', lower(c_mktsegment), '\"}, \"x\", \"\"]') WHEN 1 THEN concat('{\"$\": \"', lower(c_mktsegment), '\"}') ELSE 'y' END")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(indexes.scalars(raw), "|").alias("found"))


@query("SELECT p_name AS title, 'Session ' || p_brand AS track FROM part WHERE p_partkey % 5 <> 0 AND length(p_name) >= 8")
def program_sessions(spark, sf):
    """Titles of a conference program under the heading before them; programs that hold too few count for nothing."""
    part = table(spark, sf, "part").where("p_partkey % 5 <> 0")
    lines = part.select(F.col("p_partkey").alias("document"), F.posexplode(F.array(F.lit("x"), F.concat(F.lit("Session "), F.col("p_brand")), F.col("p_name"))).alias("n", "line"))
    poor = table(spark, sf, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("document"), F.lit(0).alias("n"), F.lit("Session only").alias("line"))
    return indexes.program_titles(lines.unionByName(poor), least=1).select("title", "track")


@query(
    """SELECT c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN repeat(c_mktsegment, 12) WHEN c_custkey % 3 = 1 THEN repeat(c_mktsegment, 13) ELSE '' END AS abstract, c_custkey % 2 = 0 AS official,
    c_custkey % 2 <> 0 AND c_custkey % 3 = 2 AS seed_only FROM customer UNION ALL SELECT s_name || ' of the pool', '', true, false FROM supplier"""
)
def composed_venue(spark, sf):
    """A venue put together: a bibliography's titles, the official pool, then abstracts by identity, by title or DOI."""
    cust = table(spark, sf, "customer")
    none = F.lit("")
    seed = cust.select(F.col("c_name").alias("title"), none.alias("abstract"), F.array(F.lit("A B")).alias("authors"), none.alias("url"), none.alias("pdf_url"), F.expr("concat('10.1/', c_custkey)").alias("doi"))
    pool = cust.where("c_custkey % 2 = 0").select(F.upper("c_name").alias("title"), F.lit("https://k").alias("url")).unionByName(table(spark, sf, "supplier").select(F.concat("s_name", F.lit(" of the pool")).alias("title"), F.lit("https://k").alias("url")))
    index = lambda rest, times, doi: cust.where(f"c_custkey % 3 = {rest}").select(F.lower("c_name").alias("title"), F.expr(doi).alias("doi"), F.repeat("c_mktsegment", times).alias("abstract"), F.lit("p").alias("pdf_url"), F.array(F.lit("C B")).alias("authors"))
    out = venues.composed(seed, pool, by_identity=[index(0, 12, "concat('10.1/', c_custkey)")], by_title=[index(1, 13, "''")], by_author=[index(2, 12, "'10.9/other'")])
    return out.select("title", "abstract", F.col("official_title_observed").alias("official"), "seed_only")


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'https://dblp.org/db/conf/kdd/kdd2024-' || c_custkey || '.xml' ELSE 'https://dblp.org/db/conf/kdd/kdd2024b' || c_custkey || '.xml' END AS url FROM customer")
def volume_links(spark, sf):
    """Every volume of a year that a venue's index pages link to."""
    html = F.expr("concat('<a href=\"', CASE WHEN c_custkey % 2 = 0 THEN concat('kdd2024-', c_custkey) ELSE concat('/db/conf/kdd/kdd2024b', c_custkey) END, '.html#x\">v</a><a href=\"index.html\">2024</a><a href=\"kdd2023.html\">2023</a>')")
    index = spread(table(spark, sf, "customer")).select(F.lit("https://dblp.org/db/conf/kdd/index.html").alias("url"), html.alias("html"))
    return venues.volume_links(index, "kdd", 2024)


@query("SELECT c_name || ' a title' AS title, 'https://o/article/view/' || c_custkey AS url, 'Vol 2024 of ' || (c_custkey % 3) AS issue, '10.1234/' || c_custkey AS doi FROM customer")
def archive_articles(spark, sf):
    """Articles of a year's issues in a journal archive, with their details."""
    cust = table(spark, sf, "customer")
    link = lambda i, label: f"<a href='/issue/view/{i}'>{label}</a>"
    chain = [("https://o/archive", 0, "".join(link(i, f"Vol 2024 of {i}") for i in range(2))), ("https://o/archive/2", 1, link(2, "Vol 2024 of 2") + link(9, "Vol 2023")), ("https://o/archive/3", 2, link(8, "Vol 2022"))]
    archive = spark.createDataFrame(chain, "url string, n int, html string")
    article = F.expr("concat('<a href=\"/article/view/', c_custkey, '\">', c_name, ' a title</a>')")
    issues = cust.groupBy((F.col("c_custkey") % 3).alias("i")).agg(F.array_join(F.collect_list(article), "").alias("html")).select(F.expr("concat('https://o/issue/view/', i)").alias("url"), "html")
    detail = cust.select(F.expr("concat('https://o/article/view/', c_custkey)").alias("url"), F.expr("concat('<meta name=\"citation_doi\" content=\"10.1234/', c_custkey, '\">')").alias("html"))
    return venues.archive(archive, issues, detail, 2024).select("title", "url", "issue", F.col("identifiers")["doi"].alias("doi"))


@query(
    """SELECT c_name || ' a title' AS title, 'https://icml.cc/virtual/2024/' || CASE c_custkey % 3 WHEN 0 THEN 'oral' WHEN 1 THEN 'spotlight' ELSE 'poster' END || '/' || c_custkey AS url,
    CASE c_custkey % 3 WHEN 0 THEN 'oral' WHEN 1 THEN 'spotlight' ELSE 'poster' END AS kind, 'Ada|Alan' AS authors, 'https://icml.cc/p' || c_custkey || '.pdf' AS pdf_url, CASE WHEN c_custkey % 2 = 0 THEN repeat(lower(c_mktsegment) || ' ', 12) || 'end' ELSE '' END AS abstract FROM customer"""
)
def conference_catalog(spark, sf):
    """A conference's index joined with its detail pages: kind of presentation, authors, abstract, PDF."""
    cust = table(spark, sf, "customer")
    path = "concat('/virtual/2024/', CASE c_custkey % 3 WHEN 0 THEN 'oral' WHEN 1 THEN 'spotlight' ELSE 'poster' END, '/', c_custkey)"
    index = cust.select(F.lit("https://icml.cc/list").alias("url"), F.expr(f"concat('<a href=\"', {path}, '\">', c_name, ' a title</a><a href=\"/x\">Not a paper at all</a>')").alias("html"))
    text = "CASE WHEN c_custkey % 2 = 0 THEN concat('<div id=\"abstract\">Abstract: ', repeat(concat(lower(c_mktsegment), ' '), 12), 'end</div>') ELSE '' END"
    detail = cust.select(F.expr(f"concat('https://icml.cc', {path})").alias("url"), F.expr(f"concat('<head><meta name=\"citation_author\" content=\"Ada\"><meta name=\"citation_author\" content=\"Alan\"><meta name=\"citation_pdf_url\" content=\"/p', c_custkey, '.pdf\"></head><body>', {text}, '</body>')").alias("html"))
    out = pages.catalog(index, detail, "icml", "ICML", 2024)
    return out.select("title", "url", F.col("presentation_type").alias("kind"), F.array_join("authors", "|").alias("authors"), "pdf_url", "abstract")


@query("SELECT c_name || ' a title' AS title, CASE WHEN c_custkey % 2 = 0 THEN repeat('y', 90) ELSE '' END AS abstract, 'https://chatpaper.com/paper/' || c_custkey AS url, '10.1234/' || c_custkey AS doi FROM customer")
def page_state_rows(spark, sf):
    """Rows that pages carry as a graph of references."""
    cells = F.expr("concat('[{\"title\": 1, \"abstract\": 2, \"id\": 3, \"source_id\": 5}, \"', 1 + c_custkey % 9, '. ', c_name, ' a title\", \"', repeat('y', CASE WHEN c_custkey % 2 = 0 THEN 90 ELSE 10 END), '\", [\"Ref\", 4], ', c_custkey + 1000000, ', \"doi 10.1234/', c_custkey, '\"]')")
    html = F.concat(F.lit('<script id="__NUXT_DATA__">'), cells, F.lit("</script>"))
    out = pages.state_rows(table(spark, sf, "customer").select(html.alias("html")))
    key = F.regexp_extract("url", r"(\d+)$", 1).cast("bigint") - 1000000
    return out.select("title", "abstract", F.concat(F.lit("https://chatpaper.com/paper/"), key.cast("string")).alias("url"), "doi")


@query("SELECT c_custkey, lower(c_mktsegment) AS found, 'w' || c_custkey AS bare FROM customer")
def wrapped_values(spark, sf):
    """Values that may be wrapped."""
    doc = F.to_json(F.struct(F.struct(F.lower("c_mktsegment").alias("value")).alias("a"), F.expr("concat('w', c_custkey)").alias("b")))
    return table(spark, sf, "customer").select("c_custkey", T.clean(files.unwrap(doc, "$.a")).alias("found"), files.unwrap(doc, "$.b").alias("bare"))


@query(
    """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
    s AS (SELECT d.day, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN day(d.day) % 5 = 0 THEN 'invalid' WHEN day(d.day) % 7 = 0 THEN 'stale' ELSE 'ok' END AS status FROM d LEFT JOIN c ON c.day = d.day)
    SELECT CAST(day AS VARCHAR) AS day, status, CASE WHEN status = 'ok' THEN n ELSE 0 END AS papers FROM s"""
)
def scanned_shards(spark, sf):
    """A scan of day shards under the reuse policy: every wanted day with its papers, or why it can't be used."""
    at, events = scratch(spark, "shards"), table(spark, sf, "events")
    of_month = F.dayofmonth("ts")
    for some, version, fetched in ((of_month % 5 == 0, "1", "2024-02-09"), ((of_month % 5 != 0) & (of_month % 7 == 0), "2", "2024-02-01"), ((of_month % 5 != 0) & (of_month % 7 != 0), "2", "2024-02-09")):
        _shards(events.where(some), F.lit("all")).write.format("scholarly").options(path=at, source="arxiv", now=f"{fetched}T00:00:00", schemaVersion=version).mode("append").save()
    options = {"path": at, "source": "arxiv", "start": "2023-12-30", "end": "2024-02-02", "now": "2024-02-10T00:00:00", "daysPerPartition": "10"}
    scan = spark.read.format("scholarly").options(**options).load()
    return scan.groupBy(F.col("day").cast("string").alias("day"), "status").agg(F.count("title").alias("papers"))


def _shards(events: DataFrame, category) -> DataFrame:
    """Events as papers of day shards."""
    events.sparkSession.dataSource.register(scholarly.ScholarlySource)
    ids = F.create_map(F.lit("arxiv_id"), F.col("event_id").cast("string"))
    return events.select(category.alias("category"), F.to_date("ts").alias("day"), F.lit("T").alias("title"), F.lit("A").alias("abstract"), F.array(F.lit("N")).alias("authors"), ids.alias("identifiers"))


@query(
    """WITH RECURSIVE d AS (SELECT event_type AS category, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS i, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2),
    m AS (SELECT 2 * max(n) + 1 AS ceiling FROM d), k AS (SELECT DISTINCT category FROM d),
    r AS (SELECT category, 0 AS a, 30 AS b, (SELECT sum(n) FROM d WHERE d.category = k.category) AS total FROM k
        UNION ALL SELECT category, lo, hi, (SELECT coalesce(sum(n), 0) FROM d WHERE d.category = h.category AND i BETWEEN lo AND hi)
        FROM (SELECT category, CASE WHEN side = 0 THEN a ELSE (a + b) // 2 + 1 END AS lo, CASE WHEN side = 0 THEN (a + b) // 2 ELSE b END AS hi FROM r, (VALUES (0), (1)) s(side), m WHERE total >= ceiling) h)
    SELECT category, CAST(DATE '2024-01-01' + a AS VARCHAR) AS first_day, CAST(DATE '2024-01-01' + b AS VARCHAR) AS last_day, CAST(total AS BIGINT) AS papers FROM r, m WHERE total < ceiling"""
)
def bisected_scan(spark, sf):
    """Ranges of days that a scan reads as one partition each: halved, by the shards' index, until each has few enough rows."""
    at, events = scratch(spark, "bisected"), table(spark, sf, "events").where("ts < TIMESTAMP '2024-02-01'")
    _shards(events, F.col("event_type")).write.format("scholarly").options(path=at, source="arxiv", now="2024-02-09T00:00:00").mode("append").save()
    most = events.groupBy("event_type", F.to_date("ts")).count().agg(F.max("count")).first()[0]
    kinds = ",".join(sorted(r.event_type for r in events.select("event_type").distinct().collect()))  # a handful of categories
    options = {"path": at, "source": "arxiv", "categories": kinds, "start": "2024-01-01", "end": "2024-01-31", "now": "2024-02-10T00:00:00", "ceiling": str(2 * most + 1)}
    scan = spark.read.format("scholarly").options(**options).load()
    ranges = scan.groupBy(F.spark_partition_id().alias("range"), "category").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count("title").alias("papers"))
    return ranges.drop("range")


@query(
    """SELECT event_type AS category, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS papers FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND event_type IN ('click', 'error') GROUP BY 1, 2"""
)
def narrowed_scan(spark, sf):
    """A scan whose filters on day, category and status leave shards unopened."""
    at, events = scratch(spark, "narrowed"), table(spark, sf, "events")
    _shards(events, F.col("event_type")).write.format("scholarly").options(path=at, source="arxiv", now="2024-02-09T00:00:00").mode("append").save()
    kinds = ",".join(sorted(r.event_type for r in events.select("event_type").distinct().collect()))  # a handful of categories
    with pushed_filters(spark):
        scan = scholarly.scan(spark, path=at, source="arxiv", categories=kinds, start="2023-12-01", end="2024-03-01", now="2024-02-10T00:00:00")
        rows = scan.where((F.col("day") >= F.lit("2024-01-05").cast("date")) & (F.col("day") < F.lit("2024-01-12").cast("date")) & F.col("category").isin("click", "error") & (F.col("status") == "ok"))
        return checkpointed(rows.groupBy("category", F.col("day").cast("string").alias("day")).agg(F.count("title").alias("papers")))


@query(
    """WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, day(CAST(ts AS DATE)) % 2 = 0 AS late FROM events GROUP BY 1, 3)
    SELECT 'only' AS policy, day, 'ok' AS status, n AS papers FROM d UNION ALL SELECT 'refresh', day, CASE WHEN late THEN 'ok' ELSE 'stale' END, CASE WHEN late THEN n ELSE 0 END FROM d"""
)
def policy_scans(spark, sf):
    """Scans under the policies that take every closed shard, or none that is older than now."""
    at, events = scratch(spark, "policies"), table(spark, sf, "events")
    for even, fetched in ((True, "2024-02-10"), (False, "2024-02-01")):
        _shards(events.where((F.dayofmonth("ts") % 2 == 0) == even), F.lit("all")).write.format("scholarly").options(path=at, source="arxiv", now=f"{fetched}T00:00:00").mode("append").save()
    first, last = events.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    out = None
    for policy in ("only", "refresh"):
        scan = spark.read.format("scholarly").options(path=at, source="arxiv", policy=policy, start=str(first), end=str(last), now="2024-02-10T00:00:00").load()
        one = scan.groupBy(F.col("day").cast("string").alias("day"), "status").agg(F.count("title").alias("papers")).select(F.lit(policy).alias("policy"), "day", "status", "papers")
        out = one if out is None else out.unionByName(one)
    return out


_MADE = """'A difficult offer of the office of ' || c_name || ', first in all'"""


@query(
    f"""SELECT c_custkey AS k, 'ok' AS status, 2 AS n_pages, {_MADE} || chr(10) || 'left (' || c_custkey || ') flat' || chr(10) || 'the affair ends' || chr(10) || 'left \\ three' || chr(10) || c_name || chr(10) || 'right two' || chr(10) || 'café'
    || chr(10) || chr(10) || 'Page two of ' || lower(c_mktsegment) || chr(10) || 'one column only' || chr(10) || 'and its end' AS text FROM customer"""
)
def pdf_texts(spark, sf):
    """Text of PDF files of two pages, with a heading over two columns, ligatures, one-byte and composite fonts, classic and
    packed cross references, form XObjects; all compressed."""
    made = _MADE.replace("||", ",").strip()
    one = F.struct(F.array(F.expr(f"concat({made})")).alias("head"), F.expr("array(concat('left (', c_custkey, ') flat'), 'the affair ends', 'left \\\\ three')").alias("left"), F.expr("array(c_name, 'right two', 'café')").alias("right"))
    two = F.struct(F.expr("array(concat('Page two of ', lower(c_mktsegment)))").alias("head"), F.expr("array('one column only', 'and its end')").alias("left"), F.expr("cast(array() as array<string>)").alias("right"))
    files = spread(table(spark, sf, "customer")).select(F.col("c_custkey").alias("path"), pdf_made.of_lines(F.array(one, two), F.col("c_custkey") % 3).alias("content"))
    return pdf.texts(files).select(F.col("path").alias("k"), "status", "n_pages", "text")


@query("SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'not_pdf' WHEN 1 THEN 'repaired' WHEN 2 THEN 'damaged' WHEN 3 THEN 'encrypted' ELSE 'ok' END AS status, c_custkey % 5 IN (1, 4) AS whole FROM customer")
def pdf_statuses(spark, sf):
    """What becomes of files that are cut off, damaged, encrypted, or none."""
    text = "repeat(concat('line of ', c_name, ' '), 9)"
    page = F.struct(F.array(F.expr("c_name")).alias("head"), F.expr(f"array({text})").alias("left"), F.expr("cast(array() as array<string>)").alias("right"))
    made = pdf_made.of_lines(F.array(page), F.lit(0))
    said = F.decode(made, "ISO-8859-1")
    # a byte in the middle of the compressed content is another one
    content = F.regexp_replace(said, r"(?s)(/Filter /FlateDecode  >>\nstream\n.{60}).{4}", "$1    ")
    cases = F.when(F.col("k") % 5 == 0, F.substring(said, 9, 999)).when(F.col("k") % 5 == 1, F.regexp_replace(said, "startxref", "startxxxx")).when(F.col("k") % 5 == 2, content).when(F.col("k") % 5 == 3, F.replace(said, F.lit("/Root"), F.lit("/Encrypt << /V 1 >> /Root"))).otherwise(said)
    files = spread(table(spark, sf, "customer")).withColumn("k", F.col("c_custkey")).select(F.col("k").alias("path"), "c_name", F.expr(text).alias("want"), F.encode(cases, "ISO-8859-1").alias("content"))
    known = F.struct("path", F.concat("c_name", F.lit("\n"), F.trim("want")).alias("want"))  # goes along with its file
    return pdf.texts(files.select(known.alias("path"), "content")).select(F.col("path.path").alias("k"), "status", (F.col("text") == F.col("path.want")).alias("whole"))


#: Part numbers to a volume of a program.
VOLUME = 5000


@query(
    """SELECT p_brand AS program, 'The ' || p_name || ' study ' || p_partkey AS title, CASE WHEN p_partkey % 3 = 0 THEN 'Short' ELSE 'Full' END AS track, 'Ada L|Alan T' AS authors,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'We describe how parts of one kind are told apart from other parts ' || p_partkey || ' and show that it holds for many kinds of parts in practice.' END AS abstract
    FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1 HAVING count(*) >= 5) AND p_partkey % 11 <> 0"""
)
def program_papers(spark, sf):
    """Papers of conference programs, PDF files of two columns: title with its track, authors over two lines, abstract.

    A program is printed in volumes, each with the papers of so many numbers: files don't grow with the table, their number does.
    """
    part = table(spark, sf, "part").where("p_partkey % 11 <> 0")
    lines = F.expr(
        """transform(papers, p -> array(concat('The ', p.p_name, ' study'), concat(p.p_partkey, CASE WHEN p.p_partkey % 3 = 0 THEN ' [Short]' ELSE ' [Full]' END), '', 'Ada L (Some University (Home));', 'Alan T (Other Place)', '',
        CASE WHEN p.p_partkey % 4 = 0 THEN 'No abstract.' ELSE 'We describe how parts of one kind are told' END, CASE WHEN p.p_partkey % 4 = 0 THEN 'Program' ELSE concat('apart from other parts ', p.p_partkey) END,
        CASE WHEN p.p_partkey % 4 = 0 THEN '12' ELSE 'and show that it holds' END, CASE WHEN p.p_partkey % 4 = 0 THEN '' ELSE 'for many kinds of parts in practice.' END, 'Room 1 · Hall A · Monday 9:00', 'left out', ''))"""
    )
    volume = F.floor(F.col("p_partkey") / VOLUME).alias("volume")
    volumes = part.groupBy("p_brand", volume).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("papers"))
    # a page for two papers: one in each column
    pair = lambda i: F.struct(F.array(F.lit("")).alias("head"), F.get("lines", i * 2).alias("left"), F.coalesce(F.get("lines", i * 2 + 1), F.array().cast("array<string>")).alias("right"))
    pages = F.transform(F.sequence(F.lit(0), ((F.size("lines") - 1) / 2).cast("int")), pair)
    files = spread(volumes).withColumn("lines", lines).select(F.struct("p_brand", "volume").alias("path"), pdf_made.of_lines(pages, F.length("p_brand") % 3).alias("content"))
    with conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "16"):  # volumes that are made together
        out = indexes.program_papers(pdf.paragraphs(files).withColumn("document", F.col("path.p_brand")), least=5)
    return out.select(F.col("document").alias("program"), "title", "track", F.array_join("authors", "|").alias("authors"), "abstract")


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS channel, count(*) AS titles FROM customer WHERE c_custkey % 8 = {i}" for i, c in enumerate(pages.INDEX_LINKS))
)
def index_links(spark, sf):
    """Titles that the index pages of eight kinds of venues link to."""
    links = ["/paper_files/paper/2023/hash/a{}", "/virtual/2024/poster/{}", "/virtual/2024/oral/{}", "/content/CVPR/html/{}.html", "/content/ICCV/html/{}.html", "/article/view/{}", "/proceedings/2024/{}", "/doi/10.1145/{}"]
    out = None
    for i, (channel, pattern) in enumerate(pages.INDEX_LINKS.items()):
        before, after = links[i].split("{}")
        html = F.concat(F.lit(f'<a href="{before}'), F.col("c_custkey").cast("string"), F.lit(f'{after}">'), F.col("c_name"), F.lit(' one</a><a href="/about">About this conference</a>'))
        rows = table(spark, sf, "customer").where(f"c_custkey % 8 = {i}").select(F.lit("https://v.org/").alias("url"), html.alias("html"))
        found = pages.index(rows, pattern).agg(F.count(F.lit(1)).alias("titles")).select(F.lit(channel).alias("channel"), "titles")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT c_custkey % 2 AS source, count(*) AS n FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1 UNION ALL SELECT 2, count(*) FROM supplier")
def first_sources(spark, sf):
    """The first source that has rows; a proceedings page counts only if every row of it is valid."""
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    odd = cust.where("k % 2 = 1")
    one = indexes.first_with_rows(cust.limit(0), odd, cust).agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("source"), "n")
    pool = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    two = venues.from_first(cust, F.col("k") > 0, pool).agg(F.count(F.lit(1)).alias("n")).select(F.lit(2).alias("source"), "n")
    return one.unionByName(two)


@query("SELECT c_name || ' accepted' AS title, 'https://k.org/p/' || c_custkey AS url FROM customer")
def title_pools(spark, sf):
    """An official list of accepted titles, each once; a list with too few is none."""
    html = F.expr("concat('<ul><li><a href=\"/p/', c_custkey, '\">', c_name, ' accepted</a></li><li><a href=\"/p/x\">', upper(c_name), ' Accepted.</a></li><a href=\"/about\">About this list</a></ul>')")
    index = spread(table(spark, sf, "customer")).select(F.lit("https://k.org/list").alias("url"), html.alias("html"))
    poor = table(spark, sf, "supplier").select(F.lit("https://k.org/other").alias("url"), F.expr("concat('<a href=\"/q/', s_suppkey, '\">', s_name, ' accepted</a>')").alias("html"))
    every = index.unionByName(poor)
    return venues.title_pool(every, venues.TitlePool("/p/")).unionByName(venues.title_pool(every, venues.TitlePool("/q/", least=1 << 30)))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ada L|Alan T' WHEN 1 THEN 'Grace H' WHEN 2 THEN 'Kurt G|Emmy N' ELSE 'Org A|Org B' END AS authors FROM customer"""
)
def page_authors(spark, sf):
    """Authors of pages: cited, from a creator field, from structured data, or the organizers' line."""
    html = F.expr(
        """CASE c_custkey % 4 WHEN 0 THEN '<meta name="citation_author" content="Ada L"><meta name="citation_author" content=" Alan  T"><meta name="author" content="No One">'
        WHEN 1 THEN '<meta name="dc.creator" content="Grace H;">' WHEN 2 THEN '<script type="application/ld+json">[{"@type": "Article", "author": [{"name": "Kurt G"}, "Emmy  N"]}]</script>'
        ELSE '<p class="event-organizers">Org A &sdot; Org B</p>' END"""
    )
    return table(spark, sf, "customer").select("c_custkey", F.array_join(pages.authors(pages.parsed(html)), "|").alias("authors"))


@query("SELECT 'https://aclanthology.org/2024.emnlp-main.' || p_partkey || '/' AS url FROM part UNION ALL SELECT 'https://aclanthology.org/2024.emnlp-findings.' || p_partkey || '/' FROM part WHERE p_partkey % 2 = 0")
def findings_union(spark, sf):
    """Main volumes and the findings volume of one conference, each paper once."""
    document = "concat('<paper id=\"', p_partkey, '\"><title>', p_name, '</title></paper>')"
    part = table(spark, sf, "part")
    main = files.anthology_rows(_xml(part, document, files.ANTHOLOGY), "EMNLP", 2024)
    findings = files.anthology_rows(_xml(part.where("p_partkey % 2 = 0"), document, files.ANTHOLOGY), "EMNLP", 2024, "findings")
    return main.unionByName(main).unionByName(findings).dropDuplicates(["url"]).select("url")


@query("SELECT c_custkey AS k, c_name AS name FROM customer")
def json_documents(spark, sf):
    """One document a file; a path that isn't there gives no row."""
    at = scratch(spark, "documents")
    rows = table(spark, sf, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))).alias("value"))
    for f in range(4):  # documents, each a list
        some = rows.where(F.pmod(F.xxhash64("value"), F.lit(4)) == f)
        some.agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n "), F.lit("]")).alias("value")).write.text(f"{at}/there/{f}")
    kind = "k bigint, name string"
    return files.json_document(spark, f"{at}/there/*", kind).unionByName(files.json_document(spark, f"{at}/none", kind))
