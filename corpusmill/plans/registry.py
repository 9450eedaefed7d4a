"""Every query of the library, by name, with the SQL that gives the same rows on the same tables.

The driver tables stand in for the scholarly ones: documents for papers (text: abstract, source: venue),
labels for scores, events for requests and attempts, pages for catalog pages, conversations for versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import audit, dedup, enrich, fulltext, overlap, records, runs, sample, score, shards
from corpusmill.plans import queries_records, queries_sources, queries_state, queries_text  # noqa: F401  they register themselves
from corpusmill.plans.catalog import ORACLE_SQL, QUERIES, REAL, query  # noqa: F401
from corpusmill.session import table
from corpusmill.sources import files, pages

FLAGSHIP = "shortlist_topk"


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    """documents as papers: the key of the whole text is the identity."""
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        F.sha2(T.title_key(F.col("text")), 256).alias("identity"),
        F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("abstract"),
        F.array("lang").alias("authors"),
        F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("lang") == "en", F.concat(F.lit("https://"), "source", F.lit(".pdf"))).alias("pdf_url"),
        F.col("source").alias("venue"),
        F.array("lang").alias("categories"),
        "lang",
        F.lit(0).alias("_source_index"),
        F.col("doc_id").alias("_source_pos"),
    )


PAPERS = """
    p AS (SELECT doc_id, sha256(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[^a-z0-9]+', '', 'g')) AS identity,
        string_split(text, chr(10))[1] AS title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract, lang, source AS venue FROM documents)
"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """labels as external scores: components from quality and toxicity."""
    rows = table(spark, sf, "labels")
    parts = F.struct((F.col("quality") * 40.0 + F.col("doc_id") % 10).alias("topic_fit"), (30.0 - F.col("toxic") * 20).alias("transferability_potential"), (F.col("doc_id") % 20).cast("double").alias("abstract_specificity"))
    return rows.select("doc_id", parts.alias("components"), (F.col("quality") * 40.0 + F.col("doc_id") % 10 + 30 - F.col("toxic") * 20 + F.col("doc_id") % 20).alias("metadata_score"), F.lit("scored").alias("reason"), F.lit("low").alias("uncertainty"))


SCORES = "s AS (SELECT doc_id, quality * 40.0 + doc_id % 10 + 30 - toxic * 20 + doc_id % 20 AS metadata_score FROM labels)"


@query(
    f"""WITH {PAPERS}, {SCORES},
    w AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY length(abstract) DESC, doc_id) AS rn FROM p),
    j AS (SELECT doc_id, identity, venue, metadata_score FROM w JOIN s USING (doc_id) WHERE rn = 1)
    SELECT doc_id, identity, venue, CAST(metadata_score AS DOUBLE) AS metadata_score, row_number() OVER (ORDER BY metadata_score DESC, identity) AS rank FROM j QUALIFY rank <= 100"""
)
def shortlist_topk(spark, sf):
    """Deduplicate, join scores, rank, keep the target number."""
    best = dedup.keep_longest_abstract(_papers(spark, sf))
    return score.shortlist(best.select("doc_id", "identity", "venue"), _scores(spark, sf), 100, on="doc_id").select("doc_id", "identity", "venue", "metadata_score", "rank")


@query(
    f"""WITH {PAPERS}, w AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY length(abstract) DESC, doc_id) AS rn, min(doc_id) OVER (PARTITION BY identity) AS first_pos FROM p)
    SELECT identity, doc_id, length(abstract) AS n, first_pos FROM w WHERE rn = 1"""
)
def dedup_keep_longest(spark, sf):
    out = dedup.keep_longest_abstract(_papers(spark, sf))
    return out.select("identity", "doc_id", F.length(T.clean(F.col("abstract"))).cast("bigint").alias("n"), F.col("first_position._source_pos").alias("first_pos"))


@query(
    """WITH n AS (SELECT doc_id, source, regexp_replace(text, '\\s+', '', 'g') AS norm FROM documents),
    g AS (SELECT norm FROM n WHERE length(norm) >= 120 GROUP BY norm HAVING min(doc_id) <> max(doc_id))
    SELECT doc_id AS identity, 'text' AS section FROM n JOIN g USING (norm)"""
)
def exact_duplicate_groups(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("identity"), F.lit("text").alias("section"), F.col("text").alias("body"))
    return dedup.duplicate_sections(docs)


@query(
    """SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) DESC) AS rn FROM conversations) WHERE rn = 1"""
)
def latest_turn_per_conversation(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("identity"), F.col("turn").cast("string").alias("version"), "turn", "role", F.col("text").alias("abstract"), F.lit(None).cast("date").alias("published"), F.lit(0).alias("_source_index"), F.col("turn").alias("_source_pos"))
    return dedup.latest_version(turns).select(F.col("identity").alias("conv_id"), "turn", "role", F.length("abstract").cast("bigint").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_tax) = 1"""
)
def order_line_dedup(spark, sf):
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")]]
    return dedup.keep_best(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    """WITH r AS (SELECT l_partkey AS identity, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sold FROM lineitem GROUP BY 1)
    SELECT identity, p_brand, sold, row_number() OVER (ORDER BY sold DESC, identity) AS rank FROM r JOIN part ON p_partkey = identity QUALIFY rank <= 20"""
)
def final_topk(spark, sf):
    sold = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("identity")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sold"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("identity"), "p_brand")
    return score.ranked(sold.join(parts, "identity"), "sold", 20).select("identity", "p_brand", "sold", "rank")


@query("SELECT doc_id AS identity FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unscored_documents(spark, sf):
    """Papers that still lack a score."""
    found = score.score_violations(_scores(spark, sf).withColumnRenamed("doc_id", "identity"), table(spark, sf, "documents").select(F.col("doc_id").alias("identity")))
    return found.where("violation = 'missing_identity'").select("identity")


@query("SELECT doc_id AS identity, 'foreign_identity' AS violation FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'duplicate_identity' FROM labels WHERE doc_id % 4 = 0")
def foreign_scores(spark, sf):
    """Scores of papers that nobody asked for, and papers scored twice."""
    scores = _scores(spark, sf).withColumnRenamed("doc_id", "identity")
    papers = table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("identity"))
    found = score.score_violations(scores.unionByName(scores.where("identity % 4 = 0")), papers)
    return found.where("violation IN ('foreign_identity', 'duplicate_identity')").distinct()


@query(
    f"""WITH {SCORES}, b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN metadata_score + 0.5 ELSE metadata_score END AS m FROM s),
    v AS (SELECT doc_id, 'sum_differs' AS violation FROM b WHERE doc_id % 7 = 0 AND m BETWEEN 0 AND 100
        UNION ALL SELECT doc_id, 'declared_out_of_bounds' FROM b WHERE m > 100
        UNION ALL SELECT doc_id, 'missing_identity' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    SELECT doc_id AS identity, violation FROM v"""
)
def score_violations(spark, sf):
    """External scores with every seventh sum off by a half."""
    scores = _scores(spark, sf).withColumnRenamed("doc_id", "identity")
    broken = scores.withColumn("metadata_score", F.when(F.col("identity") % 7 == 0, F.col("metadata_score") + 0.5).otherwise(F.col("metadata_score")))
    return score.score_violations(broken, table(spark, sf, "documents").select(F.col("doc_id").alias("identity")))


def _gappy(spark, sf):
    """papers of which some lack a title, authors or a link."""
    papers, key = _papers(spark, sf), F.col("doc_id")
    return papers.withColumns(
        {
            "title": F.when(key % 10 != 0, F.col("title")),
            "authors": F.when(key % 7 != 0, F.col("authors")).otherwise(F.array().cast("array<string>")),
            "url": F.when(key % 4 == 0, F.lit(" ")).otherwise(F.col("url")),
            "categories": F.when(key % 9 != 0, F.col("categories")),
        }
    )


SOME = {"title": "doc_id % 10 <> 0 AND trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g')) <> ''", "authors": "doc_id % 7 <> 0", "abstract": "trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''", "url": "doc_id % 4 <> 0", "pdf_url": "lang = 'en'"}
COVERAGE = "SELECT source AS venue, count(*) AS record_count, " + ", ".join(f"count(*) FILTER ({c}) AS {f}_count, round(count(*) FILTER ({c}) / count(*), 6) AS {f}_coverage" for f, c in SOME.items()) + " FROM documents GROUP BY source"


@query(COVERAGE)
def field_coverage(spark, sf):
    return audit.field_coverage(_gappy(spark, sf), ["venue"])


@query(
    f"WITH c AS ({COVERAGE}) "
    + " UNION ALL ".join(f"SELECT venue, record_count, '{f}' AS field, {f}_count AS present_count, {f}_coverage AS coverage, record_count - {f}_count AS missing_count, '{f}_incomplete' AS kind FROM c WHERE {f}_count < record_count" for f in ("authors", "abstract", "pdf_url"))
)
def coverage_notices(spark, sf):
    return audit.coverage_notices(audit.field_coverage(_gappy(spark, sf), ["venue"]), ["venue"])


@query(
    f"""WITH {PAPERS}, a AS (SELECT venue, count(*) AS n, count(DISTINCT identity) AS u, count(*) FILTER ({REAL}) AS r, count(*) FILTER ({SOME['title'].replace('text', 'raw_text')}) AS t, count(*) FILTER (doc_id % 7 <> 0) AS w,
        count(*) FILTER (doc_id % 4 <> 0 OR lang = 'en') AS l, count(*) FILTER (doc_id % 9 <> 0) AS c FROM p JOIN (SELECT doc_id, text AS raw_text FROM documents) USING (doc_id) GROUP BY venue)
    SELECT venue, n AS record_count, u AS unique_identity_count, n - u AS duplicate_count, round(t / n, 6) AS title_coverage, round(w / n, 6) AS author_coverage, round(l / n, 6) AS link_coverage,
    round(r / n, 6) AS abstract_coverage, n - r AS invalid_abstract_count, round(c / n, 6) AS category_coverage, (u = n AND r = n AND t = n AND c = n AND w >= 0.95 * n AND l >= 0.95 * n) AS metadata_completeness_ok FROM a"""
)
def catalog_audit(spark, sf):
    return audit.venue_audit(_gappy(spark, sf), ["venue"], require_categories=True)


@query(f"WITH {PAPERS} SELECT doc_id, {REAL} AS is_real FROM p")
def real_abstract_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.abstract_is_real(F.col("text")).alias("is_real"))


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1:' || doc_id), doc_id) AS draw FROM documents QUALIFY draw <= 5")
def stratified_sample(spark, sf):
    return sample.stratified_sample(table(spark, sf, "documents"), ["lang"], 5, "s1", "doc_id").select("lang", "doc_id", F.col("draw").cast("bigint").alias("draw"))


@query(
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1:' || doc_id), doc_id) AS draw FROM documents),
    attempted AS (SELECT doc_id, lang FROM d WHERE draw <= 5), ready AS (SELECT doc_id, lang FROM d WHERE draw <= 3),
    fresh AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1:2:' || lang || ':' || doc_id), doc_id) AS draw FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM attempted))
    SELECT doc_id, lang, 'kept' AS origin FROM ready UNION ALL SELECT doc_id, lang, 'replacement' FROM fresh WHERE draw <= 2"""
)
def replacement_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    drawn = sample.stratified_sample(docs, ["lang"], 5, "s1", "doc_id")
    return sample.replacement_sample(docs, drawn.where("draw <= 3"), drawn, ["lang"], 5, "s1", 2, "doc_id").select("doc_id", "lang", "origin")


@query("SELECT lang, count(*) AS population, least(count(*), 5) AS sampled FROM documents GROUP BY lang")
def strata_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sample.strata_counts(docs, sample.stratified_sample(docs, ["lang"], 5, "s1", "doc_id"), ["lang"])


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position, CAST(ntile(3) OVER (ORDER BY doc_id) AS INT) AS batch FROM documents")
def three_batches(spark, sf):
    return sample.balanced_batches(table(spark, sf, "documents").select("doc_id"), [F.col("doc_id")])


STOPS = ", ".join(f"'{w}'" for w in T.TITLE_STOPS)


@query(
    f"""WITH t AS (SELECT p_partkey, list_distinct(list_filter(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda w: length(w) >= 2 AND NOT list_contains([{STOPS}], w))) AS a,
        list_distinct(list_filter(list_transform(regexp_extract_all(p_type || ' ' || p_name, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda w: length(w) >= 2 AND NOT list_contains([{STOPS}], w))) AS b FROM part)
    SELECT p_partkey, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS similarity FROM t"""
)
def token_jaccard(spark, sf):
    a, b = T.title_tokens(F.col("p_name")), T.title_tokens(F.concat_ws(" ", "p_type", "p_name"))
    return table(spark, sf, "part").select("p_partkey", F.round(T.jaccard(a, b), 9).alias("similarity"))


GRAMS = "SELECT {id}, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT {id}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {id}, list_transform(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*'), lambda x: lower(x)) AS w FROM {t}) WHERE len(w) >= 10)"


@query(f"WITH d AS ({GRAMS.format(id='doc_id', t='documents')}), b AS ({GRAMS.format(id='item_id', t='benchmark')}) SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (g)")
def shared_10gram_contamination(spark, sf):
    """Documents that share a run of ten English words with a benchmark item."""
    return overlap.shared_runs(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"), "doc_id", "item_id")


AS_OF = "2024-01-20"


@query(
    f"""WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS row_count FROM events GROUP BY 1, 2), t AS (SELECT DISTINCT event_type FROM events),
    d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT CAST(d.day AS VARCHAR) AS day, t.event_type, coalesce(row_count, 0) AS row_count, d.day < DATE '{AS_OF}' AS complete, d.day >= DATE '{AS_OF}' AS provisional, CASE WHEN d.day < DATE '{AS_OF}' THEN 'closed' ELSE 'provisional' END AS temporal_status
    FROM d CROSS JOIN t LEFT JOIN c ON c.day = d.day AND c.event_type = t.event_type"""
)
def day_shards(spark, sf):
    """A manifest row for every day and type, empty days too, closed or provisional."""
    rows = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type")
    every = F.explode(F.expr("sequence(DATE'2023-12-30', DATE'2024-02-02', INTERVAL 1 DAY)"))
    wanted = rows.select("event_type").distinct().select(every.alias("day"), "event_type")
    return shards.manifest_of(rows, wanted, F.lit(AS_OF).cast("date"), ["day", "event_type"]).withColumn("day", F.col("day").cast("string"))


@query(
    """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-15', DATE '2024-02-15', INTERVAL 1 DAY)) AS DATE) AS day), m AS (SELECT day FROM d WHERE day NOT IN (SELECT CAST(ts AS DATE) FROM events))
    SELECT strftime(day, '%Y-%m') AS month, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS n_days FROM m GROUP BY 1"""
)
def missing_days(spark, sf):
    present = table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    return shards.month_chunks(shards.missing_days(shards.day_range(spark, "2023-12-15", "2024-02-15"), present, ["day"])).select("month", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n_days")


@query(
    f"""WITH m AS (SELECT CAST(ts AS DATE) AS date, count(*) AS row_count, max(ts) AS fetched_at FROM events GROUP BY 1)
    SELECT CAST(date AS VARCHAR) AS date, row_count FROM m WHERE date < DATE '{AS_OF}' AND (DATE '{AS_OF}' - date > 3 OR epoch(TIMESTAMP '{AS_OF} 06:00:00') - floor(epoch(fetched_at)) <= 86400)"""
)
def late_recheck_window(spark, sf):
    """Shards that need no new reading: old closed days never, the last three for a day."""
    m = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("row_count"), F.max("ts").cast("timestamp").alias("fetched_at"))
    as_of = F.lit(AS_OF).cast("date")
    m = shards.with_status(m.withColumns({"source": F.lit("biorxiv"), "schema_version": F.lit(2), "exhaustion_proof": F.lit("cursor"), "server_total": F.col("row_count")}), as_of, "date")
    return shards.usable(m, "biorxiv", as_of, F.lit(f"{AS_OF} 06:00:00").cast("timestamp")).select(F.col("date").cast("string").alias("date"), "row_count")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days FROM orders GROUP BY 1")
def month_chunks(spark, sf):
    return shards.month_chunks(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()).select("month", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n_days")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-02-28' AND DATE '1997-08-31'")
def trailing_six_months(spark, sf):
    as_of, day = F.lit("1997-08-31").cast("date"), F.to_date("o_orderdate")
    return table(spark, sf, "orders").where(day.between(shards.months_back(as_of), as_of)).select("o_orderkey", day.cast("string").alias("day"))


def _items(spark, sf):
    """events as acquisition items with one attempt each."""
    code = F.when(F.col("event_id") % 11 == 0, 429).when(F.col("event_id") % 13 == 0, 403).when(F.col("event_id") % 3 == 0, 404).otherwise(200)
    a = F.struct(F.col("event_type").alias("kind"), F.lit("https://export.arxiv.org/pdf/1").alias("url"), code.cast("int").alias("status_code"), (code == 200).alias("accepted"), F.when(code == 404, "not_found").alias("reason"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("message"))
    return table(spark, sf, "events").select(F.col("event_id").alias("identity"), F.concat(F.lit("v"), (F.col("user_id") % 5).cast("string")).alias("venue"), F.create_map(F.lit("pdf"), F.array(a)).alias("attempts"), (code == 200).alias("full_text_available"), F.when(code != 200, "missing").alias("status"))


CODES = "i AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 429 WHEN event_id % 13 = 0 THEN 403 WHEN event_id % 3 = 0 THEN 404 ELSE 200 END AS code FROM events)"


@query(f"WITH {CODES} SELECT event_type || ':' || CASE code WHEN 404 THEN 'not_found' ELSE CAST(code AS VARCHAR) END AS failure_step, count(*) AS count FROM i WHERE code <> 200 GROUP BY 1 UNION ALL SELECT 'item:missing', count(*) FROM i WHERE code <> 200")
def failure_histogram(spark, sf):
    return fulltext.failure_histogram(_items(spark, sf))


@query(f"WITH {CODES} SELECT 'v' || (user_id % 5) AS venue, count(*) AS count FROM i WHERE code <> 200 GROUP BY 1")
def unavailable_by_venue(spark, sf):
    return fulltext.unavailable_by_venue(_items(spark, sf))


@query(f"WITH {CODES} SELECT count(*) AS requested_count, count(*) FILTER (code = 200) AS ready_count, count(*) FILTER (code <> 200) AS unavailable_count FROM i")
def round_summary(spark, sf):
    return fulltext.round_summary(_items(spark, sf))


@query(
    f"""WITH {CODES} SELECT event_id AS identity, code IN (429, 403) AS retryable_after_cooldown, CASE WHEN code IN (429, 403) THEN 'arxiv' ELSE '' END AS services,
    CASE code WHEN 429 THEN 'http_429_rate_limited' WHEN 403 THEN 'http_403_access_challenge' ELSE '' END AS why FROM i"""
)
def transient_failures(spark, sf):
    out = fulltext.transient(_items(spark, sf))
    return out.select("identity", "retryable_after_cooldown", F.array_join("cooldown_services", ",").alias("services"), F.array_join("reasons", ",").alias("why"))


@query("SELECT event_id, count(*) OVER w AS in_last_hour, count(*) OVER w <= 3 AS within_quota FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)")
def hourly_quota(spark, sf):
    return runs.rolling_quota(table(spark, sf, "events"), ["user_id"], "ts", 3).select("event_id", "in_last_hour", "within_quota")


@query(
    """WITH pool AS (SELECT regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS k, c_name AS title, c_mktsegment AS abstract FROM customer),
    prim AS (SELECT s_suppkey, 'Customer#' || lpad(CAST(s_suppkey * 2 AS VARCHAR), 9, '0') AS title, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS abstract FROM supplier),
    l AS (SELECT s_suppkey, prim.title, CASE WHEN prim.abstract <> '' THEN prim.abstract ELSE coalesce(pool.abstract, prim.abstract) END AS abstract, pool.title IS NOT NULL AS official_title_observed FROM prim LEFT JOIN pool ON k = regexp_replace(lower(prim.title), '[^a-z0-9]+', '', 'g'))
    SELECT * FROM l UNION ALL SELECT -1, title, abstract, true FROM pool WHERE k NOT IN (SELECT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') FROM prim)"""
)
def fill_missing_title_join(spark, sf):
    """Rows enriched by an official title pool; titles that only the pool has follow."""
    pool = table(spark, sf, "customer").select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("abstract"))
    title = F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 2).cast("string"), 9, "0"))
    primary = table(spark, sf, "supplier").select("s_suppkey", title.alias("title"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("abstract"))
    return enrich.merge_titles(primary, pool).fillna(-1, ["s_suppkey"])


@query(
    f"""WITH {PAPERS}, w AS (SELECT *, CASE WHEN venue IN ('src0', 'src1') THEN 0 ELSE 1 END AS si FROM p)
    SELECT identity, doc_id, si AS source_index FROM w QUALIFY row_number() OVER (PARTITION BY identity ORDER BY length(abstract) DESC, si, doc_id) = 1"""
)
def source_union_dedup(spark, sf):
    papers = _papers(spark, sf).drop("_source_index")
    both = dedup.union_sources([papers.where("venue IN ('src0', 'src1')"), papers.where("venue NOT IN ('src0', 'src1')")])
    return dedup.keep_longest_abstract(both).select("identity", "doc_id", F.col("_source_index").alias("source_index"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS fp, sha256(text) AS text_sha256 FROM documents""")
def content_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("doc_id"), F.col("lang"), F.col("source")).alias("fp"), F.sha2("text", 256).alias("text_sha256"))


@query(
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang FROM pages)
    SELECT page_id, host, 'host-' || host AS service, CASE lang WHEN 'en' THEN 'neurips' WHEN 'fr' THEN 'kdd' WHEN 'de' THEN 'icml' WHEN 'es' THEN 'acl' END AS channel FROM h"""
)
def channel_routing(spark, sf):
    """Host, service and channel of links; the page's language stands in for names that aliases, prefixes and markers route."""
    url = F.col("url")
    lang = F.regexp_extract(url, "/(en|fr|de|es)/", 1)
    name = F.when(lang == "en", "NIPS").when(lang == "fr", "SIG-KDD").when(lang == "de", "ICML 2024")
    link = F.when(lang == "es", "https://aclanthology.org/1")
    return table(spark, sf, "pages").select("page_id", records.url_host(url).alias("host"), records.service(url).alias("service"), records.channel([name], [link]).alias("channel"))


@query()
def html_main_text(spark, sf):
    """Running text of each page as the full-text reader sees it."""
    text = pages.main_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", text.alias("text")).withColumn("accepted", fulltext.html_accepted(F.col("text")))


@query()
def page_details(spark, sf):
    """Links, abstract, authors and DOI of pages."""
    return pages.details(table(spark, sf, "pages").select("url", "html"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    """Objects within objects, line by line."""
    line = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.col("props"), F.lit("}"))
    return files.jsonl_rows(table(spark, sf, "events").select(line.alias("value")), "event_id bigint, props struct<k: bigint>").select("event_id", "props.k")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE contains(lower('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}'), 'tion_1')")
def catalog_search(spark, sf):
    return files.search_catalog(table(spark, sf, "nation"), "TION_1")


@query("SELECT doc_id, sha256(array_to_string(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> ''), ' ')) AS text_sha256 FROM documents")
def inverted_index_roundtrip(spark, sf):
    """Text to a map of positions by word, and back."""
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    index = T.inverted_index(table(spark, sf, "documents").select("doc_id", "text"), words)
    return index.select("doc_id", F.sha2(T.from_inverted_index(F.col("index")), 256).alias("text_sha256"))


@query(
    """WITH c AS (SELECT doc_id AS identity, CAST(quality * 6 + doc_id % 4 AS DOUBLE) AS m, CAST(10 - toxic * 5 - doc_id % 3 AS DOUBLE) AS t FROM labels)
    SELECT identity, m + t AS final_score, row_number() OVER (ORDER BY m + t DESC, identity) AS rank FROM c JOIN documents ON doc_id = identity QUALIFY rank <= 20"""
)
def evidence_join(spark, sf):
    """Ready full texts joined with their evidence cards, ranked."""
    cards = table(spark, sf, "labels").select(F.col("doc_id").alias("identity"), (F.col("quality") * 6 + F.col("doc_id") % 4).cast("double").alias("match_score"), (10 - F.col("toxic") * 5 - F.col("doc_id") % 3).cast("double").alias("transferability_score"))
    ready = table(spark, sf, "documents").select(F.col("doc_id").alias("identity"))
    return score.final_ranking(ready, cards, 20).select("identity", "final_score", "rank")


@query(
    """WITH e AS (SELECT user_id, ts, event_id, list_distinct([event_type, 'e' || (event_id % 3)]) AS w FROM events), b AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY user_id ORDER BY ts, event_id), []) AS p FROM e)
    SELECT user_id AS run_id, event_id AS stage, 'raised' AS action, unnest(list_filter(w, lambda x: NOT list_contains(p, x))) AS message FROM b
    UNION ALL SELECT user_id, event_id, 'resolved', unnest(list_filter(p, lambda x: NOT list_contains(w, x))) FROM b"""
)
def warning_history(spark, sf):
    """Warnings raised and resolved between snapshots of a run."""
    snaps = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_id").alias("stage"), F.array("event_type", F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string"))).alias("warnings"))
    return runs.warning_history(snaps).select("run_id", "stage", "action", "message")


@query(
    """WITH l AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id AS run_id, string_agg(event_type || '=' || event_id, ',' ORDER BY event_type) AS counts FROM l WHERE rn = 1 GROUP BY 1"""
)
def run_state_fold(spark, sf):
    """Counts of a run's log merged: the last value of each name."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.lit("s").alias("stage"), F.lit("active").alias("status"), F.create_map("event_type", "event_id").alias("counts"), F.array().cast("array<string>").alias("warnings"))
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return runs.run_state(log).select("run_id", F.array_join(F.array_sort(pairs), ",").alias("counts"))


@query("SELECT source, lang FROM (SELECT DISTINCT source, lang FROM documents INTERSECT SELECT DISTINCT source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0)")
def set_intersect(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return audit.shared(docs, docs.join(labels.where("quality = 0"), "doc_id"), ["source", "lang"])


@query("SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus || '|Zed' AS authors FROM orders")
def author_split(spark, sf):
    """Names in one string, at commas, semicolons and 'and'."""
    names = F.concat(F.col("o_orderpriority"), F.lit(",  "), F.col("o_orderstatus"), F.lit(" ;Zed"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(T.split_authors(names), "|").alias("authors"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'doi:10.1/' || c_custkey WHEN c_custkey % 4 = 1 THEN 'arxiv_id:2401.' || c_custkey
    ELSE 'title:' || regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') || '|author:' || lower(c_mktsegment) || '|year:2024' END AS identity FROM customer"""
)
def identity_keys(spark, sf):
    """The first identifier there is, else title, first author and year."""
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("title"), F.lit("  x ").alias("abstract"), F.array("c_mktsegment").alias("authors"), F.lit("2024-05-01T00:00:00Z").alias("published"))
    key = F.col("c_custkey").cast("string")
    ids = F.create_map(F.lit("doi"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" 10.1/"), key)), F.lit("arxiv_id"), F.when(F.col("c_custkey") % 4 <= 1, F.concat(F.lit("2401."), key)))
    return records.normalize(rows.withColumn("identifiers", ids), "venue").select("c_custkey", "identity")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'https://aclanthology.org/2024.acl-long.' || p_partkey || '.pdf' ELSE 'https://arxiv.org/pdf/2401.' || p_partkey END AS pdf FROM part")
def pdf_links(spark, sf):
    """Official PDF links of papers by channel."""
    key = F.col("p_partkey").cast("string")
    even = F.col("p_partkey") % 2 == 0
    rows = table(spark, sf, "part").select("p_partkey", F.when(even, F.concat(F.lit("https://aclanthology.org/2024.acl-long."), key, F.lit("/"))).alias("url"), F.lit(None).cast("string").alias("pdf_url"), F.create_map(F.lit("arxiv_id"), F.concat(F.lit("2401."), key)).alias("identifiers"), F.when(even, "acl").otherwise("arxiv").alias("channel"))
    return rows.select("p_partkey", F.array_join(records.pdf_candidates(F.col("channel")), " ").alias("pdf"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}]')) AS cjk, len(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*')) AS english FROM documents")
def script_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.cjk_count(F.col("text")).cast("bigint").alias("cjk"), F.size(T.english_words(F.col("text"))).cast("bigint").alias("english"))


@query(
    """WITH a AS (SELECT DISTINCT doc_id % 10 AS part, doc_id FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT DISTINCT doc_id % 10 AS part, doc_id FROM labels UNION SELECT doc_id % 10, doc_id FROM documents WHERE doc_id % 10 < 5),
    p AS (SELECT unnest([0, 3, 7]) AS part), n AS (SELECT part, (SELECT count(*) FROM a WHERE a.part = p.part AND a.doc_id NOT IN (SELECT doc_id FROM b)) AS l, (SELECT count(*) FROM b WHERE b.part = p.part AND b.doc_id NOT IN (SELECT doc_id FROM a)) AS r FROM p)
    SELECT part, l AS only_left, r AS only_right, l = 0 AND r = 0 AS equal FROM n"""
)
def set_equality(spark, sf):
    """Whether two tables hold the same ids: in tenths that are equal, that the right has alone, and that differ."""
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    left, right = docs.where("doc_id % 10 <> 3"), labels.unionByName(docs.where("doc_id % 10 < 5"))
    each = [audit.same_ids(left.where(f"doc_id % 10 = {p}"), right.where(f"doc_id % 10 = {p}"), "doc_id").withColumn("part", F.lit(p)) for p in (0, 3, 7)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(
    """SELECT s_suppkey AS identity, first(c_mktsegment ORDER BY c_custkey) AS cache_dir, 'c' || min(c_custkey) AS cache_alias FROM supplier JOIN customer ON c_custkey IN (s_suppkey * 3, s_suppkey * 3 + 1) GROUP BY 1"""
)
def alias_lookup(spark, sf):
    """The first of a paper's aliases that the alias table knows."""
    aliases = F.array(*[F.concat(F.lit("c"), e.cast("string")) for e in (F.col("s_suppkey") * 3, F.col("s_suppkey") * 3 + 1)])
    papers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("identity"), aliases.alias("aliases"))
    known = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("alias"), F.col("c_mktsegment").alias("cache_dir"))
    return enrich.alias_lookup(papers, known)


@query(
    """WITH i AS (SELECT regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS k, repeat(c_mktsegment, 12) AS a, 'd' || c_custkey AS d FROM customer),
    r AS (SELECT s_suppkey, 'customer 00000' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'd' || s_suppkey WHEN s_suppkey % 3 = 1 THEN '' ELSE 'other' END AS doi FROM supplier)
    SELECT s_suppkey, CASE WHEN doi IN ('', d) AND length(a) >= 80 THEN a ELSE '' END AS abstract FROM r LEFT JOIN i ON k = regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')"""
)
def fill_by_title_compatible_doi(spark, sf):
    """Abstracts by title from an index whose DOI doesn't contradict."""
    index = table(spark, sf, "customer").select(F.col("c_name").alias("title"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("doi"), F.repeat("c_mktsegment", 12).alias("abstract"), F.lit("").alias("pdf_url"), F.col("c_custkey").alias("_pos"))
    key = F.col("s_suppkey")
    doi = F.when(key % 3 == 0, F.concat(F.lit("d"), key.cast("string"))).when(key % 3 == 1, "").otherwise("other")
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("customer 00000"), F.lpad(key.cast("string"), 4, "0")).alias("title"), doi.alias("doi"), F.lit("").alias("abstract"), F.lit("").alias("pdf_url"))
    return enrich.fill_by_title(rows, index).select("s_suppkey", "abstract")
