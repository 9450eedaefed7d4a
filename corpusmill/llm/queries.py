"""The operators' registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as vocabulary

from corpusmill.llm import bpe, chat, exact_dedup, fim, fingerprint, html, language, licenses, near_dedup, packing, pii, quality, resampling
from corpusmill.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe.encoded(F.col("text"), path).alias("ids"))
    docs = docs.withColumn("decoded", bpe.decoded(F.col("ids"), path))
    return docs.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host: the document's source; path: its language under that source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.fit(docs, labels), F.col("source"), F.col("lang"), labels=labels)
    return out.select("doc_id", F.col("_p").alias("doc_score"), F.col("_site").alias("site_score"), F.col("_score").alias("score"), F.col("_keep").alias("keep"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii_spans")).alias("spans"), *_more(F.col("pii_spans")))


def _more(spans):
    """Scores of all spans in their order, the highest of them (0 without spans), and how many the method added."""
    scores = F.transform(spans, lambda s: s["score"])
    return (
        F.array_join(F.transform(scores, lambda x: F.format_string("%.2f", x)), ",").alias("scores"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
        F.size(F.filter(spans, lambda s: ~s["base"])).cast("bigint").alias("n_added"),
        (F.size(spans) > 0).alias("private"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = language.held_out(F.col("doc_id"))
    model = language.fit(docs, ~fold)
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", fold.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_text_sha256").alias("text_sha256"))


#: A conversation that writes the control strings of common chat formats, added to the table.
PROBE_TEXT = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, t AS turn, IF(t = 0, 'user', 'assistant') AS role, '{PROBE_TEXT}' AS text FROM VALUES (0L), (1L) AS v(t)")
    return chat.read_back(chat.format_chats(turns.unionByName(probe)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    chars = lambda part: F.length(f"fim.{part}").cast("bigint").alias(f"{part}_chars")
    back = fim.restored(F.col("fim.output"), F.col("fim.form"))
    return out.select("doc_id", "fim.n", "fim.form", chars("prefix"), chars("middle"), F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licenses.scanned(F.col("text").cast("string")).alias("scan")).select("doc_id", "scan.*")
    base = F.filter("matches", lambda m: m["base"])
    first = F.transform(base, lambda m: m["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        licenses.labels(base).alias("base_labels"),
        licenses.labels(F.col("matches")).alias("labels"),
        licenses.score(F.col("matches")).alias("score"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("_id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_bpe_transducer, op3_quality_classifier, op4_html_extraction, op5_document_fingerprints, op6_pii, op7_language_id, op8_ngram_jaccard_join, op9_exact_dedup, op10_chat_format, op11_fill_in_middle, op12_license_scan, op13_importance_resampling)}

#: Words as lists, by SQL; and words that each stand between two spaces.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _license_sql() -> str:
    """The scan by lists of words (base phrases) and by regular expressions (templates)."""
    lists = [(label, phrase.split()) for label, phrase in licenses.BASE]
    places = [f"list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p)}] = {p!r})" for _, p in lists]
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(lists))
    hits = [(label, f"regexp_matches(s, '{licenses.pattern(t)}')", licenses.mandatory(t)) for label, t in licenses.BASE + licenses.TEMPLATES]
    every = ", ".join(f"CASE WHEN {hit} THEN '{label}' END" for label, hit, _ in hits)
    most = ", ".join(f"CASE WHEN {hit} THEN {m} ELSE 0 END" for _, hit, m in hits)
    sorted_ = lambda xs: f"list_aggregate(list_sort(list_distinct(list_filter([{xs}], lambda x: x IS NOT NULL))), 'string_agg', ',')"
    return f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        e AS (SELECT *, coalesce(' ' || array_to_string(w, '  ') || ' ', '') AS s, {", ".join(f"{x} AS p{k}" for k, x in enumerate(places))} FROM d),
        f AS (SELECT *, {" + ".join(f"len(p{k})" for k in range(len(lists)))} AS n_base, list_concat({", ".join(f"p{k}" for k in range(len(lists)))}) AS p FROM e)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word,
            coalesce({sorted_(base)}, '') AS base_labels, coalesce({sorted_(every)}, '') AS labels, 1.0::DOUBLE - 1.0::DOUBLE / (greatest({most}) + 1) AS score
        FROM f
    """


_RUNS = "'[ \\t\\n\\x0B\\x0C\\r]+'"

ORACLE_SQL = {
    "op11_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tokens
            FROM documents
        ), e AS (
            SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
            FROM d
        ), f AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM e
        ), g AS (
            SELECT *, coalesce(array_to_string(tokens[1:a], ''), '') AS p, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS m,
                coalesce(array_to_string(tokens[b + 1:], ''), '') AS s
            FROM f
        )
        SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
            CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM g
    """,
    "op12_license_scan": _license_sql(),
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_RUNS}, ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op10_chat_format": f"""
        WITH c AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '{PROBE_TEXT}'), (-1, 1, 'assistant', '{PROBE_TEXT}')
        ), e AS (
            SELECT *, regexp_replace(text, '(\\\\|<s>|</s>|\\[INST\\]|\\[/INST\\]|\\[SYS\\]|\\[ANS\\]|\\[TOOL\\]|\\[ROLE:|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|\\])', '\\\\\\1', 'g') AS escaped,
                lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(escaped) + 4 + CASE role WHEN 'system' THEN 9 WHEN 'user' THEN 10 WHEN 'assistant' THEN 9 WHEN 'tool' THEN 10 END) AS BIGINT) AS formatted_chars,
            CAST(sum(CASE WHEN before IS NULL AND role IN ('system', 'user') OR before = 'system' AND role = 'user' OR before IN ('user', 'tool') AND role = 'assistant'
                OR before = 'assistant' AND role IN ('user', 'tool') THEN 0 ELSE 1 END) AS BIGINT) AS n_invalid
        FROM e GROUP BY conv_id
    """,
}
