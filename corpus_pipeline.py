"""Five stages from raw documents to packed training sequences.

Every stage reads what the one before it wrote, works on all of it, and its decisions take effect: the
next stage sees only what stayed. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as vocabulary

from corpusmill.llm import exact_dedup, language, near_dedup, packing, pii
from corpusmill.llm.common import join_checked, packed, small_batches, stored, table, unpacked
from corpusmill.llm.resampling import numbered

#: A text whose best margin and share of known n-grams are both below these has none of the languages.
#: Neither depends on how many languages the labels have.
LANGUAGE_MARGIN, LANGUAGE_KNOWN = 0.1, 0.6
#: Near duplicates: words of a shingle and the similarity, as a fraction.
SHINGLE_WORDS, SIMILAR = 5, (8, 10)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has one of the labels' languages; the model learns from this stage's own labelled rows.

    Null texts, and those without a letter, have no language and go; a table without labels keeps nothing;
    repeated rows are judged one by one.
    """
    small_batches(spark)
    model = language.fit(docs, F.lit(True))
    out = language.predict(docs.select(packed(docs).alias("row"), "text"), model, out_col="told", evidence=True)
    told = (F.col("told.margin") >= LANGUAGE_MARGIN) | (F.col("told.known") >= LANGUAGE_KNOWN)
    return unpacked(out.where((F.col("told.lang") != language.UNKNOWN) & told), "row", docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id; null texts are empty ones."""
    small_batches(spark)
    out = exact_dedup.exact_dedup(docs.select(packed(docs).alias("row"), "doc_id", "text"), columns=["row"])
    return unpacked(out.where("_kept"), "row", docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; null and empty texts stay.

    Documents are told apart by rows, not by ids: where an id is null or occurs again, rows are numbered by id
    (nulls last) and text first, and the first of each group stays.
    """
    small_batches(spark)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count()
    if not again:
        found = near_dedup.near_duplicates(docs, SHINGLE_WORDS, *SIMILAR)
        gone = stored(found.where("component_id <> id").select(F.col("id").alias("doc_id")).distinct(), "gone")
        return join_checked(docs, gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = numbered(rows, F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).select("row", "_place", "text")
    found = near_dedup.near_duplicates(rows, SHINGLE_WORDS, *SIMILAR, id_col="_place")
    gone = stored(found.where("component_id <> id").select(F.col("id").alias("_place")), "gone")
    return unpacked(join_checked(rows, gone, "_place", "left_anti"), "row", docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind; n_chars follows the text; null texts stay null."""
    small_batches(spark)
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; null texts are empty, an empty table gives no pieces."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: Kernel regressions and token ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
