"""Canonical exact document digests, with DataFrame functions only.

A text's canonical form is its NFKC form with case folded, normalised again, and each run of white space
as one space, trimmed. Its digest is three seeded 64-bit xxhashes. Rows are grouped by digest; where one
digest occurs more than once, the canonical bytes are compared, and if they differ the digest is
extended so that only equal forms share a fingerprint. Likeness of two fingerprints is 1 if they are
equal, else 0.

Edge cases: a null text is empty; empty texts share a fingerprint; a null id sorts first; repeated ids
are ordered by text digest; a single document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import join_checked, stored, text_or_empty

#: Documents in a range of ids that is sorted as one group, and most ranges (their borders, eight bytes each, reach the
#: driver); beyond MOST_RANGES x RANGE_ROWS documents ranges grow, and their sort spills.
RANGE_ROWS = 4000
MOST_RANGES = 65_536
#: Borders compared at a time.
BORDERS = 256


def canonical(text: Column) -> Column:
    """NFKC, folded case, single spaces; plain functions where the text is ASCII."""
    ascii_only = F.length(text) == F.octet_length(text)
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    same = F.when(ascii_only, F.lower(text)).otherwise(compose(folded))
    return F.trim(F.regexp_replace(same, r"(?U)\s{2,}|[^\S ]", " "))


def digest(canon: Column) -> Column:
    """192 bits of xxhash, as text."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2, 3)])


def likeness(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def with_next(docs: DataFrame, id_col: str = "_id", text_col: str = "_text") -> DataFrame:
    """docs with _next and _next_id: text and id of the next document by id (after the last, the first).

    Ids are dealt into ranges of about RANGE_ROWS rows; the first row of each range is also a guest at the
    end of the range before, so no range needs another one. Texts are shuffled once.
    """
    rows = docs.count()
    ranges = max(1, min(MOST_RANGES, rows // RANGE_ROWS))
    place = F.coalesce(F.col(id_col), F.lit(-(1 << 62)))
    cuts = sorted({int(x) for x in docs.select(place.alias("i")).approxQuantile("i", [k / ranges for k in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []
    marked = _ranged(docs, place, cuts)
    # the smallest id of each range that has rows, and the range before it; before the first comes the last
    heads = stored(marked.groupBy("_range").agg(F.min(id_col).alias("_head")), "heads")
    n_heads, last = heads.agg(F.count(F.lit(1)), F.max("_range")).first()
    ring = heads.withColumn("_before", F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.lit(last)))  # at most MOST_RANGES rows
    marked = join_checked(marked, ring, "_range", "left", n_heads)
    is_head = F.coalesce(F.col(id_col) == F.col("_head"), F.col(id_col).isNull())
    place = F.array_compact(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.when(is_head, F.struct(F.col("_before").alias("r"), F.lit(1).alias("guest")))))
    spread = marked.withColumn("_place", F.explode(place)).withColumn("_guest", F.col("_place.guest")).withColumn("_range", F.col("_place.r")).drop("_place", "_head", "_before")
    order = Window.partitionBy("_range").orderBy("_guest", F.col(id_col).asc_nulls_first(), F.xxhash64(text_col))
    return spread.withColumn("_next", F.lead(text_col).over(order)).withColumn("_next_id", F.lead(id_col).over(order)).where("_guest = 0").drop("_guest", "_range")


def _ranged(docs: DataFrame, value: Column, cuts: list[int]) -> DataFrame:
    """docs with _range: how many of the sorted cuts are at or below value. Many cuts are compared in two steps, joined by block."""
    below = lambda array, v: F.size(F.filter(array, lambda x: x <= v))
    if len(cuts) <= BORDERS:
        return docs.withColumn("_range", below(F.lit(cuts), value) if cuts else F.lit(0))
    step = -(-len(cuts) // BORDERS)
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    fine = docs.sparkSession.createDataFrame(list(enumerate(blocks, 1)), "_block int, _fine array<bigint>")
    out = docs.withColumn("_block", below(F.lit([b[0] for b in blocks]), value)).join(F.broadcast(fine), "_block", "left")  # MOST_RANGES borders
    return out.withColumn("_range", F.when(F.col("_block") == 0, F.lit(0)).otherwise((F.col("_block") - 1) * step + below(F.col("_fine"), value))).drop("_block", "_fine")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is the text whose last quarter is replaced by as much of the next document's start.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).alias("_text"))
    light = with_next(plain).select("_id", "_next_id", F.length("_text").cast("bigint").alias("n_chars"), F.col("_text"), edited("_text", "_next").alias("_edited"), F.col("_next"))
    light = light.select("_id", "_next_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), canonical(F.col("_text")).alias("c"), canonical(F.col("_edited")).alias("e"), canonical(F.col("_next")).alias("n"))
    light = stored(light.select("_id", "_next_id", "n_chars", "edited_sha256", *[digest(F.col(x)).alias(f"d_{x}") for x in "cen"], *[F.sha2(x, 256).alias(f"s_{x}") for x in "cen"]), "digests")

    repeated = stored(light.select(F.explode(F.array("d_c", "d_e")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("d"), "repeated")
    n_repeated = repeated.count()
    texts = plain.select("_id", "_text", canonical(F.col("_text")).alias("canon")).withColumn("d", digest(F.col("canon")))
    own = join_checked(texts, repeated, "d", "left_semi", n_repeated).select("d", "canon")
    # the few edited texts whose digest also occurs elsewhere are made again from the two documents
    edits = join_checked(light.select("_id", "_next_id", F.col("d_e").alias("d")), repeated, "d", "left_semi", n_repeated)
    edits = stored(edits, "edits")
    n_edits = edits.count()
    made = join_checked(plain, edits.withColumnRenamed("_id", "_for"), F.col("_id").eqNullSafe(F.col("_for")), "inner", n_edits).select("d", "_next_id", "_text")
    if n_edits:
        made = stored(made, "edited")
        made = join_checked(plain.select(F.col("_id").alias("_n"), F.col("_text").alias("_next")), made, F.col("_n").eqNullSafe(F.col("_next_id")), "inner", n_edits)
        made = made.select("d", canonical(edited("_text", "_next")).alias("canon")).where(digest(F.col("canon")) == F.col("d"))
        own = own.unionByName(made)
    differ = own.groupBy("d").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select(F.col("d").alias("_clash"))
    differ = stored(differ, "clashes")
    clashes = differ.count()

    out = light
    for x in "cen":
        print_ = F.col(f"d_{x}")
        if clashes:  # different bytes under one digest: extended by a digest of the bytes
            out = join_checked(out, differ.withColumnRenamed("_clash", f"_clash_{x}"), F.col(f"d_{x}") == F.col(f"_clash_{x}"), "left", clashes)
            print_ = F.when(F.col(f"_clash_{x}").isNull(), print_).otherwise(F.concat_ws("-", print_, f"s_{x}"))
        out = out.withColumn(f"f_{x}", print_)
    return out.select(
        F.col("_id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("f_c").alias("fingerprint"),
        F.col("f_e").alias("edited_fingerprint"),
        likeness(F.col("f_c"), F.col("f_e")).alias("near_edited"),
        likeness(F.col("f_c"), F.col("f_n")).alias("near_next"),
    )


def edited(text: str, following: str) -> Column:
    """The last floor(n/4) code points of text replaced by the first as many of the following text."""
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - k), F.substring(F.col(following), F.lit(1), k))
