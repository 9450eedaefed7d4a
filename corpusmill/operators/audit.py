"""Coverage, completeness and validity: one-row or one-row-a-group aggregates, never collected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

FIELDS = ("title", "authors", "abstract", "url", "pdf_url")
NOTICED = ("authors", "abstract", "pdf_url")
#: Shares of a catalog that must be there.
LEAST_COVERAGE = 0.95


def present(rows: DataFrame, field: str) -> Column:
    return F.coalesce(F.size(F.col(field)) > 0, F.lit(False)) if dict(rows.dtypes)[field].startswith("array") else ~T.missing(F.col(field))


def field_coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """record_count, and of each field how many rows have it and their share to six places."""
    total = F.count(F.lit(1))
    aggs = [total.alias("record_count")]
    for f in FIELDS:
        if f in rows.columns:
            n = F.count_if(present(rows, f))
            aggs += [n.alias(f"{f}_count"), F.round(n / total, 6).alias(f"{f}_coverage")]
    return rows.groupBy(*by).agg(*aggs)


def coverage_notices(coverage: DataFrame, by: list[str], fields=NOTICED) -> DataFrame:
    """A row for each source and field that some rows lack."""
    held = [f for f in fields if f"{f}_count" in coverage.columns]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_count").alias("present_count"), F.col(f"{f}_coverage").alias("coverage")) for f in held]))
    out = coverage.select(*by, "record_count", each.alias("x")).select(*by, "record_count", "x.*")
    return out.where("present_count < record_count").withColumn("missing_count", F.col("record_count") - F.col("present_count")).withColumn("kind", F.concat("field", F.lit("_incomplete")))


def venue_audit(rows: DataFrame, by: list[str] | None = None, require_categories: bool = False, examples: int = 5) -> DataFrame:
    """Counts, coverages, up to five bad titles and the verdict on a catalog (or on each group of `by`).

    rows: identity, title, abstract, authors, url, pdf_url, categories. Examples are the smallest titles, kept by
    a bounded aggregate.
    """
    has_categories = "categories" in rows.columns
    real = T.abstract_is_real(F.col("abstract"))
    n = F.count(F.lit(1))
    linked = ~T.missing(F.col("url")) | ~T.missing(F.col("pdf_url"))
    counts = {
        "record_count": n,
        "unique_identity_count": F.count_distinct("identity"),
        "titled": F.count_if(present(rows, "title")),
        "authored": F.count_if(present(rows, "authors")),
        "linked": F.count_if(linked),
        "abstracted": F.count_if(real),
        "categorized": F.count_if(present(rows, "categories")) if has_categories else F.lit(0).cast("bigint"),
    }
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(*[c.alias(k) for k, c in counts.items()])
    share = lambda c: F.when(F.col("record_count") > 0, F.round(F.col(c) / F.col("record_count"), 6)).otherwise(0.0)
    whole = (F.col("record_count") > 0) & (F.col("unique_identity_count") == F.col("record_count")) & (F.col("titled") == F.col("record_count")) & (F.col("abstracted") == F.col("record_count"))
    whole = whole & (F.col("authored") >= LEAST_COVERAGE * F.col("record_count")) & (F.col("linked") >= LEAST_COVERAGE * F.col("record_count"))
    if require_categories:
        whole = whole & (F.col("categorized") == F.col("record_count"))
    out = out.select(
        *(by or []),
        "record_count",
        "unique_identity_count",
        (F.col("record_count") - F.col("unique_identity_count")).alias("duplicate_count"),
        share("titled").alias("title_coverage"),
        share("authored").alias("author_coverage"),
        share("linked").alias("link_coverage"),
        share("abstracted").alias("abstract_coverage"),
        (F.col("record_count") - F.col("abstracted")).alias("invalid_abstract_count"),
        share("categorized").alias("category_coverage"),
        whole.alias("metadata_completeness_ok"),
    )
    if not by:
        bad = rows.where(~real).select(T.clean(F.col("title")).alias("t")).orderBy("t").limit(examples).agg(F.sort_array(F.collect_list("t")).alias("invalid_abstract_examples"))
        out = out.crossJoin(bad)  # one row each
    return out


def binding_audit(rows: DataFrame, year: int, venue: str) -> DataFrame:
    """Rows of a wrong year or venue in a catalog that is meant to hold one of each."""
    from corpusmill.operators.records import canonical_channel

    return rows.agg(
        F.count_if(~F.coalesce(F.coalesce(F.col("year"), F.year("published")) == year, F.lit(False))).alias("wrong_year_count"),
        F.count_if(canonical_channel(F.col("venue")) != venue).alias("wrong_venue_count"),
        F.count_if(F.lower(T.clean(F.col("source_type"))) != "venue").alias("wrong_type_count"),
    )


def catalog_contract(rows: DataFrame, receipt: DataFrame, channel: str, year: int, schema_version: int = 1, minimum: int = 0, require_categories: bool = False, adapter: str = "") -> DataFrame:
    """One row of booleans on a catalog that is to be kept: receipt, binding, rows, size and completeness; `complete` if all hold.

    receipt: exactly one row (else it doesn't count) of status, complete_catalog, exhaustion_proof, count, discovered_count, requested_years,
    effective_years, channel, schema_version, adapter.
    """
    from corpusmill.operators.records import canonical_channel

    found = venue_audit(rows, None, require_categories).crossJoin(binding_audit(rows, year, channel))  # one row each
    one = found.crossJoin(receipt.agg(F.count(F.lit(1)).alias("r__n"), *[F.first(c).alias(f"r_{c}") for c in receipt.columns]))  # one row each
    years = F.array(F.lit(year))
    holds = {
        "receipt_ok": (F.col("r__n") == 1) & (F.col("r_status") == "complete") & F.col("r_complete_catalog") & ~T.missing(F.col("r_exhaustion_proof")),
        "payload_binding_ok": (canonical_channel(F.col("r_channel")) == channel) & (F.col("r_schema_version") == schema_version),
        "receipt_binding_ok": (F.col("r_count") == F.col("record_count")) & (F.col("r_discovered_count") == F.col("record_count")) & (F.col("r_requested_years") == years) & (F.col("r_effective_years") == years),
        "row_binding_ok": (F.col("record_count") > 0) & (F.col("wrong_year_count") == 0) & (F.col("wrong_venue_count") == 0) & (F.col("wrong_type_count") == 0),
        "minimum_ok": F.col("record_count") >= minimum,
        "adapter_ok": (F.lit(adapter) == "") | (T.clean(F.col("r_adapter")) == adapter),
        "metadata_completeness_ok": F.col("metadata_completeness_ok"),
    }
    out = one.select("record_count", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in holds.items()])
    return out.withColumn("complete", F.forall(F.array(*holds), lambda x: x))


def preprint_violations(rows: DataFrame, source: str, by: list[str], expected_day: Column | None = None, expected_category: Column | None = None) -> DataFrame:
    """invalid_records and duplicate_records of each group of `by` (a shard): title, real abstract, authors, id, day, category."""
    ids = F.col("identifiers")
    if source == "arxiv":
        key = F.lower(T.clean(ids["arxiv_id"]))
    else:
        doi = F.lower(T.clean(ids["doi"]))
        version = F.coalesce(F.nullif(T.clean(ids["biorxiv_version"]), F.lit("")), T.clean(F.col("version")))
        key = F.when(doi != "", F.concat(doi, F.lit("v"), version)).otherwise("")
    bad = T.missing(F.col("title")) | ~T.abstract_is_real(F.col("abstract")) | (F.coalesce(F.size("authors"), F.lit(0)) <= 0) | (key == "")
    if expected_day is not None:
        bad = bad | ~F.coalesce(T.date_text(F.col("published")) == expected_day, F.lit(False))
    if expected_category is not None:
        bad = bad | ~F.coalesce(F.array_contains("categories", expected_category), F.lit(False))
    return rows.withColumn("_key", key).withColumn("_bad", bad).groupBy(*by).agg(F.count_if("_bad").alias("invalid_records"), (F.count(F.lit(1)) - F.count_distinct("_key")).alias("duplicate_records"))


def catalog_verdict(discovered: int, rows: int, invalid_abstracts: int, minimum: int | None = None) -> str:
    """complete, authoritative_empty or incomplete, from counts."""
    if not rows and not discovered:
        return "authoritative_empty"
    return "incomplete" if invalid_abstracts or discovered != rows or (minimum and rows < minimum) else "complete"


def same_ids(a: DataFrame, b: DataFrame, key: str = "identity") -> DataFrame:
    """only_left, only_right, equal: whether two tables hold the same keys."""
    left, right = a.select(key).distinct().withColumn("_l", F.lit(True)), b.select(key).distinct().withColumn("_r", F.lit(True))
    both = left.join(right, key, "full")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right")).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def shared(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Distinct combinations of `on` that both tables hold, nulls included."""
    return a.select(*on).intersect(b.select(*on))


def uncovered(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys of wanted that given lacks."""
    return wanted.select(key).distinct().join(given.select(key).distinct(), key, "left_anti")
