"""Publication of catalogs: audited by the pass that writes them, then promoted or rejected.

A catalog's rows are evaluated once. While they are written to a place aside, Spark's observation counts what the
audit needs; only identities are read again, to tell whether they are unique. A catalog that passes moves to its
own place and is recorded; one that doesn't is removed, and its record says why. Readers see recorded catalogs only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import audit
from corpusmill.operators.dedup import keep_best
from corpusmill.operators.records import canonical_channel
from corpusmill.session import exists, move, remove

RECORD = "venue string, year int, version string, status string, broken array<string>, record_count bigint, fetched_at timestamp, metrics map<string,bigint>"


def counted(rows: DataFrame, venue: str | None = None, year: int | None = None) -> dict[str, Column]:
    """What an audit counts, by name: rows, each field that is there, links, real abstracts, rows of another binding."""
    have = set(rows.columns)
    out = {"record_count": F.count(F.lit(1))}
    out |= {f"{f}_count": F.count_if(audit.present(rows, f)) for f in (*audit.FIELDS, "categories") if f in have}
    out["linked"] = F.count_if(~T.missing(F.col("url")) | ~T.missing(F.col("pdf_url")))
    out["abstracted"] = F.count_if(T.abstract_is_real(F.col("abstract")))
    if year is not None:
        out["wrong_year"] = F.count_if(~F.coalesce(F.coalesce(F.col("year"), F.year("published")) == year, F.lit(False)))
    if venue is not None:
        out["wrong_venue"] = F.count_if(~F.coalesce(canonical_channel(F.col("venue")) == venue, F.lit(False)))
    return out


def observed(rows: DataFrame, venue: str | None = None, year: int | None = None) -> tuple[DataFrame, Observation]:
    """rows, and what is counted while they pass by on their way to be written."""
    watch = Observation(f"catalog-{uuid.uuid4().hex}")
    return rows.observe(watch, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in counted(rows, venue, year).items()]), watch


def complete(metrics: dict[str, int], unique: int, require_categories: bool = False) -> bool:
    """The verdict of audit.venue_audit, from counts."""
    n = metrics["record_count"]
    whole = n > 0 and unique == n and metrics.get("title_count") == n and metrics["abstracted"] == n
    enough = metrics.get("authors_count", 0) >= audit.LEAST_COVERAGE * n and metrics["linked"] >= audit.LEAST_COVERAGE * n
    return whole and enough and (not require_categories or metrics.get("categories_count") == n)


@dataclass
class Receipt:
    """What a crawl says of itself."""

    status: str = "complete"
    exhaustion_proof: str = "all pages"
    discovered: int | None = None
    minimum: int | None = None
    require_categories: bool = False


@dataclass
class Outcome:
    """complete, authoritative_empty, incomplete or refused; which rules were broken; where the rows are, if they are kept."""

    status: str
    broken: list[str] = field(default_factory=list)
    metrics: dict[str, int] = field(default_factory=dict)
    path: str | None = None


def judged(metrics: dict[str, int], unique: int, receipt: Receipt) -> Outcome:
    n = metrics["record_count"]
    discovered = n if receipt.discovered is None else receipt.discovered
    status = audit.catalog_verdict(discovered, n, n - metrics["abstracted"], receipt.minimum)
    rules = {
        "receipt": receipt.status == "complete" and bool(receipt.exhaustion_proof.strip()),
        "discovered": discovered == n,
        "minimum": not receipt.minimum or n >= receipt.minimum,
        "abstracts": metrics["abstracted"] == n,
        "binding": not metrics.get("wrong_year") and not metrics.get("wrong_venue"),
        "unique": unique == n,
        "completeness": complete(metrics, unique, receipt.require_categories),
    }
    broken = [] if status == "authoritative_empty" else [name for name, holds in rules.items() if not holds]
    return Outcome("refused" if status == "complete" and broken else status, broken, {**metrics, "unique": unique})


def publish(rows: DataFrame, path: str, venue: str, year: int, receipt: Receipt, now: Column) -> Outcome:
    """Writes a catalog below path/venue/year, judges it, and promotes or removes it. The record is the commit."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    aside, place = f"{path}/_aside/{version}", f"{path}/data/{venue}/{year}/{version}"
    watched, watch = observed(rows, venue, year)
    watched.write.parquet(aside)
    unique = spark.read.parquet(aside).agg(F.count_distinct("identity")).first()[0]  # one column of what was written
    out = judged({k: int(v or 0) for k, v in watch.get.items()}, unique, receipt)
    if out.status == "complete":
        move(spark, aside, place)
        out.path = place
    else:
        remove(spark, aside)
    one = spark.createDataFrame([(venue, year, version, out.status, out.broken, out.metrics["record_count"], None, out.metrics)], RECORD)
    one.withColumn("fetched_at", now).write.mode("append").parquet(f"{path}/records")
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every publication that was tried."""
    return spark.read.schema(RECORD).parquet(f"{path}/records") if exists(spark, f"{path}/records") else spark.createDataFrame([], RECORD)


def current(spark: SparkSession, path: str, venue: str, year: int) -> DataFrame | None:
    """Rows of the newest catalog that was kept; None if there is none."""
    kept = records(spark, path).where((F.col("venue") == venue) & (F.col("year") == year) & (F.col("status") == "complete"))
    last = keep_best(kept, ["venue", "year"], [F.col("fetched_at").desc(), F.col("record_count").desc(), F.col("version")]).select("version").first()
    return spark.read.parquet(f"{path}/data/{venue}/{year}/{last.version}") if last else None
