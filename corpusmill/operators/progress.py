"""What a caller sees of a run: compact results, counters, results in the order they were asked for, moved paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Names of compact results.
METADATA = ("schema_version", "run_id", "run_dir", "status", "raw_count", "deduplicated_count", "metadata_profile", "warnings")
RECEIPT = ("index", "venue", "year", "status", "paper_count", "cache_status")
SHORTLIST = (
    "schema_version", "run_id", "status", "selection_method", "seed", "per_venue", "target_count", "actual_count", "replacement_round",
    "replacement_count", "replacement_count_last_round", "replacement_count_total", "attempted_identity_count",
)
FULLTEXT = ("schema_version", "run_id", "status", "requested_count", "full_text_ready_count", "worker_count", "cooldown_requeue", "history_entry_path", "history_invocation_index")


def compact(results: DataFrame, names: tuple[str, ...], **more: Column) -> DataFrame:
    """The named fields of results, null where a result lacks one, and `more`."""
    held = set(results.columns)
    return results.select(*[F.col(n) if n in held else F.lit(None).cast("string").alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


def compact_metadata(results: DataFrame) -> DataFrame:
    """A metadata result without its papers: receipts cut to their names, notices counted."""
    receipt = F.transform(
        F.coalesce("source_receipts", F.array().cast(results.schema["source_receipts"].dataType)),
        lambda r: F.struct(
            r["index"].alias("index"),
            F.coalesce(r["source"]["venue_id"], r["source"]["venue"]).alias("venue"),
            F.get(r["source"]["years"], F.lit(0)).alias("year"),
            *[r[n].alias(n) for n in RECEIPT[3:]],
        ),
    )
    notices = F.greatest(F.coalesce(F.size("coverage_notices"), F.lit(0)), F.lit(0))
    return compact(results, METADATA, coverage_notice_count=notices, metadata_path=F.concat("run_dir", F.lit("/metadata.json")), source_receipts=receipt)


def compact_shortlist(results: DataFrame) -> DataFrame:
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("complete"))
    return compact(results.withColumn("status", status), SHORTLIST, shortlist_path=F.concat("run_dir", F.lit("/shortlist.json")))


def compact_fulltext(results: DataFrame) -> DataFrame:
    return compact(results, FULLTEXT, full_text_results_path=F.concat("run_dir", F.lit("/full_text_results.json")))


def counters(rows: DataFrame, by: list[str], phase: str, field: str = "abstract", known: Column | None = None) -> DataFrame:
    """How far an enrichment is: total, complete and remaining rows of each group; where `known` doesn't hold, rows count in the total alone."""
    known, lacks = F.lit(True) if known is None else known, T.missing(F.col(field))
    have, left = F.count_if(known & ~lacks), F.count_if(known & lacks)
    return rows.groupBy(*by).agg(F.lit(phase).alias("phase"), F.count(F.lit(1)).alias("total"), have.alias(f"{field}s_complete"), left.alias("remaining"))


def in_asked_order(results: DataFrame, asked: DataFrame, key: str = "identity") -> DataFrame:
    """Results in the order of `asked` (key, position), however they finished; what was never asked for is gone."""
    return results.join(asked.select(key, F.col("position").alias("__asked")), key).orderBy("__asked").drop("__asked")


def moved(value: Column, source: str, destination: str) -> Column:
    """An absolute path below `source` as one below `destination`; every other text as it is."""
    old, new = source.rstrip("/"), destination.rstrip("/")
    inside = (value == old) | value.startswith(old + "/")
    return F.when(inside, F.concat(F.lit(new), F.substring(value, F.lit(len(old) + 1), F.length(value)))).otherwise(value)


def moved_paths(rows: DataFrame, source: str, destination: str) -> DataFrame:
    """rows with every text moved, in arrays, maps and structs as well; keys of maps stay."""
    from pyspark.sql.types import ArrayType, MapType, StringType, StructType

    def walk(value: Column, kind) -> Column:
        if isinstance(kind, StringType):
            return moved(value, source, destination)
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(value, lambda _, v: walk(v, kind.valueType))
        if isinstance(kind, StructType):
            return F.when(value.isNotNull(), F.struct(*[walk(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return value

    return rows.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])
