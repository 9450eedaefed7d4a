"""Acceptance of full texts, and what their acquisition attempts tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.records import service
from corpusmill.session import exists

#: An attempt: kind, url, status_code, accepted, reason, status, error_type, message.
ATTEMPT = "struct<kind:string,url:string,status_code:int,accepted:boolean,reason:string,status:string,error_type:string,message:string>"
LEAST_HTML = 4000
FAILED_STATUS = ["error", "skipped_cooldown", "skipped_persisted_cooldown"]
COOLDOWN = ["skipped_cooldown", "service_cooldown_active", "openreview_service_cooldown_active"]
KNOWN = ["openreview", "arxiv", "biorxiv", "openalex", "semantic_scholar", "hal", "europepmc", "unpaywall", "acm"]


def accepted(title: Column, authors: Column, text: Column) -> Column:
    """accepted, body_too_short or identity_mismatch."""
    return F.when(~T.body_ok(text), "body_invalid").when(~T.identity_ok(title, authors, text), "identity_mismatch").otherwise("accepted")


def html_accepted(text: Column) -> Column:
    return (F.length(T.text(text)) >= LEAST_HTML) & T.body_ok(text, require_sections=True)


def attempts_of(items: DataFrame) -> DataFrame:
    """One row an attempt: identity, venue, group, attempt. items: identity, venue, attempts map<string, array<attempt>>."""
    groups = items.select("identity", "venue", F.explode("attempts").alias("group", "list"))
    return groups.select("identity", "venue", "group", F.posexplode("list").alias("pos", "attempt"))


def _failed(a: Column) -> Column:
    bad = (a["accepted"] == F.lit(False)) | (F.coalesce(a["status_code"], F.lit(0)) >= 400) | F.lower(T.clean(a["status"])).isin(FAILED_STATUS) | ~T.missing(a["error_type"])
    return F.coalesce(bad, F.lit(False))


def failure_histogram(items: DataFrame) -> DataFrame:
    """failure_step, count of failed attempts by kind and reason, and of items that stayed without a text."""
    a = F.col("attempt")
    first = lambda *cs: F.coalesce(*[F.when(~T.missing(c), T.clean(c)) for c in cs])
    steps = attempts_of(items).where(_failed(a)).select(F.concat_ws(":", F.coalesce(first(a["kind"]), F.lit("unknown")), F.coalesce(first(a["reason"], a["status"], a["error_type"], a["status_code"].cast("string")), F.lit("rejected"))).alias("failure_step"))
    if "status" in items.columns:
        lost = items.where(~F.coalesce("full_text_available", F.lit(False)) & ~T.missing(F.col("status"))).select(F.concat(F.lit("item:"), T.clean(F.col("status"))).alias("failure_step"))
        steps = steps.unionByName(lost)
    return steps.groupBy("failure_step").count()


def unavailable_by_venue(items: DataFrame) -> DataFrame:
    venue = F.when(T.missing(F.col("venue")), "unknown").otherwise(T.clean(F.col("venue")))
    return items.where(~F.coalesce("full_text_available", F.lit(False))).groupBy(venue.alias("venue")).count()


def round_summary(items: DataFrame) -> DataFrame:
    """requested, ready, unavailable."""
    ready = F.count_if(F.coalesce("full_text_available", F.lit(False)))
    return items.agg(F.count(F.lit(1)).alias("requested_count"), ready.alias("ready_count"), (F.count(F.lit(1)) - ready).alias("unavailable_count"))


def transient(items: DataFrame) -> DataFrame:
    """identity, retryable_after_cooldown, cooldown_services, reasons: throttling and challenges are no absence."""
    a = F.col("attempt")
    kind, url, reason = F.lower(T.clean(a["kind"])), T.clean(a["url"]), F.lower(F.coalesce(F.when(~T.missing(a["reason"]), T.clean(a["reason"])), T.clean(a["status"])))
    message, error, code = F.lower(T.clean(a["message"])), F.lower(T.clean(a["error_type"])), F.coalesce(a["status_code"], F.lit(0))
    openreview = kind.contains("openreview") | url.contains("openreview.net")
    of = F.when(openreview, "openreview").when(url != "", service(url)).otherwise(F.coalesce(*[F.when(kind.contains(k), k) for k in KNOWN]))
    throttled = (code == 429) | (reason.contains("rate") & reason.contains("limit"))
    challenged = (code == 403) | reason.isin("challenge_403", "http_403") | reason.contains("challenge")
    cooling = reason.isin(COOLDOWN) | (error == "servicerequestdeferred") | message.contains("request deferred") | (message.contains("cooldown") & message.contains("deferred"))
    reasons = F.array_compact(F.array(F.when(throttled, "http_429_rate_limited"), F.when(challenged & openreview, "openreview_403_challenge"), F.when(challenged & ~openreview, "http_403_access_challenge"), F.when(cooling, "service_cooldown_active")))
    hits = attempts_of(items).select("identity", F.when(of != "", of).alias("service"), F.explode(reasons).alias("reason"))
    found = hits.groupBy("identity").agg(F.array_sort(F.collect_set("service")).alias("cooldown_services"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    none = F.array().cast("array<string>")
    return items.select("identity").join(found, "identity", "left").select("identity", F.col("reasons").isNotNull().alias("retryable_after_cooldown"), F.coalesce("cooldown_services", none).alias("cooldown_services"), F.coalesce("reasons", none).alias("reasons"))


def accepted_pdf_url(attempts: Column, fallback: Column) -> Column:
    """The first accepted PDF attempt's link, else the record's."""
    hit = F.filter(F.coalesce(attempts["pdf"], F.array().cast(f"array<{ATTEMPT}>")), lambda a: F.coalesce(a["accepted"], F.lit(False)) & ~T.missing(a["url"]))
    return F.when(F.size(hit) > 0, T.clean(F.get(hit, F.lit(0))["url"])).otherwise(T.clean(fallback))


def files_valid(payloads: DataFrame, files: DataFrame) -> DataFrame:
    """Payloads whose every declared file is there with its size and digest. payloads: identity, files array<struct<path,sha256,size>>."""
    declared = payloads.select("identity", F.explode("files").alias("f")).select("identity", "f.*")
    seen = files.select("path", F.col("sha256").alias("_sha"), F.col("size").alias("_size"))
    bad = declared.join(seen, "path", "left").where(~(F.col("sha256").eqNullSafe(F.col("_sha")) & F.col("size").eqNullSafe(F.col("_size"))))
    return payloads.join(bad.select("identity").distinct(), "identity", "left_anti")


def max_cooldown(services: DataFrame) -> DataFrame:
    return services.agg(F.max("cooldown_seconds").alias("max_cooldown_seconds"))


def publish(items: DataFrame, path: str) -> None:
    """Accepted full texts (identity, aliases, text) under the digest of their content, and an alias table beside them.

    What is there already is not written again, so a repeated run adds nothing.
    """
    rows = items.withColumn("digest", F.sha2("text", 256)).withColumn("cache_dir", F.concat_ws("/", F.lit(path.rstrip("/")), "digest"))
    new = {"texts": rows.select("digest", "identity", "text").dropDuplicates(["digest", "identity"]), "aliases": rows.select(F.explode("aliases").alias("alias"), "cache_dir", "digest").distinct()}
    for name, keys in (("texts", ["digest", "identity"]), ("aliases", ["alias", "digest"])):
        if exists(items.sparkSession, f"{path}/{name}"):
            known = items.sparkSession.read.parquet(f"{path}/{name}").select(*keys)
            new[name] = new[name].join(known, keys, "left_anti")
        new[name].write.mode("append").parquet(f"{path}/{name}")
