"""A run: one folder of parquet tables and a small state document, taken from plan to recommendations.

Steps check that their stage is planned, that the plan hasn't changed, and that what they build on is what
they were built on (by fingerprint). Tables stay distributed; the driver holds counts and digests only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import audit, catalogs, dedup, fulltext, reads, records, runs, sample, score
from corpusmill.plans import plan as P
from corpusmill.session import exists


class StaleError(RuntimeError):
    """A step that builds on something changed or unfinished."""


def table_fingerprint(rows: DataFrame) -> str:
    """An order-free digest of a table: its size and the combined hash of its rows."""
    plain = [F.to_json(F.struct(c)) if "map" in t or "struct" in t else F.col(c) for c, t in rows.dtypes]
    digest = rows.select(F.xxhash64(*plain).alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return P.fingerprint([str(x) for x in digest])


class Run:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # storage

    def _exists(self, name: str) -> bool:
        return exists(self.spark, f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.table(name)

    def state(self) -> dict:
        """The fold of the event log: stage, status, counts, warnings, fingerprints."""
        if not self._exists("events"):
            return {"stage": "new", "status": "active", "counts": {}, "warnings": [], "facts": {}}
        events = self.table("events")
        last = runs.run_state(events).first()
        facts: dict = {}
        for row in events.select("at", "seq", "facts").orderBy("at", "seq").collect():  # a row a step
            facts |= json.loads(row.facts)
        return {"stage": last.stage, "status": last.status, "counts": dict(last.counts or {}), "warnings": list(last.warnings or []), "facts": facts}

    def log(self, stage: str, status: str = "active", counts: dict | None = None, warnings: list | None = None, facts: dict | None = None) -> None:
        before = self.state()
        if before["status"] == "complete":
            raise StaleError("a finished run doesn't change; start a child run")
        row = (self.path, stage, status, {k: int(v) for k, v in (counts or {}).items()}, warnings if warnings is not None else before["warnings"], json.dumps(facts or {}, sort_keys=True))
        out = self.spark.createDataFrame([row], "run_id string, stage string, status string, counts map<string,bigint>, warnings array<string>, facts string")
        seq = self.table("events").count() if self._exists("events") else 0
        out.withColumn("at", F.current_timestamp()).withColumn("seq", F.lit(seq)).write.mode("append").parquet(f"{self.path}/events")

    # gates

    def _plan(self, stage: str) -> dict:
        facts = self.state()["facts"]
        if "plan" not in facts:
            raise StaleError("the run has no plan")
        if not P.unchanged(facts["plan"], facts["plan_fingerprint"]):
            raise StaleError("the plan has changed")
        if not P.stage_allowed(facts["plan"]["workflow"], stage):
            raise P.PlanError(f"the plan stops before {stage}")
        return facts

    def _built_on(self, facts: dict, name: str) -> DataFrame:
        """A table of this run, provided that it is still the one recorded."""
        if f"{name}_fingerprint" not in facts:
            raise StaleError(f"{name} is missing")
        rows = self.table(name)
        if table_fingerprint(rows) != facts[f"{name}_fingerprint"]:
            raise StaleError(f"{name} has changed")
        return rows

    @staticmethod
    def _none(violations: DataFrame, what: str) -> None:
        found = violations.orderBy("violation", "identity").limit(5).collect()
        if found:
            raise ValueError(f"{what}: " + "; ".join(f"{r.violation} {r.identity}" for r in found))

    @staticmethod
    def _target(asked: int | None, planned: int | None, default: int) -> int:
        if asked is not None and planned is not None and asked != planned:
            raise P.PlanError("the target contradicts the plan")
        target = asked if asked is not None else planned if planned is not None else default
        if target < 1:
            raise ValueError("the target must be positive")
        return target

    # steps

    def metadata(self, plan: dict, sources: list[DataFrame], errors: dict[int, str] | None = None, discovered: dict[int, int] | None = None) -> str:
        """Reads every source of the plan, audits it before any filter, deduplicates; returns the status.

        Sources are evaluated once: what their audits count is observed while their rows are written.
        errors: what is known to be wrong with a source, by its place; discovered: how many records its crawl saw.
        A catalog that fails its audit is a gap, too: its rows stay in the raw table and reach no later step.
        """
        plan, errors = P.validate(plan), dict(errors or {})
        if len(sources) != len(plan["sources"]):
            raise ValueError(f"the plan has {len(plan['sources'])} sources, {len(sources)} were given")
        watched = [catalogs.observed(records.normalize(s, str(spec["type"]).lower())) for s, spec in zip(sources, plan["sources"])]
        raw = self._write("raw", dedup.union_sources([rows for rows, _ in watched], stored=False))
        seen = [{k: int(v or 0) for k, v in watch.get.items()} for _, watch in watched]
        notices = audit.coverage_notices(self._write("receipts", self._coverage(seen)), ["_source_index"]).count()
        unique = {r["_source_index"]: r["n"] for r in raw.groupBy("_source_index").agg(F.count_distinct("identity").alias("n")).collect()}  # a row a source
        failed, audits = [], []
        for i, (spec, counts) in enumerate(zip(plan["sources"], seen)):
            found = catalogs.judged(counts, unique.get(i, 0), catalogs.Receipt(discovered=(discovered or {}).get(i), minimum=spec.get("minimum_catalog_records")))
            audits.append((i, found.status, found.broken, found.metrics))
            if str(spec["type"]).lower() == "venue" and found.status != "complete":
                failed.append(i)
                errors.setdefault(i, "the catalog is empty" if found.status == "authoritative_empty" else "the catalog fails its audit")  # the rules are in `audits`
        self._write("audits", self.spark.createDataFrame(audits, "_source_index int, status string, broken array<string>, metrics map<string,bigint>"))
        papers = self._write("papers", dedup.keep_longest_abstract(raw.where(~F.col("_source_index").isin(failed))))
        n, m = papers.count(), sum(c["record_count"] for c in seen)
        warnings = sorted(f"source {i}: {e}" for i, e in errors.items())
        status = "complete" if n and not warnings else "complete_with_gaps" if n else "blocked"
        facts = {"plan": plan, "plan_fingerprint": P.fingerprint(plan), "papers_fingerprint": table_fingerprint(papers), "metadata_status": status}
        stage = {"complete": "metadata_ready", "complete_with_gaps": "metadata_incomplete", "blocked": "metadata_blocked"}[status]
        self.log(stage, "active" if n else "blocked", {"raw_papers": m, "metadata_papers": n, "coverage_notices": notices}, warnings, facts)
        return status

    def _coverage(self, seen: list[dict[str, int]]) -> DataFrame:
        """The rows of audit.field_coverage, from what was observed of each source."""
        names = ["record_count", *[f"{f}_count" for f in audit.FIELDS if all(f"{f}_count" in c for c in seen)]]
        rows = self.spark.createDataFrame([(i, *[c[n] for n in names]) for i, c in enumerate(seen)], ", ".join(["_source_index int", *[f"{n} bigint" for n in names]]))
        share = lambda n: F.when(F.col("record_count") > 0, F.round(F.col(n) / F.greatest("record_count", F.lit(1)), 6)).otherwise(0.0)
        return rows.withColumns({n.replace("_count", "_coverage"): share(n) for n in names[1:]})

    def _ready_papers(self, facts: dict) -> DataFrame:
        if facts.get("metadata_status") != "complete":
            raise StaleError("metadata is incomplete")
        return self._built_on(facts, "papers")

    def shortlist(self, scores: DataFrame, target: int | None = None) -> DataFrame:
        facts = self._plan("shortlist")
        papers = self._ready_papers(facts)
        self._none(score.score_violations(scores, papers), "scores")
        target = self._target(target, facts["plan"]["workflow"].get("shortlist_target"), 100)
        out = self._write("shortlist", score.shortlist(papers, scores, target))
        self.log("shortlist_ready", counts={"shortlist_target": target, "shortlist_actual": out.count()}, facts={"shortlist_fingerprint": table_fingerprint(out)})
        return out

    def random_shortlist(self, per_venue: int, seed: str) -> DataFrame:
        facts = self._plan("shortlist")
        papers = self._ready_papers(facts)
        short = sample.short_strata(papers, ["venue", "year"], per_venue).limit(5).collect()
        if short:
            raise ValueError("too few papers in " + ", ".join(f"{r.venue} {r.year}" for r in short))
        out = self._write("shortlist", sample.stratified_sample(papers, ["venue", "year"], per_venue, seed))
        self._write("attempted-0", out.select("identity"))
        self.log("shortlist_ready", counts={"shortlist_actual": out.count()}, facts={"shortlist_fingerprint": table_fingerprint(out), "sample": {"per_venue": per_venue, "seed": seed, "round": 0}})
        return out

    def replace_failed(self) -> DataFrame:
        """Keeps what has a full text and draws the rest anew from papers never tried."""
        facts = self._plan("shortlist")
        drawn, items = facts["sample"], self._built_on(facts, "fulltext")
        papers, attempted = self._ready_papers(facts), self.table(f"attempted-{drawn['round']}")
        current = self._built_on(facts, "shortlist").select("venue", "year").distinct()
        population = papers.join(current, ["venue", "year"], "left_semi")
        round_ = drawn["round"] + 1
        chosen = sample.replacement_sample(population, items.where("full_text_available").select("identity"), attempted, ["venue", "year"], drawn["per_venue"], drawn["seed"], round_)
        out = self._write(f"shortlist-{round_}", chosen)
        fresh = out.where("origin = 'replacement'").select("identity")
        self._write(f"attempted-{round_}", attempted.unionByName(fresh).distinct())
        self._write("shortlist", out)
        self.log("shortlist_ready", counts={"replacements": fresh.count()}, facts={"shortlist_fingerprint": table_fingerprint(self.table("shortlist")), "sample": {**drawn, "round": round_}})
        return self.table("shortlist")

    def fulltext(self, items: DataFrame) -> str:
        """Records acquired items (identity, venue, status, full_text_available, text_path, attempts) of the shortlist."""
        facts = self._plan("fulltext")
        wanted = self._built_on(facts, "shortlist").select("identity")
        out = self._write("fulltext", items.join(wanted, "identity", "left_semi"))
        counts = fulltext.round_summary(out).first()
        history = self.table("rounds").agg(F.max("invocation_index")).first()[0] + 1 if self._exists("rounds") else 0
        summary = fulltext.failure_histogram(out).withColumn("run_id", F.lit(self.path)).withColumn("invocation_index", F.lit(history))
        runs.append_round(summary, f"{self.path}/rounds")
        lost = wanted.count() - counts.ready_count
        status = "complete" if not lost else "complete_with_gaps" if counts.ready_count else "unavailable"
        self.log("fulltext_ready", counts={"full_text_requested": counts.requested_count, "full_text_ready": counts.ready_count}, facts={"fulltext_fingerprint": table_fingerprint(out), "fulltext_status": status})
        return status

    def reading_batches(self, batches: int = 3) -> DataFrame:
        facts = self._plan("reading")
        ready = self._built_on(facts, "fulltext").where("full_text_available").select("identity")
        return self._write("batches", sample.balanced_batches(ready, [F.col("identity")], batches))

    def validate_reads(self, texts: DataFrame) -> str:
        """Checks reads (identity, text, read_path, position) of ready papers; complete only if every one passes."""
        facts = self._plan("reading")
        papers = self._built_on(facts, "papers").select("identity", "title", "abstract")
        ready = self._built_on(facts, "fulltext").where("full_text_available").select("identity")
        own = ready.join(papers, "identity").join(texts, "identity", "left")
        checked = own.withColumn("errors", reads.read_errors(F.col("text"), F.col("title"), F.col("abstract")))
        shared = dedup.duplicate_sections(reads.sections_of(checked)).groupBy("identity").agg(F.collect_set("section").alias("shared"))
        checked = self._write("reads", checked.join(shared, "identity", "left").withColumn("valid", (F.size("errors") == 0) & F.col("shared").isNull()))
        bad = checked.where("NOT valid").count()
        if not bad:
            self._write("read", reads.aggregate_reads(checked.select("text", "position")))
        status = "complete" if not bad else "partial"
        self.log("reading_ready", counts={"reads_invalid": bad}, facts={"reads_fingerprint": table_fingerprint(checked), "reading_status": status})
        return status

    def finalize(self, cards: DataFrame, target: int | None = None) -> DataFrame:
        facts = self._plan("recommendation")
        ready = self._built_on(facts, "fulltext").where("full_text_available")
        valid = self._built_on(facts, "reads").where("valid").select("identity", "read_path")
        self._none(score.evidence_violations(cards, ready.select("identity", "text_path"), valid), "evidence cards")
        target = self._target(target, facts["plan"]["workflow"].get("final_target"), 20)
        out = self._write("ranking", score.final_ranking(ready, cards, target))
        self.log("final_ranking_ready", counts={"final_target": target, "final_actual": out.count()}, facts={"ranking_fingerprint": table_fingerprint(out)})
        return out

    def complete(self, recommendations: str) -> None:
        """Ends the run if every recommended title stands in the text."""
        facts = self._plan("recommendation")
        for name in ("papers", "shortlist", "fulltext"):
            self._built_on(facts, name)
        titles = self._built_on(facts, "ranking").join(self.table("papers").select("identity", F.col("title").alias("_title")), "identity")
        missing = [r["_title"] for r in titles.select("_title").collect() if r["_title"] not in recommendations]  # the target number of rows
        if len(recommendations.strip()) < 200 or missing:
            raise ValueError(f"recommendations are too short or lack {len(missing)} titles")
        self.log("complete", "complete")

    def finish(self, stage: str) -> None:
        """Ends a run that was planned to stop at an earlier stage."""
        facts = self._plan(stage)
        if facts["plan"]["workflow"]["stop_after"] != stage:
            raise P.PlanError(f"the plan doesn't stop at {stage}")
        name = {"metadata": "papers", "shortlist": "shortlist", "fulltext": "fulltext", "reading": "reads"}[stage]
        done = {"metadata": facts.get("metadata_status"), "fulltext": facts.get("fulltext_status"), "reading": facts.get("reading_status")}.get(stage, "complete")
        if P.exit_status({"reading": "validate_reads"}.get(stage, stage), done or "error") or not self._built_on(facts, name).limit(1).count():
            raise StaleError(f"{stage} isn't done")
        self.log(f"{stage}_complete", "complete")
