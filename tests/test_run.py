"""A run from plan to recommendations, and the gates on its way."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.fulltext import ATTEMPT
from corpusmill.plans.plan import PlanError
from corpusmill.plans.run import Run, StaleError
from tests.test_operators import PLAN, good_read

ABSTRACT = "This is a real abstract with many more than eight words and over fifty characters."


def papers(spark, first, n, year):
    rows = [(f"A Paper {i}", ABSTRACT, ["A B"], f"{year}-01-01", "https://x", None, "ACL", {"doi": f"10.1/{i}"}) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "title string, abstract string, authors array<string>, published string, url string, pdf_url string, venue string, identifiers map<string,string>")


def focused(stop, **more):
    plan = json.loads(json.dumps(PLAN))
    plan["workflow"] = {"mode": "focused", "rationale": "r", "research_question": "q", "stop_after": stop, **more}
    plan["sources"] = plan["sources"][:2]
    return plan


def test_full_run(spark, tmp_path):
    run = Run(spark, str(tmp_path / "run"))
    assert run.metadata(focused("recommendation", shortlist_target=2, final_target=1), [papers(spark, 0, 3, 2023), papers(spark, 2, 2, 2023)]) == "complete"
    assert run.state()["counts"] == {"raw_papers": 5, "metadata_papers": 4, "coverage_notices": 2}
    ids = run.table("papers").select("identity")
    part = F.struct(F.lit(30.0).alias("topic_fit"), F.lit(20.0).alias("transferability_potential"), F.lit(10.0).alias("abstract_specificity"))
    scores = ids.select("identity", part.alias("components"), F.lit(60.0).alias("metadata_score"), F.lit("r").alias("reason"), F.lit("u").alias("uncertainty"))
    with pytest.raises(ValueError, match="missing_identity"):
        run.shortlist(scores.limit(1))
    with pytest.raises(PlanError):
        run.shortlist(scores, 7)
    assert [r.identity for r in run.shortlist(scores).orderBy("rank").collect()] == ["doi:10.1/0", "doi:10.1/1"]
    items = spark.createDataFrame([("doi:10.1/0", "ACL", "ready", True, "/t0", {}), ("doi:10.1/1", "ACL", "missing", False, None, {})], f"identity string, venue string, status string, full_text_available boolean, text_path string, attempts map<string,array<{ATTEMPT}>>")
    assert run.fulltext(items) == "complete_with_gaps"
    assert run.reading_batches().count() == 1
    read = good_read().replace("# A Paper", "# A Paper 0")
    texts = lambda t: spark.createDataFrame([("doi:10.1/0", t, "/r0", 1)], "identity string, text string, read_path string, position int")
    assert run.validate_reads(texts(read.replace("$x=1$", ""))) == "partial"
    assert run.validate_reads(texts(read)) == "complete"
    card = spark.createDataFrame([("doi:10.1/0", 8.0, 7.0, 15.0, "s", ["d"], ["l"], ["b"], "high", "/t0", "/r0")], "identity string, match_score double, transferability_score double, final_score double, summary string, decisive_evidence array<string>, limitations array<string>, borrowable_elements array<string>, confidence string, full_text_path string, read_path string")
    with pytest.raises(ValueError, match="wrong_full_text_path"):
        run.finalize(card.withColumn("full_text_path", F.lit("/other")))
    assert run.finalize(card).first().final_score == 15.0
    with pytest.raises(ValueError):
        run.complete("too short")
    run.complete("A Paper 0 " * 30)
    assert run.state()["status"] == "complete"
    with pytest.raises(StaleError):
        run.log("again")


def test_changed_upstream_is_refused(spark, tmp_path):
    run = Run(spark, str(tmp_path / "run"))
    run.metadata(focused("shortlist"), [papers(spark, 0, 4, 2023), papers(spark, 10, 4, 2022)])
    drawn = run.random_shortlist(2, "s")
    assert drawn.count() == 4
    with pytest.raises(PlanError):
        run.fulltext(drawn)
    run.finish("shortlist")
    other = Run(spark, str(tmp_path / "other"))
    other.metadata(focused("shortlist"), [papers(spark, 0, 4, 2023), papers(spark, 10, 4, 2022)])
    rows = other.table("papers").limit(3).toPandas()
    spark.createDataFrame(rows, other.table("papers").schema).write.mode("overwrite").parquet(f"{other.path}/papers")
    with pytest.raises(StaleError, match="papers has changed"):
        other.random_shortlist(1, "s")


def test_gaps_and_replacements(spark, tmp_path):
    run = Run(spark, str(tmp_path / "run"))
    assert run.metadata(focused("fulltext"), [papers(spark, 0, 6, 2023), papers(spark, 0, 0, 2022)], {1: "no catalog"}) == "complete_with_gaps"
    with pytest.raises(StaleError, match="incomplete"):
        run.random_shortlist(2, "s")
    run = Run(spark, str(tmp_path / "next"))
    run.metadata(focused("fulltext"), [papers(spark, 0, 6, 2023), papers(spark, 20, 1, 2023)])
    first = [r.identity for r in run.random_shortlist(3, "s").collect()]
    items = spark.createDataFrame([(i, "ACL", None, k == 0, "/t", {}) for k, i in enumerate(first)], f"identity string, venue string, status string, full_text_available boolean, text_path string, attempts map<string,array<{ATTEMPT}>>")
    assert run.fulltext(items) == "complete_with_gaps"
    after = {r.identity for r in run.replace_failed().collect()}
    assert len(after) == 3 and first[0] in after and not after & set(first[1:])
