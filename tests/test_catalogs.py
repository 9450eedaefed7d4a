"""Catalogs audited in the pass that writes them, winners merged day by day, warnings on state, XML character data."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import audit, catalogs, dedup, runs, winners
from corpusmill.session import conf
from corpusmill.sources import files
from corpusmill.streaming import days

REAL = "This is a real abstract with many more than eight words and over fifty characters."
KIND = "identity string, title string, abstract string, authors array<string>, url string, pdf_url string, venue string, year int, published date, categories array<string>"


def catalog(spark, n, **change):
    row = {"title": "A title", "abstract": REAL, "authors": ["A"], "url": "https://x", "pdf_url": None, "venue": "ACL", "year": 2024, "published": None, "categories": ["c"]}
    rows = [{"identity": f"k{i}", **row, **(change if i == 0 else {})} for i in range(n)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in KIND.split(", ")) for r in rows], KIND)


def now(month=6):
    return F.lit(f"2024-0{month}-01").cast("timestamp")


@pytest.mark.parametrize(
    "n, change, receipt, status, broken",
    [
        (25, {}, {}, "complete", []),
        (0, {}, {}, "authoritative_empty", []),
        (0, {}, {"discovered": 4}, "incomplete", ["discovered", "completeness"]),
        (25, {"abstract": "short"}, {}, "incomplete", ["abstracts", "completeness"]),
        (25, {"abstract": None}, {}, "incomplete", ["abstracts", "completeness"]),
        (25, {}, {"discovered": 26}, "incomplete", ["discovered"]),
        (25, {}, {"minimum": 26}, "incomplete", ["minimum"]),
        (25, {"year": 2023}, {}, "refused", ["binding"]),
        (25, {"venue": None}, {}, "refused", ["binding"]),
        (25, {"identity": "k1"}, {}, "refused", ["unique", "completeness"]),
        (25, {"title": " "}, {}, "refused", ["completeness"]),
        (25, {"authors": []}, {}, "complete", []),  # 24 of 25 are enough
        (10, {"authors": None}, {}, "refused", ["completeness"]),
        (10, {"categories": []}, {"require_categories": True}, "refused", ["completeness"]),
        (25, {}, {"status": "partial"}, "refused", ["receipt"]),
        (25, {}, {"exhaustion_proof": " "}, "refused", ["receipt"]),
    ],
)
def test_every_rule_of_a_catalog(spark, tmp_path, n, change, receipt, status, broken):
    rows = catalog(spark, n, **change)
    got = catalogs.publish(rows, str(tmp_path / "c"), "acl", 2024, catalogs.Receipt(**receipt), now())
    assert (got.status, got.broken) == (status, broken) and (got.path is not None) == (status == "complete")
    assert [p for p in (tmp_path / "c").rglob("*.parquet") if "_aside" in str(p)] == []  # nothing is left aside
    record = catalogs.records(spark, str(tmp_path / "c")).first()
    assert (record.status, record.record_count) == (status, n)
    if n:
        whole = audit.venue_audit(rows.withColumn("identity", F.col("identity")), None, receipt.get("require_categories", False)).first()
        assert whole.metadata_completeness_ok == ("completeness" not in broken)


def test_rows_are_evaluated_once_and_the_newest_catalog_counts(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    at = str(tmp_path / "c")
    assert catalogs.current(spark, at, "acl", 2024) is None
    catalogs.publish(catalog(spark, 30).mapInArrow(count, KIND), at, "acl", 2024, catalogs.Receipt(), now())
    assert seen.value == 30
    catalogs.publish(catalog(spark, 21), at, "acl", 2024, catalogs.Receipt(), now(7))
    catalogs.publish(catalog(spark, 40, abstract=""), at, "acl", 2024, catalogs.Receipt(), now(8))
    assert catalogs.current(spark, at, "acl", 2024).count() == 21 and catalogs.records(spark, at).count() == 3


def test_two_receipts_count_for_nothing(spark):
    receipt = spark.createDataFrame([("complete", True, "all", 3, 3, [2024], [2024], "acl", 1, "a")] * 2, "status string, complete_catalog boolean, exhaustion_proof string, count long, discovered_count long, requested_years array<int>, effective_years array<int>, channel string, schema_version int, adapter string")
    rows = catalog(spark, 3).withColumn("source_type", F.lit("venue"))
    assert audit.catalog_contract(rows, receipt.limit(1), "acl", 2024).first().complete is True
    assert audit.catalog_contract(rows, receipt, "acl", 2024).first().receipt_ok is False
    assert audit.catalog_contract(rows, receipt.limit(0), "acl", 2024).first().complete is False


def test_days_merged_in_any_order(spark, tmp_path):
    r = random.Random(9)
    rows = [(f"k{r.randrange(40)}" if r.random() < 0.95 else None, r.choice((None, "", "a  b", "ab", "abc", "xyz")), r.randrange(3), i) for i in range(300)]
    df = spark.createDataFrame(rows, "identity string, abstract string, _source_index int, _source_pos long").withColumns({"key": F.lit("clash"), "bucket": F.lit(1)})
    at = str(tmp_path / "w")
    assert winners.winners(spark, at) is None
    order = [0, 1, 2, 3, 4]
    r.shuffle(order)
    for day in [*order, order[1]]:
        winners.merge(df.where(F.col("_source_pos") % 5 == day), at, 8)
    assert winners.merge(df.limit(0), at, 8) == []
    whole = dedup.keep_longest_abstract(df)
    names = [*df.columns, "first_position"]
    assert {tuple(x) for x in winners.winners(spark, at).select(names).collect()} == {tuple(x) for x in whole.select(names).collect()}


def test_a_merge_touches_the_buckets_of_its_keys(spark, tmp_path):
    at = str(tmp_path / "w")
    df = spark.range(400).select(F.concat(F.lit("k"), "id").alias("identity"), F.lit("t").alias("abstract"), F.lit(0).alias("_source_index"), F.col("id").alias("_source_pos"))
    assert winners.merge(df, at, 16) == list(range(16))
    before = winners._records(spark, at)
    touched = winners.merge(df.where("_source_pos < 2").withColumn("abstract", F.lit("longer")), at, 16)
    after = winners._records(spark, at)
    assert 1 <= len(touched) <= 2 and {b for b in before if before[b] != after[b]} == set(touched)
    assert winners.winners(spark, at).where("abstract = 'longer'").count() == 2
    assert winners.winners(spark, at).count() == 400


def test_snapshots_out_of_order_over_batches(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"r{i % 3}", 1_704_067_200 + 600 * (i // 2), i, f"s{i}", sorted({r.choice("abcd") for _ in range(r.randrange(4))}) if i % 11 else None) for i in range(200)]
    snaps = spark.createDataFrame(rows, "run_id string, s long, seq long, stage string, warnings array<string>").select("run_id", F.timestamp_seconds("s").alias("at"), "seq", "stage", "warnings")
    arrival = sorted(rows, key=lambda x: x[1] + r.randrange(9000))
    for k in range(0, 200, 40):
        ids = [x[2] for x in arrival[k : k + 40]]
        snaps.where(F.col("seq").isin(ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = spark.createDataFrame([("other", 1_704_067_200 + 40 * 86400, 999, "end", [])], "run_id string, s long, seq long, stage string, warnings array<string>")
    last.select("run_id", F.timestamp_seconds("s").alias("at"), "seq", "stage", "warnings").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with conf(spark, "spark.sql.streaming.stateStore.providerClass", days.STATE_STORE):
        stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = days.ordered_warnings(stream, "3 hours")
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((x.run_id, x.stage, x.action, x.message) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = runs.warning_history(snaps.withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>"))))
    assert got == sorted((x.run_id, x.stage, x.action, x.message) for x in batch.collect()) and len(got) > 100


def test_a_batch_of_snapshots_costs_few_state_calls(spark):
    """The list of what waits is written once for all of a batch and read once for all that are ready."""
    from types import SimpleNamespace as N

    calls, held, timers, mark = [], [], set(), 10_000
    waiting = N(appendList=lambda x: (calls.append("append"), held.extend(x)), get=lambda: (calls.append("get"), list(held))[1], put=lambda x: (calls.append("put"), held.clear(), held.extend(x)), clear=held.clear)
    active = N(exists=lambda: False, get=lambda: None, update=lambda x: None)
    p = days._warnings_processor()
    p.init(N(getListState=lambda *a: waiting, getValueState=lambda *a: active, registerTimer=timers.add))
    rows = [N(at_us=1000 * (2500 - i) * 8, seq=i, stage=str(i), warnings=[f"w{i % 7}"]) for i in range(2500)]
    assert list(p.handleInputRows(("r",), iter(rows), None)) == [] and calls == ["append"] and len(held) == 3 and timers == {8}
    out = list(p.handleExpiredTimer(("r",), N(getCurrentWatermarkInMs=lambda: mark), None))
    assert calls == ["append", "get", "put"] and timers == {8, 10_008}  # the earliest that still waits
    assert len(out) == 2 * 1250 - 1 and [r.at_us for r in out] == sorted(r.at_us for r in out)


def test_character_data(spark):
    cases = {
        "<p>x &lt; y &amp; z</p><p><![CDATA[kept text]]></p>": "x < y & z\nkept text",
        "<a><![CDATA[one]]><![CDATA[ & <two>]]></a>": "one & <two>",
        "<a><![CDATA[not closed &amp; <b>": "not closed &amp; <b>",
        "<a>&#x41;&#66;&eacute; &nope; a&amp;lt;b</a>": "ABé &nope; a&lt;b",
        "<!DOCTYPE a [<!ENTITY x 'y'>]><?pi <p>?><!-- <a> & -->t": "t",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string").select("v", files.article_text(F.col("v")).alias("t"))
    assert {r.v: r.t or "" for r in df.collect() if r.v is not None} == cases
