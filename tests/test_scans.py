"""Scans over ranges against loops: lineage of any depth, spacing and cooldowns, rolling counts, numbered reads."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import reads, runs, scans


def test_chain_of_a_thousand(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("run_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_run_id"))
    found = runs.lineage(df)
    assert found.count() == 999 * 1000 // 2
    last = sorted(found.where("run_id = '999'").collect(), key=lambda r: r.distance)
    assert [(r.ancestor, r.distance) for r in last] == [(str(999 - d), d) for d in range(1, 1000)]


def test_lineage_of_cycles_orphans_and_none(spark):
    kind = "run_id string, parent_run_id string"
    with pytest.raises(ValueError, match="own ancestors: b, c, d"):
        runs.lineage(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", None)], kind))
    with pytest.raises(ValueError, match="own ancestors: s"):
        runs.lineage(spark.createDataFrame([("s", "s")], kind))
    rows = spark.createDataFrame([("a", "gone"), ("b", "a"), ("b", "a"), (None, "a"), ("c", None)], kind)
    assert {tuple(r) for r in runs.lineage(rows).collect()} == {("a", "gone", 1), ("b", "a", 1), ("b", "gone", 2)}
    assert runs.lineage(rows.limit(0)).count() == 0


def test_inherited_locks(spark):
    up = runs.lineage(spark.createDataFrame([(f"r{i}", f"r{i - 1}" if i else None) for i in range(12)], "run_id string, parent_run_id string"))
    rows = [("r0", "mode", "fast", True), ("r2", "mode", "deep", True), ("r3", "mode", "fast", False), ("r0", "free", "x", False), ("r11", "mode", "deep", False)]
    settings = spark.createDataFrame(rows, "run_id string, name string, value string, locked boolean")
    held = {(r.run_id, r.name): (r.value, r.origin) for r in runs.inherited(settings, up).collect()}
    assert held == {("r1", "mode"): ("fast", "r0"), ("r2", "mode"): ("fast", "r0"), **{(f"r{i}", "mode"): ("deep", "r2") for i in range(3, 12)}}
    assert {r.run_id for r in runs.broken_locks(settings, up).collect()} == {f"r{i}" for i in range(1, 11)}


@pytest.fixture(scope="module")
def requests(spark):
    r = random.Random(5)
    rows, t = [], 0
    for i in range(600):
        t += r.choice((0, 0, 1, 3, 900, 4000)) if i % 50 else 20_000
        service = "busy" if r.random() < 0.7 else r.choice(("a", "b", None))
        rows.append((i, service, t, r.choice((None, None, None, None, 5_000_000, 700_000_000))))
    return spark.createDataFrame(rows, "request_id long, service string, s long, hold long").withColumn("ts", F.timestamp_seconds("s")).repartition(5)


def test_governed_starts_against_a_loop(spark, requests):
    gap = F.when(F.col("service") == "busy", 400_000_000).otherwise(2_000_000)
    found = {r.request_id: (r.starts_at, r.waited) for r in scans.governed_starts(requests, ["service"], gap, F.col("hold")).collect()}
    state, want = defaultdict(int), {}
    for r in sorted(requests.collect(), key=lambda r: (r.s, r.request_id)):
        t = r.s * 1_000_000
        start = max(t, state[r.service])
        state[r.service] = max(start + (400_000_000 if r.service == "busy" else 2_000_000), t + (r.hold or 0))
        want[r.request_id] = (start, start - t)
    assert found == want
    assert any(w for _, w in want.values()) and spark.createDataFrame([], requests.schema).transform(lambda d: scans.governed_starts(d, ["service"], gap, F.col("hold"))).count() == 0


def test_rolling_counts_against_a_loop(requests):
    found = {r.request_id: (r.in_last_hour, r.within_quota) for r in runs.rolling_quota(requests, ["service"], "ts", 9).collect()}
    rows = requests.collect()
    want = {r.request_id: sum(x.service == r.service and r.s - 3600 <= x.s <= r.s for x in rows) for r in rows}
    assert found == {k: (n, n <= 9) for k, n in want.items()}
    assert runs.rolling_quota(requests.limit(0), ["service"]).count() == 0


def test_running_sums_cross_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"), F.lit(2).alias("v"))
    out = scans.running_sum(rows, ["k"], ["n"], "v")
    assert out.where("running <> 2 * (floor(n / 3) + 1)").count() == 0 and out.count() == 5000


def test_no_task_holds_a_whole_group(spark, requests):
    """Windows over rows are within a range; those over a whole service see a row a range."""
    plan = scans.rolling_count(requests, ["service"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    over_rows = [line for line in windows if "sum(__v" in line]
    assert over_rows and all("windowspecdefinition(__range" in line for line in over_rows)
    assert all("__t" in line for line in windows if line not in over_rows)
    numbered = reads.aggregate_reads(spark.range(50).select(F.concat(F.lit("# T"), "id").alias("text"), F.col("id").alias("position")))
    assert "Window" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    assert [r.part.split("\n")[0] for r in numbered.orderBy("n").collect()] == [f"## {i + 1:03d}. T{i}" for i in range(50)]
