"""Staged pages as a stream, and day shards written in two phases."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.session import pushed_filters
from corpusmill.sources import scholarly, staged, store

PAGE = "key string, start long, total long, items string"


def stage(spark, at, rows):
    spark.dataSource.register(staged.StagedPages)
    spark.createDataFrame(rows, PAGE).repartition(3).write.format("staged_pages").option("path", f"{at}/s").mode("append").save()


def published(spark, at, **options):
    out = staged.publish(spark, f"{at}/s", f"{at}/out", f"{at}/state", **options)
    return sorted((r.key, r.position, r.item) for r in out.collect())


def test_a_broken_off_listing_goes_on(spark, tmp_path):
    stage(spark, tmp_path, [("cat:cs.AI [2024]", 0, 5, '[{"t": "ä"}, 2]'), ("b", 0, 9, "[1]"), ("b", 4, 9, "[5]")])
    one = [("b", 0, "1"), ("cat:cs.AI [2024]", 0, '{"t": "ä"}'), ("cat:cs.AI [2024]", 1, "2")]
    assert published(spark, tmp_path) == one and staged.staged(f"{tmp_path}/s") == {"b": [(4, 1)]}
    assert published(spark, tmp_path) == one  # nothing new: nothing twice
    stage(spark, tmp_path, [("cat:cs.AI [2024]", 2, 5, "[3, 4]"), ("cat:cs.AI [2024]", 4, 5, "[5]"), ("b", 1, 9, "[2, 3, 4]"), ("b", 5, 9, "[]")])
    out = published(spark, tmp_path, pagesPerBatch="1")  # a page of each key a batch
    assert [x for x in out if x[0] == "b"] == [("b", i, str(i + 1)) for i in range(5)] and len(out) == 10
    assert staged.staged(f"{tmp_path}/s") == {}


def test_pages_that_are_refused_stay(spark, tmp_path):
    stage(spark, tmp_path, [("a", 0, 4, "[1]"), ("a", 1, 5, "[2]")])
    with pytest.raises(Exception, match="total of a changed from 4 to 5"):
        published(spark, tmp_path)
    assert staged.staged(f"{tmp_path}/s") == {"a": [(0, 1), (1, 1)]}
    assert len(published(spark, tmp_path, growing="true")) == 2  # the same batch again, under the other rule
    stage(spark, tmp_path, [("big", 0, 10_000, "[1]")])
    with pytest.raises(Exception, match="ask for it in parts"):
        published(spark, tmp_path, ceiling="10000")
    store.write(f"{tmp_path}/t/x/0-1.json", b'{"schema_version": 1, "key": "x", "start": 0, "total": 1, "items": []}')
    with pytest.raises(Exception, match="page 0 of x is invalid"):
        staged.publish(spark, f"{tmp_path}/t", f"{tmp_path}/out2", f"{tmp_path}/state2")
    assert published(spark, tmp_path / "none") == []


def test_batches_list_their_folder_once(tmp_path, monkeypatch):
    """What waits is listed when a reader begins and when what it knows is used up; many keys share a task."""
    for key in range(20):
        for start in range(8):
            page = {"schema_version": 1, "key": f"k{key}", "start": start, "total": 8, "items": [start]}
            store.write(f"{tmp_path}/k{key}/{start}-1.json", json.dumps(page).encode())
    listed, list_ = [], staged.staged
    monkeypatch.setattr(staged, "staged", lambda path: listed.append(path) or list_(path))
    reader = staged.PageReader({"path": str(tmp_path), "pagesPerBatch": "2", "tasks": "3"})
    at, rows, batches = reader.initialOffset(), [], 0
    while (to := reader.latestOffset()) != at:
        parts = reader.partitions(at, to)
        assert len(parts) == 3
        rows += [(r[0], r[1]) for p in parts for r in reader.read(p)]
        reader.commit(to)
        at, batches = to, batches + 1
    assert batches == 4 and len(listed) == 2 and list_(str(tmp_path)) == {}
    assert sorted(rows) == sorted((f"k{key}", i) for key in range(20) for i in range(8))


def test_keys_as_folders():
    for key in ("a/b", "..", "x=y", "ä ö%2F", "plain-1_2.3", ""):
        assert staged.key_of(staged.folder_of(key)) == key and "/" not in staged.folder_of(key)


ROWS = "category string, day date, title string, abstract string, authors array<string>, url string, pdf_url string, identifiers map<string,string>"


def papers(spark, n, days=3):
    spark.dataSource.register(scholarly.ScholarlySource)
    made = spark.range(n).select(F.lit("cs.AI").alias("category"), F.expr(f"date_add(DATE'2024-01-01', cast(id % {days} as int))").alias("day"), F.concat(F.lit("T"), "id").alias("title"), F.lit("A").alias("abstract"), F.array(F.lit("N")).alias("authors"))
    return made.withColumn("identifiers", F.create_map(F.lit("arxiv_id"), F.col("title")))


OPTIONS = {"source": "arxiv", "categories": "cs.AI", "start": "2024-01-01", "end": "2024-01-06", "now": "2024-01-05T12:00:00"}


def test_days_of_many_tasks_and_empty_days(spark, tmp_path):
    papers(spark, 40).repartition(4).write.format("scholarly").options(path=str(tmp_path), **OPTIONS).mode("append").save()
    names = sorted(p.name for p in (tmp_path / "arxiv" / "cs.AI").glob("*.json"))
    assert names == [*[f"2024-01-0{d}.json" for d in range(1, 7)], "index.json"]  # empty days too
    assert json.loads((tmp_path / "arxiv/cs.AI/index.json").read_text()) == {"2024-01-01": 14, "2024-01-02": 13, "2024-01-03": 13, "2024-01-04": 0, "2024-01-05": 0, "2024-01-06": 0}
    scan = scholarly.scan(spark, path=str(tmp_path), **OPTIONS)
    assert scan.where("status = 'ok'").count() == 40
    assert {r.day.day: r.status for r in scholarly.to_fetch(scan).collect()} == {5: "stale", 6: "stale"}  # not closed yet
    # again, with other rows: replaced, and nothing of the first writing is left
    papers(spark, 6, 2).write.format("scholarly").options(path=str(tmp_path), **OPTIONS).mode("append").save()
    assert scan.where("status = 'ok'").count() == 6
    parts = {p for f in (tmp_path / "arxiv/cs.AI").glob("2*.json") for p in json.loads(f.read_text())["parts"]}
    assert {str(p.relative_to(tmp_path / "arxiv/cs.AI")) for p in (tmp_path / "arxiv/cs.AI").rglob("*.jsonl")} == parts


def test_a_failed_task_leaves_no_shard(spark, tmp_path):
    bad = papers(spark, 30).withColumn("day", F.when(F.col("title") != "T29", F.col("day"))).repartitionByRange(3, "title")
    with pytest.raises(Exception, match="belongs to no shard"):
        bad.write.format("scholarly").options(path=str(tmp_path), **OPTIONS).mode("append").save()
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_many_days_in_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scholarly, "MOST_OPEN", 2)
    writer = scholarly.ShardWriter({"path": str(tmp_path), "now": "2025-01-01T00:00:00"})
    message = writer.write(iter(papers(spark, 30, 5).collect()))
    assert len(message.files) > 5  # files were closed and the days got more parts
    writer.commit([message])
    reader = scholarly.ShardReader({"path": str(tmp_path), "categories": "cs.AI", "start": "2024-01-01", "end": "2024-01-05", "now": "2025-01-01T00:00:00"})
    assert sorted(row[6] for p in reader.partitions() for row in reader.read(p)) == sorted(f"T{i}" for i in range(30))
    (tmp_path / "arxiv/cs.AI" / message.files[0][2]).unlink()
    assert any(row[3] == "invalid" for p in reader.partitions() for row in reader.read(p))  # a shard whose part is gone


def test_parts_of_rows_in_any_order(spark, tmp_path, monkeypatch):
    """A task whose days come in turn writes a part a day, and more only of days that fill what it may hold."""
    rows = papers(spark, 1000, 100).collect()
    write = lambda: scholarly.ShardWriter({"path": str(tmp_path), "now": "2025-01-01T00:00:00"}).write(iter(rows))
    assert len(write().files) == 100
    line = len(open(next(tmp_path.rglob("*.jsonl"))).readline())
    monkeypatch.setattr(scholarly, "MOST_HELD", 400 * line)
    files = write().files
    assert 100 < len(files) < 300 and sum(n for *_, n in files) == 1000
    assert sum(len(list(open(tmp_path / "arxiv/cs.AI" / name))) for _, _, name, _ in files) == 1000


def test_filters_open_fewer_shards(spark, tmp_path, monkeypatch):
    papers(spark, 60, 6).write.format("scholarly").options(path=str(tmp_path), **{**OPTIONS, "now": "2024-02-01T00:00:00"}).mode("append").save()
    opened = []
    read = store.read_json
    monkeypatch.setattr(store, "read_json", lambda path: opened.append(path) or read(path))

    def days(*filters):
        reader = scholarly.NarrowedReader({"path": str(tmp_path), **OPTIONS, "now": "2024-02-02T00:00:00"})
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies all of them again
        opened.clear()
        rows = [row for p in reader.partitions() for row in reader.read(p)]
        return len(rows), sum("/2024-" in p for p in opened)

    import datetime as dt

    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    day = lambda d: dt.date(2024, 1, d)
    assert days() == (60, 6)
    assert days(GreaterThan(("day",), day(2)), LessThanOrEqual(("day",), day(4))) == (20, 2)
    assert days(In(("day",), (day(1), day(6)))) == (20, 2)
    assert days(EqualTo(("category",), "cs.LG")) == (0, 0)
    assert days(StringContains(("title",), "T1")) == (60, 6)
    assert days(EqualTo(("status",), "stale")) == (60, 6)
    with pushed_filters(spark):
        scan = scholarly.scan(spark, path=str(tmp_path), **{**OPTIONS, "now": "2024-02-02T00:00:00"})
        assert scan.where("day > DATE'2024-01-02' AND day <= DATE'2024-01-04' AND title <> 'T2'").count() == 19
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "false"


def test_a_day_above_the_ceiling_is_read_whole(spark, tmp_path):
    """A day with more rows than a range may have is a range of its own, checked and read in two passes; one with a paper twice stays invalid."""
    papers(spark, 40).write.format("scholarly").options(path=str(tmp_path), **{**OPTIONS, "now": "2024-02-01T00:00:00"}).mode("append").save()
    want = {**OPTIONS, "now": "2024-02-02T00:00:00"}
    whole = sorted(map(str, scholarly.scan(spark, path=str(tmp_path), **want).collect()))
    assert len(whole) >= 40 and sorted(map(str, scholarly.scan(spark, path=str(tmp_path), **want, ceiling="2").collect())) == whole
    day = next(p for p in sorted(tmp_path.rglob("20*.json")) if json.loads(p.read_text())["parts"])
    envelope = json.loads(day.read_text())
    twice = {**envelope, "parts": envelope["parts"] * 2, "row_count": envelope["row_count"] * 2}
    for changed in (twice, {**envelope, "row_count": envelope["row_count"] + 1}):
        day.write_text(json.dumps(changed))
        for ceiling in ("2", "10000"):
            told = scholarly.to_fetch(scholarly.scan(spark, path=str(tmp_path), **want, ceiling=ceiling)).collect()
            assert [(r.day.isoformat(), r.status) for r in told] == [(day.stem, "invalid")]
