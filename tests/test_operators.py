"""Operators on small tables made here: contracts, ties, nulls and empty inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import audit, dedup, enrich, fulltext, reads, records, runs, sample, score, shards
from corpusmill.plans import plan as P
from corpusmill.sources import files, pages
from corpusmill.streaming import days

D = dt.date


def test_identity_precedence(spark):
    rows = [
        ("T", ["A B"], None, 2020, {"doi": " 10.1/X ", "arxiv_id": "1"}),
        ("T", ["A B"], None, 2020, {"doi": "", "arxiv_id": "2401.1"}),
        ("T &amp; U", ["A B", None], "2021-02-03", None, {}),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "title string, authors array<string>, published string, year int, identifiers map<string,string>").withColumn("abstract", F.lit("x"))
    found = [r.identity for r in records.normalize(df, "venue").select("identity").collect()]
    assert found == ["doi:10.1/x", "arxiv_id:2401.1", "title:tu|author:ab|year:2021", "title:|author:|year:"]


def test_keep_longest_takes_first_of_ties(spark):
    df = spark.createDataFrame([("k", "aa", 0, 5), ("k", "bbb", 0, 7), ("k", "ccc", 0, 6), ("m", None, 1, 1)], "identity string, abstract string, _source_index int, _source_pos long")
    found = {r.identity: (r.abstract, r.first_position._source_pos) for r in dedup.keep_longest_abstract(df).collect()}
    assert found == {"k": ("ccc", 5), "m": (None, 1)}
    assert dedup.keep_longest_abstract(df.limit(0)).count() == 0


def test_latest_version_compares_numbers(spark):
    rows = [("d", "2", "x", 0), ("d", "10", "y", 1), ("d", "v", "z", 2)]
    df = spark.createDataFrame(rows, "identity string, version string, abstract string, _source_pos long").withColumns({"published": F.lit(None).cast("date"), "_source_index": F.lit(0)})
    assert dedup.latest_version(df).first().version == "10"


def test_audit_bounds(spark):
    good = "This is a real abstract with more than eight words and fifty characters."
    rows = [(str(i), f"Title {i}", good, ["A"] if i else [], "https://x", None) for i in range(20)]
    df = spark.createDataFrame(rows, "identity string, title string, abstract string, authors array<string>, url string, pdf_url string")
    assert audit.venue_audit(df).first().metadata_completeness_ok is True  # 19 of 20 have authors
    assert audit.venue_audit(df.where("identity > '1'")).first().metadata_completeness_ok is True
    assert audit.venue_audit(df.limit(0)).first().metadata_completeness_ok is False
    assert audit.venue_audit(df.unionByName(df.limit(1))).first().duplicate_count == 1


def test_score_rules(spark):
    part = "struct<topic_fit:double,transferability_potential:double,abstract_specificity:double>"
    rows = [("a", 60.0, (30.0, 20.0, 10.0), "r", "u"), ("b", 60.02, (30.0, 20.0, 10.0), "r", "u"), ("c", 60.01, (30.0, 20.0, 10.0), " ", "u"), ("x", 10.0, (60.0, 0.0, 0.0), "r", None), ("a", 60.0, (30.0, 20.0, 10.0), "r", "u")]
    scores = spark.createDataFrame(rows, f"identity string, metadata_score double, components {part}, reason string, uncertainty string")
    papers = spark.createDataFrame([(k,) for k in "abcd"], "identity string")
    found = {(r.identity, r.violation) for r in score.score_violations(scores, papers).collect()}
    assert found == {("a", "duplicate_identity"), ("b", "sum_differs"), ("c", "missing_reason"), ("x", "component_out_of_bounds"), ("x", "missing_uncertainty"), ("x", "foreign_identity"), ("d", "missing_identity")}


def test_sampling_is_exact_stable_and_never_repeats(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("identity"), (F.col("id") % 4).alias("s"))
    a = {r.identity for r in sample.stratified_sample(df, ["s"], 5, "x").collect()}
    b = {r.identity for r in sample.stratified_sample(df.repartition(7), ["s"], 5, "x").collect()}
    assert a == b and len(a) == 20
    drawn = sample.stratified_sample(df, ["s"], 5, "x")
    ready = drawn.where("draw <= 2")
    again = sample.replacement_sample(df, ready, drawn, ["s"], 5, "x", 1).collect()
    fresh = {r.identity for r in again if r.origin == "replacement"}
    assert len(again) == 20 and not fresh & a and len(fresh) == 12
    assert sample.short_strata(df, ["s"], 26).count() == 4


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 11])
def test_batches(spark, n):
    found = [r.batch for r in sample.balanced_batches(spark.range(n).select(F.col("id").alias("i")), [F.col("i")]).orderBy("position").collect()]
    sizes = [found.count(b) for b in (1, 2, 3)]
    assert found == sorted(found) and sum(sizes) == n and sizes == sorted(sizes, reverse=True) and max(sizes) - min(sizes) <= 1


def test_enrichment(spark):
    cols = "title string, doi string, abstract string, pdf_url string, authors array<string>"
    long = "x" * 90
    rows = spark.createDataFrame([("A b", "10.1/a", "", None, ["Z Q"]), ("C", "10.1/c", "", None, []), ("D", "", "own", None, [])], cols)
    index = spark.createDataFrame([("a B!", "10.1/other", long, "u1", []), ("A B", None, long + "y", "u2", []), ("zzz", "10.1/C", long, "u3", []), ("d", "", long, "u4", [])], cols)
    found = {r.title: (r.abstract, r.pdf_url) for r in enrich.fill_by_title_or_doi(rows, index).collect()}
    assert found == {"A b": (long + "y", "u2"), "C": (long, "u3"), "D": ("own", "u4")}
    both = enrich.fill_by_doi_and_title(rows, index.withColumn("doi", F.lit("10.1/A")))
    assert {r.title: r.pdf_url for r in both.collect()}["C"] is None


def test_routing_and_links(spark):
    df = spark.createDataFrame([("SIGKDD", None), ("NeurIPS 2024", None), (None, "https://www.biorxiv.org/x"), (None, None)], "v string, u string")
    assert [r[0] for r in df.select(records.channel([F.col("v")], [F.col("u")])).collect()] == ["kdd", "neurips", "biorxiv", None]
    urls = ["https://export.arxiv.org/a", "https://dblp.org/x", "https://A.B_c:80/x", "none", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(records.service(F.col("u"))).collect()]
    assert got == ["arxiv", "dblp", "host-a.b_c", "generic", "generic"]


def test_aliases(spark):
    df = spark.createDataFrame([("Ti", ["A"], 2020, None, {"doi": "10.1/X"}, "u", None)], "title string, authors array<string>, year int, published date, identifiers map<string,string>, url string, pdf_url string")
    found = df.select(records.cache_aliases(F.lit("acl"))).first()[0]
    assert found == ["channel:acl|doi:10.1/x", "channel:acl|url:u", "channel:acl|title:ti|author:a|year:2020"]
    hit = lambda a, b: spark.range(1).select(records.alias_hit(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    assert hit(["c|doi:1", "c|url:u"], ["c|url:u"]) is True
    assert hit(["c|doi:1", "c|url:u"], ["c|doi:2", "c|url:u"]) is False


def test_attempts(spark):
    schema = f"identity string, venue string, attempts map<string,array<{fulltext.ATTEMPT}>>, full_text_available boolean, status string"
    a = lambda **k: tuple(k.get(n) for n in ("kind", "url", "status_code", "accepted", "reason", "status", "error_type", "message"))
    rows = [("1", "V", {"pdf": [a(kind="pdf", url="https://openreview.net/x", status_code=403), a(kind="pdf", status_code=200, accepted=True, url="https://ok")]}, True, None), ("2", None, {"pdf": [], "html": None}, False, "missing")]
    items = spark.createDataFrame(rows, schema)
    found = {r.identity: (r.retryable_after_cooldown, r.reasons, r.cooldown_services) for r in fulltext.transient(items).collect()}
    assert found == {"1": (True, ["openreview_403_challenge"], ["openreview"]), "2": (False, [], [])}
    assert {r.failure_step: r["count"] for r in fulltext.failure_histogram(items).collect()} == {"pdf:403": 1, "item:missing": 1}
    assert [r[0] for r in items.orderBy("identity").select(fulltext.accepted_pdf_url(F.col("attempts"), F.lit("own"))).collect()] == ["https://ok", "own"]


def good_read():
    body = {"摘要": "本文研究图神经网络的方法与应用。", "动机与核心创新": "动机：" + "动" * 100 + "核心创新：" + "新" * 110, "方法": "方" * 320 + " $x=1$ ", "实验结果": "果" * 40, "优缺点总结": "优" * 40}
    return "# A Paper\n- **来源：** ACL 2024\n- **论文链接：** URL：u；PDF：p\n" + "".join(f"## {k}\n{v}\n" for k, v in body.items())


def test_read_rules(spark):
    texts = [good_read(), good_read().replace("# A Paper", "# Other"), good_read().replace("$x=1$", "$x"), good_read().replace("## 方法", "## 别的"), ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(reads.read_errors(F.col("t"), F.lit("A paper"), F.lit("An English abstract."))).collect()]
    assert found[0] == []
    assert found[1] == ["title_line"]
    assert "formula_runs_over_line" in found[2]
    assert "sections" in found[3]
    assert len(found[4]) > 5


def test_front_matter(spark):
    text = "# Old\n- **来源：** x\n- **来源：** y\nbody $5\n"
    got = spark.range(1).select(reads.normalize_front_matter(F.lit(text), F.lit("New $1"), F.lit("ACL"), F.lit("2024-05-01"), F.lit("http://u"), F.lit(""))).first()[0]
    assert got == "# New $1\n- **来源：** ACL 2024\n- **来源：** y\nbody $5\n"


def test_aggregate(spark):
    df = spark.createDataFrame([(2, "# B\nx\n## S\ny\n"), (1, "# A\nz")], "position int, text string")
    assert [r.part for r in reads.aggregate_reads(df).orderBy("n").collect()] == ["## 001. A\n\nz\n", "## 002. B\n\nx\n### S\ny\n"]


def test_shard_rules(spark, tmp_path):
    as_of, now = F.lit("2024-01-10").cast("date"), F.lit("2024-01-10 12:00:00").cast("timestamp")
    rows = [("arxiv", D(2024, 1, 1), "2024-01-09 00:00:00"), ("arxiv", D(2024, 1, 2), "2023-12-01 00:00:00"), ("biorxiv", D(2024, 1, 1), "2023-12-01 00:00:00"), ("biorxiv", D(2024, 1, 9), "2024-01-08 00:00:00"), ("biorxiv", D(2024, 1, 8), "2024-01-10 00:00:00"), ("arxiv", D(2024, 1, 10), "2024-01-10 00:00:00")]
    m = spark.createDataFrame(rows, "source string, date date, f string").select("source", "date", F.col("f").cast("timestamp").alias("fetched_at"), F.lit(2).alias("schema_version"), F.lit("p").alias("exhaustion_proof"), F.lit(3).alias("server_total"), F.lit(3).alias("row_count"))
    m = shards.with_status(m, as_of, "date")
    assert {r.date.day for r in shards.usable(m, "arxiv", as_of, now).collect()} == {1}
    assert {r.date.day for r in shards.usable(m, "arxiv", as_of, now, "only").collect()} == {1, 2}
    assert {r.date.day for r in shards.usable(m, "biorxiv", as_of, now).collect()} == {1, 8}
    assert shards.usable(m, "arxiv", as_of, now, "refresh").count() == 0
    data = spark.createDataFrame([(D(2024, 1, 1), 1), (D(2024, 1, 2), 2)], "day date, x int")
    wanted = shards.day_range(spark, "2024-01-01", "2024-01-03")
    path = str(tmp_path / "t")
    shards.publish(data, shards.manifest_of(data, wanted, as_of, ["day"]), path, ["day"])
    shards.publish(data.where("x = 2").withColumn("x", F.lit(9)), shards.manifest_of(data, wanted, as_of, ["day"]), path, ["day"])
    assert sorted(r.x for r in shards.read_range(spark, path, "2024-01-01", "2024-01-31").collect()) == [1, 9]
    assert shards.manifest(spark, path, ["day"]).count() == 3 and shards.manifest(spark, path, ["day"]).where("row_count = 0").count() == 1
    assert shards.bisect({"a": 6000, "b": 6000, "c": 10}, 0, 2, ["a", "b", "c"]) == [("a", "a"), ("b", "b"), ("c", "c")]
    with pytest.raises(ValueError):
        shards.bisect({"a": 10_000}, 0, 0, ["a"])


def test_streamed_days_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for i, half in enumerate(("event_id < 500", "event_id >= 500")):
        events.where(half).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = days.daily_counts(stream, ["event_type"]).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.day, r.event_type): r.row_count for r in spark.table("closed").collect()}
    batch = {(r.day, r.event_type): r["count"] for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").count().collect()}
    last = max(d for d, _ in batch)
    assert got and all(batch[k] == v for k, v in got.items())
    assert {k for k in batch if k[0] < last - dt.timedelta(days=4)} <= set(got)


def test_warning_log_stream(spark, tmp_path):
    rows = [("r", "2024-01-01 00:00:00", "s1", ["a", "b"]), ("r", "2024-01-02 00:00:00", "s2", ["b", "c"])]
    snaps = spark.createDataFrame(rows, "run_id string, at string, stage string, warnings array<string>").withColumn("at", F.col("at").cast("timestamp"))
    snaps.write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(snaps.schema).parquet(str(tmp_path / "w"))
    q = days.warning_log(stream).writeStream.format("memory").queryName("warned").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {("raised", "a"), ("raised", "b"), ("raised", "c"), ("resolved", "a")}
    assert {(r.action, r.message) for r in spark.table("warned").collect()} == want
    batch = runs.warning_history(snaps.withColumn("seq", F.lit(0)))
    assert {(r.action, r.message) for r in batch.collect()} == want


def test_lineage_and_retry(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "run_id string, parent_run_id string")
    assert {(r.run_id, r.ancestor, r.distance) for r in runs.lineage(df).collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}
    values = spark.createDataFrame([("7",), ("999999",), ("Wed, 10 Jan 2024 12:00:30 GMT",), ("x",)], "v string")
    got = [r[0] for r in values.select(runs.retry_after(F.col("v"), F.lit("2024-01-10 12:00:00").cast("timestamp"))).collect()]
    assert got[:3] == [7, 86400, 30]


PLAN = {
    "request_scope": {"user_specified_time": False, "user_specified_channels": False, "as_of_date": "2024-08-31"},
    "channel_decisions": [{"channel": c, "decision": "include", "reason": "r"} for c in ("NeurIPS/NIPS", "ICLR", "ICML", "arXiv")],
    "sources": [{"type": "venue", "venue_id": v, "years": [2023], "complete_catalog": True, "latest_usable_year": True} for v in ("neurips", "iclr", "icml", "acl")]
    + [{"type": "arxiv", "start_date": "2024-02-29", "end_date": "2024-08-31"}],
}


def test_plans():
    assert P.validate(PLAN)["workflow"]["mode"] == "comprehensive"
    assert P.months_before("2024-08-31") == "2024-02-29"
    for change in (
        lambda p: p.pop("sources"),
        lambda p: p["sources"][0].update(limit=5),
        lambda p: p["sources"][0].update(years=[2022, 2023]),
        lambda p: p["sources"][3].update(queries=["x"]),
        lambda p: p["sources"][4].update(start_date="2024-03-01"),
        lambda p: p["request_scope"].update(as_of_date="2024-8-31"),
        lambda p: p["channel_decisions"].pop(),
        lambda p: p.update(workflow={"mode": "focused"}),
        lambda p: p.update(workflow={"reading_preference": "codex_fast"}),
    ):
        broken = json.loads(json.dumps(PLAN))
        change(broken)
        with pytest.raises(P.PlanError):
            P.validate(broken)
    assert P.fingerprint({"a": 1, "b": 2}) == P.fingerprint({"b": 2, "a": 1})
    assert P.stage_allowed({"stop_after": "fulltext"}, "shortlist") and not P.stage_allowed({"stop_after": "fulltext"}, "reading")


def test_atomic_json(tmp_path):
    P.write_json(str(tmp_path / "a/b.json"), {"x": [1]})
    assert json.load(open(tmp_path / "a/b.json")) == {"x": [1]} and len(list((tmp_path / "a").iterdir())) == 1


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/cond-mat/0101001v2</id><title>A
 title</title><summary>S</summary><published>2024-01-02T00:00:00Z</published><author><name>A B</name></author><author><name>C D</name></author>
<link href="http://arxiv.org/abs/x" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/x" rel="related"/><category term="cs.AI"/><category term="cs.LG"/><arxiv:doi>10.1/Z</arxiv:doi></entry></feed>"""


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    r = files.atom(spark, str(tmp_path / "a.xml")).first()
    assert (r.authors, r.published, r.pdf_url, r.categories, r.identifiers) == (["A B", "C D"], D(2024, 1, 2), "http://arxiv.org/pdf/x", ["cs.AI", "cs.LG"], {"arxiv_id": "cond-mat/0101001", "doi": "10.1/Z"})
    assert files.atom(spark, str(tmp_path / "a.xml"), keep_archive=False).first().identifiers["arxiv_id"] == "0101001"
    (tmp_path / "b.json").write_text(json.dumps({"collection": [{"doi": "10.1/b", "title": " T ", "authors": "X; Y", "date": "2024-02-01", "version": "", "category": "c", "abstract": "A"}]}))
    r = files.preprint_json(spark, str(tmp_path / "b.json")).first()
    assert (r.version, r.url, r.published) == ("1", "https://www.biorxiv.org/content/10.1/bv1", D(2024, 2, 1))
    (tmp_path / "o.json").write_text(json.dumps({"notes": [{"id": "n1", "content": {"title": {"value": "T"}, "abstract": {"value": "A"}, "authors": {"value": ["P", "P", "Q"]}, "keywords": ["k"]}}, {"id": "n2", "content": {}}]}))
    r = files.openreview(spark, str(tmp_path / "o.json"), "ICLR", 2024).collect()
    assert len(r) == 1 and r[0].authors == ["P", "Q"] and r[0].categories == ["k"]
    (tmp_path / "v.xml").write_text("<collection><volume id='1'><paper id='3'><title>T one</title><author><first>A</first><last>B</last></author><abstract>x</abstract><url>2024.acl-long.3</url><doi>10.1/q</doi></paper></volume></collection>")
    r = files.anthology(spark, str(tmp_path / "v.xml"), "ACL", 2024).first()
    assert (r.url, r.authors, r.identifiers["doi"]) == ("https://aclanthology.org/2024.acl-long.3/", ["A B"], "10.1/q")
    (tmp_path / "d.xml").write_text("<dblp><inproceedings key='conf/x'><author>A B</author><title>Long enough title.</title><year>2024</year><ee>https://doi.org/10.1145/12.3</ee></inproceedings><inproceedings key='conf/y'><author>A</author><title>Long enough title</title><year>2024</year></inproceedings></dblp>")
    r = files.dblp(spark, str(tmp_path / "d.xml"), "KDD", 2024).collect()
    assert len(r) == 1 and r[0].identifiers == {"doi": "10.1145/12.3", "dblp_key": "conf/x"}


def test_json_sources(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"identity": "a"}\n\n{"identity": "b"}\n')
    assert files.jsonl(spark, str(tmp_path / "e.jsonl"), "identity string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"identity": "a"}\n[1]\n')
    with pytest.raises(Exception, match="invalid JSONL"):
        files.jsonl(spark, str(tmp_path / "bad.jsonl"), "identity string").collect()
    assert files.json_document(spark, str(tmp_path / "none.json"), "x int").count() == 0
    item = {"identity": "a", "metadata_score": 1, "components": {"topic_fit": 1}, "reason": "r", "uncertainty": "u"}
    for i, payload in enumerate(([item], {"scores": [item]}, {"items": [item, item]})):
        (tmp_path / f"s{i}.json").write_text(json.dumps(payload))
        assert files.scores(spark, str(tmp_path / f"s{i}.json")).count() == (2 if i == 2 else 1)


def test_pages(spark):
    detail = '<head><meta name="citation_author" content="A B"><meta name="citation_pdf_url" content="/p.pdf"><meta name="citation_doi" content="10.1234/x."></head><body><h4>Abstract</h4><p>' + "word " * 30 + "</p></body>"
    index = '<a href="/virtual/2024/oral/1">A good title here</a><a href="/virtual/2024/oral/1">Again the same</a><a href="/x">Not a paper at all</a>'
    i = spark.createDataFrame([("https://icml.cc/l", index)], "url string, html string")
    d = spark.createDataFrame([("https://icml.cc/virtual/2024/oral/1", detail)], "url string, html string")
    r = pages.catalog(i, d, "icml", "ICML", 2024).collect()
    assert len(r) == 1 and (r[0].title, r[0].authors, r[0].pdf_url, r[0].presentation_type, r[0].identifiers) == ("A good title here", ["A B"], "https://icml.cc/p.pdf", "oral", {"doi": "10.1234/x"})
    assert r[0].abstract.startswith("word word")
    state = '<script id="__NUXT_DATA__">' + json.dumps([{"title": 1, "abstract": 2, "id": 3}, "1. A title", "y" * 90, ["Ref", 4], 77]) + "</script>"
    r = pages.state_rows(spark.createDataFrame([(state,)], "html string")).first()
    assert (r.title, r.url, len(r.abstract)) == ("A title", "https://chatpaper.com/paper/77", 90)


def test_indexes(spark, tmp_path):
    from corpusmill.sources import indexes

    (tmp_path / "w.json").write_text(json.dumps({"results": [{"doi": "https://doi.org/10.1234/A", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "N"}}]}, {"title": "U"}]}))
    r = indexes.inverted(spark, str(tmp_path / "w.json")).orderBy("title").collect()
    assert (r[0].doi, r[0].abstract, r[0].authors, r[1].abstract) == ("10.1234/a", "a b", ["N"], "")
    item = {"type": "publication", "mainTitle": "T", "descriptions": ["aa", "bbb"], "pids": [{"scheme": "DOI", "value": "10.1/X"}, {"scheme": "arXiv", "value": "1"}], "instances": [{"urls": ["https://h/x.pdf"], "alternateIdentifiers": [{"scheme": "doi", "value": "10.1/y"}]}]}
    (tmp_path / "p.json").write_text(json.dumps({"results": [item, {"type": "dataset", "mainTitle": "D"}]}))
    r = indexes.publications(spark, str(tmp_path / "p.json")).collect()
    assert {x.doi for x in r} == {"10.1/x", "10.1/y"} and {(x.abstract, x.pdf_url) for x in r} == {("bbb", "https://h/x.pdf")}
    got = spark.createDataFrame([('[{"$": "a"}, "b", ""]',), ('{"$": "c"}',), ("d",)], "v string").select(indexes.scalars(F.col("v"))).collect()
    assert [x[0] for x in got] == [["a", "b"], ["c"], ["d"]]
    rows = spark.range(3)
    assert indexes.first_with_rows(rows.limit(0), rows).count() == 3
    assert indexes.all_or_nothing(rows, F.col("id") < 3).count() == 3 and indexes.all_or_nothing(rows, F.col("id") < 2).count() == 0
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["Session A", "A first long title", "x", "Track B", "A second long title"])], "document string, n int, line string")
    assert {(x.title, x.track) for x in indexes.program_titles(lines, least=2).collect()} == {("A first long title", "Session A"), ("A second long title", "Track B")}
    assert indexes.program_titles(lines, least=3).count() == 0


def test_shared_runs(spark, monkeypatch):
    from corpusmill.operators import overlap

    run = "one two three four five six seven eight nine ten"
    texts = spark.createDataFrame([(1, f"before {run.title()}, after"), (2, run.replace(" five", " 5 five")), (3, None), (4, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(7, run), (8, "nothing in common with any of the texts above here now"), (9, None)], "item_id long, text string")
    for most in (overlap.BROADCAST_HASHES, 0):
        monkeypatch.setattr(overlap, "BROADCAST_HASHES", most)
        assert {tuple(r) for r in overlap.shared_runs(texts, items, "doc_id", "item_id").collect()} == {(1, 7), (2, 7)}
    assert overlap.shared_runs(texts.limit(0), items, "doc_id", "item_id").count() == 0


def test_titles_fold_case(spark):
    from corpusmill.functions import text as T

    df = spark.createDataFrame([("Straße",), ("ΟΔΟΣ – Road",), ("Plain -  Title!",), (None,)], "v string")
    assert [r[0] for r in df.select(T.normalized_title(F.col("v"))).collect()] == ["strasse", "οδοσ-road", "plain-title", ""]


def test_metadata_gate(spark, tmp_path):
    """A catalog that fails its audit reaches no later step, and the number of sources must agree."""
    from corpusmill.plans.run import Run
    from tests.test_run import focused, papers

    run = Run(spark, str(tmp_path / "run"))
    with pytest.raises(ValueError, match="2 sources"):
        run.metadata(focused("shortlist"), [papers(spark, 0, 2, 2023)])
    bad = papers(spark, 10, 3, 2023).withColumn("abstract", F.lit("tbd"))
    assert run.metadata(focused("shortlist"), [papers(spark, 0, 2, 2023), bad]) == "complete_with_gaps"
    assert run.table("papers").count() == 2 and run.table("raw").count() == 5
    assert run.state()["warnings"] == ["source 1: the catalog fails its audit"]
