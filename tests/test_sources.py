"""Day shards, staged pages, composed venues, candidates, channels and PDF text, on small inputs made here."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import acquire, audit, fulltext, progress, records
from corpusmill.plans import plan as P
from corpusmill.sources import channels, paged, pdf, scholarly, venues

PAPER = {"title": "T", "abstract": "A", "authors": ["A"], "identifiers": {"arxiv_id": "1"}}


def shard(day, papers=(PAPER,), **more):
    return {"schema_version": 2, "source": "arxiv", "category": "cs.AI", "date": day, "complete": True, "provisional": False, "fetched_at": "2024-01-09T00:00:00", "papers": list(papers), **more}


def test_scan_tells_every_unusable_shard(spark, tmp_path):
    folder = tmp_path / "arxiv" / "cs.AI"
    folder.mkdir(parents=True)
    days = {
        "2024-01-01": shard("2024-01-01"),
        "2024-01-02": shard("2024-01-02", []),
        "2024-01-03": shard("2024-01-03", [PAPER, PAPER]),
        "2024-01-04": shard("2024-01-05"),
        "2024-01-05": shard("2024-01-05", fetched_at="2023-12-01T00:00:00"),
        "2024-01-06": "{broken",
    }
    for day, value in days.items():
        (folder / f"{day}.json").write_text(value if isinstance(value, str) else json.dumps(value))
    spark.dataSource.register(scholarly.ScholarlySource)
    options = {"path": str(tmp_path), "source": "arxiv", "categories": "cs.AI", "start": "2024-01-01", "end": "2024-01-07", "now": "2024-01-10T00:00:00"}
    scan = lambda **o: spark.read.format("scholarly").options(**options, **o).load()
    told = {r.day.day: r.status for r in scholarly.to_fetch(scan()).collect()}
    assert told == {3: "invalid", 4: "invalid", 5: "stale", 6: "invalid", 7: "missing"}
    assert [r.title for r in scan().where("status = 'ok'").collect()] == ["T"]  # an empty day has no paper and is no gap
    assert scholarly.to_fetch(scan(maxAgeDays="60")).where("status = 'stale'").count() == 0
    assert scholarly.to_fetch(scan(policy="refresh")).count() == 7
    with pytest.raises(Exception, match="2024-01-03 is invalid"):
        scan(policy="only").collect()
    with pytest.raises(Exception, match="unusable shard"):
        scholarly.papers(scan()).collect()
    (folder / "index.json").write_text(json.dumps({"2024-01-01": 6000, "2024-01-02": 6000}))
    reader = scholarly.ShardReader({**options})
    assert [(p.days[0], p.days[-1]) for p in reader.partitions()] == [("2024-01-01", "2024-01-01"), ("2024-01-02", "2024-01-02"), ("2024-01-03", "2024-01-04"), ("2024-01-05", "2024-01-07")]


def staged(spark, rows):
    return spark.createDataFrame([(k, s, t, 1, [(x,) for x in items]) for k, s, t, items in rows], "key string, start long, total long, schema_version int, items array<struct<x:int>>")


def test_staged_pages(spark):
    rows = [("whole", 0, 3, [1, 2]), ("whole", 2, 3, [3]), ("gap", 0, 9, [1]), ("gap", 2, 9, [3]), ("short", 0, 5, [1, 2]), ("changed", 0, 2, [1]), ("changed", 1, 3, [2]), ("grown", 0, 1, [1]), ("grown", 1, 2, [2]), ("ended", 0, 9, [1]), ("ended", 1, 9, [])]
    pages = staged(spark, rows)
    state = paged.ranges(pages)
    assert {r.key: r.error for r in state.collect()} == {"whole": "", "gap": "gap", "short": "short", "changed": "total_changed", "grown": "total_changed", "ended": "short"}
    growing = {r.key: (r.error, r.total, r.rows) for r in paged.ranges(pages, growing=True).collect()}
    assert growing["grown"] == ("", 2, 2) and growing["ended"][0] == "" and growing["gap"] == ("gap", 9, 1)
    assert [(r.position, r.x) for r in paged.rows_of(pages, state).orderBy("position").collect()] == [(0, 1), (1, 2), (2, 3)]
    wanted = spark.createDataFrame([(k,) for k in ("whole", "gap", "short", "changed", "new")], "key string")
    assert {r.key: r.start for r in paged.still_to_read(wanted, state).collect()} == {"gap": 1, "short": 2, "changed": 0, "new": 0}
    assert paged.valid_pages(pages, lambda i: i["x"] < 3).count() == 9 and paged.ranges(pages.limit(0)).count() == 0
    r = {x.group: x for x in paged.receipts(state, F.substring("key", 1, 1)).collect()}["g"]
    assert (r.server_total, r.chunks, r.exhausted) == (11, 2, False)


def test_composed_venue(spark):
    long = "an abstract that an index knows " * 4
    index = [("https://dblp.org/db/conf/kdd/index.html", "<a href='kdd2025-1.html'>a</a><a href='/db/conf/kdd/kdd2025-2.html#x'>b</a><a href='kdd2024.html'>c</a><a href='index.html'>2025</a>")]
    pages = spark.createDataFrame(index, "url string, html string")
    assert {r.url for r in venues.volume_links(pages, "kdd", 2025).collect()} == {"https://dblp.org/db/conf/kdd/kdd2025-1.xml", "https://dblp.org/db/conf/kdd/kdd2025-2.xml"}
    kind = "title string, abstract string, authors array<string>, url string, pdf_url string, doi string"
    seed = spark.createDataFrame([("First paper title", "", ["A Bee"], "u1", "", "10.1/1"), ("Second paper title", None, ["C Dee"], "u2", None, ""), ("First paper title.", "", [], "u3", "", "")], kind)
    accepted = spark.createDataFrame([("https://k/a", "<a href='/p/1'>First Paper Title</a><a href='/p/3'>Third paper title</a><a href='/x'>PDF</a>")], "url string, html string")
    pool = venues.title_pool(accepted, venues.TitlePool("/p/"))
    assert pool.count() == 2 and venues.title_pool(accepted, venues.TitlePool("/p/", least=3)).count() == 0
    idx = spark.createDataFrame([("First paper title", "10.1/1", long, "i1", ["A Bee"]), ("Second paper title", "10.1/2", long + "2", "i2", ["X Dee"]), ("Third paper title", "", "short", "i3", [])], "title string, doi string, abstract string, pdf_url string, authors array<string>")
    out = {r.title: r for r in venues.composed(seed, pool, by_identity=[idx], by_author=[idx]).collect()}
    assert set(out) == {"First paper title", "Second paper title", "Third paper title"}
    assert out["First paper title"].abstract == long and out["First paper title"].pdf_url == "i1" and out["First paper title"].official_title_observed
    assert out["Second paper title"].abstract == long + "2" and not out["Second paper title"].official_title_observed
    assert out["Third paper title"].abstract == "" and not out["Third paper title"].seed_only
    saved = venues.checkpoints(spark.createDataFrame([("SECOND paper title", "kept", "k")], "title string, abstract string, pdf_url string"))
    assert {r.title: r.abstract for r in venues.composed(seed, saved=saved).collect()}["Second paper title"] == "kept"
    first = venues.from_first(idx, F.length("abstract") > 80, seed)
    assert first.columns == seed.columns


def test_archive(spark):
    a = [("https://o/archive", 0, "<a href='/issue/view/9'>Vol 40 2025</a><a href='/issue/view/8'>Vol 39 2025</a>"), ("https://o/archive/2", 1, "<a href='/issue/view/8'>Vol 39 2025</a><a href='/issue/view/7'>2024</a>"), ("https://o/archive/3", 2, "<a href='/issue/view/6'>2023</a>"), ("https://o/archive/4", 3, "<a href='/issue/view/5'>2025 reprint</a>")]
    archive = spark.createDataFrame(a, "url string, n int, html string")
    assert {r.url for r in venues.issues(archive, 2025).collect()} == {"https://o/issue/view/9", "https://o/issue/view/8"}
    issue = spark.createDataFrame([("https://o/issue/view/9", "<a href='/article/view/1'>A good long title</a><a href='/article/view/1'>PDF</a>"), ("https://o/issue/view/8", "<a href='/article/view/2'>A good long title</a><a href='/article/view/3'>Another long title</a>"), ("https://o/issue/view/5", "<a href='/article/view/4'>A reprint of something</a>")], "url string, html string")
    detail = spark.createDataFrame([("https://o/article/view/3", '<meta name="citation_doi" content="10.1234/z"><section class="abstract">' + "word " * 30 + "</section>")], "url string, html string")
    out = {r.title: r for r in venues.archive(archive, issue, detail, 2025).collect()}
    assert set(out) == {"A good long title", "Another long title"} and out["Another long title"].identifiers == {"doi": "10.1234/z"}
    with pytest.raises(Exception, match="too many pages"):
        venues.issues(archive.withColumn("n", F.col("n") + 200), 2025).collect()


def test_candidates_in_order(spark):
    rows = [("A paper", "https://aclanthology.org/2024.acl-long.3/", "https://h/p.pdf", {"doi": "10.1/a"}, "acl", ["https://r/1", "https://h/p.pdf", "ftp://x"]), ("Other", None, None, None, None, None)]
    papers = spark.createDataFrame(rows, "title string, url string, pdf_url string, identifiers map<string,string>, channel string, repos array<string>")
    by_doi = spark.createDataFrame([("10.1/A", "https://u/1.pdf", 2), ("10.1/a", "https://u/0.pdf", 1)], "doi string, pdf string, _pos int")
    by_title = spark.createDataFrame([("A Paper!", "https://s/1.pdf", "https://arxiv.org/pdf/1"), ("A paper two", "https://s/2.pdf", "")], "title string, pdf string, arxiv string")
    out = acquire.candidates(papers, [(by_doi, "unpaywall", "doi", {"pdf": "unpaywall_pdf"}), (by_title, "s2", "title", {"pdf": "exact_title_pdf", "arxiv": "arxiv_pdf"})], "repos")
    got = {r.title: [(c.url, c.kind) for c in r.candidates] for r in out.collect()}
    assert got["A paper"] == [
        ("https://h/p.pdf", "conference_official_pdf"), ("https://aclanthology.org/2024.acl-long.3.pdf", "conference_official_pdf"), ("https://r/1", "repository_page"),
        ("https://u/0.pdf", "unpaywall_pdf"), ("https://s/1.pdf", "exact_title_pdf"), ("https://arxiv.org/pdf/1", "arxiv_pdf"),
    ]
    assert got["Other"] == []


def make_pdf(content: bytes) -> bytes:
    data = zlib.compress(content)
    return b"%PDF-1.4\n4 0 obj\n<< /Length " + str(len(data)).encode() + b" /Filter /FlateDecode >>\nstream\n" + data + b"\nendstream\nendobj\n"


def test_pdf_text(spark, tmp_path):
    page = rb"BT /F1 12 Tf 72 700 Td (A \(good\) title) Tj 0 -14 Td [(Kern) -300 (ed) 20 (text)] TJ 14 TL T* <48656c6c6f> Tj ET"
    two = b"BT " + b" ".join(b"1 0 0 1 %d %d Tm (%s%d) Tj" % (x, 700 - 14 * i, n, i) for i in range(12) for x, n in ((60, b"left"), (330, b"right"))) + b" ET"
    (tmp_path / "a.pdf").write_bytes(make_pdf(page) + make_pdf(two))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4\n<< /Filter /FlateDecode >>\nstream\nxx\nendstream")
    (tmp_path / "other.txt").write_text("x")
    got = {r.path.rsplit("/", 1)[-1]: r.text.split("\n") for r in pdf.read(spark, str(tmp_path)).collect()}
    assert got["broken.pdf"] == [""] and set(got) == {"a.pdf", "broken.pdf"}
    assert got["a.pdf"][:3] == ["A (good) title", "Kern edtext", "Hello"]
    assert got["a.pdf"][-24:] == [f"left{i}" for i in range(12)] + [f"right{i}" for i in range(12)]
    lines = pdf.program_lines(spark.read.format("binaryFile").load(str(tmp_path / "a.pdf")))
    assert lines.count() == len([line for line in got["a.pdf"] if line])  # pages are set apart by an empty line


def test_catalog_contract_and_channels(spark):
    text = "This is a real abstract with many more than eight words and over fifty characters."
    rows = spark.createDataFrame([(f"k{i}", f"Title {i}", text, ["A"], "https://x", None, 2024, "NIPS", "venue") for i in range(3)], "identity string, title string, abstract string, authors array<string>, url string, pdf_url string, year int, venue string, source_type string").withColumn("published", F.lit(None).cast("date"))
    receipt = spark.createDataFrame([("complete", True, "all pages", 3, 3, [2024], [2024], "NeurIPS", 1, "neurips_official_papers")], "status string, complete_catalog boolean, exhaustion_proof string, count long, discovered_count long, requested_years array<int>, effective_years array<int>, channel string, schema_version int, adapter string")
    c = channels.of("NIPS")
    assert c.judged(rows, receipt, 2024).first().complete
    for change in ({"status": F.lit("x")}, {"count": F.lit(2)}, {"effective_years": F.array(F.lit(2023))}, {"channel": F.lit("icml")}, {"adapter": F.lit("")}):
        assert not c.judged(rows, receipt.withColumns(change), 2024).first().complete
    assert not c.judged(rows, receipt, 2023).first().row_binding_ok and not c.judged(rows, receipt, 2024, minimum=4).first().minimum_ok
    assert not c.judged(rows, receipt.limit(0), 2024).first().complete
    assert audit.catalog_contract(rows.limit(0), receipt, "neurips", 2024).first().complete is False
    channels.register(channels.Channel("own", "conference", reader=lambda s: s.range(2)))
    assert channels.of("own").read(spark).columns == ["id", "channel"] and channels.of("own").cache_path("/r/", 2024) == "/r/own/2024"
    with pytest.raises(ValueError):
        channels.of("arxiv").cache_path("/r", 2024)
    del channels.CHANNELS["own"]
    routed = channels.routed(spark.createDataFrame([("ACL", "https://aclanthology.org/2024.acl-long.3", None, {})], "venue string, url string, pdf_url string, identifiers map<string,string>"))
    assert routed.first().pdf_links == ["https://aclanthology.org/2024.acl-long.3.pdf"]


def test_progress(spark):
    rows = spark.createDataFrame([("/old/run/a.txt", ["/old/run", "/old/runs/b"], {"k": "/old/run/c"}, ("x", "/old/run/d")), (None, None, None, None)], "p string, a array<string>, m map<string,string>, s struct<n:string,p:string>")
    r = progress.moved_paths(rows, "/old/run/", "/new").first()
    assert (r.p, r.a, r.m, r.s.p) == ("/new/a.txt", ["/new", "/old/runs/b"], {"k": "/new/c"}, "/new/d")
    done = spark.createDataFrame([("b", 1), ("a", 2), ("z", 3)], "identity string, x int")
    asked = spark.createDataFrame([("a", 1), ("b", 2)], "identity string, position int")
    assert [x.identity for x in progress.in_asked_order(done, asked).collect()] == ["a", "b"]
    c = progress.counters(spark.createDataFrame([("v", "x"), ("v", " "), ("v", None)], "venue string, abstract string"), ["venue"], "p").first()
    assert (c.total, c.abstracts_complete, c.remaining) == (3, 1, 2)
    result = spark.createDataFrame([("r", "/d", 5, [(0, "complete", 3, "hit", ("neurips", None, [2024]))], ["n"])], "run_id string, run_dir string, raw_count int, source_receipts array<struct<index:int,status:string,paper_count:int,cache_status:string,source:struct<venue_id:string,venue:string,years:array<int>>>>, coverage_notices array<string>")
    m = progress.compact_metadata(result).first()
    assert (m.coverage_notice_count, m.metadata_path, m.source_receipts[0].venue, m.source_receipts[0].year, m.status) == (1, "/d/metadata.json", "neurips", 2024, None)
    assert progress.compact_shortlist(result.withColumn("status", F.lit(None).cast("string"))).first().status == "complete"
    assert progress.compact_fulltext(result).first().full_text_results_path == "/d/full_text_results.json"


def test_small_documents_and_locked_settings(tmp_path):
    P.write_text(str(tmp_path / "a" / "r.md"), "x\n\n")
    assert (tmp_path / "a" / "r.md").read_text() == "x\n" and len(list((tmp_path / "a").iterdir())) == 1
    parent = {"workflow": {"user_disabled_claude": True, "conversation_reading_preference_locked": True, "reading_preference_scope": "Conversation"}}
    assert P.child({"workflow": {"mode": "focused"}}, parent)["workflow"] == {"mode": "focused", **P.LOCKED}
    assert P.inherited({"workflow": {**parent["workflow"], "reading_preference_scope": "current_turn"}}) == {} == P.inherited(None)
    with pytest.raises(P.PlanError):
        P.child({"workflow": {"reading_preference": "auto"}}, parent)


def test_links(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c).first()[0]
    assert one(records.dblp_mirrors(F.col("v")), "http://www.dblp.org/db/x?y=1") == [f"https://{h}/db/x?y=1" for h in ("dblp.org", "dblp.uni-trier.de", "dblp.dagstuhl.de")]
    assert one(records.dblp_mirrors(F.col("v")), "https://h/x") == ["https://h/x"]
    assert one(records.arxiv_id(F.col("v")), "http://arxiv.org/abs/2401.1234v12") == "2401.1234"
    assert one(records.arxiv_query(F.lit("cs.AI"), F.lit("2024-01-02").cast("date"), F.lit("2024-02-01").cast("date")), "") == "cat:cs.AI AND submittedDate:[202401020000 TO 202402012359]"


def test_publishing_texts_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y"], "text")], "identity string, aliases array<string>, text string")
    for _ in range(2):
        fulltext.publish(rows, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/texts").count() == 1 and spark.read.parquet(f"{tmp_path}/aliases").count() == 2
