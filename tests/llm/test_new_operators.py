"""Fill-in-the-middle, license scans and importance resampling against plain Python on whole tables and odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import fim, licenses, queries, resampling, words
from tests.llm.test_edge_cases import CLASH, ROWS

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = st.text(alphabet=st.sampled_from(list("aZ09 \t\n\r\x0b\x0c\x00\x1c\x85\xa0 é日😀_-<PSM>")), max_size=60)


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [*[t for _, t, _ in ROWS], "a <P> b", "a<S", "<M>", " lead", "tail \n", "\x00nul\x00 x", "é́ ü\xa0z w", "😀 😀" * 50, *[" ".join(["under the MIT license"] * k) for k in (1, 2, 30)]]
    df = spark.createDataFrame([(None if i == 3 else i // 2 * 2 if i > 40 else i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in ("text", "doc_id")})


def drawn(key, seed=42):
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def plain_fim(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    h1, h2, h3, h4 = drawn(key)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_fim_on_odd_texts(odd):
    out = fim.fill_in_middle(odd, rate=50)
    assert set(out.columns) == {*odd.columns, "fim"}
    got = out.select("doc_id", "text", "fim.n", "fim.form", F.length("fim.prefix").alias("p"), F.length("fim.middle").alias("m"), "fim.output", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    for r in got:
        assert (r["n"], r["form"], r["p"], r["m"], r["output"]) == plain_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(odd.limit(0)).count() == 0


def test_fim_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op11_fill_in_middle(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        n, form, p, m, output = plain_fim(r["doc_id"], docs[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(ODD, st.integers(1, 12))
def test_fim_tokens_in_blocks(text, size):
    ends = np.cumsum([len(t) for t in TOKEN.findall(text)])
    assert fim.token_ends(text, size=size).tolist() == ends.tolist()


def test_fim_long_texts():
    for text in ("x" * 3_000_000, " " * 1_000_000, "word " * 400_000, "日本 \n" * 200_000):
        assert len(fim.token_ends(text)) == len(TOKEN.findall(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD), max_size=8), st.integers(0, 2), st.integers(1, 40))
def test_words_of_bytes(texts, again, most):
    """Blocks of any size hold the words of every text; those told again come once more."""
    array = pa.array(["skipped", *texts], pa.string()).slice(1)
    found = [[] for _ in texts]
    for block in words.blocks(array, again, most):
        said = block.strings().to_pylist()
        assert said == [bytes(block.data[a:b]) for a, b in zip(block.starts, block.ends)]
        for w, row in list(zip(said, block.row.tolist()))[: block.counted]:
            found[row].append(w.decode())
    assert found == [words_of(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=120), min_size=1, max_size=30))
def test_crc_of_many_starts(strings):
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    lengths = np.array([len(s) for s in strings])
    state = words.advance(np.full(len(strings), words.ALL), data, ends - lengths, lengths)
    assert (state ^ words.ALL).tolist() == [zlib.crc32(s) for s in strings]


def runs_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, max_size=6), st.integers(1, 60))
def test_features_in_blocks(texts, most):
    found = [Counter() for _ in texts]
    for block in words.blocks(pa.array(texts, pa.string()), 2, most):
        for bucket, first in resampling.features(block):
            for b, f in zip(bucket.tolist(), first.tolist()):
                found[block.row[f]][b] += 1
    assert found == [Counter(zlib.crc32(x.encode()) % 10_000 for x in runs_of(t)) for t in texts]


def plain_resample(docs, target):
    bucket = lambda text: Counter(zlib.crc32(x.encode()) % 10_000 for x in runs_of(text))
    s, t = Counter(), Counter()
    each = [(key, len(words_of(text)), bucket(text)) for key, text in docs]
    for _, _, b in each:
        s.update(b)
    for text in target:
        t.update(bucket(text))
    S, T = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10_000) / ((s[b] + 1.0) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for key, n, b in each:
        weight = sum(gain[x] * k for x, k in b.items())
        score = weight + math.floor(-1000 * math.log(-math.log((drawn(key)[0] + 0.5) / 4294967296)))
        out.append([key, n, sum(b.values()), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0], -r[3], r[2]))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[5] = k
    return Counter((r[0], *r[2:]) for r in out)


def test_resampling_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    out = queries.op13_importance_resampling(spark, sf)
    assert rows(out, "doc_id", "n_features", "weight", "score", "rank") == plain_resample(docs, target)


def test_resampling_of_odd_rows(spark, odd):
    """Null and repeated ids, equal rows, clashing columns, other shares, an empty target and an empty table."""
    r = random.Random(3)
    more = spark.createDataFrame([(k // 3, " ".join(r.choice(("alpha", "beta", "Gamma", "delta9")) for _ in range(20 + k // 3 % 4))) for k in range(200)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    target = spark.createDataFrame([("beta gamma",), (None,), ("",)], "text string")
    out = resampling.resample(docs.withColumn("weight", F.lit(1)).withColumn("_id", F.lit(2)), target)
    assert rows(out, "_id", "n_features", "weight", "score", "rank") == plain_resample([tuple(x) for x in docs.collect()], ["beta gamma"])
    none = resampling.resample(docs, target.limit(0))
    assert rows(none, "_id", "n_features", "weight", "score", "rank") == plain_resample([tuple(x) for x in docs.collect()], [])
    assert resampling.resample(docs.limit(0), target).count() == 0


def plain_matches(text, base, templates):
    """Every template tried at every word by recursion over its parts."""
    w = words_of(text)

    def ends(items, at):
        if not items:
            return {at}
        head, rest = items[0], items[1:]
        if isinstance(head, str):
            return ends(rest, at + 1) if at < len(w) and w[at] == head else set()
        if isinstance(head, int):
            return set().union(*[ends(rest, at + k) for k in range(head + 1) if at + k <= len(w)])
        return ends(rest, at).union(*[ends(rest, x) for x in ends(head, at)])

    out = []
    for n, (label, markup) in enumerate(base + templates):
        items = licenses.parsed(markup)
        for at in range(len(w)):
            found = ends(items, at)
            if found:
                out.append((label, n < len(base), at, max(found) - at, licenses.mandatory(markup)))
    return len(w), sorted(out)


SMALL = (("x", "a [b [c] {g:2}] d"), ("y", "[a] b c [d]"), ("z", "b {k:3} c {m:1} d"), ("w", "a a"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("aabbccde"), max_size=14).map(" ".join))
def test_automaton_against_recursion(text):
    every = licenses.BASE + SMALL
    scanner = licenses._scanner(every)
    numbers = scanner.numbers(pa.array([w.encode() for w in words_of(text)], pa.binary()))
    found = [(every[n][0], n < 3, at, long, licenses.mandatory(every[n][1])) for n, at, long in scanner.matches(numbers)]
    assert (len(numbers), sorted(found)) == plain_matches(text, licenses.BASE, SMALL)


def filled(markup, r, whole=True):
    """A text of a template: optional regions at random, free words, marks and capitals between."""
    out = []

    def put(items):
        for x in items:
            if isinstance(x, str):
                out.append(x.upper() if r.random() < 0.3 else x)
            elif isinstance(x, int):
                out.extend(r.choice(("foo", "the", "2020", "é")) for _ in range(r.randint(0, x)))
            elif r.random() < 0.5:
                put(x)

    put(licenses.parsed(markup))
    if not whole:
        out[r.randrange(len(out))] = "other"
    return "".join(w + r.choice((" ", ", ", "\n * ", " (", ". ")) for w in out)


@pytest.fixture(scope="module")
def licensed(spark):
    r = random.Random(7)
    texts = [r.choice(("", "Some code. ", "the this ")) + filled(t, r, whole) + r.choice(("", "more words", "the")) for _, t in licenses.BASE + licenses.TEMPLATES for whole in (True, True, False)]
    texts += [None, "", " \n", "under the mit", "cc by nc cc by nc", "under the MIT license under the mit licensed", "copyright copyright c all rights reserved", "the " * 5000]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH if c not in ("text", "doc_id")})


def test_scans_against_recursion(licensed):
    out = licensed.select("text", licenses.scanned(F.col("text")).alias("scan")).collect()
    for r in out:
        got = sorted((m["label"], m["base"], m["first"], m["words"], m["mandatory"]) for m in r["scan"]["matches"])
        assert (r["scan"]["n_words"], got) == plain_matches(r["text"], licenses.BASE, licenses.TEMPLATES)
    whole = [r["scan"]["matches"] for r in out[: 3 * len(licenses.BASE + licenses.TEMPLATES)]]
    for k, (label, _) in enumerate(licenses.BASE + licenses.TEMPLATES):
        assert all(label in {m["label"] for m in found} for found in whole[3 * k : 3 * k + 2])
    assert licensed.limit(0).select(licenses.scanned(F.col("text"))).count() == 0


def test_scan_query_against_sql(spark, licensed, tmp_path):
    licensed.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = list(out[0].asDict())
    want = sorted(db.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op12_license_scan']})").fetchall())
    assert [tuple(r) for r in out] == want
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in out)
    by = {r["doc_id"]: r for r in out}
    two = by[licensed.where("text = 'cc by nc cc by nc'").first()["doc_id"]]
    assert (two["n_base"], two["first_word"], two["last_word"], two["base_labels"]) == (2, 0, 3, "cc-by-nc")


def test_markup_errors():
    with pytest.raises(ValueError, match="brackets"):
        licenses.parsed("a [b")
    with pytest.raises(ValueError, match="two words"):
        licenses.Scanner((("x", "alone [more]"),))


def bare(page):
    """A page without marks: no class, id or role, no article or main element."""
    page = re.sub(r"</?(article|main)\b[^>]*>", "", page or "")
    return re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_templates_find_the_text_of_pages_without_marks(spark, sf):
    """Nothing but the template tells where the text begins and ends; hosts with few pages share their domain's."""
    from corpusmill.llm import html

    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    want = {r.page_id: html.main_text(r.html) for r in rows}  # by the marks
    made = spark.createDataFrame([(r.page_id, r.url, bare(r.html)) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(made).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    without = {r.page_id: html.main_text(r.html) for r in made.collect()}
    assert sum(without[k] == want[k] for k in want) == 0
    marked = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows)).collect()}
    assert marked == want


def test_slots_beside_the_main_one(spark):
    """Lines above the heading and below the text go, one in its midst stays, and so does a large slot wherever it is."""
    from corpusmill.llm import html

    def page(k, above="", below=""):
        body = "".join(f"<p>Paragraph {i} of page {k}, with some words in it.</p>" for i in range(3 + k % 4))
        return f"<html><body><div>{above or f'Line {k}'}</div><h1>Title {k}</h1>{body}<section>In the midst {k}</section><p>Last of {k}.</p><center>{below or f'Below {k}'}</center></body></html>"

    for many, host in ((8, "https://big.example.com/"), (1, "https://h{}.example.org/")):
        rows = [(k, host.format(k) + str(k), page(k)) for k in range(8)]
        got = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        for k in range(8):
            assert got[k][0] == f"Title {k}" and got[k][-1] == f"Last of {k}." and f"In the midst {k}" in got[k] and len(got[k]) == 6 + k % 4
    large = [(k, f"https://big.example.com/{k}", page(k, above=f"A long introduction to {k} that is as much text as the rest of it. " * 9)) for k in range(8)]
    out = html.extract(spark.createDataFrame(large, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "row": F.lit(1), "beside": F.lit(2)}))
    assert all(r.text.startswith("A long introduction") for r in out.collect())
