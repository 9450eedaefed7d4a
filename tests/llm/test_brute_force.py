"""Registered queries against plain Python over the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import html, language, pii, quality, queries


@pytest.fixture(scope="module")
def docs(sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in t}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1_pieces_cover_documents_and_fit(spark, sf, docs):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    total = 0
    for doc_id, text in docs.items():
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == [(k, k * 4096) for k in range(-(-len(ids) // 4096))]
        for r in own:
            part = ids[r.start : r.start + 4096]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * total / 4096 + 2


def test_op2_equals_the_library(spark, sf, docs):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in queries.op2_bpe_transducer(spark, sf).collect():
        ids = tok.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(tok.decode(ids, skip_special_tokens=False))


class Article(HTMLParser):
    """Blocks of the one <article> of these pages, without elements that are none of it."""

    OUT = {"nav", "aside", "form", "script", "style", "footer"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "u", "small", "sup", "sub"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.blocks, self.held = 0, [], [], ""

    def close_block(self):
        text = " ".join(self.held.split())
        if text:
            self.blocks.append(text)
        self.held = ""

    def handle_starttag(self, tag, attrs):
        said = dict(attrs).get("class") or ""
        if tag == "article":
            self.inside += 1
        elif self.out or tag in self.OUT or said in ("ad", "comments", "share"):
            if tag not in ("br", "img", "hr"):
                self.out.append(tag)
        elif tag == "br":
            self.held += " "
        elif tag not in self.INLINE:
            self.close_block()

    def handle_endtag(self, tag):
        if self.out:
            if tag in self.out:
                del self.out[len(self.out) - 1 - self.out[::-1].index(tag) :]
        elif tag == "article":
            self.close_block()
            self.inside -= 1
        elif tag not in self.INLINE:
            self.close_block()

    def handle_data(self, data):
        if self.inside and not self.out:
            self.held += data


def test_op4_articles(spark):
    """The tables' pages mark their article: a plain reader of it gives the same text."""
    path = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] or "" for r in pq.read_table(f"{path}/pages.parquet").to_pylist()}
    got = {r.page_id: r for r in queries.op4_html_extraction(spark, path).collect()}
    assert set(got) == set(pages)
    for page_id, page in pages.items():
        reader = Article()
        reader.feed(page)
        reader.close()
        assert got[page_id].text == "\n".join(reader.blocks), page_id
        assert got[page_id].n_chars == len(got[page_id].text)


def plain_templates(pages):
    """Classes by whole occurrence vectors over distinct pages: {host: {token: (kind, depth)}}, and slots by their statistics."""
    hosts = defaultdict(dict)
    for host, page in pages:
        blocks, paths = html.parse(page)
        hosts[host][(tuple(paths.items()), tuple((b.path, b.text, b.link_chars) for b in blocks if not b.dropped or b.worded))] = (blocks, paths)
    out = {}
    for host, found in hosts.items():
        vectors, places, n = defaultdict(dict), defaultdict(list), len(found)
        length, links, seen, total = Counter(), Counter(), defaultdict(set), 0
        for k, (blocks, paths) in enumerate(found.values()):
            size = max(1, len(paths) + len(blocks))
            texts = Counter((b.path, b.text) for b in blocks if not b.dropped)
            for kind, counted in (("p", paths), ("t", texts)):
                for i, (token, times) in enumerate(counted.items()):
                    vectors[kind, token][k] = times
                    places[kind, token].append(i / size)
            for b in blocks:
                if not b.dropped or b.worded:
                    slot = "w" if b.dropped else "s", html._slot(b)
                    length[slot] += len(b.text)
                    links[slot] += b.link_chars
                    seen[slot].add(k)
                    total += len(b.text)
        classes = defaultdict(list)
        for token, vector in vectors.items():
            if n >= 4 and len(vector) >= 4 and 2 * len(vector) >= n:
                classes[tuple(sorted(vector.items()))].append(token)
        valid = {v: ts for v, ts in classes.items() if len(ts) >= 2}
        if not valid:
            continue
        spans = {v: (min(np.mean(places[t]) for t in ts), max(np.mean(places[t]) for t in ts)) for v, ts in valid.items()}
        depth = {v: sum(o != v and spans[o][0] <= spans[v][0] and spans[o][1] >= spans[v][1] for o in valid) for v in valid}
        tokens = {t: depth[v] for v, ts in valid.items() for t in ts}
        often = [s for s in length if len(seen[s]) >= 4 and 2 * len(seen[s]) >= n and ("p", s[1]) in tokens]
        gone = {p for k, p in often if k == "s" and links[k, p] >= 0.6 * length[k, p] and not re.search(r">(article|main)\b", p)}
        kept = {p for k, p in often if k == "w" and links[k, p] < 0.3 * length[k, p] and length[k, p] > total / 2}
        out[host] = tokens, gone, kept
    return out


def made_pages():
    """Hosts whose pages share menus without marks, texts under misleading words, and copies."""
    out = []
    for k in range(12):
        words = " ".join(f"w{k}x{i}" for i in range(60))
        menu = "".join(f"<li><a href=/{k}/{i}>go {k} {i}</a></li>" for i in range(4))
        out.append(("a.example", f"<body><div class=top><ul>{menu}</ul></div><div class='story related'><p>{words}</p></div><div class=promo><p>Buy {k}</p></div><p class=legal>All rights kept</p><div class=end><p>Same end</p></div></body>"))
        if k % 3 == 0:
            out += [out[-1]] * 2
        out.append(("b.example", f"<body><h1>Head {k}</h1><div><p>{words}</p></div>" + ("<div><p>Now and then</p><p>And again</p></div>" if k % 2 else "") + "</body>"))
    return out


@pytest.mark.parametrize("source", ["sf0.001", "sf0.01", "made"])
def test_op4_classes_and_nesting(spark, source):
    if source == "made":
        pages = made_pages()
    else:
        rows = pq.read_table(f"/root/testdata/{source}/pages.parquet").to_pylist()
        pages = [(re.match(r"https?://([^/]+)", r["url"])[1].lower(), r["html"] or "") for r in rows]
    want = plain_templates(pages)
    df = spark.createDataFrame(pages, "host string, html string")
    got = {r.host: r for r in html.templates(df).collect()}
    assert set(got) == set(want)
    for host, (tokens, gone, kept) in want.items():
        hashed = {(k, html._hash("path", t) if k == "p" else html._hash("text", *t)): d for (k, t), d in tokens.items()}
        assert {(t.kind, t.token): t.depth for t in got[host].tokens} == hashed
        assert (set(got[host].gone), set(got[host].kept)) == (gone, kept)
    if source == "made":
        assert want["a.example"][1] and want["a.example"][2]
        rows = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
        text = {r.page_id: r.text for r in html.extract(rows).collect()}
        for i, (host, page) in enumerate(pages):
            assert "w" in text[i] and "go " not in text[i] and "Same end" not in text[i] and "Buy" not in text[i]
            assert host == "a.example" or "Head" in text[i]
            assert text[i] != html.main_text(page) or host == "b.example"  # the template decides


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op3_posteriors(spark, folder):
    """Site posteriors without the document itself, and scores, from the documents' own probabilities."""
    path = f"/root/testdata/{folder}"
    site = {r["doc_id"]: (r["source"], r["lang"]) for r in pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "source", "lang"]).to_pylist()}
    rows = {r.doc_id: r for r in queries.op3_quality_classifier(spark, path).collect()}
    assert set(rows) == set(site)
    paths, hosts = defaultdict(list), defaultdict(list)
    for k, (host, lang) in site.items():
        paths[host, lang].append(rows[k].doc_score)
        hosts[host].append(rows[k].doc_score)
    n, every = len(rows), [r.doc_score for r in rows.values()]
    mean = sum(every) / n
    within = sum(sum((x - np.mean(v)) ** 2 for x in v) for v in paths.values()) / (n - len(paths))
    around = sum(len(v) * (np.mean(v) - np.mean(hosts[h])) ** 2 for (h, _), v in paths.items()) - (len(paths) - len(hosts)) * within
    size = n - sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items())
    path_weight = np.clip(within / (around / size) if size and around > 0 else 1000.0, 2, 1000)
    around = sum(len(v) * (np.mean(v) - mean) ** 2 for v in hosts.values()) - (len(hosts) - 1) * within
    size = n - sum(len(v) ** 2 for v in hosts.values()) / n
    host_weight = np.clip(within / (around / size) if size and around > 0 else 1000.0, 2, 1000)
    logit = lambda p: np.log(p / (1 - p))
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{path}/labels.parquet").to_pylist() if r["quality"] is not None and r["doc_id"] in rows}
    assert len(labels) <= quality.SAMPLE  # all of them set the sites' share

    def loss(share):
        odds = [logit(rows[k].doc_score) + share * (logit(rows[k].site_score) - logit(mean)) for k in labels]
        return sum(math.log1p(math.exp(-x if y else x)) for x, y in zip(odds, labels.values()))

    share = min((c / 20 for c in range(21)), key=loss)
    for k, (host, lang) in site.items():
        p, mine, all_ = rows[k].doc_score, paths[host, lang], hosts[host]
        above = (sum(all_) - p + host_weight * mean) / (len(all_) - 1 + host_weight)
        want = (sum(mine) - p + path_weight * above) / (len(mine) - 1 + path_weight)
        assert rows[k].site_score == pytest.approx(want, rel=1e-6)
        score = 1 / (1 + np.exp(-(logit(p) + share * (logit(want) - logit(mean)))))
        assert rows[k].score == pytest.approx(score, rel=1e-6) and rows[k].keep == (rows[k].score >= 0.5)


def test_op5_edits_and_equal_fingerprints(spark, sf, docs):
    rows = {r.doc_id: r for r in queries.op5_document_fingerprints(spark, sf).collect()}
    assert set(rows) == set(docs)
    order = sorted(docs)
    by_text = defaultdict(set)
    for i, doc_id in enumerate(order):
        text, following = docs[doc_id], docs[order[(i + 1) % len(order)]]
        k = len(text) // 4
        changed = text[: len(text) - k] + following[:k]
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(changed))
        by_text[text].add(r.fingerprint)
        by_text[changed].add(r.edited_fingerprint)
        assert r.near_next == (r.fingerprint == rows[order[(i + 1) % len(order)]].fingerprint)
        assert r.near_edited == (r.fingerprint == r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_op6_base_spans(spark, sf, docs):
    for r in queries.op6_pii(spark, sf).collect():
        want = plain_spans(docs[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        n = Counter(k for k, *_ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n["email"], n["ip"], n["card"], n["phone"], sha(said))
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_op7_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = queries.op7_language_id(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def plain_grams(text):
    """All n-grams of one to four letters, white space between words as one mark."""
    flat = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return {flat[i : i + n] for n in range(1, 5) for i in range(len(flat) - n + 1)}


def test_op7_equals_kernel_regression_on_plain_ngrams():
    """Landmarks that are the whole sample make the regression exact: the dual solution over sets of n-grams gives the same.

    It also tells what hashing n-grams to the domain changes: margins by less than a twentieth, no prediction.
    """
    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() if r["text"] and any(c.isalpha() for c in r["text"])]
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r["text"][:4000])
    train = [(lang, t) for lang in sorted(by) for t in by[lang][:40]]
    test = [(lang, t) for lang in sorted(by) for t in by[lang][40:90]]
    model = language.solve([(lang, language.grams(t)) for lang, t in train])
    got = model.scores([language.grams(t) for _, t in test])

    sets, others = [plain_grams(t) for _, t in train], [plain_grams(t) for _, t in test]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    target = np.array([[1.0 if lang == name else -1.0 for name in model.languages] for lang, _ in train])
    alpha = np.linalg.solve(gram + language.RIDGE * len(train) / 100 * np.eye(len(train)), target)
    want = np.array([[kernel(a, b) for b in sets] for a in others]) @ alpha
    assert np.abs(got - want).max() < 0.05
    assert (got.argmax(1) == want.argmax(1)).all()
    assert np.mean([model.languages[k] == lang for k, (lang, _) in zip(want.argmax(1), test)]) >= 0.95


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def plain_components(docs, words, num, den):
    sets = {k: shingle_set(v, words) for k, v in docs.items()}
    parent = {k: k for k in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted((k for k in docs if sets[k]), key=lambda k: len(sets[k]))
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if len(sets[b]) * num > len(sets[a]) * den:
                break
            common = len(sets[a] & sets[b])
            if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in docs}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op8_components(spark, folder):
    path = f"/root/testdata/{folder}"
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{path}/documents.parquet").to_pylist()}
    want = plain_components(docs, 3, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_ngram_jaccard_join(spark, path).collect()}
    assert got == want


def test_op9_groups(spark, sf, docs):
    groups = defaultdict(list)
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", v) for k, v in docs.items()}
    for k, v in norm.items():
        groups[v].append(k)
    rows = queries.op9_exact_dedup(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(own), len(own), r.doc_id == min(own), sha(norm[r.doc_id]))
