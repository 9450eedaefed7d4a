"""Main-text extraction with templates deduced from pages of one host.

Pages are tokenised: block elements by their path (tag and class names from the root), text blocks by
path and content. Over the pages of a host each token has an occurrence vector (how often it stands on
each page); tokens with one vector form an equivalence class. Classes that are large and frequent enough
are valid; ordered by place and nested where one lies within another, they are the host's template. What
the template doesn't cover are slots. Vectors are compared through an order-free hash, so they are made
by one grouped aggregation that combines before its shuffle, however many pages a host has. Copies of a
page count once.

A slot is known by the path of its element. Over a host's pages it has a length and a share of links. Where
the slot's element is in a valid class, these decide: a slot outside marked articles whose text is mostly
links goes, though nothing in its marks says so; a slot that holds most of the host's text stays, though
class words speak against it.

Hosts with too few pages share the template of their domain's other small hosts, whose classes run over all their
pages. On pages without a marked article the template also tells where the text begins and ends: of the slots whose
element is in a valid class, the one that holds most text and least of it links is the main one; small slots that
stand before it and the page's first heading, or after its last record, on average, are no part of the text (a line
above the heading, a notice below). No word is needed for that, and none can undo it.

A page's text is what its slots hold, without template texts and without elements that are no article by
their meaning (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments; told
by tag, role or class words). Inside a marked article few class words do so alone, other words and ids only
on block elements of which half of the text or more is template or links; headings are never dropped by
words. The template is deduced and taken off on every page, inside marked articles too; all slots that it
leaves stay, in page order.

Edge cases: a null or empty html gives an empty text; a page without a url, or of a host and domain with few pages,
has no template; a page that the template covers whole keeps its blocks; unclosed or misnested tags never
lose text; repeated rows are extracted one by one and count once in vectors; an empty table gives no rows;
other columns pass through, whatever their names; one named like the result gives way.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import array_udf, join_checked, map_batches, own, packed, stored, unpacked

#: A valid class has this many tokens and stands on this share of the host's pages, and this many of them.
CLASS_TOKENS = 2
CLASS_SHARE = 0.5
CLASS_PAGES = 4
#: Share of links from which a slot is no text, share below which it can be, and share of a host's text that outweighs class words.
LINK_SLOT, TEXT_SLOT, MOST_TEXT = 0.6, 0.3, 0.5
#: Share of a host's text up to which a slot outside the main one's span is none of the text.
SMALL_SLOT = 0.2
#: Template tokens, of all hosts, up to which templates are broadcast (eight bytes each).
BROADCAST_TOKENS = 1_000_000

_BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
BLOCKS = frozenset(_BLOCKS)
VOID = frozenset("area base basefont br col embed hr img input link meta param source track wbr".split())
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "noembed", "noframes"})
#: Elements that are never part of an article.
NEVER = frozenset("script style noscript template iframe object embed svg canvas head title nav footer aside form button select option optgroup textarea datalist dialog menu audio video map noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words in class or id attributes that tell what an element is.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promos promotion sidebar sidebars rail "
    "menu menus nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login "
    "share sharing social comment comments commentlist reply replies respond disqus discussion related recommended recommendations footer footnav header masthead topbar widget widgets toolbar pagination pager skip".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words that are no reason to drop an element inside a marked article: its own heading.
HEADING = frozenset({"header", "masthead", "banner"})
#: Class words that alone drop an element inside a marked article (in <main>, ids as well).
SURE = frozenset("advert adverts advertisement advertisements advertising adbox adslot comments commentlist disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CLOSED_BY = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "tbody": ("tr", "td", "th", "tbody", "thead"),
}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


@dataclass
class Element:
    tag: str
    path: str
    dropped: bool
    article: bool
    main: bool
    link: bool
    suspect: int
    worded: str


@dataclass
class Block:
    """worded: path of the outermost element that only class words speak against, if that is why it is dropped."""

    text: str
    path: str
    dropped: bool
    link_chars: int
    suspect: int
    worded: str


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)}


def _names(attributes: dict[str, str], *which: str) -> set[str]:
    said = " ".join(attributes.get(a, "") for a in which)
    return {w.lower() for w in _WORD.findall(said)} | set(re.split(r"[^a-z]+", said.lower()))


def _opened(tag: str, raw: str, up: Element | None, place: int) -> Element:
    attributes = _attributes(raw) if raw.strip(" /\n\t") else {}
    names = _names(attributes, "class", "id") if "class" in attributes or "id" in attributes else set()
    inside = up is not None and (up.article or up.main)
    sure = suspect = False
    if inside and tag not in HEADINGS and names & BOILERPLATE:
        told = _names(attributes, "class") if up.article else names
        sure = bool(told & SURE) or (tag == "article" and bool(_names(attributes, "class") & COMMENTS - {"discussion"}))
        suspect = tag in BLOCKS and not names & BOILERPLATE <= HEADING
    role = attributes.get("role", "").lower()
    soft = False
    if tag in ("html", "body"):
        bad = False
    elif tag in ("article", "main"):
        bad = sure if inside else bool(names & COMMENTS)
    elif tag == "header":
        bad = not inside
    else:
        bad = tag in NEVER or role in ROLES or (sure if inside else bool(names & COMMENTS))
        bad = bad or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
        soft = not bad and not inside and bool(names & BOILERPLATE)
    dropped = bad or soft or (up is not None and up.dropped)
    path = up.path if up else ""
    if tag in BLOCKS:
        path = f"{path}>{tag}" + "".join(f".{n}" for n in attributes.get("class", "").split()[:2])
    return Element(
        tag,
        path,
        dropped,
        (up is not None and up.article) or (tag == "article" and not dropped),
        (up is not None and up.main) or ((tag == "main" or role == "main") and not dropped),
        (up is not None and up.link) or tag == "a",
        place if suspect else up.suspect if up else 0,
        "" if bad else up.worded if up is not None and up.dropped else path if soft and tag in BLOCKS else "",
    )


def parse(page: str) -> tuple[list[Block], Counter]:
    """Text blocks in page order, and how often each path of a block element stands on the page."""
    stack: list[Element] = []
    blocks: list[Block] = []
    paths: Counter = Counter()
    pieces: list[str] = []
    link_chars = 0

    def end_block() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1] if stack else Element("", "", False, False, False, False, 0, "")
                blocks.append(Block(text, top.path, top.dropped, link_chars, top.suspect, top.worded))
            pieces.clear()
        link_chars = 0

    def switch(before: Element | None, after: Element | None) -> None:
        """A text also ends where an inline element starts or stops being dropped."""
        if (before is not None and before.dropped) != (after is not None and after.dropped):
            end_block()

    def say(text: str) -> None:
        nonlocal link_chars
        if text:
            if "&" in text:
                text = entities.unescape(text)
            pieces.append(text)
            if stack and stack[-1].link:
                link_chars += len(text.strip())

    def pop_to(i: int) -> None:
        end_block() if any(e.tag in BLOCKS for e in stack[i:]) else switch(stack[-1], stack[i - 1] if i else None)
        del stack[i:]

    at = 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing, raw = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6] or ""
        if closing:
            found = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    found = i
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break  # an inline end tag doesn't close blocks
            if found is not None:
                pop_to(found)
            elif tag in BLOCKS:
                end_block()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            continue
        if tag in BLOCKS:
            end_block()
            closes = _CLOSED_BY.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in _SCOPE.get(tag, ()):
                    break
                if stack[i].tag in closes:
                    pop_to(i)
                    if tag not in ("tr", "tbody"):
                        break
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        up = stack[-1] if stack else None
        element = _opened(tag, raw, up, at)
        if tag in BLOCKS:
            paths[element.path] += 1
        else:
            switch(up, element)
        if raw.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue  # written as empty
        stack.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
    say(page[at:])
    end_block()
    return blocks, paths


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "replace")) - (1 << 63)


def _container(path: str) -> str:
    """The element that holds a block's paragraph, heading or list item."""
    parts = path.split(">")
    while len(parts) > 2 and re.match(r"(p|h[1-6]|li|ul|ol|dd|dt|dl|td|th|tr|tbody|table|pre|blockquote|figure|figcaption)\b", parts[-1]):
        parts.pop()
    return ">".join(parts)


def _text_token(block: Block) -> int:
    return _hash("text", block.path, block.text)


_HEADED = re.compile(r">h[1-6]\b[^>]*$")
_MARKED = re.compile(r">(?:article|main)\b")
_TOKENS = "host string, kind string, token bigint, page bigint, n int, place double, chars bigint, links bigint, path string, last double"


def _slot(block: Block) -> str:
    return block.worded or _container(block.path)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct token of each page; kind p: path, t: text, s: slot, w: slot that only words speak against, n: the page itself,
    h: its first heading."""
    names = [c.split()[0] for c in _TOKENS.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not host or not page:
                continue
            blocks, paths = parse(page)
            size = max(1, len(paths) + len(blocks))
            # pages that differ only in what has no token (scripts, comments, dropped texts) are copies, too
            key = _hash("page", str(size), *(f"{p} {n}" for p, n in paths.items()), *(x for b in blocks if not b.dropped or b.worded for x in (b.path, b.text, str(b.link_chars))))
            rows.append((host, "n", 0, key, 1, 0.0, 0, 0, None, 0.0))
            rows += [(host, "p", _hash("path", p), key, n, i / size, 0, 0, None, 0.0) for i, (p, n) in enumerate(paths.items())]
            texts = Counter(_text_token(b) for b in blocks if not b.dropped)
            rows += [(host, "t", t, key, n, i / size, 0, 0, None, 0.0) for i, (t, n) in enumerate(texts.items())]
            slots: dict[tuple[str, str], list[int]] = {}  # characters, those in links, first and last block
            for i, b in enumerate(blocks):
                if not b.dropped or b.worded:
                    held = slots.setdefault(("w" if b.dropped else "s", _slot(b)), [0, 0, i, i])
                    held[0] += len(b.text)
                    held[1] += b.link_chars
                    held[3] = i
            heading = next((i for i, b in enumerate(blocks) if not b.dropped and _HEADED.search(b.path)), None)
            if heading is not None:
                rows.append((host, "h", 0, key, 1, heading / len(blocks), 0, 0, None, 0.0))
            rows += [(host, kind, _hash("path", p), key, 1, a / len(blocks), n, links, p, z / len(blocks)) for (kind, p), (n, links, a, z) in slots.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def templates(pages: DataFrame) -> DataFrame:
    """host, tokens (of valid classes: token, kind, class, place, depth), texts (their text tokens), gone and kept
    (paths of slots that their statistics decide), main_slot, and beside (paths of small slots outside its span).

    pages: host, html. A token that stands on at least half of a host's pages is one of a bounded number:
    at most twice as many as a page has on average, so a template is never larger than pages are.
    """
    rows = map_batches(pages, _emit, _TOKENS).distinct()  # copies of a page give equal rows and count once
    tokens = rows.groupBy("host", "kind", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count(F.lit(1)).alias("support"), F.avg("place").alias("place"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.first("path").alias("path"), F.avg("last").alias("last")
    )
    tokens = stored(tokens.where("kind IN ('n', 's', 'w', 'h') OR support > 1"), "tokens")
    hosts = tokens.where("kind = 'n'").select("host", F.col("support").alias("pages"))
    often = (F.col("support") >= CLASS_PAGES) & (F.col("support") >= F.ceil(F.col("pages") * CLASS_SHARE))
    frequent = tokens.where("kind IN ('p', 't')").join(hosts.where(F.col("pages") >= CLASS_PAGES), "host").where(often)
    member = F.struct("place", "token", "kind")
    classes = frequent.groupBy("host", "vector", "support").agg(F.sort_array(F.collect_list(member)).alias("members")).where(F.size("members") >= CLASS_TOKENS)
    classes = classes.select("host", F.struct(F.element_at("members", 1)["place"].alias("start"), F.element_at("members", -1)["place"].alias("stop"), "vector", "members").alias("c"))
    nested = classes.groupBy("host").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    # depth: how many other classes enclose this one
    depth = lambda c: F.size(F.filter("cs", lambda o: (o["start"] <= c["start"]) & (o["stop"] >= c["stop"]) & (o["vector"] != c["vector"])))
    flat = F.flatten(F.transform("cs", lambda c: F.transform(c["members"], lambda t: F.struct(t["place"].alias("place"), t["token"].alias("token"), t["kind"].alias("kind"), c["vector"].alias("class"), depth(c).alias("depth")))))
    nested = nested.select("host", F.sort_array(flat).alias("tokens"))
    of_kind = lambda k: F.transform(F.filter("tokens", lambda t: t["kind"] == k), lambda t: t["token"])

    held = tokens.where("kind IN ('s', 'w')")
    total = held.groupBy("host").agg(F.sum("chars").alias("total"))
    links = F.col("links") / F.greatest("chars", F.lit(1))
    gone = (F.col("kind") == "s") & (links >= LINK_SLOT) & ~F.col("path").rlike(_MARKED.pattern)
    kept = (F.col("kind") == "w") & (links < TEXT_SLOT) & (F.col("chars") > F.col("total") * MOST_TEXT)
    told = held.join(hosts, "host").where(often).join(total, "host").where(gone | kept).groupBy("host").agg(F.collect_list(F.struct("kind", "token", "path")).alias("told"))
    # slots whose element is in a class, and where the one with most text begins and ends
    framed = tokens.where("kind = 's'").join(hosts, "host").where(often).select("host", "token", "path", "chars", "links", F.col("place").alias("first"), "last")
    framed = framed.join(frequent_paths(nested), ["host", "token"], "left_semi")
    main = framed.groupBy("host").agg(F.max_by(F.struct("path", "first", "last"), F.struct(F.col("chars") - 3 * F.col("links"), "path")).alias("main"))
    headed = tokens.where("kind = 'h'").select("host", F.col("place").alias("heading"))
    main = main.join(headed, "host", "left").withColumn("begin", F.least("main.first", "heading"))
    outside = (F.col("first") < F.col("begin")) | (F.col("first") > F.col("main.last"))
    small = F.col("chars") <= F.col("total") * SMALL_SLOT
    beside = framed.join(main, "host").join(total, "host").where(outside & small).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("beside"))
    out = nested.join(main, "host", "left").join(beside, "host", "left").join(told, "host", "left")
    out = out.select("host", "tokens", of_kind("t").alias("texts"), of_kind("p").alias("paths"), F.col("main.path").alias("main_slot"), F.coalesce("beside", F.array().cast("array<string>")).alias("beside"), F.coalesce("told", F.array().cast(told.schema["told"].dataType)).alias("told"))
    named = lambda k: F.array_sort(F.transform(F.filter("told", lambda x: (x["kind"] == k) & F.array_contains("paths", x["token"])), lambda x: x["path"]))
    return out.select("host", "tokens", "texts", named("s").alias("gone"), named("w").alias("kept"), "main_slot", "beside")


def frequent_paths(nested: DataFrame) -> DataFrame:
    """host, token of the paths in valid classes."""
    return nested.select("host", F.explode("tokens").alias("t")).where("t.kind = 'p'").select("host", "t.token")


def main_text(page: str | None, texts=None, gone=None, kept=None, beside=None) -> str:
    """Blocks of the slots that the host's template leaves, joined by line ends."""
    gone, kept, known = set(gone or ()), set(kept or ()), set(texts or ())
    blocks = [b for b in parse(page or "")[0] if (not b.dropped and _slot(b) not in gone) or (b.worded and b.worded in kept)]
    if beside and not any(_MARKED.search(b.path) for b in blocks):
        blocks = [b for b in blocks if _slot(b) not in beside] or blocks
    own = [_text_token(b) not in known for b in blocks]
    size, proof = Counter(), Counter()
    for b, new in zip(blocks, own):
        size[b.suspect] += len(b.text)
        proof[b.suspect] += b.link_chars if new else len(b.text)
    slots = [b for b, new in zip(blocks, own) if new and not (b.suspect and 2 * proof[b.suspect] >= size[b.suspect])]
    return "\n".join(b.text for b in slots or blocks)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def _extract(*columns: pa.Array) -> pa.Array:
    own("html")
    return pa.array([main_text(*row) for row in zip(*(c.to_pylist() for c in columns))], pa.string())


def grouped(pages: DataFrame) -> DataFrame:
    """pages (row, host, page) with `host` replaced by the group that shares a template: the host, or `*.` and its
    domain for hosts with fewer pages than a class needs."""
    hosts = pages.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    domain = F.concat(F.lit("*."), F.regexp_extract("host", r"([^.]*\.?[^.]+)$", 1))
    hosts = stored(hosts.select("host", F.when(F.col("pages") >= CLASS_PAGES, F.col("host")).otherwise(domain).alias("group")), "hosts")
    return join_checked(pages, hosts, "host", "left").select("row", F.coalesce("group", "host").alias("host"), "page")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col: the main text of each whole page."""
    url, page = F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    rows = grouped(pages.select(packed(pages).alias("row"), host_of(url).alias("host"), page.alias("page")))
    known = stored(templates(rows.select("host", F.col("page").alias("html"))).drop("tokens", "main_slot"), "templates")
    # hosts and their tokens: a broadcast is bounded by both
    size = known.agg(F.count(F.lit(1)), F.sum(F.size("texts") + 8 * (F.size("gone") + F.size("kept") + F.size("beside")))).first()
    n = size[0] if (size[1] or 0) <= BROADCAST_TOKENS else 1 << 60
    out = join_checked(rows, known, "host", "left", n, limit=20_000)
    out = out.select("row", array_udf(_extract, "string")("page", "texts", "gone", "kept", "beside").alias("text"))
    return unpacked(out, "row", pages.columns, **{out_col: F.col("text")})
