"""Text expressions against their definitions in Python."""

import html
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import entities
from corpusmill.functions import text as T


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'map<string,array<int>>' if isinstance(v, dict) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("value", [None, "", " a b　c\x1cd ", "x\n\ty", "Tom &amp; Co"])
def test_clean(spark, value):
    assert one(spark, T.clean(F.col("v")), v=value) == " ".join((value or "").split())
    assert one(spark, entities.clean_decoded(F.col("v")), v=value) == " ".join(html.unescape(value or "").split())


@pytest.mark.parametrize("value,want", [("2024-01-05T10:00:00Z", "2024-01-05"), ("2024", None), ("2024-1-5", None), ("2024-02-30", None), (None, None)])
def test_date_text(spark, value, want):
    found = one(spark, T.date_text(F.col("v")), v=value)
    assert (found and found.isoformat()) == want


WORDS = "one two three four five six seven "


@pytest.mark.parametrize(
    "value,want",
    [
        ("x" * 49, False),
        (WORDS + "a" * 20, True),
        ("seven words only are here and that " + "y" * 40, True),
        ("six words only are here " + "y" * 40, False),
        ("n/a", False),
        ("Correct abstract if needed. Retain XML formatting tags and then some more words follow", False),
        ("Some authors wrote a long line here for you. Proceedings of the 3rd big meeting of things, 2021.", False),
        (None, False),
    ],
)
def test_real_abstract(spark, value, want):
    assert one(spark, T.abstract_is_real(F.col("v")), v=value) is want


def test_controls_are_stripped(spark):
    assert one(spark, T.clean_abstract(F.col("v")), v="Text here. Show more  展开。") == "Text here."


def test_titles_and_tokens(spark):
    assert one(spark, T.title_key(F.col("v")), v="A Ünïcode-Title 2!") == re.sub("[^a-z0-9]+", "", "A Ünïcode-Title 2!".lower())
    assert one(spark, T.title_tokens(F.col("v")), v="The Art of the Deep‐Net via X") == ["art", "deep", "net"]
    assert one(spark, T.looks_like_title(F.col("v")), v="Paper Details") is False
    assert one(spark, T.normalized_title(F.col("v")), v="Deep – Learning: A View") == "deep-learning a view"
    assert one(spark, T.family_names(F.col("v")), v=["Ada B. Lovelace", "Grace Hopper-Smith", ""]) == ["lovelace", "hopper-smith"]


def test_inverted_index(spark):
    assert one(spark, T.from_inverted_index(F.col("v")), v={"b": [1, 3], "a": [0], "c": [2]}) == "a b c b"


def test_inverted_index_is_made_in_place(spark):
    texts = ["a b c b", "a", "", None, "b a b a", "x " * 3000 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    out = T.inverted_index(df, F.filter(F.split("v", " "), lambda w: w != ""))
    want = [None if v is None else {w: [i for i, x in enumerate(v.split()) if x == w] for w in v.split()} for v in texts]
    assert [r["index"] for r in out.orderBy("k").collect()] == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def formula_error(text):
    scrubbed = re.sub(r"```[\s\S]*?```|~~~[\s\S]*?~~~|`[^`\n]*`", "", text)
    opened, i = "", 0
    while i < len(scrubbed):
        c = scrubbed[i]
        if c == "\\":
            i += 2
        elif c != "$":
            if opened == "$" and c == "\n":
                return "formula_runs_over_line"
            i += 1
        else:
            mark = "$$" if scrubbed[i : i + 2] == "$$" else "$"
            if opened and mark != opened:
                return "formula_marks_differ"
            opened = "" if opened else mark
            i += len(mark)
    return "formula_left_open" if opened else ""


@pytest.mark.parametrize("value", ["a $x$ b", "a $x\ny$", "$$a\nb$$", "$$a$ b", "open $x", "esc \\$5 and `$`", "```$```"])
def test_formula_automaton(spark, value):
    assert one(spark, T.formula_error(F.col("v")), v=value) == formula_error(value)


def test_sections_sentences_and_latex(spark):
    page = "# T\n## A\nfirst\nline\n## B\nsecond\n"
    assert one(spark, T.section(F.col("v"), "A"), v=page) == "first\nline"
    assert one(spark, T.section(F.col("v"), "B"), v=page) == "second"
    assert one(spark, T.section(F.col("v"), "C"), v=page) == ""
    assert one(spark, T.sentences(F.col("v")), v="One. Two!  Three") == ["One.", "Two!", "Three"]
    assert one(spark, T.unresolved_latex(F.col("v")), v=r"text \alpha here") is True
    assert one(spark, T.unresolved_latex(F.col("v")), v=r"text $\alpha$ and `\beta`") is False


def test_copied_and_prose(spark):
    line = "one two three four five six seven eight nine ten eleven"
    assert one(spark, T.copied(F.col("a"), F.col("b")), a=line, b="so " + line) is True
    assert one(spark, T.copied(F.col("a"), F.col("b")), a=line, b="one two three four") is False
    assert one(spark, T.long_english_prose(F.col("v")), v="this is the long line of words that we have for you and all to read") is True


def test_best_title_and_identity(spark):
    text = "Journal of Things\nA Study of Deep Networ-\nks for Graphs\nAda Lovelace and Grace Hopper\nAbstract\nbody"
    found = one(spark, T.best_title(F.col("t"), F.col("v")), t="A Study of Deep Networks for Graphs", v=text)
    assert found.similarity == 1.0
    assert one(spark, T.identity_ok(F.col("t"), F.col("a"), F.col("v")), t="A Study of Deep Networks for Graphs", a=["Ada Lovelace"], v=text) is True
    assert one(spark, T.identity_ok(F.col("t"), F.col("a"), F.col("v")), t="Another Matter Entirely", a=["Ada Lovelace"], v=text) is False


@pytest.mark.parametrize("size,sections,want", [(1199, True, False), (1300, True, True), (1300, False, False), (8000, False, True)])
def test_body(spark, size, sections, want):
    heads = "1. Introduction\n2 Methods\n3) Results\nReferences\n" if sections else ""
    assert one(spark, T.body_ok(F.col("v")), v=heads + "x" * (size - len(heads))) is want


def test_between(spark):
    assert one(spark, T.between(F.col("v"), "Abstract", ["\nVideo\n", "\nPoster"]), v="Top Abstract\nwords here\nPoster\nVideo\nmore") == "words here"


def test_running_text_of_pages(spark, sf):
    """The reader's text of every page against one made by patterns: the article's text between tags, line by line."""
    import html
    import re

    from corpusmill.plans import registry

    def plain(page):
        body = re.search(r"<article\b[^>]*>(.*)</article>", page, re.S)[1]
        body = re.sub(r"<!--.*?-->", "", body, flags=re.S)
        body = re.sub(r"<(script|style|nav|header|footer|aside)\b.*?</\1>", "", body, flags=re.S)
        lines = [html.unescape(x) for x in re.split(r"<[^>]+>", body)]
        return "\n".join(y.strip() for x in lines for y in x.splitlines() if y.strip())

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = {r.page_id: r for r in registry.QUERIES["html_main_text"](spark, sf).collect()}
    assert set(found) == set(pages)
    for page_id, page in pages.items():
        assert found[page_id].text == plain(page), page_id
        assert found[page_id].accepted is False or len(found[page_id].text) >= 4000


def test_identity_makes_each_part_once(spark):
    """What Spark would make anew at every mention stands once in the plan: front lines, a window's words, the best window."""
    df = spark.createDataFrame([("A Study of Deep Networks", ["Ada Lovelace"], "A Study of Deep Networks\nAda Lovelace\nAbstract\nx")], "t string, a array<string>, v string")
    for found in (T.identity(F.col("t"), F.col("a"), F.col("v")), T.best_title(F.col("t"), F.col("v")), T.identity_ok(F.col("t"), F.col("a"), F.col("v"))):
        plan = df.select(found.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("acknowledgements") == 1 and plan.count("[A-Za-z0-9]{2,}") == 2 and plan.count("array_max(") == 1
    row = df.select(T.identity(F.col("t"), F.col("a"), F.col("v")).alias("x")).select("x.*").first()
    assert (row.similarity, row.candidate, row.same_paper) == (1.0, "A Study of Deep Networks", True)


def test_abstracts_are_cleaned_once_and_judged_as_before(spark):
    """The shortcuts of abstract_is_real and missing against what they stand for; no expression cleans a text twice."""
    long = "seven words and many more of them stand here, one after another"
    values = [None, "", " \n ", "　\x1c", " x ", "\x00", "a-b' " * 200, "- " * 300 + "one two three four five six seven eight", "-' " * 300 + "one two three four five six seven",
              "x" * 500 + " " + "word " * 7, "word " * 6 + "x" * 600, long, long + " Show  more", long + " show less。 Read more.", long + "\n展开 。 收起", long + " show more" * 30, "show more " + long, long + " show moreover",
              "Not available", "Correct abstract if needed. Retain XML formatting tags " + long, long + ". Proceedings of the X, 2020.", "word " * 8, "show more" * 20, "étude " * 9, "字 " * 60]
    t = F.trim(F.regexp_replace(T.clean(F.col("v")), T.UI_CONTROLS, ""))
    whole = (F.length(t) >= 50) & (T.word_count(t) >= 8) & ~t.rlike(T.PLACEHOLDER) & ~F.lower(t).startswith(T.CORRECTION_FORM) & ~t.rlike(T.BIBLIOGRAPHIC)
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    pairs = [(T.clean_abstract(F.col("v")), t), (T.abstract_is_real(F.col("v")), whole), (T.missing(F.col("v")), T.clean(F.col("v")) == "")]
    for r in rows.select("v", *[F.array(x, y) for x, y in pairs]).collect():
        assert all(x == y and x is not None for x, y in r[1:]), r
    plan = rows.where(T.abstract_is_real(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[\s\x1c-\x1f]+") == 1


def test_letters_are_counted_without_a_list_of_them(spark):
    rows = spark.createDataFrame([(v,) for v in (None, "", "abc 中文 Zz9é", "㐀鿿㏿ꀀ𠀀", "\n中\n", "x" * 99 + "字" * 77)], "v string")
    for r in rows.select("v", T.cjk_count(F.col("v")).alias("cjk"), T.latin_count(T.text(F.col("v"))).alias("latin")).collect():
        assert (r.cjk, r.latin) == (len(re.findall("[㐀-鿿]", r.v or "")), len(re.findall("[A-Za-z]", r.v or "")))
    plan = rows.select(T.cjk_count(F.col("v")), T.translation_issue(F.col("v"), F.lit("x")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" not in plan.split("copies_source")[0].split("little_chinese")[0]


def test_texts_are_stripped_at_their_ends_alone(spark):
    """strip against white space as SPACES has it, for every character of the basic plane; its middle is never searched."""
    blank = F.col("c").rlike(r"(?U)[\s\x1c-\x1f]")
    rows = spark.range(1, 0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.expr("unhex(lpad(hex(id), 4, '0'))"), "UTF-16BE").alias("c"))
    assert rows.where((T.strip(F.concat("c", F.lit("x y"), "c")) == "x y") != blank).count() == 0 and rows.where(blank).count() == 29
    assert "regexp" not in rows.select(T.strip(F.col("c")))._jdf.queryExecution().analyzed().toString().lower()
    found = rows.limit(1).select(T.strip(F.lit("\n　 字 a\n\x85")), T.strip(F.lit(" \t ")), T.unresolved_latex(F.lit("a \\x $\\y$")), T.unresolved_latex(F.lit("a $\\y$ `\\z`")), T.unresolved_latex(F.lit("a \\1")), T.formula_error(F.lit("`$` ~~~ $ ~~~ a")), T.formula_error(F.lit("a $x"))).first()
    assert tuple(found) == ("字 a", "", True, False, False, "", "formula_left_open")
