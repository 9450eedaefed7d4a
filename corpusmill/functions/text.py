"""Text expressions: Column in, Column out, all inside the JVM (entity decoding apart, see entities.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Acceptance lists and patterns of the record contracts.
TITLE_STOPS = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "toward", "towards", "with", "via", "using"]
NOT_TITLES = ["view paper", "view details", "paper details", "download pdf", "abstract", "title tbd"]
FUNCTION_WORDS = ["a", "an", "and", "are", "as", "by", "for", "from", "in", "is", "of", "on", "our", "that", "the", "this", "to", "we", "which", "with"]
SPACES = r"(?U)[\s\x1c-\x1f]+"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # what SPACES takes
UI_CONTROLS = r"(?i)(?:\s*(?:show\s+(?:more|less)|read\s+(?:more|less)|显示更多|显示较少|展开|收起)\s*[。. ]?\s*)+$"
PLACEHOLDER = r"(?i)^(?:abstract\s*)?(?:not\s+available|unavailable|none|n/?a|tbd|to\s+be\s+(?:added|announced|determined)|coming\s+soon)\.?$"
CORRECTION_FORM = "correct abstract if needed. retain xml formatting tags"
BIBLIOGRAPHIC = r"(?is)\.\s+(?:proceedings|findings)\s+of\s+the\b.*\b(?:19|20)\d{2}\.?$"
WORD = r"(?U)\b[\w'-]+\b"
ENGLISH_WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)*"
PROTECTED = r"```[\s\S]*?```|~~~[\s\S]*?~~~|`[^`\n]*`|\$\$[\s\S]*?\$\$|\\\[[\s\S]*?\\\]|\\\([^\n]*?\\\)|(?<!\\)\$[^$\n]*?(?<!\\)\$"


def text(value: Column) -> Column:
    """Null and empty are one."""
    return F.coalesce(value.cast("string"), F.lit(""))


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often it is used (inside lambdas, too)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(value: Column) -> Column:
    """White space of any kind as single spaces, trimmed; null as empty."""
    return F.trim(F.regexp_replace(text(value), SPACES, " "))


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text(value), F.lit(BLANKS))


def clean_abstract(value: Column) -> Column:
    """Without trailing expand and collapse controls of web pages.

    The last control of a cleaned text stands in its last 32 characters; only a text that has one is searched.
    """
    bare = lambda t: F.when(F.substring(t, -32, 32).rlike(UI_CONTROLS), F.trim(F.regexp_replace(t, UI_CONTROLS, ""))).otherwise(t)
    return let(clean(value), bare)


def missing(value: Column) -> Column:
    """Null, empty or nothing but white space."""
    return ~text(value).rlike(NOT_SPACE)


def date_text(value: Column) -> Column:
    """First ten characters as an ISO date, else null."""
    head = F.substring(clean(value), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def title_key(value: Column) -> Column:
    """Lower case with everything but ASCII letters and digits deleted."""
    return F.regexp_replace(F.lower(clean(value)), "[^a-z0-9]+", "")


def unicode_title_key(value: Column) -> Column:
    """As title_key, but letters and digits of every script stay, so titles in other scripts don't collapse."""
    return F.regexp_replace(F.lower(clean(value)), r"[^\p{L}\p{N}]+", "")


def spaced_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean(value)), "[^a-z0-9]+", " "))


def casefold(value: Column) -> Column:
    """Unicode case folding; plain lower case where the text is ASCII."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), value, F.lit(True))
    return F.when(F.length(value) == F.octet_length(value), F.lower(value)).otherwise(folded)


def normalized_title(value: Column) -> Column:
    """Dashes folded, marks as spaces, case folded (sharp s as ss, final sigma as sigma)."""
    dashed = F.regexp_replace(F.regexp_replace(clean(value), r"[\u2010-\u2015\u2212]", "-"), r"\s*-\s*", "-")
    return F.trim(F.regexp_replace(casefold(F.regexp_replace(dashed, r"(?U)[^\w-]+", " ")), " +", " "))


def split_authors(value: Column) -> Column:
    """One string of names, at commas, semicolons and 'and'."""
    return F.filter(F.transform(F.split(text(value), r"\s*(?:,|;|\band\b)\s*"), clean), lambda a: a != "")


def clean_authors(names: Column) -> Column:
    return F.coalesce(F.filter(F.transform(names, clean), lambda a: a != ""), F.array().cast("array<string>"))


def _title_words(value: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text(value), F.lit("[A-Za-z0-9]{2,}"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(TITLE_STOPS)))


def title_tokens(value: Column) -> Column:
    """Distinct lower-case words of two or more letters or digits, stop words out, sorted."""
    return F.sort_array(_title_words(value))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def family_names(names: Column) -> Column:
    """Last word of each name, lower case, distinct."""
    last = lambda n: F.lower(F.element_at(F.regexp_extract_all(n, F.lit("[A-Za-z][A-Za-z-]+"), F.lit(0)), -1))
    named = F.filter(F.transform(names, clean), lambda n: n.rlike("[A-Za-z][A-Za-z-]+"))
    return F.array_distinct(F.transform(named, last))


def word_count(value: Column) -> Column:
    return F.size(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)))


def abstract_is_real(value: Column) -> Column:
    """At least 50 characters and 8 words, no placeholder, no form text, no citation line.

    A text is cleaned once (filters and observations would clean it for every mention), and all its words are counted
    only if its beginning has too few.
    """

    def real(t: Column) -> Column:
        wordy = (word_count(F.substring(t, 1, 400)) >= 8) | (word_count(t) >= 8)
        return (F.length(t) >= 50) & wordy & ~t.rlike(PLACEHOLDER) & ~F.lower(F.substring(t, 1, 100)).startswith(CORRECTION_FORM) & ~t.rlike(BIBLIOGRAPHIC)

    return let(clean_abstract(value), real)


def looks_like_title(value: Column) -> Column:
    t = clean(value)
    return (F.length(t) >= 8) & (F.size(F.split(t, " ")) >= 2) & ~F.lower(t).isin(NOT_TITLES)


def cjk_count(value: Column) -> Column:
    return F.length(F.regexp_replace(text(value), r"[^\u3400-\u9fff]+", ""))


def latin_count(value: Column) -> Column:
    """Letters of ASCII; null of null."""
    return F.length(F.regexp_replace(value, "[^A-Za-z]+", ""))


def english_words(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(text(value), F.lit(ENGLISH_WORD), F.lit(0)), F.lower)


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words; empty with fewer words."""

    def made(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))

    return let(words, made)


def shingle_hashes(words: Column, n: int) -> Column:
    """Distinct 64-bit hashes of runs of n words; empty with fewer words."""

    def made(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " "))))).otherwise(F.array().cast("array<bigint>"))

    return let(words, made)


def copied(source: Column, candidate: Column, n: int = 10) -> Column:
    """Whether the two share a run of n English words."""
    return F.arrays_overlap(shingles(english_words(source), n), shingles(english_words(candidate), n))


def long_english_prose(value: Column) -> Column:
    """A sentence of twelve or more English words, two of them function words, with hardly any CJK."""
    scrubbed = F.regexp_replace(text(value), r"https?://\S+|`[^`]*`|\$[^$]*\$", " ")
    known = F.array(*[F.lit(w) for w in FUNCTION_WORDS])

    def prose(segment: Column) -> Column:
        words = english_words(segment)
        return (F.size(words) >= 12) & (cjk_count(segment) <= 2) & (F.size(F.filter(words, lambda w: F.array_contains(known, w))) >= 2)

    return F.exists(F.split(scrubbed, r"(?<=[.!?])\s+|\n+"), prose)


def translation_issue(value: Column, source: Column) -> Column:
    """Why a Chinese text is no translation of an English one; empty if it may be."""
    chinese, latin = cjk_count(value), latin_count(text(value))
    thin = (chinese < 4) | ((latin > 0) & (chinese / (chinese + latin) < 0.15))
    return F.when(thin, "little_chinese").when(copied(source, value), "copies_source").when(long_english_prose(value), "english_sentences").otherwise("")


def sentences(value: Column) -> Column:
    return F.filter(F.transform(F.split(text(value), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def section(value: Column, name: str) -> Column:
    """Text under the second-level heading `name`, up to the next one."""
    return strip(F.regexp_extract(text(value), rf"(?ms)^##\s+\Q{name}\E\s*$\n(.*?)(?=^##\s+|\Z)", 1))


def between(value: Column, start: str, ends: list[str]) -> Column:
    """What follows the first `start`, up to the first of `ends`; empty without a start."""
    at = F.locate(start, text(value))
    rest = F.substring(text(value), at + len(start), F.length(text(value)))
    stops = F.array_compact(F.array(*[F.when(F.locate(e, rest) > 0, F.locate(e, rest)) for e in ends]))
    return F.when(at > 0, strip(F.substring(rest, F.lit(1), F.coalesce(F.array_min(stops) - 1, F.length(rest))))).otherwise("")


def doi(value: Column) -> Column:
    """The first DOI, lower case, without closing punctuation."""
    return F.lower(F.regexp_replace(F.regexp_extract(text(value), r"(?i)10\.\d{4,9}/[^\s<>\"]+", 0), r"[.,)]+$", ""))


def abstract_of_full_text(value: Column) -> Column:
    """The abstract of an extracted paper: from its heading to the introduction or keywords."""
    return clean(F.regexp_extract(text(value), r"(?is)\babstract\b\s*[:.—-]?\s*(.{50,5000}?)(?=\n\s*(?:\d+\.?\s*)?(?:introduction|keywords|index terms|ccs concepts)\b|\Z)", 1))


def inverted_index(rows: DataFrame, words: Column, name: str = "index") -> DataFrame:
    """rows with the positions (from 0) of each word, a map, made where the words stand: nothing is shuffled."""
    at = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    out = rows.withColumn("__sorted", F.array_sort(at))  # a word's places are a run
    first = lambda x, i: F.when((i == 0) | (x["word"] != F.get("__sorted", i - 1)["word"]), i)
    out = out.withColumn("__starts", F.filter(F.transform("__sorted", first), lambda i: i.isNotNull()))
    end = lambda j: F.coalesce(F.get("__starts", j + 1), F.size("__sorted"))
    places = F.transform("__starts", lambda i, j: F.transform(F.slice("__sorted", i + 1, end(j) - i), lambda x: x["at"]))
    return out.withColumn(name, F.map_from_arrays(F.transform("__starts", lambda i: F.get("__sorted", i)["word"]), places)).drop("__sorted", "__starts")


def from_inverted_index(index: Column) -> Column:
    """map<word, positions> back to its text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " ")


def unresolved_latex(value: Column) -> Column:
    """LaTeX commands outside code and formulas; a text without any command isn't searched for those."""
    return text(value).rlike(r"\\[A-Za-z]") & F.regexp_replace(text(value), PROTECTED, " ").rlike(r"\\[A-Za-z]+")


def formula_error(value: Column) -> Column:
    """What is wrong with the dollar signs of a Markdown text; empty if nothing is.

    A fold over the tokens that matter: escapes, line ends, single and double dollars.
    """
    code = text(value).contains("`") | text(value).contains("~~~")
    scrubbed = F.when(code, F.regexp_replace(text(value), r"```[\s\S]*?```|~~~[\s\S]*?~~~|`[^`\n]*`", "")).otherwise(text(value))
    tokens = F.regexp_extract_all(scrubbed, F.lit(r"\\[\s\S]|\$\$|\$|\n"), F.lit(0))
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("error"))

    def step(state: Column, token: Column) -> Column:
        dollar = token.isin("$", "$$")
        error = F.when(state["error"] != "", state["error"]).when((token == "\n") & (state["open"] == "$"), "formula_runs_over_line").when(dollar & (state["open"] != "") & (state["open"] != token), "formula_marks_differ").otherwise("")
        opened = F.when(~dollar, state["open"]).when(state["open"] != "", "").otherwise(token)
        return F.struct(opened.alias("open"), error.alias("error"))

    return F.aggregate(tokens, start, step, lambda s: F.when(s["error"] != "", s["error"]).when(s["open"] != "", "formula_left_open").otherwise(""))


def fingerprint(*values: Column) -> Column:
    """SHA-256 of the values as JSON with sorted keys of one-letter-free names; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)


def markdown_link(label: str, url: Column) -> Column:
    return F.when(F.lower(clean(url)).startswith("http"), F.format_string(f"[{label}](%s)", clean(url))).otherwise(clean(url))


def body_ok(value: Column, require_sections: bool = False) -> Column:
    """A text long enough and built like a paper."""
    t = text(value)
    pattern = r"(?im)^\s*(?:\d+(?:\.\d+)*[.)]?\s*)?(abstract|introduction|background|related work|method|methods|materials and methods|experiments?|evaluation|results?|discussion|conclusions?|references)\s*[:.]?\s*$"
    fold = lambda h: F.when(F.lower(h).isin("method", "methods", "materials and methods"), "method").otherwise(F.regexp_replace(F.lower(h), "s+$", ""))
    found = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), fold))
    core = F.array_except(found, F.array(*[F.lit(x) for x in ("abstract", "reference", "introduction", "background", "related work")]))
    outcome = F.arrays_overlap(found, F.array(*[F.lit(x) for x in ("result", "evaluation", "discussion", "conclusion")]))
    built = (F.array_contains(found, "introduction") & F.array_contains(found, "reference") & (F.size(core) >= 2)) | ((F.length(t) >= 8000) & (F.size(core) >= 2) & outcome)
    return (F.length(t) >= 1200) & (built if require_sections else (F.length(t) >= 8000) | built)


def front_lines(value: Column) -> Column:
    """Up to 36 lines before the abstract, each at most 240 characters."""
    lines = F.transform(F.split(text(value), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.rtrim(F.substring(F.trim(F.regexp_replace(x, SPACES, " ")), 1, 240)))
    starts = lambda x, words: F.lower(x).rlike("^(?:" + "|".join(words) + ")")
    ends = lambda x, i: starts(x, ["abstract", "references", "acknowledgments", "acknowledgements"]) | (starts(x, ["keywords", "introduction"]) & (i > 0))

    def front(kept: Column) -> Column:
        first = F.array_position(F.concat(F.transform(kept, ends), F.array(F.lit(True))), True)  # after the last line if none ends it
        return F.slice(kept, F.lit(1), first.cast("int") - 1)

    return let(F.slice(F.filter(lines, lambda x: x != ""), 1, 36), front)


def _best(lines: Column, wanted: Column) -> Column:
    """struct(similarity, order, candidate) of the best window of one to ten lines for a title's tokens.

    What is used more than once is bound by let: inside lambdas Spark makes every mention of an expression anew.
    """

    def join(i: Column, n: Column) -> Column:
        whole = lambda c: F.regexp_replace(F.regexp_replace(c, r"([A-Za-z]{2,})-\s+([A-Za-z]{1,3})(?=\b)", "$1$2"), r"([A-Za-z])-\s+([A-Za-z])", "$1 $2")
        return let(F.array_join(F.slice(lines, i, n), " "), lambda c: F.when(c.contains("- "), whole(c)).otherwise(c))

    def likeness(t: Column) -> Column:  # jaccard of distinct words
        common = F.size(F.array_intersect(wanted, t))
        return let(common, lambda n: F.when(n == 0, 0.0).otherwise(n / (F.size(wanted) + F.size(t) - n)))

    def window(i: Column, n: Column) -> Column:
        return let(join(i, n), lambda c: F.struct(let(_title_words(c), likeness).alias("similarity"), (-(i * 100 + n)).alias("order"), c.alias("candidate")))

    starts = F.sequence(F.lit(1), F.greatest(F.least(F.size(lines), F.lit(10)), F.lit(1)))
    counts = lambda i: F.sequence(F.lit(1), F.greatest(F.least(F.size(lines) - i + 1, F.lit(10)), F.lit(1)))
    return F.array_max(F.flatten(F.transform(starts, lambda i: F.transform(counts(i), lambda n: window(i, n)))))


def identity(title: Column, authors: Column, value: Column) -> Column:
    """struct(similarity, candidate, same_paper): the best title among a text's front lines, and whether the text is the
    paper by it and by the authors that stand there. Each part is made once a row."""
    given = F.struct(front_lines(value).alias("lines"), title_tokens(title).alias("wanted"), family_names(authors).alias("names"))

    def judged(x: Column) -> Column:
        seen = F.transform(F.regexp_extract_all(F.array_join(x["lines"], " "), F.lit("[A-Za-z][A-Za-z-]+"), F.lit(0)), F.lower)
        found = F.struct(_best(x["lines"], x["wanted"]).alias("top"), F.size(F.array_intersect(x["names"], seen)).alias("overlap"))

        def told(y: Column) -> Column:
            similarity, overlap = y["top"]["similarity"], y["overlap"]
            with_authors = ((similarity >= 0.82) & (overlap >= 1)) | ((similarity >= 0.78) & (overlap >= 2)) | ((similarity >= 0.70) & (overlap >= 4))
            same = (F.size(x["wanted"]) > 0) & F.when(F.size(x["names"]) == 0, similarity >= 0.92).otherwise(with_authors)
            return F.struct(similarity.alias("similarity"), F.when(similarity > 0, y["top"]["candidate"]).otherwise("").alias("candidate"), same.alias("same_paper"))

        return let(found, told)

    return let(given, judged)


def best_title(title: Column, value: Column) -> Column:
    """struct(similarity, candidate) of the best window of one to ten front lines; the earliest of equals."""

    def best(top: Column) -> Column:
        return F.struct(top["similarity"].alias("similarity"), F.when(top["similarity"] > 0, top["candidate"]).otherwise("").alias("candidate"))

    given = F.struct(front_lines(value).alias("lines"), title_tokens(title).alias("wanted"))
    return let(given, lambda x: let(_best(x["lines"], x["wanted"]), best))


def identity_ok(title: Column, authors: Column, value: Column) -> Column:
    """Whether a full text is the paper: title similarity and author overlap before its abstract."""
    return identity(title, authors, value)["same_paper"]
