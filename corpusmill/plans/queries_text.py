"""Queries of text functions on titles, abstracts, full texts and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.entities import clean_decoded
from corpusmill.plans.catalog import query
from corpusmill.session import spread, table

TITLE = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Abstract' ELSE concat('  ', upper(p_name), ' – Straße  ') END"


@query(
    f"""WITH t AS (SELECT p_partkey, trim({TITLE}) AS t FROM part)
    SELECT p_partkey, length(t) >= 8 AND contains(t, ' ') AND lower(t) <> 'abstract' AS is_title, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS spaced,
    replace(replace(lower(t), ' – ', '-'), 'ß', 'ss') AS normalized FROM t"""
)
def title_forms(spark, sf):
    """Whether a text can be a title, and its keys: spaced, and normalised with dashes and case folded."""
    t = F.expr(TITLE)
    return table(spark, sf, "part").select("p_partkey", T.looks_like_title(t).alias("is_title"), T.spaced_key(t).alias("spaced"), T.normalized_title(t).alias("normalized"))


@query("SELECT c_custkey, c_name || ' & <' || c_mktsegment || '> é' AS title FROM customer")
def entity_decoding(spark, sf):
    raw = F.expr("concat(c_name, ' &amp;  &lt;', c_mktsegment, '&gt; &#233; ')")
    return table(spark, sf, "customer").select("c_custkey", clean_decoded(raw).alias("title"))


@query("SELECT p_partkey, 'A summary of ' || p_name || CASE p_partkey % 4 WHEN 3 THEN ' show more text' ELSE '' END AS abstract FROM part")
def abstract_cleaning(spark, sf):
    """Expand and collapse controls of web pages go, where they end the text."""
    raw = F.expr("concat(' A summary of  ', p_name, CASE p_partkey % 4 WHEN 0 THEN ' Show more' WHEN 1 THEN ' Read less. 展开' WHEN 2 THEN ' 显示更多 。' ELSE ' show more text' END)")
    return table(spark, sf, "part").select("p_partkey", T.clean_abstract(raw).alias("abstract"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_texts(spark, sf):
    """ISO dates at a text's start; other forms and days that don't exist are none."""
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm\") WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN '2024-13-01' ELSE ' ' END")
    return table(spark, sf, "orders").select("o_orderkey", T.date_text(raw).cast("string").alias("day"))


@query("SELECT c_custkey, lower(c_mktsegment) || '|lovelace-byron' AS names FROM customer")
def family_name_sets(spark, sf):
    names = F.expr("array(c_mktsegment, concat('Ann  B. ', c_mktsegment), '123', 'Ada Lovelace-Byron', NULL)")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(T.family_names(names), "|").alias("names"))


@query(
    """WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM conversations)
    SELECT conv_id, turn, len(s) AS n, sha256(array_to_string(s, '|')) AS parts FROM s"""
)
def sentence_split(spark, sf):
    s = T.sentences(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(s).cast("bigint").alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("parts"))


@query("SELECT p_partkey, p_partkey % 6 = 1 AS latex, CASE p_partkey % 6 WHEN 3 THEN 'formula_runs_over_line' WHEN 4 THEN 'formula_marks_differ' WHEN 5 THEN 'formula_left_open' ELSE '' END AS formula FROM part")
def markup_checks(spark, sf):
    """LaTeX outside formulas, and what is wrong with dollar signs."""
    samples = ["plain {}", r"a \alpha {}", r"a $\alpha$ {} `\beta`", "a $x {}\ny$", "$$x {}$", "x {} $$y"]
    t = F.element_at(F.array(*[F.concat(*[F.lit(x) if i == 0 else F.concat(F.col("p_name"), F.lit(x)) for i, x in enumerate(s.split("{}"))]) for s in samples]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.unresolved_latex(t).alias("latex"), T.formula_error(t).alias("formula"))


@query(
    """SELECT p_partkey, '10.' || (1000 + p_partkey % 9000) || '/ab.' || p_partkey AS doi, p_name AS marked, trim(repeat(p_name || ' ', 12)) AS abstract, '[PDF](https://x/' || p_partkey || ')' AS link FROM part"""
)
def parts_of_texts(spark, sf):
    """DOI, what stands between markers, the abstract of a full text, a Markdown link."""
    rows = table(spark, sf, "part")
    found = F.expr("concat('see https://doi.org/10.', 1000 + p_partkey % 9000, '/Ab.', p_partkey, ').')")
    page = F.concat(F.lit("x\nAbstract\n "), F.col("p_name"), F.lit(" \nVideo\nz\nPoster\n"))
    paper = F.concat(F.lit("A Title\nABSTRACT: "), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(12)), F.lit("\n1. Introduction\nWe begin."))
    link = T.markdown_link("PDF", F.expr("concat(' https://x/', p_partkey)"))
    return rows.select("p_partkey", T.doi(found).alias("doi"), T.between(page, "Abstract", ["\nPoster\n", "\nVideo\n"]).alias("marked"), T.abstract_of_full_text(paper).alias("abstract"), link.alias("link"))


SOURCE = "we show that the model is able to learn from few labelled examples"


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'little_chinese' WHEN 2 THEN 'copies_source' WHEN 3 THEN 'english_sentences' ELSE '' END AS issue, c_custkey % 4 = 3 OR c_custkey % 4 = 2 AS prose FROM customer"""
)
def translation_checks(spark, sf):
    """Why a text is no Chinese translation: too little Chinese, a copied run, a long English sentence."""
    chinese = "这是一个关于模型学习的中文摘要内容描述方法与结果" * 4
    other = "and this is a new line of the text that we have for you in all of the parts"
    t = F.element_at(F.array(*[F.lit(x) for x in (chinese, "only english words here", f"{chinese}\n{SOURCE}", f"{chinese}\n{other}")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", T.translation_issue(t, F.lit(SOURCE)).alias("issue"), T.long_english_prose(t).alias("prose"))


BODY = "concat('Introduction\\n', CASE WHEN doc_id % 2 = 0 THEN '2. Methods:\\n' ELSE '' END, text, '\\nResults\\nx', CASE WHEN doc_id % 3 = 0 THEN '\\nReferences\\nr' ELSE '' END)"


@query(
    f"""WITH b AS (SELECT doc_id, length({BODY.replace(chr(92) + 'n', "' || chr(10) || '")}) AS n FROM documents)
    SELECT doc_id, n >= 1200 AND (n >= 8000 OR (doc_id % 2 = 0 AND doc_id % 3 = 0)) AS ok, n >= 1200 AND doc_id % 2 = 0 AND (doc_id % 3 = 0 OR n >= 8000) AS built FROM b"""
)
def full_text_sections(spark, sf):
    """Full texts by length and by the sections that they show."""
    body = F.expr(BODY)
    return table(spark, sf, "documents").select("doc_id", T.body_ok(body).alias("ok"), T.body_ok(body, require_sections=True).alias("built"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 0.0 ELSE 1.0 END AS similarity, p_partkey % 4 IN (0, 3) AS same_paper FROM part")
def full_text_identity(spark, sf):
    """Whether a text's front matter is the paper's: its title in one line or over two, and an author."""
    title = F.expr("concat('Deep ', p_name, ' models for ', p_type, ' learning')")
    front = F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN concat('Venue 2024\\n', t, '\\nAda Lovelace, Alan Turing') WHEN 1 THEN concat(t, '\\nNobody Else') "
        "WHEN 2 THEN 'Gardens and birds\\nAda Lovelace' ELSE concat(regexp_replace(t, ' models', '\\n models'), '\\nAda Lovelace') END"
    )
    rows = spread(table(spark, sf, "part")).withColumn("t", title).withColumn("v", F.concat(front, F.lit("\nAbstract\nDeep learning of everything.")))
    authors = F.array(F.lit("Ada Lovelace"), F.lit("Alan Turing"))
    return rows.select("p_partkey", T.identity(F.col("t"), authors, F.col("v")).alias("found")).select("p_partkey", "found.similarity", "found.same_paper")


@query(
    """WITH p AS (SELECT p_partkey, [34, 35, 38, 39, 40, 41, 45, 46][p_partkey % 8 + 1] AS m, (p_partkey // 8) % 6 AS a FROM part)
    SELECT p_partkey, m / 50.0 AS similarity, CASE WHEN a = 5 THEN m >= 46 ELSE m >= 41 AND a >= 1 OR m >= 39 AND a >= 2 OR m >= 35 AND a >= 4 END AS same_paper FROM p"""
)
def identity_thresholds(spark, sf):
    """Titles that share 34 to 46 of 50 words with a text, and none to four of its authors: every bound of the acceptance."""
    k = F.col("p_partkey")
    m = F.element_at(F.array(*[F.lit(x) for x in (34, 35, 38, 39, 40, 41, 45, 46)]), (k % 8 + 1).cast("int"))
    a = (F.floor(k / 8) % 6).cast("int")
    words, names = F.array(*[F.lit(f"q{x}") for x in range(10, 60)]), F.array(*[F.lit(x) for x in ("Ada One", "Bob Two", "Cy Three", "Di Four")])
    front = F.concat(F.array_join(F.slice(words, F.lit(1), m), " "), F.lit("\nby "), F.array_join(F.slice(names, F.lit(1), F.when(a == 5, 0).otherwise(a)), ", "), F.lit("\nAbstract\nOf words."))
    authors = F.when(a == 5, F.array().cast("array<string>")).otherwise(names)
    title = F.array_join(words, " ")
    return spread(table(spark, sf, "part")).select("p_partkey", T.identity(title, authors, front).alias("found")).select("p_partkey", "found.similarity", "found.same_paper")


@query("SELECT c_custkey, 'a b ' || lower(c_mktsegment) || ' b' AS abstract FROM customer")
def abstract_of_inverted_index(spark, sf):
    """A text from the positions of its words."""
    index = F.create_map(F.lit("b"), F.array(F.lit(3), F.lit(1)), F.lower("c_mktsegment"), F.array(F.lit(2)), F.lit("a"), F.array(F.lit(0)))
    return table(spark, sf, "customer").select("c_custkey", T.from_inverted_index(index).alias("abstract"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN 1 THEN 'y' ELSE '' END AS body FROM conversations")
def named_sections(spark, sf):
    """A named section, the one asked for by turn: between headings, the last, or none of that name."""
    page = F.concat(F.lit("# T\n## 摘要\nx\n## 方法\n"), F.col("text"), F.lit("\n## 实验结果\ny\n"))
    wanted = F.col("turn") % 3
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(wanted == 0, T.section(page, "方法")).when(wanted == 1, T.section(page, "实验结果")).otherwise(T.section(page, "优缺点总结")).alias("body"))
