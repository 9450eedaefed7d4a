"""The PDF reader on files made here and on hand-written oddities."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.sources import indexes, pdf, pdf_made
from corpusmill.sources.pdf_objects import Document, Font, Lexer, Ref, Stream, _cmap, _lzw, _predicted, font_of, glyph

WORDS = ["offer", "flat", "affair", "(one)", "café", "\\two", "three", "finite", "of", "a", "baffled"]


def a_page(r, two):
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    return [line(13)] if two or r.random() < 0.5 else [], [line(r.randint(1, 5)) for _ in range(r.randint(2, 9))], [line(r.randint(1, 4)) for _ in range(r.randint(2, 9))] if two else []


@pytest.mark.parametrize("style", [0, 1, 2])
def test_made_files(style):
    r = random.Random(style)
    for _ in range(30):
        pages = [a_page(r, r.random() < 0.6) for _ in range(r.randint(1, 5))]
        status, found = pdf.pages_of(pdf_made.made(pages, style))
        assert status == "ok"
        assert [[x for block in page for x in block] for page in found] == [[*head, *left, *right] for head, left, right in pages]


def test_wrong_cross_references_are_made_anew():
    pages = [(["Heading over it"], ["first line", "second line"], [])]
    for style in (0, 1, 2):
        raw = pdf_made.made(pages, style)
        for broken in (raw[:-25], raw.replace(b"startxref\n", b"startxref\n7"), b"%PDF-1.4 more\n" + raw):
            status, found = pdf.pages_of(broken)
            assert (status, [x for b in found[0] for x in b]) == ("repaired", ["Heading over it", "first line", "second line"])


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_any_damage_gives_a_status(data):
    raw = bytearray(pdf_made.made([(["Head"], ["one two", "three"], ["four", "five"])], data.draw(st.integers(0, 2))))
    for _ in range(data.draw(st.integers(1, 8))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    status, found = pdf.pages_of(bytes(raw[: data.draw(st.integers(0, len(raw)))]))
    assert status in ("ok", "empty", "not_pdf", "encrypted", "broken", "damaged", "oversized", "filter", "repaired") and isinstance(found, list)


def test_statuses():
    assert pdf.pages_of(None) == pdf.pages_of(b"") == pdf.pages_of(b"hello") == ("not_pdf", [])
    assert pdf.pages_of(b"%PDF-1.4 nothing else") == ("broken", [])
    assert pdf.pages_of(pdf_made.made([([], [], [])], 0)) == ("empty", [[]])


def one_page(content, resources=b"", more=b""):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 2 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Resources << " + resources + b" >> /Contents 4 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in enumerate(objects, 1)) + more + b"trailer << /Root 1 0 R >>"


def lines(raw):
    return [x for page in pdf.pages_of(raw)[1] for block in page for x in block]


def test_operators():
    assert lines(one_page(rb"BT /F 10 Tf 14 TL 72 700 Td (a\051\n\101) Tj T* [(b) -900 (c) 20 (d)] TJ (next) ' ET")) == ["a) A", "b cd", "next"]
    assert lines(one_page(b'BT /F 10 Tf 14 TL 72 700 Td 0 0 (quoted) " <6869> Tj ET')) == ["quotedhi"]
    # a page's own tree twice, turned text, an image inside the content, text drawn by scaled coordinates
    assert lines(one_page(b"BT /F 10 Tf 0 1 -1 0 30 300 Tm (turned) Tj ET BI /W 1 ID \x00(no) Tj EI q .5 0 0 .5 0 0 cm BT /F 20 Tf 100 900 Td (half) Tj ET Q")) == ["half"]


def test_forms_that_draw_themselves():
    form = b"9 0 obj << /Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 -20] /Resources << /XObject << /X 9 0 R >> >> /Length 44 >>\nstream\nBT /F 10 Tf 72 700 Td (in a form) Tj ET /X Do\nendstream endobj\n"
    assert lines(one_page(b"BT /F 10 Tf 72 700 Td (page) Tj ET /X Do", b"/XObject << /X 9 0 R >>", form)) == ["page", "in a form"]


def test_reading_order_below_a_heading():
    r = random.Random(1)
    for _ in range(40):
        left, right = r.randint(2, 30), r.randint(2, 30)
        put = [pdf.Piece(72, 520, 700, 10, "head")] + [pdf.Piece(72, 200 + r.random() * 80, 680 - 12 * i, 10, f"L{i}") for i in range(left)]
        put += [pdf.Piece(310, 400 + r.random() * 100, 674 - 12 * i, 10, f"R{i}") for i in range(right)] + [pdf.Piece(290, 300, 20, 10, "7")]
        r.shuffle(put)
        found = [x for b in pdf.blocks_of(put) for x in b]
        assert found == ["head", *[f"L{i}" for i in range(left)], *[f"R{i}" for i in range(right)], "7"]


def test_lexer():
    x = Lexer(rb"<< /A [1 -2.5 .5 (x\)\(y(z)) <4a4B4> /N#20m] % c" + b"\n/B 12 0 R /C true /D null >> (a\\\nb\\53)")
    assert x.next() == {"/A": [1, -2.5, 0.5, b"x)(y(z)", b"JK@", "/N m"], "/B": Ref(12), "/C": True, "/D": None}
    assert x.next() == b"ab+" and x.next() is None


def test_predictors_and_lzw():
    r = random.Random(2)
    rows = [bytes(r.randrange(256) for _ in range(12)) for _ in range(10)]
    coded, above = b"", bytes(12)
    for k, row in enumerate(rows):
        how = k % 5
        guess = []
        for j in range(12):
            a, b, c = (row[j - 3] if j >= 3 else 0), above[j], (above[j - 3] if j >= 3 else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            guess.append((0, a, b, (a + b) // 2, paeth)[how])
        coded += bytes([how]) + bytes((x - g) & 255 for x, g in zip(row, guess))
        above = row
    assert _predicted(coded, {"/Predictor": 15, "/Columns": 4, "/Colors": 3}) == b"".join(rows)
    assert _lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"


def test_damaged_and_unknown_streams():
    doc = Document(one_page(b""))
    text = b" ".join(b"%d" % (k * k % 9973) for k in range(3000))
    whole = zlib.compress(text)
    assert doc.data(Stream({"/Filter": ["/ASCIIHexDecode", "/FlateDecode"]}, whole.hex().encode() + b">")) == text and not doc.notes - {"repaired"}
    assert text.startswith(cut := doc.data(Stream({"/Filter": "/FlateDecode"}, whole[:-300]))) and len(cut) > len(text) / 2 and "damaged" in doc.notes
    doc.notes.clear()
    assert doc.data(Stream({"/Filter": "/A85"}, b"87cURD]j7BEbo80~>")) == b"Hello world!"
    broken = bytearray(whole)
    broken[len(broken) // 2 :] = b"\xff" * 40
    doc.data(Stream({"/Filter": "/FlateDecode"}, bytes(broken)))
    assert "damaged" in doc.notes and doc.data(Stream({"/Filter": "/Other"}, b"x")) == b"" and "filter" in doc.notes


def test_fonts():
    assert [glyph(n) for n in ("A", "fi", "f_f_i", "eacute", "Ccaron", "uni00660069", "u1F600", "one.alt", "nothing")] == ["A", "fi", "ffi", "é", "Č", "fi", "😀", "1", ""]
    font = Font(codec="")
    _cmap(font, b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfrange <0001> <0003> <0041> <0010> <0011> [<00660066> <FB02>] endbfrange 1 beginbfchar <0020> <D83DDE00> endbfchar")
    assert "".join(t for _, t, _ in font.read(bytes([0, 1, 0, 3, 0, 0x10, 0, 0x11, 0, 0x20, 0, 0x99]))) == "ACfffl😀"
    doc = Document(one_page(b""))
    wide = font_of(doc, {"/Subtype": "/Type0", "/Encoding": "/UniGB-UCS2-H", "/DescendantFonts": [{"/DW": 900, "/W": [1, [10, 20], 5, 7, 30]}]})
    assert [t for _, t, _ in wide.read("日本".encode("utf-16-be"))] == ["日", "本"]
    assert (wide.default, wide.widths) == (900.0, {1: 10.0, 2: 20.0, 5: 30.0, 6: 30.0, 7: 30.0})
    mac = font_of(doc, {"/Subtype": "/TrueType", "/Encoding": "/MacRomanEncoding"})
    assert [t for _, t, _ in mac.read(b"\x8e")] == ["é"]


def test_tables_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_made.made([(["Title"], ["x one", "y"], []), ([], ["z"], [])], 1))
    (tmp_path / "b.pdf").write_bytes(b"not one")
    (tmp_path / "c.txt").write_bytes(b"other")
    got = {r.path.rsplit("/", 1)[-1]: (r.status, r.n_pages, r.text) for r in pdf.read(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("ok", 2, "Title\nx one\ny\n\nz"), "b.pdf": ("not_pdf", 0, "")}
    none = spark.createDataFrame([(None, None)], "path string, content binary")
    assert pdf.texts(none).first().status == "not_pdf" and pdf.paragraphs(none).count() == 0 and pdf.texts(none.limit(0)).count() == 0


def test_programs_that_are_not_understood(spark):
    rows = [("p", 0, 0, ["cover"]), ("p", 0, 1, ["A title of", "a paper [Full]"]), ("p", 0, 2, ["Ada (U (x));", "Alan (V)", "An abstract " * 9]), ("p", 1, 0, ["Another paper here [demo]"]), ("p", 1, 1, ["Kurt (W)"])]
    rows += [("q", 0, 0, ["One more paper [Short]"]), ("q", 0, 1, [])]
    blocks = spark.createDataFrame(rows, "path string, page int, n int, lines array<string>")
    found = {r.title: (r.document, r.track, r.authors, len(r.abstract) > 0, r.page) for r in indexes.program_papers(blocks, 1).collect()}
    assert found == {"A title of a paper": ("p", "Full", ["Ada", "Alan"], True, 0), "Another paper here": ("p", "demo", ["Kurt"], False, 1)}
    assert indexes.program_papers(blocks, 3).count() == 0 and indexes.program_papers(blocks.limit(0), 1).count() == 0


def test_cross_references_of_large_files():
    """Files of more than 16 MB or of more than 65,536 packed objects need wider cross references."""
    for fill, n in ((b"<< /A 1 >>", 66_000), (None, 3)):
        w = pdf_made.Writer(True)
        for _ in range(n):
            w.add(fill or b"", None if fill else random.Random(n).randbytes(6 << 20))
        content = w.add(b"", b"BT ET")
        page = w.add(b"<< /Type /Page /Resources << >> /Contents %d 0 R >>" % content)
        tree = w.add(b"<< /Type /Pages /Kids [%d 0 R] /Count 1 /MediaBox [0 0 612 792] >>" % page)
        assert pdf.pages_of(w.file(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))) == ("empty", [[]])


def test_plain_objects_are_read_as_any_others():
    """The one pattern for plain objects against what stands behind it, and codes that a font looks up once."""
    said = b" 12 -3.5 .5 7 0 R 8 0 RG (a b) (a\\051(b)) <4 1> <414> <41> true null nulls T* ' \" %x\n% y\r1.2.3 +4 /N 5/M[1(x)]<</A 1>>"
    lexer, out = Lexer(said), []
    while (x := lexer.next()) is not None:
        out.append(x)
    assert out == [12, -3.5, 0.5, Ref(7), 8, 0, "RG", b"a b", b"a)(b)", b"A", b"A@", b"A", True, "null", "nulls", "T*", "'", '"', "1.2.3", 4, "/N", 5, "/M", [1, b"x"], {"/A": 1}]
    font, looked = Font(texts={65: "x"}), []
    letter, font._letter = font._letter, lambda one: (looked.append(one), letter(one))[1]
    assert [t for _, t, _ in font.read(b"ABABA")] == ["x", "B", "x", "B", "x"] and looked == [b"A", b"B"]


def test_lists_of_numbers_are_read_at_once(monkeypatch):
    """A list of widths is one step; what its pattern can't read is read an object at a time, with the same result."""
    r = random.Random(5)
    for _ in range(300):
        words = [r.choice([b"0", b"12", b"-7", b"+3", b".5", b"-.25", b"6.", b"1.75", b"007", b"3 0 R", b"/a", b"(1)", b"null", b"1-2", b"- 1", b"[1 2]", b"%c\n9"][: r.choice((9, 17))]) for _ in range(r.randint(0, 6))]
        raw = b"[" + r.choice((b"", b" ", b"\n")) + r.choice((b" ", b"\r\n", b"\x00")).join(words) + r.choice((b"", b" ")) + r.choice((b"]", b"")) + b" 5"
        slow, quick = Lexer(raw, 1), Lexer(raw)
        assert (slow._until("]"), slow.at) == (quick.next(), quick.at), raw
    calls, real = [], Lexer.next
    monkeypatch.setattr(Lexer, "next", lambda self: calls.append(1) or real(self))
    assert Lexer(b"[%s]" % b" ".join([b"500"] * 256)).next() == [500] * 256 and len(calls) == 1


def test_what_is_known_of_a_file_goes_along_with_it(spark, sf):
    """No join of files with texts made of the same rows; Spark took the made texts for small and sent them through the driver."""
    from corpusmill.plans import registry

    assert "Join" not in registry.QUERIES["pdf_statuses"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_programs_of_several_files(spark):
    """Papers are counted over all files of a program, and none goes on in the next file; one file without authors spoils its program."""
    rows = [("p", 1, 0, 0, ["One paper of many [Full]"]), ("p", 1, 0, 1, ["Ada (U)"]), ("p", 2, 0, 0, ["of the file before"]), ("p", 2, 0, 1, ["Another paper here [Short]"]), ("p", 2, 0, 2, ["Alan (V)"])]
    rows += [("q", 1, 0, 0, ["One more paper [Full]"]), ("q", 1, 0, 1, ["Ada (U)"]), ("q", 2, 0, 0, ["Papers of nobody [Full]"]), ("q", 2, 0, 1, [])]
    blocks = spark.createDataFrame(rows, "document string, volume int, page int, n int, lines array<string>").withColumn("path", F.struct("document", "volume"))
    found = {r.title: (r.document, r.authors, r.abstract) for r in indexes.program_papers(blocks, 2).collect()}
    assert found == {"One paper of many": ("p", ["Ada"], ""), "Another paper here": ("p", ["Alan"], "")}
    assert indexes.program_papers(blocks, 3).count() == 0


def test_files_of_programs_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """One brand with most of the parts is many files, all of them read once."""
    from corpusmill.plans import registry

    n, seen = 24_000, []
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("lace "), "id").alias("p_name"), F.when(F.col("id") % 100 < 99, "Brand#11").otherwise("Brand#2").alias("p_brand"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    real = pdf.paragraphs
    monkeypatch.setattr(pdf, "paragraphs", lambda files: seen.append(files) or real(files))
    out = registry.QUERIES["program_papers"](spark, str(tmp_path))
    assert "Arrow" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == sum(k % 11 != 0 for k in range(n))
    sizes = [r.n for r in seen[0].select(F.octet_length("content").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) < 3 << 20


def test_a_file_of_many_pages_holds_few_objects(spark):
    """Objects of pages that were read are let go, in all three styles, and the rows are those of the whole file."""
    lines = [([f"head {i}"], [f"left {i}", "more"], [f"right {i}", "more"]) for i in range(1500)]
    for style in range(3):
        raw = pdf_made.made(lines, style)
        doc, most = Document(raw), 0
        for page in doc.pages():
            doc.contents(page)
            doc.forget()
            most = max(most, len(doc._held))
        assert most <= 1010
        status, found = pdf.pages_of(raw)
        assert (status, len(found), found[7], found[1499]) == ("ok", 1500, pdf.pages_of(pdf_made.made(lines[7:8], style))[1][0], pdf.pages_of(pdf_made.made(lines[1499:], style))[1][0])
        files = spark.createDataFrame([("a", raw), ("b", b"none"), (None, raw)], "path string, content binary").coalesce(1)
        got = [(r.path, r.page, r.n, r.lines) for r in pdf.paragraphs(files).collect()]
        assert got == [(path, i, n, one) for path in ("a", None) for i, page in enumerate(found) for n, one in enumerate(page)]


def test_arrays_of_words_are_read_at_once(monkeypatch):
    """Hexadecimal strings with moves between them are one step, with the result of reading an object at a time; words are remembered within bounds."""
    r = random.Random(7)
    for _ in range(300):
        words = [r.choice([b"<0041>", b"<00410042>", b"-250", b"12", b".5", b"6.", b"+3", b"<aBcD>", b"<004>", b"<>", b"(x)", b"3 0 R", b"<<>>", b"- 1", b"1-2", b"%c\n9"][: r.choice((8, 16))]) for _ in range(r.randint(0, 6))]
        raw = b"[" + r.choice((b"", b" ", b"\n")) + r.choice((b" ", b"\r\n", b"", b"\x00")).join(words) + r.choice((b"", b" ")) + r.choice((b"]", b"")) + b" 5"
        slow, quick = Lexer(raw, 1), Lexer(raw)
        assert (slow._until("]"), slow.at) == (quick.next(), quick.at), raw
    calls, real = [], Lexer.next
    monkeypatch.setattr(Lexer, "next", lambda self: calls.append(1) or real(self))
    assert Lexer(b"[%s]" % b" -250 ".join([b"<0041>"] * 50)).next() == [b"\0A", -250] * 49 + [b"\0A"] and len(calls) == 1
    font = Font(texts={65: "x"}, widths={66: 7.0})
    for i in range(5000):
        assert font.word(b"AB%d" % i) == ("xB" + str(i), [(65, 500.0), (66, 7.0), *((ord(c), 500.0) for c in str(i))])
    assert len(font.words) <= 4096 and font.word(b"AB7")[0] == "xB7"
