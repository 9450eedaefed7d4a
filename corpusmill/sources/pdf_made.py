"""PDF files made of lines, to prove the reader on: compressed, of several pages, in the forms that papers come in."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that one glyph stands for.
LIGATURES = {"ffi": "ﬃ", "ffl": "ﬄ", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ"}
WIDTH, SIZE, LEAD = 500, 10, 14


def _composed(line: str) -> str:
    for letters, one in LIGATURES.items():
        line = line.replace(letters, one)
    return line


def _placed(lines: list[str], left: float, top: float) -> list[tuple[float, float, str]]:
    return [(left, top - LEAD * i, line) for i, line in enumerate(lines)]


class Writer:
    """Objects of one file; `packed` puts them into an object stream with a cross-reference stream."""

    def __init__(self, packed: bool):
        self.packed, self.objects = packed, []

    def add(self, body: bytes, stream: bytes | None = None) -> int:
        if stream is not None:
            data = zlib.compress(stream)
            body = b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(data), body, data)
        self.objects.append((body, stream is not None))
        return len(self.objects)

    def file(self, root: int) -> bytes:
        out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
        loose = [(i, b) for i, (b, is_stream) in enumerate(self.objects, 1) if is_stream or not self.packed]
        inner = [(i, b) for i, (b, is_stream) in enumerate(self.objects, 1) if self.packed and not is_stream]
        pack = len(self.objects) + 1
        if inner:
            heads, at = [], 0
            for i, b in inner:
                heads.append(b"%d %d" % (i, at))
                at += len(b) + 1
            head = b" ".join(heads) + b"\n"
            data = zlib.compress(head + b"\n".join(b for _, b in inner))
            loose.append((pack, b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(inner), len(head), len(data), data)))
        for i, b in loose:
            places[i] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (i, b)
        start = len(out)
        if not self.packed:
            out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(self.objects) + 1)
            out += b"".join(b"%010d 00000 n \n" % places[i] for i in range(1, len(self.objects) + 1))
            out += b"trailer\n<< /Size %d /Root %d 0 R >>\n" % (len(self.objects) + 1, root)
        else:
            inside = {i: k for k, (i, _) in enumerate(inner)}
            wide = lambda most, least: max(least, (most.bit_length() + 7) // 8)  # noqa: E731  fields as wide as the file needs
            one, two = wide(max(start, pack), 3), wide(len(inner), 2)
            row = lambda kind, a, b: bytes([kind]) + a.to_bytes(one, "big") + b.to_bytes(two, "big")
            rows = [row(0, 0, 0)] + [row(2, pack, inside[i]) if i in inside else row(1, places.get(i, start), 0) for i in range(1, pack + 2)]
            up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(now, before)) for now, before in zip(rows, [bytes(1 + one + two), *rows]))
            data = zlib.compress(up)
            out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 %d %d] /Root %d 0 R /Length %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns %d >> >>\nstream\n%s\nendstream\nendobj\n" % (pack + 1, pack + 2, one, two, root, len(data), 1 + one + two, data)
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def _simple_font(w: Writer) -> tuple[int, callable]:
    """One-byte codes, ligatures by glyph names."""
    names = {"ﬀ": (1, b"ff"), "ﬁ": (2, b"fi"), "ﬂ": (3, b"fl"), "ﬃ": (4, b"f_f_i"), "ﬄ": (5, b"ffl")}
    widths = b" ".join([b"%d" % WIDTH] * 256)
    font = w.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /F /FirstChar 0 /LastChar 255 /Widths [%s] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 %s] >> >>" % (widths, b" ".join(b"/" + n for _, n in names.values())))

    def coded(line: str) -> bytes:
        raw = b"".join(bytes([names[c][0]]) if c in names else c.encode("cp1252", "replace") for c in line)
        return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"

    return font, coded


def _composite_font(w: Writer, letters: list[str]) -> tuple[int, callable]:
    """Two-byte codes that mean nothing without their map: one letter a code, ligatures to their letters."""
    code = {c: i + 7 for i, c in enumerate(letters)}
    told = {c: next((k for k, v in LIGATURES.items() if v == c), c) for c in letters}
    rows = [b"<%04x> <%s>" % (code[c], told[c].encode("utf-16-be").hex().encode()) for c in letters]
    parts = [b"%d beginbfchar\n%s\nendbfchar" % (len(rows[i : i + 100]), b"\n".join(rows[i : i + 100])) for i in range(0, len(rows), 100)]
    cmap = w.add(b"", b"/CIDInit /ProcSet findresource begin begincmap\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n%s\nendcmap" % b"\n".join(parts))
    inner = w.add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /G /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 400 /W [7 %d %d] >>" % (7 + len(letters), WIDTH))
    font = w.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /G /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (inner, cmap))
    return font, lambda line: b"<" + b"".join(b"%04x" % code[c] for c in line) + b">"


def made(pages: list[tuple[list[str], list[str], list[str]]], style: int) -> bytes:
    """A file of pages, each a heading, a left and a right column.

    style 0: cross-reference table, one-byte font, a string a line; 1: cross-reference and object streams, composite
    font, words set apart by moves instead of spaces; 2: as 1, with the right column in a form XObject and drawn first.
    """
    w = Writer(packed=style > 0)
    lines = [[[_composed(x) for x in part] for part in page] for page in pages]
    if style == 0:
        font, coded = _simple_font(w)
    else:
        font, coded = _composite_font(w, sorted({c for page in lines for part in page for line in part for c in line}))
    resources = b"/Font << /F1 %d 0 R >>" % font

    def drawn(placed) -> bytes:
        out = [b"BT /F1 %d Tf" % SIZE]
        for x, y, line in placed:
            words = line.split(" ")
            if style:  # a word after the other, a space's width between
                said = b"[" + (b" %d " % -(WIDTH // 2)).join(coded(word) for word in words) + b"] TJ"
            else:
                said = coded(line) + b" Tj"
            out.append(b"1 0 0 1 %g %g Tm %s" % (x, y, said))
        return b"\n".join([*out, b"ET"])

    tree = len(w.objects) + 1 + sum(2 + (style == 2) for _ in lines)  # the number that the page tree will have
    kids = []
    for head, left, right in lines:
        top, columns = _placed(head, 72, 740), 740 - LEAD * (len(head) + 1)
        one, two = _placed(left, 72, columns), _placed(right, 330, columns)
        own = resources
        if style == 2:
            form = w.add(b"/Type /XObject /Subtype /Form /BBox [0 0 612 792] /Matrix [1 0 0 1 0 0] /Resources << %s >>" % resources, drawn(two))
            own += b" /XObject << /X1 %d 0 R >>" % form
            stream = b"q /X1 Do Q\n" + drawn(one + top)
        else:
            stream = drawn(top) + b"\n" + drawn([x for pair in zip(one, two) for x in pair] + one[len(two) :] + two[len(one) :])
        content = w.add(b"", stream)
        kids.append(w.add(b"<< /Type /Page /Parent %d 0 R /Resources << %s >> /Contents %d 0 R >>" % (tree, own, content)))
    w.add(b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids)))
    return w.file(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))


def of_lines(pages: Column, style: Column) -> Column:
    """Files of pages: array<struct<head, left, right: array<string>>>, in one of three styles."""

    def make(many: pa.Array, styles: pa.Array) -> pa.Array:
        return pa.array([made([(p["head"], p["left"], p["right"]) for p in some.as_py()], s) for some, s in zip(many, styles.to_pylist())], pa.binary())  # a file at a time

    return F.arrow_udf(make, "binary")(pages, style.cast("int"))
