"""Text of PDF files, without any PDF library: files become pages, pages become lines in reading order.

Pages are read through cross-reference tables and streams, object streams and the page tree; text through fonts'
encodings and ToUnicode maps (one-byte and composite fonts), form XObjects included. A page is cut into blocks
at gutters that no text crosses, where need be below a heading that crosses them; blocks are read from the left,
lines from the top. Ligatures become letters. Turned text is left out.

A file's status: ok, empty (no text), not_pdf, encrypted, broken; or with what could be read, damaged (a stream ends
early), oversized (a stream is larger than may be inflated), filter (a kind of compression that isn't known),
repaired (the cross references were wrong). Null content is empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusmill.sources.pdf_objects import Document, PdfError, Piece, shown

#: In sizes of the text: a gap that is a space, one that parts two segments of a line, how far base lines of one line may differ.
SPACE, APART, SAME_LINE = 0.17, 1.0, 0.4
#: The distance of base lines that parts two paragraphs.
PARAGRAPH = 1.8
#: Lines that a column has at least.
COLUMN_LINES = 2
#: Paragraphs of a file that are held as objects, and rows that go on together.
ROWS = 2000


def segments(pieces: list[Piece]) -> list[Piece]:
    """Pieces of one base line joined where they are near each other, with spaces where there are gaps."""
    out: list[Piece] = []
    lines: list[list[Piece]] = []
    for p in sorted(pieces, key=lambda p: -p.base):
        if lines and abs(lines[-1][0].base - p.base) <= SAME_LINE * min(p.size, lines[-1][0].size):
            lines[-1].append(p)
        else:
            lines.append([p])
    for line in lines:
        last = None
        for p in sorted(line, key=lambda p: p.left):
            size = min(p.size, last.size) if last else p.size
            if last and p.left - last.right <= APART * size:
                gap = " " if p.left - last.right > SPACE * size and not last.text.endswith(" ") and not p.text.startswith(" ") else ""
                last = Piece(last.left, max(last.right, p.right), last.base, max(last.size, p.size), last.text + gap + p.text)
                out[-1] = last
            else:
                last = p
                out.append(p)
    return out


def _gutter(parts: list[Piece]) -> float | None:
    """The middle of the widest gap from left to right that no segment crosses, with lines enough on both sides."""
    best, reach = None, None
    for p in sorted(parts, key=lambda p: p.left):
        if reach is not None and p.left - reach > APART * p.size and (best is None or p.left - reach > best[0]):
            sides = [len({round(q.base) for q in parts if (q.left >= p.left) == right}) for right in (False, True)]
            if min(sides) >= COLUMN_LINES:
                best = (p.left - reach, (p.left + reach) / 2)
        reach = p.right if reach is None else max(reach, p.right)
    return best and best[1]


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Spans without overlaps."""
    out: list[tuple[float, float]] = []
    for left, right in sorted(spans):
        if out and left <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], right))
        else:
            out.append((left, right))
    return out


def blocks(parts: list[Piece]) -> list[list[Piece]]:
    """Segments of a page as blocks in reading order, by cuts at gutters."""
    middle = _gutter(parts)
    if middle is not None:
        return blocks([p for p in parts if p.left < middle]) + blocks([p for p in parts if p.left >= middle])
    # no gutter through all lines: the most lines below each other that have one
    heights = sorted({p.base for p in parts}, reverse=True)
    rows: dict[float, list[Piece]] = {y: [] for y in heights}
    for p in parts:
        rows[p.base].append(p)
    best = None
    for low in range(len(heights)):
        if best and len(heights) - low <= best[1] - best[0]:
            break
        taken: list[tuple[float, float]] = []
        parted = []  # whether the lines from low on leave a gap, by their last
        for y in heights[low:]:
            taken = _merged([*taken, *((p.left, p.right) for p in rows[y])])
            parted.append(len(taken) > 1)
        for high in range(len(heights), low + COLUMN_LINES - 1, -1):
            if best and high - low <= best[1] - best[0]:
                break
            if parted[high - 1 - low] and _gutter([p for y in heights[low:high] for p in rows[y]]) is not None:
                best = (low, high)
                break
    if best is None:
        return [parts] if parts else []
    top, bottom = heights[best[0]], heights[best[1] - 1]
    above, inside, below = ([p for p in parts if test(p)] for test in (lambda p: p.base > top, lambda p: bottom <= p.base <= top, lambda p: p.base < bottom))
    return blocks(above) + blocks(inside) + blocks(below)


def blocks_of(pieces: list[Piece]) -> list[list[str]]:
    """Lines of a page's paragraphs, in reading order."""
    out: list[list[str]] = []
    for block in blocks(segments(pieces)):
        before = None
        for p in sorted(block, key=lambda p: (-p.base, p.left)):
            said = " ".join(p.text.split())
            if not said:
                continue
            if before is not None and before.base == p.base:
                out[-1][-1] += " " + said
            elif before is None or before.base - p.base > PARAGRAPH * max(p.size, before.size):
                out.append([said])
            else:
                out[-1].append(said)
            before = p
    return out


def read_pages(raw: bytes | None, keep: Callable[[list[list[str]]], object]) -> str:
    """Status of a file; keep gets its pages in order, each as lists of lines. What it got of a broken file counts for nothing."""
    n = said = 0
    try:
        doc = Document(raw or b"")
        for page in doc.pages():
            found = blocks_of(list(shown(doc, doc.contents(page), doc.get(page.get("/Resources")) or {})))
            keep(found)
            n, said = n + 1, said + bool(found)
            doc.forget()
        for data in () if n else doc.loose():
            found = blocks_of(list(shown(doc, data, {})))
            keep(found)
            n, said = n + 1, said + bool(found)
    except PdfError as e:
        return str(e) if str(e) in ("not_pdf", "encrypted") else "broken"
    except (ValueError, IndexError, KeyError, TypeError, AttributeError, OverflowError, RecursionError, zlib.error):
        return "broken"
    worst = [s for s in ("damaged", "oversized", "filter", "repaired") if s in doc.notes]
    return "broken" if not n else worst[0] if worst else "ok" if said else "empty"


def pages_of(raw: bytes | None) -> tuple[str, list[list[list[str]]]]:
    """Status and every page of a file: its paragraphs, each a list of lines."""
    out: list[list[list[str]]] = []
    status = read_pages(raw, out.append)
    return status, [] if status == "broken" else out


_PAGES = "struct<status: string, pages: array<array<array<string>>>>"


def pages(content: Column) -> Column:
    """Struct of status and pages of a file given as bytes; a page is an array of paragraphs, each an array of lines."""

    def read_all(files: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.list_(pa.string())))
        states, found, held, n_pages = [], [pa.array([], kind)], [], 0
        for raw in files:  # a file at a time; what was read is kept as Arrow, not as objects
            status, some = pages_of(raw.as_py())
            states.append(status)
            held.append(some)
            n_pages += len(some)
            if n_pages >= 1000:
                found.append(pa.array(held, kind))
                held, n_pages = [], 0
        found.append(pa.array(held, kind))
        return pa.StructArray.from_arrays([pa.array(states, pa.string()), pa.concat_arrays(found)], names=["status", "pages"])

    return F.arrow_udf(read_all, _PAGES)(content)


def joined(found: Column) -> Column:
    """The text of a file's pages: lines by line ends, pages by an empty line."""
    return F.array_join(F.transform(found, lambda page: F.array_join(F.flatten(page), "\n")), "\n\n")


def text(content: Column) -> Column:
    """Text of PDF files given as bytes; empty if there is none."""
    return joined(pages(content)["pages"])


def texts(files: DataFrame) -> DataFrame:
    """path, status, n_pages, text of files (path, content)."""
    out = files.select("path", pages(F.col("content")).alias("found"))
    return out.select("path", "found.status", F.size("found.pages").alias("n_pages"), joined(F.col("found.pages")).alias("text"))


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of paragraphs: of a file its bytes, some pages as objects and the rest as Arrow are held at a time."""
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()))
    for batch in batches:
        paths, waiting, n_waiting = batch.column("path"), [], 0

        def taken() -> pa.RecordBatch:
            at, *found = [pa.concat_arrays(some) for some in zip(*waiting)]
            waiting.clear()
            return pa.RecordBatch.from_arrays([paths.take(at), *found], names=["path", "page", "n", "lines"])

        for i, raw in enumerate(batch.column("content")):
            rows, done, n_pages = [], [], 0

            def put() -> None:
                done.append([pa.array([i] * len(rows), pa.int32()), *[pa.array(some, kind) for some, kind in zip(zip(*rows), kinds)]])
                rows.clear()

            def keep(page: list[list[str]]) -> None:
                nonlocal n_pages
                rows.extend((n_pages, n, lines) for n, lines in enumerate(page))
                n_pages += 1
                if len(rows) >= ROWS:
                    put()

            status = read_pages(raw.as_py(), keep)
            if status == "broken":
                continue
            if rows:
                put()
            for some in done:
                waiting.append(some)
                n_waiting += len(some[0])
                if n_waiting >= ROWS:
                    yield taken()
                    n_waiting = 0
        if waiting:
            yield taken()


def paragraphs(files: DataFrame) -> DataFrame:
    """path, page, n, lines of files (path, content): a row a paragraph, in reading order, pages and paragraphs from 0."""
    kind = StructType([files.schema["path"], *[StructField(c, IntegerType(), False) for c in ("page", "n")], StructField("lines", ArrayType(StringType()))])
    return files.select("path", "content").mapInArrow(_paragraphs, kind)


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, status, n_pages, text of every PDF file below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    return texts(files.select("path", "content"))


def program_lines(files: DataFrame) -> DataFrame:
    """document, n, line of conference programs (path, content), in reading order of their columns, all pages through."""
    every = F.flatten(F.flatten(pages(F.col("content"))["pages"]))
    return files.select(F.col("path").alias("document"), F.posexplode(every).alias("n", "line")).where(F.trim("line") != "")
