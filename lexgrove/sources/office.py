"""Word and slide files as lines. These are archives of XML, so they are parsed in Python, a file at a time, in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
# Names of heading styles in several languages, and parts of a Word file that are not its body.
HEADING = re.compile(r"(?:heading|überschrift|titre|título|titolo|제목)\s*-?(\d)", re.I)
TITLE = re.compile(r"(?:title|titel|제목)$", re.I)
SLIDE_WIDTH = 12192000
SIDE_PARTS = {"footnotes": "footnotes", "endnotes": "endnotes", "header": "headers", "footer": "footers"}


def _word_text(node) -> str:
    out = []
    for e in node.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag in (W + "tab",):
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def _blocks(node) -> Iterator:
    """Paragraphs and tables in order, those of content controls included."""
    for e in node:
        if e.tag in (W + "p", W + "tbl"):
            yield e
        elif e.tag in (W + "sdt", W + "sdtContent", W + "ins", W + "customXml"):
            yield from _blocks(e)


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(" ".join(c.split()) for c in cells) + " |"


def docx_lines(content: bytes) -> tuple[list[str], list[str]]:
    """Lines of a Word file, headings as '#' lines and tables as rows of pipes; and its parts whose text the body lacks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(W + "style"):
                name = s.find(W + "name")
                styles[s.get(W + "styleId")] = name.get(W + "val") if name is not None else ""
        lines = []
        for e in _blocks(body):
            if e.tag == W + "tbl":
                rows = [_row(["\n".join(_word_text(p) for p in c.iter(W + "p")) for c in r.findall(W + "tc")]) for r in e.iter(W + "tr")]
                lines += ["", *rows, ""]
                continue
            text = _word_text(e).strip()
            if not text:
                continue
            style = e.find(f"{W}pPr/{W}pStyle")
            name = styles.get(style.get(W + "val"), style.get(W + "val")) if style is not None else ""
            level = HEADING.search(name or "")
            if level:
                lines.append("#" * min(6, int(level[1]) + 1) + " " + text)
            elif TITLE.search(name or ""):
                lines.append("# " + text)
            elif e.find(f"{W}pPr/{W}numPr") is not None:
                lines.append("- " + text)
            else:
                lines += [text, ""]
        whole, dropped = " ".join(" ".join(lines).split()), []
        for part in sorted(z.namelist()):
            kind = next((v for k, v in SIDE_PARTS.items() if re.fullmatch(rf"word/{k}\d*\.xml", part)), None)
            if kind and kind not in dropped:
                for p in ElementTree.fromstring(z.read(part)).iter(W + "p"):
                    text = " ".join(_word_text(p).split())
                    if text and not re.fullmatch(r"(?i)(?:page\s*)?[\d\s/ofIVX-]*", text) and text not in whole:
                        dropped.append(kind)
                        break
        return lines, dropped


def _slide_number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def slide_shapes(content: bytes) -> list[tuple[int, int, int | None, int | None, int, int, str]]:
    """(slide, shape, x, y, cx, slide width, text) of a deck's shapes with text, groups' offsets added, tables as rows of pipes; x and y are null if a shape's layout places it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        size = ElementTree.fromstring(z.read("ppt/presentation.xml")).find(P + "sldSz") if "ppt/presentation.xml" in z.namelist() else None
        width = int(size.get("cx")) if size is not None else SLIDE_WIDTH
        out = []
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_slide_number):
            tree = ElementTree.fromstring(z.read(name)).find(f"{P}cSld/{P}spTree")
            for k, (x, y, cx, text) in enumerate(_walk(tree, 0, 0)):
                out.append((_slide_number(name), k, x, y, cx, width, text))
        return out


def _walk(node, dx: int, dy: int) -> Iterator[tuple[int | None, int | None, int, str]]:
    for e in node:
        box = e.find(f".//{A}xfrm") if e.tag != P + "graphicFrame" else e.find(P + "xfrm")
        off, ext = (box.find(A + "off"), box.find(A + "ext")) if box is not None else (None, None)
        x, y = (int(off.get("x")), int(off.get("y"))) if off is not None else (0, 0)
        cx = int(ext.get("cx")) if ext is not None else 0
        if e.tag == P + "grpSp":
            inner = box.find(A + "chOff") if box is not None else None
            ix, iy = (int(inner.get("x")), int(inner.get("y"))) if inner is not None else (0, 0)
            yield from _walk(e, dx + x - ix, dy + y - iy)
        elif e.tag in (P + "sp", P + "graphicFrame"):
            table = e.find(f".//{A}tbl")
            if table is not None:
                text = "\n".join(_row(["".join(t.text or "" for t in c.iter(A + "t")) for c in r.findall(A + "tc")]) for r in table.iter(A + "tr"))
            else:
                text = "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(A + "t")).strip() for p in e.iter(A + "p"))))
            if text:
                yield (x + dx, y + dy, cx, text) if off is not None else (None, None, cx, text)


def slide_notes(content: bytes) -> list[tuple[int, str]]:
    """(slide, notes) of a deck, lines that are the slide's number left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        out = []
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/notesSlides/notesSlide\d+\.xml", n)), key=_slide_number):
            lines = ["".join(t.text or "" for t in p.iter(A + "t")).strip() for p in ElementTree.fromstring(z.read(name)).iter(A + "p")]
            text = "\n".join(x for x in lines if x and x != str(_slide_number(name)))
            if text:
                out.append((_slide_number(name), text))
        return out


def _docx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                lines, dropped = docx_lines(content.as_py())
                rows.append((file, "\n".join(lines), dropped, None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                rows.append((file, None, [], f"{type(e).__name__}: {e}"))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "text", "dropped", "error"])


def word_files(files: DataFrame) -> DataFrame:
    """files with content -> (file, text, dropped, error) of .docx files; a file that can't be read gives its error."""
    return files.where("ext = '.docx'").select("file", "content").mapInArrow(_docx, "file string, text string, dropped array<string>, error string")


def media_count(content: bytes) -> int:
    """Pictures, sounds and films of a deck."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return sum(n.startswith("ppt/media/") and not n.endswith("/") for n in z.namelist())


#: Numbers of rows of a deck that are no shapes: its speaker's notes, its count of media, its error.
_NOTES, _MEDIA, _ERROR = 10**6, 10**6 + 1, 10**6 + 2


def _pptx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "slide", "shape", "x", "y", "cx", "width", "text"]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
    for b in batches:
        rows = []
        for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                found = [(file, *s) for s in slide_shapes(content.as_py())]
                found += [(file, s, _NOTES, 0, 0, 0, 1, "Speaker notes:\n" + t) for s, t in slide_notes(content.as_py())]
                rows += [*found, (file, 0, _MEDIA, 0, 0, media_count(content.as_py()), 1, None)]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                rows.append((file, 0, _ERROR, 0, 0, 0, 1, f"{type(e).__name__}: {e}"))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def deck_rows(files: DataFrame) -> DataFrame:
    """files with content -> rows of .pptx files: shapes, notes, the count of media, or the error of a deck that can't be read."""
    return files.where("ext = '.pptx'").select("file", "content").mapInArrow(_pptx, "file string, slide long, shape long, x long, y long, cx long, width long, text string")


def deck_facts(rows: DataFrame) -> DataFrame:
    """(file, media, error) of decks."""
    of = lambda kind, column: F.max(F.when(F.col("shape") == kind, F.col(column)))
    return rows.groupBy("file").agg(F.coalesce(of(_MEDIA, "cx"), F.lit(0)).alias("media"), of(_ERROR, "text").alias("error"))


def slide_texts(rows: DataFrame) -> DataFrame:
    """deck_rows() -> (file, slide, text): shapes in reading order by slide_order(), then the speaker's notes."""
    from ..operators.corpus import slide_order

    keyed = rows.withColumn("number", F.col("slide")).withColumn("slide", F.concat_ws("#", "file", "slide"))
    placed = slide_order(keyed.where(F.col("shape") < _NOTES)).select("file", "number", "place", "text")
    notes = keyed.where(F.col("shape") == _NOTES).select("file", "number", F.lit(1 << 30).alias("place"), "text")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n")
    return placed.union(notes).groupBy("file", "number").agg(joined.alias("text")).select("file", F.col("number").alias("slide"), "text")


def slide_files(files: DataFrame) -> DataFrame:
    """files with content -> (file, slide, text) of .pptx files."""
    return slide_texts(deck_rows(files))
