"""Office files, PDF, HTML and captions -> sections of text (S10-S16), with nothing but the standard library.

``sections(files)`` reads (path, content) rows on the executors; a file that cannot be read gives one section that says so.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.text import html_text

Section = tuple[str, str]  # heading, text


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(node: ET.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _name(k) == name), "")


def _texts(node: ET.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _name(x.tag) == tag)


def docx(data: bytes) -> list[Section]:
    """Headings open sections; a table gives one line per row, cells separated by a bar."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
    out: list[list] = [["", []]]
    for block in next(x for x in body.iter() if _name(x.tag) == "body"):
        if _name(block.tag) == "p":
            style = next((_attr(x, "val") for x in block.iter() if _name(x.tag) == "pStyle"), "")
            text = _texts(block)
            if style.lower().startswith(("heading", "title")) and text.strip():
                out.append([text.strip(), []])
            elif text.strip():
                out[-1][1].append(text)
        elif _name(block.tag) == "tbl":
            for n, row in enumerate((x for x in block.iter() if _name(x.tag) == "tr"), 1):
                cells = [_texts(c).strip() for c in row if _name(c.tag) == "tc"]
                out[-1][1].append(f"{n} | " + " | ".join(cells))
    return [(h, "\n".join(t)) for h, t in out if h or t]


def xlsx(data: bytes) -> list[Section]:
    """Each sheet is a section; a row keeps the sheet's own number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_texts(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        book = ET.fromstring(z.read("xl/workbook.xml"))
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {_attr(r, "Id"): _attr(r, "Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for n, sheet in enumerate((x for x in book.iter() if _name(x.tag) == "sheet"), 1):
            part = targets.get(_attr(sheet, "id"), f"worksheets/sheet{n}.xml").lstrip("/")
            part = part if part.startswith("xl/") else f"xl/{part}"
            lines = []
            for row in (x for x in ET.fromstring(z.read(part)).iter() if _name(x.tag) == "row") if part in names else ():
                cells = []
                for c in row:
                    letters = re.match(r"[A-Z]+", _attr(c, "r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    cells += [""] * (min(at, 16_384) - len(cells))  # cells that are empty are not written
                    value = next((x.text or "" for x in c if _name(x.tag) == "v"), "")
                    cells.append(shared[int(value)] if _attr(c, "t") == "s" and value else _texts(c) if _attr(c, "t") == "inlineStr" else value)
                if any(cells):
                    lines.append(f"{_attr(row, 'r') or len(lines) + 1} | " + " | ".join(cells))
            out.append((_attr(sheet, "name"), "\n".join(lines)))
        return out


def pptx(data: bytes) -> list[Section]:
    """Slides in order, each with its notes; pages of a drawing likewise."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        def numbered(pattern: str) -> dict[int, str]:
            found = {int(m[1]): n for n in z.namelist() if (m := re.fullmatch(pattern, n))}
            return dict(sorted(found.items()))

        slides, notes, pages = numbered(r"ppt/slides/slide(\d+)\.xml"), numbered(r"ppt/notesSlides/notesSlide(\d+)\.xml"), numbered(r"visio/pages/page(\d+)\.xml")
        out = []
        for n, part in slides.items():
            root = ET.fromstring(z.read(part))
            lines = [t for p in root.iter() if _name(p.tag) == "p" and (t := _texts(p).strip())]
            if n in notes:
                lines += ["Notes: " + t for p in ET.fromstring(z.read(notes[n])).iter() if _name(p.tag) == "p" and (t := _texts(p).strip())]
            out.append((f"Slide {n}", "\n".join(lines)))
        for n, part in pages.items():
            out.append((f"Page {n}", "\n".join("".join(x.itertext()).strip() for x in ET.fromstring(z.read(part)).iter() if _name(x.tag) == "Text")))
        return out


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "", "f": ""}


def _pdf_string(raw: bytes) -> str:
    text = raw.decode("latin-1")
    return re.sub(r"\\([0-7]{1,3}|.)", lambda m: chr(int(m[1], 8)) if m[1][0] in "01234567" else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def pdf(data: bytes) -> list[Section]:
    """Best effort: strings shown in each content stream; fonts with two-byte codes are only told."""
    out = []
    at = 0
    while (start := data.find(b"stream", at)) >= 0:
        begin = start + 6
        begin += 2 if data[begin : begin + 2] == b"\r\n" else 1
        end = data.find(b"endstream", begin)
        if end < 0:
            break
        at, body = end + 9, data[begin:end]
        try:
            body = zlib.decompressobj().decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body:
            continue
        lines, line = [], []
        for m in re.finditer(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\[\]()]|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|(T\*|Td|TD|ET)", body, re.S):
            if m[3]:
                if line:
                    lines.append("".join(line))
                line = []
            elif m[1] is not None:
                line.append(_pdf_string(m[1]))
            else:
                line += [_pdf_string(x[1]) if x[1] is not None else " " for x in re.finditer(rb"\(((?:[^()\\]|\\.)*)\)|-\d{3,}", m[2], re.S)]
        if lines:
            out.append((f"Stream {len(out) + 1}", "\n".join(lines)))
    if b"/Identity-H" in data and not out:
        out.append(("", "(text in fonts with two-byte codes is not read)"))
    return out


def plain(data: bytes) -> list[Section]:
    """Markdown headings open sections."""
    from quernstone.sources.members import decode

    out: list[list] = [["", []]]
    for r in decode(data)[0].splitlines():
        if m := re.match(r"#{1,6}\s+(.*)", r):
            out.append([m[1].strip(), []])
        else:
            out[-1][1].append(r)
    return [(h, "\n".join(t).strip("\n")) for h, t in out if h or any(x.strip() for x in t)]


READERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "vsdx": pptx, "pdf": pdf, "txt": plain, "md": plain}


def extract(path: str, data: bytes) -> list[Section]:
    """Sections of a file by its suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        return READERS.get(suffix, plain)(data)
    except Exception as error:  # a damaged file must not end the scan
        return [("", f"(not readable: {type(error).__name__})")]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, n, h, t) for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, (h, t) in enumerate(extract(p, d), 1)]
        yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], ["path", "ordinal", "heading", "text"])


def sections(files: DataFrame) -> DataFrame:
    """(path, ordinal, heading, text) of (path, content) rows; HTML stays in the JVM."""
    is_html = F.lower("path").rlike(r"\.html?$")
    pages = files.filter(is_html).select("path", F.lit(1).alias("ordinal"), F.lit("").alias("heading"), html_text(F.col("content").cast("string")).alias("text"))
    return files.filter(~is_html).select("path", "content").mapInArrow(_run, "path string, ordinal int, heading string, text string").unionByName(pages)


def captions(files: DataFrame) -> DataFrame:
    """(path, start_s, text) of WebVTT or SRT text rows (path, text), with DataFrame functions only.

    A cue is a block of lines after its times; a speaker's tag becomes ``Name: ``, other tags go.
    """
    blocks = files.select("path", F.explode(F.split(F.regexp_replace("text", "\r", ""), "\n[ \t]*\n")).alias("block"))
    times = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,]\d{3}\s*-->"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract("block", times, k), F.lit("")).cast("int"), F.lit(0))
    body = F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)", 1), r"<v(?:\.[^ >]*)? ([^>]*)>", "$1: ")
    cues = blocks.filter(F.col("block").rlike(times)).select("path", (part(1) * 3600 + part(2) * 60 + part(3)).alias("start_s"), F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", ""), "\\s+", " ")).alias("text"))
    return cues.filter("text <> ''")


def caption_sections(cues: DataFrame, seconds: int = 120) -> DataFrame:
    """Captions joined per tumbling window, a text that repeats the one before left out."""
    before = F.lag("text").over(Window.partitionBy("path").orderBy("start_s", "text"))
    kept = cues.withColumn("_b", before).filter("_b is null or _b <> text")
    cell = (F.floor(F.col("start_s") / seconds) * seconds).alias("window_s")
    rows = kept.groupBy("path", cell).agg(F.sort_array(F.collect_list(F.struct("start_s", "text"))).alias("r"))
    return rows.select("path", "window_s", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"))
