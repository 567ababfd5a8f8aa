"""Document readers on files made here, captions, and recovery operators."""

import io
import zipfile
import zlib

from quernstone.operators import recovery
from quernstone.sources import documents as d


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = zipped(word__document_dot_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Intro</w:t></w:r></w:p><w:p><w:r><w:t>Hello </w:t><w:t>there</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
XLSX = zipped(
    xl__workbook_dot_xml='<workbook><sheets><sheet name="Jobs" sheetId="1"/></sheets></workbook>',
    xl__sharedStrings_dot_xml="<sst><si><t>NIGHT</t></si></sst>",
    xl__worksheets__sheet1_dot_xml='<worksheet><sheetData><row r="4"><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>',
)
PPTX = zipped(ppt__slides__slide2_dot_xml='<s xmlns:a="a"><a:p><a:t>Two</a:t></a:p></s>', ppt__slides__slide1_dot_xml='<s xmlns:a="a"><a:p><a:t>One</a:t></a:p></s>', ppt__notesSlides__notesSlide1_dot_xml='<s xmlns:a="a"><a:p><a:t>say it</a:t></a:p></s>')
PDF = b"%PDF\n1 0 obj\nstream\n" + zlib.compress(b"BT (Hel\\154o) Tj T* [(wor) -20 (ld) -400 (x)] TJ ET") + b"\nendstream\n"


def test_readers():
    assert d.docx(DOCX) == [("Intro", "Hello there\n1 | a | b")]
    assert d.xlsx(XLSX) == [("Jobs", "4 | NIGHT | 7")]
    assert d.pptx(PPTX) == [("Slide 1", "One\nNotes: say it"), ("Slide 2", "Two")]
    assert d.pdf(PDF) == [("Stream 1", "Hello\nworld x")]
    assert d.plain(b"# A\ntext\n## B\nmore\n") == [("A", "text"), ("B", "more")]
    assert d.extract("x.docx", b"no zip") == [("", "(not readable: BadZipFile)")]


def test_sections(spark):
    rows = [("a.docx", bytearray(DOCX)), ("b.html", bytearray(b"<p>x<script>no</script> y &amp; z</p>")), ("c.txt", bytearray(b"plain"))]
    got = {(r.path, r.heading, r.text) for r in d.sections(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {("a.docx", "Intro", "Hello there\n1 | a | b"), ("b.html", "", "x y & z"), ("c.txt", "", "plain")}


def test_captions(spark):
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\n<v Ann>Good <b>day</b>\n\n00:03.000 --> 00:04.000\nGood\nday\n\n1:02:03,500 --> 1:02:04,000\nlate\n"
    cues = d.captions(spark.createDataFrame([("m", vtt)], "path string, text string"))
    assert sorted((r.start_s, r.text) for r in cues.collect()) == [(1, "Ann: Good day"), (3, "Good day"), (3723, "late")]
    assert sorted((r.window_s, r.text) for r in d.caption_sections(cues).collect()) == [(0, "Ann: Good day Good day"), (3720, "late")]


ORIGINAL = "       01 A.\n       COPY CUST.\n       01 B PIC X.\n"
EXPANDED = "       01 A.\n       COPY CUST.\n          05 KEY PIC X(4).\n          05 AMT PIC 9.\n       01 B PIC X.\n"


def test_recover_and_choose(spark):
    other = EXPANDED.replace("PIC 9", "PIC 99")
    rows = [("p1", ORIGINAL, EXPANDED), ("p2", ORIGINAL, EXPANDED), ("p3", ORIGINAL, other), ("p4", ORIGINAL, EXPANDED.replace("B PIC X", "B PIC Z"))]
    blocks = recovery.recover(spark.createDataFrame(rows, "source string, original string, expanded string"))
    best = recovery.choose(blocks).collect()
    assert len(best) == 1 and best[0].copybook == "CUST" and "PIC 9." in best[0].text and best[0].n >= 2
    assert recovery.marked_blocks("x".ljust(72) + "CUSTREC \n" + "y".ljust(72) + "CUSTREC ") == [("CUSTREC", "x\ny", True)]


def test_verdicts(spark):
    picked = spark.createDataFrame([("P", c, "L1", "s") for c in ("A", "B", "C", "D", "E")], "program string, copybook string, dataset string, sha string")
    listed = spark.createDataFrame([("P", "A", "L1", "s"), ("P", "B", "L1", "t"), ("P", "C", "L2", "s"), ("P", "D", "L9", "s")], "program string, copybook string, dataset string, sha string")
    held = spark.createDataFrame([("A", "L1", "s"), ("B", "L1", "s"), ("C", "L2", "s")], "copybook string, dataset string, sha string")
    got = {r.copybook: r.verdict for r in recovery.check_choices(picked, listed, held).collect()}
    assert got == {"A": "CONFIRMED", "B": "OLDER", "C": "CONTRADICTED", "D": "NOT HELD", "E": "UNKNOWN"}


def test_names_on_disk(spark):
    files = spark.createDataFrame([("/x/CUSTREC.cpy",), ("/x/ORDTAIL2.cpy",), ("/x/PRICEX.txt",)], "file string")
    missing = spark.createDataFrame([("CUSTREC",), ("ORDTAIL",), ("PRICES",), ("NOWHERE",)], "name string")
    got = {(r.name, r.file.split("/")[-1], r.how) for r in recovery.match_names(missing, files).collect()}
    assert got == {("CUSTREC", "CUSTREC.cpy", "exact"), ("ORDTAIL", "ORDTAIL2.cpy", "prefix"), ("PRICES", "PRICEX.txt", "close")}


def test_screen_text(spark):
    lines = spark.createDataFrame([(1, "CUSTREC balance q9# 100"), (2, "~~ q# $$"), (3, "A . B . C")], "line_id long, text string")
    words = spark.createDataFrame([("CUSTREC",)], "word string")
    assert [(r.line_id, r.text) for r in recovery.clean_lines(lines, words).collect()] == [(1, "CUSTREC balance ? 100")]
    assert lines.filter("line_id = 3").select(recovery.tidy("text")).first()[0] == "A.B.C"
