"""Ceilings on inputs that once took quadratic time; seconds as published for a single worker."""

import time

import pytest

from quernstone.functions import cobol, jcl, screens
from quernstone.operators import text
from quernstone.sources import documents, members

HEAD = "       PROCEDURE DIVISION.\n       A.\n"
STEP = "//J JOB\n//S EXEC PGM=SORT\n//SYSIN DD *\n"
CASES = {
    "sentence of 20,000 lines": (4, lambda: cobol.sentences(cobol.logical_lines(HEAD + "           MOVE A TO B\n" * 20_000 + "           .\n"))),
    "open literal": (4, lambda: cobol.parse_program(HEAD + "           MOVE 'A TO B\n" * 8000)),
    "open block": (4, lambda: cobol.parse_program(HEAD + "           EXEC SQL SELECT 1\n" * 8000)),
    "moves and calls": (20, lambda: cobol.parse_program(HEAD + "           MOVE A TO B.\n" * 3000 + "           CALL 'X' USING A B.\n" * 1500)),
    "copies": (25, lambda: cobol.parse_program("       PROGRAM-ID. X.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n" + "       COPY C1.\n" * 400, {"C1": "       01 A PIC X.\n" * 50})),
    "blank cards": (8, lambda: jcl.parse_jcl(STEP + (" " * 72 + "\n") * 40_000)),
    "sort cards": (2, lambda: jcl.parse_jcl(STEP + "  OUTFIL FNAMES=A,INCLUDE=(1,2,CH,EQ,C'A')\n" * 6000)),
    "continuations": (3, lambda: jcl.parse_jcl("//J JOB\n//S EXEC PGM=X,\n" + "// A=B,\n" * 40_000 + "// C=D\n")),
    "referbacks": (4, lambda: jcl.parse_jcl("//J JOB\n//S EXEC PGM=X\n" + "".join(f"//D{i} DD DSN=A.B{i}\n" for i in range(3000)) + "//T EXEC PGM=Y\n" + "".join(f"//E{i} DD DSN=*.S.D{i}\n" for i in range(3000)))),
    "classifying blank cards": (0.5, lambda: members.classify("/x/y", (" " * 80 + "\n") * 101)),
    "define on a padded member": (2, lambda: jcl.parse_jcl("//J JOB\n//S EXEC PGM=IDCAMS\n//SYSIN DD *\n" + (" " * 72 + "\n") * 2000 + "  DEFINE CLUSTER (NAME(A.B))\n" + (" " * 72 + "\n") * 2000)),
    "report program of blank lines": (2, lambda: jcl.easytrieve("FILE A\n" + (" " * 72 + "\n") * 40_000)),
    "transfer job of blank lines": (3, lambda: jcl.parse_jcl(jcl.redact_credentials("//J JOB\n//S EXEC PGM=FTP\n//INPUT DD *\n" + (" " * 72 + "\n") * 20_000))),
    "utility cards": (2, lambda: jcl.db2_utility("LOAD DATA INDDN A\n" * 4000)),
    "map fields": (3, lambda: screens.parse_bms("M DFHMDI SIZE=(24,80)\n" + "".join(f"F{i} DFHMDF POS=(1,1),LENGTH=3\n" for i in range(8000)))),
    "one paragraph of 24 MB": (8, lambda: text.cut_section("row of a table\n" * 1_600_000)),
    "shown strings": (3, lambda: documents.pdf(b"stream\nBT " + b"[(a) -300 (b)] TJ " * 4000 + b"ET\nendstream")),
    "streams": (3, lambda: documents.pdf(b"stream\nBT (a) Tj ET\nendstream\n" * 2000)),
}


@pytest.mark.parametrize("name", CASES)
def test_ceiling(name):
    ceiling, run = CASES[name]
    began = time.time()
    run()
    assert time.time() - began < ceiling


def test_unclosed_blocks_of_a_page(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([("<style>a" * 16_000 + "<!-- x" * 16_000 + "</style> the end",), ("<p>short</p>",)], "html string")
    pages.select(text.html_text("html")).collect()  # compiled once
    began = time.time()
    got = pages.select(F.length(text.html_text("html")).alias("n")).collect()
    assert len(got) == 2 and time.time() - began < 2
