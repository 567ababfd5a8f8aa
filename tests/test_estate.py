"""The example estate, question by question."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quernstone.functions import cobol, jcl, layout, screens
from quernstone.plans import estate as plans
from quernstone.sources import members
from quernstone.sources.example import MEMBERS


def write(folder: Path, changes=None):
    for path, text in (MEMBERS | (changes or {})).items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)


@pytest.fixture(scope="module")
def estate(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("src"), tmp_path_factory.mktemp("out")
    write(root)
    return plans.build(spark, str(root), str(out))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("pic, usage, separate, size", [
    ("X(10)", "DISPLAY", False, 10), ("S9(7)V99", "COMP-3", False, 5), ("9(4)", "COMP", False, 2), ("S9(9)", "COMP", False, 4), ("9(10)", "COMP-5", False, 8), ("S9(3)", "DISPLAY", False, 3),
    ("S9(3)", "DISPLAY", True, 4), ("N(4)", "NATIONAL", False, 8), ("ZZ9.99CR", "DISPLAY", False, 8), (None, "COMP-1", False, 4), (None, "COMP-2", False, 8), ("9(3)PP", "DISPLAY", False, 3),
])
def test_storage(pic, usage, separate, size):
    assert layout.storage_bytes(pic, usage, separate) == size


def test_kinds(estate):
    got = dict(rows(estate.members, "path", "kind"))
    want = {"cbl": "program", "cpy": "copybook", "jcl": "jcl", "prc": "proc", "dbd": "dbd", "psb": "psb", "csd": "csd", "bms": "bms", "txt": "document"}
    assert {p.rsplit("/", 1)[-1]: k for p, k in got.items()} == {p.rsplit("/", 1)[-1]: want[p.rsplit(".", 1)[-1]] for p in MEMBERS}


def test_layout_through_nested_and_replaced_copies(estate):
    assert rows(estate.layout("ORDLOAD").filter("root = 'OUT-REC'"), "name", "offset", "length") == [("ORD-ALT", 10, 5), ("ORD-AMT", 10, 5), ("ORD-FLAG", 21, 1), ("ORD-ID", 0, 10), ("ORD-QTY", 15, 2), ("OUT-REC", 0, 22)]
    assert {r.name for r in estate.layout("ORDREAD").collect()} >= {"INP-ID", "INP-AMT"}


def test_copy_chosen_from_own_system(estate):
    assert rows(estate.layout("ORDLOAD").filter("name = 'ORD-ID'"), "length") == [(10,)]
    assert rows(estate.ambiguous()["copies"], "name", "copies", "contents") == [("ORDREC", 2, 2)]


def test_calls(estate):
    assert rows(estate.calls().filter("callee is not null"), "caller", "callee", "kind") == [("CUSTUPD", "CBLTDLI", "static"), ("ORDLOAD", "GONE", "static"), ("ORDLOAD", "PRICER", "dynamic")]
    assert rows(estate.callers("PRICER"), "node", "depth") == [("ORDLOAD", 1), ("PRICER", 0)]
    assert rows(estate.callees("ORDLOAD"), "node", "held") == [("GONE", False), ("ORDLOAD", True), ("PRICER", True)]


def test_dataset_flow(estate):
    got = rows(estate.dataset_flow(), "program_id", "dd", "dsn", "mode", "mode_source")
    assert ("ORDLOAD", "ORDOUT", "PROD.ORDERS", "output", "open_verb") in got
    assert ("ORDREAD", "ORDIN", "PROD.ORDERS", "input", "open_verb") in got
    assert ("SORT", "SORTIN", "PROD.ORDERS", "output", "gdg") in got and ("SORT", "SORTOUT", "PROD.ORDERS.SORTED", "output", "dd_name") in got


def test_dossier(estate):
    d = estate.program("ordload")
    assert rows(d["runs_in"], "job", "step", "from_proc") == [("NIGHT", "LOAD.RUN", "ORDPROC")]
    assert rows(d["copybooks"], "copybook", "resolved") == [("ORDREC", True)]
    assert rows(d["tables"], "tbl", "verbs") == [("APP.CUSTOMER", "SELECT")]
    assert {r.name: r.depth for r in d["paragraphs"].collect()} == {"MAIN-PARA": 0, "FILL-PARA": 1, "FILL-EXIT": 1, "LOST-PARA": 2}


def test_paragraph(estate):
    p = estate.paragraph("ORDLOAD", "FILL-PARA")
    assert rows(p["reached_by"], "from_para", "kind") == [("MAIN-PARA", "perform")]
    assert p["data_flow"].count() == 3 and p["sql_stmt"].count() == 1


def test_values_and_literals(estate):
    got = {r.value: (r.status, r.conditions) for r in estate.values("WS-STATE").collect()}
    assert got == {"OP": ("documented", "STATE-OPEN"), "SH": ("unused", "STATE-SHUT"), "CL": ("unused", "STATE-SHUT"), "ZZ": ("undocumented", None)}
    assert rows(estate.literal("OP"), "context", "field") == [("move_to", "WS-STATE")]
    assert rows(estate.messages("%IS WRONG%"), "literal") == [("STATE <WS-STATE> IS WRONG",)]
    assert rows(estate.pair("WS-KEY", "ORD-ID", 5), "member", "line", "r_line") == [("ORDLOAD", 29, 29)]


def test_columns_and_crud(estate):
    assert rows(estate.column("CITY"), "tbl", "host_var", "mode") == [("APP.CUSTOMER", "WS-STATE", "read")]
    assert rows(estate.table("price"), "member", "verbs") == [("CUSTUPD", "SELECT"), ("PRICER", "UPDATE")]
    assert rows(estate.crud(), "member", "resource", "letters") == [("CUSTUPD", "APP.PRICE", "R"), ("ORDLOAD", "APP.CUSTOMER", "R"), ("ORDLOAD", "DD ORDOUT", "C"), ("ORDREAD", "DD ORDIN", "R"), ("PRICER", "APP.PRICE", "U")]


def test_conditions(estate):
    assert rows(estate.conditions("ORDLOAD"), "para", "field", "literals") == [("MAIN-PARA", "WS-STATE", "ZZ")]


def test_database_screen_transaction(estate):
    assert rows(estate.database("CUSTDB")["segments"], "segment", "bytes") == [("CUST", 16)]
    assert rows(estate.database("CUSTDB")["pcbs"], "psb", "position") == [("CUSTPSB", 2)]
    assert rows(estate.segment_offsets("CUST", "ORDLOAD", "OUT-REC"), "seg_field", "item", "fit") == [("CUSTAMT", "ORD-AMT", "exact"), ("CUSTKEY", "ORD-ID", "exact")]
    assert rows(estate.transaction("ORDT"), "program") == [("PRICER",)]
    assert rows(estate.fact("screen_symbol"), "symbol") == [("CUSTNOA",), ("CUSTNOF",), ("CUSTNOI",), ("CUSTNOL",), ("CUSTNOO",)]


def test_dead_and_coverage(estate):
    dead = estate.dead()
    assert dead["programs"].count() == 0 and rows(dead["written_never_read"], "dsn") == [("PROD.ORDERS.SORTED",)]
    open_ = {(r.what, r.key): r.n for r in estate.coverage().collect()}
    assert open_["unresolved", "missing_copybook"] == 1 and open_["unresolved", "missing_proc"] == 1 and open_["members", "program"] == 4


def test_search_and_cite(estate):
    assert rows(estate.search("order file", "document"), "member", "line_no") == [("GUIDE", 1), ("GUIDE", 3)]
    assert rows(estate.cite("GUIDE", 1, 1), "txt") == [("The load job writes the order file.",)]


def test_diff(estate):
    ids = {r.library: r.member_id for r in estate.members.filter("name = 'ORDREC'").collect()}
    got = rows(estate.diff(ids["TEST/copy"], ids["SALES/copy"]).filter("level = 5"), "name", "change")
    assert got == [("ORD-ALT", "added"), ("ORD-AMT", "added"), ("ORD-ID", "changed"), ("ORD-QTY", "added")]


def test_flow(estate):
    got = {(r.hop, r.program_id, r.root, r.lo, r.hi, r.how) for r in estate.flow("WS-KEY", "ORDLOAD", 3).collect()}
    assert (1, "ORDLOAD", "OUT-REC", 0, 10, "MOVE") in got
    assert (1, "PRICER", "LK-KEY", 0, 10, "CALL") in got
    assert (2, "PRICER", "WS-SAVE", 0, 6, "MOVE") in got  # cut at the target's six bytes
    assert (2, "ORDREAD", "IN-REC", 0, 10, "file PROD.ORDERS") in got
    assert (3, "ORDREAD", "WS-COPY", 0, 10, "MOVE") in got


def test_refresh(spark, estate, tmp_path):
    root = Path(estate.members.filter("name = 'GUIDE'").first().path.removeprefix("file:")).parents[2]
    before = (root / "SALES/copy/ORDTAIL.cpy").read_text()
    write(root, {"SALES/copy/ORDTAIL.cpy": "           05 ORD-FLAG      PIC X(3).\n", "SALES/copy/NOTHERE.cpy": "           DISPLAY 'HELLO'.\n"})
    new = plans.refresh(spark, str(root), estate.path, str(tmp_path))
    assert rows(new.layout("ORDLOAD").filter("name = 'ORD-FLAG'"), "length") == [(3,)]
    assert {(r.kind, r.detail) for r in new.fact("unresolved").collect()} == {("missing_proc", "NOPROC")}
    assert rows(new.fact("ims_segment"), "segment") == [("CUST",)]
    (root / "SALES/copy/ORDTAIL.cpy").write_text(before)
    (root / "SALES/copy/NOTHERE.cpy").unlink()


def test_encodings():
    assert members.decode("é".encode("latin-1") * 3)[1] == "latin-1"
    text, encoding = members.decode(("//JOB1     JOB CLASS=A".ljust(80) + "// EXEC PGM=X".ljust(80) + " " * 80).encode("cp037"))
    assert encoding == "cp037" and text.splitlines()[0].startswith("//JOB1")


def test_recursion_and_slow_inputs_end():
    facts = cobol.parse_program("       PROGRAM-ID. X.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       COPY A.\n", {"A": "       COPY B.\n", "B": "       COPY A.\n"})
    assert ("recursive_copy", "A") in {(u["kind"], u["detail"]) for u in facts["unresolved"]}
    cobol.parse_program("       PROCEDURE DIVISION.\n" + "           MOVE 'A TO B\n" * 8000)
    cobol.parse_program("       PROCEDURE DIVISION.\n" + "           EXEC SQL SELECT 1\n" * 8000)
    jcl.parse_jcl("//J JOB\n//S EXEC PGM=SORT\n//SYSIN DD *\n" + "\n" * 40_000)
    assert screens.macros(" " * 80 + "\n") == []


def test_symbols_and_operands():
    assert jcl.substitute("&A..B&C", {"A": "X"}) == "X.B&C"
    assert jcl.split_operands("A=(1,2),B='x,y',C") == ["A=(1,2)", "B='x,y'", "C"]
    assert jcl.strip_generation("A.B(+1)") == ("A.B", "+1") and jcl.strip_generation("A.G0001V00") == ("A", "G0001V00")


def test_gate(spark):
    from quernstone.operators import gate

    answers = spark.createDataFrame([(1, 'See [[M1 1-2 "hello world"]] and [[M1 9-9 "hello"]], [[ZZ 1-1 "x"]], [[M1 1-1 "nothing here"]] and [[M1 1-1 "hell"]].')], "answer_id long, answer string")
    lines = spark.createDataFrame([("M1", 1, "say hello"), ("M1", 2, "hello world")], "ref string, line_no long, txt string")
    sizes = lines.groupBy("ref").agg(F.count("*").alias("n_lines"))
    got = {(r.n, r.verdict, r.reason) for r in gate.verdicts(gate.extract(answers), lines, sizes).collect()}
    assert got == {(1, "PASS", ""), (2, "FAIL", "range invalid"), (3, "FAIL", "unknown member"), (4, "FAIL", "token absent"), (5, "WARN", "weak token")}


def test_interfaces_releases_documents_pack(estate):
    assert ("online_file", "CUSTF", "PROD.CUST") in rows(estate.interfaces(), "kind", "who", "what")
    got = {(r.name, r.kind): r.change for r in estate.releases("TEST", "SALES").collect()}
    assert got["ORDREC", "copybook"] == "changed" and got["ORDTAIL", "copybook"] == "added"
    assert rows(estate.documents("each night"), "member", "part") == [("GUIDE", 1)]
    packed = estate.pack("ORDLOAD", 120).collect()
    assert packed and sum(len(r.txt) + 1 for r in packed) <= 120 and packed[0].priority == 0


def test_flow_upwards_and_through_columns(estate):
    up = {(r.program_id, r.root, r.lo, r.hi, r.how) for r in estate.flow("WS-COPY", "ORDREAD", 3, up=True).collect()}
    assert {("ORDREAD", "IN-REC", 0, 10, "MOVE"), ("ORDLOAD", "OUT-REC", 0, 10, "file PROD.ORDERS"), ("ORDLOAD", "WS-KEY", 0, 10, "MOVE")} <= up
    down = {(r.program_id, r.root, r.how) for r in estate.flow("LK-AMT", "PRICER", 2).collect()}
    assert ("CUSTUPD", "WS-PRICE", "column PRICE.AMT") in down
    assert rows(estate.origins("WS-STATE", "ORDLOAD", 1), "dst", "literal") == [("WS-STATE", "OP")]


def test_database_calls(estate):
    assert rows(estate.database_calls(), "program_id", "func", "position", "psb", "dbd", "procopt") == [("CUSTUPD", "GU", 2, "CUSTPSB", "CUSTDB", "A")]
    assert rows(estate.segment("cust"), "program_id", "functions") == [("CUSTUPD", "GU")]


def test_listing_blocks_and_their_age():
    from quernstone.operators import recovery

    source = ["       IDENTIFICATION DIVISION.", "       DATA DIVISION.", "       01 A.", "       COPY ONE.", "       01 B."]
    copied = ["          05 X PIC X(3).", "          05 Y PIC 9."]
    rows = [f"  00000{n}  {' ':<6}{r}" for n, r in enumerate(source[:4], 1)] + [f"  00000{n}C {' ':<6}{r}" for n, r in enumerate(copied, 5)] + [f"  000007  {' ':<6}{source[4]}"]
    listing = "PP 5655-EC6 IBM Enterprise COBOL for z/OS\n  LineID  PL SL ----+-*A-1-B--+----2\n" + "\n".join(rows) + "\n ONE      SYSLIB   PROD.COPYLIB        2020-01-01\nDATA DIVISION MAP\n  000009C                 01 ZZ.\n"
    assert recovery.listed_blocks(listing) == [("ONE", "\n".join(copied), True)]
    assert recovery.copy_sources(listing) == [("ONE", "SYSLIB", "PROD.COPYLIB")]
    assert recovery.listing_is_current(listing, "\n".join(source)) == (True, 100)
    current, match = recovery.listing_is_current(listing, "\n".join([*source, "       01 C."]))
    assert current is False and 50 < match < 100
    assert recovery.listing_is_current(listing, None) == (None, None)
    assert recovery.recovered_blocks("\n".join(source), listing) == [("ONE", "\n".join(copied), True, "listing")]


def test_overrides_includes_and_guards():
    text = """\
//J        JOB
//         SET WHAT=ONE
//         INCLUDE MEMBER=&WHAT
//         IF (A.RC = 0) THEN
//B        EXEC P,COND=(4,LT)
//IN1      DD DSN=NEW.FIRST
//S2.OUT   DD DSN=NEW.OUT,DISP=MOD
//         DD DSN=MORE
//         ELSE
//C        EXEC PGM=X
//         ENDIF
//D        EXEC PGM=Y
//         INCLUDE MEMBER=GONE
"""
    proc = "//P PROC\n//S1 EXEC PGM=A\n//IN1 DD DSN=OLD.A,DISP=SHR\n//    DD DSN=OLD.B,DISP=SHR\n//S2 EXEC PGM=B\n//IN1 DD DSN=KEEP\n//OUT DD DSN=OLD.OUT,UNIT=X\n"
    facts = jcl.parse_jcl(text, {"P": proc, "ONE": "//A EXEC PGM=FIRST\n"})
    assert [(s["step"], s["effective"], s["guard"]) for s in facts["step"]] == [("A", "FIRST", ""), ("B.S1", "A", "(A.RC = 0) AND COND=(4,LT)"), ("B.S2", "B", "(A.RC = 0) AND COND=(4,LT)"), ("C", "X", "NOT ((A.RC = 0))"), ("D", "Y", "")]
    assert [(d["step"], d["dd"], d["concat"], d["dsn"], d["disp"]) for d in facts["dd"]] == [("B.S1", "IN1", 0, "NEW.FIRST", "SHR"), ("B.S1", "IN1", 1, "OLD.B", "SHR"), ("B.S2", "IN1", 0, "KEEP", ""), ("B.S2", "OUT", 0, "NEW.OUT", "MOD"), ("B.S2", "OUT", 1, "MORE", "")]
    assert [(u["kind"], u["detail"]) for u in facts["unresolved"]] == [("missing_include", "GONE")]


def test_credentials_and_variables():
    text = "//J JOB ,USER=ME,PASSWORD=SECRET\n//S EXEC PGM=FTP\n//INPUT DD *\nhost.example.org\nme secret\nGET A\nUSER you\n//T EXEC PGM=X\n//SYSIN DD *\nUSER TABLE\n"
    out = jcl.redact_credentials(text)
    assert "SECRET" not in out and "secret" not in out and "host.example.org" in out and "GET A" in out and "USER TABLE" in out and "you" not in out
    assert jcl.variables("A.D%%ODATE..&LYYMMDD..X") == "A.D<VAR>.<VAR>.X" and jcl.variables("&&TEMP") == "&&TEMP"


def test_margin_qualifiers_and_statements():
    wide = [f"      {'MOVE A TO B.':<66}{'ABCD'}{n:04}" for n in range(30)]
    wide = [r[:72] + "  " + r[72:] for r in wide]
    assert cobol.code_end(wide) == 72 and cobol.code_end(["x" * 60] * 5) == 72
    tagged = [f"{'       MOVE A TO B.':<66}TAGX{n:04}" for n in range(10)]
    assert cobol.code_end(tagged) == 66
    body = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. X.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 A.
          05 K PIC X(3) SYNC.
       01 Q PIC X(8) VALUE 'QUE1'.
       66 R RENAMES A.
       PROCEDURE DIVISION.
       P1.
           UNSTRING K OF A DELIMITED BY ',' INTO Q K IN B.
           SET P TO ADDRESS OF A.
           SET ADDRESS OF B TO P.
           EXEC SQL DECLARE C1 CURSOR FOR SELECT C.ID, NAME
             FROM APP.CUST C END-EXEC.
           EXEC SQL FETCH C1 INTO :K, :Q END-EXEC.
           EXEC CICS WRITEQ TS QUEUE(Q) FROM(A) END-EXEC.
           EXEC CICS START TRANSID('T001') FROM(B) END-EXEC.
           EXEC DLI GU USING PCB(1) SEGMENT(CUST) INTO(A) END-EXEC.
"""
    f = cobol.parse_program(body)
    assert {(r["verb"], r["src"], r["src_of"], r["dst"], r["dst_of"]) for r in f["data_flow"]} == {("UNSTRING", "K", "A", "Q", ""), ("UNSTRING", "K", "A", "K", "B"), ("ADDRESS OF", "A", "", "P", ""), ("ADDRESS TO", "P", "", "B", "")}
    assert [(r["tbl"], r["col"], r["host_var"]) for r in f["sql_col_ref"]] == [("APP.CUST", "ID", "K"), ("APP.CUST", "NAME", "Q")]
    assert [(r["kind"], r["resource"], r["area"]) for r in f["cics_op"]] == [("ts_queue", "QUE1", "A"), ("transaction", "T001", "B")]
    assert [(r["func"], r["area"], r["ssas"]) for r in f["dli_call"]] == [("GU", "A", ["CUST"])]
    assert len([u for u in f["unresolved"] if u["kind"] == "layout"]) == 2


def test_formats_and_report_cards():
    mfs = "MYMSG    MSG   TYPE=INPUT\n         DO    2\n         MFLD  KEY,LTH=4\n         ENDDO\nMYFMT    FMT\nKEY      DFLD  POS=(3,10),LTH=4\n"
    f = screens.parse_mfs(mfs)
    assert [(x["map"], x["name"], x["col"], x["length"]) for x in f["screen_field"]] == [("MYMSG", "KEY", 0, 4), ("MYMSG", "KEY#2", 4, 4), ("MYFMT", "KEY", 10, 4)]
    assert jcl.db2_utility("SELECT A FROM APP.T1 WHERE X IN (SELECT Y FROM APP.T2); DELETE FROM APP.T3", True) == [("DELETE", "APP.T3", ""), ("SELECT", "APP.T1", ""), ("SELECT", "APP.T2", "")]
    assert jcl.sort_roles("  OUTFIL FNAMES=(A,B)\n  JOINKEYS FILE=F1,FIELDS=(1,2,A)") == {"A": "output", "B": "output", "F1": "input"}


def test_manifest_markers_and_scheduler(spark, tmp_path):
    root = tmp_path / "src"
    write(root)
    (root / "OUT").mkdir()
    (root / "OUT" / members.OUTPUT_MARKER).write_text("x")
    (root / "OUT" / "COPY.cbl").write_text("       IDENTIFICATION DIVISION.\n")
    (root / "SALES" / members.LIBRARY_MARKER).write_text('{"dataset": "PROD.SALES", "expected": 5, "present": 4, "complete": false, "missing": ["X"]}')
    found = members.scan(spark, str(root))
    assert found.filter("path like '%OUT/COPY%'").count() == 0 and found.count() == len(MEMBERS)
    assert rows(members.libraries(spark, str(root)), "dataset", "expected", "present", "complete") == [("PROD.SALES", 5, 4, False)]
    told = members.apply_manifest(found, {"systems": {"NEW": ["SALES/copy"]}, "system_of": {"JCL": "JOBS"}, "authoritative": ["copy"], "kinds": {"docs": "sql"}})
    got = {(r.name, r.kind): (r.system, r.authoritative) for r in told.filter("system <> 'TEST'").collect()}
    assert got["ORDREC", "copybook"] == ("NEW", True) and got["NIGHT", "jcl"] == ("JOBS", False) and ("GUIDE", "sql") in got
    (tmp_path / "s.csv").write_text("kind,depends_on,Job_Name\ntrigger,a,b\n,,c\n")
    s = members.scheduler(spark, str(tmp_path / "s.csv"))
    assert rows(s["dependencies"], "job_name", "depends_on", "kind") == [("B", "A", "trigger")] and rows(s["jobs"], "job_name") == [("C",)]
    (tmp_path / "t.csv").write_text("x,y\n1,2\n")
    assert members.scheduler(spark, str(tmp_path / "t.csv"))["unresolved"].count() == 1
    e = members.external_interfaces(spark, {"external_interfaces": [{"kind": "ndm", "peer": "P", "direction": "out", "dataset": "a.b"}, {"kind": "x"}]})
    assert rows(e, "kind", "target_kind", "target") == [("ndm", "dataset", "A.B")]


def test_snap_of_folded_names(spark):
    from quernstone.operators import text

    pieces = spark.createDataFrame([("0RD-KEY",), ("ORD-KFY",), ("ZZZZ",), ("ABC1",)], "piece string")
    words = spark.createDataFrame([("ORD-KEY",), ("ABCD",), ("ABCE",)], "word string")
    assert rows(text.snap_folded(pieces, words), "piece", "word") == [("0RD-KEY", "ORD-KEY"), ("ORD-KFY", "ORD-KEY")]
