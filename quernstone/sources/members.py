"""A folder of source members -> a table of members (S1-S6): decoded, classified, fingerprinted by the executors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import ship

SKIPPED = r"/(\.[^/]+|__pycache__|node_modules)/"
#: A folder with a file of this name was written by this engine and is not scanned again; libraries tell what they hold in the other.
OUTPUT_MARKER, LIBRARY_MARKER = "QUERNSTONE-OUTPUT.marker", "QUERNSTONE-LIBRARY.json"
SCHEMA = "member_id bigint, path string, name string, kind string, reason string, system string, library string, authoritative boolean, sha256 string, norm_sha string, bytes bigint, lines int, encoding string, text string"


#: Bytes that tell of ASCII: printable ones but the blank of EBCDIC, tabs and line ends.
_ASCII = bytes(b for b in range(256) if 0x21 <= b < 0x7F and b != 0x40 or b in (9, 10, 13))


def sniff_encoding(data: bytes) -> str:
    """EBCDIC when blanks are 0x40 and little else is ASCII, else UTF-8, else latin-1 (S3)."""
    if data:
        blanks = data.count(0x40) / len(data)
        if blanks > 0.15 and (min(len(data), 8192) - len(data[:8192].translate(None, _ASCII))) / min(len(data), 8192) < 0.60:
            return "cp037"
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "latin-1"


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding); text without line ends is cut into 80-character records."""
    encoding = sniff_encoding(data)
    text = data.decode(encoding, "replace").replace("\x85", "\n").replace("\r\n", "\n")
    if "\n" not in text and len(text) > 160 and encoding == "cp037":
        text = "\n".join(text[i : i + 80] for i in range(0, len(text), 80))
    return text, encoding


_LABEL = r"(?m)^(?:[A-Z0-9@#$]{1,8})?[ \t]+"
#: The first that a text holds decides; statements of one language before words that occur in several.
_SIGNATURES = [
    ("jcl", r"(?m)^//\S+[ \t]+JOB\b"),
    ("proc", r"(?m)^//\S*[ \t]+PROC\b"),
    ("stage1", _LABEL + r"(?:APPLCTN|TRANSACT)[ \t]+(?:G?PSB|CODE)="),
    ("csd", r"(?im)^[ \t]*(?:(?:USER)?DEFINE|ALTER)[ \t]+(?:TRANSACTION|FILE|PROGRAM|MAPSET|TDQUEUE)[ \t]*\("),
    ("dbd", _LABEL + r"(?:DBD|SEGM)[ \t]+NAME="),
    ("psb", _LABEL + r"(?:PCB[ \t]+TYPE=|PSBGEN\b)"),
    ("bms", r"(?m)^\S*[ \t]+DFHM(?:SD|DI|DF)\b"),
    ("mfs", _LABEL + r"(?:MSG|FMT|DFLD|MFLD)[ \t\n]"),
    ("listing", r"(?im)^1?PP[ \t]+5655-|^[ \t]+LineID[ \t]+PL[ \t]+SL\b|\bMODULE MAP\b|\bIBM Enterprise COBOL for z/OS\b"),
    ("program", r"(?im)^.{0,11}\b(?:IDENTIFICATION|ID)[ \t]+DIVISION[ \t]*\.|\bPROGRAM-ID\b"),
    ("asm", _LABEL + r"(?:CSECT|DSECT|DFHEIENT)\b"),
    ("rexx", r"(?i)\A\s*/\*[ \t]*REXX"),
    ("html", r"(?i)<html\b"),
    ("sql", r"(?i)\bCREATE[ \t]+(?:TABLE|VIEW|INDEX|TABLESPACE|DATABASE)\b"),
    ("include", r"(?m)^//\S*[ \t]+(?:EXEC|DD|SET)\b"),
    ("copybook", r"(?im)^.{0,11}[ \t]*(?:0[1-9]|[1-4]\d|66|77|88)[ \t]+[A-Z0-9][A-Z0-9-]*\b.*(?:PIC|OCCURS|REDEFINES|COMP|VALUE|\.)|^.{0,11}[ \t]*(?:[1-9])[ \t]+[A-Z][A-Z0-9-]*[ \t]+PIC"),
]
_FOLDERS = [
    ("copybook", r"(?i)(?:COPY(?:LIB|BOOKS?)?S?|CPY|COPYBOOK)$"), ("proc", r"(?i)PROC(?:LIB|S)?$"), ("jcl", r"(?i)(?:JCL(?:LIB)?|JOBS?)$"), ("ctlcard", r"(?i)(?:CNTL(?:LIB)?|CARD(?:LIB|S)?|UTL)$"),
    ("dbd", r"(?i)DBD(?:LIB|SRC|SOURCE)?$"), ("psb", r"(?i)PSB(?:LIB|SRC|SOURCE)?$"), ("bms", r"(?i)(?:BMS(?:LIB|SRC|SOURCE)?|MAPS?)$"), ("mfs", r"(?i)(?:MFS(?:LIB|SRC|GEN)?|FMTLIB|MSGLIB)$"),
    ("program", r"(?i)(?:SRC|SOURCE|COBOL|PGM(?:LIB)?)$"), ("ctlcard", r"(?i)(?:CTL(?:CARDS?)?|PARM(?:LIB)?|SYSIN)$"), ("document", r"(?i)(?:DOCS?|DOCUMENT.*|SPECS?|DESIGN)$"),
]
_SUFFIXES = {
    "cbl": "program", "cob": "program", "cpy": "copybook", "inc": "copybook", "dcl": "copybook", "jcl": "jcl", "job": "jcl", "prc": "proc", "ctl": "ctlcard", "card": "ctlcard", "parm": "ctlcard", "dbd": "dbd", "psb": "psb",
    "bms": "bms", "mfs": "mfs", "csd": "csd", "sql": "sql", "ddl": "sql", "asm": "asm", "rexx": "rexx", "lst": "listing", "txt": "document", "md": "document", "html": "html", "htm": "html", "csv": "scheduler",
}
_DATA_SET = re.compile(r"[A-Z0-9$#@]{1,8}(?:\.[A-Z0-9$#@]{1,8})+$", re.I)


def how_classified(path: str, head: str) -> tuple[str, str]:
    """(kind, reason): by the first content signature, then the folder, then the suffix."""
    for kind, pattern in _SIGNATURES:
        if re.search(pattern, head[:8192]):
            return kind, "content"
    folder = path.rsplit("/", 2)[-2] if path.count("/") > 1 else ""
    for kind, pattern in _FOLDERS:
        if re.search(pattern, folder):
            return kind, f"folder {folder}"
    suffix = path.rsplit(".", 1)[-1].lower()
    kind = _SUFFIXES.get(suffix, "other")
    if kind == "document" and _DATA_SET.match(folder):  # a library's member of no known kind is no document
        return "other", f"unknown member of {folder}"
    return kind, f"suffix {suffix}" if kind != "other" else "nothing tells"


def classify(path: str, head: str) -> str:
    return how_classified(path, head)[0]


def norm_hash(kind: str, text: str) -> str:
    """Digest of the code alone: no comments, sequence numbers, case or trailing blanks."""
    if kind in ("program", "copybook"):
        from quernstone.functions.cobol import logical_lines

        body = "\n".join(" ".join(code.upper().split()) for _, code in logical_lines(text))
    elif kind in ("jcl", "proc", "include"):
        body = "\n".join(r[:72].rstrip().upper() for r in text.splitlines() if not r.startswith("//*"))
    else:
        body = "\n".join(r.rstrip() for r in text.splitlines())
    return hashlib.sha256(body.encode()).hexdigest() if body.strip() else "empty"


def _inventory(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quernstone.functions.jcl import redact_credentials

        for batch in batches:
            rows = []
            for member_id, path, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                text, encoding = decode(data)
                local = path.split(root.rstrip("/"), 1)[-1].lstrip("/")
                parts = local.split("/")
                kind, reason = how_classified(path, text)
                if kind in ("jcl", "proc", "include", "ctlcard"):
                    text = redact_credentials(text)
                rows.append((member_id, path, parts[-1].rsplit(".", 1)[0].upper(), kind, reason, parts[0] if len(parts) > 1 else "", "/".join(parts[:-1]), False, hashlib.sha256(data).hexdigest(), norm_hash(kind, text), len(data), text.count("\n") + 1, encoding, text))
            types = [pa.int64(), *[pa.string()] * 6, pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def inventory(files: DataFrame, root: str) -> DataFrame:
    """Rows of (path, content) as members; user names and passwords in job control are blanked before anything is stored."""
    ship(files.sparkSession)
    return files.select(F.xxhash64("path").alias("member_id"), "path", "content").mapInArrow(_inventory(root), SCHEMA)


def _files(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All members below a folder, one row each; hidden folders and those that this engine wrote are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    files = _files(spark, root).filter(~F.col("path").rlike(SKIPPED) & ~name.isin(OUTPUT_MARKER, LIBRARY_MARKER))
    own = _files(spark, root, OUTPUT_MARKER).select(F.regexp_replace("path", "/[^/]*$", "").alias("own"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    written = files.select("path", F.explode(above).alias("own")).join(own, "own", "left_semi").select("path").distinct()
    return inventory(files.join(written, "path", "left_anti"), root)


def libraries(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, folder, expected, present, complete, missing): what the host listed against what arrived, from the markers."""
    told = F.from_json("text", "dataset string, expected int, present int, complete boolean, missing array<string>").alias("t")
    return _files(spark, root, LIBRARY_MARKER).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.decode("content", "UTF-8").alias("text")).select("folder", told).select("t.dataset", "folder", "t.expected", "t.present", F.coalesce("t.complete", F.lit(False)).alias("complete"), "t.missing")


def apply_manifest(members: DataFrame, manifest: dict, root: str = "") -> DataFrame:
    """Declared facts over derived ones (S8): ``authoritative`` libraries, ``systems`` by folder, ``system_of`` by library, ``kinds`` by library.

    A manifest is written by hand, so its entries become a chain of conditions, the first that holds winning.
    """
    path, library = F.upper("path"), F.upper(F.element_at(F.split("library", "/"), -1))
    inside = lambda prefix: path.contains(f"/{prefix.upper().strip('/')}/") | (library == prefix.upper())
    system, kind = F.col("system"), F.col("kind")
    rules = [(inside(x), s) for s, folders in (manifest.get("systems") or {}).items() for x in folders] + [(library == k.upper(), s) for k, s in (manifest.get("system_of") or {}).items()] + [(inside(k), s) for k, s in (manifest.get("system_of") or {}).items()]
    for test, name in reversed(rules):
        system = F.when(test, F.lit(str(name).upper())).otherwise(system)
    for name, declared in (manifest.get("kinds") or {}).items():
        kind = F.when((library == str(name).upper()) & (F.col("reason") != "content"), F.lit(str(declared).lower())).otherwise(kind)
    official = F.lit(False)
    for x in manifest.get("authoritative") or []:
        official = official | inside(x)
    return members.withColumns({"system": system, "kind": kind, "authoritative": official})


def external_interfaces(spark: SparkSession, manifest: dict) -> DataFrame:
    """(kind, peer, direction, target_kind, target): what the manifest says crosses the border."""
    rows = []
    for e in manifest.get("external_interfaces") or []:
        target = next((k for k in ("dataset", "queue", "table", "transaction", "program", "path") if e.get(k)), None)
        if target:
            rows.append(((e.get("kind") or "other").lower(), e.get("peer"), (e.get("direction") or "").lower(), target, str(e[target]) if target == "path" else str(e[target]).upper()))
    return spark.createDataFrame(rows, "kind string, peer string, direction string, target_kind string, target string")


def scheduler(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Scheduler rows from a CSV with a header, columns in any order (S7): job definitions, dependencies, and what is no such file."""
    rows = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in rows.columns}
    job = next((names[c] for c in ("job_name", "job", "jobname") if c in names), None)
    empty = spark.createDataFrame([], "job_name string, depends_on string, kind string")
    if job is None:
        told = f"no job_name column in the first line: {','.join(rows.columns)[:80]}"
        return {"jobs": spark.createDataFrame([], "job_name string, system string, schedule string, calendar string"), "dependencies": empty, "unresolved": spark.createDataFrame([("scheduler_format", told)], "kind string, detail string")}
    get = lambda *of: next((F.trim(F.col(f"`{names[c]}`")) for c in of if c in names), F.lit(None).cast("string"))
    own = rows.select(F.upper(F.trim(F.col(f"`{job}`"))).alias("job_name"), F.nullif(get("depends_on", "predecessor"), F.lit("")).alias("before"), get("kind").alias("kind"), get("system").alias("system"), get("schedule").alias("schedule"), get("calendar").alias("calendar")).filter("job_name is not null and job_name <> ''")
    return {
        "jobs": own.filter("before is null").select("job_name", "system", "schedule", "calendar"),
        "dependencies": own.filter("before is not null").select("job_name", F.upper("before").alias("depends_on"), F.coalesce(F.nullif("kind", F.lit("")), F.lit("predecessor")).alias("kind")),
        "unresolved": spark.createDataFrame([], "kind string, detail string"),
    }
