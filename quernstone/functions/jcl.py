"""Job control -> facts (E29-E43): statements, includes, symbols, procedures, data sets with their direction and its evidence.

Utility cards (sort, IDCAMS, DB2, report writers) become facts of their own; they stand in the job or in a control member
that a data set names.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict

_OPERAND = re.compile(r"'(?:[^']|'')*'|[(),=]|[^(),='\s]+")
_BREAK = re.compile(r"[',()]")
_SYMBOL = re.compile(r"&([A-Z0-9@#$]{1,8})(\.?)")
_LAUNCHERS = {"IKJEFT01": "tso", "IKJEFT1A": "tso", "IKJEFT1B": "tso", "DFSRRC00": "ims", "IRXJCL": "rexx", "BPXBATCH": "shell"}
_UTILITIES = {
    "SORT": "SORT", "ICEMAN": "SORT", "DFSORT": "SORT", "SYNCSORT": "SORT", "IEBGENER": "COPY", "ICEGENER": "COPY", "IDCAMS": "IDCAMS", "IEFBR14": "NONE", "FTP": "FTP", "DMBATCH": "NDM",
    "DSNUTILB": "DB2UTIL", "DSNTIAUL": "DB2SQL", "DSNTEP2": "DB2SQL", "DSNTEP4": "DB2SQL", "EZTPA00": "EASYTRIEVE", "EZTCOM": "EASYTRIEVE", "SAS": "SAS",
}
#: Procedures of the system that estates call but rarely hold: what they run, and which of their symbols names it.
_SYSTEM_PROCS = {"DSNUPROC": ("DSNUTILB", ""), "IMSBATCH": ("DFSRRC00", "MBR"), "DLIBATCH": ("DFSRRC00", "MBR"), "DBBBATCH": ("DFSRRC00", "MBR"), "SASPROC": ("SAS", ""), "EZTPROC": ("EZTPA00", "")}
_CARD_DDS = frozenset("SYSIN SYSTSIN SORTCNTL TOOLIN DFSPARM INPUT SYSFTP".split())
_READ_DDS = frozenset("SYSUT1 SORTIN SYSIN INDD STEPLIB JOBLIB CARDS CONTROL PARMS".split())
_WRITE_DDS = frozenset("SYSUT2 SORTOUT SYSPRINT SYSOUT OUTDD REPORT".split())


_RELATIVE, _ABSOLUTE = re.compile(r"(.*?)\(([+-]?\d+)\)$"), re.compile(r"(.*)\.(G\d{4}V\d{2})$")
_STATEMENT = re.compile(r"//(\S*)\s+(\S+)\s*(.*)")
_PART = re.compile(r"\(([A-Z@#$][A-Z0-9@#$]{0,7})\)$")
_DATA_SET = re.compile(r"DSN=([^,()'=]*),DISP=([A-Z]+|\([A-Z,]*\))")  # most operands of a DD; for the rest see split_operands
_PLAIN_DSN = re.compile(r"DSN=[^,()'=]*(?:,|$)")
_PART_NAME = re.compile(r"[A-Z@#$][A-Z0-9@#$]{0,7}")


def split_operands(text: str) -> list[str]:
    """Operands at commas that are in no parentheses and no quotes."""
    if "(" not in text and "'" not in text and ")" not in text:
        return [x for x in text.split(",") if x]
    out, depth, quoted, start = [], 0, False, 0
    for m in _BREAK.finditer(text):
        c = m[0]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            if c == ",":
                if depth == 0:
                    out.append(text[start : m.start()])
                    start = m.end()
            else:
                depth += 1 if c == "(" else -1
    return [x for x in [*out, text[start:]] if x]


def substitute(value: str, symbols: dict[str, str], depth: int = 5) -> str:
    """Symbols replaced, to a depth; unknown ones stay; the period that ends a symbol goes."""
    if "&" not in value and "\0" not in value:
        return value
    for _ in range(depth):
        new = _SYMBOL.sub(lambda m: symbols[m[1]] if m[1] in symbols else m[0], value.replace("&&", "\0")).replace("\0", "&&")
        if new == value or "&" not in new:
            return new
        value = new
    return value


def strip_generation(dsn: str) -> tuple[str, str]:
    """(name, generation) of a data set."""
    m = "(" in dsn and _RELATIVE.match(dsn) or ".G" in dsn and _ABSOLUTE.match(dsn)
    return (m[1], m[2]) if m else (dsn, "")


def direction(dd: str, dsn: str, generation: str, ops: dict[str, str]) -> tuple[str, str]:
    """(mode, evidence): the first that tells wins."""
    disp = ops.get("DISP", "").strip("()").split(",")[0]
    if "SYSOUT" in ops:
        return "output", "sysout"
    if "DUMMY" in ops or dsn == "NULLFILE":
        return "none", "dummy"
    if generation and re.fullmatch(r"[+-]?\d+", generation):
        return ("output" if generation.startswith("+") and int(generation) > 0 else "input"), "gdg"
    if dd in _READ_DDS:
        return "input", "dd_name"
    if dd in _WRITE_DDS:
        return "output", "dd_name"
    if disp in ("NEW", "MOD"):
        return "output", "disp"
    if disp in ("SHR", "OLD"):
        return "input", "disp_weak"
    return "unknown", "none"


def statements(text: str) -> list[tuple[int, str, str, str, list[str]]]:
    """(line, name, operation, operands, in-stream lines), continuations joined."""
    out: list[tuple[int, str, str, str, list[str]]] = []
    pending: list | None = None
    ends: str | None = None
    for no, raw in enumerate(text.splitlines(), 1):
        if ends is not None:
            if raw.startswith(ends) or ends == "/*" and raw.startswith("//") and not raw.startswith("//*"):
                ends = None
                if raw.startswith("/*"):
                    continue
            else:
                out[-1][4].append(raw[:72].rstrip())
                continue
        if raw[:2] != "//" or raw[:3] == "//*":
            continue
        r = raw[:71].rstrip()
        if r == "//":
            continue
        if pending is not None:
            pending[3] += r[2:].strip().split("  ")[0].strip()
        else:
            m = _STATEMENT.match(r)
            if not m:
                continue
            operands = m[3]
            if "'" not in operands and m[2].upper() != "IF":
                operands = operands.split(" ")[0]
            pending = [no, m[1].upper(), m[2].upper(), operands.strip()]
        if pending[3].endswith(","):
            continue
        out.append((*pending, []))
        if pending[2] == "DD" and (pending[3] in ("*", "DATA") or pending[3].startswith(("*,", "DATA,"))):
            m = re.search(r"DLM=(\S\S)", pending[3])
            ends = m[1] if m else "/*"
        pending = None
    return out


@functools.lru_cache(maxsize=256)
def _part_statements(text: str) -> list[tuple[int, str, str, str, list[str]]]:
    """Statements of a part, which many members use; nobody changes them."""
    return statements(text)


def _keywords(operands: str) -> dict[str, str]:
    if m := _DATA_SET.fullmatch(operands):
        return {"DSN": m[1], "DISP": m[2]}
    out = {}
    for x in split_operands(operands):
        k, _, v = x.partition("=")
        out[k.upper()] = v
    return out


def variables(dsn: str) -> str:
    """Run-time tokens of schedulers and symbols that nothing set, as ``<VAR>``."""
    return re.sub(r"%%[$A-Z0-9_]+\.?|&(?!&)[A-Z0-9@#$]+\.?", "<VAR>", dsn) if ("&" in dsn or "%%" in dsn) and not dsn.startswith("&&") else dsn


_CREDENTIAL = re.compile(r"(?i)\b(PASSWORD|PASSWD|PASS|PWD|USERID|USER|LOGIN)\b(\s*[=(]\s*|\s+)('[^']*'|[^\s,)]+)")
#: Without one of these no line is changed.
_SECRETS = ("PGM=FTP", "PGM=DMBATCH", "PASSWORD=", "USER=")
_FTP_VERBS = frozenset("GET PUT MGET MPUT CD LCD BINARY BIN ASCII TYPE SITE LOCSITE QUIT OPEN CLOSE DIR DELETE RENAME MODE EBCDIC".split())


def redact_credentials(text: str) -> str:
    """User names and passwords blanked before a text is stored (E43): keywords, and the log-on lines of transfer steps."""
    if not any(x in text for x in _SECRETS):  # nothing to blank
        return "\n".join(text.splitlines()) + ("\n" if text.endswith("\n") else "")
    out, transfer, logon = [], False, False
    for r in text.splitlines():
        if r.startswith("//"):
            if re.match(r"//\S*\s+EXEC\b", r):
                transfer = bool(re.search(r"PGM=(FTP|DMBATCH)\b", r))
            logon = transfer and bool(re.match(r"//\S+\s+DD\s+(\*|DATA)", r))
            if re.match(r"//\S+\s+JOB\b|//\s", r):
                r = re.sub(r"\b(PASSWORD|USER)=('[^']*'|\([^)]*\)|[^\s,]+)", r"\1=********", r)
        elif logon and r.strip():
            words = r.split()
            if words[0].upper() in _FTP_VERBS:
                logon = False
            elif len(words) > 1 or "." not in words[0]:  # a host alone stays
                r = re.sub(r"\S+", "********", r)
        if transfer and not r.startswith("//"):
            r = _CREDENTIAL.sub(lambda m: f"{m[1]}{m[2]}********", r)
        out.append(r)
    return "\n".join(out) + ("\n" if text.endswith("\n") else "")


def spliced(text: str, lookup: dict[str, str], depth: int = 5, is_part: bool = False) -> tuple[list[tuple[int, str, str, str, list[str]]], list[tuple[str, str, int]]]:
    """Statements with INCLUDE members put in (E32), their names with the symbols set so far; and what is missing."""
    missing: list[tuple[str, str, int]] = []
    symbols: dict[str, str] = {}

    def go(found: list, outer: int, left: int) -> list:
        out = []
        for st in found:
            at = outer or st[0]
            if st[2] == "SET":
                symbols.update({k: substitute(v.strip("'"), symbols) for k, v in _keywords(st[3]).items()})
            if st[2] != "INCLUDE":
                out.append((at, *st[1:]))
                continue
            name = substitute(_keywords(st[3]).get("MEMBER", ""), symbols).upper()
            if name in lookup and left:
                out += go(_part_statements(lookup[name]), at, left - 1)
            else:
                missing.append(("missing_include" if name not in lookup else "include_too_deep", name, at))
        return out

    return go(_part_statements(text) if is_part else statements(text), 0, depth), missing


def part_names(text: str) -> set[str]:
    """Names of procedures, include members and control members that a text calls for."""
    out, symbols, nested = set(), {}, False
    for _, _, op, operands, _ in statements(text):
        if op == "DD" and not nested and (m := _PLAIN_DSN.match(operands)) and operands.upper().find("DSN", m.end()) < 0:  # names no member
            continue
        kw = _keywords(operands)
        if op == "SET":
            symbols.update({k: substitute(v.strip("'"), symbols) for k, v in kw.items()})
            nested = nested or any(")" in v for v in symbols.values())
        elif op == "INCLUDE":
            out.add(substitute(kw.get("MEMBER", ""), symbols).upper())
        elif op == "EXEC" and "PGM" not in kw:
            first = split_operands(operands)[:1]
            out.add(substitute(kw.get("PROC") or (first[0] if first and "=" not in first[0] else ""), symbols).upper())
        elif op == "DD" and (m := _PART.search(substitute(kw.get("DSN", kw.get("DSNAME", "")), symbols).upper())):
            out.add(m[1])
    return {x for x in out if _PART_NAME.fullmatch(x)}


def parse_jcl(text: str, parts: dict[str, str] | None = None) -> dict[str, list[dict]]:
    """Facts of one member: jobs, steps as they run (procedures expanded to depth 5), and their data sets.

    ``parts`` holds procedures, include members and control members by name. A member with several JOB cards gives the
    facts of each job.
    """
    facts: dict[str, list[dict]] = defaultdict(list)
    parts = parts or {}
    found, missing = spliced(text, parts)
    for kind, detail, line in missing:
        facts["unresolved"].append({"kind": kind, "detail": detail, "line": line})
    jobs: list[list] = [[]]
    for st in found:
        if st[2] == "JOB" and any(x[2] == "JOB" for x in jobs[-1]):
            jobs.append([])
        jobs[-1].append(st)
    for own in jobs:
        _job(facts, own, parts)
    return dict(facts)


def _job(facts: dict[str, list[dict]], found: list, parts: dict[str, str]) -> None:
    job, symbols = "", {}
    streams: dict[str, list] = {}
    body: list = []
    inside: str | None = None
    for st in found:
        if st[2] == "PROC":
            inside = st[1] or "(PROC)"
            streams[inside] = [st]
        elif st[2] == "PEND":
            inside = None
        elif inside:
            streams[inside].append(st)
        else:
            body.append(st)
    if not any(st[2] == "JOB" for st in body) and streams:
        name, own = next(iter(streams.items()))
        facts["proc_def"].append({"proc": name, "line": own[0][0], "symbolics": _keywords(own[0][3])})
        _steps(facts, "", own[1:], _keywords(own[0][3]), {}, parts, 0, name)
        return
    for st in body:
        if st[2] == "JOB":
            job = st[1]
            facts["job"].append({"job": job, "line": st[0]})
        elif st[2] == "JCLLIB":
            order = _keywords(st[3]).get("ORDER", "")
            for n, lib in enumerate(split_operands(order.strip("()"))):
                facts["job_library"].append({"job": job, "position": n, "library": substitute(lib, symbols).strip("'"), "line": st[0]})
        elif st[2] == "SET":
            symbols.update({k: substitute(v.strip("'"), symbols) for k, v in _keywords(st[3]).items()})
    _steps(facts, job, [st for st in body if st[2] not in ("JOB", "SET", "JCLLIB")], symbols, streams, parts, 0, "")


def _overridden(own: list[tuple[int, dict, list]], more: list[tuple[int, dict, list]]) -> list[tuple[int, dict, list]]:
    """The n-th entry of a concatenation with the n-th that overrides it: keywords it names replace, the rest stay."""
    out = []
    for k in range(max(len(own), len(more))):
        if k >= len(more):
            out.append(own[k])
        elif k >= len(own):
            out.append(more[k])
        else:
            (no, kw, lines), (_, new, new_lines) = own[k], more[k]
            if {"DUMMY", "*", "DATA"} & new.keys() or {"DSN", "DSNAME"} & new.keys():
                kw = {x: v for x, v in kw.items() if x not in ("DUMMY", "*", "DATA", "SYSOUT", "DSN", "DSNAME")}
            out.append((no, kw | {x: v for x, v in new.items() if v or x in ("DUMMY", "*", "DATA")}, new_lines or lines))
    return out


def _steps(facts, job, body, symbols, streams, parts, depth, from_proc, overrides=None, parent="", guards=()) -> None:
    """``overrides``: (step or "", DD) -> entries whose symbols are replaced already; one without a step is the first step's."""
    guard: list[str] = list(guards)
    groups: list[tuple[dict, list]] = []
    for st in body:
        no, name, op, operands, _ = st
        if op == "IF":
            guard.append(re.sub(r"\s*\bTHEN\b.*", "", operands).strip())
        elif op == "ELSE" and len(guard) > len(guards):
            guard[-1] = f"NOT ({guard[-1]})"
        elif op == "ENDIF" and len(guard) > len(guards):
            guard.pop()
        elif op == "EXEC":
            groups.append(({"line": no, "name": name, "ops": operands, "guard": list(guard)}, []))
        elif op == "DD" and groups:
            groups[-1][1].append(st)
    for number, (step, dds) in enumerate(groups):
        ops = _keywords(step["ops"])
        positional = next((k for k, v in ops.items() if not v and k not in ("PGM", "PROC")), "")
        proc = substitute(ops.get("PROC") or ("" if "PGM" in ops else positional), symbols)
        label = f"{parent}.{step['name']}" if parent else step["name"]
        when = step["guard"] + ([f"COND={ops['COND']}"] if ops.get("COND") else [])
        named: dict[str, list] = {}
        last = ""
        for st in dds:
            last = st[1] or last
            named.setdefault(last, []).append((st[0], _keywords(substitute(st[3], symbols)), st[4]))
        mine = {dd: own for (where, dd), own in (overrides or {}).items() if where == step["name"] or not where and number == 0}
        if proc:
            own = streams.get(proc) or (spliced(parts[proc], parts, is_part=True)[0] if proc in parts else None)
            given = {k: substitute(v.strip("'"), symbols) for k, v in ops.items() if k not in ("PROC", "COND", "REGION", "PARM", "TIME") and v}
            if own is None and proc in _SYSTEM_PROCS:
                program, symbol = _SYSTEM_PROCS[proc]
                target = given.get(symbol, "")
                facts["step"].append({"job": job, "step": label, "pgm": program, "effective": target or program, "how": "system_proc", "from_proc": proc, "psb": given.get("PSB", target), "line": step["line"], "ordinal": len(facts["step"]), "guard": " AND ".join(when)})
                _data_sets(facts, job, label, {k.rpartition(".")[2]: v for k, v in named.items()}, "DB2UTIL" if program == "DSNUTILB" else "", step["line"], parts)
                continue
            if own is None or depth >= 5:
                facts["unresolved"].append({"kind": "missing_proc" if own is None else "proc_too_deep", "detail": proc, "line": step["line"]})
                continue
            default = {k: v.strip("'") for k, v in _keywords(own[0][3]).items()} if own[0][2] == "PROC" else {}
            inner = symbols | default | given
            below = {(key.rpartition(".")[0], key.rpartition(".")[2]): v for key, v in named.items()}
            facts["proc_call"].append({"job": job, "proc": proc, "step": label, "line": step["line"]})
            _steps(facts, job, [x for x in own if x[2] not in ("PROC", "PEND", "SET")], inner, streams, parts, depth + 1, proc, below, label, when)
            continue
        program = substitute(ops.get("PGM", ""), symbols).upper()
        for dd, more in mine.items():
            named[dd] = _overridden(named.get(dd, []), more)
        cards = [x for own in named.values() for _, _, lines in own for x in lines]
        cards += [x for dd in _CARD_DDS & named.keys() for member in _control_members(named[dd]) for x in parts.get(member, "").splitlines()]
        parm = substitute(ops.get("PARM", "").strip("'()"), symbols)
        fields = parm.split(",")
        psb = fields[2].strip().upper() if program == "DFSRRC00" and len(fields) > 2 else ""
        effective, how = _effective(program, parm, cards)
        facts["step"].append({"job": job, "step": label, "pgm": program, "effective": effective, "how": how, "from_proc": from_proc, "psb": psb, "line": step["line"], "ordinal": len(facts["step"]), "guard": " AND ".join(when)})
        _data_sets(facts, job, label, named, how, step["line"], parts)


def _control_members(own: list[tuple[int, dict, list]]) -> list[str]:
    return [m[1] for _, kw, _ in own if (m := _PART.search(kw.get("DSN", kw.get("DSNAME", ""))))]


def _data_sets(facts, job: str, step: str, named: dict[str, list], how: str, line: int, parts: dict[str, str]) -> None:
    """Data set rows of a step, the facts of its cards, and what these say of directions (M3)."""
    cards: list[str] = []
    for dd in named:
        for _, _, lines in named[dd]:
            cards += lines
        if dd in _CARD_DDS:
            for member in _control_members(named[dd]):
                if member in parts:
                    cards += parts[member].splitlines()
                    facts["card_member"].append({"job": job, "step": step, "dd": dd, "member_name": member, "line": line})
                else:
                    facts["unresolved"].append({"kind": "missing_control_member", "detail": member, "line": line})
    text = "\n".join(cards)
    told: dict[str, str] = {}
    if how == "SORT":
        for kind, pos, length, fmt in sort_fields(text):
            facts["card_field"].append({"job": job, "step": step, "card": kind, "pos": pos, "length": length, "fmt": fmt, "line": line})
        told = sort_roles(text)
    elif how == "IDCAMS":
        for op, dsn in idcams(text):
            facts["idcams_op"].append({"job": job, "step": step, "op": op, "dsn": dsn, "line": line})
            if op == "REPRO IN FILE":
                told[dsn] = "input"
            elif op == "REPRO OUT FILE":
                told[dsn] = "output"
        for source, from_dd, target, to_dd in repro_copies(text):
            facts["dataset_copy"].append({"job": job, "step": step, "source": source, "from_dd": from_dd, "target": target, "to_dd": to_dd, "line": line})
        for row in idcams_attributes(text):
            facts["dataset_attribute"].append({"job": job, "step": step, **row, "line": line})
    elif how in ("DB2UTIL", "DB2SQL"):
        for op, table_, dd in db2_utility(text, how == "DB2SQL"):
            facts["db2_utility"].append({"job": job, "step": step, "op": op, "tbl": table_, "dd": dd, "line": line})
            if dd:
                told[dd] = "output" if op == "UNLOAD" else "input"
    elif how == "EASYTRIEVE":
        for file, name, pos, length, kind in easytrieve(text):
            facts["report_field"].append({"job": job, "step": step, "file": file, "name": name, "pos": pos, "length": length, "kind": kind, "line": line})
    for name, value in control_parameters(text) if how == "pgm" else ():
        facts["card_parameter"].append({"job": job, "step": step, "name": name, "value": value, "line": line})
    for dd, own in named.items():
        for seq, (no, kw, _) in enumerate(own):
            raw = kw.get("DSN", kw.get("DSNAME", ""))
            if raw.startswith("*."):
                raw = _refer(facts, job, raw)
            dsn, generation = strip_generation(variables(raw))
            mode, evidence = direction(dd, dsn, generation, kw)
            if dd in told and evidence not in ("dummy", "sysout"):
                mode, evidence = told[dd], "card"
            facts["dd"].append({"job": job, "step": step, "dd": dd, "concat": seq, "dsn": dsn, "gdg": generation, "disp": kw.get("DISP", ""), "mode": mode, "mode_source": evidence, "temp": dsn.startswith("&&"), "line": no})


def _refer(facts, job: str, raw: str) -> str:
    """``*.STEP.DD`` or ``*.DD`` -> the data set named there before."""
    parts = raw[2:].split(".")
    for row in reversed(facts["dd"]):
        if row["job"] == job and row["dd"] == parts[-1] and (len(parts) == 1 or row["step"].split(".")[-1] == parts[-2] or row["step"] == ".".join(parts[:-1])):
            return row["dsn"]
    facts["unresolved"].append({"kind": "referback", "detail": raw, "line": 0})
    return ""


def _effective(program: str, parm: str, cards: list[str]) -> tuple[str, str]:
    """What really runs (E33): a launcher's program from its cards or parameter, or a utility."""
    kind = _LAUNCHERS.get(program)
    if kind == "tso":
        for c in cards:
            if m := re.search(r"\bRUN\s+PROGRAM\s*\(\s*(\S+?)\s*\)|\bCALL\s+'?[^'(]*\((\w+)\)", c, re.I):
                name = (m[1] or m[2]).upper()
                return name, _UTILITIES.get(name, "tso_run")
        return program, "unresolved"
    if kind == "ims":
        fields = parm.split(",")
        return (fields[1].strip().upper(), "ims_parm") if len(fields) > 1 and fields[1].strip() else (program, "unresolved")
    if kind == "rexx":
        return (parm.split()[0].upper(), "rexx_parm") if parm.split() else (program, "unresolved")
    if kind == "shell":
        m = re.match(r"(?:SH|PGM)\s+(\S+)", parm, re.I)
        return (m[1], "shell_parm") if m else (program, "unresolved")
    return program, _UTILITIES.get(program, "pgm")


_CARD = re.compile(r"\b(SORT|MERGE|SUM|INCLUDE|OMIT|INREC|OUTREC|OUTFIL|JOINKEYS)\b")
_CLAUSE = re.compile(r"\b(FIELDS|COND|BUILD|OUTREC|OVERLAY|INCLUDE|OMIT)=\(([^)]*)\)?")
_FIELD = re.compile(r"(?:\d+:)?(\d+),(\d+)(?:,([A-Z]{2}))?")


def sort_symbols(text: str) -> dict[str, str]:
    """Symbols of the form NAME,position,length[,format] -> the text they stand for."""
    return {m[1]: ",".join(x for x in m.groups()[1:] if x) for m in re.finditer(r"(?m)^([A-Z][A-Z0-9_-]*),(\d+),(\d+)(?:,([A-Z]{2}))?\s*$", text)}


def sort_fields(text: str) -> list[tuple[str, int, int, str]]:
    """(card, position, length, format) named by sort cards (E38); symbols stand for fields, ``c:`` for a column."""
    symbols = sort_symbols(text)
    out = []
    for r in re.sub(r",[ \t]*\n[ \t]+", ",", text).splitlines():
        head = _CARD.search(r.upper())
        if not head:
            continue
        body = re.sub(r"[A-Z][A-Z0-9_-]*", lambda m: symbols.get(m[0], m[0]), r.upper()[head.end() :]) if symbols else r.upper()[head.end() :]
        default = re.search(r"FORMAT=(\w\w)", body)
        for m in _CLAUSE.finditer(body):
            card = head[1] if m[1] in ("FIELDS", "COND", "BUILD", "OVERLAY", "OUTREC") else f"{head[1]} {m[1]}"
            for f in _FIELD.finditer(m[2]):
                out.append((card, int(f[1]), int(f[2]), f[3] or (default[1] if default else "")))
    return out


def sort_roles(text: str) -> dict[str, str]:
    """DD names that cards give a direction to: OUTFIL writes, JOINKEYS reads."""
    upper = text.upper()
    out = {x: "output" for m in re.finditer(r"\bOUTFIL\b[^\n]*?\bFNAMES=\(?([A-Z0-9@#$,]+)", upper) for x in m[1].split(",") if x}
    out |= {f"SORTOF{m[1]}": "output" for m in re.finditer(r"\bOUTFIL\b[^\n]*?\bFILES=(\d+)", upper)}
    return out | {m[1]: "input" for m in re.finditer(r"\bJOINKEYS\b[^\n]*?\bFILES?=([A-Z0-9@#$]+)", upper)}


def _joined(text: str) -> str:
    return re.sub(r"[-+][ \t]*\n[ \t]*", " ", "\n".join(r.rstrip() for r in text.splitlines()))


_AMS_NAME = r"\(\s*'?([A-Z0-9.@#$-]+)'?"


def idcams(text: str) -> list[tuple[str, str]]:
    """(operation, data set or DD) of DEFINE, DELETE and REPRO cards."""
    joined = _joined(text)
    out = [(f"DEFINE {m[1].upper()}", m[2].upper()) for m in re.finditer(rf"\b(?:DEFINE|DEF)\s+(\w+)\s*\(\s*NAME\s*{_AMS_NAME}", joined, re.I)]
    out += [("DELETE", m[1].upper()) for m in re.finditer(r"\b(?:DELETE|DEL)\s+\(?\s*'?([A-Z0-9.@#$-]+)", joined, re.I)]
    for k in ("IN", "OUT"):
        out += [(f"REPRO {k}", m[1].upper()) for m in re.finditer(rf"\b{k}DATASET\s*{_AMS_NAME}", joined, re.I)]
        out += [(f"REPRO {k} FILE", m[1].upper()) for m in re.finditer(rf"\b{k}FILE\s*{_AMS_NAME}", joined, re.I)]
    return out


def repro_copies(text: str) -> list[tuple[str, bool, str, bool]]:
    """(source, whether it is a DD, target, whether it is a DD) of each REPRO."""
    out = []
    for block in re.split(r"(?i)\bREPRO\b", _joined(text))[1:]:
        ends = [next(((m[1].upper(), kind == "FILE") for kind in ("DATASET", "FILE") if (m := re.search(rf"\b{side}{kind}\s*{_AMS_NAME}", block, re.I))), None) for side in ("IN", "OUT")]
        if all(ends):
            out.append((*ends[0], *ends[1]))
    return out


def idcams_attributes(text: str) -> list[dict]:
    """Type, record sizes, key and generation limit of what DEFINE cards make."""
    out = []
    for block in re.split(r"(?i)\bDEF(?:INE)?\s+(?=CLUSTER|GDG|AIX|GENERATIONDATAGROUP)", _joined(text))[1:]:
        name = re.search(rf"NAME\s*{_AMS_NAME}", block, re.I)
        pair = lambda word, b=block: (lambda m: (int(m[1]), int(m[2])) if m else (0, 0))(re.search(rf"\b{word}\w*\s*\(\s*(\d+)[\s,]+(\d+)", b, re.I))
        kind = next((k for k, w in (("KSDS", "INDEXED"), ("ESDS", "NONINDEXED"), ("RRDS", "NUMBERED"), ("LDS", "LINEAR")) if re.search(rf"\b{w}\b", block, re.I)), "")
        head = block.split(None, 1)[0].upper().split("(")[0]
        limit = re.search(r"\bLIM\w*\s*\(\s*(\d+)", block, re.I)
        (average, largest), (key_length, key_offset) = pair("REC"), pair("KEY")
        if name:
            out.append({"dsn": name[1].upper(), "kind": "GDG" if head.startswith("G") else "AIX" if head == "AIX" else kind or "KSDS", "average": average, "largest": largest, "key_length": key_length, "key_offset": key_offset, "generations": int(limit[1]) if limit else 0})
    return out


_TABLE = r"\s+([A-Z0-9_#@$]+(?:\.[A-Z0-9_#@$]+)?)"


def db2_utility(text: str, is_sql: bool = False) -> list[tuple[str, str, str]]:
    """(operation, table or table space, DD) of utility cards, or the verbs of SQL that a program runs from its input."""
    upper = " ".join(text.upper().split())
    if is_sql:
        found = [("SELECT", m[1]) for m in re.finditer(rf"\b(?:FROM|JOIN){_TABLE}", upper)]
        found += [(m[1].split()[0], m[2]) for m in re.finditer(rf"\b(INSERT INTO|UPDATE|DELETE FROM|MERGE INTO){_TABLE}", upper)]
        deleted = {t for v, t in found if v == "DELETE"}
        return sorted({(v, t, "") for v, t in found if not (v == "SELECT" and t in deleted)})
    out = []
    for m in re.finditer(r"\b(LOAD|UNLOAD|REORG|RUNSTATS|COPY|CHECK|QUIESCE|REBUILD|RECOVER|REPAIR|MODIFY)\b(.*?)(?=\b(?:LOAD|UNLOAD|REORG|RUNSTATS|COPY|CHECK|QUIESCE|REBUILD|RECOVER|REPAIR|MODIFY)\b\s+(?:DATA|TABLESPACE|INDEX|FROM|REPLACE|INDDN|RESUME|RECOVERY)|$)", upper):
        dd = re.search(r"\b(?:INDDN|UNLDDN|COPYDDN|PUNCHDDN)\s*\(?\s*([A-Z0-9@#$]+)", m[2])
        tables = re.findall(rf"\b(?:INTO TABLE|FROM TABLE|TABLESPACE|INDEX){_TABLE}", m[2])
        out += [(m[1], t, dd[1] if dd and m[1] in ("LOAD", "UNLOAD") else "") for t in tables]
    return out


def easytrieve(text: str) -> list[tuple[str, str, int, int, str]]:
    """(file, field, position, length, type) of a report program's FILE and field lines; files alone have no field."""
    out, file = [], ""
    for r in text.splitlines():
        words = r[:72].split()
        if len(words) >= 2 and words[0].upper() == "FILE":
            file = words[1].upper().rstrip(".")
            out.append((file, "", 0, 0, ""))
        elif file and len(words) >= 4 and words[1].isdigit() and words[2].isdigit() and words[3][:1].isalpha():
            out.append((file, words[0].upper(), int(words[1]), int(words[2]), words[3].upper().rstrip(".")))
        elif words and words[0].upper() in ("JOB", "SORT", "REPORT"):
            file = ""
    return out


def control_parameters(text: str) -> list[tuple[str, str]]:
    """KEY=VALUE cards of a program's own input."""
    return [(m[1], m[2].strip()) for r in text.splitlines() if (m := re.fullmatch(r"\s*([A-Z][A-Z0-9_.-]*)\s*=\s*([^=]*?)\s*", r[:72]))]
