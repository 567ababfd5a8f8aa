"""Macro sources: screens (BMS), databases and program views (DBD, PSB), resource definitions (CSD)."""

from __future__ import annotations

import re
from collections import defaultdict

from quernstone.functions.jcl import split_operands


def macros(text: str) -> list[tuple[int, str, str, dict[str, str]]]:
    """(line, label, operation, operands) of assembler-format statements, column 72 continuing."""
    out, pending = [], None
    for no, raw in enumerate(text.splitlines(), 1):
        if raw.startswith("*"):
            continue
        r, goes_on = raw[:71].rstrip(), len(raw) > 71 and raw[71] != " "
        if pending:
            pending[3] += r.strip()
        elif m := re.match(r"(\S*)\s+(\S+)\s*(.*)", r):
            pending = [no, m[1].upper(), m[2].upper(), m[3].strip()]
        if pending and not goes_on:
            ops: dict[str, str] = {}
            for n, x in enumerate(split_operands(pending[3].split(" ")[0] if "'" not in pending[3] else pending[3])):
                k, eq, v = x.partition("=")
                ops[k.upper() if eq else f"#{n}"] = v if eq else k
            out.append((pending[0], pending[1], pending[2], ops))
            pending = None
    return out


def parse_bms(text: str) -> dict[str, list[dict]]:
    facts, map_ = defaultdict(list), ""
    for line, label, op, ops in macros(text):
        if op == "DFHMDI":
            map_ = label
            facts["screen"].append({"map": label, "size": ops.get("SIZE", ""), "line": line})
        elif op == "DFHMDF":
            row, _, col = ops.get("POS", "(0,0)").strip("()").partition(",")
            facts["screen_field"].append({"map": map_, "name": label, "row": int(row or 0), "col": int(col or 0), "length": int(ops.get("LENGTH", 0) or 0), "initial": ops.get("INITIAL", "").strip("'"), "line": line})
            for suffix in "IOLFA" if label else "":
                facts["screen_symbol"].append({"map": map_, "name": label, "symbol": label + suffix, "line": line})
    return dict(facts)


def parse_dbd(text: str) -> dict[str, list[dict]]:
    facts, dbd, segment = defaultdict(list), "", ""
    for line, _, op, ops in macros(text):
        if op == "DBD":
            dbd = ops.get("NAME", "")
            facts["ims_dbd"].append({"dbd": dbd, "access": ops.get("ACCESS", ""), "line": line})
        elif op == "SEGM":
            segment = ops.get("NAME", "")
            facts["ims_segment"].append({"dbd": dbd, "segment": segment, "parent": ops.get("PARENT", "").strip("()").split(",")[0], "bytes": int(re.sub(r"\D.*", "", ops.get("BYTES", "0").strip("()")) or 0), "line": line})
        elif op == "FIELD":
            name = ops.get("NAME", "").strip("()").split(",")
            facts["ims_field"].append({"dbd": dbd, "segment": segment, "field": name[0], "is_seq": "SEQ" in name, "start": int(ops.get("START", 0) or 0), "bytes": int(ops.get("BYTES", 0) or 0), "line": line})
    return dict(facts)


def parse_psb(text: str) -> dict[str, list[dict]]:
    """PCBs with the position a program sees: one more where the I/O PCB comes first."""
    facts, pcbs, psb, io_first = defaultdict(list), [], "", False
    for line, _, op, ops in macros(text):
        if op == "PCB" and ops.get("LIST", "YES") != "NO":
            pcbs.append({"type": ops.get("TYPE", ""), "dbd": ops.get("DBDNAME", ops.get("NAME", "")), "procopt": ops.get("PROCOPT", ""), "line": line, "senseg": []})
        elif op == "SENSEG" and pcbs:
            pcbs[-1]["senseg"].append(ops.get("NAME", ""))
        elif op == "PSBGEN":
            psb, io_first = ops.get("PSBNAME", ""), ops.get("CMPAT", "NO") == "YES"
    for n, p in enumerate(pcbs, 1):
        facts["ims_pcb"].append({"psb": psb, "position": n + io_first, **p})
    return dict(facts)


def parse_csd(text: str) -> dict[str, list[dict]]:
    facts = defaultdict(list)
    for no, raw in enumerate(re.sub(r"\n(?!\s*DEFINE)", " ", text, flags=re.I).splitlines(), 1):
        attrs = {k.upper(): v for k, v in re.findall(r"(\w+)\(([^)]*)\)", raw)}
        if "TRANSACTION" in attrs and re.match(r"\s*DEFINE", raw, re.I):
            facts["transaction_def"].append({"code": attrs["TRANSACTION"], "program": attrs.get("PROGRAM", ""), "psb": "", "line": no})
        elif "FILE" in attrs:
            facts["cics_file"].append({"file": attrs["FILE"], "dsn": attrs.get("DSNAME", ""), "line": no})
    return dict(facts)


def parse_stage1(text: str) -> dict[str, list[dict]]:
    """IMS stage-1 APPLCTN / TRANSACT pairs as routing."""
    facts, psb = defaultdict(list), ""
    for line, _, op, ops in macros(text):
        if op == "APPLCTN":
            psb = ops.get("PSB", ops.get("GPSB", ""))
        elif op == "TRANSACT":
            for code in ops.get("CODE", "").strip("()").split(","):
                facts["transaction_def"].append({"code": code, "program": psb, "psb": psb, "line": line})
    return dict(facts)


def parse_mfs(text: str) -> dict[str, list[dict]]:
    """Message and device formats (S17): fields of MSG in their order with running offsets, of FMT at their positions.

    ``DO n`` to ``ENDDO`` repeats the fields between; a field without a length has that of the device field it names.
    """
    facts, owner, kind, width = defaultdict(list), "", "", {}
    pending: list[tuple[str, str, dict, int]] = []
    stack: list[tuple[int, int]] = []
    for line, label, op, ops in macros(text):
        if op in ("MSG", "FMT"):
            owner, kind = label, op
            pending.append((owner, op, ops, line))
        elif op == "DO":
            stack.append((int(re.sub(r"\D.*", "", ops.get("#0", "1")) or 1), len(pending)))
        elif op == "ENDDO" and stack:
            times, at = stack.pop()
            body = pending[at:]
            pending += [(f"{n}#{k}" if n else n, o, p, at_line) for k in range(2, times + 1) for n, o, p, at_line in body]
        elif op in ("DFLD", "MFLD"):
            name = label or (ops.get("#0", "").strip("()").split(",")[0])
            if op == "DFLD" and ops.get("LTH", "").isdigit():
                width[label] = int(ops["LTH"])
            pending.append((name, op, ops, line))
    offset = 0
    for name, op, ops, line in pending:
        if op in ("MSG", "FMT"):
            owner, kind, offset = name, op, 0
            facts["screen"].append({"map": name, "size": ops.get("TYPE", ""), "line": line})
            continue
        row, _, col = ops.get("POS", "(0,0)").strip("()").partition(",")
        length = int(ops["LTH"]) if ops.get("LTH", "").isdigit() else width.get(name.split("#")[0], 0)
        facts["screen_field"].append({"map": owner, "name": name, "row": int(re.sub(r"\D.*", "", row) or 0), "col": int(re.sub(r"\D.*", "", col) or 0) if kind == "FMT" else offset, "length": length, "initial": ops.get("#0", "").strip("'") if ops.get("#0", "").startswith("'") else "", "line": line})
        offset += length
    return dict(facts)
