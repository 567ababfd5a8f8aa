"""COBOL data descriptions: pictures, storage sizes, and trees of items at byte offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_REPEAT = re.compile(r"(.)\((\d+)\)")
_USAGES = {
    "COMP": "COMP", "COMPUTATIONAL": "COMP", "BINARY": "COMP", "COMP-4": "COMP", "COMPUTATIONAL-4": "COMP", "COMP-5": "COMP-5", "COMPUTATIONAL-5": "COMP-5",
    "COMP-1": "COMP-1", "COMPUTATIONAL-1": "COMP-1", "COMP-2": "COMP-2", "COMPUTATIONAL-2": "COMP-2", "COMP-3": "COMP-3", "COMPUTATIONAL-3": "COMP-3",
    "PACKED-DECIMAL": "COMP-3", "INDEX": "INDEX", "POINTER": "POINTER", "DISPLAY": "DISPLAY", "DISPLAY-1": "DISPLAY-1", "NATIONAL": "NATIONAL",
}


@dataclass
class Picture:
    chars: int
    digits: int
    scale: int
    signed: bool
    numeric: bool
    edited: bool


def parse_picture(pic: str) -> Picture:
    """Sizes told by a picture; S, V and P take no storage, CR and DB two bytes."""
    text = pic.upper()
    while m := _REPEAT.search(text):
        text = text[: m.start()] + m[1] * int(m[2]) + text[m.end() :]
    signed = text.startswith("S")
    body = text.replace("S", "", 1) if signed else text
    chars = len(body.replace("V", "").replace("P", ""))
    digits = sum(body.count(c) for c in "9Z*") if not re.search("[XA]", body) else 0
    after = body.split("V", 1)[1] if "V" in body else ""
    numeric = bool(body) and not body.strip("9VP")
    return Picture(chars, digits, sum(after.count(c) for c in "9Z*"), signed, numeric, not numeric and not re.search("[XA]", body))


def storage_bytes(pic: str | None, usage: str = "DISPLAY", separate_sign: bool = False) -> int:
    p = parse_picture(pic) if pic else Picture(0, 0, 0, False, False, False)
    if usage == "COMP-3":
        return (p.digits + 2) // 2 if p.digits else 0
    if usage in ("COMP", "COMP-5"):
        return 2 if p.digits <= 4 else 4 if p.digits <= 9 else 8
    fixed = {"COMP-1": 4, "COMP-2": 8, "INDEX": 4, "POINTER": 4}.get(usage)
    if fixed:
        return fixed
    return p.chars * (2 if usage in ("NATIONAL", "DISPLAY-1") else 1) + (1 if p.signed and separate_sign else 0)


@dataclass
class Item:
    level: int
    name: str
    line: int
    section: str = ""
    fd: str = ""
    sync: bool = False
    pic: str | None = None
    usage: str | None = None
    separate: bool | None = None
    occurs: int = 1
    odo: str | None = None
    redefines: str | None = None
    value: str | None = None
    offset: int = 0
    length: int = 0
    parent: Item | None = None
    children: list[Item] = field(default_factory=list)
    values: list[tuple[str, str, str, int]] = field(default_factory=list)  # 88s: (name, lo, hi, line)

    @property
    def extent(self) -> int:
        return self.length * self.occurs

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


_WORD = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[^\s,;]+")
_ENTRY = re.compile(r"(\d{1,2})(?:\s+|$)")


def parse_entry(text: str, line: int, section: str = "") -> Item | None:
    """One data description entry without its period."""
    m = _ENTRY.match(text.strip())
    if not m:
        return None
    words = _WORD.findall(text.strip()[m.end() :])
    level, at = int(m[1]), 0
    clauses = {"PIC", "PICTURE", "USAGE", "OCCURS", "REDEFINES", "VALUE", "VALUES", "SIGN", "SYNC", "SYNCHRONIZED", "JUSTIFIED", "BLANK", *_USAGES}
    name = "FILLER"
    if words and words[0].upper() not in clauses:
        name, at = words[0].upper(), 1
    item = Item(level, name, line, section)
    upper = [w.upper() for w in words]
    while at < len(words):
        w = upper[at]
        following = upper[at + 1] if at + 1 < len(words) else ""
        if w in ("PIC", "PICTURE"):
            at += 2 if following == "IS" else 1
            item.pic = words[at].upper() if at < len(words) else None
        elif w == "OCCURS":
            numbers = [int(x) for x in upper[at + 1 : at + 4] if x.isdigit()]
            item.occurs = max(numbers or [1])
        elif w == "DEPENDING":
            at += 1 if following == "ON" else 0
            item.odo = upper[at + 1] if at + 1 < len(words) else None
            at += 1
        elif w == "REDEFINES":
            item.redefines = following
            at += 1
        elif w in ("VALUE", "VALUES"):
            at += 1 if following in ("IS", "ARE") else 0
            rest = words[at + 1 :]
            if level == 88:
                item.values, k = [], 0
                rest = [r for r in rest if r.upper() not in ("IS", "ARE")]
                while k < len(rest):
                    hi = rest[k]
                    step = 1
                    if k + 2 < len(rest) and rest[k + 1].upper() in ("THRU", "THROUGH"):
                        hi, step = rest[k + 2], 3
                    item.values.append((name, unquote(rest[k]), unquote(hi), line))
                    k += step
                break
            item.value = unquote(rest[0]) if rest else None
            at += 1
        elif w in ("SYNC", "SYNCHRONIZED"):
            item.sync = True
        elif w == "SEPARATE":
            item.separate = True
        elif w in _USAGES and w != "INDEX" or w == "INDEX" and upper[at - 1] in ("USAGE", "IS"):
            item.usage = _USAGES[w]
        at += 1
    return item


def unquote(s: str) -> str:
    return s[1:-1].replace(s[0] * 2, s[0]) if len(s) > 1 and s[0] in "'\"" and s[-1] == s[0] else s


def build_trees(items: list[Item]) -> tuple[list[Item], list[str]]:
    """Roots with offsets set, and warnings. Fragments (no 01) hang under a root of their own."""
    roots: list[Item] = []
    stack: list[Item] = []
    warnings: list[str] = []
    for item in items:
        if item.level == 88:
            if stack:
                stack[-1].values += item.values
            continue
        if item.level == 66:
            warnings.append(f"{item.name} renames other items (level 66) and has no bytes of its own")
            continue
        if item.sync:
            warnings.append(f"{item.name} is SYNCHRONIZED: slack bytes before it are not counted")
        if item.level in (1, 77):
            stack = [item]
            roots.append(item)
            continue
        while stack and stack[-1].level >= item.level:
            stack.pop()
        if not stack:
            root = Item(0, "(FRAGMENT)", item.line, item.section)
            if roots and roots[-1].level == 0:
                root = roots[-1]
            else:
                roots.append(root)
            stack = [root]
        item.parent = stack[-1]
        stack[-1].children.append(item)
        stack.append(item)
    for root in roots:
        _place(root, 0, "DISPLAY", False, warnings)
    return roots, warnings


def _place(item: Item, start: int, usage: str, separate: bool, warnings: list[str]) -> None:
    """Offsets: a REDEFINES begins at its base and moves nothing; usage and sign are inherited unless stated."""
    usage, separate = item.usage or usage, separate if item.separate is None else item.separate
    item.offset = start
    if not item.children:
        item.length = storage_bytes(item.pic, usage, separate)
        return
    at, end, by_name = start, start, {}
    for c in item.children:
        base = by_name.get(c.redefines) if c.redefines else None
        if c.redefines and base is None:
            warnings.append(f"{c.name} redefines {c.redefines}, which is not before it")
        _place(c, base.offset if base else at, usage, separate, warnings)
        if base:
            if c.extent > base.extent:
                warnings.append(f"{c.name} is longer than {base.name}")
        else:
            at = c.offset + c.extent
        end = max(end, c.offset + c.extent)
        by_name[c.name] = c
    item.length = end - start
