"""Recovery and reconciliation (C1-C19): copybook text found in expanded sources, choices checked, names matched to disk."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.relational import ordered_list

#: Most serious first.
VERDICTS = ("CONTRADICTED", "OLDER", "NOT HELD", "UNKNOWN", "CONFIRMED")


def aligned_blocks(original: str, expanded: str) -> list[tuple[str, str, bool]]:
    """(copybook, text, trusted): lines put in at each COPY when the expanded text is aligned to the original.

    Lines that changed anywhere else make every block untrusted.
    """
    a, b = ([r[6:72].rstrip() for r in t.splitlines()] for t in (original, expanded))
    copies = [(n, m[1].upper()) for n, r in enumerate(a) if (m := re.search(r"\bCOPY\s+([A-Z0-9-]+)", r, re.I))]
    blocks, stray = [], False
    for op, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        here = [name for n, name in copies if a0 - 1 <= n <= a1]
        if len(here) == 1 and b1 > b0:
            blocks.append((here[0], "\n".join(b[b0:b1])))
        else:
            stray = True
    return [(name, text, not stray) for name, text in blocks]


def marked_blocks(text: str, wanted: set[str] | None = None) -> list[tuple[str, str, bool]]:
    """Blocks whose lines carry the copybook's name in columns 73-80 (C3): runs of one name."""
    out: list[tuple[str, list[str]]] = []
    last = ""
    for r in text.splitlines():
        name = r[72:80].strip().upper()
        if re.fullmatch(r"[A-Z][A-Z0-9@#$-]{0,7}", name) and (wanted is None or name in wanted):
            if name != last:
                out.append((name, []))
            out[-1][1].append(r[:72].rstrip())
        last = name
    return [(name, "\n".join(rows), True) for name, rows in out]


def is_copybook(text: str) -> bool:
    """Whether a block looks like data or procedure lines of 80-column source."""
    rows = [r for r in text.splitlines() if r.strip()]
    shaped = sum(len(r) <= 80 for r in rows)
    code = sum(bool(re.match(r".{0,11}\s*(\d\d\s+\S|[A-Z][A-Z-]*\s)", r)) for r in rows if r[6:7] not in "*/")
    return bool(rows) and shaped >= 0.98 * len(rows) and code > 0


_RULER = re.compile(r"-{4}\+-\*A-1-B")
_NUMBERED = re.compile(r"\s{0,4}(\d{4,6})(?:[ \t]{0,2}([A-Z+*]{1,2}))?(?=\s|$)")
_TABLES = re.compile(r"DATA DIVISION MAP|CROSS.REFERENCE|DEFINED\s+REFERENCES|\* Statistics for COBOL", re.I)


def listing_records(listing: str) -> list[tuple[str, str]]:
    """(flag, source record) of the numbered lines of a compiler listing, up to the tables after the source.

    Records begin at the column of the ruler; without one at that which puts a division header in area A.
    """
    rows = listing.splitlines()
    column = next((m.start() for r in rows if (m := _RULER.search(r))), None)
    if column is None:
        header = next(((r.upper().find("DIVISION"), r) for r in rows if _NUMBERED.match(r) and "DIVISION" in r.upper()), None)
        if header is None:
            return []
        column = max(re.search(r"(IDENTIFICATION|ID|PROCEDURE|ENVIRONMENT|DATA)\s+DIVISION", header[1].upper()).start() - 7, 0)
    out = []
    for r in rows:
        m = _NUMBERED.match(r)
        if m and m.end() <= column + 1:
            out.append(((m[2] or "").replace("*", ""), r[column : column + 80].rstrip()))
        elif len(out) >= 5 and _TABLES.search(r):
            break
    return out


def listed_blocks(listing: str) -> list[tuple[str, str, bool]]:
    """(copybook, text, trusted): the flagged lines after each COPY of a compiler listing (C1); unknown flags spoil a block."""
    out: list[tuple[str, list[str], bool]] = []
    name, statement, inside = "", "", False
    for flag, record in listing_records(listing):
        code = record[7:72]
        if flag in ("C", "+"):
            if not inside and name:
                out.append((name, [], True))
                inside = True
            if inside:
                out[-1][1].append(record[:72].rstrip())
            continue
        if flag:
            if inside:
                out[-1] = (*out[-1][:2], False)
            continue
        if not code.strip() or record[6:7] in ("*", "/"):
            continue
        statement = f"{statement} {code.strip()}" if statement else code
        m = re.search(r"\b(?:COPY|INCLUDE)\s+([A-Z0-9@#$-]+)", statement, re.I)
        name, inside = (m[1].upper(), False) if m else ("", False)
        closed = "." in code or "END-EXEC" in code.upper()
        statement = "" if closed or not re.search(r"\b(?:COPY|EXEC\s+SQL)\b", statement, re.I) else statement
    return [(name, "\n".join(rows), trusted) for name, rows, trusted in out]


def copy_sources(listing: str) -> list[tuple[str, str, str]]:
    """(copybook, DD, data set) of the table in which a listing says where its copybooks came from."""
    row = re.compile(r"^[01+ -]?\s*([A-Z@#$][A-Z0-9@#$]{0,7})\s+([A-Z@#$][A-Z0-9@#$]{0,7})\s+([A-Z@#$][A-Z0-9@#$]{0,7}(?:\.[A-Z0-9@#$]{1,8})+)(?:\s|$)")
    return [m.groups() for r in listing.splitlines() if (m := row.match(r))]


def listing_is_current(listing: str, original: str | None) -> tuple[bool | None, int | None]:
    """(current, match in percent): whether a listing's own lines are those of the member (C8); never 100 unless equal."""
    from quernstone.functions.cobol import logical_lines

    own = "\n".join(record for flag, record in listing_records(listing) if not flag)
    if original is None or not own:
        return None, None
    a, b = ([code.rstrip() for _, code in logical_lines(t)] for t in (original, own))
    return (True, 100) if a == b else (False, min(99, int(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() * 100)))


def recovered_blocks(original: str, expanded: str) -> list[tuple[str, str, bool, str]]:
    """(copybook, text, trusted, method): by listing flags, alignment, or names in columns 73-80, the first that gives any (C4)."""
    ways = (("listing", lambda: listed_blocks(expanded)), ("alignment", lambda: aligned_blocks(original, expanded)), ("marks", lambda: marked_blocks(expanded)))
    for how, find in ways:
        found = [b for b in find() if is_copybook(b[1])]
        if found:
            return [(*b, how) for b in found]
    return []


def missing_parts(uses: DataFrame, held: DataFrame) -> DataFrame:
    """(name, state, users): parts that nobody holds, and parts that arrived after their users were parsed.

    uses: (user, name, resolved); held: (name). Links that say resolved though nothing is held any more are stale.
    """
    there = held.select("name").distinct().withColumn("held", F.lit(True))
    both = uses.join(there, "name", "left")
    state = F.when(F.col("held").isNull() & F.col("resolved"), "stale_link").when(F.col("held").isNull(), "missing").when(~F.col("resolved"), "arrived")
    return both.withColumn("state", state).filter("state is not null").groupBy("name", "state").agg(ordered_list("user").alias("users"))


def same_named(missing: DataFrame, members: DataFrame) -> DataFrame:
    """(name, note): what else has the name of a missing part: members of other kinds, with their libraries."""
    others = members.groupBy("name").agg(F.array_sort(F.collect_set(F.concat("kind", F.lit(" in "), "library"))).alias("others"))
    return missing.select("name").distinct().join(others, "name", "left").select("name", F.coalesce(F.array_join("others", "; "), F.lit("no member of this name")).alias("note"))


def refile(members: DataFrame, changes: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with new kinds, members to parse again): those re-typed and those that use them (M5). changes: (member_id, kind); uses: (member_id, name)."""
    new = changes.select("member_id", F.col("kind").alias("new_kind"))
    typed = members.join(new, "member_id", "left").withColumn("kind", F.coalesce("new_kind", "kind")).drop("new_kind")
    names = members.join(new.select("member_id"), "member_id", "left_semi").select("name").distinct()
    pending = uses.join(names, "name", "left_semi").select("member_id").union(new.select("member_id")).distinct()
    return typed, pending


def appended_sections(sections: DataFrame, more: DataFrame, key: str, first: int = 1001) -> DataFrame:
    """Sections of documents with texts read from their pictures after them, numbered from 1001 (M6). more: (key, at, text)."""
    w = Window.partitionBy(key).orderBy("at", "text")
    read = more.filter(F.trim("text") != "").select(key, (F.row_number().over(w) + first - 1).cast("long").alias("section"), "text")
    return sections.select(key, F.col("section").cast("long").alias("section"), "text").unionByName(read)


def recover(pairs: DataFrame) -> DataFrame:
    """(source, copybook, text, trusted, method) of (source, original, expanded) rows (C1-C4); each pair is one task's small work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, original, expanded in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += [(source, *f) for f in recovered_blocks(original or "", expanded or "")]
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["source", "copybook", "text", "trusted", "method"])

    return pairs.select("source", "original", "expanded").mapInArrow(run, "source string, copybook string, text string, trusted boolean, method string")


def choose(blocks: DataFrame) -> DataFrame:
    """One text per copybook (C5): the most frequent, then the longest; an untrusted one needs two that agree."""
    votes = blocks.groupBy("copybook", "text").agg(F.count(F.lit(1)).alias("n"), F.max("trusted").alias("trusted"), ordered_list("source").alias("sources"))
    w = Window.partitionBy("copybook").orderBy(F.desc("trusted"), F.desc("n"), F.desc(F.length("text")), "text")
    return votes.filter("trusted or n >= 2").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def check_choices(picked: DataFrame, listed: DataFrame, held: DataFrame) -> DataFrame:
    """(program, copybook, verdict) of chosen copybooks against what compiler listings say.

    picked: (program, copybook, dataset, sha); listed: (program, copybook, dataset, sha); held: (copybook, dataset, sha).
    """
    truth = listed.select("program", "copybook", F.col("dataset").alias("l_dataset"), F.col("sha").alias("l_sha"))
    there = held.select("copybook", F.col("dataset").alias("l_dataset"), F.col("sha").alias("h_sha"))
    both = picked.join(truth, ["program", "copybook"], "left").join(there, ["copybook", "l_dataset"], "left")
    rank = {v: n for n, v in enumerate(VERDICTS)}
    verdict = (
        F.when(F.col("l_dataset").isNull(), rank["UNKNOWN"])
        .when(F.col("h_sha").isNull(), rank["NOT HELD"])
        .when((F.col("dataset") == F.col("l_dataset")) & (F.col("sha") == F.col("l_sha")), rank["CONFIRMED"])
        .when(F.col("dataset") == F.col("l_dataset"), rank["OLDER"])
        .otherwise(rank["CONTRADICTED"])
    )
    worst = both.groupBy("program", "copybook").agg(F.min(verdict).alias("v"))
    return worst.select("program", "copybook", F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.col("v") + 1).alias("verdict"))


def match_names(missing: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file, how): missing names found on disk, exactly, as a prefix either way, or close (C11); at most three close ones.

    Prefixes are joined on their first four characters, close names in blocks of length and first or last character.
    """
    m = missing.select("name").distinct()
    f = files.select("file", F.upper(F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)).alias("stem"))
    exact = m.join(f, m["name"] == f["stem"]).select("name", "file", F.lit("exact").alias("how"))
    rest = m.join(exact, "name", "left_anti")
    head = lambda c: F.substring(c, 1, 4)
    both = rest.withColumn("h", head("name")).join(f.withColumn("h", head("stem")), "h")
    prefix = both.filter((F.length("name") >= 4) & (F.col("name").startswith(F.col("stem")) | F.col("stem").startswith(F.col("name")))).filter(F.length("stem") >= 4).select("name", "file", F.lit("prefix").alias("how"))
    rest = rest.join(prefix, "name", "left_anti")
    ends = lambda c: F.array(F.concat(F.lit("f"), F.substring(c, 1, 1)), F.concat(F.lit("l"), F.substring(c, -1, 1)))
    left = rest.select("name", F.explode(ends("name")).alias("c")).select("name", "c", F.explode(F.array(*[F.length("name") + d for d in (-1, 0, 1)])).alias("n"))
    right = f.select("file", "stem", F.explode(ends("stem")).alias("c"), F.length("stem").alias("n"))
    near = left.join(right, ["c", "n"]).select("name", "file", "stem").distinct().withColumn("d", F.levenshtein("name", "stem")).filter("d <= 2")
    w = Window.partitionBy("name").orderBy("d", "file")
    close = near.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").select("name", "file", F.lit("close").alias("how"))
    return exact.unionByName(prefix).unionByName(close)


def fetch_list(needed: DataFrame, held: DataFrame) -> DataFrame:
    """Per library data set the copybooks to fetch and the programs that need them (C12). needed: (dataset, copybook, program)."""
    open_ = needed.join(held.select("dataset", "copybook"), ["dataset", "copybook"], "left_anti")
    return open_.groupBy("dataset").agg(ordered_list("copybook").alias("copybooks"), ordered_list("program").alias("programs"), F.countDistinct("copybook").alias("n"))


_LOOK_ALIKE = ("O0", "I1", "l1", "S5", "B8", "Z2")


def fold_glyphs(c: str) -> Column:
    """Look-alike characters folded, before names are snapped (C14)."""
    return F.translate(F.upper(c), "".join(p[0].upper() for p in _LOOK_ALIKE if p[0].isupper()), "".join(p[1] for p in _LOOK_ALIKE if p[0].isupper()))


def tidy(c: str) -> Column:
    """Dots spaced out between capitals or digits joined again (C17)."""
    return F.regexp_replace(c, r"(?<=[A-Z0-9])\s*\.\s+(?=[A-Z0-9])|(?<=[A-Z0-9])\s+\.\s*(?=[A-Z0-9])", ".")


def clean_lines(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(line_id, text): tokens of screen lines kept when known or plain, junk marked; lines mostly junk go.

    lines: (line_id, text); vocabulary: (word). Tokens are joined with the vocabulary once, on the token.
    """
    t = lines.select("line_id", F.posexplode(F.split("text", r"\s+")).alias("at", "token")).filter("token <> ''")
    known = t.join(vocabulary.select(F.col("word").alias("token"), F.lit(True).alias("known")).distinct(), "token", "left")
    junk = ~F.coalesce("known", F.lit(False)) & ~F.col("token").rlike(r"^[A-Za-z]{3,}[,.:;]?$|^[0-9]+[,.]?$")
    shown = F.when(junk, F.lit("?")).otherwise(F.col("token"))
    rows = known.groupBy("line_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_if(junk).alias("junk"), F.count_if(F.coalesce("known", F.lit(False))).alias("names"), F.sort_array(F.collect_list(F.struct("at", shown.alias("s")))).alias("r"))
    kept = rows.filter("junk * 2 < pieces and (names > 0 or pieces >= 2)")
    return kept.select("line_id", F.array_join(F.transform("r", lambda x: x["s"]), " ").alias("text"))
