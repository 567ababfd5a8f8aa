"""Facts of a source estate as tables, and the questions asked of them (Q1-Q37).

``build`` parses every member once, on the executors, into typed facts: one folder per fact, in which the fact's columns
stand in slots by their types, so that a question reads the columns it names and filters reach the files. Every question
is joins over these. What could not be resolved stays beside each answer in the ``unresolved`` facts.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators import graph, interval, recovery, relational, text
from quernstone.session import cut
from quernstone.sources.members import apply_manifest, scan

#: Columns of each fact table, besides member_id and name (the member's).
FACTS = {
    "program": "program_id string, line int, linkage array<string>",
    "paragraph": "name string, kind string, ordinal int, start_line int, end_line int",
    "perform_edge": "from_para string, to_para string, thru_para string, kind string, line int",
    "call_edge": "kind string, target string, via_var string, resolved array<string>, resolution string, using_args array<string>, line int, para string",
    "call_arg": "target string, pos int, arg string, line int",
    "dli_call": "func string, func_var string, pcb string, area string, ssas array<string>, line int",
    "mq_call": "verb string, args array<string>, queue string, area string, line int",
    "cics_op": "verb string, kind string, resource string, via_var string, area string, direction string, line int",
    "copy_use": "copybook string, library string, line int, resolved boolean",
    "field": "ordinal int, path string, fd string, value string, root string, parent string, level int, name string, pic string, usage string, occurs int, odo_on string, redefines string, offset int, length int, extent int, is_group boolean, section string, line int",
    "cond88": "field string, name string, lo string, hi string, line int",
    "field_ref": "name string, of string, mode string, stmt string, line int",
    "data_flow": "verb string, src string, src_of string, src_lit string, src_sub string, dst string, dst_of string, dst_sub string, line int, guard string",
    "literal_ref": "literal string, context string, field string, line int",
    "file_decl": "select string, assign_dd string, line int",
    "io_op": "verb string, target string, dd string, kind string, line int",
    "sql_stmt": "verb string, tables array<string>, cursor string, is_dynamic boolean, line int",
    "sql_col_ref": "tbl string, base_tbl string, col string, host_var string, mode string, line int",
    "job": "job string, line int",
    "proc_def": "proc string, line int, symbolics map<string,string>",
    "proc_call": "job string, proc string, step string, line int",
    "step": "job string, step string, pgm string, effective string, how string, from_proc string, psb string, line int, ordinal int, guard string",
    "job_library": "job string, position int, library string, line int",
    "card_member": "job string, step string, dd string, member_name string, line int",
    "idcams_op": "job string, step string, op string, dsn string, line int",
    "dataset_copy": "job string, step string, source string, from_dd boolean, target string, to_dd boolean, line int",
    "dataset_attribute": "job string, step string, dsn string, kind string, average int, largest int, key_length int, key_offset int, generations int, line int",
    "db2_utility": "job string, step string, op string, tbl string, dd string, line int",
    "report_field": "job string, step string, file string, name string, pos int, length int, kind string, line int",
    "card_parameter": "job string, step string, name string, value string, line int",
    "dd": "job string, step string, dd string, concat int, dsn string, gdg string, disp string, mode string, mode_source string, temp boolean, line int",
    "card_field": "job string, step string, card string, pos int, length int, fmt string, line int",
    "screen": "map string, size string, line int",
    "screen_field": "map string, name string, row int, col int, length int, initial string, line int",
    "screen_symbol": "map string, name string, symbol string, line int",
    "ims_dbd": "dbd string, access string, line int",
    "ims_segment": "dbd string, segment string, parent string, bytes int, line int",
    "ims_field": "dbd string, segment string, field string, is_seq boolean, start int, bytes int, line int",
    "ims_pcb": "psb string, position int, type string, dbd string, procopt string, line int, senseg array<string>",
    "transaction_def": "code string, program string, psb string, line int",
    "cics_file": "file string, dsn string, line int",
    "unresolved": "kind string, detail string, line int",
}


#: Kinds of members that are parsed together, and the first and last fact that they alone give.
GROUPS = {
    "code": (("program", "copybook"), "program", "sql_col_ref"),
    "jobs": (("jcl", "proc", "include"), "job", "card_field"),
    "definitions": (("bms", "mfs", "dbd", "psb", "csd", "stage1"), "screen", "cics_file"),
}
_OWNER = ["member_id", "member", "system", "fact"]
#: Slots of a stored row by their type: letter and Arrow type. A fact's columns take the slots of their types in order.
_TYPES = {"string": ("s", pa.string()), "int": ("i", pa.int32()), "boolean": ("b", pa.bool_()), "array<string>": ("a", pa.list_(pa.string())), "map<string,string>": ("m", pa.map_(pa.string(), pa.string()))}
#: Fact rows that a worker holds before it hands them on.
ROWS = 20_000


@functools.lru_cache(maxsize=1)
def _slots() -> dict[str, dict[str, str]]:
    """The slot of each column of each fact."""
    out: dict[str, dict[str, str]] = {}
    for fact, columns in FACTS.items():
        taken: Counter[str] = Counter()
        own = out[fact] = {}
        for column in columns.split(", "):
            name, kind = column.split(" ")
            letter = _TYPES[kind][0]
            own[name] = f"{letter}{taken[letter]}"
            taken[letter] += 1
    return out


@functools.lru_cache(maxsize=1)
def _slot_types() -> dict[str, str]:
    """All slots with their types, those of one type together."""
    used = {slot for own in _slots().values() for slot in own.values()}
    return {slot: kind for kind, (letter, _) in _TYPES.items() for slot in sorted((x for x in used if x[0] == letter), key=lambda x: int(x[1:]))}


def fact_row() -> str:
    """Columns of a stored row: its owner, its fact, and the slots, which are few, as most facts have no column of most types."""
    return ", ".join([*(f"{c} {'bigint' if c == 'member_id' else 'string'}" for c in _OWNER), *(f"{slot} {kind}" for slot, kind in _slot_types().items())])


def facts_of(kind: str, source: str, parts: list[dict]) -> dict[str, list[dict]]:
    """All facts of one member, by table name."""
    from quernstone.functions import cobol, jcl, layout, screens

    macro = {"bms": screens.parse_bms, "mfs": screens.parse_mfs, "dbd": screens.parse_dbd, "psb": screens.parse_psb, "csd": screens.parse_csd, "stage1": screens.parse_stage1}
    known = {p["name"]: p["text"] for p in parts or []}
    if kind == "program":
        return cobol.parse_program(source, known)
    if kind == "copybook":
        entries = [e for at, s in cobol.sentences(cobol.logical_lines(source)) if (e := layout.parse_entry(s, at))]
        roots, warnings = layout.build_trees(entries)
        out = cobol.defaultdict(list)
        cobol._fields(out, roots, warnings)
        return dict(out) | {"copy_use": [{"copybook": n, "library": lib, "line": at, "resolved": n in known} for n, lib, at in cobol.copy_names(source)]}
    if kind in ("jcl", "proc"):
        return jcl.parse_jcl(source, known)
    return macro[kind](source) if kind in macro else {}


def _packed(fact: str, owners: list[tuple], rows: list[dict]) -> pa.RecordBatch:
    """Rows of one fact in their slots."""
    n = len(rows)
    head = [pa.array([o[k] for o in owners], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
    column = {slot: name for name, slot in _slots()[fact].items()}
    values = []
    for slot, kind in _slot_types().items():
        if slot not in column:
            values.append(pa.nulls(n, _TYPES[kind][1]))
        else:
            own = [r.get(column[slot]) for r in rows]
            values.append(pa.array([x and list(x.items()) for x in own] if slot[0] == "m" else own, _TYPES[kind][1]))
    return pa.RecordBatch.from_arrays([*head, pa.array([fact] * n, pa.string()), *values], [*_OWNER, *_slot_types()])


def _parser():
    """(member_id, member, system, kind, text, parts) -> fact rows; a member that fails leaves one unresolved row.

    Rows are handed on as soon as there are ``ROWS``, so a worker holds the facts of a few members, not of its whole batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: dict[str, list[tuple]] = {}
        rows: dict[str, list[dict]] = {}
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for member_id, member, system, kind, source, parts in zip(*(part.column(k).to_pylist() for k in range(6))):
                    try:
                        facts = facts_of(kind, source, parts)
                    except Exception as error:  # one bad member must not end the build
                        facts = {"unresolved": [{"kind": "parse_error", "detail": f"{type(error).__name__}: {error}", "line": 0}]}
                    for fact, own in facts.items():
                        if fact in FACTS and own:
                            owners.setdefault(fact, []).extend([(member_id, member, system)] * len(own))
                            rows.setdefault(fact, []).extend(own)
                            held += len(own)
                    if held >= ROWS:
                        yield from (_packed(fact, owners[fact], own) for fact, own in rows.items())
                        owners, rows, held = {}, {}, 0
        yield from (_packed(fact, owners[fact], own) for fact, own in rows.items())

    return run


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member_id, kind, text) -> (member_id, part): names of copybooks, procedures, includes and control members that a member calls for."""
    from quernstone.functions.cobol import copy_names
    from quernstone.functions.jcl import part_names

    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch, rows = whole.slice(at, 256), []
            for member, kind, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                names = {n for n, _, _ in copy_names(source)} if kind in ("program", "copybook") else part_names(source)
                rows += [(member, n) for n in sorted(names)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["member_id", "part"])


PARTS = ("copybook", "proc", "include", "ctlcard")
USERS = ("program", "copybook", "jcl", "proc", "include")


def parts_of(members: DataFrame, kinds: tuple[str, ...] = USERS, tasks: int | None = None, limit: int = 100) -> DataFrame:
    """(member_id, parts array<(name, text)>, ambiguous): the copybooks, procedures and cards each member of these kinds needs, all levels.

    Level by level by joins, so no text is broadcast. Of several parts of one name one is chosen by precedence: the
    first by path of the same system, else the first of an authoritative library, else the first of all (E8); all are
    aggregates with one row per name, so a name that every system holds does not multiply. A recursion ends because a
    name is taken once per member; more than ``limit`` levels raise.
    """
    kinds = tuple(k for k in kinds if k in USERS)
    usable = members.filter(F.col("kind").isin(*kinds, *PARTS) & F.col("kind").isin(*USERS))
    uses = cut(usable.select("member_id", "kind", "text").mapInArrow(_uses, "member_id bigint, part string"))
    library = members.filter(F.col("kind").isin(*PARTS)).select(F.col("name").alias("part"), "system", "path", "member_id", "norm_sha", (~F.col("authoritative")).alias("later"))
    own = library.groupBy("part", "system").agg(F.min(F.struct("path", "member_id")).alias("own"))
    any_ = library.groupBy("part").agg(F.min(F.struct("later", "path", "member_id")).alias("any"), (F.min("norm_sha") != F.max("norm_sha")).alias("ambiguous"))

    def resolved(need: DataFrame) -> DataFrame:
        both = need.join(any_, "part").join(own, ["part", "system"], "left")
        return both.select("member_id", "system", "part", F.coalesce("own.member_id", "any.member_id").alias("part_id"), "ambiguous")

    inner = uses.join(members.filter(F.col("kind").isin(*PARTS)).select("member_id"), "member_id", "left_semi").select(F.col("member_id").alias("part_id"), F.col("part").alias("next"))
    frontier = cut(resolved(members.filter(F.col("kind").isin(*kinds)).select("member_id", "system").join(uses, "member_id")))
    seen = frontier
    for _ in range(limit):
        below = frontier.join(inner, "part_id").select("member_id", "system", F.col("next").alias("part")).distinct()
        frontier = cut(resolved(below.join(seen.select("member_id", "part"), ["member_id", "part"], "left_anti")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        raise RuntimeError(f"parts nest more than {limit} levels deep")
    texts = members.filter(F.col("kind").isin(*PARTS)).select(F.col("member_id").alias("part_id"), F.col("text").alias("part_text"))
    chosen = seen.join(texts, "part_id")
    if tasks:
        chosen = chosen.repartition(tasks, "member_id")
    return chosen.groupBy("member_id").agg(F.collect_list(F.struct(F.col("part").alias("name"), F.col("part_text").alias("text"))).alias("parts"), F.max("ambiguous").alias("ambiguous"))


def _parsed(members: DataFrame) -> DataFrame:
    return members.select("member_id", F.col("name").alias("member"), "system", "kind", "text", "parts").mapInArrow(_parser(), fact_row())


#: Bytes of source that one task parses: its facts are sorted before they are written, so this bounds their memory.
TASK_BYTES = 8_000_000


def parse(members: DataFrame, group: str | None = None) -> DataFrame:
    """Facts of all members, or of a group of kinds alone."""
    kinds = GROUPS[group][0] if group else USERS
    own = members.filter(F.col("kind").isin(*kinds)) if group else members
    size = own.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), min(members.sparkSession.sparkContext.defaultParallelism, size // 65_536))
    own = own.repartition(tasks, "member_id")
    return _parsed(own.join(parts_of(members, kinds, tasks), "member_id", "left") if set(kinds) & set(USERS) else own.withColumn("parts", F.lit(None).cast("array<struct<name:string,text:string>>")))


def build(spark: SparkSession, root: str, out: str, manifest: dict | None = None) -> Estate:
    """Scan, parse and store: ``out/members`` and ``out/facts`` (one folder per fact)."""
    members = scan(spark, root)
    return store(apply_manifest(members, manifest, root) if manifest else members, out)


def _write_facts(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").partitionBy("fact").parquet(folder)


def store(members: DataFrame, out: str, on_demand: bool = False) -> Estate:
    """All members, and their facts; on demand, a group of kinds is parsed when a question first reads a fact of it."""
    spark = members.sparkSession
    members.write.mode("overwrite").parquet(f"{out}/members")
    if not on_demand:
        _write_facts(parse(spark.read.parquet(f"{out}/members")), f"{out}/facts")
    return Estate(spark, out, on_demand)


def refresh(spark: SparkSession, root: str, old: str, new: str) -> Estate:
    """A new version from an old one: members of unchanged content keep their facts, unless they use a changed part."""
    scan(spark, root).write.mode("overwrite").parquet(f"{new}/members")
    now, was = spark.read.parquet(f"{new}/members"), spark.read.parquet(f"{old}/members").select("member_id", F.col("sha256").alias("old_sha"))
    joined = now.select("member_id", "name", "sha256").join(was, "member_id", "full_outer")
    changed = joined.filter(~F.col("sha256").eqNullSafe(F.col("old_sha"))).select("member_id")
    gone_names = spark.read.parquet(f"{old}/members").select("member_id", "name").join(changed, "member_id", "left_semi").select("name")
    names = now.join(changed, "member_id", "left_semi").select("name").union(gone_names).distinct()
    parts = cut(parts_of(now))
    users = parts.select("member_id", F.explode("parts.name").alias("name"))
    missing = Estate(spark, old).fact("unresolved").filter(F.col("kind").isin("missing_copybook", "missing_proc", "missing_include", "missing_control_member")).select("member_id", F.col("detail").alias("name"))
    forced = users.unionByName(missing).join(names, "name", "left_semi").select("member_id")
    stale = cut(changed.union(forced).distinct())
    kept = spark.read.schema(fact_row()).parquet(f"{old}/facts").join(now.select("member_id"), "member_id", "left_semi").join(stale, "member_id", "left_anti")
    fresh = _parsed(now.join(stale, "member_id", "left_semi").join(parts, "member_id", "left"))
    _write_facts(kept.unionByName(fresh), f"{new}/facts")
    return Estate(spark, new)


class Estate:
    """Reader of one stored version, with one method per question."""

    def __init__(self, spark: SparkSession, path: str, on_demand: bool = False) -> None:
        self.spark, self.path, self.on_demand = spark, path, on_demand
        self._tables: dict[str, DataFrame] = {}

    @functools.cached_property
    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/members")

    def _facts(self, group: str | None) -> DataFrame:
        """All facts, or those of a group that is parsed on demand; their files are listed once for all questions."""
        key = f"facts {group}"
        if key not in self._tables:
            folder = f"{self.path}/facts-{group}" if group else f"{self.path}/facts"
            if group:
                _write_facts(parse(self.members, group), folder)
            self._tables[key] = self.spark.read.schema(fact_row()).parquet(folder)
        return self._tables[key]

    def fact(self, name: str) -> DataFrame:
        """One fact table: member_id, member (name), system, and its columns; only the columns used are read."""
        order = list(FACTS)
        groups = [g for g, (_, first, last) in GROUPS.items() if name == "unresolved" or order.index(first) <= order.index(name) <= order.index(last)] if self.on_demand else [None]
        rows = functools.reduce(DataFrame.unionByName, (self._facts(g) for g in groups))
        named = {c: c for c in _OWNER[:3]} | _slots()[name]  # aliases, so that two facts never share a column
        return rows.filter(F.col("fact") == name).select(*[F.col(slot).alias(c) for c, slot in named.items()])

    # -- programs ----------------------------------------------------------------------------------------------------

    def calls(self) -> DataFrame:
        """(caller, callee, kind, line): every call with each of its candidates."""
        programs = self.fact("program").select("member_id", F.col("program_id").alias("caller"))
        edges = self.fact("call_edge").select("member_id", "kind", "line", F.explode_outer("resolved").alias("callee"))
        return edges.join(programs, "member_id").select("caller", "callee", "kind", "line")

    def callers(self, name: str, depth: int = 2) -> DataFrame:
        edges = self.calls().filter("callee is not null").select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
        return graph.bounded_reach(edges, self._one(name), depth)

    def callees(self, name: str, depth: int = 2) -> DataFrame:
        """With ``held``: whether the estate has the program."""
        edges = self.calls().filter("callee is not null").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
        reach = graph.bounded_reach(edges, self._one(name), depth)
        held = self.fact("program").select(F.col("program_id").alias("node"), F.lit(True).alias("held")).distinct()
        return reach.join(held, "node", "left").withColumn("held", F.coalesce("held", F.lit(False)))

    def _one(self, name: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(name.upper()).alias("node"))

    def program(self, name: str) -> dict[str, DataFrame]:
        """The dossier of a program (Q1)."""
        name = name.upper()
        own = self.fact("program").filter(F.col("program_id") == name).select("member_id")
        of = lambda fact: self.fact(fact).join(own, "member_id", "left_semi")
        return {
            "runs_in": self._as_run("step").filter(F.col("effective") == name).select("job", "step", "how", "from_proc", "line"),
            "calls": of("call_edge").select("kind", "target", "via_var", "resolved", "resolution", "line"),
            "callers": self.calls().filter(F.col("callee") == name).select("caller", "kind", "line"),
            "copybooks": of("copy_use").select("copybook", "resolved", "line"),
            "files": self.dataset_flow().filter(F.col("program_id") == name),
            "tables": of("sql_stmt").select("verb", F.explode("tables").alias("tbl")).groupBy("tbl").agg(relational.ordered_list("verb").alias("verbs")),
            "paragraphs": self.reachability(name),
            "literals": of("literal_ref").groupBy("literal", "context").count().orderBy(F.desc("count"), "literal").limit(15),
            "unresolved": of("unresolved").select("kind", "detail", "line"),
        }

    def reachability(self, program: str) -> DataFrame:
        """Paragraphs of a program with their distance from its first; null where nothing leads.

        A PERFORM THRU reaches every paragraph of its range, by a range join on the ordinal.
        """
        own = self.fact("program").filter(F.col("program_id") == program.upper()).select("member_id")
        paras = self.fact("paragraph").join(own, "member_id", "left_semi").select("member_id", "name", "kind", "ordinal", "start_line", "end_line")
        edges = self.fact("perform_edge").join(own, "member_id", "left_semi")
        first = paras.select("member_id", F.col("name").alias("to_para"), F.col("ordinal").alias("lo"))
        last = paras.select("member_id", F.col("name").alias("thru_para"), F.col("ordinal").alias("up_to"))
        spans = edges.join(first, ["member_id", "to_para"]).join(last, ["member_id", "thru_para"], "left").withColumn("hi", F.coalesce("up_to", "lo") + 1)
        steps = interval.point_join(paras.select("member_id", F.col("name").alias("dst"), "ordinal"), spans.select("member_id", F.col("from_para").alias("src"), "lo", "hi"), ["member_id"], "ordinal", "lo", "hi", 64)
        roots = paras.filter("ordinal = 0").select(F.col("name").alias("node"))
        reach = graph.closure(steps.select("src", "dst"), roots)
        return paras.join(reach, paras["name"] == reach["node"], "left").select("name", "kind", "ordinal", "start_line", "end_line", "depth")

    def walk(self, program: str | None = None) -> DataFrame:
        """(program_id, place, name, how, depth): paragraphs in reading order, place null where nothing leads (G2, W10); of one program or all."""
        own = self.fact("program").select("member_id", "program_id")
        if program:
            own = own.filter(F.col("program_id") == program.upper())
        paras = self.fact("paragraph").select("member_id", "name", "ordinal").join(own, "member_id")
        edges = self.fact("perform_edge").select("member_id", "from_para", "to_para", "thru_para", "kind", "line").join(own.select("member_id"), "member_id", "left_semi")

        def order(p, e):
            import pandas as pd

            from quernstone.functions.walk import reading_order

            p = p.sort_values("ordinal")
            found, never = reading_order(p["name"].tolist(), list(e[["from_para", "to_para", "thru_para", "kind", "line"]].itertuples(index=False, name=None)))
            program_id = p["program_id"].iloc[0] if len(p) else None
            rows = [(program_id, *r) for r in found] + [(program_id, None, n, "never", None) for n in never]
            return pd.DataFrame(rows, columns=["program_id", "place", "name", "how", "depth"]).astype({"place": "Int32", "depth": "Int32"})

        read = paras.groupBy("member_id").cogroup(edges.groupBy("member_id")).applyInPandas(order, "program_id string, place int, name string, how string, depth int")
        return read.filter("place is not null") if program else read

    def data_used(self) -> DataFrame:
        """(program_id, root, used, total): items that the code names, of all items of each 01."""
        programs = self.fact("program").select("member_id", "program_id")
        refs = self.fact("field_ref").join(programs, "member_id").select("program_id", "name", "of").distinct()
        items = self._kept("items", self.items)
        pattern = F.concat(F.lit("(^|/)"), F.array_join(F.reverse(F.split("of", "/")), "(/.*)?/"), F.lit("(/.*)?/"), "name", F.lit("$"))
        named = items.join(refs, ["program_id", "name"]).filter((F.col("of") == "") | F.rlike("path", pattern)).select("program_id", "path").distinct()
        flagged = items.join(named.withColumn("hit", F.lit(1)), ["program_id", "path"], "left")
        return flagged.groupBy("program_id", "root").agg(F.count("hit").alias("used"), F.count(F.lit(1)).alias("total"))

    def version_items(self, old: str, new: str) -> DataFrame:
        """(name, level, item, change, delta): items of every member that two groups of systems hold, as :meth:`diff` has them for two members."""
        m = self.members.select("name", "kind", "system")
        held = m.filter(F.col("system").startswith(old)).select("name", "kind").distinct().join(m.filter(F.col("system").startswith(new)).select("name", "kind").distinct(), ["name", "kind"]).select(F.col("name").alias("member")).distinct()

        def side(prefix: str, label: str) -> DataFrame:
            rows = self.fact("field").filter(F.col("system").startswith(prefix)).join(held, "member", "left_semi")
            return rows.select("member", "level", F.col("name").alias("item"), F.struct("pic", "length").alias(f"{label}_shape"), F.col("offset").alias(f"{label}_at"))

        both = side(old, "old").join(side(new, "new"), ["member", "level", "item"], "full_outer")
        return both.select(F.col("member").alias("name"), "level", "item", self._change().alias("change"), (F.col("new_at") - F.col("old_at")).alias("delta"))

    @staticmethod
    def _change() -> Column:
        return (
            F.when(F.col("old_shape").isNull(), "added").when(F.col("new_shape").isNull(), "removed").when(F.col("old_shape") != F.col("new_shape"), "changed")
            .when(F.col("old_at") != F.col("new_at"), "shifted").otherwise("same")
        )

    def paragraph(self, program: str, name: str) -> dict[str, DataFrame]:
        """Who leads to a paragraph, and what it does (Q-paragraph, G3)."""
        own = self.fact("program").filter(F.col("program_id") == program.upper()).select("member_id")
        span = self.fact("paragraph").join(own, "member_id", "left_semi").filter(F.col("name") == name.upper()).select("member_id", F.col("start_line").alias("lo"), (F.col("end_line") + 1).alias("hi"))
        inside = lambda fact: interval.point_join(self.fact(fact), span, ["member_id"], "line", "lo", "hi", 512).drop("lo", "hi")
        reached = self.fact("perform_edge").join(own, "member_id", "left_semi").filter((F.col("to_para") == name.upper()) | (F.col("thru_para") == name.upper()))
        return {"reached_by": reached.select("from_para", "kind", "line"), **{f: inside(f) for f in ("call_edge", "io_op", "data_flow", "sql_stmt", "perform_edge")}}

    # -- data sets ---------------------------------------------------------------------------------------------------

    def _as_run(self, fact: str) -> DataFrame:
        """Steps or data sets as they run: a bare procedure's own only where no job expands it (runs-in rule)."""
        rows = self.fact(fact)
        expanded = self.fact("proc_call").filter("job <> ''").select(F.col("proc").alias("member")).distinct()
        return rows.filter("job <> ''").unionByName(rows.filter("job = ''").join(expanded, "member", "left_anti").select(rows.columns))

    def dataset_flow(self) -> DataFrame:
        """(program_id, dd, dsn, mode, mode_source, job, step): a step's data sets with the program's own open modes first (M1)."""
        programs = self.fact("program").select("member_id", "program_id")
        opens = self.fact("io_op").filter(F.col("verb").startswith("OPEN")).join(programs, "member_id")
        reads, writes = F.max(F.col("verb").isin("OPEN INPUT", "OPEN I-O")), F.max(F.col("verb").isin("OPEN OUTPUT", "OPEN EXTEND", "OPEN I-O"))
        modes = opens.groupBy("program_id", "dd").agg(F.when(reads & writes, "both").when(reads, "input").when(writes, "output").alias("open_mode"))
        steps = self._as_run("step").select("member_id", "job", "step", F.col("effective").alias("program_id"), "how", "from_proc")
        dds = self._as_run("dd").select("member_id", "job", "step", "dd", "concat", "dsn", "gdg", "mode", "mode_source", "temp", "line")
        flow = dds.join(steps, ["member_id", "job", "step"]).join(modes, ["program_id", "dd"], "left")
        return flow.filter("dsn <> ''").select(
            "program_id", "dd", "dsn", "gdg", F.coalesce("open_mode", "mode").alias("mode"), F.when(F.col("open_mode").isNotNull(), "open_verb").otherwise(F.col("mode_source")).alias("mode_source"), "job", "step", "how", "temp", "line"
        )

    def dataset(self, dsn: str) -> DataFrame:
        return self.dataset_flow().filter(F.col("dsn") == dsn.upper())

    def job(self, name: str) -> dict[str, DataFrame]:
        """Steps of a job in order with what they run, their data sets and card fields (Q2)."""
        mine = F.col("job") == name.upper()
        return {"steps": self.fact("step").filter(mine).orderBy("ordinal"), "data_sets": self.fact("dd").filter(mine).orderBy("line", "concat"), "cards": self.fact("card_field").filter(mine), "procs": self.fact("proc_call").filter(mine)}

    # -- fields, values, columns -------------------------------------------------------------------------------------

    def layout(self, member: str) -> DataFrame:
        """Items of a member in order, with offsets and lengths (Q17)."""
        return self.fact("field").filter(F.col("member") == member.upper()).orderBy("ordinal")

    def field(self, name: str) -> dict[str, DataFrame]:
        """Definitions, references and 88s of a name; definitions differ when offsets or lengths do (Q3)."""
        n = name.upper()
        defs = self.fact("field").filter(F.col("name") == n)
        return {
            "definitions": defs.select("member", "root", "level", "pic", "usage", "offset", "length", "line"),
            "skew": defs.groupBy("name").agg(F.countDistinct("offset", "length").alias("layouts"), F.countDistinct("member_id").alias("members")).filter("layouts > 1"),
            "references": self.fact("field_ref").filter(F.col("name") == n).groupBy("member", "mode", "stmt").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line")),
            "conditions": self.fact("cond88").filter(F.col("field") == n).select("member", "name", "lo", "hi"),
            "columns": self.fact("sql_col_ref").filter(F.col("host_var") == n).select("member", "tbl", "col", "mode", "line"),
        }

    def values(self, name: str) -> DataFrame:
        """Observed values of a field against those its 88s document (Q6, P5)."""
        n = name.upper()
        norm = lambda c: F.when(F.col(c).rlike(r"^[+-]?\d{1,38}$"), F.col(c).cast("decimal(38,0)").cast("string")).otherwise(F.col(c))
        known = self.fact("cond88").filter(F.col("field") == n).select(norm("lo").alias("value"), F.col("name").alias("cond"), norm("hi").alias("hi"))
        documented = known.groupBy("value").agg(relational.ordered_list("cond").alias("conditions"), F.max("hi").alias("hi"))
        used = self.fact("literal_ref").filter((F.col("field") == n) & (F.col("context") != "value")).select(norm("literal").alias("value"), "context", "member")
        counts = used.groupBy("value").agg(F.count_if(F.col("context") == "move_to").alias("n_set"), F.count_if(F.col("context").isin("compare", "when")).alias("n_tested"), relational.ordered_list("member").alias("members"))
        status = F.when(F.col("conditions").isNull(), "undocumented").when(F.col("n_set").isNull(), "unused").otherwise("documented")
        return counts.join(documented, "value", "full_outer").withColumn("status", status)

    def literal(self, value: str, like: bool = False) -> DataFrame:
        """Places of a literal by context (Q5)."""
        test = F.col("literal").like(value) if like else F.col("literal") == value
        return self.fact("literal_ref").filter(test).groupBy("literal", "context", "field").agg(relational.ordered_list("member").alias("members"), F.count(F.lit(1)).alias("n"))

    def pair(self, a: str, b: str, window: int = 20) -> DataFrame:
        """References to two fields near each other in one program (Q8)."""
        refs = self.fact("field_ref").select("member_id", "member", "name", F.col("line").cast("long").alias("line"), "mode")
        x, y = (refs.filter(F.col("name") == n.upper()) for n in (a, b))
        return interval.band_join(x, y.drop("member"), ["member_id"], "line", window).select("member", "line", "mode", "r_line", "r_mode")

    def messages(self, pattern: str) -> DataFrame:
        return self.fact("literal_ref").filter(F.col("literal").like(pattern)).groupBy("literal").agg(relational.ordered_list("member").alias("members"), relational.ordered_list("context").alias("contexts"), F.count(F.lit(1)).alias("n"))

    def column(self, name: str) -> DataFrame:
        """Who reads, writes and tests a column, and through which host variable (Q12)."""
        return self.fact("sql_col_ref").filter(F.col("col") == name.upper()).select("member", "tbl", "col", "host_var", "mode", "line")

    def table(self, name: str) -> DataFrame:
        """Verbs per program on a table, matched on the last part of its name."""
        s = self.fact("sql_stmt").select("member", "verb", F.explode("tables").alias("tbl"), "line").withColumn("base", relational.base_name("tbl"))
        base = name.upper().split(".")[-1]
        return s.filter(F.col("base") == base).groupBy("member", "tbl").agg(relational.ordered_list("verb").alias("verbs"), F.min("line").alias("first_line"))

    _CRUD = {"C": ["OPEN OUTPUT", "OPEN EXTEND", "WRITE", "RELEASE", "INSERT", "MERGE"], "R": ["OPEN INPUT", "OPEN I-O", "READ", "START", "RETURN", "SELECT", "DECLARE", "FETCH", "STARTBR", "READNEXT", "READPREV"], "U": ["OPEN I-O", "REWRITE", "UPDATE", "MERGE"], "D": ["DELETE"]}

    def crud(self) -> DataFrame:
        """(program, resource, letters, first_line) in the order C R U D."""
        files = self.fact("io_op").select("member", F.when(F.col("dd") != "", F.concat(F.lit("DD "), "dd")).otherwise(F.col("target")).alias("resource"), "verb", "line")
        tables = self.fact("sql_stmt").select("member", F.explode("tables").alias("resource"), "verb", "line")
        ops = files.unionByName(tables)
        parts = [F.when(F.max(F.col("verb").isin(*verbs)), F.lit(letter)) for letter, verbs in self._CRUD.items()]
        return ops.groupBy("member", "resource").agg(F.concat_ws("", *parts).alias("letters"), F.min("line").alias("first_line")).filter("letters <> ''")

    def conditions(self, program: str) -> DataFrame:
        """Tests per paragraph (Q19): literals compared, by a point-in-range join of lines and paragraphs."""
        own = self.fact("program").filter(F.col("program_id") == program.upper()).select("member_id")
        tests = self.fact("literal_ref").join(own, "member_id", "left_semi").filter(F.col("context").isin("compare", "when"))
        paras = self.fact("paragraph").join(own, "member_id", "left_semi").select("member_id", F.col("name").alias("para"), F.col("start_line").alias("lo"), (F.col("end_line") + 1).alias("hi"))
        hit = interval.point_join(tests, paras, ["member_id"], "line", "lo", "hi", 512)
        return hit.groupBy("para", "field").agg(relational.ordered_list("literal").alias("literals"), F.count(F.lit(1)).alias("n"))

    # -- databases, screens, transactions ----------------------------------------------------------------------------

    def database(self, name: str) -> dict[str, DataFrame]:
        mine = F.col("dbd") == name.upper()
        return {k: self.fact(f).filter(mine) for k, f in (("segments", "ims_segment"), ("fields", "ims_field"), ("pcbs", "ims_pcb"))}

    def segment_offsets(self, segment: str, program: str, root: str) -> DataFrame:
        """A segment's fields at their bytes in a program's area, and how each fits."""
        seg = self.fact("ims_field").filter(F.col("segment") == segment.upper()).select(F.lit(1).alias("k"), F.col("field").alias("seg_field"), (F.col("start") - 1).cast("long").alias("lo"), (F.col("start") - 1 + F.col("bytes")).cast("long").alias("hi"))
        own = self.fact("program").filter(F.col("program_id") == program.upper()).select("member_id")
        items = self.fact("field").join(own, "member_id", "left_semi").filter((F.col("root") == root.upper()) & ~F.col("is_group") & (F.col("redefines") == "") & (F.col("extent") > 0))
        items = items.select(F.lit(1).alias("k"), F.col("name").alias("item"), F.col("offset").cast("long").alias("lo"), (F.col("offset") + F.col("extent")).cast("long").alias("hi"))
        hit = interval.overlap_join(seg, items, ["k"], "lo", "hi", 256)
        return hit.select("seg_field", F.col("r_item").alias("item"), interval.fit_class("lo", "hi", "r_lo", "r_hi").alias("fit"))

    def screen(self, name: str) -> DataFrame:
        """Fields of a map and who refers to them through their symbolic names (Q20)."""
        symbols = self.fact("screen_symbol").filter(F.col("map") == name.upper()).select("map", F.col("name").alias("screen_field"), "symbol")
        refs = self.fact("field_ref").select("member", F.col("name").alias("symbol"), "mode", "line")
        return symbols.join(refs, "symbol").select("map", "screen_field", "symbol", "member", "mode", "line")

    def transaction(self, code: str) -> DataFrame:
        return self.fact("transaction_def").filter((F.col("code") == code.upper()) | (F.col("program") == code.upper())).select("code", "program", "psb", "line")

    # -- impact, coverage, search ------------------------------------------------------------------------------------

    def copybook(self, name: str) -> dict[str, DataFrame]:
        """Who includes a copybook, the steps that run them, and the data sets these touch (Q11)."""
        users = self.fact("copy_use").filter(F.col("copybook") == name.upper()).select("member_id", "member").distinct()
        programs = self.fact("program").join(users.select("member_id"), "member_id", "left_semi").select("program_id").distinct()
        return {"users": users.select("member"), "steps": self._as_run("step").join(programs.select(F.col("program_id").alias("effective")), "effective", "left_semi"), "data_sets": self.dataset_flow().join(programs, "program_id", "left_semi"), "callers": self.calls().join(programs.select(F.col("program_id").alias("callee")), "callee", "left_semi")}

    def dead(self) -> dict[str, DataFrame]:
        """Programs nothing calls, runs or routes to; data sets written and never read, or read and never written; unused copybooks (Q23)."""
        programs = self.fact("program").select(F.col("program_id").alias("n")).distinct()
        used = self.calls().select(F.col("callee").alias("n")).union(self.fact("step").select("effective")).union(self.fact("transaction_def").select("program")).filter("n is not null")
        flow = self.dataset_flow().groupBy("dsn").agg(F.count_if(F.col("mode").isin("output", "both")).alias("writes"), F.count_if(F.col("mode").isin("input", "both")).alias("reads"))
        copies = self.members.filter("kind = 'copybook'").select("name")
        return {
            "programs": programs.join(used, "n", "left_anti").withColumnRenamed("n", "program_id"),
            "written_never_read": flow.filter("writes > 0 and reads = 0").select("dsn"),
            "read_never_written": flow.filter("reads > 0 and writes = 0").select("dsn"),
            "copybooks": copies.join(self.fact("copy_use").select(F.col("copybook").alias("name")), "name", "left_anti"),
        }

    def ambiguous(self) -> dict[str, DataFrame]:
        """Names held more than once with different contents, and names of several kinds (Q24)."""
        m = self.members
        return {
            "copies": m.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("norm_sha").alias("contents"), relational.ordered_list("library").alias("libraries")).filter("copies > 1"),
            "kinds": m.groupBy("name").agg(F.countDistinct("kind").alias("n_kinds"), relational.ordered_list("kind").alias("kinds")).filter("n_kinds > 1"),
        }

    def coverage(self) -> DataFrame:
        """What the index does not know (Q25)."""
        kinds = self.members.groupBy(F.lit("members").alias("what"), F.col("kind").alias("key")).count()
        open_ = self.fact("unresolved").groupBy(F.lit("unresolved").alias("what"), F.col("kind").alias("key")).count()
        calls = self.fact("call_edge").groupBy(F.lit("calls").alias("what"), F.col("resolution").alias("key")).count()
        modes = self.fact("dd").groupBy(F.lit("directions").alias("what"), F.col("mode_source").alias("key")).count()
        return kinds.union(open_).union(calls).union(modes).withColumnRenamed("count", "n")

    def search(self, phrase: str, kind: str | None = None) -> DataFrame:
        """(member, line_no, txt): lines that hold the phrase's words in order."""
        import re

        words = re.findall("[a-z0-9]+", phrase.lower())
        m = self.members.filter(F.col("kind") == kind) if kind else self.members
        lines = text.lines(m.select("member_id", "text"), "member_id").withColumn("at", F.struct("member_id", "line_no"))
        hits = text.phrase_hits(text.tokens(lines, "at", "txt"), "at", words).select("at").distinct()
        return lines.join(hits, "at", "left_semi").join(self.members.select("member_id", F.col("name").alias("member")), "member_id").select("member", "line_no", "txt")

    def cite(self, member: str, first: int, last: int) -> DataFrame:
        """Source lines first..last of a member (Q28)."""
        lines = text.lines(self.members.filter(F.col("name") == member.upper()).select("member_id", "text"), "member_id")
        return lines.filter(F.col("line_no").between(first, last)).orderBy("member_id", "line_no")

    def diff(self, old_member: int, new_member: int) -> DataFrame:
        """Items of two versions: added, removed, changed, or moved by how much."""
        side = lambda i, p: self.fact("field").filter(F.col("member_id") == i).select("level", "name", F.struct("pic", "length").alias(f"{p}_shape"), F.col("offset").alias(f"{p}_at"))
        both = side(old_member, "old").join(side(new_member, "new"), ["level", "name"], "full_outer")
        return both.select("level", "name", self._change().alias("change"), (F.col("new_at") - F.col("old_at")).alias("delta"))

    def interfaces(self) -> DataFrame:
        """Facts at the estate's border: transfers, online files, data sets that only one side touches (Q22)."""
        ftp = self.fact("step").filter("effective = 'FTP' or how = 'FTP'").select(F.lit("ftp").alias("kind"), F.col("job").alias("who"), F.col("step").alias("what"))
        online = self.fact("cics_file").select(F.lit("online_file").alias("kind"), F.col("file").alias("who"), F.col("dsn").alias("what"))
        entry = self.fact("transaction_def").select(F.lit("transaction").alias("kind"), F.col("code").alias("who"), F.col("program").alias("what"))
        systems = self.dataset_flow().join(self.fact("job").select("job", "system"), "job").groupBy("dsn").agg(relational.ordered_list("system").alias("who"), F.countDistinct("system").alias("n"))
        shared = systems.filter("n > 1").select(F.lit("shared_data_set").alias("kind"), "who", F.col("dsn").alias("what"))
        return ftp.unionByName(online).unionByName(entry).unionByName(shared)

    def releases(self, old: str, new: str) -> DataFrame:
        """Members of two systems by name and kind: added, removed, changed, same (Q32), by one full outer join."""
        side = lambda system, p: self.members.filter(F.col("system") == system).groupBy("name", "kind").agg(F.min("norm_sha").alias(f"{p}_sha"), F.min("member_id").alias(f"{p}_id"))
        both = side(old, "old").join(side(new, "new"), ["name", "kind"], "full_outer")
        change = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").when(F.col("old_sha") != F.col("new_sha"), "changed").otherwise("same")
        return both.select("name", "kind", change.alias("change"), "old_id", "new_id")

    def condition_names(self, name: str) -> DataFrame:
        """(value, hi, conditions): which condition names a value of a field has (Q7); numbers compare as numbers (P5)."""
        norm = lambda c: F.when(F.col(c).rlike(r"^[+-]?\d{1,38}$"), F.col(c).cast("decimal(38,0)").cast("string")).otherwise(F.col(c))
        own = self.fact("cond88").filter(F.col("field") == name.upper()).select(norm("lo").alias("value"), norm("hi").alias("hi"), "name")
        return own.groupBy("value", "hi").agg(relational.ordered_list("name").alias("conditions"))

    def message_texts(self) -> DataFrame:
        """(member, name, value, next_name, next_value): initial values with that of the next item under the same parent, as a code stands beside its text."""
        rows = self.fact("field").filter("not is_group and level > 1")
        beside = relational.next_sibling(relational.next_sibling(rows, ["member_id", "root", "parent"], ["ordinal"], "value", "next_value"), ["member_id", "root", "parent"], ["ordinal"], "name", "next_name")
        return beside.select("member", "root", "name", "value", "next_name", "next_value")

    def record_ends(self) -> DataFrame:
        """(member, root, line, next_line): where each 01 begins, and where the next does (W2); null after the last."""
        roots = self.fact("field").filter("level in (1, 77)").select("member_id", "member", F.col("name").alias("root"), "line", "ordinal")
        return relational.next_sibling(roots, ["member_id"], ["ordinal"], "line", "next_line").select("member", "root", "line", "next_line")

    def moves_by_line(self) -> DataFrame:
        """(program_id, line, src, dst): moves put together from lines that read one name and write one (G31), for facts without data flow."""
        programs = self.fact("program").select("member_id", "program_id")
        refs = self.fact("field_ref").filter("stmt = 'MOVE'").join(programs, "member_id")
        reads, writes = F.col("mode") == "read", F.col("mode") == "write"
        one = refs.groupBy("program_id", "line").agg(F.count_if(reads).alias("r"), F.count_if(writes).alias("w"), F.max(F.when(reads, F.col("name"))).alias("src"), F.max(F.when(writes, F.col("name"))).alias("dst"))
        return one.filter("r = 1 and w = 1").select("program_id", "line", "src", "dst")

    def changed_targets(self, changed: DataFrame) -> DataFrame:
        """(program_id, name): items set by statements that touch changed lines (G32). changed: (program_id, line).

        A statement reaches from its first line to the line before the next statement's, so a change in its middle counts.
        """
        programs = self.fact("program").select("member_id", "program_id")
        writes = self.fact("field_ref").filter("mode = 'write'").join(programs, "member_id").select("program_id", "name", "line")
        starts = None
        for fact in ("field_ref", "call_edge", "io_op", "sql_stmt", "perform_edge"):
            own = self.fact(fact).join(programs, "member_id").select("program_id", "line")
            starts = own if starts is None else starts.union(own)
        paras = self.fact("paragraph").join(programs, "member_id").select("program_id", F.col("start_line").alias("line"))
        w = Window.partitionBy("program_id").orderBy("line")
        spans = starts.union(paras).distinct().withColumn("hi", F.coalesce(F.lead("line").over(w), F.col("line") + 200)).select("program_id", F.col("line").alias("lo"), "hi")
        touched = interval.point_join(changed.select("program_id", F.col("line").alias("at")), spans, ["program_id"], "at", "lo", "hi", 64).select("program_id", F.col("lo").alias("line")).distinct()
        return writes.join(touched, ["program_id", "line"]).select("program_id", "name").distinct()

    def missing_parts(self) -> DataFrame:
        """(name, state, users): copybooks and procedures that nobody holds, that arrived since, or whose link is stale."""
        programs = self.fact("copy_use").select(F.col("member").alias("user"), F.col("copybook").alias("name"), "resolved")
        kinds = ("missing_proc", "missing_include", "missing_control_member")
        jobs = self.fact("unresolved").filter(F.col("kind").isin(*kinds)).select(F.col("member").alias("user"), F.col("detail").alias("name"), F.lit(False).alias("resolved"))
        return recovery.missing_parts(programs.unionByName(jobs), self.members.filter(F.col("kind").isin(*PARTS)).select("name"))

    def header(self) -> DataFrame:
        """(n_members, n_programs, n_unresolved): what this version holds (Q36)."""
        none = F.lit(0).cast("long")
        members = self.members.agg(F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("kind") == "program").alias("n_programs"), none.alias("n_unresolved"))
        open_ = self.fact("unresolved").agg(none.alias("n_members"), none.alias("n_programs"), F.count(F.lit(1)).alias("n_unresolved"))
        return members.unionByName(open_).agg(*[F.sum(c).alias(c) for c in members.columns])

    def _documents(self) -> DataFrame:
        return self.members.filter(F.col("kind").isin("document", "html")).select("member_id", F.col("name").alias("member"), "text")

    def document_list(self, pattern: str = "%") -> DataFrame:
        """(member, sections, chars): documents with their number of sections (Q34)."""
        docs = self._documents().filter(F.col("member").like(pattern.upper()))
        parts = text.chunks(docs.select("member_id", "text"), "member_id").groupBy("member_id").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("chunk")).alias("chars"))
        return docs.select("member_id", "member").join(parts, "member_id").select("member", "sections", "chars")

    def document_sections(self, name: str, spec: str = "", grep: str = "", budget: int = 0) -> DataFrame:
        """(part, chunk): sections of a document by number (``2,7,9-12``) or by a text they hold, within a budget of characters."""
        docs = self._documents().filter(F.col("member") == name.upper())
        parts = text.chunks(docs.select("member_id", "text"), "member_id")
        if spec:
            wanted = self.spark.createDataFrame([(spec,)], "spec string").select(F.explode(relational.section_numbers("spec")).alias("part"))
            parts = parts.join(wanted, "part", "left_semi")
        if grep:
            parts = parts.filter(F.contains(F.lower("chunk"), F.lit(grep.lower())))
        if budget:
            running = F.sum(F.length("chunk")).over(Window.partitionBy("member_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
            parts = parts.withColumn("running", running).filter(F.col("running") <= budget)
        return parts.select("part", "chunk").orderBy("part")

    def pictures(self, sections: DataFrame) -> DataFrame:
        """(member, pictures, with_text): of (member, section, text) rows, how many sections from 1001 on were read from pictures and hold text (Q35)."""
        return sections.filter("section >= 1001").groupBy("member").agg(F.count(F.lit(1)).alias("pictures"), F.count_if(F.trim("text") != "").alias("with_text"))

    def documents(self, term: str) -> DataFrame:
        """(member, part, excerpt): documents that mention a term (Q33)."""
        docs = self.members.filter(F.col("kind").isin("document", "html")).select("member_id", F.col("name").alias("member"), "text")
        parts = text.chunks(docs.select("member_id", "text"), "member_id")
        hit = parts.filter(F.contains(F.lower("chunk"), F.lit(term.lower()))).join(docs.select("member_id", "member"), "member_id")
        at = F.greatest(F.locate(term.lower(), F.lower(F.col("chunk"))) - 40, F.lit(1))
        return hit.select("member", "part", F.substr("chunk", at, F.lit(120)).alias("excerpt"))

    def pack(self, program: str, budget: int = 4000) -> DataFrame:
        """Evidence lines of a program in a character budget, by priority of their fact (Q30, L4)."""
        own = self.fact("program").filter(F.col("program_id") == program.upper()).select("member_id")
        order = ["call_edge", "io_op", "sql_stmt", "perform_edge", "data_flow", "literal_ref"]
        cites = None
        for n, fact in enumerate(order):
            rows = self.fact(fact).join(own, "member_id", "left_semi").select("member_id", F.col("line").cast("long").alias("line_no"), F.lit(n).alias("priority"))
            cites = rows if cites is None else cites.unionByName(rows)
        best = cites.groupBy("member_id", "line_no").agg(F.min("priority").alias("priority"))
        lines = text.lines(self.members.join(own, "member_id", "left_semi").select("member_id", "text"), "member_id")
        sized = best.join(lines, ["member_id", "line_no"]).withColumn("size", F.length("txt").cast("long") + 1)
        running = F.sum("size").over(Window.partitionBy("member_id").orderBy("priority", "line_no").rowsBetween(Window.unboundedPreceding, 0))
        return sized.withColumn("running", running).filter(F.col("running") <= budget).select("priority", "line_no", "txt")

    # -- value flow --------------------------------------------------------------------------------------------------

    def _kept(self, name: str, make) -> DataFrame:
        """A table of this estate that several hops or questions use, cut once."""
        if name not in self._tables:
            self._tables[name] = cut(make())
        return self._tables[name]

    def items(self) -> DataFrame:
        """Items with bytes: (program_id, root, name, path, lo, hi, length, pic, is_group, plain) of every program."""
        programs = self.fact("program").select("member_id", "program_id")
        rows = self.fact("field").filter("extent > 0").join(programs, "member_id")
        plain = (F.col("redefines") == "") & (F.col("occurs") == 1) & (F.col("name") != "FILLER")
        return rows.select("program_id", "root", "name", "path", F.col("offset").cast("long").alias("lo"), (F.col("offset") + F.col("extent")).cast("long").alias("hi"), F.col("length").cast("long").alias("length"), "pic", "is_group", plain.alias("plain"))

    def _links(self) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, list[str], Column]]]:
        """Names from which bytes go to names: direct links, and meetings.

        Direct are moves and other statements, pointers, arguments and parameters, transactions: (a_program, a, a_of, a_sub,
        b_program, b, b_of, b_sub, how, line). A meeting is what programs put under keys, what programs get under them, the
        keys, and how: columns, database segments, queues, containers and message queues (G15, G17, G20, G22-G26). Its pairs
        grow with the square of the programs that share a key, so whoever needs only some of them, or sums, never makes all.
        """
        programs = self._kept("programs", lambda: self.fact("program").select("member_id", "program_id", "linkage"))
        ids = programs.select("member_id", "program_id")
        none = F.lit("")

        def named(df: DataFrame, a: str, b: str, how: Column, a_program: str = "a_program", b_program: str = "b_program") -> DataFrame:
            return df.select(F.col(a_program).alias("a_program"), F.col(a).alias("a"), none.alias("a_of"), none.alias("a_sub"), F.col(b_program).alias("b_program"), F.col(b).alias("b"), none.alias("b_of"), none.alias("b_sub"), how.alias("how"), "line")

        def met(put: DataFrame, get: DataFrame, on: list[str], how: Column) -> tuple[DataFrame, DataFrame, list[str], Column]:
            """What one program puts under a key and another, or the same, gets under it."""
            a = put.select(*on, F.col("program_id").alias("a_program"), F.col("area").alias("a"), "line")
            b = get.select(*on, F.col("program_id").alias("b_program"), F.col("area").alias("b")).distinct()
            return a, b, on, how

        flows = self._kept("flows", lambda: self.fact("data_flow").join(ids, "member_id").drop("member_id", "member", "system"))
        moves = flows.filter("src <> '' and verb not like 'ADDRESS%'").select(F.col("program_id").alias("a_program"), F.col("src").alias("a"), F.col("src_of").alias("a_of"), F.col("src_sub").alias("a_sub"), F.col("program_id").alias("b_program"), F.col("dst").alias("b"), F.col("dst_of").alias("b_of"), F.col("dst_sub").alias("b_sub"), F.col("verb").alias("how"), "line")
        taken = flows.filter("verb = 'ADDRESS OF'").select("program_id", F.col("dst").alias("pointer"), F.col("src").alias("a"))
        given = flows.filter("verb = 'ADDRESS TO'").select("program_id", F.col("src").alias("pointer"), F.col("dst").alias("b"), "line")
        pointers = named(taken.join(given, ["program_id", "pointer"]), "a", "b", F.lit("POINTER"), "program_id", "program_id")
        args = self.fact("call_edge").join(ids, "member_id").select(F.col("program_id").alias("a_program"), "kind", F.explode("resolved").alias("b_program"), "line", "using_args")
        each = args.select("a_program", "kind", "b_program", "line", F.posexplode("using_args").alias("pos", "a"))
        params = programs.select(F.col("program_id").alias("b_program"), F.posexplode("linkage").alias("pos", "b"))
        calls = named(each.filter("kind not like 'cics%'").join(params, ["b_program", "pos"]), "a", "b", F.lit("CALL"))
        areas = named(each.filter("kind like 'cics%'").withColumn("b", F.lit("DFHCOMMAREA")), "a", "b", F.lit("COMMAREA"))
        columns = self.fact("sql_col_ref").filter("tbl <> '?'").join(ids, "member_id").withColumnRenamed("host_var", "area")
        tables = met(columns.filter("mode = 'write'"), columns.filter("mode = 'read'"), ["base_tbl", "col"], F.concat(F.lit("column "), "base_tbl", F.lit("."), "col"))
        dli = self.database_calls().filter("dbd is not null and area <> ''")
        segments = met(dli.filter(F.col("func").isin("ISRT", "REPL")), dli.filter(F.col("func").isin("GU", "GN", "GNP", "GHU", "GHN", "GHNP")), ["dbd"], F.concat(F.lit("database "), "dbd"))
        online = self._kept("online", lambda: self.fact("cics_op").join(ids, "member_id").filter("area <> ''").drop("member_id", "member", "system"))
        held = online.filter("resource <> '' and kind <> 'transaction' and kind <> 'map'")
        queues = met(held.filter("direction = 'out'"), held.filter("direction = 'in'"), ["kind", "resource"], F.concat("kind", F.lit(" "), "resource"))
        routes = self.fact("transaction_def").select(F.col("code").alias("resource"), F.col("program").alias("b_program")).distinct()
        sent = online.filter("kind = 'transaction' and resource <> ''").join(routes, "resource").select(F.col("program_id").alias("a_program"), F.col("area").alias("a"), "b_program", "verb", "resource", "line")
        start = online.filter("kind = 'start_data'").select(F.col("program_id").alias("b_program"), F.col("area").alias("b"))
        how = F.concat(F.lit("transaction "), "resource")
        started = named(sent.filter("verb = 'START'").join(start, "b_program"), "a", "b", how)
        returned = named(sent.filter("verb = 'RETURN'").withColumn("b", F.lit("DFHCOMMAREA")), "a", "b", how)
        mq = self.fact("mq_call").join(ids, "member_id").filter("queue <> '' and area <> ''")
        messages = met(mq.filter("verb like 'MQPUT%'"), mq.filter("verb = 'MQGET'"), ["queue"], F.concat(F.lit("message queue "), "queue"))
        out = moves
        for more in (pointers, calls, areas, started, returned):
            out = out.unionByName(more)
        return out, [tables, segments, queues, messages]

    def _resolved_names(self) -> DataFrame:
        """(program_id, name, of, n, item): each name used, with its OF/IN groups, and how many items of the program it fits.

        With exactly one, that is the item; the rest are the residue of :meth:`unresolved_names`.
        """
        links, meetings = self._linked()
        ends = [links.select(F.col(f"{e}_program").alias("program_id"), F.col(e).alias("name"), F.col(f"{e}_of").alias("of")) for e in "ab"]
        for put, get, on, _ in meetings:
            for e, one, other in (("a", put, get), ("b", get, put)):
                ends.append(one.join(other.select(*on).distinct(), on, "left_semi").select(F.col(f"{e}_program").alias("program_id"), F.col(e).alias("name"), F.lit("").alias("of")))
        used = functools.reduce(DataFrame.union, ends).distinct()
        items = self._kept("items", self.items)
        groups = F.reverse(F.split("of", "/"))
        pattern = F.concat(F.lit("(^|/)"), F.array_join(groups, "(/.*)?/"), F.lit("(/.*)?/"), "name", F.lit("$"))
        fits = used.join(items, ["program_id", "name"], "left").filter((F.col("of") == "") | F.col("path").isNull() | F.rlike("path", pattern))
        found = fits.groupBy("program_id", "name", "of").agg(F.count("path").alias("n"), F.min(F.struct("root", "path", "lo", "hi", "length", "pic", "is_group")).alias("item"))
        return used.join(found, ["program_id", "name", "of"], "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def unresolved_names(self) -> DataFrame:
        """(program_id, name, of, kind): names in the flow that fit no item of their program, or several."""
        names = self._kept("names", self._resolved_names)
        held = self.fact("program").select("program_id").distinct()
        return names.filter("n <> 1").join(held, "program_id", "left_semi").select("program_id", "name", "of", F.when(F.col("n") == 0, "unknown_field").otherwise("ambiguous_field").alias("kind"))

    @staticmethod
    def _part(side: str) -> tuple[Column, Column]:
        """First and last byte of an item named with a subscript or a reference modification, both as numbers."""
        sub, lo, hi, length = (F.col(f"{side}_{c}") for c in ("sub", "lo", "hi", "length"))
        begin, size = (F.nullif(F.regexp_extract(sub, r"^\s*(\d+)\s*:\s*(\d*)", k), F.lit("")).cast("long") for k in (1, 2))
        element = F.nullif(F.regexp_extract(sub, r"^\s*(\d+)\s*$", 1), F.lit("")).cast("long")
        first = F.when(begin.isNotNull(), lo + begin - 1).when(element.isNotNull() & (lo + element * length <= hi), lo + (element - 1) * length).otherwise(lo)
        last = F.when(begin.isNotNull(), F.coalesce(F.least(lo + begin - 1 + size, hi), hi)).when(element.isNotNull() & (lo + element * length <= hi), lo + element * length).otherwise(hi)
        return first, last

    def _linked(self) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, list[str], Column]]]:
        """Direct links, made once per estate, and meetings."""
        if "links" not in self._tables:
            direct, self._meetings = self._links()
            self._tables["links"] = cut(direct)
        return self._tables["links"], self._meetings

    def _end(self, side: str) -> DataFrame:
        """Names that fit one item, with its bytes, as one end of a link."""
        names = self._kept("names", self._resolved_names).filter("n = 1")
        return names.select(F.col("program_id").alias(f"{side}_program"), F.col("name").alias(side), F.col("of").alias(f"{side}_of"), *[F.col(f"item.{c}").alias(f"{side}_{c}") for c in ("root", "path", "lo", "hi", "length", "pic")])

    def _met_ends(self) -> list[tuple[DataFrame, DataFrame, list[str]]]:
        """Of each meeting, both sides as byte ranges, with the keys and how: a side is as long as the facts it comes from."""

        def side(e: str, rows: DataFrame, on: list[str], how: Column, *more: str) -> DataFrame:
            own = self._end(e).filter(F.col(f"{e}_of") == "").drop(f"{e}_of")
            return rows.join(own, [f"{e}_program", e]).select(*on, how.alias("how"), f"{e}_program", *[f"{e}_{c}" for c in ("root", "lo", "hi", "pic")], *more)

        return [(side("a", put, on, how, "line"), side("b", get, on, how), [*on, "how"]) for put, get, on, how in self._linked()[1]]

    def flow_edges(self) -> DataFrame:
        """The edges of the value flow: direct ones, and all pairs that meet, which are not stored."""
        direct = self._kept("edges", self._flow_edges)
        return functools.reduce(DataFrame.unionByName, (a.join(b, on).select(*direct.columns) for a, b, on in self._met_ends()), direct)

    def flow_totals(self) -> DataFrame:
        """(how, n, a_lo, a_hi, b_lo, b_hi): the edges of the value flow by how, with sums of their ends.

        Of n puts and m gets under a key there are n m pairs, in which each put's bytes count m times and each get's n
        times, so no pair is made.
        """
        places = ("lo", "hi")
        out = self._kept("edges", self._flow_edges).groupBy("how").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"{e}_{c}").alias(f"{e}_{c}") for e in "ab" for c in places])
        for a, b, on in self._met_ends():
            sums = [rows.groupBy(*on).agg(F.count(F.lit(1)).alias(f"{e}_n"), *[F.sum(f"{e}_{c}").alias(f"{e}_{c}") for c in places]) for e, rows in (("a", a), ("b", b))]
            met = sums[0].join(sums[1], on)
            out = out.unionByName(met.select("how", (F.col("a_n") * F.col("b_n")).alias("n"), *[(F.col(f"{e}_{c}") * F.col(f"{'ba'['ab'.index(e)]}_n")).alias(f"{e}_{c}") for e in "ab" for c in places]))
        return out.groupBy("how").agg(*[F.sum(c).alias(c) for c in out.columns if c != "how"])

    def _flow_edges(self) -> DataFrame:
        """Direct edges between byte ranges: (a_program, a_root, a_lo, a_hi, a_pic, b_program, b_root, b_lo, b_hi, b_pic, how, line).

        MOVE CORRESPONDING is one edge for each pair of elementary items of the same name and place in both groups (G16);
        FILLER, REDEFINES and OCCURS take no part.
        """
        both = self._linked()[0].join(self._end("a"), ["a_program", "a", "a_of"]).join(self._end("b"), ["b_program", "b", "b_of"])
        (a_lo, a_hi), (b_lo, b_hi) = self._part("a"), self._part("b")
        plain = both.filter("how <> 'MOVE CORR'").select("a_program", "a_root", a_lo.alias("a_lo"), a_hi.alias("a_hi"), "a_pic", "b_program", "b_root", b_lo.alias("b_lo"), b_hi.alias("b_hi"), "b_pic", "how", "line")
        small = self._kept("items", self.items).filter("plain and not is_group")
        parts = F.split("path", "/")
        under = small.select("program_id", "root", "lo", "hi", "pic", "path", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).alias("k"), parts.alias("p"))
        under = under.filter(F.size("p") > F.col("k")).select("program_id", "root", "lo", "hi", "pic", F.array_join(F.slice("p", 1, F.col("k")), "/").alias("group"), F.array_join(F.slice("p", F.col("k") + 1, F.size("p")), "/").alias("rest"))
        corr = both.filter("how = 'MOVE CORR'").select("a_program", "a_path", "b_program", "b_path", "how", "line")

        def below(side: str) -> DataFrame:
            return under.select(F.col("program_id").alias(f"{side}_program"), F.col("group").alias(f"{side}_path"), "rest", *[F.col(c).alias(f"{side}_{c}") for c in ("root", "lo", "hi", "pic")])

        pairs = corr.join(below("a"), ["a_program", "a_path"]).join(below("b"), ["b_program", "b_path", "rest"]).select(*plain.columns)
        return plain.unionByName(pairs)

    def copied_data_sets(self) -> DataFrame:
        """(dsn, copy): copies of data sets and their copies, made once per estate."""
        return self._kept("copies", self._copied_data_sets)

    def _copied_data_sets(self, rounds: int = 20) -> DataFrame:
        """(dsn, copy): data sets whose records a plain sort, copy or REPRO, or a chain of them, puts into another.

        Steps that rebuild records (INREC, OUTREC, OUTFIL BUILD, JOINKEYS) end a chain.
        """
        step = ["member_id", "job", "step"]
        rebuilt = self.fact("card_field").filter(F.col("card").isin("INREC", "OUTREC", "OUTFIL", "JOINKEYS")).select(*step)
        plain = self._as_run("step").filter(F.col("how").isin("SORT", "COPY")).select(*step).distinct().join(rebuilt, step, "left_anti")
        dds = self._as_run("dd").filter("dsn <> '' and not temp").join(plain, step, "left_semi").filter(~F.col("dd").isin("STEPLIB", "JOBLIB", "SYSIN"))
        reads, writes = dds.filter(F.col("dd").isin("SORTIN", "SYSUT1")), dds.filter(F.col("dd").isin("SORTOUT", "SYSUT2"))
        pairs = reads.select(*step, "dsn").join(writes.select(*step, F.col("dsn").alias("copy")), step).select("dsn", "copy")
        of_dd = self._as_run("dd").filter("dsn <> '' and not temp").select(*step, "dd", "dsn")
        repro = self.fact("dataset_copy").filter("job <> ''")
        for name, flag in (("source", "from_dd"), ("target", "to_dd")):
            own = of_dd.select(*step, F.col("dd").alias(name), F.lit(True).alias(flag), F.col("dsn").alias(f"{name}_dsn"))
            repro = repro.join(own, [*step, name, flag], "left").withColumn(name, F.when(F.col(flag), F.col(f"{name}_dsn")).otherwise(F.col(name))).drop(f"{name}_dsn")
        pairs = pairs.unionByName(repro.filter("source is not null and target is not null").select(F.col("source").alias("dsn"), F.col("target").alias("copy")))
        direct = cut(pairs.filter("dsn <> copy").distinct())
        seen = frontier = direct
        for _ in range(rounds):
            longer = frontier.join(direct.select(F.col("dsn").alias("copy"), F.col("copy").alias("next")), "copy").select("dsn", F.col("next").alias("copy")).distinct()
            frontier = cut(longer.join(seen, ["dsn", "copy"], "left_anti"))
            if frontier.isEmpty():
                return seen
            seen = seen.unionByName(frontier)
        raise RuntimeError(f"copies chain more than {rounds} steps")

    def file_edges(self) -> DataFrame:
        """Records that one program writes and another reads, made once per estate."""
        return self._kept("files", self._file_edges)

    def _file_edges(self) -> DataFrame:
        """(program_id, root, other, d_root, dsn): records written by one program that another reads, directly or as a copy."""
        programs = self.fact("program").select("member_id", "program_id")
        ios = self.fact("io_op").join(programs, "member_id").filter("dd <> ''").select("program_id", "dd", "target").distinct()
        sets = self.dataset_flow().filter("not temp").select("program_id", "dd", "dsn", "mode").distinct().join(ios, ["program_id", "dd"]).join(self.record_areas(), ["program_id", "target"])
        out = sets.filter(F.col("mode").isin("output", "both")).select("program_id", "root", "dsn")
        copies = self.copied_data_sets().select("dsn", F.col("copy").alias("at"))
        out = out.withColumn("at", F.col("dsn")).unionByName(out.join(copies, "dsn").select("program_id", "root", "dsn", "at"))
        into = sets.filter(F.col("mode").isin("input", "both")).select(F.col("program_id").alias("other"), F.col("root").alias("d_root"), F.col("dsn").alias("at"))
        return out.join(into, "at").filter("program_id <> other").select("program_id", "root", "other", "d_root", F.col("at").alias("dsn")).distinct()

    def flow(self, field: str, program: str, hops: int = 3, up: bool = False) -> DataFrame:
        """Where the bytes of a field go, or come from: (hop, program_id, root, lo, hi, how, line).

        A node is a byte range of a root item of one program. Each hop joins the frontier with the edges whose range it
        overlaps, and with the records it is written in; a range inside one that was seen ends there. Names that fit no
        item, or several, are in :meth:`unresolved_names`. The walk ignores the order of statements.
        """
        items = self._kept("items", self.items)
        edges = self._kept("edges", self._flow_edges)
        files = self.file_edges()
        near, far = ("b", "a") if up else ("a", "b")
        steps = edges.select(F.col(f"{near}_program").alias("program_id"), F.col(f"{near}_root").alias("root"), F.col(f"{near}_lo").alias("lo"), F.col(f"{near}_hi").alias("hi"), F.col(f"{near}_pic").alias("pic"), F.col(f"{far}_program").alias("d_program"), F.col(f"{far}_root").alias("d_root"), F.col(f"{far}_lo").alias("d_lo"), F.col(f"{far}_hi").alias("d_hi"), F.col(f"{far}_pic").alias("d_pic"), "how", "line")
        # of a meeting only the pairs of the frontier's own ranges are made
        met = []
        for a, b, on in self._met_ends():
            own, other = (b.withColumn("line", F.lit(None).cast("int")), a) if up else (a, b.withColumn("line", F.lit(None).cast("int")))
            own = own.select(*on, F.col(f"{near}_program").alias("program_id"), *[F.col(f"{near}_{c}").alias(c) for c in ("root", "lo", "hi", "pic")], F.col("line").alias("own_line"))
            met.append((own, other.select(*[F.col(c).alias(f"r_{c}") for c in on], F.col(f"{far}_program").alias("r_d_program"), *[F.col(f"{far}_{c}").alias(f"r_d_{c}") for c in ("root", "lo", "hi", "pic")], F.col("line").alias("far_line")), [f"r_{c}" for c in on]))
        records = files.select(F.col("other").alias("program_id"), F.col("d_root").alias("root"), F.col("program_id").alias("other"), F.col("root").alias("d_root"), "dsn") if up else files
        start = items.filter((F.col("name") == field.upper()) & (F.col("program_id") == program.upper()))
        frontier = cut(start.select(F.lit(0).alias("hop"), "program_id", "root", "lo", "hi", F.lit("start").alias("how"), F.lit(0).alias("line")))
        seen = frontier
        for hop in range(1, hops + 1):
            nodes = frontier.select("program_id", "root", "lo", "hi")
            at = interval.overlap_join(nodes, steps, ["program_id", "root"], "lo", "hi", 256)
            for own, other, on in met:
                pairs = interval.overlap_join(nodes, own, ["program_id", "root"], "lo", "hi", 256).join(other, on)
                at = at.unionByName(pairs.withColumn("r_line", F.coalesce("r_own_line", "far_line")).select(*at.columns))
            begin = F.greatest("lo", "r_lo") - F.col("r_lo")
            size = F.least("hi", "r_hi") - F.greatest("lo", "r_lo")
            # left-justified bytes, cut at the other end's last; the whole of it where a move converts the picture
            numeric = F.col("r_pic").rlike("^S?9") | F.col("r_d_pic").rlike("^S?9")
            shared = F.col("r_how").isin("CALL", "COMMAREA", "POINTER")
            whole = ~shared & (F.col("r_pic") != F.col("r_d_pic")) & numeric
            lo = F.when(whole, F.col("r_d_lo")).otherwise(F.col("r_d_lo") + begin)
            hi = F.when(whole, F.col("r_d_hi")).otherwise(F.least(F.col("r_d_hi"), F.col("r_d_lo") + begin + size))
            moved = at.select(F.col("r_d_program").alias("program_id"), F.col("r_d_root").alias("root"), lo.alias("lo"), hi.alias("hi"), F.col("r_how").alias("how"), F.col("r_line").alias("line"))
            written = frontier.select("program_id", "root", "lo", "hi").join(records, ["program_id", "root"]).select(F.col("other").alias("program_id"), F.col("d_root").alias("root"), "lo", "hi", F.concat(F.lit("file "), "dsn").alias("how"), F.lit(0).alias("line"))
            new = moved.unionByName(written).filter("lo < hi").distinct()
            inside = seen.select("program_id", "root", F.col("lo").alias("v_lo"), F.col("hi").alias("v_hi"))
            fresh = new.join(inside, (new["program_id"] == inside["program_id"]) & (new["root"] == inside["root"]) & (inside["v_lo"] <= new["lo"]) & (new["hi"] <= inside["v_hi"]), "left_anti")
            frontier = cut(fresh.select(F.lit(hop).alias("hop"), "program_id", "root", "lo", "hi", "how", "line"))
            seen = seen.unionByName(frontier)
            if frontier.isEmpty():
                break
        return seen

    def origins(self, field: str, program: str, hops: int = 3) -> DataFrame:
        """Literals that reach a field, with where each is set (G27): moves of literals into ranges of the upward walk."""
        walk = self.flow(field, program, hops, up=True).select("program_id", "root", "lo", "hi", "hop")
        programs = self.fact("program").select("member_id", "program_id")
        items = self.fact("field").filter("extent > 0").join(programs, "member_id").select("program_id", "root", F.col("name").alias("dst"), F.col("offset").cast("long").alias("lo"), (F.col("offset") + F.col("extent")).cast("long").alias("hi"))
        touched = interval.overlap_join(walk, items, ["program_id", "root"], "lo", "hi", 256).select("program_id", F.col("r_dst").alias("dst"), "hop")
        sets = self.fact("data_flow").filter("src = ''").join(programs, "member_id").select("program_id", "dst", F.col("src_lit").alias("literal"), "line")
        return sets.join(touched, ["program_id", "dst"]).groupBy("program_id", "dst", "literal", "line").agg(F.min("hop").alias("hop"))

    # -- database calls ----------------------------------------------------------------------------------------------

    def database_calls(self) -> DataFrame:
        """(program_id, func, position, psb, dbd, procopt, area, line): each DL/I call with the PCB it names.

        The PSB is that of the step's parameter, else the one of the program's own name; the position is the argument's
        place in the program's linkage.
        """
        programs = self.fact("program").select("member_id", "program_id", "linkage")
        calls = self.fact("dli_call").join(programs, "member_id").withColumn("position", F.array_position("linkage", F.col("pcb")).cast("int"))
        by_step = self.fact("step").filter("how = 'ims_parm'").select(F.col("effective").alias("program_id"), F.nullif("psb", F.lit("")).alias("step_psb")).filter("step_psb is not null").distinct()
        psb = calls.join(by_step, "program_id", "left").withColumn("psb", F.coalesce("step_psb", "program_id"))
        pcbs = self.fact("ims_pcb").select("psb", "position", "dbd", "procopt", "senseg")
        return psb.join(pcbs, ["psb", "position"], "left").select("program_id", "func", "position", "psb", "dbd", "procopt", "senseg", "area", "line")

    def segment(self, name: str) -> DataFrame:
        """Programs whose calls go through a PCB that is sensitive to a segment (Q15)."""
        return self.database_calls().filter(F.array_contains("senseg", name.upper())).groupBy("program_id", "dbd").agg(relational.ordered_list("func").alias("functions"), F.min("line").alias("first_line"))

    def record_areas(self) -> DataFrame:
        """(program_id, target, root): the record areas of each file, the 01 items of its own FD."""
        programs = self.fact("program").select("member_id", "program_id")
        areas = self.fact("field").filter("section = 'FILE' and level = 1 and fd <> ''")
        return areas.join(programs, "member_id").select("program_id", F.col("fd").alias("target"), "root").distinct()
