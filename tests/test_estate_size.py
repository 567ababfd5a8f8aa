"""What keeps the estate's build and walks bounded: rows in runs, groups on demand, meetings without their pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.functions import jcl
from quernstone.plans import estate as plans
from quernstone.sources import derived, members

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sources") / "members")
    members.inventory(derived.files(spark, SF), "/estate").write.parquet(out)
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def whole(spark, sources, tmp_path_factory):
    return plans.store(sources, str(tmp_path_factory.mktemp("whole")))


def test_parser_hands_rows_on_in_runs(sources):
    kind, source = next((r["kind"], r["text"]) for r in sources.filter("kind = 'jcl' and name like 'C%'").limit(1).collect())
    n = 5000
    parts = pa.array([None] * n, pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())])))
    batch = pa.record_batch([pa.array(range(n), pa.int64()), *(pa.array([x] * n) for x in ("M", "R0", kind, source)), parts], ["member_id", "member", "system", "kind", "text", "parts"])
    own = len(plans.facts_of(kind, source, None)["dd"])
    sizes, dds = [], 0
    for out in plans._parser()(iter([batch])):
        sizes.append(out.num_rows)
        dds += out.num_rows if out.column("fact")[0].as_py() == "dd" else 0
        assert out.nbytes < 400 * out.num_rows + 20_000  # no wide row of nulls for what other facts have
    assert max(sizes) <= 2 * plans.ROWS and dds == n * own > plans.ROWS


def test_facts_on_demand_are_those_of_a_whole_build(spark, sources, whole, tmp_path):
    lazy = plans.store(sources, str(tmp_path / "lazy"), on_demand=True)
    assert lazy.fact("program").count() > 0
    assert not (tmp_path / "lazy/facts-jobs").exists()
    for fact in plans.FACTS:
        a, b = (sorted(map(str, e.fact(fact).collect())) for e in (whole, lazy))
        assert a == b, fact


def test_totals_are_those_of_all_edges(whole):
    places = ["a_lo", "a_hi", "b_lo", "b_hi"]
    want = whole.flow_edges().groupBy("how").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in places]).select("how", "n", *places)
    assert sorted(map(tuple, whole.flow_totals().select("how", "n", *places).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("up", [False, True])
def test_a_walk_finds_what_meets_without_all_pairs(whole, monkeypatch, up):
    edges = whole.flow_edges().filter("how like 'ts_queue%' and " + ("b_program = 'P0000001' and b_root = 'WS-COPY'" if up else "a_program = 'P0000001' and a_root = 'WS-AREA'"))
    want = {r[0] for r in edges.select("a_program" if up else "b_program").distinct().collect()}
    monkeypatch.setattr(plans.Estate, "flow_edges", None)
    got = whole.flow("WS-COPY" if up else "WS-KEY", "P0000001", 1, up=up).filter("how like 'ts_queue%'").collect()
    assert {r["program_id"] for r in got} == want and want


def test_short_cuts_of_parsing_change_nothing():
    def operands(text):
        out, depth, quoted, start = [], 0, False, 0
        for k, c in enumerate(text):
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 0:
                    out.append(text[start:k])
                    start = k + 1
        return [x for x in [*out, text[start:]] if x]

    def is_host(data):
        plain = sum(0x21 <= b < 0x7F and b != 0x40 or b in (9, 10, 13) for b in data[:8192]) / min(len(data), 8192)
        return data.count(0x40) / len(data) > 0.15 and plain < 0.60

    rng = random.Random(5)
    for _ in range(5000):
        text = "".join(rng.choice("AB,,()'=&.") for _ in range(rng.randrange(14)))
        assert jcl.split_operands(text) == operands(text)
        data = bytes(rng.choice((0x40, 0x40, 0x41, 0xC1, 0x0A, 0x20)) for _ in range(rng.randrange(1, 40)))
        assert (members.sniff_encoding(data) == "cp037") == is_host(data)
    for ops in ("DSN=A.B,DISP=SHR", "DSN=&H..B,DISP=(NEW,CATLG)", "DSN=A(+1),DISP=SHR", "dsn=A,DISP=SHR", "DSN=A,DISP=(NEW,'X')", "DSN=,DISP=OLD"):
        assert jcl._keywords(ops) == {x.partition("=")[0].upper(): x.partition("=")[2] for x in operands(ops)}
    text = "//J JOB X\n//    SET M='L(ABC)'\n//S EXEC PGM=P\n//A DD DSN=&M\n//B DD DSN=L(DEF),DISP=SHR\n//C DD DSN=L,DISP=SHR\n//D DD DSN=L,DSN=L(GHI)\n"
    assert jcl.part_names(text) == {"ABC", "DEF", "GHI"}


def test_impact_counts_grow_by_tasks_not_in_them(spark, tmp_path):
    from quernstone.plans.catalogue import QUERIES
    from quernstone.session import tasks_for

    assert tasks_for(spark, 36_000_000) == 72 and tasks_for(spark, 216_000_000) == 432 and tasks_for(spark, 0) == 1
    out = QUERIES["copybook_impact"](spark, SF)
    assert "Expand" not in out._jdf.queryExecution().toString()
    # an order and a customer that are there twice, an order without its customer, a brand and a nation that are null
    for name, rows, schema in (
        ("part", [(1, "A"), (2, None)], "p_partkey long, p_brand string"),
        ("lineitem", [(1, 1), (1, 1), (2, 1), (2, 2), (3, 1)], "l_orderkey long, l_partkey long"),
        ("orders", [(1, 1), (1, 2), (2, 3), (3, 9)], "o_orderkey long, o_custkey long"),
        ("customer", [(1, 5), (2, 5), (2, 6), (3, None)], "c_custkey long, c_nationkey int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = QUERIES["copybook_impact"](spark, str(tmp_path)).select("p_brand", "n_orders", "n_customers", "n_nations")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("A", 2, 3, 2), (None, 1, 1, 0)], key=str)
