"""The query catalogue: name -> DataFrame builder, and the SQL each one is checked against.

Each query binds an operator of the engine to whole driver tables. ``@query`` registers it with its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators import gate, graph, interval, relational, text
from quernstone.session import table, tasks_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""
        select coalesce(n_name, '?') as nation, count(*) as n_lines, count(distinct o_custkey) as n_customers,
          round(sum(case when l_returnflag = 'R' then l_quantity else 0 end), 2) as returned_qty,
          string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as statuses
        from lineitem join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
        left join nation on c_nationkey = n_nationkey group by 1""")
def dataset_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left chain with a coalesced key, then distinct counts and an ordered list per nation."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("decimal(18,2)")).otherwise(0)).alias("r"),
    )
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .groupBy(F.coalesce("n_name", F.lit("?")).alias("nation"))
        .agg(
            F.sum("n").alias("n_lines"),
            F.countDistinct("o_custkey").alias("n_customers"),
            F.round(F.sum("r").cast("double"), 2).alias("returned_qty"),
            F.concat_ws(",", F.sort_array(F.collect_set("o_orderstatus"))).alias("statuses"),
        )
    )


@query("""
    select sha256(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) as norm_sha, count(*) as copies, count(distinct source) as n_sources,
      string_agg(distinct lang, ',' order by lang) as langs, min(doc_id) as first_doc
    from documents where text is not null group by 1 having count(*) > 1""")
def ambiguous_members(spark, sf_dir):
    """Members of one normalised content: copies, their sources and languages."""
    norm = F.sha2(F.trim(F.regexp_replace("text", "[ \t\r\n]+", " ")).cast("binary"), 256)
    d = table(spark, sf_dir, "documents").filter("text is not null").select(norm.alias("norm_sha"), "doc_id", "source", "lang")
    # sets of sources and languages stay small per group, and are combined on the map side
    return (
        d.groupBy("norm_sha")
        .agg(F.count(F.lit(1)).alias("copies"), F.size(F.collect_set("source")).cast("long").alias("n_sources"), relational.ordered_list("lang").alias("langs"), F.min("doc_id").alias("first_doc"))
        .filter("copies > 1")
    )


@query("""
    select p_name, count(distinct p_brand) as n_brands, count(distinct p_type) as n_types, count(*) as n_parts
    from part group by 1 having count(distinct p_brand) > 1""")
def kinds_per_name(spark, sf_dir):
    """One name in several kinds (second half of Q24)."""
    return (
        table(spark, sf_dir, "part")
        .groupBy("p_name")
        .agg(F.countDistinct("p_brand").alias("n_brands"), F.countDistinct("p_type").alias("n_types"), F.count(F.lit(1)).alias("n_parts"))
        .filter("n_brands > 1")
    )


_LETTERS = {"click": "R", "signup": "C", "purchase": "U", "error": "D", "view": "X"}


@query("""
    select user_id, concat(case when max((event_type = 'click')::int) = 1 then 'R' else '' end, case when max((event_type = 'signup')::int) = 1 then 'C' else '' end,
      case when max((event_type = 'purchase')::int) = 1 then 'U' else '' end, case when max((event_type = 'error')::int) = 1 then 'D' else '' end,
      case when max((event_type = 'view')::int) = 1 then 'X' else '' end) as letters
    from events group by 1""")
def crud_matrix(spark, sf_dir):
    """Letters per entity in a fixed order."""
    return relational.letters(table(spark, sf_dir, "events"), ["user_id"], "event_type", _LETTERS)


@query("""
    select o_orderstatus, count(*) filter (o_orderpriority = '1-URGENT') as urgent, count(*) filter (o_orderpriority = '2-HIGH') as high,
      count(*) filter (o_orderpriority not in ('1-URGENT', '2-HIGH')) as other, count(distinct o_custkey) as n_customers from orders group by 1""")
def table_verbs(spark, sf_dir):
    """Counts per verb, pivoted by conditional sums in one pass."""
    p = F.col("o_orderpriority")
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderstatus")
        .agg(
            F.count_if(p == "1-URGENT").alias("urgent"),
            F.count_if(p == "2-HIGH").alias("high"),
            F.count_if(~p.isin("1-URGENT", "2-HIGH")).alias("other"),
            F.countDistinct("o_custkey").alias("n_customers"),
        )
    )


@query("""
    with seen as (select o_orderstatus as value, count(*) filter (o_totalprice >= 250000) as n_set, count(*) filter (o_totalprice < 250000) as n_tested from orders group by 1),
    known(value) as (values ('F'), ('O'), ('X'))
    select coalesce(s.value, k.value) as value, coalesce(n_set, 0) as n_set, coalesce(n_tested, 0) as n_tested,
      case when k.value is null then 'undocumented' when s.value is null then 'unused' else 'documented' end as status
    from seen s full join known k on s.value = k.value""")
def value_domain(spark, sf_dir):
    """Observed values against the documented ones (Q6)."""
    big = F.col("o_totalprice") >= 250000
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count_if(big).alias("n_set"), F.count_if(~big).alias("n_tested"))
    known = spark.sql("select * from values ('F'), ('O'), ('X') as k(value)").withColumn("known", F.lit(True))
    status = F.when(F.col("known").isNull(), "undocumented").when(F.col("n_set").isNull(), "unused").otherwise("documented")
    return seen.join(known, "value", "full_outer").select(
        "value", F.coalesce("n_set", F.lit(0)).alias("n_set"), F.coalesce("n_tested", F.lit(0)).alias("n_tested"), status.alias("status")
    )


@query("""
    select lang, source, count(*) as n, cast(sum(n_chars) as bigint) as chars, round(count(*) * 100.0 / sum(count(*)) over (), 4) as share from documents group by 1, 2""")
def coverage_counts(spark, sf_dir):
    """What the index holds per kind, with its share (A1, Q25)."""
    d = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    # the window runs over the groups, of which there are few
    return d.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()).cast("double"), 4))


@query("""
    select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'P')""")
def dead_candidates(spark, sf_dir):
    """Entities that nothing reaches."""
    used = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(used, "c_custkey", "left_anti")


@query("""
    select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) filter (event_type = 'purchase') as n_written from events
    group by 1, 2 having count(*) filter (event_type = 'purchase') > 0 and count(*) filter (event_type = 'error') = 0""")
def written_never_read(spark, sf_dir):
    """Written but never read, by conditional sums (A4, Q23)."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    n = e.agg(F.count_if(F.col("event_type") == "purchase").alias("n_written"), F.count_if(F.col("event_type") == "error").alias("n_read"))
    return n.filter("n_written > 0 and n_read = 0").drop("n_read")


@query("""
    with c as (select p_partkey, unnest(list_distinct(list_concat(string_split(p_name, ' '), [p_type]))) as target from part),
    routes as (select distinct p_type as code from part union select distinct string_split(p_name, ' ')[1] from part)
    select code, count(*) as n_parts, min(p_partkey) as first_part from c join routes on target = code group by 1""")
def transaction_routing(spark, sf_dir):
    """Candidate lists exploded and joined by equality instead of by pattern."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    words = F.split("p_name", " ")
    c = p.select("p_partkey", F.explode(F.array_distinct(F.concat(words, F.array("p_type")))).alias("target"))
    routes = p.select(F.col("p_type").alias("code")).union(p.select(F.element_at(words, 1))).distinct()
    return c.join(routes, F.col("target") == F.col("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_parts"), F.min("p_partkey").alias("first_part"))


@query("""
    with q as (select doc_id, lang || '.' || source as qualified from documents)
    select split_part(qualified, '.', 2) as base, count(*) as n_docs, count(distinct split_part(qualified, '.', 1)) as n_schemas, cast(coalesce(sum(toxic), 0) as bigint) as n_toxic
    from q left join labels using (doc_id) group by 1""")
def suffix_table_match(spark, sf_dir):
    """Qualified names matched on their last part."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "lang", "source").alias("qualified"))
    marks = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (
        d.join(marks, "doc_id", "left")
        .groupBy(relational.base_name("qualified").alias("base"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct(F.substring_index("qualified", ".", 1)).alias("n_schemas"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("n_toxic"))
    )


@query("""
    select p_brand, count(distinct l_orderkey) as n_orders, count(distinct o_custkey) as n_customers, count(distinct c_nationkey) as n_nations
    from part join lineitem on p_partkey = l_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1""")
def copybook_impact(spark, sf_dir):
    """Impact over two hops: who uses it, and who uses those (Q11).

    Each count is one of distinct rows, and these are made distinct where their key lies: by order, then by customer, in
    tasks of half a million lines. Distinct counts over one joined table would hold a row three times, in tasks that grow.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = tasks_for(spark, lines.count())
    pairs = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_orderkey").repartition(n, "l_orderkey").distinct()
    placed = orders.repartition(n, "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_nationkey").repartition(n, "o_orderkey")
    used = pairs.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    by_order = used.select("p_brand", "l_orderkey").distinct()
    by_customer = used.select("p_brand", "o_custkey", "c_nationkey").repartition(n, "o_custkey").distinct()
    none = F.lit(0).cast("long")
    counts = [
        by_order.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_orders"), none.alias("n_customers"), none.alias("n_nations")),
        by_customer.select("p_brand", "o_custkey").distinct().groupBy("p_brand").agg(none.alias("n_orders"), F.count(F.lit(1)).alias("n_customers"), none.alias("n_nations")),
        by_customer.groupBy("p_brand").agg(none.alias("n_orders"), none.alias("n_customers"), F.countDistinct("c_nationkey").alias("n_nations")),
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("p_brand").agg(*[F.sum(c).alias(c) for c in ("n_orders", "n_customers", "n_nations")])


@query("select user_id, event_type, min(ts) as ts, arg_min(event_id, (ts, event_id)) as event_id from events group by 1, 2")
def first_cite(spark, sf_dir):
    """First cite of each cell (A10)."""
    return relational.first_cite(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "ts")


@query("""
    select o_custkey, o_orderkey, o_orderpriority, ambiguous from (
      select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderdate, o_orderkey) as rn,
        min(o_orderstatus) over (partition by o_custkey) <> max(o_orderstatus) over (partition by o_custkey) as ambiguous from orders) where rn = 1""")
def pick_by_precedence(spark, sf_dir):
    """One of several same-named by precedence, with a flag where they differ."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    best = relational.pick_by_precedence(o, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], "o_orderstatus")
    return best.select("o_custkey", "o_orderkey", "o_orderpriority", "ambiguous")


@query("""
    with d as (select lang, substr(text, 1, 20) as name, sha256(text) as sha, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1, 2, 3),
    f as (select *, first_value(doc_id) over w as old_doc, row_number() over w as version, count(*) over (partition by lang, name) as versions from d window w as (partition by lang, name order by doc_id))
    select lang, name, old_doc, doc_id as new_doc, copies, version - 1 as nth from f where versions > 1 and version > 1""")
def version_pairs(spark, sf_dir):
    """Members of one name with different contents, each against the first (Q32).

    Equal contents are one row before names are compared, and versions are paired with the first, not with each other.
    """
    d = table(spark, sf_dir, "documents").filter("text is not null")
    d = d.groupBy("lang", F.substring("text", 1, 20).alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    w = Window.partitionBy("lang", "name").orderBy("doc_id")
    f = d.withColumn("old_doc", F.first("doc_id").over(w)).withColumn("nth", (F.row_number().over(w) - 1).cast("long"))
    return f.filter("nth > 0").select("lang", "name", "old_doc", F.col("doc_id").alias("new_doc"), "copies", "nth")


@query("""
    with a as (select distinct p_name, p_brand from part where p_partkey % 2 = 1), b as (select distinct p_name, p_brand from part where p_partkey % 2 = 0)
    select coalesce(a.p_name, b.p_name) as p_name, coalesce(a.p_brand, b.p_brand) as p_brand,
      case when a.p_name is null then 'added' when b.p_name is null then 'removed' else 'both' end as change
    from a full join b on a.p_name = b.p_name and a.p_brand = b.p_brand""")
def set_difference_facts(spark, sf_dir):
    """Facts of two versions: added, removed, both (J12, Q31). The two versions are the odd and the even keys."""
    p = table(spark, sf_dir, "part")
    return relational.difference(p.filter("p_partkey % 2 = 1"), p.filter("p_partkey % 2 = 0"), ["p_name", "p_brand"])


@query("""
    with x as (select l_orderkey, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as delta from lineitem)
    select delta, count(*) as n_lines, count(distinct l_orderkey) as n_orders from x group by 1""")
def shifted_fields(spark, sf_dir):
    """Places that moved, grouped by how far."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - F.row_number().over(w)).cast("long").alias("delta"))
    return li.groupBy("delta").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("""
    select user_id, case when bool_or(event_type in ('click', 'view')) and bool_or(event_type in ('purchase', 'signup')) then 'both'
      when bool_or(event_type in ('click', 'view')) then 'input' when bool_or(event_type in ('purchase', 'signup')) then 'output' else 'none' end as mode from events group by 1""")
def open_modes(spark, sf_dir):
    """Modes of all opens folded into one (M1)."""
    reads, writes = F.max(F.col("event_type").isin("click", "view")), F.max(F.col("event_type").isin("purchase", "signup"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(reads & writes, "both").when(reads, "input").when(writes, "output").otherwise("none").alias("mode"))


@query("""
    select o_orderkey, o_custkey, row_number() over w + case when first_value(o_orderstatus) over w = 'F' then 1 else 0 end as position
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def pcb_positions(spark, sf_dir):
    """Position as the program sees it: one more when the first entry is implied."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = F.when(F.first("o_orderstatus").over(w) == "F", 1).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(w) + first).cast("long").alias("position"))


@query("""
    select user_id, count(*) as n, count(*) filter (cast(regexp_extract(props, '"k": ([0-9]+)', 1) as int) >= 90) as n_unresolved,
      case when count(*) filter (cast(regexp_extract(props, '"k": ([0-9]+)', 1) as int) >= 90) = 0 then 'complete' else 'has unresolved' end as state from events group by 1""")
def unresolved_residue(spark, sf_dir):
    """A result with, beside it, what could not be resolved about it (Q26)."""
    e = table(spark, sf_dir, "events").select("user_id", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int").alias("k"))
    result = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    out = relational.with_residue(result, e.filter("k >= 90"), ["user_id"])
    return out.withColumn("state", F.when(F.col("n_unresolved") == 0, "complete").otherwise("has unresolved"))


def _supplier_edges(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst"))
    return li.filter("dst is not null and src <> dst").distinct()


_EDGES = """edges as (select distinct src, dst from (select l_suppkey as src, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst from lineitem)
      where dst is not null and src <> dst),
    reach(node, depth) as (select cast(1 as bigint), 0 union all select dst, depth + 1 from reach join edges on src = node where depth < 2)"""


@query(f"with recursive {_EDGES} select node, min(depth) as depth from reach group by 1")
def callers_depth(spark, sf_dir):
    """Breadth-first reach to a depth, each node at its least distance (G1)."""
    root = spark.range(1).select(F.lit(1).cast("long").alias("node"))
    return graph.bounded_reach(_supplier_edges(spark, sf_dir), root, 2)


@query(f"""with recursive {_EDGES},
    near as (select distinct node from reach where depth < 2)
    select dst as node, count(*) as n_callers from edges join near on src = node where not exists (select 1 from nation where n_nationkey = dst) group by 1""")
def callees_missing(spark, sf_dir):
    """Targets that are called but not held (G1, Q23)."""
    edges = _supplier_edges(spark, sf_dir)
    near = graph.bounded_reach(edges, spark.range(1).select(F.lit(1).cast("long").alias("node")), 1).select(F.col("node").alias("src"))
    held = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("dst"))
    return edges.join(near, "src").join(held, "dst", "left_anti").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_callers"))


@query("""
    with recursive e as (select n_nationkey as src, lead(n_nationkey) over (partition by n_regionkey order by n_nationkey) as dst from nation),
    r(node, depth) as (select n_nationkey, 0 from nation where n_nationkey in (1, 3) union all select dst, depth + 1 from r join e on src = node where dst is not null)
    select node, min(depth) as depth from r group by 1""")
def closure_changed(spark, sf_dir):
    """Everything that depends on what changed, to a fixpoint."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), F.lead("n_nationkey").over(w).alias("dst")).filter("dst is not null")
    return graph.closure(edges, table(spark, sf_dir, "nation").filter("n_nationkey in (1, 3)").select(F.col("n_nationkey").alias("node")))


@query("""
    select 'region' as kind, cast(r_regionkey as bigint) as key, 1 + count(distinct n_nationkey) + count(c_custkey) as n_nodes
    from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 2
    union all select 'nation', cast(n_nationkey as bigint), 1 + count(c_custkey) from nation left join customer on c_nationkey = n_nationkey group by 2""")
def subtree_counts(spark, sf_dir):
    """Sizes of subtrees of a hierarchy (G4): leaves are counted per parent first, then added up per level."""
    per_nation = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    nations = table(spark, sf_dir, "nation").join(per_nation, "n_nationkey", "left").select("n_nationkey", "n_regionkey", (1 + F.coalesce("n", F.lit(0))).alias("n"))
    per_region = nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sum("n").alias("n"))
    regions = table(spark, sf_dir, "region").join(per_region, "r_regionkey", "left")
    return regions.select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("key"), (1 + F.coalesce("n", F.lit(0))).alias("n_nodes")).unionByName(
        nations.select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("key"), F.col("n").alias("n_nodes"))
    )


@query("""
    with x as (select user_id, event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events)
    select src, dst, count(*) as n, count(distinct user_id) as n_users from x where dst is not null group by 1, 2""")
def reachability_modes(spark, sf_dir):
    """Which kind follows which (Q1's reachability, W1)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return x.filter("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("""
    select a.user_id, a.event_id as event_id, b.event_id as r_event_id from events a join events b on a.user_id = b.user_id and abs(a.event_id - b.event_id) <= 200
    where a.event_type = 'error' and b.event_type = 'purchase'""")
def pair_window(spark, sf_dir):
    """Pairs of one key within a window."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    a, b = (e.filter(F.col("event_type") == t).drop("event_type") for t in ("error", "purchase"))
    return interval.band_join(a, b, ["user_id"], "event_id", 200)


def _windows(spark, sf_dir, days):
    li = table(spark, sf_dir, "lineitem")
    lo = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return li.select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), lo.alias("lo"), (lo + days).alias("hi"))


_SHIP = """w as (select l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber as id, date_diff('day', date '1990-01-01', cast(l_shipdate as date)) as lo,
      date_diff('day', date '1990-01-01', cast(l_shipdate as date)) + {days} as hi from lineitem)"""


@query(f"""with {_SHIP.format(days="30")}
    select a.l_partkey, a.l_suppkey, a.id, b.id as r_id, least(a.hi, b.hi) - greatest(a.lo, b.lo) as days
    from w a join w b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey and a.lo < b.hi and b.lo < a.hi where a.id < b.id""")
def byte_overlap(spark, sf_dir):
    """Overlapping ranges of one key."""
    w = _windows(spark, sf_dir, F.lit(30))
    out = interval.overlap_join(w, w, ["l_partkey", "l_suppkey"], "lo", "hi", 64).filter("id < r_id")
    return out.select("l_partkey", "l_suppkey", "id", "r_id", (F.least("hi", "r_hi") - F.greatest("lo", "r_lo")).alias("days"))


@query(f"""with {_SHIP.format(days="cast(l_quantity as bigint)")}
    select case when a.lo = b.lo and a.hi = b.hi then 'exact' when b.lo <= a.lo and b.hi >= a.hi then 'longer' when b.lo >= a.lo and b.hi <= a.hi then 'shorter' else 'partial' end as fit,
      count(*) as n, min(a.id) as first_id
    from w a join w b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey and a.lo < b.hi and b.lo < a.hi where a.id < b.id group by 1""")
def overlap_class(spark, sf_dir):
    """How ranges that overlap fit each other (Q16)."""
    w = _windows(spark, sf_dir, F.col("l_quantity").cast("long"))
    out = interval.overlap_join(w, w, ["l_partkey", "l_suppkey"], "lo", "hi", 64).filter("id < r_id")
    return out.groupBy(interval.fit_class("lo", "hi", "r_lo", "r_hi").alias("fit")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("""
    with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as txt from documents),
    r as (select doc_id, line_no, coalesce(sum(length(txt) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as lo, length(txt) + 1 as n from l),
    p as (select doc_id, unnest([0, 500, 2500, 10000]) as place from documents)
    select p.doc_id, cast(place as bigint) as place, cast(line_no as bigint) as line_no, cast(place - lo as bigint) as col from p join r on p.doc_id = r.doc_id and lo <= place and place < lo + n""")
def origin_line(spark, sf_dir):
    """An offset in the expanded text -> the line it came from."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    size = (F.length("txt") + 1).cast("long")
    ranges = text.lines(d, "doc_id").select("doc_id", "line_no", size.alias("n"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("lo"))
    points = d.select("doc_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 500, 2500, 10000)])).alias("place"))
    hit = interval.point_join(points, ranges.withColumn("hi", F.col("lo") + F.col("n")), ["doc_id"], "place", "lo", "hi", 1024)
    return hit.select("doc_id", "place", "line_no", (F.col("place") - F.col("lo")).alias("col"))


@query("""
    select turn // 3 as section, role, count(*) as n_turns, cast(sum(length(text) - length(replace(text, '?', ''))) as bigint) as n_questions, cast(sum(length(text) - length(replace(text, '.', ''))) as bigint) as n_stops
    from conversations group by 1, 2""")
def conditions_by_section(spark, sf_dir):
    """Tests counted per section (Q19)."""
    marks = lambda c: F.sum(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("long")
    return (
        table(spark, sf_dir, "conversations")
        .groupBy(F.floor(F.col("turn") / 3).alias("section"), "role")
        .agg(F.count(F.lit(1)).alias("n_turns"), marks("?").alias("n_questions"), marks(".").alias("n_stops"))
    )


@query("""
    select doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) as bigint) as line_no, unnest(string_split(text, chr(10))) as txt from documents""")
def source_lines(spark, sf_dir):
    """Lines of every text, numbered."""
    return text.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("""
    with t as (select doc_id, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) as pos, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents)
    select a.doc_id, count(*) as n_hits, cast(min(a.pos) as bigint) as first_pos from t a join t b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.token = 'of' and b.token = 'the' group by 1""")
def search_phrase(spark, sf_dir):
    """Phrase search over an inverted index."""
    index = text.tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return text.phrase_hits(index, "doc_id", ["of", "the"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("pos").alias("first_pos"))


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)")
def docs_mentions(spark, sf_dir):
    """Documents that mention a term (Q33)."""
    return text.mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")


@query()
def chunk_sections(spark, sf_dir):
    """Sections over the limit cut at paragraphs, lines, sentences (E46); a fold that SQL does not express."""
    return text.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("""
    select page_id, cast(generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) as bigint) as link_no, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages""")
def html_links(spark, sf_dir):
    """Links of every page, in order."""
    return text.html_links(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


_HTML = "html"
for _p in ("(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "<[^>]*>"):
    _HTML = f"regexp_replace({_HTML}, '{_p}', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"


@query(f"with t as (select page_id, trim(regexp_replace({_HTML}, '[ \\t\\r\\n]+', ' ', 'g')) as txt from pages) select page_id, txt, length(txt) as n_chars from t")
def html_text(spark, sf_dir):
    """Text of every page."""
    t = table(spark, sf_dir, "pages").select("page_id", text.html_text("html").alias("txt"))
    return t.withColumn("n_chars", F.length("txt").cast("long"))


@query("""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as txt from documents)
    select txt, count(*) as n, count(distinct doc_id) as n_docs, min(doc_id) as first_doc from l where lower(txt) like '%licensed under%' group by 1""")
def messages_like(spark, sf_dir):
    """Texts that match a pattern, grouped by text (Q9)."""
    l = text.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").filter(F.lower("txt").like("%licensed under%"))
    return l.groupBy("txt").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""
    with v as (select distinct p_name as word from part), p as (select distinct substr(word, 1, 2) || substr(word, 4) as piece from v),
    c as (select distinct piece, word, cast(levenshtein(piece, word) as bigint) as distance from p join v
      on abs(length(piece) - length(word)) <= 1 and (substr(piece, 1, 1) = substr(word, 1, 1) or right(piece, 1) = right(word, 1)) where levenshtein(piece, word) <= 2),
    r as (select *, row_number() over (partition by piece order by distance, word) as rn, lead(distance) over (partition by piece order by distance, word) as nxt from c)
    select piece, word, distance from r where rn = 1 and (nxt is null or nxt > distance)""")
def fuzzy_snap(spark, sf_dir):
    """Misread names to the one nearest known name (C14)."""
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("word")).distinct()
    pieces = words.select(F.concat(F.substring("word", 1, 2), F.expr("substring(word, 4)")).alias("piece"))
    return text.snap(pieces, words)


@query("""
    with x as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations)
    select conv_id, turn, case when abs(length(text) - length(before)) > greatest(6, greatest(length(text), length(before)) // 100) then false
      else levenshtein(text, before) <= greatest(6, greatest(length(text), length(before)) // 100) end as same from x where before is not null""")
def near_duplicates(spark, sf_dir):
    """Whether a screen nearly repeats the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).filter("before is not null")
    return x.select("conv_id", "turn", text.nearly_same("text", "before").alias("same"))


@query("""
    select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is null or before <> event_type""")
def dedupe_consecutive(spark, sf_dir):
    """Repeats of the row before left out."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w))
    return x.filter("before is null or before <> event_type").select("event_id", "user_id", "event_type")


@query("""
    select cast(floor(epoch(ts)) as bigint) // 120 * 120 as start_s, count(*) as n, min(event_id) as first_event, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by 1""")
def caption_windows(spark, sf_dir):
    """Sections of 120 seconds."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.floor(seconds / 120) * 120).cast("long").alias("start_s"))
    return e.groupBy("start_s").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), relational.ordered_list("event_type").alias("kinds"))


@query("""
    with l as (select unnest(string_split(text, chr(10))) as txt from documents),
    s as (select regexp_replace(regexp_replace(regexp_replace(txt, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<email>', 'g'), '(/[A-Za-z0-9._-]+){2,}', '<path>', 'g'), '[0-9]+', '#', 'g') as signature from l)
    select signature, count(*) as n from s group by 1 order by n desc, signature limit 12""")
def redact(spark, sf_dir):
    """Lines masked and counted by signature, the twelve commonest."""
    l = text.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return l.groupBy(text.redact("txt").alias("signature")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature").limit(12)


_CLAIM = """a as (select doc_id, '[[D' || doc_id || ' 1-' || (1 + doc_id % 3) || ' "' || substr(regexp_replace(string_split(text, chr(10))[1], '["\\]\\[]', '', 'g'), 1, cast(3 + doc_id % 9 as int)) || '"]]' as answer from documents),
    c as (select doc_id as answer_id, regexp_extract(answer, '\\[\\[([A-Za-z0-9_.-]+) ', 1) as ref, cast(regexp_extract(answer, ' ([0-9]+)-', 1) as bigint) as first,
      cast(regexp_extract(answer, '-([0-9]+) "', 1) as bigint) as last, regexp_extract(answer, ' "([^"]*)"\\]\\]', 1) as token from a where regexp_matches(answer, '\\[\\[([A-Za-z0-9_.-]+) ([0-9]+)-([0-9]+) "([^"]*)"\\]\\]')),
    l as (select 'D' || doc_id as ref, string_split(text, chr(10)) as parts from documents)"""


@query(f"""with {_CLAIM},
    j as (select c.*, parts, len(parts) as n from c join l using (ref)),
    r as (select answer_id, ref, first, last, token, case when last > n then 'range invalid' when len(list_filter(parts[first:last], lambda x: contains(x, token))) = 0 then 'token absent'
      when length(token) < 6 then 'weak token' else '' end as reason from j)
    select *, case when reason in ('range invalid', 'token absent') then 'FAIL' when reason = '' then 'PASS' else 'WARN' end as verdict from r""")
def citation_gate(spark, sf_dir):
    """Citations of an answer joined back to the source lines (Q37). Each document gets an answer that cites it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.regexp_replace(F.element_at(F.split("text", "\n", -1), 1), '["\\]\\[]', "")
    answer = F.concat(F.lit("[[D"), "doc_id", F.lit(" 1-"), 1 + F.col("doc_id") % 3, F.lit(' "'), F.substr(first, F.lit(1), (3 + F.col("doc_id") % 9).cast("int")), F.lit('"]]'))
    claims = gate.extract(d.select(F.col("doc_id").alias("answer_id"), answer.alias("answer"))).drop("n")
    ref = F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("ref")
    members = d.select(ref, F.size(F.split("text", "\n", -1)).alias("n_lines"))
    return gate.verdicts(claims, text.lines(d, "doc_id").select(ref, "line_no", "txt"), members)


@query("""
    select lang, doc_id, n_chars, cast(running as bigint) as running from (select lang, doc_id, n_chars, sum(n_chars) over (partition by lang order by n_chars, doc_id rows between unbounded preceding and current row) as running from documents)
    where running <= 20000""")
def budget_fill(spark, sf_dir):
    """Smallest first until the budget is full (L4, Q30)."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return relational.prefix_within_budget(d, ["lang"], "n_chars", ["doc_id"], 20_000)


@query("""select o_orderpriority, count(*) as n, min(o_totalprice) as lowest, max(o_totalprice) as highest, round(avg(o_totalprice), 4) as mean from orders group by 1 order by n desc, o_orderpriority limit 3""")
def top_values(spark, sf_dir):
    """Commonest values with their sizes."""
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"), F.round(F.avg("o_totalprice"), 4).alias("mean")
    )
    return g.orderBy(F.desc("n"), "o_orderpriority").limit(3)


@query("""
    with c as (select lang, length(text) // 100 as width, count(*) as n from documents where text is not null group by 1, 2),
    r as (select *, row_number() over (partition by lang order by n desc, width) as rn from c) select lang, width, n from r where rn = 1""")
def modal_width(spark, sf_dir):
    """The commonest value per group, ties to the smallest."""
    c = table(spark, sf_dir, "documents").filter("text is not null").groupBy("lang", F.floor(F.length("text") / 100).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("lang").agg(F.max(F.struct("n", (-F.col("width")).alias("w"))).alias("b"))
    return best.select("lang", (-F.col("b.w")).alias("width"), F.col("b.n").alias("n"))


@query("""
    with x as (select user_id, event_id, event_id - row_number() over (partition by user_id order by event_id) as island from (select distinct user_id, event_id from events))
    select user_id, min(event_id) as first_id, max(event_id) as last_id, count(*) as n from x group by user_id, island having count(*) > 1""")
def contiguous_runs(spark, sf_dir):
    """Runs of neighbouring lines, by gaps and islands."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = table(spark, sf_dir, "events").select("user_id", "event_id").distinct().withColumn("island", F.col("event_id") - F.row_number().over(w))
    return x.groupBy("user_id", "island").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("island")


@query("""
    select l_partkey, l_suppkey, rn, l_orderkey from (select l_partkey, l_suppkey, l_orderkey, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_suppkey) as rn from lineitem) where rn <= 3
    union all select l_partkey, -1, 4, count(*) - 3 from lineitem group by 1 having count(*) > 3""")
def width_cap(spark, sf_dir):
    """The first three per node, and a row that tells how many more there are."""
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice")
    top = li.withColumn("rn", F.row_number().over(w).cast("long")).filter("rn <= 3").select("l_partkey", "l_suppkey", "rn", "l_orderkey")
    more = li.groupBy("l_partkey").agg((F.count(F.lit(1)) - 3).alias("l_orderkey")).filter("l_orderkey > 0")
    return top.unionByName(more.select("l_partkey", F.lit(-1).cast("long").alias("l_suppkey"), F.lit(4).cast("long").alias("rn"), "l_orderkey"))


@query("""
    with e as (select user_id, strftime(ts, '%Y-%m-%d') as day, event_type from events)
    select user_id, day, 'only a' as side from (select user_id, day from e where event_type = 'error' except select user_id, day from e where event_type = 'signup')
    union all select user_id, day, 'only b' from (select user_id, day from e where event_type = 'signup' except select user_id, day from e where event_type = 'error')""")
def symmetric_difference(spark, sf_dir):
    """Members of one set but not of both."""
    e = table(spark, sf_dir, "events")
    a, b = (e.filter(F.col("event_type") == t).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")) for t in ("error", "signup"))
    d = relational.difference(b, a, ["user_id", "day"], "side").filter("side <> 'both'")
    return d.withColumn("side", F.when(F.col("side") == "added", "only a").otherwise("only b"))


@query("""
    select date_trunc('hour', ts) as hour, event_type, count(*) as n, cast(round(sum(cast(value as decimal(18,2))), 2) as double) as total from events group by 1, 2""")
def events_stream(spark, sf_dir):
    """Events replayed as a file stream, with tumbling counts per hour."""
    from quernstone.streaming import hourly_counts

    return hourly_counts(spark, f"{sf_dir}/events.parquet")
