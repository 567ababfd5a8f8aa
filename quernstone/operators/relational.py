"""Joins, aggregates, windows and set operations that the fact queries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_list(column: str | Column, sep: str = ",") -> Column:
    """Distinct values of a group in a fixed order, as one string (A3)."""
    return F.concat_ws(sep, F.sort_array(F.collect_set(column)))


def pick_by_precedence(df: DataFrame, keys: list[str], order: list[Column], differs: str | None = None) -> DataFrame:
    """The first row of each key by the given precedence (J14, W4), flagged ``ambiguous`` if the key has several ``differs``.

    A window over the key sorts and spills; keys here are entities (a program, a customer), not categories.
    """
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if differs:
        every = Window.partitionBy(*keys)
        out = out.withColumn("ambiguous", F.min(differs).over(every) != F.max(differs).over(every))
    return out.filter("_rank = 1").drop("_rank")


def first_cite(df: DataFrame, keys: list[str], cite: str, order: str) -> DataFrame:
    """The cite with the smallest order in each cell (A10); combines on the map side."""
    return df.groupBy(*keys).agg(F.min(F.struct(order, cite)).alias("_m")).select(*keys, F.col(f"_m.{order}").alias(order), F.col(f"_m.{cite}").alias(cite))


def letters(df: DataFrame, keys: list[str], kind: str, letter_of: dict[str, str]) -> DataFrame:
    """Set of kinds per key as letters in the fixed order of ``letter_of``."""
    flags = [F.max(F.col(kind) == k).alias(f"_{n}") for n, k in enumerate(letter_of)]
    parts = [F.when(F.col(f"_{n}"), F.lit(x)) for n, x in enumerate(letter_of.values())]
    return df.groupBy(*keys).agg(*flags).select(*keys, F.concat_ws("", *parts).alias("letters"))


def difference(old: DataFrame, new: DataFrame, keys: list[str], label: str = "change") -> DataFrame:
    """Rows of two sets as added / removed / both (J12, U3, U4), by one full outer join on the keys."""
    a = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    b = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("both").alias(label))


def base_name(column: str) -> Column:
    """Last part of a qualified name, so that a suffix match is an equi-join."""
    return F.element_at(F.split(F.col(column), r"\."), -1)


def prefix_within_budget(df: DataFrame, keys: list[str], size: str, order: list[str], budget: int, salts: int = 32) -> DataFrame:
    """Per key the longest prefix, smallest sizes first, whose running sum is within the budget (L4).

    A row of the prefix is within the budget in any part of its key as well, so parts are cut first, by salt, and only
    what is left meets in the key's own window: at most ``salts * budget / smallest size`` rows.
    """
    local = Window.partitionBy(*keys, "_salt").orderBy(size, *order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys).orderBy(size, *order).rowsBetween(Window.unboundedPreceding, 0)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    small = salted.withColumn("_sum", F.sum(size).over(local)).filter(F.col("_sum") <= budget).drop("_sum", "_salt")
    return small.withColumn("running", F.sum(size).over(whole)).filter(F.col("running") <= budget)


def with_residue(result: DataFrame, residue: DataFrame, keys: list[str]) -> DataFrame:
    """A result with, beside it, the number of facts about its keys that could not be resolved."""
    counts = residue.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_unresolved"))
    return result.join(counts, keys, "left").withColumn("n_unresolved", F.coalesce("n_unresolved", F.lit(0)))


def column_aliases(name: str) -> Column:
    """Column names that a COBOL name may stand for (P4): with underscores, and without the prefix of its section."""
    under = F.replace(F.upper(name), F.lit("-"), F.lit("_"))
    return F.array_distinct(F.array(under, F.regexp_replace(under, "^(WS|LK|WK|W|IN|OUT)_", "")))


def section_numbers(spec: str) -> Column:
    """``2,7,9-12`` -> the sorted numbers it names (P9); what is no number or range names none."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d{1,6}(\s*-\s*\d{1,6})?$"))
    ends = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).cast("int")))
    ranges = F.transform(ends, lambda e: F.when(F.element_at(e, -1) >= e[0], F.sequence(e[0], F.element_at(e, -1))).otherwise(F.array().cast("array<int>")))
    return F.sort_array(F.array_distinct(F.flatten(ranges)))


def dd_matches(assigns: DataFrame, dds: DataFrame) -> DataFrame:
    """(assign, dd): names of files and of DDs that mean each other (P10): equal, or one's part after a ``.`` or ``-`` is the other.

    Both sides are exploded to the suffixes they may be known by, so the test is an equi-join.
    """

    def suffixes(c: str) -> Column:
        parts = F.split(F.replace(F.upper(c), F.lit("."), F.lit("-")), "-")
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "-")))

    a = assigns.select("assign").distinct()
    d = dds.select("dd").distinct()
    by_assign = a.select("assign", suffixes("assign").alias("s")).join(d.select("dd", F.replace(F.upper("dd"), F.lit("."), F.lit("-")).alias("s")), "s")
    by_dd = d.select("dd", suffixes("dd").alias("s")).join(a.select("assign", F.replace(F.upper("assign"), F.lit("."), F.lit("-")).alias("s")), "s")
    return by_assign.select("assign", "dd").union(by_dd.select("assign", "dd")).distinct()


def next_sibling(df: DataFrame, parent: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Each row with the value of the next one under the same parent."""
    return df.withColumn(name, F.lead(value).over(Window.partitionBy(*parent).orderBy(*order)))


def deepest_first_cut(df: DataFrame, keys: list[str], depth: str, size: str, budget: int) -> DataFrame:
    """Whole levels of each key from the top down, as many as the budget holds (L5): the deepest are cut first."""
    levels = df.groupBy(*keys, depth).agg(F.sum(size).alias("_level"))
    running = F.sum("_level").over(Window.partitionBy(*keys).orderBy(depth).rowsBetween(Window.unboundedPreceding, 0))
    kept = levels.withColumn("_running", running).filter(F.col("_running") <= budget).select(*keys, depth)
    return df.join(kept, [*keys, depth], "left_semi")


def nulls_last(*columns: str) -> list[Column]:
    """Sort keys with nulls after all values (L1)."""
    return [F.col(c).asc_nulls_last() for c in columns]
