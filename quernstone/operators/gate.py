"""The citation gate (Q37): claims ``[[DOC first-last "token"]]`` in an answer, checked against the lines they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r'\[\[([A-Za-z0-9_.-]+) ([0-9]+)-([0-9]+) "([^"]*)"\]\]'
WEAK, LONG = 6, 20


def extract(answers: DataFrame, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """(key, n, ref, first, last, token): one row per citation, in order."""
    parts = [F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(k)).alias(f"_{k}") for k in range(1, 5)]
    zipped = answers.select(key, F.arrays_zip(*parts).alias("z")).select(key, F.posexplode("z").alias("_n", "c"))
    names = [f"c.`{k}`" for k in zipped.schema["c"].dataType.names]
    return zipped.select(
        key,
        (F.col("_n") + 1).cast("long").alias("n"),
        F.col(names[0]).alias("ref"),
        F.col(names[1]).cast("long").alias("first"),
        F.col(names[2]).cast("long").alias("last"),
        F.col(names[3]).alias("token"),
    )


def verdicts(claims: DataFrame, lines: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``verdict`` and ``reason``. lines: (ref, line_no, txt); members: (ref, n_lines).

    Order of tests: member unknown, range invalid, token absent: FAIL; weak token or long range: WARN; else PASS. A claim
    is joined with its own lines only (equi-join on member and on each line of the range).
    """
    numbered = claims.withColumn("_id", F.xxhash64(*claims.columns))
    there = numbered.join(members, "ref", "left")
    valid = (F.col("first") >= 1) & (F.col("last") >= F.col("first")) & (F.col("last") <= F.col("n_lines"))
    wanted = there.filter(F.coalesce(valid, F.lit(False))).select("_id", "ref", "token", F.explode(F.sequence("first", "last")).alias("line_no")).distinct()
    found = wanted.join(lines, ["ref", "line_no"]).groupBy("_id").agg(F.max(F.contains("txt", "token")).alias("_found"))
    out = there.join(found, "_id", "left")
    reason = (
        F.when(F.col("n_lines").isNull(), "unknown member")
        .when(~valid, "range invalid")
        .when(~F.coalesce("_found", F.lit(False)), "token absent")
        .when(F.length("token") < WEAK, "weak token")
        .when(F.col("last") - F.col("first") + 1 > LONG, "long range")
        .otherwise("")
    )
    verdict = F.when(F.col("reason").isin("unknown member", "range invalid", "token absent"), "FAIL").when(F.col("reason") == "", "PASS").otherwise("WARN")
    return out.withColumn("reason", reason).select(*claims.columns, "reason", verdict.alias("verdict"))
