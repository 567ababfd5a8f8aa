"""Bounded samples by the hash of an id: the same rows at any size, and no more than about the bound at the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(ids: DataFrame, want: int, seed: int) -> list[int]:
    """At most ``want`` distinct doc_ids, those with the smallest hashes.

    Rows are counted first, and only hashes below the share that holds about 1.3 times as many as wanted leave the
    executors, so that what reaches the driver does not grow with the number of partitions either.
    """
    rows = ids.select("doc_id").filter("doc_id is not null")
    n = rows.count()
    if not n:
        return []
    share = int(min(1.0, (1.3 * want + 30) / n) * (1 << 40))
    order = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    picked = rows.select(order.alias("h"), "doc_id").filter(F.col("h") < share).distinct().collect()
    return [r.doc_id for r in sorted(picked)[:want]]
