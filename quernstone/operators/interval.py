"""Interval, band and point-in-range joins (J5-J7) as equi-joins on blocks of the axis.

A range is cut into the blocks it touches, so that a range join is a hash join on (key, block) with a residual test and
never a nested loop. A pair is reported in one block only: the one in which the later of the two begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _block(x: Column, width: int) -> Column:
    return F.floor(x / width)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, width: int) -> DataFrame:
    """Pairs with equal keys and overlapping [lo, hi); columns of the right side get the prefix ``r_``."""
    a = left.withColumn("_b", F.explode(F.sequence(_block(F.col(lo), width), _block(F.col(hi) - 1, width))))
    b = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])
    b = b.withColumn("_b", F.explode(F.sequence(_block(F.col(f"r_{lo}"), width), _block(F.col(f"r_{hi}") - 1, width))))
    test = (F.col(lo) < F.col(f"r_{hi}")) & (F.col(f"r_{lo}") < F.col(hi))
    once = F.col("_b") == _block(F.greatest(F.col(lo), F.col(f"r_{lo}")), width)
    return a.join(b, [*keys, "_b"]).filter(test & once).drop("_b")


def point_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Each point with the ranges [lo, hi) of its key that hold it."""
    p = points.withColumn("_b", _block(F.col(at), width))
    r = ranges.withColumn("_b", F.explode(F.sequence(_block(F.col(lo), width), _block(F.greatest(F.col(hi) - 1, F.col(lo)), width))))
    return p.join(r, [*keys, "_b"]).filter((F.col(lo) <= F.col(at)) & (F.col(at) < F.col(hi))).drop("_b")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, within: int) -> DataFrame:
    """Pairs with equal keys and ``abs(left.at - right.at) <= within`` (J6); the right side gets the prefix ``r_``."""
    a = left.withColumn("_b", _block(F.col(at), within + 1))
    b = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])
    here = _block(F.col(f"r_{at}"), within + 1)
    b = b.withColumn("_b", F.explode(F.array(here - 1, here, here + 1)))
    return a.join(b, [*keys, "_b"]).filter(F.abs(F.col(at) - F.col(f"r_{at}")) <= within).drop("_b")


def fit_class(lo: str, hi: str, r_lo: str, r_hi: str) -> Column:
    """How the second range fits the first: exact, longer, shorter or partial (Q16)."""
    return (
        F.when((F.col(lo) == F.col(r_lo)) & (F.col(hi) == F.col(r_hi)), "exact")
        .when((F.col(r_lo) <= F.col(lo)) & (F.col(r_hi) >= F.col(hi)), "longer")
        .when((F.col(r_lo) >= F.col(lo)) & (F.col(r_hi) <= F.col(hi)), "shorter")
        .otherwise("partial")
    )
