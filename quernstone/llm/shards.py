"""Sharding along a Hilbert curve, with DataFrame expressions only.

Several metadata dimensions are quantised into at most ``2**bits`` cells each, each row gets the index of its cell on a
Hilbert curve over these dimensions, and the curve is cut into runs of equal row counts: every shard is then a compact
box in all dimensions at once, so a reader that filters on any of them can skip most files by their min/max.

The global rank needs no sort of the table by one task. Rows are counted per (cell, salt of doc_id); the running sum of
these counts (at most ``2**(bits*dims) * salts`` rows, whatever the table's size) gives each small group its offset, and
a window per (cell, salt) gives the rest. A cell that holds a third of all rows is split by the salt.

Defined results: null text has no bytes (size 16, crc 0); null metadata go to the lowest cell; rows of one cell are in an
order that all their columns decide (salt and ties by a hash of the row), so null and repeated ids have fixed slots, and
only rows equal in all columns may change places; an empty table gives an empty table; more columns are kept by
:func:`assign_shards`, whatever their names, unless a column of the result has the same name, which then wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.names import spare

BITS, SALTS = 4, 64


def hilbert_table(dims: int) -> list[int]:
    """Transitions of the curve: entry ``state * 2**dims + cell`` holds ``next_state * 2**dims + digit``.

    A state is (entry corner, direction); the rules are those of the Gray-code construction of the curve.
    """
    size = 1 << dims

    def rot_right(x: int, k: int) -> int:
        k %= dims
        return ((x >> k) | (x << (dims - k))) & (size - 1)

    def rot_left(x: int, k: int) -> int:
        return rot_right(x, dims - k % dims)

    def gray(w: int) -> int:
        return w ^ (w >> 1)

    inverse = {gray(w): w for w in range(size)}

    def trailing(w: int) -> int:
        return ((w ^ (w + 1)).bit_length() - 1) if w + 1 else 0

    def entry(w: int) -> int:
        return 0 if w == 0 else gray(2 * ((w - 1) // 2))

    def direction(w: int) -> int:
        return 0 if w == 0 else (trailing(w - 1) if w % 2 == 0 else trailing(w)) % dims

    out = []
    for state in range(size * dims):
        e, d = divmod(state, dims)
        for cell in range(size):
            w = inverse[rot_right(cell ^ e, d + 1)]
            e2 = e ^ rot_left(entry(w), d + 1)
            d2 = (d + direction(w) + 1) % dims
            out.append((e2 * dims + d2) * size + w)
    return out


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the curve of a cell given by integer columns below ``2**bits``."""
    dims = len(cells)
    cells = [c.cast("int") for c in cells]
    moves = F.expr(f"array({','.join(map(str, hilbert_table(dims)))})")

    def step(acc: Column, level: Column) -> Column:
        corner = F.lit(0)
        for j, c in enumerate(cells):
            corner = corner + F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)) * (1 << j)
        move = F.element_at(moves, acc["s"] * (1 << dims) + corner + 1)
        return F.struct(
            (acc["h"] * (1 << dims) + (move % (1 << dims))).cast("long").alias("h"), F.floor(move / (1 << dims)).cast("int").alias("s")
        )

    first = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), first, step, lambda acc: acc["h"])


def _number(df: DataFrame, name: str) -> Column:
    """A dimension as an order-preserving number: strings by their first seven bytes."""
    if dict(df.dtypes)[name] == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(name), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def quantise(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Adds one column of cells per dimension after all others, cut at approximate quantiles (2**bits-1 numbers each).

    The numbers are projected once, below the comparisons, so that no string is converted for each cut anew.
    """
    number, cell = (spare(df, *[f"{stem}{k}" for k in range(len(dims))]) for stem in ("number", "cell"))
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.select([_number(df, d).alias(d) for d in dims]).agg(*[F.percentile_approx(d, share, 2000).alias(d) for d in dims]).first()
    numbers = df.select("*", *[_number(df, d).alias(number[k]) for k, d in enumerate(dims)])
    cells = []
    for k, d in enumerate(dims):
        bounds = sorted(set(cuts[d] or []))
        at = F.lit(0)
        for n, b in enumerate(bounds):  # the first that holds wins, so from the highest cut down
            at = F.when(F.col(number[k]) >= F.lit(b), n + 1).otherwise(at) if n else F.when(F.col(number[k]) >= F.lit(b), 1).otherwise(0)
        cells.append(at.cast("int").alias(cell[k]))
    return numbers.select(*[F.col(f"`{c}`") for c in df.columns], *cells)


def assign_shards(docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = BITS, salts: int = SALTS) -> DataFrame:
    """Adds ``curve`` (Hilbert index), ``shard`` and ``slot`` (gapless from 0); row counts differ by one at most."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("curve", "shard", "slot")]
    salt, tie, before, all_, place, of = spare([*docs.columns, "curve", "shard", "slot"], "salt", "tie", "before", "all", "place", "of")
    celled = quantise(docs, list(dims), bits)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    placed = celled.select(*kept, hilbert_index([F.col(c) for c in celled.columns[len(docs.columns) :]], bits).alias("curve"), whole.alias(tie))
    placed = placed.withColumn(salt, F.pmod(F.col(tie), F.lit(salts)).cast("int"))
    every = Window.orderBy("curve", salt).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("curve", salt).agg(F.count(F.lit(1)).alias(of))
    total = F.sum(of).over(Window.partitionBy())
    # At most 2**(bits*dims) * salts rows (262,144 by default), however large the table: safe to window in one task and to broadcast.
    offsets = counts.select("curve", salt, F.coalesce(F.sum(of).over(every), F.lit(0)).alias(before), total.alias(all_))
    inside = Window.partitionBy("curve", salt).orderBy("doc_id", tie)
    ranked = placed.withColumn(place, F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["curve", salt])
    rank = F.col(before) + F.col(place)
    # the first (total mod shards) shards hold one row more
    base, extra = F.floor(F.col(all_) / shards), F.col(all_) % shards
    big = extra * (base + 1)
    shard = F.when(rank < big, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - big) / F.greatest(base, F.lit(1))))
    begins = F.when(F.col("shard") < extra, F.col("shard") * (base + 1)).otherwise(big + (F.col("shard") - extra) * base)
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (rank - begins).cast("long"))
        .select(*kept, "curve", "shard", "slot")
    )


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document; text is reduced to its size and checksum before anything is shuffled."""
    small = docs.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    return assign_shards(small, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, **how) -> None:
    """Write whole rows as Parquet, one folder per shard, rows in slot order within it."""
    placed = assign_shards(docs, shards, **how)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
