"""Near-duplicate groups with min-max hashing.

Each document's set of k-word shingles is hashed under ``PERMS`` random permutations of 32-bit numbers, and both the
minimum and the maximum under each are kept, so a signature of ``2*PERMS`` values costs half the hash evaluations. A
band is three permutations (six values); at a similarity of 0.8 a pair of large sets shares none of the 45 bands with a
probability of 1e-6 (of the smallest sets, four shingles in five: 2e-5).

Candidates are confirmed on the full sets, and never by all pairs of a bucket:

1. texts with equal sets are one class, whatever their number; a class is a node with a number of its own, so that one
   doc_id may stand in several;
2. in each band bucket only the smallest class is known to the others (a ``min`` that combines on the map side), and
   each class is compared with the smallest one it meets in any bucket;
3. confirmed links are turned into components. What is left are classes that met in a bucket but are in different
   components. Of these the rarest shingles are taken, as many as two sets of that similarity cannot both lack
   (``n - ceil(percent * n / 100) + 1``; rarity by counts in a table of fixed size, equal for all), and those that share
   one are compared. This is exact and leaves out what merely comes from one template. One text is sent to where the
   other is, in chunks of ``CHUNK`` members per leader, so no leader is one task.

The similarity test is in integers: ``100 * |A & B| >= percent * |A | B|``.

Defined results: null or empty text has an empty set, size 0, and links with nothing; fewer than k words make one
shingle of the whole sequence; a row belongs to the component of its own text, so rows that repeat a doc_id with other
texts may have different components, and each keeps all its links; a null doc_id takes part in no link, has a null
component and is kept; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import wordhash, worker
from quernstone.llm.components import connected_components
from quernstone.llm.names import spare
from quernstone.session import cut

PERMS, PER_BAND, CHUNK = 135, 3, 256
RARITY = 1 << 18
_RNG = np.random.default_rng(7)
_A = (_RNG.integers(0, 2**31, PERMS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, PERMS, dtype=np.uint32)
_FOLD = _RNG.integers(1, 2**63, 2 * PER_BAND, dtype=np.uint64) | np.uint64(1)


def min_max(shingles: np.ndarray) -> np.ndarray:
    """2 x PERMS values: minima and maxima of the set under each permutation."""
    low, high = np.full(PERMS, 2**32 - 1, np.uint32), np.zeros(PERMS, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        h = _A[:, None] * x[None, at : at + 1024]
        h += _B[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.stack([low, high])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, 2, PERMS) signatures -> (n, bands) 64-bit keys that hold the band's number."""
    n = len(signatures)
    bands = PERMS // PER_BAND
    parts = signatures.astype(np.uint64).reshape(n, 2, bands, PER_BAND).transpose(0, 2, 1, 3).reshape(n, bands, 2 * PER_BAND)
    keys = (wordhash.mix(parts * _FOLD + np.uint64(1)) * _FOLD[::-1]).sum(axis=2, dtype=np.uint64)
    return wordhash.mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = wordhash.shingle_sets(batch.column("text"), k)
                sizes = np.array([len(s) for s in sets], np.int64)
                filled = np.flatnonzero(sizes)
                keys = band_keys(np.stack([min_max(sets[j]) for j in filled])) if len(filled) else np.zeros((0, PERMS // PER_BAND), np.int64)
                bands: list = [None] * len(sets)
                ids: list = [None] * len(sets)
                for row, j in enumerate(filled.tolist()):
                    bands[j] = keys[row].astype("<i8").tobytes()
                    ids[j] = xxhash.xxh3_128_digest(sets[j].tobytes())
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes), pa.array(ids, pa.binary()), pa.array(bands, pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "set_id", "bands"],
                )

    return run


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.release()
    per = PERMS // PER_BAND
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i8")
            rep, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), per) for c in ("rep", "n"))
            yield pa.record_batch([pa.array(keys), pa.array(rep), pa.array(n)], ["key", "rep", "n"])


def _confirm(k: int, percent: int):
    """Over rows sorted by (leader, chunk, member): the leader's own row comes first (member null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        leader, own = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = wordhash.shingle_sets(batch.column("text"), k)
                found: list[tuple[int, int]] = []
                for a, c, b, s in zip(*(batch.column(x).to_pylist() for x in ("leader", "chunk", "member")), sets):
                    if b is None:
                        leader, own = (a, c), s
                        continue
                    assert leader == (a, c)
                    inter = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * inter >= percent * (len(own) + len(s) - inter):
                        found.append((b, a))
                yield pa.record_batch([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], ["src", "dst"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(leader, member) pairs -> confirmed (src, dst). ``texts``: (rep, text), one row per class.

    Members of one leader are cut into chunks by hash; each chunk gets a copy of the leader's text.
    """
    counts = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("c"))
    chunked = pairs.join(counts, "leader").select(
        "leader", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("c") / CHUNK)).cast("int").alias("chunk")
    )
    chunked = cut(chunked)
    heads = chunked.select("leader", "chunk").distinct().select(F.col("leader").alias("rep"), "leader", "chunk", F.lit(None).cast("long").alias("member"))
    wanted = chunked.select(F.col("member").alias("rep"), "leader", "chunk", "member").unionByName(heads)
    there = wanted.join(texts, "rep").select("leader", "chunk", "member", "text")
    return (
        there.repartition("leader", "chunk")
        .sortWithinPartitions("leader", "chunk", F.col("member").asc_nulls_first())
        .mapInArrow(_confirm(k, percent), "src bigint, dst bigint")
    )


def _shingle_counts(k: int):
    """How many sets have a shingle of each of ``RARITY`` hash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        total = np.zeros(RARITY, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                for s in wordhash.shingle_sets(whole.column("text").slice(at, 1000), k):
                    total += np.bincount((s >> np.uint64(40)) % np.uint64(RARITY), minlength=RARITY)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["value", "n"])

    return run


def _rarest(k: int, percent: int, often: np.ndarray):
    """The shingles of each set that no set of the wanted similarity can lack all of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys, sizes = [np.zeros(0, np.uint64)], []
                for s in wordhash.shingle_sets(batch.column("text"), k):
                    order = np.argsort(often[((s >> np.uint64(40)) % np.uint64(RARITY)).astype(np.int64)], kind="stable")  # ties by hash
                    keys.append(s[order[: len(s) + percent * -len(s) // 100 + 1]])
                    sizes.append(len(keys[-1]))
                row = np.repeat(np.arange(batch.num_rows), sizes)
                rest = [batch.column(c).take(pa.array(row)) for c in ("rep", "n", "comp")]
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), *rest], ["shingle", "rep", "n", "comp"])

    return run


def _residual(open_: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(leader, member) of the (rep, n, comp) given: in different components, of fitting sizes, and with a rare shingle in common."""
    with_text = cut(open_.join(texts, "rep"))
    often = np.zeros(RARITY, np.int32)
    counted = with_text.select("text").mapInArrow(_shingle_counts(k), "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
    told = counted.toArrow()  # at most RARITY rows, 4 MB
    often[told.column("value").to_numpy()] = np.minimum(told.column("n").to_numpy(), np.iinfo(np.int32).max)
    rare = with_text.mapInArrow(_rarest(k, percent, often), "shingle bigint, rep bigint, n bigint, comp bigint")
    several = rare.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("shingle")
    met = cut(rare.join(several, "shingle"))
    a, b = met.alias("a"), met.alias("b")
    return (
        a.join(b, F.col("a.shingle") == F.col("b.shingle"))
        .filter((F.col("a.rep") < F.col("b.rep")) & (F.col("a.comp") != F.col("b.comp")))
        .filter(F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent)
        .select(F.col("a.rep").alias("leader"), F.col("b.rep").alias("member"))
        .distinct()
    )


def near_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_key (xxhash64 of the text), n_shingles, component_id (smallest doc_id reachable), kept."""
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    signed = cut(narrow.mapInArrow(_sign(k), "doc_id bigint, text_key bigint, n_shingles bigint, set_id binary, bands binary"))
    usable = signed.filter(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull())
    classes = usable.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "bands")).alias("r"))
    reps = cut(classes.select("set_id", F.monotonically_increasing_id().alias("rep"), "r.doc_id", "r.text_key", F.col("r.n_shingles").alias("n"), "r.bands"))
    rows = reps.select("rep", "n", "bands").mapInArrow(_explode_bands, "key bigint, rep bigint, n bigint")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("first")).filter("c > 1").select("key", "first")
    buckets = cut(rows.join(shared, "key"))
    star = buckets.filter("rep <> first").groupBy(F.col("rep").alias("member")).agg(F.min("first").alias("leader")).select("leader", "member")
    met = reps.select("rep", "doc_id", "text_key").join(buckets.select("rep").distinct(), "rep", "left_semi")
    texts = cut(narrow.join(met, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("rep", "text"))
    links = cut(confirm(star, texts, k, percent))
    labels = connected_components(links)
    # what step 2 left open: one bucket, two components
    placed = buckets.join(labels, buckets["rep"] == labels["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    open_ = cut(placed.join(mixed, "key", "left_semi").select("rep", "n", "comp").distinct())
    if open_.limit(1).count():
        more = cut(confirm(_residual(open_, texts, k, percent), texts, k, percent))
        labels = connected_components(links.union(more))
    linked = labels.join(reps.select(F.col("rep").alias("node"), "doc_id"), "node")
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("first_doc"))
    of_rep = linked.join(smallest, "component").select(F.col("node").alias("rep"), "first_doc")
    final = reps.select("set_id", "rep", "doc_id").join(of_rep, "rep", "left").select(F.col("set_id").alias("key"), F.coalesce("first_doc", "doc_id").alias("comp"))
    # rows without a set get keys of their own, which no set has, so that they do not meet in one task
    key = F.coalesce("set_id", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0").cast("binary"))
    out = signed.select("doc_id", "text_key", "n_shingles", key.alias("key")).join(final, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("comp"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    return near_rows(docs, k, percent).drop("text_key")


def keep_near(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, with all their columns: of each component those of its smallest doc_id.

    Rows are told apart by doc_id and text, so that a row goes for its own text only. Should the smallest doc_id of a
    component have several texts in it (they are near copies of each other), all of these rows are that document.
    """
    gone = near_rows(docs, k, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct()
    id_, key, d, t = spare(docs, "row_id", "row_key", "gone_id", "gone_key")
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), key: F.xxhash64(F.col("text").cast("string"))})
    gone = gone.select(F.col("d").alias(d), F.col("t").alias(t))
    return keyed.join(gone, (F.col(id_) == F.col(d)) & (F.col(key) == F.col(t)), "left_anti").drop(id_, key)
