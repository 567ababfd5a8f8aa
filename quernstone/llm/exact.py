"""Exact dedup on full bytes with Patricia tries.

1. Map side: each task inserts the normalised bytes (A-Z lower-cased, nothing else) of its rows into a compressed radix
   trie, so that equal texts leave the task once, with their best row and their count. Rows that lost are dropped
   whenever the rows held exceed ``HELD`` bytes; if the distinct texts alone do, the largest subtrees below the root are
   spilled, that is sent on, until half is left.
2. Rows are hash-partitioned and sorted by (length, content hash). Each such pair is a subtree of its own: its full byte
   strings are inserted into a radix trie, whose terminal nodes hold the owner, and it is emitted and dropped as soon as
   the pair has passed. So a task holds no more than the distinct texts of one (length, 64-bit hash) at a time.
3. Texts that make up more than one row in ``HOT`` are found by counting hashes first; there are fewer than ``HOT`` of
   them, whatever the table's size. They take a way of their own, in which step 2 is done in ``SALTS`` parts before it is
   done for the whole, so no task receives a hot text from every map task.

The owner is the row with the largest doc_id (``largest=True``) or the smallest.

Defined results: null text equals empty text; a null doc_id is smaller than any other; rows that repeat a doc_id and a
text count each, and one of them stays in :func:`keep_exact`; an empty table gives an empty table; all other columns,
whatever their names, are carried by :func:`keep_exact` and ignored by :func:`exact_groups`.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm import worker
from quernstone.llm.names import spare

HELD, HOT, SALTS = 48 << 20, 1000, 64
_STEMS = ("text_bytes", "text_hash", "text_rows", "text_salt")


class PatriciaTrie:
    """A compressed radix trie over byte strings; a node is [label, children by first byte, terminal value]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def find_or_add(self, key: bytes) -> list:
        """The terminal node of ``key``; its value (index 2) is None when the key is new."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                return node
            child = node[1].get(key[at])
            if child is None:
                leaf = [key[at:], {}, None]
                node[1][key[at]] = leaf
                return leaf
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = self._common(label, key, at)
            middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = middle
            node, at = middle, at + same

    @staticmethod
    def _common(label: bytes, key: bytes, at: int) -> int:
        lo, hi = 1, min(len(label), len(key) - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if key.startswith(label[:mid], at):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def terminals(self, below: list | None = None) -> Iterator[list]:
        stack = [self.root if below is None else below]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node
            stack.extend(node[1].values())


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _better(a: int | None, b: int | None, largest: bool) -> bool:
    """Whether id a takes the place of id b."""
    if a is None or b is None:
        return (b is None and a is not None) if largest else (a is None and b is not None)
    return a > b if largest else a < b


def _local(largest: bool, own: list[str]):
    """Equal texts of a task as one row; ``own`` names the columns added: bytes, hash, number of rows, salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        # a terminal's value: place in the rows held, doc_id, bytes, hash, number of rows
        held: list[pa.Table] = []
        trie, distinct, kept, rows = PatriciaTrie(), 0, 0, 0
        context = TaskContext.get()
        salt = context.partitionId() % SALTS if context else 0

        def winners(nodes: list[list]) -> pa.Table:
            """The rows of these terminals alone, copied out of the batches they came in; the terminals know their new places."""
            nodes.sort(key=lambda n: n[2][0])
            table = pa.concat_tables(held).take(pa.array([n[2][0] for n in nodes], pa.int64())).combine_chunks()
            for place, n in enumerate(nodes):
                n[2][0] = place
            return table

        def emit(nodes: list[list]) -> Iterator[pa.RecordBatch]:
            if nodes:
                table = winners(nodes)
                for name, kind, k in zip(own, (pa.int64(), pa.int64(), pa.int64()), (2, 3, 4)):
                    table = table.append_column(name, pa.array([n[2][k] for n in nodes], kind))
                table = table.append_column(own[3], pa.array(np.full(len(nodes), salt, np.int32)))
                yield from table.to_batches(max_chunksize=2000)

        def shrink() -> Iterator[pa.RecordBatch]:
            """Drop the rows that lost; where the distinct texts alone are too many, spill the largest subtrees."""
            nonlocal held, distinct, kept, rows
            if distinct > HELD // 2:
                size = {b: sum(n[2][2] for n in trie.terminals(child)) for b, child in trie.root[1].items()}
                for b in sorted(size, key=size.get, reverse=True):
                    if distinct <= HELD // 4:
                        break
                    yield from emit(spilled := list(trie.terminals(trie.root[1].pop(b))))
                    distinct -= sum(n[2][2] for n in spilled)
                    # places of what stays are those in the batches still, emit has moved only its own
            left = list(trie.terminals())
            held = [winners(left)] if left else []
            rows = len(left)
            kept = held[0].nbytes if held else 0

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                held.append(pa.Table.from_batches([part]))
                for k, (i, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())):
                    key = normalised(text)
                    node = trie.find_or_add(key)
                    if node[2] is None:
                        node[2] = [rows + k, i, len(key), xxhash.xxh3_64_intdigest(key) - 2**63, 1]
                        distinct += len(key)
                    else:
                        node[2][4] += 1
                        if _better(i, node[2][1], largest):
                            node[2][0], node[2][1] = rows + k, i
                rows += part.num_rows
                kept += part.nbytes
                if kept > HELD:
                    yield from shrink()
        yield from emit(list(trie.terminals()))

    return run


def _merge(largest: bool, own: list[str]):
    """Over rows sorted by (length, hash): one row per distinct text, with the rows it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        trie, current = PatriciaTrie(), None

        def emit(nodes: list[list]) -> Iterator[pa.RecordBatch]:
            if nodes:
                rows = pa.concat_tables([node[2][0] for node in nodes])
                k = rows.schema.get_field_index(own[2])
                rows = rows.set_column(k, own[2], pa.array([node[2][2] for node in nodes], pa.int64()))
                yield from rows.combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(batch.column(own[0]).to_pylist(), batch.column(own[1]).to_pylist()))
            ids, texts, counts = (batch.column(c).to_pylist() for c in ("doc_id", "text", own[2]))
            done: list[list] = []
            for k, key in enumerate(keys):
                if key != current:
                    done.extend(trie.terminals())
                    trie, current = PatriciaTrie(), key
                node = trie.find_or_add(normalised(texts[k]))
                if node[2] is None:
                    node[2] = [table.slice(k, 1), ids[k], counts[k]]
                else:
                    node[2][2] += counts[k]
                    if _better(ids[k], node[2][1], largest):
                        node[2][:2] = [table.slice(k, 1), ids[k]]
            yield from emit(done)
        yield from emit(list(trie.terminals()))

    return run


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def _key() -> Column:
    """The same number for texts that are equal after lower-casing A-Z (and for some that are not)."""
    return F.xxhash64(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def hot_keys(docs: DataFrame) -> list[int]:
    """Keys that more than one row in ``HOT`` has, fewer than ``HOT`` of them; only hashes and counts are shuffled."""
    counts = docs.groupBy(_key().alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rows = docs.count()
    return sorted(r.key for r in counts.filter(F.col("n") * HOT > max(rows, HOT)).select("key").collect())


def _distinct_texts(docs: DataFrame, largest: bool, hot: bool) -> tuple[DataFrame, list[str]]:
    """One row per distinct text with all columns of ``docs`` and the four of ``own``, whose names are returned."""
    own = spare(docs, *_STEMS)
    schema = f"{_schema(docs)}, `{own[0]}` bigint, `{own[1]}` bigint, `{own[2]}` bigint, `{own[3]}` int"
    out = docs.mapInArrow(_local(largest, own), schema)
    for keys in ([own[0], own[1], own[3]], [own[0], own[1]]) if hot else ([own[0], own[1]],):
        out = out.repartition(*[F.col(f"`{c}`") for c in keys]).sortWithinPartitions(*[F.col(f"`{c}`") for c in keys]).mapInArrow(_merge(largest, own), schema)
    return out, own


def _ways(docs: DataFrame) -> list[tuple[DataFrame, bool]]:
    """The rows of hot texts, if there are any, and all others."""
    hot = hot_keys(docs)
    if not hot:
        return [(docs, False)]
    is_hot = _key().isin(hot)
    return [(docs.filter(~is_hot), False), (docs.filter(is_hot), True)]


def keep_exact(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows that stay, with all their columns: one per distinct normalised text."""
    kept = [_distinct_texts(part, largest, hot) for part, hot in _ways(docs)]
    return functools.reduce(DataFrame.unionByName, [rows.drop(*own) for rows, own in kept])


def _digest(name: str, schema: str):
    """Rows with the digest of the normalised text in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            sha = [hashlib.sha256(normalised(t)).hexdigest() for t in batch.column("text").to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(sha, pa.string())], [*rest, name])

    return lambda df: df.mapInArrow(run, f"{schema}, {name} string")


def exact_groups(docs: DataFrame, largest: bool = True) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are joined with their owners on the digest of the text. The owners of hot texts are fewer than ``HOT``, so they
    are broadcast, and rows of a hot text stay where they are.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for part, hot in _ways(narrow):
        rows, own = _distinct_texts(part, largest, hot)
        named = rows.select("text", F.col("doc_id").alias("keep_id"), F.col(own[2]).alias("group_size"))
        owners = _digest("text_sha256", "keep_id bigint, group_size bigint")(named)
        each = _digest("text_sha256", "doc_id bigint")(part)
        parts.append(each.join(F.broadcast(owners) if hot else owners, "text_sha256"))
    return functools.reduce(DataFrame.unionByName, parts).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
