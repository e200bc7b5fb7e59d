"""Exact deduplication by Patricia-trie owners.

Texts are equal when identical after lower-casing A-Z.  Map tasks collapse
their own copies in a radix trie, so that a group of copies, however large,
leaves at most a few rows per task.  The distinct texts then go to partitions
by length and content hash, where a compressed radix trie over the full byte
strings decides equality and its terminal nodes store the owner's identifier.
A trie above its memory budget spills whole subtrees to a temporary file and
takes them up one after the other at the end.  Documents learn their owner in a
join of the tasks' groups (digest and identifiers, no texts) with the owners.

Defined results for odd input: a null text counts as empty; empty texts form
one group.  A null identifier loses to any other.  Repeated rows (same
identifier and text) are copies of one another, counted each; all of them carry
the owner's identifier, and exactly one row is marked as kept.  Extra columns
play no part.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import met, tidy, written
from .textkernel import LOWER_TABLE, PIECE, slices


class _Node:
    __slots__ = ("edge", "kids", "value")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.kids, self.value = edge, None, value


class PatriciaTrie:
    """Compressed radix trie from byte strings to values, merged by ``merge(old, new)``.

    ``budget`` bounds the bytes held; beyond it the heaviest subtree below the
    first fork is written to a temporary file, together with every later string
    that belongs there.
    """

    #: Bytes a node takes besides its edge.
    NODE = 200

    def __init__(self, merge, budget: int = 128 << 20):
        self.merge, self.budget = merge, budget
        self.root = _Node(b"")
        self.held = 0
        self.spilled: dict[bytes, tempfile._TemporaryFileWrapper] = {}

    def insert(self, key: bytes, value) -> None:
        for prefix, file in self.spilled.items():
            if key.startswith(prefix):
                pickle.dump((key, value), file)
                return
        self._insert(key, value)
        if self.held > self.budget:
            self._spill()

    def _insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                if node.kids is None:
                    node.kids = {}
                node.kids[key[at]] = _Node(key[at:], value)
                self.held += len(key) - at + self.NODE
                return
            edge = kid.edge
            if key.startswith(edge, at):
                node, at = kid, at + len(edge)
                continue
            same = self._common(edge, key, at)
            fork = _Node(edge[:same])
            kid.edge = edge[same:]
            fork.kids = {kid.edge[0]: kid}
            node.kids[key[at]] = fork
            self.held += self.NODE
            node, at = fork, at + same

    @staticmethod
    def _common(edge: bytes, key: bytes, at: int) -> int:
        lo, hi = 1, min(len(edge), len(key) - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if edge[:mid] == key[at : at + mid]:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.edge
            if node.value is not None:
                yield prefix, node.value
            if node.kids:
                stack += [(k, prefix) for k in node.kids.values()]

    def _weight(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.edge) + self.NODE
            stack += x.kids.values() if x.kids else ()
        return total

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while node.kids and len(node.kids) == 1:
            node = next(iter(node.kids.values()))
            prefix += node.edge
        if not node.kids:
            return
        weights = {k: self._weight(v) for k, v in node.kids.items()}
        first = max(weights, key=weights.get)
        file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)  # where the executor spills too
        for item in self._walk(node.kids.pop(first), prefix):
            pickle.dump(item, file)
        self.held -= weights[first]
        self.spilled[prefix + bytes([first])] = file

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All strings with their values; spilled subtrees follow, each in a trie of its own."""
        yield from self._walk(self.root, b"")
        self.root = _Node(b"")
        for file in self.spilled.values():
            sub = PatriciaTrie(self.merge, self.budget)
            file.seek(0)
            while True:
                try:
                    key, value = pickle.load(file)
                except EOFError:
                    break
                sub.insert(key, value)
            file.close()
            yield from sub.items()
        self.spilled = {}


def _merge(largest: bool):
    """Of values (best identifier, documents, documents with that identifier)."""

    def merge(x, y):
        if x[0] == y[0]:
            return (x[0], x[1] + y[1], x[2] + y[2])
        best = y if x[0] is None or (y[0] is not None and (y[0] > x[0]) == largest) else x
        return (best[0], x[1] + y[1], best[2])

    return merge


_OWNER = "best long, n long, copies long"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Record batches of rows; the row's column ``size`` (a number of bytes) bounds a batch."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += row[size]
        if total > 4 * PIECE or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_ID = pa.int64()
_HEAD = [("sha", pa.string()), ("length", _ID)]
_MEMBERS = pa.schema([*_HEAD, ("place", _ID), ("ids", pa.list_(_ID))])
_LOCAL = pa.schema([*_HEAD, ("best", _ID), ("n", _ID), ("copies", _ID), ("body", pa.binary())])
_OWNERS = pa.schema([*_HEAD, ("keep_id", _ID), ("group_size", _ID), ("copies", _ID)])


def _local(df: DataFrame, key: str, text: str, keep: str, budget: int, members: bool) -> DataFrame:
    """Per map task, its distinct normalised texts, with the text and the local owner, or with the members' identifiers.

    ``place`` numbers the tries of all tasks; a trie's identifiers count in its budget.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = (lambda x, y: x + y) if members else _merge(keep == "largest")
        trie, place = PatriciaTrie(merge, 1 << 62), TaskContext.get().partitionId() << 32

        def flush():
            digest = lambda t: hashlib.sha256(t).hexdigest()
            if members:
                return _batches(((digest(t), len(t), place, v) for t, v in trie.items()), _MEMBERS, 1)
            return _batches(((digest(t), len(t), *v, t) for t, v in trie.items()), _LOCAL, 1)

        for batch in batches:
            for part in slices(batch, text):
                for i, t in zip(part.column(key).to_pylist(), part.column(text).to_pylist(), strict=True):
                    body = (t or "").encode().translate(LOWER_TABLE)
                    trie.insert(body, [i] if members else (i, 1, 1))
                    trie.held += 8 * members
                if trie.held > budget:
                    yield from flush()
                    trie, place = PatriciaTrie(merge, 1 << 62), place + 1
        yield from flush()

    schema = "sha string, length long, " + ("place long, ids array<long>" if members else f"{_OWNER}, body binary")
    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(tidy(run), schema)


def owners(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest", budget: int = 64 << 20, local_budget: int = 32 << 20) -> DataFrame:
    """One row per distinct text: sha (of the normalised text), length, keep_id, group_size, and
    ``copies``, the number of rows with the owner's identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(_merge(keep == "largest"), budget)
        for batch in batches:
            for *value, body in zip(*[batch.column(c).to_pylist() for c in ("best", "n", "copies", "body")], strict=True):
                trie.insert(body, tuple(value))
        rows = ((hashlib.sha256(body).hexdigest(), len(body), *v) for body, v in trie.items())
        yield from _batches(rows, _OWNERS, 1)

    dealt = _local(df, key, text, keep, local_budget, members=False).repartition("length", "sha")
    return dealt.mapInArrow(tidy(run), "sha string, length long, keep_id long, group_size long, copies long")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest", local_budget: int = 32 << 20) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    The join carries one row per group and trie, which is then expanded to its documents;
    groups with more than a thousandth of all documents are met by broadcast.
    """
    keys = ["sha", "length"]
    own, _ = written(owners(df, key, text, keep, local_budget=local_budget), "owners")
    members, _ = written(_local(df, key, text, keep, local_budget, members=True), "group-members")
    own = own.withColumn("c", F.col("group_size"))
    total = own.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    several = own.filter("copies > 1")
    if several.isEmpty():
        own = own.withColumn("first", F.lit(None).cast("long"))
    else:
        # Of repeated rows of an owner one stays: in the first trie that has it, the first of its identifiers there.
        place = met(members, several, keys, total).filter(F.exists("ids", lambda i: i.eqNullSafe(F.col("keep_id"))))
        own = own.join(place.groupBy(*keys).agg(F.min("place").alias("first")), keys, "left")
    rows = met(members, own, keys, total).select("*", F.posexplode("ids").alias("__pos", key))
    at = F.coalesce(F.array_position("ids", F.col("keep_id")) - 1, F.lit(0))
    stays = F.col("first").isNull() | ((F.col("place") == F.col("first")) & (F.col("__pos") == at))
    return rows.select(key, "keep_id", "group_size", (F.col(key).eqNullSafe(F.col("keep_id")) & stays).alias("kept"), F.col("sha").alias("text_sha256"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
