"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct 5-word shingles.  Two sets with
sizes a <= b and Jaccard similarity of 0.8 or more have b <= a / 0.8 and differ in
at most a / 4 elements.  Sizes are cut into windows; a pair belongs to the window
of its smaller size, and every set signs in each window that its size can meet.
A window's signatures partition the hash range into ``n1`` parts of ``n2`` cells:
with at most k differences, at least ``n1 - k // (k2 + 1)`` parts hold no more than
``k2`` of them, and there some ``n2 - k2`` cells agree wholly, so both sets sign that
subset of cells alike.

Signatures over no element at all would match unrelated sets.  They are left out
wherever that loses nothing: a set with fewer such parts than a pair is bound to
agree in is safe.  Sets that are not safe sign again under another partition of
the hash range, and those unsafe in the last one sign everything there.  One
safe set of a pair is enough for the pair to meet, so no link is lost.

Signatures travel as packed arrays cut by hash.  Runs of equal signatures are
candidates: each member is first compared with the smallest member it meets;
then only runs that still span different components are looked at again, where
counts of differing cells (a lower bound of the difference) rule pairs out before
the sets themselves are compared.  Of the pairs left, a run first tries a forest:
where all its pairs are links, the run's other pairs are joined by them already;
where one fails, all the run's remaining pairs are compared.  Pairs are compared once.  Copies (equal sets) are collapsed first.

Defined results for odd input: a null or empty text has an empty set and is linked
with nothing; texts of fewer than five words have their whole word sequence as
one shingle.  Inside, a set under a null or repeated identifier goes by its own
64-bit hash, any other by its identifier, so different texts under one identifier
have each their own links, and each row reports its own.  A null identifier counts
as the largest.  Extra columns play no part.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .components import connected_components, joined_components
from .storage import add_columns, dealt_in_order, met, partitions, remove, tidy, written
from .textkernel import mix64, mix_int, slices, word_hashes

WORDS = 5
LEVELS = 3
#: Members of a run that one task compares at once.
BLOCK = 256


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    hashes, at = word_hashes(column)
    factor = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    many = max(0, len(hashes) - words + 1)
    value = np.zeros(many, dtype=np.uint64)
    for k in range(words):
        value += hashes[k : k + many] * factor[k]
    value = mix64(value)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(value[a : b - words + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            whole = (hashes[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(whole + np.uint64(mix_int(b - a))))
        else:
            out.append(value[:0])
    return out


@dataclass(frozen=True)
class Window:
    """Sizes [low, high) of a pair's smaller set; ``most`` is the largest size that can meet them."""

    low: int
    high: int
    most: int
    k: int
    n1: int
    n2: int
    k2: int

    @property
    def agree(self) -> int:
        """Parts in which a pair within k differences is bound to have a subset of cells alike."""
        return self.n1 - self.k // (self.k2 + 1)


@cache
def window(i: int) -> Window:
    """The i-th window; sizes below 32 go in steps of 4, then each window is a third longer than its start."""
    if i < 3:
        low, high = i + 1, i + 2
    elif i < 10:
        low, high = 4 * (i - 2), 4 * (i - 1)
    else:
        low = window(i - 1).high
        high = low + low // 3
    k = (high - 1) // 4
    if k == 0:
        shape = (1, 1, 0)
    elif k < 4:
        shape = (1, k + 3, k)
    elif k < 8:
        k2 = k // 2
        shape = (2, k2 + 3, k2)
    else:
        shape = (k // 2 + 2 + -(-15 * (k // 2) // 100), 3, 1)
    return Window(low, high, (high - 1) * 5 // 4, k, *shape)


def windows_of(size: int) -> list[int]:
    i = 0
    while window(i).most < size:
        i += 1
    out = []
    while window(i).low <= size:
        out.append(i)
        i += 1
    return out


@cache
def _windows_of(size: int) -> tuple[int, ...]:
    return tuple(windows_of(size))


class _Scheme:
    """Cell bounds, subsets and signature salts of a window at a level."""

    def __init__(self, i: int, level: int):
        w = self.window = window(i)
        cells = w.n1 * w.n2
        self.bounds = np.array([(c << 64) // cells for c in range(1, cells)], dtype=np.uint64)
        subsets = list(combinations(range(w.n2), w.n2 - w.k2))
        self.pick = np.zeros((w.n2, len(subsets)), dtype=np.uint64)
        for c, s in enumerate(subsets):
            self.pick[list(s), c] = 1
        self.salt = mix64(np.uint64(mix_int(i * LEVELS + level + 1)) + np.arange(w.n1 * len(subsets), dtype=np.uint64)).reshape(w.n1, -1)


@cache
def _scheme(i: int, level: int) -> _Scheme:
    return _Scheme(i, level)


def signatures(own: np.ndarray) -> list[np.ndarray]:
    """All signatures of one set, as arrays."""
    out = []
    if not len(own):
        return out
    prepared: list[tuple[np.ndarray, np.ndarray]] = []
    for i in _windows_of(len(own)):
        for level in range(LEVELS):
            if len(prepared) == level:
                h = own if not level else np.sort(mix64(own ^ np.uint64(mix_int(level))))
                sums = np.zeros(len(h) + 1, dtype=np.uint64)
                np.cumsum(mix64(h + np.uint64(0xA24BAED4963EE407)), out=sums[1:])
                prepared.append((h, sums))
            h, sums = prepared[level]
            s = _scheme(i, level)
            w = s.window
            edge = np.zeros(len(s.bounds) + 2, dtype=np.int64)
            edge[1:-1] = np.searchsorted(h, s.bounds)
            edge[-1] = len(h)
            at = sums[edge]
            total = (at[1:] - at[:-1]).reshape(w.n1, w.n2) @ s.pick
            full = (np.diff(edge).astype(np.uint64).reshape(w.n1, w.n2) @ s.pick) > 0
            signature = mix64(total ^ s.salt)
            safe = int((~full.all(axis=1)).sum()) < w.agree
            if safe or level + 1 < LEVELS:
                out.append(signature[full])
            else:
                out.append(signature.ravel())
            if safe:
                break
    return out


def _sketch(own: np.ndarray) -> bytes:
    """One byte per cell of the hash range, the sum of the cell's element hashes; cells are a power of two, half the size or more."""
    cells = _sketch_cells(len(own))
    place = (own >> np.uint64(65 - cells.bit_length())).astype(np.int64) if cells > 1 else np.zeros(len(own), np.int64)
    return np.bincount(place, weights=(mix64(own + np.uint64(1)) & np.uint64(255)).astype(np.float64), minlength=cells).astype(np.int64).astype(np.uint8).tobytes()


def _sketch_cells(size: int) -> int:
    return 1 << max(0, (max(1, size) - 1).bit_length() - 1)


def _fold(sketch: np.ndarray, cells: int) -> np.ndarray:
    return sketch.reshape(cells, -1).sum(axis=1, dtype=np.uint8) if len(sketch) > cells else sketch


def _planes(values: np.ndarray, n: int) -> bytes:
    """The n low bytes of 64-bit values, all first bytes first: unused high bytes then compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _from_planes(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(blob) // n, 8), dtype=np.uint8)
    out[:, :n] = np.frombuffer(blob, np.uint8).reshape(n, -1).T
    return out.view("<u8").ravel()


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    both = mix64(own + np.uint64(11)).sum(dtype=np.uint64), mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return tuple(int(x.astype(np.int64)) for x in both)


def _sizes(docs: DataFrame, words: int) -> DataFrame:
    """id, n and the set's fingerprint (f1, f2) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                prints = [_fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)]], ["id", "n", "f1", "f2"]
                )

    return docs.mapInArrow(tidy(run), "id long, n long, f1 long, f2 long")


def _signed(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Signatures of a task's different sets, cut by bucket: packed signatures and identifiers."""
    chunk = max(1_000_000, 64 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, counts, size, seen = [], [], [], 0, set()

        def emit():
            nonlocal held, ids, counts, size, seen
            every, owner = np.concatenate(held), np.repeat(np.array(ids, dtype=np.int64), counts)
            order = np.argsort(every)
            every, owner = every[order], owner[order]
            cuts = np.searchsorted(every >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_planes(every[part] >> np.uint64(8), 6)], pa.binary()), pa.array([_planes(owner[part], 8)], pa.binary())], ["bucket", "signatures", "owners"])
            held, ids, counts, size, seen = [], [], [], 0, set()

        for batch in batches:
            for part in slices(batch, "text"):
                for i, own in zip(part.column("id").to_pylist(), shingle_sets(part.column("text"), words), strict=True):
                    mark = _fingerprint(own)
                    if not len(own) or mark in seen:
                        continue
                    seen.add(mark)
                    new = signatures(own)
                    held += new
                    ids.append(i)
                    counts.append(sum(map(len, new)))
                    size += counts[-1]
                    if size >= chunk:
                        yield from emit()
        if size:
            yield from emit()

    # A chunk forgets its sets' fingerprints, and the smallest identifier of a class may sit in any
    # task: copies among the members are dropped later, for their representative signs alike.
    return docs.mapInArrow(tidy(run), "bucket int, signatures binary, owners binary")


def _runs(signed: DataFrame, bits: int) -> DataFrame:
    """Members (run, id) of all runs of two or more equal signatures; equal runs of a bucket once.

    Buckets are ranges of hashes and are dealt in order, so every partition has an equal share.
    """

    def of_bucket(blobs: list[tuple[bytes, bytes]]) -> pa.RecordBatch | None:
        signature = np.concatenate([_from_planes(s, 6) for s, _ in blobs])
        owner = np.concatenate([_from_planes(o, 8) for _, o in blobs]).astype(np.int64)
        order = np.lexsort((owner, signature))
        signature, owner = signature[order], owner[order]
        fresh = np.empty(len(owner), dtype=bool)
        fresh[:1] = True
        fresh[1:] = (signature[1:] != signature[:-1]) | (owner[1:] != owner[:-1])
        signature, owner = signature[fresh], owner[fresh]
        start = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
        length = np.diff(np.concatenate([start, [len(owner)]]))
        many = length > 1
        member = np.repeat(many, length)
        owner, length = owner[member], length[many]
        if not len(length):
            return None
        start = np.cumsum(length) - length
        name = mix64(np.add.reduceat(mix64(owner.astype(np.uint64) + np.uint64(3)), start) + length.astype(np.uint64))
        _, first = np.unique(name, return_index=True)
        keep = np.zeros(len(length), dtype=bool)
        keep[first] = True
        take = np.repeat(keep, length)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name[keep], length[keep]).astype(np.int64)), pa.array(owner[take])], ["run", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for b, s, o in zip(*[batch.column(c).to_pylist() for c in ("bucket", "signatures", "owners")], strict=True):
                if b != now and held:
                    out = of_bucket(held)
                    if out is not None:
                        yield out
                    held = []
                now = b
                held.append((s, o))
        if held:
            out = of_bucket(held)
            if out is not None:
                yield out

    return dealt_in_order(signed, bits).mapInArrow(tidy(run), "run long, id long").dropDuplicates(["run", "id"])


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id, the size of its set, its sketch and its shingles as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                sizes = [len(s) for s in sets]
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(sets).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array([_sketch(s) for s in sets], pa.binary()), arrays], ["id", "n", "sketch", "shingles"])

    return docs.mapInArrow(tidy(run), "id long, n long, sketch binary, shingles array<long>")


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and cell counts don't rule out."""
    known = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    sized = pairs.join(known("b"), "b").join(known("a"), "a").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*[batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")], strict=True):
                cells = min(len(sa), len(sb))
                differ = np.count_nonzero(_fold(np.frombuffer(sa, np.uint8), cells) != _fold(np.frombuffer(sb, np.uint8), cells))
                keep.append(differ * (100 + percent) <= (na + nb) * (100 - percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of percent / 100 or more.

    Only sets of some pair travel; where the pairs are few, Spark finds those sets without a shuffle.
    """
    used = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")).join(pairs.select(c).distinct(), c, "left_semi")
    joined = pairs.join(used("b"), "b").join(used("a"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return joined.filter(100 * common >= percent * union).select("a", "b")


def _across(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """Candidate pairs (run, a, b) of different components within a run that cell counts don't rule out.

    Rows: run, part, id, component, n, sketch, failed (partners that the member is
    known not to be linked with) and block.  With ``every``, all such pairs, once a task;
    else only so many that they would join all that such pairs join (a forest,
    likeliest pairs first): fewer pairs than the run has members.  Runs come in parts;
    in all parts but the first, pairs of members that every part has (``block`` null)
    are left out.
    """

    def of_run(member: list[tuple], later: bool) -> Iterator[tuple[int, int]]:
        if len(member) < 2:
            return
        member.sort(key=lambda m: m[2])
        ids, tree, size = (np.array([m[k] for m in member], dtype=np.int64) for k in (0, 1, 2))
        own = np.array([m[5] is not None for m in member])
        sketch = [np.frombuffer(m[3], np.uint8) for m in member]
        cells = min(map(len, sketch))
        cell = np.stack([_fold(s, cells) for s in sketch])
        for i in range(len(member) - 1):
            last = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
            failed = set(member[i][4] or ())
            for at in range(i + 1, last, 4096):
                part = slice(at, min(last, at + 4096))
                differ = (cell[part] != cell[i]).sum(axis=1)
                # Jaccard >= p/100 allows (a + b) * (100 - p) / (100 + p) differences at most.
                fits = (tree[part] != tree[i]) & (differ * (100 + percent) <= (size[i] + size[part]) * (100 - percent))
                near = np.flatnonzero(fits & (own[part] | own[i]) if later else fits)
                if not every:
                    near = near[np.argsort(differ[near], kind="stable")]
                for j in near:
                    if failed and int(ids[at + j]) in failed:
                        continue
                    if not every:
                        if tree[at + j] == tree[i]:
                            continue
                        tree[tree == tree[at + j]] = tree[i]
                    a, b = int(ids[i]), int(ids[at + j])
                    yield (a, b) if a < b else (b, a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int]] = []

        def full():
            out = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(3)], ["run", "a", "b"])
            found.clear()
            return out

        once: set[tuple[int, int]] = set()

        def take(now: tuple, held: list[tuple]) -> None:
            for p in of_run(held, now[1] > 0):
                if not every or p not in once:
                    found.append((now[0], *p))
                    if every:
                        once.add(p)

        now, held = (0, 0), []
        for batch in batches:
            for r, x, *m in zip(*[batch.column(c).to_pylist() for c in ("run", "part", "id", "component", "n", "sketch", "failed", "block")], strict=True):
                if (r, x) != now:
                    take(now, held)
                    if len(found) >= 100_000:
                        yield full()
                        once.clear()
                    held = []
                now = (r, x)
                held.append(tuple(m))
        take(now, held)
        if found:
            yield full()

    return rows.repartition("run", "part").sortWithinPartitions("run", "part").mapInArrow(tidy(run), "run long, a long, b long")


def _mixed(member: DataFrame, component: DataFrame, sets: DataFrame, failed: DataFrame, total: int, every: bool) -> tuple[DataFrame, str] | None:
    """Members of the runs that still span several components, with what ``_across`` needs, and their path; None if there is none.

    For forests, a run's members are dealt to parts of about ``BLOCK``.  With ``every``, where all but at most
    ``BLOCK`` members are of one component, that component's members are dealt so, and the others go to
    every part: pairs that matter have one of them.  Rows so at most double.  Other runs are one part.
    """
    both = failed.select(F.col("a").alias("id"), F.col("b").alias("f")).unionByName(failed.select(F.col("b").alias("id"), F.col("a").alias("f")))
    known = sets.select("id", "n", "sketch").join(both.groupBy("id").agg(F.collect_set("f").alias("failed")), "id", "left")
    placed = member.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed, at = written(placed, "placed-members")
    each = placed.groupBy("run", "component").agg(F.count("*").alias("n"))
    runs = each.groupBy("run").agg(F.sum("n").alias("c"), F.max("n").alias("most"), F.max_by("component", "n").alias("largest"), F.count("*").alias("k")).filter("k > 1")
    dealt = F.col("most") if every else F.col("c")
    parts = F.when(F.lit(not every) | (F.col("c") - F.col("most") <= BLOCK), F.ceil(dealt / BLOCK)).otherwise(1).cast("int")
    runs, runs_at = written(runs.select("run", "c", parts.alias("parts"), "largest"), "mixed-runs")
    if runs.isEmpty():
        remove(member.sparkSession, at, runs_at)
        return None
    own = F.pmod(F.xxhash64("id", "run"), F.col("parts")).cast("int")
    members = met(placed, runs, ["run"], total).withColumn("block", F.when((F.col("component") == F.col("largest")) | F.lit(not every), own))
    members = members.withColumn("part", F.explode(F.when(F.col("block").isNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("block"))))
    out, out_at = written(members.join(known, "id").select("run", "part", "id", "component", "n", "sketch", "failed", "block", "parts"), "mixed-members")
    remove(member.sparkSession, at, runs_at)
    return out, out_at


def _with_prints(df: DataFrame, text: str, words: int) -> DataFrame:
    """Rows with their set's size and fingerprint as __n, __f1 and __f2."""

    def make(column: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(column, words)
        prints = [_fingerprint(s) for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), *[pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)]]

    return add_columns(df, text, [StructField(c, LongType()) for c in ("__n", "__f1", "__f2")], make)


def _placed(df: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, bool]:
    """(id, n, f1, f2, component and label of every row; identifiers of several rows; whether any is null or repeated).

    ``component`` is the smallest node that links reach (null for empty sets under a null or repeated
    identifier); ``label`` is the component's smallest identifier.
    """
    if percent < 80:
        raise ValueError("the signature windows hold for a similarity of 0.8 and above")
    spark = df.sparkSession
    # Some signature buckets for every partition of the shuffle, 1024 at least.
    bits = max(10, (partitions(spark) - 1).bit_length() + 2)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sized, sized_at = written(_sizes(docs, words), "shingle-sizes")
    repeated, _ = written(sized.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id"), "repeated-ids")
    several = not (repeated.isEmpty() and sized.filter("id IS NULL").isEmpty())
    if several:
        unique, other = _split(sized, "id", repeated)
        named = unique.withColumn("node", F.col("id")).unionByName(other.withColumn("node", F.when(F.col("n") > 0, F.col("f1"))))
        sized, _ = written(named, "shingle-sizes")
        remove(spark, sized_at)
        alone, rest = _split(docs, "id", repeated)
        docs = alone.unionByName(_with_prints(rest, "text", words).select(F.col("__f1").alias("id"), "text"))
    else:
        sized = sized.withColumn("node", F.col("id"))
    # Copies: all but the smallest node of the documents with one set.
    prints, rows = ["n", "f1", "f2"], sized.count()
    group, group_at = written(sized.filter("n > 0").groupBy(*prints).agg(F.min("node").alias("rep"), F.count("*").alias("c")).filter("c > 1"), "copy-groups")
    grouped, grouped_at = written(met(sized, group, prints, rows, "left"), "grouped")
    copies, copies_at = written(grouped.filter("node <> rep").select(F.col("node").alias("id")).distinct(), "copies")
    member, member_at = written(_runs(_signed(docs, words, bits), bits).join(copies, "id", "left_anti"), "signature-runs")

    total = member.count()
    leader, leader_at = written(member.groupBy("run").agg(F.min("id").alias("a"), F.count("*").alias("c")), "leaders")
    first = met(member, leader, ["run"], total).filter("a < id").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a"))
    wanted = docs.join(member.select("id").distinct(), "id")
    sets, sets_at = written(_sets(wanted.dropDuplicates(["id"]) if several else wanted, words), "candidate-sets")
    likely, likely_at = written(_likely(first, sets, percent), "likely-pairs")
    edges, edges_at = written(_verified(likely, sets, percent), "links")
    component, at = written(connected_components(edges), "components")

    # Runs still mixed: first a sixteenth of them, which already joins large groups, then all, by forests of
    # candidates; then the runs whose forest had a pair that failed or left parts unjoined, by every candidate,
    # again a part of them first: pairs that failed once are not tried again.
    gone = [group_at, grouped_at, copies_at, member_at, leader_at, sets_at, likely_at, edges_at, at]
    failed, some = edges.limit(0), member
    for share, whole in ((16, False), (1, False), (16, True), (1, True)):
        found = _mixed(some.filter(F.pmod("run", F.lit(share)) == 0), component, sets, failed, total, whole)
        if found is None:
            if share == 1:
                break  # no run is mixed
            continue
        mixed, at = found
        gone.append(at)
        tried, at = written(_across(mixed, percent, whole), "candidates")
        more, more_at = written(_verified(tried.select("a", "b").distinct(), sets, percent), "links")
        lost = tried.join(more, ["a", "b"], "left_anti")
        if (share, whole) == (1, False):
            unjoined = lost.select("run").unionByName(mixed.filter("parts > 1").select("run")).distinct()
            some, some_at = written(member.join(unjoined, "run"), "open-runs")
            gone.append(some_at)
        gone += [at, more_at]
        failed, at = written(failed.unionByName(lost.select("a", "b")).distinct(), "failed")
        gone.append(at)
        if not more.isEmpty():
            component, at = written(joined_components(component, more), "components")
            gone.append(at)

    # A row's node, or that of its copies' group, leads to its component; groups know theirs before their rows meet them.
    named = component.withColumnRenamed("node", "rep")
    group = group.join(named, "rep", "left").select(*prints, "c", F.coalesce("component", "rep").alias("component"))
    alone = grouped.filter("node IS NOT NULL AND rep IS NULL").join(component, "node", "left").select("id", *prints, F.coalesce("component", "node").alias("component"))
    out = alone.unionByName(met(grouped.filter("rep IS NOT NULL").select("id", *prints), group, prints, rows))
    out, _ = written(out, "linked")
    remove(spark, *gone)
    if not several:
        return out.withColumn("label", F.col("component")), repeated, several
    # The smallest node names most components rightly; the others get their smallest identifier, null if none has one.
    least = out.groupBy("component").agg(F.min("id").alias("least")).filter(~F.col("component").eqNullSafe(F.col("least")))
    out = out.join(least.withColumn("named", F.lit(True)), "component", "left")
    out = out.select("id", *prints, "component", F.when(F.col("named"), F.col("least")).otherwise(F.col("component")).alias("label"))
    empty = sized.filter("node IS NULL").select("id", *prints, F.col("node").alias("component"), F.col("id").alias("label"))
    return out.unionByName(empty), repeated, several


def _split(df: DataFrame, key: str, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose identifier no other row has, rows with a null or repeated one)."""
    ids = repeated.select(F.col("id").alias("__id"))
    same = F.col(key).cast("long") == F.col("__id")
    return df.filter(F.col(key).isNotNull()).join(ids, same, "left_anti"), df.filter(F.col(key).isNull()).unionByName(df.join(ids, same, "left_semi"))


def link(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key reachable by links, itself included).

    ``percent`` must be 80 or more, as the windows are built for a similarity of 0.8.
    """
    rows, _, _ = _placed(df, key, text, words, percent)
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))


def firsts(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without all but one of every group of linked documents: a row with the smallest key stays.

    Among rows of that key the smallest set fingerprint decides; rows without words all stay.
    """
    rows, repeated, several = _placed(df, key, text, words, percent)
    same = F.col(key).cast("long").eqNullSafe(F.col("__id"))
    if not several:
        gone = rows.filter("id <> label").select(F.col("id").alias("__id"))
        return df.join(gone, same, "left_anti")
    rows = rows.filter("n > 0").withColumn("place", F.struct(F.col("id").isNull().alias("last"), "id", "f1", "f2"))
    best = rows.groupBy("component").agg(F.min("place").alias("best"))
    gone = rows.join(best, "component").filter("place <> best").select(F.col("id").alias("__id"), F.col("f1").alias("__g1"), F.col("f2").alias("__g2")).distinct()
    gone, _ = written(gone, "gone")
    alone, rest = _split(df, key, repeated)
    alone = alone.join(gone.select("__id"), same, "left_anti")
    rest = _with_prints(rest, text, words).join(gone, same & (F.col("__f1") == F.col("__g1")) & (F.col("__f2") == F.col("__g2")), "left_anti")
    # Of rows alike in key and set one stays; rows without words are told apart by their number.
    rest = rest.withColumn("__row", F.when(F.col("__n") == 0, F.monotonically_increasing_id())).dropDuplicates([key, "__f1", "__f2", "__row"])
    return alone.unionByName(rest.select(*df.columns))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
