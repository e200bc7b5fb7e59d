"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped arrays.

Counting: map tasks hash the words of their texts, count pairs (word before,
word) over a few million tokens at a time and send the counts, cut by the hash
of the word before, as packed arrays.  A bucket thus holds all pairs of its
contexts, and a context at most one entry per word and chunk; pairs of the few
most frequent contexts, which would be too many for one bucket, are spread over
all by their words.  Each bucket becomes a file of sorted hash arrays: pair hashes
with counts, context hashes with totals and the numbers of words seen once, twice
and more often after it; each array takes as few bytes a number as its largest
needs, 8 at most.  How many different words precede a word (its continuation
count) is counted in a second, smaller exchange and stored alike.

Scoring: workers map the files into memory and look sorted hashes up by binary
search.  With counts c, context totals and discounts D1, D2, D3+ from the counts
of counts,

    P(w | v) = (c(vw) - D) / c(v) + g(v) * ((k(w) - D') / K + g' / (V + 1))

where k is the continuation count, K their sum and g, g' give the discounted mass
to the lower order; the last term also covers words never seen.

Words are known by 64-bit hashes as contexts and by their upper 48 bits as
continuations.  A text's tokens are its lower-cased (A-Z) words and one end.

Defined results for odd input: a null or empty text is its end alone.  A null
identifier hashes as the empty string when rows are held out.  Repeated rows
count each time and score alike.  Extra columns play no part.  Without any
training row every token has probability 1 / (V + 1) = 1.  An empty table gives
no rows.
"""

from __future__ import annotations

import mmap
import os
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from .storage import add_columns, dealt_in_order, filesystem, fresh_path, partitions, remove, tidy, written
from .textkernel import mix64, slices, word_hashes

#: Stand for the start and the end of a text.
BEGIN, END = np.uint64(0x6F4A91B3C2D5E807), np.uint64(0x1B873593CC9E2D51)


def bucket_bits(parts: int) -> int:
    """Bits that number the buckets: some for every partition of the shuffle, 1024 at least."""
    return max(10, (parts - 1).bit_length() + 2)


def pair_key(before: np.ndarray, word48: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """Hash of a pair, whose upper ``bits`` number its bucket.

    Its upper bits, 16 or as many as number the buckets, are the context's, so a context has one
    bucket; but pairs of ``hot`` contexts (sorted) are spread over all buckets.
    """
    context, upper = mix64(before), max(16, bits)
    top = np.uint64((1 << 64) - (1 << 64 - upper))
    pair = mix64(context ^ (word48 * np.uint64(0x9E3779B97F4A7C15)))
    return np.where(_among(before, hot), pair, (context & top) | (pair >> np.uint64(upper)))


def _among(values: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values if len(hot) else np.zeros(len(values), bool)


def _bucket(context: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(context) >> np.uint64(64 - bits)).astype(np.int64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, text number) of every token; each text ends with END and starts after BEGIN."""
    words, at = word_hashes(column)
    n = np.diff(at)
    ends = np.cumsum(n + 1)
    out = np.empty(len(words) + len(n), dtype=np.uint64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[ends - 1] = True
    out[is_end] = END
    out[~is_end] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[ends - n - 1] = BEGIN
    return before, out, np.repeat(np.arange(len(n)), n + 1)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start, and the length."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays, each in the fewest bytes a number that hold all its numbers, after their lengths and widths."""
    narrow = [a.astype(f"<u{next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) >> 8 * w == 0)}") for a in arrays]
    return struct.pack(f"<{2 * len(arrays)}Q", *map(len, narrow), *[a.itemsize for a in narrow]) + b"".join(a.tobytes() for a in narrow)


def _unpack(blob, count: int) -> list[np.ndarray]:
    head, at, out = struct.unpack_from(f"<{2 * count}Q", blob), 16 * count, []
    for n, width in zip(head[:count], head[count:], strict=True):
        out.append(np.frombuffer(blob, f"<u{width}", n, at))
        at += n * width
    return out


def _count_pairs(before: np.ndarray, word: np.ndarray, bits: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Counts of a chunk's pairs as one packed blob per bucket: contexts, pairs of each, then per pair
    the word's upper 32 and next 16 bits and the count."""
    w48 = word >> np.uint64(16)
    key = pair_key(before, w48, bits, hot)
    order = np.argsort(key)
    key = key[order]
    start = _runs(key)
    first, count = order[start[:-1]], np.diff(start)
    before, w48, bucket = before[first], w48[first], (key[start[:-1]] >> np.uint64(64 - bits)).astype(np.int64)
    # Keys of one context share their upper bits only: bring each context's pairs together.
    by_context = np.lexsort((w48, before, bucket))
    before, w48, count = before[by_context], w48[by_context], count[by_context]
    cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    hi, lo = w48 >> np.uint64(16), w48 & np.uint64(0xFFFF)
    for b in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[b], cuts[b + 1])
        edges = _runs(before[part])
        yield int(b), _pack(before[part][edges[:-1]], np.diff(edges), hi[part], lo[part], count[part])


def _store(path: str, name: str, *arrays: np.ndarray) -> None:
    store, folder = filesystem(path)
    temp = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        f.write(_pack(*arrays))
    store.move(temp, f"{folder}/{name}")


def _counts_of_counts(count: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(count, 5).astype(np.int64), minlength=6)[1:5].tolist()


#: Arrays of a file of pairs: pair hashes and counts, contexts, their totals, and words seen once, twice and more
#: often after a context.
_PAIR_FILE = 7


def _reduce_pairs(blobs: list[bytes], path: str, bucket: int, bits: int, hot: np.ndarray) -> tuple[dict, np.ndarray, bytes | None]:
    """Stores a bucket's pairs and contexts; its statistics, the words of its pairs, and its share of hot contexts' numbers."""
    parts = [_unpack(b, 5) for b in blobs]
    before = np.concatenate([np.repeat(c.astype(np.uint64), n.astype(np.int64)) for c, n, *_ in parts])
    w48 = np.concatenate([hi.astype(np.uint64) << np.uint64(16) | lo.astype(np.uint64) for _, _, hi, lo, _ in parts])
    count = np.concatenate([p[4].astype(np.int64) for p in parts])
    order = np.lexsort((w48, before))
    before, w48, count = before[order], w48[order], count[order]
    fresh = np.concatenate([[True], (before[1:] != before[:-1]) | (w48[1:] != w48[:-1])])
    at = np.flatnonzero(fresh)
    before, w48, count = before[at], w48[at], np.add.reduceat(count, at)
    edges = _runs(before)
    seen = [np.add.reduceat((count == k).astype(np.int64) if k < 3 else (count >= 3).astype(np.int64), edges[:-1]) for k in (1, 2, 3)]
    contexts, numbers = before[edges[:-1]], [np.add.reduceat(count, edges[:-1]), *seen]
    key = pair_key(before, w48, bits, hot)
    by_key = np.argsort(key)
    spread = _among(contexts, hot)
    own = [contexts[~spread], *[x[~spread] for x in numbers]]
    _store(path, f"pairs-{bucket:05d}", key[by_key], count[by_key], *own)
    total, real = own[1], own[0] != BEGIN
    stat = {"tokens": int(total[real].sum()), "words": int(real.sum()), "texts": int(total[~real].sum()), "coc": _counts_of_counts(count)}
    return stat, w48, _pack(contexts[spread], *[x[spread] for x in numbers]) if spread.any() else None


def _reduce_words(w48: np.ndarray, count: np.ndarray, path: str, bucket: int) -> dict:
    order = np.argsort(w48)
    w48, count = w48[order], count[order]
    at = _runs(w48)[:-1]
    w48, count = w48[at], np.add.reduceat(count, at)
    _store(path, f"words-{bucket:05d}", w48, count)
    return {"tokens": int(count.sum()), "words": len(w48), "texts": 0, "coc": _counts_of_counts(count), "seen": [int((count == 1).sum()), int((count == 2).sum()), int((count >= 3).sum())]}


def _discounts(coc: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; plain ones where a count of counts is 0."""
    n1, n2, n3, n4 = map(float, coc)
    if not all((n1, n2, n3, n4)):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


@dataclass(frozen=True)
class Model:
    """A stored model: its folder and the numbers that are not per word or pair."""

    path: str
    bits: int
    train_tokens: int
    vocabulary: int
    texts: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    continuations: int
    word_mass: float
    #: Contexts whose pairs are spread over all buckets (sorted), with their totals and words seen once, twice and more often.
    hot: tuple[np.ndarray, ...]


_STAT = "kind string, bucket int, blob binary, tokens long, words long, texts long, coc array<long>, seen array<long>"
_STAT_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64()), ("texts", pa.int64()), ("coc", pa.list_(pa.int64())), ("seen", pa.list_(pa.int64()))])


def _row(kind: str, bucket: int, blob: bytes | None = None, stat: dict | None = None) -> pa.RecordBatch:
    row = {"kind": kind, "bucket": bucket, "blob": blob} | (stat or {})
    return pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in _STAT_ARROW}], schema=_STAT_ARROW)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of each bucket from rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(blob)
    if held:
        yield now, held


def hot_contexts(df: DataFrame, text: str, share: float, sample: float, most: int = 256) -> np.ndarray:
    """Contexts with more than ``share`` of the tokens in a sample of the texts, ``most`` at most, sorted.

    They are only dealt differently: counts and scores don't depend on the choice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                before, n = np.unique(tokens(part.column(text))[0], return_counts=True)
                often = n > n.sum() * share / 4
                yield pa.RecordBatch.from_arrays([pa.array(before[often].view(np.int64)), pa.array(n[often]), pa.array(np.full(often.sum(), n.sum()))], ["context", "n", "of"])

    found = df.select(text).sample(sample, 7).mapInArrow(tidy(run), "context long, n long, of long")
    top = found.groupBy("context").agg((F.sum("n") / F.sum("of")).alias("share")).orderBy(F.desc("share")).limit(most).collect()
    often = [np.int64(r["context"]).view(np.uint64) for r in top if r["share"] > share]
    return np.unique(np.array([*often, BEGIN], dtype=np.uint64))


def train(df: DataFrame, text: str = "text", chunk: int = 2_000_000, share: float | None = None, sample: float = 0.01) -> Model:
    """Counts the texts of ``df`` and stores the model in the shared folder.

    Contexts with more than ``share`` of all tokens (by default, a quarter of a partition's) are spread over all buckets.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "language-model")
    bits = bucket_bits(partitions(spark))
    hot = hot_contexts(df, text, 0.25 / partitions(spark) if share is None else share, sample)
    store, folder = filesystem(path)
    store.create_dir(folder, recursive=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit():
            for b, blob in _count_pairs(*[np.concatenate(x) for x in zip(*held, strict=True)], bits, hot):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for part in slices(batch, text):
                held.append(tokens(part.column(text))[:2])
                size += len(held[-1][0])
                if size >= chunk:
                    yield from emit()
                    held, size = [], 0
        if held:
            yield from emit()

    def reduce_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], []

        def continuations():
            w, c = np.concatenate(words), np.concatenate(counts)
            order = np.argsort(w)
            w, c = w[order], c[order]
            at = _runs(w)[:-1]
            return w[at], np.add.reduceat(c, at)

        for b, blobs in _by_bucket(batches):
            stat, w48, spread_here = _reduce_pairs(blobs, path, b, bits, hot)
            yield _row("pairs", b, spread_here, stat)
            words.append(w48)
            counts.append(np.ones(len(w48), np.int64))
            words, counts = ([x] for x in continuations())
            if len(words[0]) > chunk:
                yield from spread(words.pop(), counts.pop())
        if words:
            yield from spread(words[0], counts[0])

    def spread(w48: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.searchsorted(w48 >> np.uint64(48 - bits), np.arange((1 << bits) + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            yield _row("words", int(b), _pack(w48[part], count[part]))

    def reduce_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in _by_bucket(batches):
            w, c = zip(*[_unpack(x, 2) for x in blobs], strict=True)
            yield _row("words", b, stat=_reduce_words(np.concatenate(w).astype(np.uint64), np.concatenate(c).astype(np.int64), path, b))

    pairs = dealt_in_order(df.select(text).mapInArrow(tidy(count), "bucket int, blob binary"), bits)
    reduced, at = written(pairs.mapInArrow(tidy(reduce_pairs), _STAT), "pair-statistics")
    words = dealt_in_order(reduced.filter("kind = 'words'").select("bucket", "blob"), bits)
    word = _totals(words.mapInArrow(tidy(reduce_words), _STAT))
    pair = _totals(reduced.filter("kind = 'pairs'"))
    numbers = _hot_numbers(reduced.filter("kind = 'pairs' AND blob IS NOT NULL").select("blob"))
    remove(spark, at)
    real = numbers[0] != BEGIN
    texts = int(numbers[1][~real].sum())
    count, vocabulary = pair["tokens"] + int(numbers[1][real].sum()), pair["words"] + int(real.sum())
    mass, discounts = word["tokens"], _discounts(word["coc"])
    freed = float(np.dot(discounts, word["seen"]))
    return Model(path, bits, count + texts, vocabulary + (texts > 0), texts, _discounts(pair["coc"]), discounts, mass, freed / mass if mass else 1.0, numbers)


def _hot_numbers(blobs: DataFrame) -> tuple[np.ndarray, ...]:
    """The hot contexts' numbers, summed over all buckets; there are a few hundred at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in _unpack(blob, 5)], ["context", "total", "s1", "s2", "s3"])

    each = blobs.mapInArrow(tidy(run), "context long, total long, s1 long, s2 long, s3 long")
    rows = each.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("total", "s1", "s2", "s3")]).collect()
    table = np.array([tuple(r) for r in rows], dtype=np.int64).reshape(-1, 5)
    contexts = np.ascontiguousarray(table[:, 0]).view(np.uint64)
    order = np.argsort(contexts)
    return (contexts[order], *[table[order, k] for k in range(1, 5)])


def _totals(stats: DataFrame) -> dict:
    """Sums over all buckets' statistics."""
    names = ["tokens", "words", "texts", *[f"coc[{k}]" for k in range(4)], *[f"seen[{k}]" for k in range(3)]]
    row = stats.agg(*[F.coalesce(F.sum(F.expr(n)), F.lit(0)) for n in names]).first()
    return dict(zip(names[:3], row[:3], strict=True)) | {"coc": np.array(row[3:7]), "seen": np.array(row[7:])}


def _mapped(name: str) -> mmap.mmap:
    """A file mapped for reading; where Python can, without a descriptor held for it."""
    with open(name, "rb") as f:
        kept = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **kept)


class Arrays:
    """The model's files, mapped into memory when first asked for.

    Files in a store that can't be mapped are read whole; beyond ``most`` bytes the one not used for longest goes.
    """

    def __init__(self, path: str, bits: int, most: int = 256 << 20):
        self.path, self.bits, self.most, self.held, self.open = path, bits, most, 0, {}

    def get(self, name: str, count: int) -> list[np.ndarray] | None:
        store, folder = filesystem(self.path)
        if store.type_name == "local":
            if name not in self.open:
                there = os.path.exists(f"{folder}/{name}")
                self.open[name] = _unpack(_mapped(f"{folder}/{name}"), count) if there else None
            return self.open[name]
        if name in self.open:
            self.open[name] = self.open.pop(name)
        else:
            there = store.get_file_info(f"{folder}/{name}").type.name == "File"
            raw = store.open_input_stream(f"{folder}/{name}").read() if there else b""
            self.held += len(raw)
            self.open[name] = (_unpack(raw, count), len(raw)) if there else (None, 0)
            while self.held > self.most and len(self.open) > 1:
                self.held -= self.open.pop(next(iter(self.open)))[1]
        return self.open[name][0]

    def find(self, sorted_query: np.ndarray, bucket: np.ndarray, name: str, count: int, key: int, values: list[int]) -> list[np.ndarray]:
        """Values (0 where absent) of sorted queries; buckets ascend with the queries."""
        out = [np.zeros(len(sorted_query), np.int64) for _ in values]
        cuts = np.searchsorted(bucket, np.arange((1 << self.bits) + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            arrays = self.get(f"{name}-{b:05d}", count)
            if arrays is None or not len(arrays[key]):
                continue
            part = slice(cuts[b], cuts[b + 1])
            place = np.minimum(np.searchsorted(arrays[key], sorted_query[part]), len(arrays[key]) - 1)
            hit = arrays[key][place] == sorted_query[part]
            for o, v in zip(out, values, strict=True):
                o[part] = np.where(hit, arrays[v][place], 0)
        return out


@cache
def arrays(path: str, bits: int) -> Arrays:
    return Arrays(path, bits)


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def score_tokens(model: Model, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, training count) of every token."""
    store, bits = arrays(model.path, model.bits), model.bits
    # Words and contexts: one lookup for each different one.
    each, inverse = np.unique(np.concatenate([word, before]), return_inverse=True)
    bucket = _bucket(each, bits)
    spot = np.argsort(bucket, kind="stable")
    total, s1, s2, s3 = store.find(each[spot], bucket[spot], "pairs", _PAIR_FILE, 2, [3, 4, 5, 6])
    back = np.empty(len(spot), np.int64)
    back[spot] = np.arange(len(spot))
    total, s1, s2, s3 = (x[back] for x in (total, s1, s2, s3))
    hot = model.hot[0]
    spread = np.flatnonzero(_among(each, hot))
    if len(spread):
        for x, own in zip((total, s1, s2, s3), model.hot[1:], strict=True):
            x[spread] = own[np.searchsorted(hot, each[spread])]
    w48 = each >> np.uint64(16)
    (follow,) = store.find(w48, (w48 >> np.uint64(48 - bits)).astype(np.int64), "words", 2, 0, [1])
    of_word, of_context = inverse[: len(word)], inverse[len(word) :]
    count = np.where(word == END, model.texts, np.where(each == BEGIN, 0, total)[of_word])
    lower = model.word_mass / (model.vocabulary + 1) + np.maximum(follow - _discount(follow, model.word_discounts), 0) / max(1, model.continuations)
    d1, d2, d3 = model.pair_discounts
    with np.errstate(divide="ignore", invalid="ignore"):
        mass = np.where(total > 0, (d1 * s1 + d2 * s2 + d3 * s3) / total, 1.0)
    key, place = np.unique(pair_key(before, word >> np.uint64(16), bits, hot), return_inverse=True)
    (pairs,) = store.find(key, (key >> np.uint64(64 - bits)).astype(np.int64), "pairs", _PAIR_FILE, 0, [1])
    pairs = pairs[place]
    upper = np.maximum(pairs - _discount(pairs, model.pair_discounts), 0) / np.maximum(total[of_context], 1)
    return np.log10(upper + mass[of_context] * lower[of_word]), count


def score(df: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds n_tokens, n_known, base_score (add-one unigrams) and score (log10 probability of the text)."""
    fields = [StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())]

    def make(column: pa.Array) -> list[pa.Array]:
        before, word, text_no = tokens(column)
        log_p, count = score_tokens(model, before, word)
        base = np.log10((count + 1) / (model.train_tokens + model.vocabulary + 1))
        ends = np.flatnonzero(word == END)
        add = lambda x: np.add.reduceat(x, np.concatenate([[0], ends[:-1] + 1]))
        return [pa.array(add(x)) for x in (np.ones(len(word), np.int64), (count > 0).astype(np.int64), base, log_p)]

    return add_columns(df, text, fields, make, drop)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op4_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    out = score(docs, model, drop=("text",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
