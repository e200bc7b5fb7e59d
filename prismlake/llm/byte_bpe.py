"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary's byte strings: a
pre-token that is a vocabulary entry is resolved by one probe.  Tier two merges
the rest with a heap over a doubly linked list of bytes, always the pair of the
lowest rank and, among equal ranks, the leftmost.  Texts are cut at single
spaces before the pattern runs, and a bounded memo keeps the ids of the pieces.

Defined results for odd input: null and empty texts have no ids and decode to
no bytes.  Very long pre-tokens take n log n steps and are not memoised.
Repeated rows are encoded alike.  Extra columns stay; columns named like the
results are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from .storage import add_columns

_K = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


class MinimalPerfectHash:
    """Maps each of n byte strings to its own slot in 0..n-1 by hash and displacement.

    Buckets are placed from the largest to the smallest; a bucket of one key
    stores its slot itself, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.m = len(keys), max(1, len(keys) // 3)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        bucket = (hashes % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.m + 1))
        sizes = np.diff(bounds)
        self.shift = [0] * self.m
        self.at = np.full(self.n, -1, dtype=np.int64)
        trial = np.arange(1, 513, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[bounds[b] : bounds[b + 1]]
            if len(own) < 2:
                break
            base = np.uint64(0)
            while True:
                slots = self._slots(hashes[own][:, None], (trial + base)[None, :])
                sorted_slots = np.sort(slots, axis=0)
                good = (self.at[slots] < 0).all(axis=0) & (np.diff(sorted_slots, axis=0) != 0).all(axis=0)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = int(trial[k] + base)
                    self.at[slots[:, k]] = own
                    break
                base += np.uint64(512)
        free = iter(np.flatnonzero(self.at < 0))
        for b in np.flatnonzero(sizes == 1):
            slot = int(next(free))
            self.shift[b] = -slot - 1
            self.at[slot] = order[bounds[b]]
        self.at = self.at.tolist()

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(_K))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        if d < 0:
            return -d - 1
        return (((h ^ (d * _K & _M64)) * 0xBF58476D1CE4E5B9 & _M64) >> 32) % self.n


#: White space, a space and white space again, or a space at the end after white space: there the cut at spaces would change tokens.
_TIGHT = re.compile(r"\s \s|\s \Z")


class _Memo(dict):
    """Bounded memo: missing keys are computed; beyond ``most`` entries it starts anew."""

    def __init__(self, make, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Encoder and decoder over a rank file (base64 token, rank) and a split pattern."""

    def __init__(self, path: str, pattern: str, memo: int = 250_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        keys = sorted(self.ranks, key=self.ranks.get)
        self.mph = MinimalPerfectHash(keys)
        self.slot_key = [keys[i] for i in self.mph.at]
        self.slot_code = [self.ranks[k].to_bytes(4, "little") for k in self.slot_key]
        self.code = {k: i.to_bytes(4, "little") for k, i in self.ranks.items()}
        self.token = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.pattern = regex.compile(pattern)
        self.pre = _Memo(self._pre_token, memo)
        self.unit = _Memo(self._unit, memo)

    def _pre_token(self, word: str) -> bytes:
        raw = word.encode()
        slot = self.mph.slot(raw)
        if self.slot_key[slot] == raw:
            return self.slot_code[slot]
        return self.merge(raw)

    def merge(self, raw: bytes) -> bytes:
        """Ids (little-endian, 32 bits each) of a byte string by merges in rank order."""
        get, n = self.ranks.get, len(raw)
        end = list(range(1, n + 1))  # where the piece that starts at i ends
        before = list(range(-1, n - 1))  # where the piece before it starts
        rank = [get(raw[i : i + 2]) for i in range(n)]  # of the pair that starts at i
        rank[n - 1] = None
        heap = [r << 40 | i for i, r in enumerate(rank) if r is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & 0xFFFFFFFFFF
            if rank[i] != x >> 40:
                continue
            j = end[i]
            k = end[i] = end[j]
            rank[j] = None
            if k < n:
                before[k] = i
                r = rank[i] = get(raw[i : end[k]])
                if r is not None:
                    heappush(heap, r << 40 | i)
            else:
                rank[i] = None
            h = before[i]
            if h >= 0:
                r = rank[h] = get(raw[h:k])
                if r is not None:
                    heappush(heap, r << 40 | h)
        out, i, code = [], 0, self.code
        while i < n:
            out.append(code[raw[i : end[i]]])
            i = end[i]
        return b"".join(out)

    def _unit(self, unit: str) -> bytes:
        return b"".join([self.pre[x] for x in self.pattern.findall(unit)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if "\0" in text or _TIGHT.search(text):
            return b"".join(map(self.pre.__getitem__, self.pattern.findall(text)))
        return b"".join(map(self.unit.__getitem__, text.replace(" ", "\0 ").split("\0")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


@cache
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One tokenizer per worker process."""
    return ByteBpe(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", drop: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """Adds n_tokens (long) and ids (binary, little-endian 32-bit); with ``decoded``, the bytes decoded from the ids too."""
    fields = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    if decoded:
        fields.append(StructField("decoded", BinaryType()))

    def make(column: pa.Array) -> list[pa.Array]:
        bpe = tokenizer(path, pattern)
        ids = [bpe.encode(t) if t else b"" for t in column.to_pylist()]
        out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return [*out, pa.array([bpe.decode(x) for x in ids], pa.binary())] if decoded else out

    return add_columns(df, text, fields, make, drop)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Adds the bytes that a column of ids stands for; null ids decode to no bytes."""

    def make(values: pa.Array) -> list[pa.Array]:
        bpe = tokenizer(path, pattern)
        return [pa.array([bpe.decode(x) if x else b"" for x in values.to_pylist()], pa.binary())]

    return add_columns(df, ids, [StructField(column, BinaryType())], make)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, drop=("text",), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
