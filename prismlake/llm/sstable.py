"""Sorted-string-table shards for token ids.

A shard file holds documents in ascending order of their key::

    block*  index  bloom  footer

* key: 1 and the identifier as 8 big-endian bytes with the sign bit flipped (so
  bytes sort as numbers), or 0 for a null identifier, then the writing task and the
  row's number among that task's rows of the identifier, 4 bytes each: no two rows
  of a set of shards have the same key;
* block: entries of (shared key bytes, further key bytes, value bytes) as varints,
  the further key bytes, the value; every 16th entry shares nothing (a restart);
  then the restarts' offsets and their number (32 bits each) and a CRC-32;
* value: the ids, little-endian, ``width`` bytes each (2 where the vocabulary allows);
* index: per block, its first key's length and key, offset, length, entries, ids;
* bloom: a bit array over the identifiers, 10 bits a row and 7 probes;
* footer: offsets, counts, width, format version, magic.

Files are written to a name of the attempt and then renamed, so a repeated
task leaves the same shard.

Defined results for odd input: a null or empty text has only the end id; null
identifiers sort first; rows of null or repeated identifiers are told apart by the
key's number and all found under their identifier.  A special token's string in a
text gives that token, as the library does it.  Extra columns play no part.  An
empty table gives no shard and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import filesystem, fresh_path, tidy, written
from .textkernel import slices, utf8

MAGIC, VERSION = 0x50534C5353540001, 1
FOOTER = struct.Struct("<QQQQQQQIIQ")
RESTART = 16


def key_bytes(doc_id: int | None, part: int = 0, seq: int = 0) -> bytes:
    return id_bytes(doc_id) + struct.pack(">II", part, seq)


def id_bytes(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else struct.pack(">BQ", 1, doc_id + (1 << 63))


def key_id(key: bytes) -> int | None:
    return struct.unpack_from(">Q", key, 1)[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(names: list[bytes], bits: int, k: int = 7) -> np.ndarray:
    """Bits of the filter, ``k`` for each name."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names)), ">u8").reshape(-1, 2).astype(np.uint64)
    return (h[:, :1] + np.arange(k, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) % np.uint64(bits)


class ShardWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, sink, width: int, block_bytes: int = 1 << 16):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.offset = self.docs = self.ids = 0
        self.index, self.names = [], []
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.first, self.last, self.entries, self.block_ids = bytearray(), [], None, b"", 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.first = key if self.first is None else self.first
        self.last = key
        self.entries += 1
        self.block_ids += len(value) // self.width
        name = key[:-8]
        if not self.names or self.names[-1] != name:
            self.names.append(name)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            body += struct.pack("<I", zlib.crc32(body))
            self.sink.write(body)
            self.index.append((self.first, self.offset, len(body), self.entries, self.block_ids))
            self.offset += len(body)
            self.docs += self.entries
            self.ids += self.block_ids
            self._fresh()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QQQQ", *x) for k, *x in self.index)
        bits = max(64, 10 * self.docs)
        held = np.zeros(bits, dtype=np.uint8)
        for a in range(0, len(self.names), 1 << 16):
            held[_probes(self.names[a : a + (1 << 16)], bits)] = 1
        self.sink.write(index + np.packbits(held, bitorder="little").tobytes())
        at = self.offset + len(index)
        self.sink.write(FOOTER.pack(self.offset, len(index), at, bits, self.docs, self.ids, len(self.index), self.width, VERSION, MAGIC))
        self.sink.close()


class ShardReader:
    """Lookups by binary search and ordered scans over a shard file (anything with ``seek`` and ``read``)."""

    def __init__(self, file, size: int):
        self.file = file
        index_at, index_len, bloom_at, self.bits, self.docs, self.ids, n, self.width, version, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of a known version")
        raw, at, self.index = self._read(index_at, index_len), 0, []
        for _ in range(n):
            (length,) = struct.unpack_from("<I", raw, at)
            key = raw[at + 4 : at + 4 + length]
            self.index.append((key, *struct.unpack_from("<QQQQ", raw, at + 4 + length)))
            at += 36 + length
        self.bloom = self._read(bloom_at, -(-self.bits // 8))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, at, length, _, _ = self.index[i]
        raw = self._read(at, length)
        if zlib.crc32(raw[:-4]) != struct.unpack_from("<I", raw, length - 4)[0]:
            raise ValueError("a block's checksum is wrong")
        (n,) = struct.unpack_from("<I", raw, length - 8)
        end = length - 8 - 4 * n
        return raw[:end], list(struct.unpack_from(f"<{n}I", raw, end))

    @staticmethod
    def _entries(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            further, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + further]
            at += further + length
            yield key, data[at - length : at]

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes([id_bytes(doc_id)], self.bits)[0].tolist())

    def find(self, doc_id: int | None) -> Iterator[bytes]:
        """The values of all documents of an identifier: Bloom filter, then block index, then restarts, then a scan."""
        name = id_bytes(doc_id)
        if not self.index or not self.may_hold(doc_id):
            return
        lo, hi = 0, len(self.index)
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.index[mid][0] < name else (lo, mid)
        data, restarts = self._block(lo)
        a, b = 0, len(restarts)
        while a + 1 < b:
            mid = (a + b) // 2
            a, b = (mid, b) if next(self._entries(data, restarts[mid]))[0] < name else (a, mid)
        at = restarts[a]
        while True:
            for k, v in self._entries(data, at):
                if k[:-8] == name:
                    yield v
                elif k > name:
                    return
            lo, at = lo + 1, 0
            if lo == len(self.index):
                return
            data, _ = self._block(lo)

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._entries(self._block(i)[0], 0)


#: What a tokenizer file must say for its texts to be cut here; any other goes through the library text by text.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Kinds of bytes in words of visible ASCII and two-byte Latin-1 letters: letters, single digits, signs; 0 sends the word to the library.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[[ord("'"), 0x97, 0xB7]] = 0  # contractions, and the multiplication and division signs
#: Lower case of those letters' bytes.
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[0x80:0x9F] += 32
#: How the byte-level model writes a byte: visible Latin-1 as it is, the rest from U+0100 on in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHAR = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def _expand(flat: np.ndarray, at: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``index`` of a ragged array one after the other, and their offsets."""
    n = at[index + 1] - at[index]
    out = np.zeros(len(index) + 1, dtype=np.int64)
    np.cumsum(n, out=out[1:])
    return flat[np.repeat(at[index] - out[:-1], n) + np.arange(out[-1])], out


def _offsets(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int64)


class WordTokenizer:
    """A word-level tokenizer file of the tokenizers library, encoding columns of texts.

    Where the file's normaliser and splitter never look across white space, a column's
    different words are encoded once: those of visible ASCII and Latin-1 letters are
    lower-cased and cut into pieces by array operations, and the library's model merges
    each new piece; every other word, and any that holds a special token's string, goes
    through the library whole.  Memos of pieces and words are bounded.
    """

    def __init__(self, path: str, memo: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        says = json.loads(self.lib.to_str())
        self.added = [t["content"] for t in says["added_tokens"]]
        self.by_word = (
            says["normalizer"] == _NORMALIZER
            and says["pre_tokenizer"] == _SPLITTER
            and says["model"]["type"] == "BPE"
            and not says["model"].get("dropout")
            and not any(says[k] for k in ("truncation", "padding"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"] != "".join(t["content"].split()) for t in says["added_tokens"])
        )
        wide = max(self.lib.get_vocab(with_added_tokens=True).values(), default=0) >= 1 << 16
        self.width, self.code, self.letter = (4, "<u4", "I") if wide else (2, "<u2", "H")
        self.most, self.words, self.pieces = memo, {}, {}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _merged(self, piece: bytes) -> bytes:
        """A lower-case piece by the file's model."""
        shown = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(_AS_CHAR)
        return self.pack([t.id for t in self.lib.model.tokenize(shown)])

    def _whole(self, word: str) -> bytes:
        return self.pack(self.lib.encode(word, add_special_tokens=False).ids)

    def _known(self, units: list, memo: dict, make) -> list[bytes]:
        """The units' ids from a memo that is emptied where new ones would overfill it."""
        out = list(map(memo.get, units))
        new = [i for i, x in enumerate(out) if x is None]
        if len(memo) + len(new) > self.most:
            memo.clear()
        for i in new:
            out[i] = memo[units[i]] = make(units[i])
        return out

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word of an array of different words, one after the other, and their offsets."""
        data, at = utf8(words)
        data, at = data[at[0] : at[-1]], at - at[0]
        size = np.diff(at)
        kind = _KIND[data]
        odd = np.zeros(len(words), dtype=bool)
        odd[np.searchsorted(at, np.flatnonzero(kind == 0), side="right") - 1] = True
        for token in self.added:
            odd |= pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        # Pieces of the other words: cut where the kind changes, at every digit and at word ends.
        plain = np.repeat(~odd, size)
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut[at[:-1][size > 0]] = True
        start = np.flatnonzero(cut & plain)
        low = _LOW[data[plain]]
        edge = np.append(np.cumsum(plain)[start] - 1, len(low)) if len(start) else np.zeros(1, np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(low)]).dictionary_encode()
        found = self._known(pieces.dictionary.to_pylist(), self.pieces, self._merged)
        rest = self._known(words.filter(pa.array(odd)).to_pylist(), self.words, self._whole)
        # A plain word is its pieces, any other one unit after all pieces.
        n = np.where(odd, 1, np.bincount(np.searchsorted(at, start, side="right") - 1, minlength=len(words)))
        first = np.concatenate([[0], np.cumsum(n)])
        unit = np.empty(first[-1], dtype=np.int64)
        is_odd = np.repeat(odd, n)
        unit[is_odd] = len(found) + np.arange(len(rest))
        unit[~is_odd] = pieces.indices.to_numpy(zero_copy_only=False)
        each = found + rest
        ids, ends = _expand(np.frombuffer(b"".join(each), self.code), _offsets(map(len, each)) // self.width, unit)
        return ids, ends[first]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column one after the other, and the texts' offsets; null counts as empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if not self.by_word:
            each = [e.ids for e in self.lib.encode_batch(column.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], dtype=self.code), _offsets(map(len, each))
        split = pc.ascii_split_whitespace(column)
        texts = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        ids, at = self._encode_words(words.dictionary)
        ids, at = _expand(ids, at, words.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        return ids, at[texts - texts[0]]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


MANIFEST = "shard string, part long, seq long, docs long, ids long"


def write_shards(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encodes every text and writes shard files under ``path``; returns the manifest, one row per file, in key order by (part, seq).

    Keys are dealt by range, repeated keys by a hash of their texts too, and each
    task sorts its range and starts a new file at ``shard_bytes``.
    """
    where, inside = filesystem(path)
    where.create_dir(inside, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        part, coder = TaskContext.get().partitionId(), word_tokenizer(tokenizer)
        end = coder.pack([end_id])
        out, writer, name, temp, last, seq = [], None, "", "", (), 0

        def close():
            writer.close()
            store.move(f"{folder}/{temp}", f"{folder}/{name}")
            out.append((name, part, len(out), writer.docs, writer.ids))

        for batch in batches:
            for piece in slices(batch, text):
                ids, at = coder.encode(piece.column(text))
                values, at = memoryview(ids).cast("B"), (at * coder.width).tolist()
                for i, k in enumerate(piece.column(key).to_pylist()):
                    if writer is None or writer.offset + len(writer.block) >= shard_bytes:
                        if writer is not None:
                            close()
                        name, temp = f"shard-{part:06d}-{len(out):04d}.sst", f".{uuid.uuid4().hex}"
                        writer = ShardWriter(store.open_output_stream(f"{folder}/{temp}"), coder.width)
                    seq = seq + 1 if k == last else 0
                    last = k
                    writer.add(key_bytes(k, part, seq), bytes(values[at[i] : at[i + 1]]) + end)
        if writer is not None:
            close()
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["shard", "part", "seq", "docs", "ids"])

    rows = df.select(F.col(key).cast("long").alias(key), text)
    dealt = rows.repartitionByRange(F.col(key).asc_nulls_first(), F.xxhash64(text)).sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text))
    return dealt.mapInArrow(tidy(run), MANIFEST)


def read_shards(manifest: DataFrame, path: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """Every document of the shards: key, start (ids of all documents before it), n_tokens, ids_crc32, and with ``ids`` the ids as little-endian 32-bit binary.

    The running sum is over one row per shard file.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", F.coalesce(F.sum("ids").over(order), F.lit(0)).cast("long").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{folder}/{shard}"
                rows, size = [], 0
                with store.open_input_file(name) as file:
                    reader = ShardReader(file, file.size())
                    for k, value in reader.scan():
                        raw = np.frombuffer(value, f"<u{reader.width}").astype("<u4").tobytes()
                        rows.append((key_id(k), start, len(raw) // 4, zlib.crc32(raw), *([raw] if ids else ())))
                        start += len(raw) // 4
                        size += len(raw) * ids
                        if len(rows) >= 10_000 or size > 8 << 20:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    kinds = [pa.int64()] * 4 + [pa.binary()] * ids
    names = [key, "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # A number of its own, as adaptive execution would put so small a table into one task.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "shard").mapInArrow(tidy(run), f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def op6_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_path(spark, "token-shards")
    manifest, _ = written(write_shards(docs, path, P.path("word_bpe_49k.json")), "token-manifest")
    return read_shards(manifest, path, ids=False)
