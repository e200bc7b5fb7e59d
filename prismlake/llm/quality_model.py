"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text: its different 1- and 2-grams of tokens (runs of letters and
digits, runs of other visible characters; A-Z lower-cased), hashed into
``2**bits`` places and scaled to unit length; and, for 1-, 2- and 3-grams, which
shares of the tokens belong to n-grams that occur once, twice, up to 4, 8, 16
times or more.  A text's score is the logistic of a sparse dot product.

The model is fitted on a sample of labelled rows with a bounded expected size
(``sample_rows``): rows whose identifier's hash is below sample_rows / rows.
Their features, not their texts, go to one task that runs FTRL-proximal over
them in hash order.  The weights (2**bits floats) are the only thing sent to the
driver and the workers.

Defined results for odd input: a null or empty text has no features and gets the
logistic of the bias.  Rows with null labels are not learnt from.  Repeated rows
score alike.  Without any training row every score is 0.5.  Extra columns stay;
columns named like the results are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from .storage import add_columns, tidy
from .textkernel import mix64, slices, word_hashes

_ORDERS, _SHARES = 3, 6


@dataclass(frozen=True)
class Ftrl:
    """Follow-the-regularised-leader settings."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3
    epochs: int = 3


def features(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of every text; place 2**bits is the bias."""
    hashes, at = word_hashes(column, split_classes=True)
    grams = [hashes]
    for n in range(2, _ORDERS + 1):
        grams.append(mix64(grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1 :]) if len(hashes) >= n else hashes[:0])
    size = 1 << bits
    for a, b in zip(at[:-1], at[1:], strict=True):
        places, values = [np.array([size])], [np.ones(1)]
        different = []
        for n in range(1, _ORDERS + 1):
            own = np.sort(grams[n - 1][a : max(a, b - n + 1)])
            if not len(own):
                break
            start = np.concatenate([[True], own[1:] != own[:-1]])
            count = np.diff(np.concatenate([np.flatnonzero(start), [len(own)]]))
            share = np.bincount(np.minimum(np.ceil(np.log2(count)).astype(np.int64), _SHARES - 1), weights=count, minlength=_SHARES) / len(own)
            places.append(size + 1 + (n - 1) * _SHARES + np.arange(_SHARES))
            values.append(share)
            if n < 3:
                different.append((mix64(own[start] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
        if different:
            place = np.unique(np.concatenate(different))
            places.append(place)
            values.append(np.full(len(place), len(place) ** -0.5))
        yield np.concatenate(places), np.concatenate(values)


def _width(bits: int) -> int:
    return (1 << bits) + 1 + _ORDERS * _SHARES


def sigmoid(x: float | np.ndarray):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], width: int, setting: Ftrl) -> np.ndarray:
    """Weights after ``epochs`` passes over (places, values, label) rows."""
    z, n = np.zeros(width), np.zeros(width)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        short = np.abs(zi) <= setting.l1
        return np.where(short, 0.0, (np.sign(zi) * setting.l1 - zi) / ((setting.beta + np.sqrt(ni)) / setting.alpha + setting.l2))

    for _ in range(setting.epochs):
        for place, value, y in rows:
            zi, ni = z[place], n[place]
            w = weights(zi, ni)
            g = (sigmoid(w @ value) - y) * value
            after = ni + g * g
            z[place] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / setting.alpha * w
            n[place] = after
    return weights(z, n).astype(np.float32)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bits: int = 18, setting: Ftrl = Ftrl()) -> np.ndarray:
    """Fits the weights on all rows of ``labelled`` (see ``sample`` for its bound)."""
    width = _width(bits)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                f = list(features(part.column(text), bits))
                yield pa.RecordBatch.from_arrays(
                    [part.column("h"), part.column(label).cast(pa.float64()), pa.array([p.astype("<i4").tobytes() for p, _ in f], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in f], pa.binary())],
                    ["h", "y", "places", "features"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for y, p, v in zip(*[batch.column(c).to_pylist() for c in ("y", "places", "features")], strict=True):
                rows.append((np.frombuffer(p, "<i4"), np.frombuffer(v, "<f4"), y))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([fit_ftrl(rows, width, setting).tobytes()], pa.binary())], ["weights"])

    rows = labelled.filter(F.col(label).isNotNull()).select(F.xxhash64(key).alias("h"), label, text)
    made = rows.mapInArrow(tidy(featurise), "h long, y double, places binary, features binary")
    found = made.repartition(1).sortWithinPartitions("h", "y", "places").mapInArrow(tidy(learn), "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros(width, np.float32)


def sample(labels: DataFrame, key: str = "doc_id", sample_rows: int = 12_000) -> DataFrame:
    """Rows whose identifier's hash is in the share that holds ``sample_rows`` rows on average."""
    share = min(1.0, sample_rows / max(1, labels.count()))
    return labels.filter(F.shiftrightunsigned(F.xxhash64(key), 11) < int(share * (1 << 53)))


def score(df: DataFrame, weights: np.ndarray, text: str = "text", bits: int = 18, threshold: float = 0.7, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds score (0 to 1, higher: better) and predicted (score >= threshold)."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]

    def make(column: pa.Array) -> list[pa.Array]:
        w = shared.value
        s = sigmoid(np.array([float(w[p] @ v) for p, v in features(column, bits)]))
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return add_columns(df, text, fields, make, drop)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000) -> np.ndarray:
    """Weights from the quality labels of rows that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).select("doc_id", "quality").dropDuplicates(["doc_id"])
    chosen = sample(known, sample_rows=sample_rows)
    # About sample_rows rows of 12 bytes, whatever the input: a proven bound for the broadcast.
    return train(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, weights, drop=("text",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
