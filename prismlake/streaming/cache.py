"""Compression requests that build on a device's earlier result.

A device keeps the last level it was compressed to.  A request for a higher level
recompresses that earlier result, any other starts from the image.  The answer
depends on the order of requests, so a device's requests are folded in order; the
streaming form keeps the same state per device.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec_math as m
from ..functions import strategy as st
from ..functions.tables import INCREMENTS, basis


def quantizers(order: np.ndarray, level: int) -> np.ndarray:
    """Quantizers of 64 positions, row by row."""
    rounds, started = divmod(max(0, int(level)), 64)
    steps = np.full(64, rounds)
    steps[np.asarray(order, dtype=int)[:started]] += 1
    return np.minimum(255, 1 + np.array(INCREMENTS) * steps)


def code(samples: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.floor(basis() @ samples / q + 0.5)


def decode(coefficients: np.ndarray, q: np.ndarray) -> np.ndarray:
    return basis().T @ (coefficients * q)


def _answer(held: dict, device: str, seq: int, level: int, order, samples: np.ndarray) -> tuple[str, int, int, bool, int]:
    """Updates the state of a device; (device, seq, level, from the cache, nonzeros)."""
    cached = held.get("level") is not None and held["level"] < level
    source = decode(np.array(held["coefficients"]), quantizers(order, held["level"])) if cached else samples
    coefficients = code(source, quantizers(order, level))
    if held.get("level") is None or held["level"] < level or not cached:
        held["level"], held["coefficients"] = int(level), coefficients.tolist()
    return device, seq, int(level), cached, int((coefficients != 0).sum())


RESULT = "device_id string, seq long, level int, from_cache boolean, nonzeros int"


def fold(requests: DataFrame) -> DataFrame:
    """Rows device_id, seq, quality, samples (64 doubles of one block): the answers in order of seq.

    A device's requests go to one task in its order; they are one device's own.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        pdf = pdf.sort_values("seq")
        rows = [_answer(held, r.device_id, r.seq, r.level, r.order, np.asarray(r.samples)) for r in pdf.itertuples()]
        return pd.DataFrame(rows, columns=["device_id", "seq", "level", "from_cache", "nonzeros"])

    return _prepared(requests).groupBy("device_id").applyInPandas(run, RESULT)


def stream(requests: DataFrame) -> DataFrame:
    """The same over a streaming relation; a device's state is its level and coefficients."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, coefficients = state.get if state.exists else (None, None)
        held = {"level": level, "coefficients": coefficients} if level is not None else {}
        every = pd.concat(list(batches)).sort_values("seq")
        rows = [_answer(held, r.device_id, r.seq, r.level, r.order, np.asarray(r.samples)) for r in every.itertuples()]
        state.update((held["level"], held["coefficients"]))
        yield pd.DataFrame(rows, columns=["device_id", "seq", "level", "from_cache", "nonzeros"])

    return _prepared(requests).groupBy("device_id").applyInPandasWithState(run, RESULT, "level int, coefficients array<double>", "append", "NoTimeout")


def _prepared(requests: DataFrame) -> DataFrame:
    return requests.select("device_id", "seq", m.level_of_quality(F.col("quality")).alias("level"), st.quantization_order(F.col("device_id")).alias("order"), "samples")
