"""Device strategies: everything a device loses is a function of its identifier's SHA-256.

All are column expressions.  Generator states are unsigned 32-bit numbers held in
longs; products stay below 2**53.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_half_up, unsigned32
from .tables import INCREMENTS, LUMINANCE, int_array

_LONG = "bigint"


def device_name(i: Column) -> Column:
    """The number in three digits at least; ``lpad`` would cut longer ones to its width."""
    digits = i.cast("string")
    return F.concat(F.lit("DEVICE-"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), "0"))


def digest(device: Column) -> Column:
    """Lower-case hex SHA-256 of the identifier."""
    return F.sha2(device.cast("binary"), 256)


def hex_number(hex_text: Column, start: int, length: int) -> Column:
    """The number that ``length`` hex digits from ``start`` (0-based) write."""
    return F.conv(F.substring(hex_text, start + 1, length), 16, 10).cast(_LONG)


def digest_byte(hex_text: Column, i: int) -> Column:
    return hex_number(hex_text, 2 * i, 2)


def _nonzero(seed: Column) -> Column:
    return F.when(seed == 0, F.lit(1).cast(_LONG)).otherwise(seed)


def next_state(state: Column) -> Column:
    return unsigned32(state * F.lit(1664525).cast(_LONG) + F.lit(1013904223).cast(_LONG))


def unit(state: Column) -> Column:
    return state / F.lit(4294967296.0)


def text_seed(hex_text: Column) -> Column:
    """31-multiplier hash of the digest's 64 hex characters."""
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast(_LONG), lambda h, k: unsigned32(h * 31 + F.ascii(F.substr(hex_text, k, F.lit(1)))))
    return _nonzero(fold)


def quantization_order(device: Column) -> Column:
    """A device's permutation of the 64 positions (array of int): a shuffle from the last place down."""

    def swap(acc: Column, i: Column) -> Column:
        state = next_state(acc["s"])

        def move(a: Column) -> Column:
            j = F.floor(unit(a["s"]) * (i + 1)).cast("int")
            # One level of nesting gives j and the state one evaluation each.
            order = F.transform(F.array(F.struct(j.alias("j"), a["o"].alias("o"))), lambda t: F.transform(t["o"], lambda x, k: F.when(k == i, F.get(t["o"], t["j"])).when(k == t["j"], F.get(t["o"], i)).otherwise(x)))
            return F.struct(a["s"].alias("s"), F.get(order, F.lit(0)).alias("o"))

        return F.get(F.transform(F.array(F.struct(state.alias("s"), acc["o"].alias("o"))), move), F.lit(0))

    first = F.struct(text_seed(digest(device)).alias("s"), F.sequence(F.lit(0), F.lit(63)).alias("o"))
    return F.aggregate(F.sequence(F.lit(63), F.lit(1), F.lit(-1)), first, swap)["o"]


def quantizer(inc: Column, rank: Column, level: Column) -> Column:
    """Quantizer of the coefficient at ``rank`` in the device's order: whole rounds and the started one, 255 at most."""
    steps = F.greatest(level, F.lit(0))
    return F.least(F.lit(255), 1 + inc * (F.floor(steps / 64) + F.when(rank < F.pmod(steps, F.lit(64)), 1).otherwise(0))).cast("int")


def quantizer_matrix(order: Column, level: Column) -> Column:
    """The 64 quantizers, row by row, of an order at a level."""
    steps = F.greatest(level, F.lit(0))
    started = F.slice(order, F.lit(1), F.pmod(steps, F.lit(64)).cast("int"))
    raised = lambda inc, p, s: F.least(F.lit(255), 1 + inc * (F.floor(steps / 64) + F.when(F.array_contains(s, p), 1).otherwise(0))).cast("int")
    # One level of nesting gives the order one evaluation for all positions.
    return F.get(F.transform(F.array(started), lambda s: F.transform(int_array(INCREMENTS), lambda inc, p: raised(inc, p, s))), F.lit(0))


def frequency_mask(device: Column) -> Column:
    """Which zigzag positions a device keeps (64 booleans): squared draws until enough differ, the first always."""
    h = digest(device)
    wanted = (16 + F.floor(digest_byte(h, 0) / 255 * 10)).cast("int")

    def draw(acc: Column, _: Column) -> Column:
        s = next_state(acc["s"])
        grown = F.transform(F.array(s), lambda x: F.struct(x.alias("s"), F.array_union(acc["k"], F.array(F.floor(unit(x) * unit(x) * 64).cast("int"))).alias("k")))
        return F.when(F.size(acc["k"]) >= wanted, acc).otherwise(F.get(grown, F.lit(0)))

    first = F.struct(_nonzero(hex_number(h, 0, 8)).alias("s"), F.array(F.lit(0)).alias("k"))
    kept = F.aggregate(F.sequence(F.lit(1), F.lit(256)), first, draw)["k"]
    return F.get(F.transform(F.array(kept), lambda k: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array_contains(k, i))), F.lit(0))


def luminance_matrix(device: Column) -> Column:
    """The luminance quantizers varied by up to 40 % (64 ints, row by row)."""

    def vary(acc: Column, base: Column) -> Column:
        out = F.transform(F.array(next_state(acc["s"])), lambda s: F.struct(s.alias("s"), F.concat(acc["m"], F.array(F.greatest(F.lit(1), round_half_up(base * (F.lit(0.6) + unit(s) * F.lit(0.8))).cast("int")))).alias("m")))
        return F.get(out, F.lit(0))

    first = F.struct(_nonzero(hex_number(digest(device), 16, 8)).alias("s"), F.array().cast("array<int>").alias("m"))
    return F.aggregate(int_array(LUMINANCE), first, vary)["m"]


def channel_weights(device: Column) -> Column:
    """Shares of Y, Cb and Cr; null where all three bytes are 0."""
    h = digest(device)
    part = [digest_byte(h, i) / F.lit(255.0) for i in (12, 13, 14)]
    whole = part[0] + part[1] + part[2]
    return F.struct(*[F.try_divide(p, whole).alias(n) for p, n in zip(part, ("y", "cb", "cr"), strict=True)])


def spatial_pattern(device: Column) -> Column:
    return F.pmod(digest_byte(digest(device), 15), F.lit(4)).cast("int")


def wavelet_threshold(device: Column) -> Column:
    return F.pmod(hex_number(digest(device), 0, 8), F.lit(50)) / F.lit(100.0)


def run_break_phase(device: Column) -> Column:
    return F.pmod(hex_number(digest(device), 0, 4), F.lit(16)).cast("int")


def dct_strategy(device: Column) -> Column:
    """Digest, mask, matrix, weights and pattern in one struct."""
    return F.struct(
        digest(device).alias("strategy_hash"), frequency_mask(device).alias("frequency_mask"), luminance_matrix(device).alias("quant"),
        channel_weights(device).alias("weights"), spatial_pattern(device).alias("spatial_pattern"),
    )


def qdct_strategy(device: Column) -> Column:
    """Identifier, order and the nominal increase (a fixed value) in one struct."""
    return F.struct(device.alias("device_id"), quantization_order(device).alias("quantization_order"), F.lit(0.1).alias("quantization_increase"))
