"""Deterministic integer mixers and shift registers, in bigint arithmetic with explicit 32-bit wrap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW32 = 0xFFFFFFFF
# The mixer's word and its shifted mask.
WORD, MASK31 = 273326509, 0x7FFFFFFF
TAPS16 = (0, 2, 3, 5)


def _and(x: Column, m: int) -> Column:
    return x.bitwiseAND(F.lit(m).cast("long"))


def static_random(seed: Column, upper: Column | int) -> Column:
    """A number below ``upper`` from a seed, always the same for one seed."""
    s = _and(seed.cast("long"), LOW32)
    t = s.bitwiseXOR(_and(F.shiftleft(s, 11), LOW32))
    w = WORD ^ (WORD >> 19)
    x = F.lit(w).cast("long").bitwiseXOR(t.bitwiseXOR(F.shiftright(t, 8)))
    return _and(x, MASK31) % (F.lit(upper).cast("long") if isinstance(upper, int) else upper)


def scaled_random(seed: Column, upper: int) -> Column:
    """The variant that scales by a fraction instead of taking a remainder."""
    s = _and(seed.cast("long"), LOW32)
    t = s.bitwiseXOR(_and(F.shiftleft(s, 11), LOW32))
    x = _and(F.lit(WORD ^ (WORD >> 19)).cast("long").bitwiseXOR(t.bitwiseXOR(F.shiftright(t, 8))), MASK31)
    return F.floor(x / F.lit(2147483648.0) * upper).cast("long")


def lfsr16_next(state: Column) -> Column:
    """One step of the 16-bit register: the taps' parity goes in at the top."""
    bit = F.lit(0).cast("long")
    for t in TAPS16:
        bit = bit.bitwiseXOR(F.shiftright(state, t))
    return F.shiftright(state, 1).bitwiseOR(F.shiftleft(_and(bit, 1), 15))


def lfsr16(seed: Column, steps: Column) -> Column:
    """The register's state after so many steps."""
    return F.aggregate(F.sequence(F.lit(1), steps), seed.cast("long"), lambda s, _: lfsr16_next(s))


def lfsr32(seed: Column, steps: Column) -> Column:
    """32 bits from two 16-bit registers, seeded by the two halves of the seed."""
    s = _and(seed.cast("long"), LOW32)
    return F.shiftleft(lfsr16(F.shiftright(s, 16), steps), 16).bitwiseOR(lfsr16(_and(s, 0xFFFF), steps))


def positions(item_hash: Column, k: int, size: int) -> Column:
    """The k positions of an item in a filter of ``size`` cells: seeds item_hash + 1 .. item_hash + k."""
    return F.array(*[static_random(item_hash + i, size) for i in range(1, k + 1)])


def iterated_positions(item_hash: Column, k: int, size: int) -> Column:
    """The k positions by the scaling variant: each position is the seed of the next."""
    out, seed = [], item_hash
    for _ in range(k):
        seed = scaled_random(seed, size)
        out.append(seed)
    return F.array(*out)
