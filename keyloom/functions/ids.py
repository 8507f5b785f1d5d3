"""Wide identifiers as arrays of unsigned 32-bit limbs, most significant first.

Array order is byte order, so ``<`` and ``==`` compare ids; XOR and prefix length stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 32
FULL_LIMBS = 16


def limbs(hex_digits: Column, n: int) -> Column:
    """``n`` limbs from a string of hex digits, short ones filled up with zeros on the right."""
    text = F.rpad(hex_digits, 8 * n, "0")
    return F.array(*[F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)])


def from_bytes(raw: Column, n: int = FULL_LIMBS) -> Column:
    """An id from at most 4 * n bytes; more are an error."""
    return F.when(F.octet_length(raw) > 4 * n, F.raise_error(F.lit("too many bytes for an identifier"))).otherwise(limbs(F.hex(raw), n))


def md5_id(text: Column) -> Column:
    """A 128-bit id (four limbs) from text: the cheap width for lookups by key."""
    return limbs(F.md5(text.cast("string").cast("binary")), 4)


def hashed(raw: Column) -> Column:
    """SHA-512 of an id's bytes as an id of 16 limbs."""
    return limbs(F.sha2(raw, 512), FULL_LIMBS)


def xor(a: Column, b: Column) -> Column:
    """The distance of two ids."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def prefix_length(distance: Column, n: int) -> Column:
    """Leading zero bits of a distance of ``n`` limbs: how many bits two ids share."""
    at = F.array_position(F.transform(distance, lambda x: x != 0), True)
    limb = F.element_at(distance, F.when(at > 0, at).otherwise(1).cast("int"))
    return F.when(at == 0, F.lit(LIMB * n)).otherwise(LIMB * (at - 1) + LIMB - F.length(F.bin(limb))).cast("int")


def closer(a: Column, b: Column, target: Column) -> Column:
    """Of two ids the one nearer to the target (the first, if equally near)."""
    return F.when(xor(a, target) <= xor(b, target), a).otherwise(b)


def wrap32(x: Column) -> Column:
    """The signed 32-bit value of the low bits of a bigint."""
    low = x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


# The multipliers of the sixteen words of an id made from one integer.
KEY_FACTORS = (1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def swapped(word: Column) -> Column:
    """A 32-bit word whose four bytes stand little-endian, as an unsigned big-endian limb."""
    low = word.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    out = F.lit(0).cast("long")
    for i in range(4):
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftright(low, 8 * i).bitwiseAND(F.lit(255).cast("long")))
    return out


def from_int(x: Column) -> Column:
    """An id from one integer: its multiples as little-endian words."""
    return F.array(*[swapped(x.cast("long") * k) for k in KEY_FACTORS])


def hash_code(octets: Column) -> Column:
    """Fold of an array of bytes (0 to 255) by h * 31 ^ b in 32 bits."""
    return F.aggregate(octets, F.lit(0).cast("long"), lambda h, b: wrap32((h * 31).bitwiseXOR(b.cast("long"))))


def as_guids(digits: Column) -> Column:
    """128 hex digits as four slash-separated groups of 32 digits with dashes."""
    parts = []
    for i in range(4):
        p = F.substring(digits, 32 * i + 1, 32)
        parts.append(F.concat_ws("-", F.substring(p, 1, 8), F.substring(p, 9, 4), F.substring(p, 13, 4), F.substring(p, 17, 4), F.substring(p, 21, 12)))
    return F.concat_ws("/", *parts)


def from_guids(text: Column) -> Column:
    return F.regexp_replace(text, "[-/]", "")


def with_prefix(base: Column, noise: Column, bits: Column, n: int) -> Column:
    """The first ``bits`` bits of ``base``, the rest from ``noise``."""
    out = []
    for i in range(n):
        keep = F.least(F.greatest(bits - LIMB * i, F.lit(0)), F.lit(LIMB)).cast("int")
        low = F.expr("1L").cast("long")
        mask = F.call_function("shiftleft", low, F.lit(LIMB) - keep) - 1
        out.append(base[i].bitwiseAND(F.bitwise_not(mask)).bitwiseOR(noise[i].bitwiseAND(mask)))
    return F.array(*out)


def advanced(octets: Column, by: Column, n: int) -> Column:
    """The id ``by`` places on, as an array of ``n`` limbs: ordinary addition with carry, modulo the id's width."""
    out, carry = [], by.cast("long")
    for i in range(n - 1, -1, -1):
        total = octets[i] + carry
        out.append(total.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
        carry = F.shiftright(total, LIMB)
    return F.array(*out[::-1])


def chunk_key(root: Column, index: Column, n: int = 4) -> Column:
    """The key of a chunk: the digest of its root's id advanced by the index (MD5 for four limbs, else SHA-512)."""
    at = advanced(root, index, n)
    digits = F.concat(*[F.lpad(F.lower(F.hex(at[i])), 8, "0") for i in range(n)])
    return limbs(F.md5(F.unhex(digits)), 4) if n == 4 else hashed(F.unhex(digits))


def random_id(seed: Column, n: int = 4) -> Column:
    """An id drawn from a seed, the same at every run; unlike seeds have unlike ids."""
    return limbs(F.concat(*[F.md5(F.concat(seed.cast("string"), F.lit(f"/{i}")).cast("binary")) for i in range(-(-n // 4))]), n)
