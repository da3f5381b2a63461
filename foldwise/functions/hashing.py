"""Deterministic integer hash, the same in any SQL engine with 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the hash: a prime modulus below 2^31 and multipliers below it, so that no product leaves 64 bits.
MODULUS = 2_147_483_647
FOLD = 1_103_515_245
MULTIPLIERS = (1_597_334_677, 2_024_568_971, 1_812_433_253)
SHIFTS = (15, 13)
SEED_STEPS = (104_729, 1_299_709, 15_485_863)


def _offsets(seed: int) -> list[int]:
    """A number per round: the seed enters before the first multiplication and again between rounds."""
    return [((seed + 1) * step * (seed + step)) % MODULUS for step in SEED_STEPS]


def key_hash(key: Column | str, seed: int) -> Column:
    """A bigint in ``[0, MODULUS)`` for any non-negative integer key: the whole key is folded, then three rounds of
    multiply, add and modulus with xor-shifts between, so that two seeds give unrelated orders."""
    c = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    x = F.pmod(F.pmod(c, F.lit(MODULUS)) + F.pmod(F.shiftright(c, 31) * F.lit(FOLD), F.lit(MODULUS)), F.lit(MODULUS))
    for n, (factor, offset) in enumerate(zip(MULTIPLIERS, _offsets(seed))):
        if n:
            x = x.bitwiseXOR(F.shiftright(x, SHIFTS[n - 1]))
        x = F.pmod(x * F.lit(factor) + F.lit(offset), F.lit(MODULUS))
    return x


def hash_slice(hash_column: Column, parts: int) -> Column:
    """Slice number of a hash value, non-decreasing in the hash."""
    return F.floor(hash_column * F.lit(parts) / F.lit(MODULUS)).cast("int")


def hash_sql(key: str, seed: int) -> str:
    """The same hash as SQL text."""
    x = f"((({key}) % {MODULUS} + (cast({key} as bigint) >> 31) * {FOLD} % {MODULUS}) % {MODULUS})"
    for n, (factor, offset) in enumerate(zip(MULTIPLIERS, _offsets(seed))):
        if n:
            x = f"xor({x}, {x} >> {SHIFTS[n - 1]})"
        x = f"(({x} * {factor} + {offset}) % {MODULUS})"
    return x
