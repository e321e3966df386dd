"""MurmurHash3 x86-32 of 32-bit words, seed 17, in whole-column integer arithmetic (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def _mul(a: Column, b: int) -> Column:
    """Low 32 bits of a product of 32-bit values, without overflowing a signed long."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(_MASK)


def _rotl(a: Column, n: int) -> Column:
    return F.shiftleft(a, n).bitwiseOR(F.shiftright(a, 32 - n)).bitwiseAND(_MASK)


def murmur3_words(words: Column, seed: int = 17) -> Column:
    """Hash of an array of unsigned 32-bit words (as longs), as a long in 0 .. 2^32 - 1."""

    def mix(h: Column, w: Column) -> Column:
        k = _mul(_rotl(_mul(w.bitwiseAND(_MASK), 0xCC9E2D51), 15), 0x1B873593)
        return (_rotl(h.bitwiseXOR(k), 13) * 5 + 0xE6546B64).bitwiseAND(_MASK)

    def finish(h: Column) -> Column:
        h = h.bitwiseXOR((F.size(words) * 4).cast("long"))
        h = _mul(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B)
        h = _mul(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35)
        return h.bitwiseXOR(F.shiftright(h, 16))

    return F.aggregate(words, F.lit(seed).cast("long"), mix, finish)
