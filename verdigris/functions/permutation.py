"""Keyed permutations of [0, size): as a column, as numpy arrays, and backwards.

A number is a pair of digits in mixed radix, ``size`` or slightly more in all.
``ROUNDS`` times one digit is moved on by a keyed mix of the other, which is a
bijection whatever the mix (a generalised Feistel network). The radices are
chosen so that few numbers, mostly none to five, lie beyond ``size``; a result
that is one of them is permuted again, as often as there are such numbers at
most, so the outcome is a bijection of [0, size) exactly.

With it a green list of an exact length needs no list: a token is green if its
permuted id is below that length. Keys are derived from an MD5 digest of the
list's seed, so other engines can be made to agree.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
_MASK = 0xFFFFFFFF
#: Odd multiplier of the mix, and what tells the rounds' keys apart; fixed values.
_FACTOR, _STEP = 0x45D9F3B, 0x9E3779B9


@lru_cache
def radices(size: int) -> tuple[int, int]:
    """(a, b) with a * b >= size, the least excess, and a the largest such number up to the root."""
    root = math.isqrt(max(size, 1) - 1) + 1
    return min(((a, -(-size // a)) for a in range(root, max(root // 4, 0), -1)), key=lambda p: p[0] * p[1] - size)


def _keys(seed: Column) -> Column:
    """The rounds' keys, from the seed's digest."""
    digest = F.md5(seed)
    words = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    return F.transform(F.array(*words), lambda w: w)


def _mix(v: Column) -> Column:
    v = v.bitwiseXOR(F.shiftright(v, 16))
    v = (v * F.lit(_FACTOR)).bitwiseAND(F.lit(_MASK))
    return v.bitwiseXOR(F.shiftright(v, 16))


def _once(x: Column, keys: Column, a: int, b: int, backwards: bool) -> Column:
    rounds = F.array(*[F.lit(k) for k in (range(ROUNDS)[::-1] if backwards else range(ROUNDS))])
    sign = -1 if backwards else 1

    def turn(p: Column, k: Column) -> Column:
        key = (F.get(keys, k % 4) + k * F.lit(_STEP)).bitwiseAND(F.lit(_MASK))
        even = k % 2 == 0
        moved = _mix((F.when(even, p["r"]).otherwise(p["l"]) + key).bitwiseAND(F.lit(_MASK)))
        l, r = F.pmod(p["l"] + sign * moved, F.lit(a)), F.pmod(p["r"] + sign * moved, F.lit(b))  # noqa: E741
        return F.struct(F.when(even, l).otherwise(p["l"]).alias("l"), F.when(even, p["r"]).otherwise(r).alias("r"))

    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).cast("bigint").alias("r"))
    return F.aggregate(rounds, start, turn, lambda p: p["l"] * b + p["r"])


def permuted(x: Column, size: int, seed: Column, backwards: bool = False) -> Column:
    """Where the permutation that ``seed`` (text) names sends ``x`` in [0, size); null for others, and for a null seed."""
    a, b = radices(size)
    again = a * b - size
    x, keys = x.cast("bigint"), _keys(seed)

    def walked(ks: Column) -> Column:
        first = _once(x, ks, a, b, backwards)
        if not again:
            return first
        return F.aggregate(F.sequence(F.lit(1), F.lit(again)), first, lambda y, _: F.when(y < size, y).otherwise(_once(y, ks, a, b, backwards)))

    once = F.get(F.transform(F.array(keys), walked), 0)  # binds the keys, so they are derived once
    return F.when((x >= 0) & (x < size) & seed.isNotNull(), once)


def permute(x: np.ndarray, size: int, seed: str, backwards: bool = False) -> np.ndarray:
    """``permuted`` of an array of numbers in [0, size)."""
    return permute_by(x, size, hashlib.md5(seed.encode()).hexdigest(), backwards)


def permute_by(x: np.ndarray, size: int, digest: str, backwards: bool = False) -> np.ndarray:
    """``permute`` by the seed's MD5 digest."""
    a, b = radices(size)
    words = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    sign = -1 if backwards else 1

    def once(y: np.ndarray) -> np.ndarray:
        l, r = y // b, y % b  # noqa: E741
        for k in range(ROUNDS)[::sign]:
            v = ((r if k % 2 == 0 else l) + ((words[k % 4] + k * _STEP) & _MASK)) & _MASK
            v ^= v >> 16
            v = (v * _FACTOR) & _MASK
            v ^= v >> 16
            if k % 2 == 0:
                l = (l + sign * v) % a  # noqa: E741
            else:
                r = (r + sign * v) % b
        return l * b + r

    out = once(np.asarray(x, np.int64))
    while (beyond := out >= size).any():
        out[beyond] = once(out[beyond])
    return out
