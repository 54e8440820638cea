"""Keyed hashes, the green predicate and test statistics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 32 bits that depends on all parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def below(share: float, *parts: Column) -> Column:
    """``uniform(*parts) < share``, compared as hexadecimal digits, which needs no conversion."""
    return _below(share, F.concat_ws(":", *[p.cast("string") for p in parts]))


def _below(share: float, text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8) < F.lit(f"{math.ceil(share * 4294967296):08x}")


def is_green(before: Column, token: Column, key: int, gamma: float, select_green: bool = True) -> Column:
    """Whether a token is on the green list that the token before it seeds.

    The list is the set of tokens whose keyed hash falls below gamma, so
    membership takes one hash and no list is ever made. Without
    ``select_green`` it is the upper end: those not below 1 - gamma.
    """
    return below(gamma, F.lit(key), before, token) if select_green else ~below(1 - gamma, F.lit(key), before, token)


def green_text(hashed: Column, gamma: float, select_green: bool = True) -> Column:
    """``is_green`` of a key and two tokens that are joined by colons already."""
    return _below(gamma, hashed) if select_green else ~_below(1 - gamma, hashed)


def neighbours(tokens: Column) -> Column:
    """Each token from the second on with the one before it, as structs (prev, token); null for a null array.

    What is done with a pair needs nothing of the array. A function of places
    that looks tokens up in the array has the array made anew for every place
    where the optimizer puts its definition for its name, as it does for the
    filters that it infers from an explosion.
    """
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.arrays_zip(F.slice(tokens, F.lit(1), rest).alias("prev"), F.slice(tokens, F.lit(2), rest).alias("token"))


def green_bits(tokens: Column, key: int, gamma: float, select_green: bool = True) -> Column:
    """0/1 for each token from the second on."""
    return F.transform(neighbours(tokens), lambda p: F.when(is_green(p["prev"], p["token"], key, gamma, select_green), 1).otherwise(0))


def z_score(green: Column, n: Column, gamma: float) -> Column:
    """(k - gamma n) / sqrt(n gamma (1 - gamma)); 0 for n = 0."""
    return F.when(n > 0, (green - gamma * n) / F.sqrt(F.greatest(n, F.lit(1)) * (gamma * (1 - gamma)))).otherwise(F.lit(0.0))


def green_fraction(green: Column, n: Column) -> Column:
    return F.when(n > 0, green / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))


#: Coefficients of a published polynomial fit of the complementary error function; fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def p_value(z: Column | str) -> Column:
    """Upper tail of the normal distribution, to a relative error below 1.2e-7; null stays null."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    inner = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        inner = c + t * inner
    tail = 0.5 * t * F.exp(inner - x * x)
    return F.when(z >= 0, tail).when(z < 0, 1 - tail)


def ones(bits: Column) -> Column:
    return F.length(bits) - F.length(F.replace(bits, F.lit("1"), F.lit("")))


def longest_run(bits: Column) -> tuple[Column, Column]:
    """Length of the longest run between zeros, and how many runs have it."""
    runs = F.transform(F.filter(F.split(bits, "0"), lambda r: r != ""), lambda r: F.length(r))
    longest = F.coalesce(F.array_max(runs), F.lit(0))
    return longest, F.coalesce(F.size(F.filter(runs, lambda r: r == longest)), F.lit(0))


def skew(value: str | Column) -> Column:
    """Biased skewness; 0 for constant values and up to two of them."""
    return F.when(F.count(value) > 2, F.coalesce(F.skewness(value), F.lit(0.0))).otherwise(F.lit(0.0))


def excess(value: str | Column) -> Column:
    """Biased excess kurtosis; 0 for constant values and up to three of them."""
    return F.when(F.count(value) > 3, F.coalesce(F.kurtosis(value), F.lit(0.0))).otherwise(F.lit(0.0))


def places(c: Column | str, n: int) -> Column:
    """To ``n`` places, halves away from zero, by the binary product, as other engines round doubles; ``F.round`` goes by the decimal text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * F.floor(F.abs(c) * 10**n + 0.5) / 10**n + F.lit(0.0)
