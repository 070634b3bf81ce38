"""Deterministic hash fractions, splits and fill-in-the-middle boundaries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TWO_64 = float(1 << 64)


def hash64(key: Column) -> Column:
    """The first 64 bits of the key's SHA-256, as DECIMAL(20,0): Spark has no unsigned long."""
    return F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)")


def hash_fraction(key: Column) -> Column:
    """hash64 over 2**64, from 0 to 1."""
    return hash64(key).cast("double") / F.lit(_TWO_64)


def hash_modulo(key: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return (hash64(key) % n.cast("decimal(20,0)")).cast("long")


def split_name(key: Column, train: float, validation: float) -> Column:
    """train, validation or test by the key's hash fraction; the shares add up to 1 with the rest for test."""
    if not 0 <= train + validation <= 1 + 1e-6:
        raise ValueError("shares have to add up to 1")
    x = hash_fraction(key)
    return F.when(x < F.lit(float(train)), "train").when(x < F.lit(float(train + validation)), "validation").otherwise("test")


def fim_bounds(key: Column, length: Column, least: int) -> tuple[Column, Column]:
    """(first, second) cut of a text in three segments of `least` characters or more, from two hashes of its id."""
    spare = length - 3 * least
    first = least + hash_modulo(F.concat(key, F.lit(":fill_in_middle:first")), spare + 1)
    second = first + least + hash_modulo(F.concat(key, F.lit(":fill_in_middle:second")), length - 2 * least - first + 1)
    return first, second
