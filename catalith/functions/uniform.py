"""Reproducible random numbers: functions of a key, so independent of partitioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(*parts: Column | str) -> Column:
    """md5 of the parts joined by ":"."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))


def _fraction(h: Column, first: int) -> Column:
    """In [0, 1): 13 hex digits of a hash over 2^52."""
    return F.conv(F.substring(h, first, 13), 16, 10).cast("double") / float(2**52)


def uniform(*parts: Column | str) -> Column:
    """In [0, 1): the first 13 hex digits of md5(parts joined by ":") over 2^52."""
    return _fraction(key_hash(*parts), 1)


def deviate(h: Column) -> Column:
    """Standard normal by Box and Muller from two uniforms: the first 13 hex digits of a hash, and the next 13."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _fraction(h, 1))) * F.cos(F.lit(2.0 * math.pi) * _fraction(h, 14))


def gaussian(*parts: Column | str) -> Column:
    """Standard normal of a key."""
    return deviate(key_hash(*parts))


# Fixed values of the 64-bit mixer (a public-domain generator: a counter times STEP, mixed).
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def counted(seed: int, counter: np.ndarray) -> np.ndarray:
    """In [0, 1): the number of each counter (unsigned 64 bits) of a seed, for tasks that draw very many."""
    with np.errstate(over="ignore"):
        z = counter.astype(np.uint64) * np.uint64(STEP) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53


def counted_normals(seed: int, counter: np.ndarray) -> np.ndarray:
    """Standard normals by Box and Muller from the numbers 2 c and 2 c + 1 of each counter c."""
    with np.errstate(over="ignore"):
        c = counter.astype(np.uint64) * np.uint64(2)
    return np.sqrt(-2 * np.log(1 - counted(seed, c))) * np.cos(2 * math.pi * counted(seed, c + np.uint64(1)))
