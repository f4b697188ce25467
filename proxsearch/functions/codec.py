"""Delta coding and the size of variable-length integers, as column expressions and over arrays that hold many lists one after another."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def delta_encode(values: Column) -> Column:
    """Array of differences; the first element stays."""
    return F.transform(values, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(values, i - 1)))


def delta_decode(deltas: Column) -> Column:
    """Running sums: the inverse of delta_encode. For long lists use delta_decode_rows."""
    return F.aggregate(deltas, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))


def delta_decode_rows(delta: Column, keys: list[str], order: str) -> Column:
    """As delta_decode, over rows of one difference each: the time is in proportion to a list's length."""
    return F.sum(delta).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def varint_size(value: Column) -> Column:
    """Bytes of a 32-bit integer in groups of 7 bits; a negative one takes 5."""
    over = [F.when(value >= (1 << bits), 1).otherwise(0) for bits in (7, 14, 21, 28)]
    return F.when(value < 0, 5).otherwise(1 + over[0] + over[1] + over[2] + over[3])


def encode_lists(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As delta_encode, of lists one after another; ``sizes``: how many values each has, at least one."""
    first = np.cumsum(sizes) - sizes
    deltas = np.diff(values, prepend=0)
    deltas[first] = values[first]
    return deltas


def decode_lists(deltas: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The inverse of encode_lists."""
    first = np.cumsum(sizes) - sizes
    sums = np.cumsum(deltas)
    return sums - np.repeat(sums[first] - deltas[first], sizes)


def varint_sizes(values: np.ndarray) -> np.ndarray:
    """As varint_size, of each value."""
    return np.where(values < 0, 5, 1 + sum((values >= (1 << bits)).astype(np.int64) for bits in (7, 14, 21, 28)))
