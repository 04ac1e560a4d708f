"""A filter of fixed size that tells which join keys cannot meet anything.

One bit stands for every key of the asking side (a Bloom filter with one hash, as keys are hashes already).  The
other side drops keys without a bit before they leave Python, so only keys that may meet are shuffled.  Nothing that
meets is ever dropped, whatever the number of keys: a crowded filter lets more through, and is never larger than
``2 ** BITS`` bits (8 MB).  Bits are set with a group-by whose map-side part already merges them.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26
_U = np.uint64


def key_filter(keys: DataFrame, column: str = "key", bits: int = BITS) -> Broadcast:
    """The filter of a written table of non-negative integer keys, for :func:`may_meet` in tasks."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(place.alias("place")).select(F.expr("cast(shiftright(place, 6) as int)").alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most 2 ** (bits - 6) rows
    table = np.zeros(1 << (bits - 6), _U)
    table[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(_U)
    return keys.sparkSession.sparkContext.broadcast(table)


def may_meet(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may stand on the asking side."""
    place = keys.view(_U) & _U(len(table) * 64 - 1)
    return ((table[(place >> _U(6)).view(np.int64)] >> (place & _U(63))) & _U(1)).astype(bool)
