"""Splits and nested subsets over rows and documents.

Two orders are on offer: ``hashed`` ranks by a digest of seed and key, fully
distributed and the same in any engine; ``numpy`` permutes a bounded list of
ids on the driver and equals the permutation of NumPy's legacy generator bit
for bit.  The second refuses lists longer than ``DRIVER_IDS``.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalamos.operators.rows import document_column

DRIVER_IDS = 1_000_000


def hash_rank(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def ranked(ids: DataFrame, key: str, seed: int) -> DataFrame:
    """``key, rank, total`` by digest.  Ranks of distinct ids are counted in 4096 ranges of the digest, so that no
    single task sorts all of them."""
    digest = ids.select(key).distinct().withColumn("__h", hash_rank(seed, key)).withColumn("__b", F.substring("__h", 1, 3))
    sizes = digest.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # at most 4096 rows
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("__b").orderBy("__h", key)
    out = digest.join(F.broadcast(starts), "__b")
    return out.select(key, (F.col("__start") + F.row_number().over(inside)).alias("rank"), "total")


def _permuted(ids: list, seed: int, how: str) -> list:
    if how == "numpy":
        return [ids[k] for k in np.random.RandomState(seed).permutation(len(ids))]
    out = list(ids)
    random.Random(seed).shuffle(out)
    return out


def _driver_ids(ids: DataFrame) -> list:
    rows = ids.limit(DRIVER_IDS + 1).collect()
    if len(rows) > DRIVER_IDS:
        raise ValueError(f"more than {DRIVER_IDS} ids: use the hashed order")
    return [r[0] for r in rows]


def split_documents(df: DataFrame, share: float, group: str | None = None, seed: int = 42, how: str = "hashed", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(training, validation); all rows of a document on one side, rows without a document on neither."""
    group = group if group in df.columns else document_column(df)
    if group is None:
        raise ValueError("no document column; split by rows instead")
    ids = df.where(F.col(group).isNotNull())
    if how == "hashed":
        marks = ranked(ids, group, seed)
        held = marks.where(F.col("rank") <= F.ceil(F.col("total") * share))
        if ids.select(group).distinct().limit(2).count() < 2:
            raise ValueError("a document split needs at least 2 unique document IDs")
        held = held.select(group)
    else:
        first = ids.groupBy(group).agg(F.min(order or group).alias("__o")).orderBy("__o", group).select(group)
        listed = _driver_ids(first)
        if len(listed) < 2:
            raise ValueError("a document split needs at least 2 unique document IDs")
        chosen = _permuted(listed, seed, how)[: math.ceil(len(listed) * share)]
        held = df.sparkSession.createDataFrame([(c,) for c in chosen], f"{group} {dict(df.dtypes)[group]}")
    return ids.join(held, group, "left_anti"), ids.join(held, group, "left_semi")


def split_rows(df: DataFrame, share: float, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, validation) row by row, by the digest of a unique key."""
    marks = ranked(df, key, seed)
    held = marks.where(F.col("rank") <= F.ceil(F.col("total") * share)).select(key)
    return df.join(held, key, "left_anti"), df.join(held, key, "left_semi")


def require_both(train: DataFrame, validation: DataFrame) -> None:
    for name, side in (("training", train), ("validation", validation)):
        if side.isEmpty():
            raise ValueError(f"the {name} split is empty")


def nested_subsets(df: DataFrame, shares: list[float], group: str | None = None, seed: int = 42, how: str = "hashed") -> dict[float, DataFrame]:
    """For each share the rows of a prefix of one order of documents: smaller subsets lie inside larger ones.
    Rows without a document form one document ``nan``."""
    group = group or document_column(df)
    keyed = df.withColumn("__doc", F.coalesce(F.col(group).cast("string"), F.lit("nan")))
    if how == "hashed":
        marks = ranked(keyed, "__doc", seed)
    else:
        listed = _permuted(_driver_ids(keyed.select("__doc").distinct().orderBy("__doc")), seed, how)
        marks = df.sparkSession.createDataFrame([(d, k + 1, len(listed)) for k, d in enumerate(listed)], "__doc string, rank long, total long")
    cut = lambda s: F.greatest(F.lit(1), F.floor(F.col("total") * s))
    return {s: keyed.join(marks.where(F.col("rank") <= cut(s)).select("__doc"), "__doc", "left_semi").drop("__doc") for s in shares}


def shuffled_split(df: DataFrame, share: float = 0.1, group: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, validation) by Python's own shuffle of the sorted documents; at least one for validation."""
    group = group or document_column(df)
    listed = _permuted(_driver_ids(df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group)), seed, "python")
    chosen = listed[: max(1, int(len(listed) * share))]
    held = df.sparkSession.createDataFrame([(c,) for c in chosen], f"{group} {dict(df.dtypes)[group]}")
    return df.join(held, group, "left_anti"), df.join(held, group, "left_semi")
