"""Problem 5: values that look alike but are written with different characters.

Confusables skeleton: every text is decomposed, mapped character by character
to its look-alike prototype and decomposed again; texts are grouped by equal
skeleton.  The skeleton is computed once, in Arrow batches, and leaves Python as
a 128-bit digest; the digests are written, and only fixed-width rows are shuffled.  Copies of one written
form are counted as one class before classes are paired: the pairing costs what
it returns, also where one form holds a third of all rows.

Null and empty texts look like nothing and take no part.  Repeated rows with
the same characters are never a pair with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from kalamos.llm.lookalike import one_form, skeleton
from kalamos.llm.work import written


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        look = b"".join(xxhash.xxh3_128_digest(skeleton(t).encode("utf-8", "surrogatepass")) for t in texts)
        own = b"".join(xxhash.xxh3_64_digest(t.encode("utf-8", "surrogatepass")) for t in texts)
        pair = np.frombuffer(look, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(np.frombuffer(own, np.int64))],
            names=["id", "look_a", "look_b", "own"],
        )


def look_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, look_a, look_b, own``: digests of the skeleton (128 bits) and of the characters, for non-empty texts."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    return rows.mapInArrow(_digests, "id long, look_a long, look_b long, own long")


def alike_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, class_id, forms, rows``: every row that looks like one with other characters, its class (named by the least
    id of the rows that look so) and how many written forms and rows the class has."""
    rows = written(look_digests(df, id_col, text_col), "looks")
    look = ["look_a", "look_b"]
    # forms first, so that a form that holds a third of all rows is one row a task
    forms = rows.groupBy(*look, "own").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = forms.groupBy(*look).agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("forms"), F.sum("n").alias("rows")).where("forms > 1")
    return rows.join(classes, look).select("id", "class_id", "forms", "rows")


def alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_a < id_b``: rows that look the same but are not the same characters."""
    rows = written(look_digests(df, id_col, text_col), "looks")
    look = ["look_a", "look_b"]
    mixed = rows.groupBy(*look).agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most").select(*look)
    rows = rows.join(mixed, look)
    forms = rows.select(*look, "own").distinct()
    other = forms.withColumnRenamed("own", "own_2")
    two = forms.join(other, look).where("own < own_2")
    one_side = rows.select(*look, "own", F.col("id").alias("id_1"))
    other_side = rows.select(*look, F.col("own").alias("own_2"), F.col("id").alias("id_2"))
    return (
        two.join(one_side, [*look, "own"])
        .join(other_side, [*look, "own_2"])
        .select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))
    )


@arrow_udf(StringType())
def _one_form(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else one_form(t) for t in texts.to_pylist()], pa.string())


def to_one_form(text: Column | str) -> Column:
    """The text in the one form that looks the same; null stays null."""
    return _one_form(text)
