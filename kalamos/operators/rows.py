"""Filters, projections and set operations over bitext tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalamos.functions import text as T


def document_column(df: DataFrame) -> str | None:
    """The column that names documents, decided from the schema alone."""
    return next((c for c in ("oare_id", "doc_id") if c in df.columns), None)


def exclude_documents(df: DataFrame, ids: DataFrame, column: str | None = None) -> DataFrame:
    """Rows whose document is not held out.  An anti-join keeps rows without a document; a table without the
    column passes through.  Whether the ids are broadcast is left to their measured size."""
    column = column or document_column(df)
    if column is None:
        return df
    held = ids.select(F.col(ids.columns[0]).cast("string").alias("__held")).where("__held is not null").distinct()
    return df.join(held, df[column].cast("string") == held["__held"], "left_anti")


def complete_pairs(df: DataFrame, source: str = "transliteration", target: str = "translation") -> DataFrame:
    return df.na.drop(subset=[source, target])


def word_range(df: DataFrame, column: str = "transliteration", least: int = 2, most: int = 150) -> DataFrame:
    return df.where(T.word_count(F.col(column)).between(least, most))


def granularity(df: DataFrame, wanted: str | None, column: str = "granularity") -> DataFrame:
    return df.where(F.col(column) == wanted) if wanted and column in df.columns else df


def sentence_like(df: DataFrame, mode: str, wanted: str | None, column: str = "granularity") -> bool:
    """A prepared table of sentences: asked for, or all that it states.  One aggregate row at most."""
    if mode != "prepared":
        return False
    if wanted == "sentence":
        return True
    if column not in df.columns:
        return False
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.coalesce(F.col(column) == "sentence", F.lit(False))), F.lit(False)).alias("all")).first()
    return bool(row["n"] and row["all"])


def good_pair(source: Column, target: Column, least_chars: int = 10, most_ratio: float = 10.0) -> Column:
    """Quality of a pair, on the raw texts: long enough, of similar length, not a remark about the tablet."""
    one, two = F.length(source), F.length(target)
    ratio = F.greatest(one, two) / F.greatest(F.lit(1), F.least(one, two))
    return (two >= least_chars) & (ratio <= most_ratio) & ~target.rlike(T.METADATA)


def quality(df: DataFrame, source: str = "transliteration", target: str = "translation", least_chars: int = 10, most_ratio: float = 10.0) -> DataFrame:
    return df.where(good_pair(F.col(source), F.col(target), least_chars, most_ratio))


def visible_pairs(df: DataFrame, source: str = "transliteration", target: str = "translation") -> DataFrame:
    """Pairs with something left on both sides."""
    return df.where((T.strip(F.col(source)) != "") & (T.strip(F.col(target)) != ""))


def between_lengths(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    for column, (least, most) in bounds.items():
        df = df.where(F.length(column).between(least, most))
    return df


def among(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def without_columns(df: DataFrame, *names: str) -> DataFrame:
    """Missing names are ignored."""
    return df.drop(*names)


def prefixed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column))) if prefix else df


def union_ids(*ids: DataFrame) -> DataFrame:
    """Distinct ids of all lists, sorted."""
    out = None
    for df in ids:
        side = df.select(F.col(df.columns[0]).cast("string").alias("id")).where("id is not null and trim(id) <> ''")
        out = side if out is None else out.unionAll(side)
    return out.distinct().orderBy("id")


def common_ids(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.intersect(two)


def remaining_ids(one: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        one = one.subtract(other)
    return one


def stacked(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns missing somewhere are null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def first_seen(values: Column, most: int = 32) -> Column:
    """Distinct stripped non-empty strings of an array in their first order, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, T.strip), lambda x: x != "")), 1, most)
