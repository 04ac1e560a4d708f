"""Dataset variants: genre tags, number tags, retrieved neighbours, glosses and switched-off steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalamos.functions import text as T
from kalamos.operators.retrieval import nearest
from kalamos.operators.rows import document_column, exclude_documents
from kalamos.session import written

# The names of the retrieval formats and how many bytes of source and translation they take.
RETRIEVAL_FORMATS = {"retrieval_augmented": (160, 220), "retrieval_compact": (96, 96), "retrieval_source_only": (160, None)}


def _said(column: str) -> Column:
    """Variants write a missing text as ``nan``."""
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def _base(df: DataFrame) -> DataFrame:
    out = df.withColumn("base_transliteration", T.normalize_transliteration(_said("transliteration")))
    return out.withColumn("translation", T.clean_translation(_said("translation"))) if "translation" in df.columns else out


def genre_conditioned(df: DataFrame) -> DataFrame:
    genre = F.col("genre") if "genre" in df.columns else F.lit(None).cast("string")
    out = _base(df).withColumn("genre_tag", T.genre_tag(genre))
    return out.withColumn("transliteration", T.strip(F.concat(F.lit("genre_"), "genre_tag", F.lit(" source_text "), "base_transliteration")))


def numeral_normalized(df: DataFrame) -> DataFrame:
    out = _base(df).withColumn("transliteration", T.annotate_numbers(F.col("base_transliteration")))
    return out.withColumn("numeral_annotation_count", T.number_annotations(F.col("transliteration"), F.col("base_transliteration")))


def retrieval_input(source: Column, translation: Column, current: Column, source_bytes: int, translation_bytes: int | None) -> Column:
    """The neighbour's texts, cut to bytes, before the row's own; empty segments are left out."""
    segments = [F.lit("retrieved_source"), T.utf8_truncate(source, source_bytes)]
    if translation_bytes:
        segments += [F.lit("retrieved_translation"), T.utf8_truncate(translation, translation_bytes)]
    segments += [F.lit("current_source"), current]
    return T.strip(F.array_join(F.filter(F.array(*segments), lambda s: s != ""), " "))


def with_neighbours(df: DataFrame, bank: DataFrame, key: str, exclude_self: bool, again: bool, **grams) -> DataFrame:
    """Every row with its nearest bank row.  ``again``: evaluation rows are normalised once for the search and
    once more for what is written out, which is not the same since the chain is not idempotent."""
    once = df.withColumn("__once", T.normalize_transliteration(_said("transliteration")))
    held = bank.withColumn("__once", T.normalize_transliteration(_said("transliteration")))
    near = nearest(once, held, key, "__once", key, "__once", exclude_self=exclude_self, **grams)
    doc = document_column(bank)
    found = held.select(
        F.col(key).alias("bank_id"),
        (F.col(doc) if doc else F.col(key).cast("string")).alias("retrieved_doc_id"),
        F.col("__once").alias("retrieved_transliteration"),
        T.clean_translation(_said("translation")).alias("retrieved_translation"),
    )
    near = near.join(found, "bank_id").select(F.col("query_id").alias(key), "retrieved_doc_id", F.col("score").alias("retrieved_score"), "retrieved_transliteration", "retrieved_translation")
    base = T.normalize_transliteration(F.col("__once"))
    out = once.withColumn("base_transliteration", base).drop("__once")
    if "translation" in df.columns:
        out = out.withColumn("translation", T.clean_translation(_said("translation")))
    return out.join(near, key)


def formatted(df: DataFrame, source_bytes: int, translation_bytes: int | None) -> DataFrame:
    return df.withColumn("transliteration", retrieval_input(F.col("retrieved_transliteration"), F.col("retrieved_translation"), F.col("base_transliteration"), source_bytes, translation_bytes))


def retrieval_augmented(train: DataFrame, evals: dict[str, DataFrame], held_out: DataFrame | None, key: str, formats: dict[str, tuple[int, int | None]] | None = None, **grams) -> dict[str, dict[str, DataFrame]]:
    """Per format and split the augmented rows.  The bank is the training set without held-out documents; neighbours
    are searched once per split, written, and formatted as often as asked."""
    bank = exclude_documents(train, held_out) if held_out is not None else train
    if bank.isEmpty():
        raise ValueError("the retrieval bank is empty after hold-out removal")
    splits = {"train": written(with_neighbours(train, bank, key, True, True, **grams), "neighbours")}
    splits |= {name: written(with_neighbours(df, bank, key, False, True, **grams), "neighbours") for name, df in evals.items()}
    formats = formats or RETRIEVAL_FORMATS
    return {name: {split: formatted(df, *sizes) for split, df in splits.items()} for name, sizes in formats.items()}


def all_variants(train: DataFrame, evals: dict[str, DataFrame], held_out: DataFrame | None, key: str) -> dict[str, dict[str, DataFrame]]:
    plain = {"train": train, **evals}
    out = {name: {split: make(df) for split, df in plain.items()} for name, make in (("genre_conditioned", genre_conditioned), ("numeral_normalized", numeral_normalized))}
    return out | retrieval_augmented(train, evals, held_out, key)


def source_bytes(df: DataFrame, column: str = "transliteration") -> DataFrame:
    """``rows, p95, most`` of the UTF-8 lengths: the exact 95th percentile, interpolated and cut to whole bytes."""
    size = F.octet_length(column)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.floor(F.percentile(size, F.lit(0.95))).cast("long").alias("p95"), F.max(size).cast("long").alias("most"))


def write_variants(variants: dict[str, dict[str, DataFrame]], folder: str, write_json) -> dict[str, dict]:
    """One CSV folder per variant and split, and ``manifest.json`` with counts and lengths, written by
    ``write_json(path, value)``."""
    manifest: dict[str, dict] = {}
    for name, splits in variants.items():
        files = {}
        for split, df in splits.items():
            files[split] = f"{folder}/{name}/{split}"
            df.write.mode("overwrite").option("header", True).option("escape", '"').csv(files[split])
        row = source_bytes(splits["train"]).first()
        manifest[name] = {f"{split}_rows": df.count() for split, df in splits.items()} | {"train_source_bytes_p95": row["p95"], "train_source_bytes_max": row["most"], "files": files}
    write_json(f"{folder}/manifest.json", manifest)
    return manifest
