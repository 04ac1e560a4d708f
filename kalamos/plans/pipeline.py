"""From configured sources to training and validation tables, and from predictions to scores.

The order of the stages is part of the result: hold-outs, complete pairs, word
counts, quality (on the raw texts), normalisation, glosses, visible pairs,
split.  Every stage is an expression over the one before, so the whole is one
lazy plan whose filters reach the scan where they may.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kalamos.functions import text as T
from kalamos.operators import lexicon, metrics, rows, spans, splits
from kalamos.operators.retrieval import nearest
from kalamos.session import written
from kalamos.sources import readers
from kalamos.sources.config import normalisation_flags


def load_source(spark: SparkSession, data: Any) -> DataFrame:
    """The rows of the configured mode, before any filter."""
    folder, mode = data.data_dir, data.data_mode
    if mode == "prepared":
        if not data.prepared_file:
            raise ValueError("mode 'prepared' needs data.prepared_file")
        return rows.granularity(readers.read_prepared(spark, data.prepared_file), data.prepared_granularity)
    documents = readers.read_documents(spark, folder, data.train_file)
    if mode == "document":
        return documents
    anchors = readers.read_anchors(spark, folder)
    if mode == "sentence_only":
        return spans.sentence_spans(documents, anchors)
    if mode == "mixed":
        return spans.mixed_rows(documents, anchors, data.include_invalid_anchors)
    if mode == "extended_sentence":
        held = readers.read_ids(spark, data.holdout_doc_ids_file)
        return spans.extended_rows(documents, anchors, readers.read_published(spark, folder), held)
    raise ValueError(f"unknown data_mode {mode!r}")


def filtered(df: DataFrame, data: Any, held: DataFrame | None) -> DataFrame:
    """Hold-outs, complete pairs, word counts and quality, in this order and on the raw texts."""
    if held is not None:
        df = rows.exclude_documents(df, held)
    df = rows.complete_pairs(df)
    if data.data_mode in ("sentence_only", "extended_sentence") or rows.sentence_like(df, data.data_mode, data.prepared_granularity):
        df = rows.word_range(df, "transliteration", data.min_sentence_words, data.max_sentence_words)
    if data.filter_quality:
        df = rows.quality(df, least_chars=data.min_translation_chars, most_ratio=data.max_length_ratio)
    return df


def stage_counts(df: DataFrame, data: Any, held: DataFrame | None = None) -> DataFrame:
    """``place, stage, rows``: how many rows each stage of the filter leaves, observed in one pass over the data."""
    stages = [("loaded", lambda d: d)]
    if held is not None:
        stages.append(("held_out", lambda d: rows.exclude_documents(d, held)))
    stages.append(("complete", rows.complete_pairs))
    if data.filter_quality:
        stages.append(("quality", lambda d: rows.quality(d, least_chars=data.min_translation_chars, most_ratio=data.max_length_ratio)))
    seen = []
    for name, step in stages:
        seen.append(Observation(name))
        df = step(df).observe(seen[-1], F.count(F.lit(1)).alias("rows"))
    df.write.format("noop").mode("overwrite").save()
    counted = [(k, name, o.get["rows"]) for k, ((name, _), o) in enumerate(zip(stages, seen, strict=True))]
    return df.sparkSession.createDataFrame(counted, "place int, stage string, rows long")


def normalised(df: DataFrame, data: Any) -> DataFrame:
    source = T.whitespace(F.col("transliteration")) if data.skip_source_normalization else T.normalize_transliteration(F.col("transliteration"), **normalisation_flags(data))
    out = df.withColumn("transliteration", source)
    return out.withColumn("translation", T.clean_translation(F.col("translation"))) if "translation" in df.columns else out


def glossed(df: DataFrame, spark: SparkSession, data: Any) -> DataFrame:
    if not data.use_dictionary_gloss:
        return df
    lookup = lexicon.gloss_lookup(readers.read_dictionary(spark, data.data_dir), readers.read_lexicon(spark, data.data_dir), kind="type")
    keyed = df if "ordinal" in df.columns else df.withColumn("ordinal", F.monotonically_increasing_id())
    return lexicon.augment_with_glosses(keyed, lookup, "ordinal", most=data.max_glosses)


def prepare(df: DataFrame, spark: SparkSession, data: Any, held: DataFrame | None = None) -> DataFrame:
    return rows.visible_pairs(glossed(normalised(filtered(df, data, held), data), spark, data))


def load_train_data(spark: SparkSession, data: Any, how: str = "hashed") -> tuple[DataFrame, DataFrame]:
    """(training, validation) of a configuration; neither may be empty."""
    held = readers.read_ids(spark, data.holdout_doc_ids_file) if data.holdout_doc_ids_file else None
    df = prepare(load_source(spark, data), spark, data, held)
    if data.val_split_strategy == "doc_id" and rows.document_column(df):
        group = data.val_group_column if data.val_group_column in df.columns else rows.document_column(df)
        train, validation = splits.split_documents(df, data.val_split, group, how=how)
    else:
        keyed = df if "ordinal" in df.columns else df.withColumn("ordinal", F.monotonically_increasing_id())
        train, validation = splits.split_rows(keyed, data.val_split, "ordinal")
    splits.require_both(train, validation)
    return train, validation


def load_test_data(spark: SparkSession, data: Any, path: str | None = None) -> DataFrame:
    """Test rows, normalised as the training rows; a missing source is an error, not a silent row."""
    df = readers.read_test_set(spark, path or f"{data.data_dir}/{data.test_file}")
    if not df.where("transliteration is null").isEmpty():
        raise ValueError("the test set has rows without a source text")
    return normalised(df, data)


def test_file(cli: str | None, configured: str | None, default: str) -> str:
    """Command line before configuration before default."""
    return cli or configured or default


def evaluation_settings(config_path: str | None, stored: dict | None = None) -> Any:
    """How test rows are prepared: by the configuration if one is named, else as a trained model's metadata says, else
    by the defaults; unknown names in metadata are left out."""
    from kalamos.sources import config

    if config_path:
        return config.load(config_path).data
    known = (stored or {}).get("data", {})
    return config.DataConfig(**{k: v for k, v in known.items() if k in config.SETTINGS})


Predict = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def predict_with(df: DataFrame, model: Predict, column: str = "prediction", clean: bool = True) -> DataFrame:
    """Any predictor as a function over pandas batches that adds ``column``; outputs are cleaned on request."""
    schema = StructType([*df.schema.fields, StructField(column, StringType())])
    out = df.mapInPandas(model, schema)
    return out.withColumn(column, T.postprocess_translation(F.col(column))) if clean else out


def predict_nearest(train: DataFrame, test: DataFrame, train_id: str, test_id: str, source: str = "transliteration", target: str = "translation", **grams) -> DataFrame:
    """The retrieval predictor: the translation of the nearest training source.  Training rows are prepared once."""
    train = written(train.select(train_id, source, target), "bank")
    near = nearest(test, train, test_id, source, train_id, source, **grams)
    said = train.select(F.col(train_id).cast("long").alias("bank_id"), F.col(target).alias("prediction"))
    return test.join(near.join(said, "bank_id").select(F.col("query_id").alias(test_id), "bank_id", "score", "prediction"), test_id)


def evaluate(predictions: DataFrame, reference: str = "translation", *by: str) -> DataFrame:
    """Corpus BLEU, chrF++ and their combination; missing predictions count as empty."""
    return metrics.corpus_scores(metrics.statistics(predictions, "prediction", reference, *by), *by)


def with_references(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Predictions of a test set with its prepared texts, place by place; the documents must be the same."""
    doc = rows.document_column(references) or "doc_id"
    return readers.attach_references(predictions.withColumnRenamed(rows.document_column(predictions) or "doc_id", "doc_id"), references.withColumnRenamed(doc, "doc_id"))


def retrieval_baseline(train: DataFrame, tests: dict[str, DataFrame], train_id: str, test_id: str) -> dict[str, DataFrame]:
    """Scores of the retrieval predictor per test set."""
    return {name: evaluate(predict_nearest(train, df, train_id, test_id)) for name, df in tests.items()}
