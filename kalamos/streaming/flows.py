"""The same operators over streams: ingestion with normalisation, metric histories as they grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kalamos.functions import text as T
from kalamos.operators.rows import good_pair

HISTORY = "run_id string, step int, epoch int, metric string, value double, logged_at timestamp"


def normalised_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """New files of a folder, quality-filtered and normalised; stateless, so it is the batch expression."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    kept = raw.where("transliteration is not null and translation is not null").where(good_pair(F.col("transliteration"), F.col("translation")))
    return kept.withColumns({"transliteration": T.normalize_transliteration(F.col("transliteration")), "translation": T.clean_translation(F.col("translation"))})


def history_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(HISTORY).parquet(folder)


def windowed_loss(history: DataFrame, width: str = "1 minute", late: str = "10 minutes", metric: str = "train/loss") -> DataFrame:
    """Mean, count and last value per run and time window; rows later than the watermark are dropped."""
    rows = history.where(F.col("metric") == metric).withWatermark("logged_at", late)
    return rows.groupBy("run_id", F.window("logged_at", width)).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("points"), F.max_by("value", "step").alias("last"))


def deduplicated(history: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row per run, step and metric, also if a log is delivered twice."""
    return history.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["run_id", "step", "metric"])


def early_stops(history: DataFrame, metric: str, patience: int) -> DataFrame:
    """``run_id, step, best, since, stopped`` per evaluation, in the order of steps within a micro-batch; the state per
    run is three numbers."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, since, stopped = state.get if state.exists else (float("-inf"), 0, False)
        out = []
        for row in pd.concat(list(batches)).sort_values("step").itertuples():
            if stopped:
                break
            best, since = (row.value, 0) if row.value > best else (best, since + 1)
            stopped = since >= patience
            out.append((key[0], row.step, best, since, stopped))
        state.update((best, since, stopped))
        yield pd.DataFrame(out, columns=["run_id", "step", "best", "since", "stopped"])

    rows = history.where(F.col("metric") == metric).select("run_id", "step", "value")
    schema, kept = "run_id string, step int, best double, since int, stopped boolean", "best double, since int, stopped boolean"
    return rows.groupBy("run_id").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.NoTimeout)
