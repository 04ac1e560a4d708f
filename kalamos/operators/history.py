"""Metric histories: series, smoothing, last values, early stopping, throughput windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loss_series(history: DataFrame, metric: str = "train/loss", order: str = "ordinal", *by: str) -> DataFrame:
    """``step, value`` of one metric; of several values at a step the last one by ordinal counts."""
    rows = history.where((F.col("metric") == metric) & F.col("step").isNotNull() & F.col("value").isNotNull())
    return rows.groupBy(*by, "step").agg(F.max_by("value", order).alias("value"))


def smoothed(series: DataFrame, window: int, *by: str) -> DataFrame:
    """Trailing mean over ``window`` points, over fewer at the start; 1 or less changes nothing."""
    if window <= 1:
        return series.withColumn("smoothed", F.col("value"))
    w = Window.partitionBy(*by).orderBy("step").rowsBetween(-(window - 1), Window.currentRow)
    return series.withColumn("smoothed", F.avg("value").over(w))


def series_summary(series: DataFrame, *by: str) -> DataFrame:
    return series.groupBy(*by).agg(F.count(F.lit(1)).alias("num_points"), F.max("step").alias("final_step"), F.max_by("value", "step").alias("final_loss"))


def loss_status(manifest: DataFrame, summary: DataFrame, present: DataFrame, key: str = "run_id") -> DataFrame:
    """Every run of the manifest as ``ok``, ``missing_history`` or ``missing_train_loss``."""
    has = present.select(key).distinct().withColumn("__there", F.lit(True))
    out = manifest.join(has, key, "left").join(summary, key, "left")
    status = F.when(F.col("__there").isNull(), "missing_history").when(F.col("num_points").isNull(), "missing_train_loss").otherwise("ok")
    return out.withColumn("status", status).withColumn("num_points", F.coalesce("num_points", F.lit(0).cast("long"))).drop("__there")


def early_stopping(df: DataFrame, value: str, order: list[str], patience: int, *by: str) -> DataFrame:
    """Each evaluation with the best value before it, whether it improves on it (strictly), how many evaluations since
    the last improvement, and whether training would still be running; ``stops`` marks the last one."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("best_before", F.max(value).over(before))
    out = out.withColumn("improved", F.col("best_before").isNull() | (F.col(value) > F.col("best_before")))
    out = out.withColumn("__n", F.row_number().over(w))
    out = out.withColumn("since", (F.col("__n") - F.max(F.when(F.col("improved"), F.col("__n"))).over(upto)).cast("long"))
    out = out.withColumn("__hits", F.count_if(F.col("since") >= patience).over(upto))
    out = out.withColumn("stops", (F.col("since") >= patience) & (F.col("__hits") == 1))
    return out.withColumn("running", (F.col("__hits") == 0) | F.col("stops")).drop("__n", "__hits")


def every(position: Column, size: int) -> Column:
    """The number of the count-based window that a 1-based position lies in."""
    return F.floor((position - 1) / size)


def throughput(df: DataFrame, window: Column, examples: str, tokens: str, wait: str, compute: str, *by: str) -> DataFrame:
    """Sums per window and rates with guarded denominators."""
    out = df.groupBy(*by, window.alias("window")).agg(
        F.count(F.lit(1)).alias("batches"), F.sum(examples).alias("examples"), F.sum(tokens).alias("tokens"), F.sum(wait).alias("wait_s"), F.sum(compute).alias("compute_s")
    )
    seconds = F.greatest(F.col("wait_s") + F.col("compute_s"), F.lit(1e-9))
    return out.withColumns({"examples_per_sec": F.col("examples") / seconds, "tokens_per_sec": F.col("tokens") / seconds, "wait_share": F.col("wait_s") / seconds})


def epoch_means(df: DataFrame, epoch: str, loss: str) -> DataFrame:
    return df.groupBy(epoch).agg((F.coalesce(F.sum(loss), F.lit(0.0)) / F.greatest(F.count(loss), F.lit(1))).alias("mean_loss"))
