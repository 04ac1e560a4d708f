"""Reports over stored runs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalamos.operators import history
from kalamos.sources import readers


def history_path(root: str, row: dict) -> Path:
    """The stated history file, else the one in the run's own folder."""
    stated = (row.get("history_path") or "").strip()
    return Path(root, stated) if stated else Path(root, "outputs", row["run_id"], "training_history.csv")


def loss_curves(spark: SparkSession, manifest_path: str, root: str, window: int = 1, priorities: list[str] | None = None, groups: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(status, series): every wanted run of the manifest with its state and end, and the smoothed curves."""
    manifest = readers.read_manifest(spark, manifest_path)
    for column, wanted in (("priority", priorities), ("comparison_group", groups)):
        if wanted:
            manifest = manifest.where(F.col(column).isin(wanted))
    found = None
    for row in manifest.collect():  # a manifest names files, one line each
        path = history_path(root, row.asDict())
        if path.exists():
            side = readers.read_csv(spark, str(path), readers.HISTORY, ordinal=True).withColumn("run_id", F.lit(row["run_id"]))
            found = side if found is None else found.unionByName(side)
    if found is None:
        found = spark.createDataFrame([], readers.HISTORY + ", ordinal long, run_id string")
    series = history.loss_series(found, "train/loss", "ordinal", "run_id")
    status = history.loss_status(manifest, history.series_summary(series, "run_id"), found)
    order = F.expr("try_cast(`order` as int)") if "order" in manifest.columns else F.lit(0)
    return status.orderBy("comparison_group", order, "run_id"), history.smoothed(series, window, "run_id").orderBy("run_id", "step")
