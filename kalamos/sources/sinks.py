"""Sinks: tables, id lists, manifests, artifact bundles, append-only logs."""

from __future__ import annotations

import csv
import json
import numbers
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalamos.operators.rows import union_ids, without_columns
from kalamos.operators.runs import upsert_runs
from kalamos.session import written

TEXT_COLUMNS = ("transliteration", "translation", "reference", "source")


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=quote_all, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(path: str | Path, value) -> None:
    """To wherever tables can be written: a local path or one of the session's file systems."""
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    spark = SparkSession.getActiveSession()
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def write_id_union(path: str, *ids: DataFrame) -> int:
    """The sorted distinct ids of all lists as a JSON list; id lists are small by nature, the count is returned."""
    listed = [r[0] for r in union_ids(*ids).toLocalIterator()]
    write_json(path, listed)
    return len(listed)


def write_subsets(subsets: dict[float, DataFrame], group: str, folder: str) -> dict[str, dict]:
    """One table per share and a manifest of its documents and rows."""
    manifest = {}
    total = None
    for share in sorted(subsets, reverse=True):
        tag, path = f"{round(share * 100)}pct", f"{folder}/{round(share * 100)}pct"
        subsets[share].write.mode("overwrite").parquet(path)
        row = subsets[share].agg(F.count_distinct(F.coalesce(F.col(group).cast("string"), F.lit("nan"))).alias("docs"), F.count(F.lit(1)).alias("rows")).first()
        total = total or row["docs"]
        manifest[tag] = {"fraction": share, "n_docs": row["docs"], "total_docs": total, "n_rows": row["rows"], "file": path}
    write_json(f"{folder}/manifest.json", manifest)
    return manifest


def write_bundle(folder: str, config: dict, predictions: dict[str, DataFrame], scores: dict[str, dict], extra: dict | None = None) -> None:
    """A run's artifacts: configuration, predictions without their texts, scores per test set and a summary."""
    write_json(f"{folder}/config_snapshot.json", config)
    for name, df in predictions.items():
        write_csv(without_columns(df, *TEXT_COLUMNS), f"{folder}/{name}_preds")
    for name, values in scores.items():
        write_json(f"{folder}/{name}_metrics.json", values)
    write_json(f"{folder}/summary.json", {**(extra or {}), **scores})


def write_registry(registry: DataFrame, news: DataFrame, path: str) -> None:
    """The table may be the one that ``registry`` reads: the new one is written elsewhere before it takes the place."""
    written(upsert_runs(registry, news), "registry").write.mode("overwrite").parquet(path)


def append_history(path: str, metrics: dict, step: int, epoch: int, fresh: bool = False) -> None:
    """Numeric metrics of one step, by name; the header is written once, a fresh run starts a new file."""
    file = Path(path)
    if fresh:
        file.unlink(missing_ok=True)
    file.parent.mkdir(parents=True, exist_ok=True)
    new = not file.exists()
    with file.open("a", newline="", encoding="utf-8") as out:
        rows = csv.writer(out)
        if new:
            rows.writerow(["step", "epoch", "metric", "value"])
        rows.writerows([step, epoch, name, metrics[name]] for name in sorted(metrics) if isinstance(metrics[name], numbers.Real) and not isinstance(metrics[name], bool))


def append_history_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("run_id").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    write_csv(df.select("transliteration", F.col("translation").alias("reference"), "prediction"), path)


def report_lines(df: DataFrame, pattern: str, *columns: str) -> list[str]:
    """One formatted line per row of a small report."""
    return [r[0] for r in df.select(F.format_string(pattern, *columns)).toLocalIterator()]
