"""Make this package importable in the Python workers of a session, wherever they run."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors once per Spark context (the driver serves the file)."""
    context = spark.sparkContext
    if context not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="kalamos-")) / "kalamos.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
        _shipped.add(context)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the session has cores (one small file, one row group) is dealt out to all of
    them before costly expressions; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share (``spark.checkpoint.dir``; below the system's temporary folder
    only for a local master without the setting), emptied when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/kalamos"
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to such a place and read back."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
