"""Tables written between the stages of an operator.

They go to the folder the cluster names in ``spark.checkpoint.dir``, which all
executors share, so a lost executor costs a re-read and never the result.
Where the setting is missing (a local session, as in tests) a folder below the
system's temporary one is set for the session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; set to a local one only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"kalamos-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder; whatever lies there goes when the application ends."""
    path = f"{shared_folder(spark)}/kalamos/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back: the lineage ends here.  Also the place."""
    path = new_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later plan reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
