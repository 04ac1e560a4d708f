"""Problem 2: how often every term occurs, and in how many records.

Incremental signed deltas.  A ``TermCounts`` is a persistent table of counts,
partitioned by a hash of the term.  A change set of added, changed and deleted
records is reduced to per-term signed changes (map-side first, so a hot term
costs one row per task), then merged into only those partitions that it
touches; the rest of the table is not rewritten.  The work of a merge follows
the change set and its partitions, not the collection.

A term is a piece between blanks of a non-empty text in the one look-alike
form.  Null and empty texts hold no terms and do not count as records.  Counts
that fall to zero leave the table.  Repeated records all count.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalamos.llm.lookalike import one_form
from kalamos.llm.work import new_place, written

REMEMBERED, PER_BUCKET = 500_000, 100_000
RECORDS = ""  # the row that counts the records themselves; no term is empty


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[str, ...]] = {}
    for batch in batches:
        occurrences: Counter[str] = Counter()
        records: Counter[str] = Counter()
        for text, sign in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            records[RECORDS] += sign
            terms: list[str] = []
            for piece in text.split():
                found = known.get(piece)
                if found is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    found = known[piece] = tuple(one_form(piece).split())
                terms += found
            if sign == 1:
                occurrences.update(terms)
                records.update(set(terms))
            else:
                occurrences.subtract(terms)
                records.subtract(set(terms))
        keys = list(records)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([occurrences[k] for k in keys], pa.int64()), pa.array([records[k] for k in keys], pa.int64())],
            names=["term", "occurrences", "records"],
        )


def signed(old: DataFrame | None, new: DataFrame | None, text_col: str) -> DataFrame:
    """A change set ``text, sign``: what was there goes (-1), what is there now comes (+1).  A changed record
    is in both, a deleted one only in ``old``, an added one only in ``new``."""
    parts = [df.select(F.col(text_col).alias("text"), F.lit(sign).alias("sign")) for df, sign in ((old, -1), (new, 1)) if df is not None]
    both = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return both.where("text is not null and text <> ''")


def deltas(changes: DataFrame) -> DataFrame:
    """``term, occurrences, records``: the signed change of every term a change set touches."""
    rows = changes.mapInArrow(_terms, "term string, occurrences long, records long")
    total = rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return total.where("occurrences <> 0 or records <> 0")


class TermCounts:
    """Counts in ``path``: folders of buckets of terms, and a list of versions that says which folder holds which.

    Opening a path continues what lies there, in whatever process it was written.  A merge writes new folders and then,
    in one file, the next version of the list; a run that fails before that changes nothing.  A new table gets as many
    buckets as its first change set has ``PER_BUCKET`` terms, at least one."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.path = path or new_place(spark, "terms")
        self.buckets, self.version, self.place = buckets, 0, {}
        held = sorted(p for p in self._names(f"{self.path}/versions") if p.isdigit())
        if held:
            self.version = int(held[-1])
            state = json.loads(self.spark.read.text(f"{self.path}/versions/{held[-1]}", wholetext=True).first()[0])
            self.buckets, self.place = state["buckets"], {int(b): f for b, f in state["place"].items()}

    def _read(self, places: dict[int, str]) -> DataFrame | None:
        if not places:
            return None
        folders = [f"{self.path}/{folder}/bucket={bucket}" for bucket, folder in sorted(places.items())]
        return self.spark.read.schema("term string, occurrences long, records long").parquet(*folders)

    def apply(self, changes: DataFrame) -> None:
        """Merge a change set.  Only buckets with a changed term are read and written again."""
        change = written(deltas(changes), "delta")
        if self.buckets is None:
            self.buckets = max(1, -(-change.count() // PER_BUCKET))
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in change.select(bucket.alias("b")).distinct().collect()}  # at most `buckets` rows
        held = self._read({b: f for b, f in self.place.items() if b in touched})
        if held is not None:
            change = held.unionAll(change).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        # one file per bucket: a bucket without remaining terms must still replace the old one
        folder = uuid.uuid4().hex
        kept = change.where("records > 0").withColumn("bucket", bucket).repartition(self.buckets, "bucket")
        kept.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        there = {int(n.split("=")[1]) for n in self._names(f"{self.path}/{folder}") if "=" in n}
        self.place = {b: f for b, f in self.place.items() if b not in touched} | dict.fromkeys(there, folder)
        self._commit()

    def _commit(self) -> None:
        """The next version of the list, complete or not there at all."""
        self.version += 1
        state = json.dumps({"buckets": self.buckets, "place": self.place})
        files, path = self._files(f"{self.path}/versions")
        jvm = self.spark._jvm.org.apache.hadoop.fs
        unfinished, name = jvm.Path(path, f".{uuid.uuid4().hex}"), jvm.Path(path, f"{self.version:012d}")
        out = files.create(unfinished, True)
        out.write(bytearray(state.encode("utf-8")))
        out.close()
        if files.exists(name) or not files.rename(unfinished, name):
            raise RuntimeError(f"another process has written version {self.version} of {self.path}")

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(folder)
        return [p.getPath().getName() for p in files.listStatus(path)] if files.exists(path) else []

    def _all(self) -> DataFrame:
        found = self._read(self.place)
        return found if found is not None else self.spark.createDataFrame([], "term string, occurrences long, records long")

    def counts(self) -> DataFrame:
        """``term, occurrences, records`` of every term."""
        return self._all().where(F.col("term") != RECORDS)

    def records(self) -> int:
        row = self._all().where(F.col("term") == RECORDS).agg(F.sum("records")).first()
        return int(row[0] or 0)

    def marked(self, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
        """``term, occurrences, records, mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than
        the share ``common_above`` of them, otherwise null.  Where a term is both (in tiny collections), rare wins."""
        total = self.records()
        mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common")
        return self.counts().withColumn("mark", mark)
