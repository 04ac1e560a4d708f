"""Sources: CSV and JSON tables with explicit schemas, id lists, metric files, positional joins."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Fixed value: cells that stand for a missing value in CSV files.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

DOCUMENTS = "oare_id string, transliteration string, translation string"
ANCHORS = "text_uuid string, first_word_number int, first_word_spelling string, translation string"
PUBLISHED = "oare_id string, transliteration string"
DICTIONARY = "word string, definition string, derived_from string"
LEXICON = "type string, form string, norm string, lexeme string, eBL string"
PREPARED = "transliteration string, translation string, oare_id string, genre string, source string, alignment_method string"
INDEPENDENT = "transliteration string, translation string, doc_id string, genre string, sentence_idx int, anchor_valid boolean, word_start int, word_end int"
NEW_TEST = "transliteration string, translation string, oare_id string, genre string, source string"
HISTORY = "step int, epoch int, metric string, value double"


def _there(path: str) -> str:
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str | None = None, missing: tuple[str, ...] = MISSING, ordinal: bool = False) -> DataFrame:
    """A CSV table by column name: columns of the schema in the file get their types, others stay strings.

    All cells are read as strings (quoted line breaks and doubled quotes allowed), missing marks become null, then
    types are cast.  ``ordinal`` adds the row's place in the file, for rules that speak of first and last."""
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', nullValue="\0", emptyValue="").csv(_there(path))
    types = dict(part.strip().split(" ", 1) for part in schema.split(",")) if schema else {}
    cell = lambda c: F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")) if missing else F.col(f"`{c}`")
    out = raw.select(*(cell(c).cast(types.get(c, "string")).alias(c) for c in raw.columns))
    return out.withColumn("ordinal", F.monotonically_increasing_id()) if ordinal else out


def read_documents(spark: SparkSession, folder: str, name: str = "train.csv") -> DataFrame:
    return read_csv(spark, f"{folder}/{name}", DOCUMENTS, ordinal=True)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """A prepared table; its ``doc_id`` is called ``oare_id`` where there is none."""
    df = read_csv(spark, path, PREPARED + ", " + INDEPENDENT.split(", ", 2)[2], ordinal=True)
    return df.withColumnRenamed("doc_id", "oare_id") if "doc_id" in df.columns and "oare_id" not in df.columns else df


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, INDEPENDENT, ordinal=True)


def read_dictionary(spark: SparkSession, folder: str, name: str = "eBL_Dictionary.csv") -> DataFrame:
    return read_csv(spark, f"{folder}/{name}", DICTIONARY, ordinal=True)


def read_lexicon(spark: SparkSession, folder: str, name: str = "OA_Lexicon_eBL.csv") -> DataFrame:
    return read_csv(spark, f"{folder}/{name}", LEXICON, ordinal=True)


def read_anchors(spark: SparkSession, folder: str, name: str = "Sentences_Oare_FirstWord_LinNum.csv") -> DataFrame:
    return read_csv(spark, f"{folder}/{name}", ANCHORS, ordinal=True)


def read_published(spark: SparkSession, folder: str, name: str = "published_texts.csv") -> DataFrame:
    return read_csv(spark, f"{folder}/{name}", PUBLISHED, ordinal=True)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as the string it is; no missing marks."""
    return read_csv(spark, path, missing=())


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_ids(spark: SparkSession, path: str | None, strict: bool = False, keep_blanks: bool = False) -> DataFrame:
    """``id``: a JSON list of ids.  A missing file is an error when strict, otherwise an empty list and a warning;
    anything but a list is always an error."""
    ids: list[str] = []
    if path is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            if strict:
                raise FileNotFoundError(f"hold-out list not found: {path}; build it first with `kalamos holdout-union`")
            log.warning("hold-out list %s not found: nothing is held out", path)
        else:
            try:
                listed = json.loads((spark.read.text(str(path), wholetext=True).first() or [""])[0])
            except json.JSONDecodeError as e:
                raise ValueError(f"{path} is not JSON") from e
            if not isinstance(listed, list):
                raise ValueError(f"{path} is not a list of ids")
            ids = sorted({str(x) if keep_blanks else str(x).strip() for x in listed if keep_blanks or str(x).strip()})
    return spark.createDataFrame([(i,) for i in ids], "id string")


def read_metric_files(spark: SparkSession, pattern: str, path_regex: str, names: tuple[str, ...]) -> DataFrame:
    """``bleu, chrf, combined`` of JSON files, with columns drawn from their paths by the groups of a pattern."""
    df = spark.read.schema("bleu double, chrf double, combined double").option("multiLine", True).json(pattern)
    path = F.col("_metadata.file_path")
    return df.select(*(F.regexp_extract(path, path_regex, k + 1).alias(n) for k, n in enumerate(names)), "bleu", "chrf", "combined")


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Run summaries with the scores of both test sets flattened."""
    scores = "struct<bleu:double,chrf:double,combined:double>"
    df = spark.read.schema(f"run_id string, config_path string, independent {scores}, newtest {scores}").option("multiLine", True).json(pattern)
    flat = [F.col(f"{s}.{m}").alias(f"{s}_{m}") for s in ("independent", "newtest") for m in ("bleu", "chrf", "combined")]
    return df.select("run_id", "config_path", F.col("_metadata.file_path").alias("summary_path"), *flat)


def read_history(spark: SparkSession, path: str, metric: str = "train/loss") -> DataFrame:
    df = read_csv(spark, path, HISTORY, ordinal=True)
    return df.where((F.col("metric") == metric) & F.col("step").isNotNull() & F.col("value").isNotNull())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    df = read_strings(spark, path)
    if df.isEmpty():
        raise ValueError(f"{path} lists no runs")
    return df


def numbered(df: DataFrame, order: str = "ordinal", name: str = "row") -> DataFrame:
    """0, 1, 2, ... in the order of a column, counted in ranges so that no task holds all rows."""
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return ranged.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + inside).drop("__p", "__start")


def attach_references(predictions: DataFrame, references: DataFrame, doc: str = "doc_id", order: str = "ordinal", columns: tuple[str, ...] = ("transliteration", "translation")) -> DataFrame:
    """Predictions with the texts of the references at the same place; both must have as many rows and the same
    documents in the same order."""
    one, two = numbered(predictions, order), numbered(references, order).select("row", F.col(doc).alias("__doc"), *columns)
    both = one.join(two, "row", "full")
    bad = both.where(f"{order} is null or not ({doc} <=> __doc)").limit(1).count()
    if bad:
        raise ValueError("predictions and references differ in rows or in the order of documents")
    return both.drop("__doc")
