"""The pN_ queries: each runs a problem's operator over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalamos.session import spread

CORPUS = "golden_corpus_v2_prefilt"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in (CORPUS, "documents", "sentence_pairs") else df


def _tests(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str]]:
    return {
        "independent": (table(spark, folder, "independent_test_set_clean"), "test_id"),
        "newtest": (table(spark, folder, "new_test_set"), "test_id"),
    }


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.overlap import cross_split_overlaps

    return cross_split_overlaps(table(spark, folder, CORPUS), "row_id", "transliteration", _tests(spark, folder)).select("split", "test_id", "row_id")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.overlap import cross_split_overlaps, overlap_report

    corpus = table(spark, folder, CORPUS)
    return overlap_report(cross_split_overlaps(corpus, "row_id", "transliteration", _tests(spark, folder)), corpus, "row_id", "source")


def _term_counts(spark: SparkSession, folder: str):
    from kalamos.llm.termcounts import TermCounts, signed

    corpus = table(spark, folder, CORPUS).select("transliteration", "ingested_at")
    counts = TermCounts(spark)
    # two deliveries: what came in before 2024, then everything later as a change set of added rows
    early = F.coalesce(F.col("ingested_at") < F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(True))
    counts.apply(signed(None, corpus.where(early), "transliteration"))
    counts.apply(signed(None, corpus.where(~early), "transliteration"))
    return counts


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder).marked().where("mark is not null").select("term", "mark")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder).marked()


def p2_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Counts after a first delivery, then one change set: rows without a genre deleted, the text of rows edited in
    2024 or later replaced by their translation, rows that came in after the first delivery added."""
    from kalamos.llm.termcounts import TermCounts, signed

    corpus = table(spark, folder, CORPUS).select("transliteration", "translation", "genre", "edited_at", "ingested_at")
    counts = TermCounts(spark)
    early = F.coalesce(F.col("ingested_at") < F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(True))
    counts.apply(signed(None, corpus.where(early), "transliteration"))
    gone, edited = F.col("genre").isNull(), F.coalesce(F.col("edited_at") >= F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(False))
    now = corpus.where(~gone).select(F.when(edited, F.col("translation")).otherwise(F.col("transliteration")).alias("transliteration"), early.alias("early"), edited.alias("edited"))
    counts = TermCounts(spark, counts.path)  # another session would open the table the same way
    counts.apply(signed(corpus.where(early & (gone | edited)), now.where("edited or not early"), "transliteration"))
    return counts.counts()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.groups import tablet_groups
    from kalamos.llm.work import written

    ids = table(spark, folder, CORPUS).select(F.col("oare_id").alias("id")).unionAll(table(spark, folder, "sentence_pairs").select(F.col("doc_id").alias("id")))
    groups = written(tablet_groups(ids, "id", table(spark, folder, "tablet_joins"), "left_id", "right_id"), "groups")
    many = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("group")
    return groups.join(many, "group").select("id_written", F.col("group").alias("group_id"))


def _splits(spark: SparkSession, folder: str):
    from kalamos.llm.groups import assign_splits

    tables = {
        CORPUS: (table(spark, folder, CORPUS), "row_id", "oare_id"),
        "sentence_pairs": (table(spark, folder, "sentence_pairs"), "pair_id", "doc_id"),
    }
    targets = table(spark, folder, "split_targets")
    return tables, targets, assign_splits(tables, table(spark, folder, "tablet_joins"), "left_id", "right_id", targets, "split", "share")


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    return _splits(spark, folder)[2]


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Of the assignment of all rows: the wanted splits, whether their shares came out, and that no id is torn."""
    from kalamos.llm.groups import split_check
    from kalamos.llm.work import written

    tables, targets, assigned = _splits(spark, folder)
    return split_check(written(assigned, "splits"), tables, targets, "split", "share").select("split", "within", "torn")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.neardup import near_duplicate_pairs

    return near_duplicate_pairs(table(spark, folder, CORPUS), "row_id", "transliteration", "translation").toDF("row_id_a", "row_id_b")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.neardup import near_duplicate_report

    return near_duplicate_report(table(spark, folder, CORPUS), "row_id", "transliteration", "translation")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.alike import alike_pairs

    return alike_pairs(table(spark, folder, CORPUS), "row_id", "transliteration").toDF("row_id_a", "row_id_b")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.alike import alike_groups

    return alike_groups(table(spark, folder, CORPUS), "row_id", "transliteration").toDF("row_id", "class_id", "forms", "rows")


def p5_one_form(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.alike import to_one_form

    return table(spark, folder, CORPUS).select("row_id", to_one_form("transliteration").alias("one_form"))


def _aligned(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.sentences import align_documents

    return align_documents(table(spark, folder, "sentence_pairs"), "doc_id", "sentence_idx", "transliteration", "translation")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _aligned(spark, folder).select(F.col("doc").alias("doc_id"), F.col("src").alias("src_idx"), F.col("tgt").alias("tgt_idx"))


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _aligned(spark, folder).select(F.col("doc").alias("doc_id"), F.col("src").alias("src_idx"), F.col("tgt").alias("tgt_idx"), F.round("score", 4).alias("score"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.encode import encode_table

    return encode_table(table(spark, folder, "documents"), "doc_id", "text").toDF("doc_id", "ids")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.leaks import leaked_items

    return leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "heldout_items"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.leaks import leak_report

    return leak_report(_leaks(spark, folder), table(spark, folder, "heldout_items"), "item_id", "split")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.spans import SharedSpans

    return SharedSpans(table(spark, folder, "documents"), "doc_id", "text").pair_ids().toDF("doc_id_a", "doc_id_b")


def p9_coverage(spark: SparkSession, folder: str) -> DataFrame:
    from kalamos.llm.spans import SharedSpans

    return SharedSpans(table(spark, folder, "documents"), "doc_id", "text").coverage().withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_counts, p2_changes, p3_found, p3_splits, p3_shares, p4_found, p4_groups, p5_found, p5_groups, p5_one_form, p6_found, p6_scores, p7_ids, p8_found, p8_report, p9_found, p9_coverage)}
