"""Sentences of documents from positional anchors.

An anchor says at which word (1-based) a sentence starts.  A sentence ends
where the next anchor of the document starts, the last one with the document.
One window over the anchors, one equi-join with the documents; both are keyed
by the document, so the join's partitioning serves the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalamos.functions import text as T

SPAN_COLUMNS = ("transliteration", "translation", "doc_id", "sentence_idx", "anchor_valid", "word_start", "word_end")


def same_anchor(actual: Column, expected: Column) -> Column:
    """Equal words, or equal but for lowered digits, or one the beginning of the other; never if one is empty."""
    one, two = F.lower(T.strip(actual)), F.lower(T.strip(expected))
    plain = T.plain_digits(one) == T.plain_digits(two)
    return F.coalesce((one != "") & (two != "") & ((one == two) | plain | one.startswith(two) | two.startswith(one)), F.lit(False))


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key by an explicit ordinal."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sentence_spans(documents: DataFrame, anchors: DataFrame, doc: str = "oare_id", order: str = "ordinal") -> DataFrame:
    """SentencePair rows.  ``documents``: doc, transliteration, ordinal; ``anchors``: text_uuid, first_word_number,
    first_word_spelling, translation, ordinal.  Of anchors at one word the last one by ordinal holds.  ``word_end``
    is not clipped to the text.  Anchors without translation still end the sentence before them."""
    docs = first_rows(documents.where(F.col(doc).isNotNull()), doc, order).select(F.col(doc).alias("doc_id"), T.words(F.col("transliteration")).alias("words"))
    w = Window.partitionBy("text_uuid").orderBy("first_word_number", order)
    placed = anchors.where("text_uuid is not null").select(
        F.col("text_uuid").alias("doc_id"),
        (F.col("first_word_number") - 1).cast("int").alias("word_start"),
        (F.lead("first_word_number").over(w) - 1).cast("int").alias("next_start"),
        (F.row_number().over(w) - 1).cast("int").alias("sentence_idx"),
        F.coalesce("first_word_spelling", F.lit("nan")).alias("spelling"),
        "translation",
    )
    spans = placed.join(docs, "doc_id").withColumn("n", F.size("words")).withColumn("word_end", F.coalesce("next_start", "n"))
    spans = spans.where("word_start >= 0 and word_start < n and word_end > word_start").where(T.strip(F.col("translation")) != "")
    return spans.select(
        F.array_join(F.slice("words", F.col("word_start") + 1, F.col("word_end") - F.col("word_start")), " ").alias("transliteration"),
        T.strip(F.col("translation")).alias("translation"),
        "doc_id",
        "sentence_idx",
        same_anchor(F.get("words", F.col("word_start")), F.col("spelling")).alias("anchor_valid"),
        "word_start",
        "word_end",
    )


def mixed_rows(documents: DataFrame, anchors: DataFrame, include_invalid: bool = False, doc: str = "oare_id", order: str = "ordinal") -> DataFrame:
    """Sentences where a document has anchors, whole documents where it has none, told apart by ``data_type``."""
    spans = sentence_spans(documents, anchors, doc, order)
    if not include_invalid:
        spans = spans.where("anchor_valid")
    known = anchors.select(F.col("text_uuid").alias(doc)).where("text_uuid is not null").distinct()
    whole = first_rows(documents, doc, order).join(known, doc, "left_anti").where((T.strip(F.col("transliteration")) != "") & (T.strip(F.col("translation")) != ""))
    whole = whole.select("transliteration", "translation", F.col(doc).alias("doc_id"), F.lit("document").alias("data_type"))
    return spans.withColumn("data_type", F.lit("sentence")).unionByName(whole, allowMissingColumns=True)


def extended_rows(documents: DataFrame, anchors: DataFrame, published: DataFrame | None = None, held_out: DataFrame | None = None, doc: str = "oare_id", order: str = "ordinal") -> DataFrame:
    """Sentences of the training documents and, beyond them, of published texts that have anchors; ``source`` says which."""
    spans = sentence_spans(documents, anchors, doc, order).withColumn("source", F.lit("train"))
    if published is not None:
        more = published.join(documents.select(doc).where(F.col(doc).isNotNull()).distinct(), doc, "left_anti")
        if held_out is not None:
            more = more.join(held_out.select(F.col(held_out.columns[0]).alias(doc)).distinct(), doc, "left_anti")
        more = more.where(T.strip(F.col("transliteration")) != "")
        spans = spans.unionByName(sentence_spans(more, anchors, doc, order).withColumn("source", F.lit("published")))
    return spans


def extraction_statistics(documents: DataFrame, anchors: DataFrame, doc: str = "oare_id", order: str = "ordinal") -> DataFrame:
    """One row about what the anchors yield."""
    spans = sentence_spans(documents, anchors, doc, order)
    ids = documents.select(F.col(doc).alias("id")).where("id is not null").distinct()
    known = anchors.select(F.col("text_uuid").alias("id")).where("id is not null").distinct()
    counts = ids.agg(F.count(F.lit(1)).alias("train_docs")).crossJoin(known.agg(F.count(F.lit(1)).alias("anchor_docs")))
    counts = counts.crossJoin(ids.join(known, "id", "left_semi").agg(F.count(F.lit(1)).alias("docs_with_anchors")))  # one row each
    words = T.word_count(F.col("transliteration"))
    pairs = spans.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if("anchor_valid").alias("valid"),
        F.count_if(~F.col("anchor_valid")).alias("invalid"),
        F.round(F.coalesce(F.avg(F.col("anchor_valid").cast("double")), F.lit(0.0)), 6).alias("match_rate"),
        F.round(F.coalesce(F.avg(words), F.lit(0.0)), 6).alias("avg_words"),
        F.coalesce(F.min(words), F.lit(0)).cast("long").alias("min_words"),
        F.coalesce(F.max(words), F.lit(0)).cast("long").alias("max_words"),
    )
    return counts.crossJoin(pairs)
