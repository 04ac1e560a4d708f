"""Glosses from a dictionary and a lexicon of forms, and texts enriched with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalamos.functions import text as T

ROMAN = rf"{T.WS}+[IVX]+$"
GAPS = (T.GAP, T.LARGE_GAP)
NO_GLOSS = r"^[A-ZÀ-Ž0-9.]+$"


def lookup_form(form: Column) -> Column:
    return F.replace(T.plain_digits(F.lower(T.strip(form))), F.lit("ḫ"), F.lit("h"))


def short_gloss(definition: Column) -> Column:
    """The first quoted string up to its first ; and then its first comma; empty if there is none."""
    quoted = F.regexp_extract(F.coalesce(definition, F.lit("")), '"([^"]+)"', 1)
    return T.strip(F.substring_index(F.substring_index(quoted, ";", 1), ",", 1))


def dictionary_keys(dictionary: DataFrame, order: str = "ordinal") -> DataFrame:
    """``key, gloss``.  A word's own keys hold its last gloss; keys without the homonym numeral hold, where no word
    has them as its own, the first gloss that came along."""
    word = T.strip(F.coalesce(F.col("word"), F.lit("nan")))
    base = T.strip(F.regexp_replace(word, ROMAN, ""))
    rows = dictionary.where("definition is not null").select(word.alias("word"), base.alias("base"), short_gloss(F.col("definition")).alias("gloss"), F.col(order).alias("o")).where("gloss <> ''")
    key = lambda k, own: F.struct(k.alias("key"), F.lit(own).alias("own"))
    w, b = F.col("word"), F.col("base")
    keys = F.array(key(F.lower(w), True), key(lookup_form(w), True))
    more = F.array(key(F.lower(b), False), key(lookup_form(b), False))
    rows = rows.select("gloss", "o", F.inline(F.when(b == w, keys).otherwise(F.concat(keys, more))))
    best = F.max_by("gloss", F.struct("own", F.when(F.col("own"), F.col("o")).otherwise(-F.col("o"))))
    return rows.groupBy("key").agg(best.alias("gloss"))


def gloss_lookup(dictionary: DataFrame, forms: DataFrame, order: str = "ordinal", kind: str = "entry_type") -> DataFrame:
    """``form, gloss``: the first form of each spelling that finds a gloss by its lexeme, in lower case, else in
    look-up form."""
    keys = dictionary_keys(dictionary, order)
    said = lambda c: F.coalesce(T.strip(F.col(c)), F.lit("nan"))
    rows = forms.where(F.col(kind) == "word").select(said("form").alias("form"), said("lexeme").alias("lexeme"), F.col(order).alias("o"))
    rows = rows.where("form not in ('', 'nan') and lexeme not in ('', 'nan')")
    rows = rows.select(lookup_form(F.col("form")).alias("form"), F.lower("lexeme").alias("first"), lookup_form(F.col("lexeme")).alias("second"), "o")
    one, two = keys.toDF("first", "gloss_1"), keys.toDF("second", "gloss_2")
    found = rows.join(one, "first", "left").join(two, "second", "left").withColumn("gloss", F.coalesce("gloss_1", "gloss_2")).where("gloss is not null")
    return found.groupBy("form").agg(F.min_by("gloss", "o").alias("gloss"))


def augment_with_glosses(df: DataFrame, lookup: DataFrame, key: str, column: str = "transliteration", most: int = 8) -> DataFrame:
    """The text followed by ``|| token: gloss; ...`` for the first ``most`` tokens that have one, in their order.

    Tokens meet glosses in an equi-join; per text only the found ones come back, so the gather is bounded by
    the text itself."""
    token = F.explode(F.transform(T.words(F.col(column)), lambda w, i: F.struct(i.alias("pos"), w.alias("token"))))
    tokens = df.select(key, token.alias("e")).select(key, "e.pos", "e.token").where(~F.col("token").isin(*GAPS) & ~F.col("token").rlike(NO_GLOSS))
    hits = tokens.withColumn("form", lookup_form(F.col("token"))).join(lookup, "form")
    first = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    hits = hits.withColumn("n", first).where(F.col("n") <= most)
    said = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.concat("token", F.lit(": "), "gloss").alias("g")))).alias("hits"))
    said = said.select(key, F.array_join(F.col("hits.g"), "; ").alias("__glosses"))
    out = df.join(said, key, "left")
    return out.withColumn(column, F.when(F.col("__glosses").isNull(), F.col(column)).otherwise(F.concat(column, F.lit(" || "), "__glosses"))).drop("__glosses")
