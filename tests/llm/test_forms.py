"""Problems 2, 5 and the plain words that several problems share."""

import random
import unicodedata
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from kalamos.llm.alike import alike_groups, alike_pairs, to_one_form
from kalamos.llm.lookalike import one_form, plain_words, skeleton
from kalamos.llm.termcounts import TermCounts, signed
from kalamos.llm.words import WordHashes, bags, signatures, sketches

CLASH = "id long, text string, sig long, look_a long, own long, term string, key long, doc long"


def with_clashes(df):
    return df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ") if c.split()[0] not in df.columns})


def test_skeleton():
    same = ["šar-ru qé", unicodedata.normalize("NFD", "šar-ru qé"), "šar‐ru qé", "š​a﻿r-ru­ qé", "ｓ̌ａｒ－ｒｕ qé", "šаr-ru qé"]
    assert len({skeleton(s) for s in same}) == 1
    assert {one_form(s) for s in same} == {"šar-ru qé"}
    different = ["a₄", "a4", "A4", "á4", "ạ4", "[a4]", "‹a4›", "<a4>", "(a4)", "{a4}", "a 4", "a  4", "a-4", "a—4", "a\n4"]
    assert len({skeleton(s) for s in different}) == len(different)
    assert skeleton("") == "" and skeleton("​") == ""
    assert skeleton("ＮΑ.ＡΖ") == "NA.AZ" and skeleton("Ψ8 Δ6") == "Ψ8 Δ6"
    assert skeleton(skeleton("Ａ̀ｋ")) == skeleton("Ａ̀ｋ")


def test_look_alikes_of_any_script():
    pairs = ["𝐚a", "ρp", "αa", "ⅼl", "ᎪA", "ⲟo", "סo", "ıi", "Ӏl", "ƽs", "ГΓ", "𝟎0", "ⅿm", "ΙI", "ІI", "ӏl", "ｱア"]
    assert all(skeleton(p[0]) == skeleton(p[1]) for p in pairs)
    assert skeleton("ﬁ") == "fi" and skeleton("Ⅳ") == "IV" and skeleton("ｶﾞ") == skeleton("ガ")
    kept = "lI10Oom|ʾʿ×ₓ₄ʼŁøßþ⁴½①ΛΔΨЖ"
    assert len({skeleton(c) for c in kept}) == len(kept) and all(one_form(c) == c for c in kept)
    from kalamos.llm.lookalike import LOOKALIKE, confusables

    assert len(confusables()) > 5000 and confusables("/nowhere") == {}
    assert all(skeleton(skeleton(chr(c))) == skeleton(chr(c)) for c in LOOKALIKE)


def test_alike_groups(spark):
    rows = [(1, "šu-ma"), (2, "šu‐ma"), (3, "šu-ma"), (4, "ŠU"), (5, None), (6, ""), (7, "a"), (8, "а")]
    df = with_clashes(spark.createDataFrame(rows, "row_id long, t string"))
    got = {tuple(r) for r in alike_groups(df, "row_id", "t").collect()}
    assert got == {(1, 1, 2, 3), (2, 1, 2, 3), (3, 1, 2, 3), (7, 7, 2, 2), (8, 7, 2, 2)}
    assert alike_groups(df.where("false"), "row_id", "t").count() == 0


def test_plain_words():
    assert plain_words('[Ma-àk₄]! x? "the... ＡＢ － 1/2. ‹a›-na ˹{d}utu˺') == ["ma-àk4", "x", "the", "ab", "1/2", "a-na", "dutu"]
    assert plain_words(None) == plain_words("") == plain_words("... !? —") == []
    assert plain_words("a b\r\nc d") == ["a", "b", "c", "d"]


def test_word_hashes_remember_without_change():
    words = WordHashes()
    text = "a b ｃ [d] a a ..."
    assert words(text) == words(text) and len(words(text)) == 6
    flat, offsets = words.batch([text, None, "", "a"])
    assert offsets.tolist() == [0, 6, 6, 6, 7]
    tokens = bags(flat, offsets)
    assert len(set(tokens[:6].tolist())) == 6  # repeated words are told apart by occurrence
    one, two = words.batch(["a b c a"]), words.batch(["c a b a"])
    assert signatures(bags(*one), one[1])[0] == signatures(bags(*two), two[1])[0]
    assert sketches(tokens, offsets)[1] == 0


def test_alike_pairs_by_brute_force(spark):
    rng = random.Random(2)
    forms = ["šu-ma", "šu‐ma", "s̆u-ma", unicodedata.normalize("NFD", "šu-ma"), "šu-ma​", "su-ma", "ŠU-MA", "šu ma", "šu ma", "", None, "š" * 20000, "š" * 20000 + "​"]
    data = [(i, rng.choice(forms)) for i in range(80)]
    df = with_clashes(spark.createDataFrame(data, "row_id long, transliteration string"))
    got = alike_pairs(df, "row_id", "transliteration").collect()
    want = {(i, j) for (i, a), (j, b) in combinations(data, 2) if a and b and a != b and skeleton(a) == skeleton(b)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert alike_pairs(df.where("false"), "row_id", "transliteration").count() == 0


def test_column_form(spark):
    df = spark.createDataFrame([("ａ b",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(to_one_form("t")).collect()] == ["a b", None, ""]


def count(texts):
    occurrences, records = Counter(), Counter()
    for t in texts:
        if t:
            terms = [one_form(p) for p in t.split() if one_form(p)]
            occurrences.update(terms)
            records.update(set(terms))
    return {t: (n, records[t]) for t, n in occurrences.items()}


def stored(counts):
    return {r.term: (r.occurrences, r.records) for r in counts.counts().collect()}


def test_incremental_counts_equal_a_recount(spark):
    rng = random.Random(4)
    words = ["a", "ａ", "b", "c₄", "[d]", "e", "ḫu", "ḫu"]
    texts = {i: rng.choice([None, "", " "] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(12)]) for i in range(60)}
    table = lambda rows: spark.createDataFrame(list(rows), "row_id long, text string")
    counts = TermCounts(spark, buckets=4)
    counts.apply(signed(None, table(texts.items()), "text"))
    assert stored(counts) == count(texts.values())
    assert counts.records() == sum(bool(t) for t in texts.values())
    changed = {i: "new words b b" for i in range(0, 20, 3)}
    gone = [i for i in range(40, 60)]
    old = {i: texts[i] for i in [*changed, *gone]}
    counts.apply(signed(table(old.items()), table([*changed.items(), (100, "added ａ")]), "text"))
    texts = {i: t for i, t in texts.items() if i not in gone} | changed | {100: "added a"}
    assert stored(counts) == count(texts.values())
    counts.apply(signed(table(texts.items()), None, "text"))
    assert stored(counts) == {} and counts.records() == 0


def test_marks(spark):
    texts = ["a b"] * 3 + ["a c"] + ["d d d"] * 12
    counts = TermCounts(spark)
    counts.apply(signed(None, with_clashes(spark.createDataFrame([(t,) for t in texts], "t string")), "t"))
    marks = {r.term: r["mark"] for r in counts.marked().collect()}
    assert marks == {"a": "common", "b": None, "c": "rare", "d": "common"}
    empty = TermCounts(spark)
    empty.apply(signed(None, spark.createDataFrame([(None,), ("",)], "t string"), "t"))
    assert empty.marked().count() == 0 and empty.records() == 0


def test_a_second_process_continues_the_table(spark, tmp_path):
    import os
    import subprocess
    import sys

    path = str(tmp_path / "terms")
    make = "from pyspark.sql import SparkSession; from kalamos.llm.termcounts import TermCounts, signed; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
    first = make + f"c = TermCounts(s, {path!r}); c.apply(signed(None, s.createDataFrame([('a b a',), ('b c',)], 't string'), 't'))"
    subprocess.run([sys.executable, "-c", first], check=True, env=os.environ, timeout=200, capture_output=True)
    again = TermCounts(spark, path)
    assert stored(again) == {"a": (2, 1), "b": (2, 2), "c": (1, 1)} and again.records() == 2
    text = lambda *t: spark.createDataFrame([(x,) for x in t], "t string")
    again.apply(signed(text("b c"), text("d", "a"), "t"))
    assert stored(TermCounts(spark, path)) == {"a": (3, 2), "b": (1, 1), "d": (1, 1)} and TermCounts(spark, path).version == 2
