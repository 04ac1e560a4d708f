"""Operators on small tables with known results."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kalamos.operators import batching, history, lexicon, metrics, retrieval, rows, runs, spans, splits, variants
from kalamos.operators.retrieval import nearest
from kalamos.sources import sinks


def test_exclusion_keeps_rows_without_document(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), (None, 3)], "oare_id string, v int")
    held = spark.createDataFrame([("A",), (None,)], "id string")
    assert {r.v for r in rows.exclude_documents(df, held).collect()} == {2, 3}
    assert rows.exclude_documents(df.select("v"), held).count() == 3


def test_word_filter_and_sentence_likeness(spark):
    df = spark.createDataFrame([("A", "a b c", "sentence"), ("B", "w " * 160, "sentence"), ("D", "a b c", "sentence"), ("E", "a", "sentence"), ("C", "w " * 220, "document")], "oare_id string, transliteration string, granularity string")
    kept = rows.granularity(df, "sentence")
    assert {r.oare_id for r in rows.word_range(kept).collect()} == {"A", "D"}
    assert rows.sentence_like(kept, "prepared", None) and not rows.sentence_like(df, "prepared", None)
    assert not rows.sentence_like(df.where("false"), "prepared", None) and not rows.sentence_like(kept, "document", None)


def test_metadata_and_ratio(spark):
    bad = ["12. 3:", "(a remark)", "Obv", "REV 1", "seal  impression", "[[ ]]", "broken", "Traces of signs", "col. iii"]
    df = spark.createDataFrame([("x" * 20, b + " " * 0) for b in bad] + [("x" * 20, "observe the long text"), ("x" * 500, "short text")], "transliteration string, translation string")
    assert [r.translation for r in rows.quality(df, least_chars=1).collect()] == ["observe the long text"]


def test_spans(spark):
    docs = spark.createDataFrame([("d", " ".join(f"w{i}" for i in range(1, 11)), 0), ("d", "ignored later row", 1)], "oare_id string, transliteration string, ordinal int")
    anchors = spark.createDataFrame([("d", n, s, t, i) for i, (n, s, t) in enumerate([(1, "w1", "one"), (4, "w4", "skipped"), (4, "W₄", "two"), (9, "no", "three"), (15, "x", "beyond")])], "text_uuid string, first_word_number int, first_word_spelling string, translation string, ordinal int")
    got = {(r.sentence_idx, r.word_start, r.word_end, r.transliteration, r.anchor_valid) for r in spans.sentence_spans(docs, anchors).collect()}
    assert got == {(0, 0, 3, "w1 w2 w3", True), (2, 3, 8, "w4 w5 w6 w7 w8", True), (3, 8, 14, "w9 w10", False)}
    stats = spans.extraction_statistics(docs, anchors).first()
    assert (stats.pairs, stats.valid, stats.invalid) == (3, 2, 1)
    assert spans.extraction_statistics(docs.where("false"), anchors).first().pairs == 0


def test_splits(spark):
    df = spark.createDataFrame([(f"d{i % 20}", i) for i in range(100)] + [(None, 100)], "oare_id string, n int")
    train, held = splits.split_documents(df, 0.1)
    assert held.select("oare_id").distinct().count() == 2 and train.count() + held.count() == 100
    a, b = splits.split_documents(df, 0.25, how="numpy", order="n")
    import numpy as np

    chosen = {f"d{k}" for k in np.random.RandomState(42).permutation(20)[:5]}
    assert {r.oare_id for r in b.collect()} == chosen
    subsets = splits.nested_subsets(df, [0.25, 0.5])
    small, large = ({r.n for r in subsets[s].collect()} for s in (0.25, 0.5))
    assert small < large
    ids = [f"d{k}" for k in range(20)]
    random.Random(42).shuffle(sorted(ids))
    with pytest.raises(ValueError, match="at least 2 unique document IDs"):
        splits.split_documents(df.where("oare_id = 'd1'"), 0.5)
    with pytest.raises(ValueError):
        splits.require_both(df, df.where("false"))


def test_glosses(spark):
    words = spark.createDataFrame([("awīlum I", '"man, human"', 1), ("awīlum", '"person; man"', 2), ("x", None, 3)], "word string, definition string, ordinal int")
    keys = {r["key"]: r["gloss"] for r in lexicon.dictionary_keys(words).collect()}
    assert keys["awīlum"] == "person" and keys["awīlum i"] == "man"
    forms = spark.createDataFrame([("word", "A-wi-lum", "awīlum I", 1), ("word", "a-wi-lum", "awīlum", 2), ("PN", "p", "awīlum", 3)], "entry_type string, form string, lexeme string, ordinal int")
    lookup = lexicon.gloss_lookup(words, forms)
    assert [tuple(r) for r in lookup.collect()] == [("a-wi-lum", "man")]
    df = spark.createDataFrame([(1, "a-wi-lum <gap> KÙ 10 a-wi-lum"), (2, "none"), (3, None)], "k int, transliteration string")
    got = {r.k: r.transliteration for r in lexicon.augment_with_glosses(df, lookup, "k").collect()}
    assert got == {1: "a-wi-lum <gap> KÙ 10 a-wi-lum || a-wi-lum: man; a-wi-lum: man", 2: "none", 3: None}


def test_retrieval_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    syllables = ["ma", "na", "ki", "ba", "lum", "šu", "tim", "um", "a"]
    text = lambda: " ".join("-".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6)))
    bank, asked = [(i, text()) for i in range(60)], [(i, text()) for i in range(25)] + [(90, "zzzz"), (91, ""), (92, None)]

    def grams(t):
        out = {}
        for n in (3, 4, 5):
            for k in range(len(t) - n + 1):
                out[t[k : k + n]] = out.get(t[k : k + n], 0) + 1
        return out

    tf = {i: grams(t) for i, t in bank}
    df = {}
    for g in tf.values():
        for k in g:
            df[k] = df.get(k, 0) + 1
    idf = {k: math.log((1 + len(bank)) / (1 + n)) + 1 for k, n in df.items()}

    def vector(g):
        v = {k: c * idf[k] for k, c in g.items() if k in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {k: x / norm for k, x in v.items()}

    vectors = {i: vector(g) for i, g in tf.items()}
    expected = {}
    for i, t in asked:
        q = vector(grams(t or ""))
        scores = [(round(sum(x * v.get(k, 0) for k, x in q.items()), 12), -b) for b, v in vectors.items()]
        best = max(scores)
        expected[i] = (-best[1], best[0])
    for most in (retrieval.MOST_GRAMS, 0):  # both ways
        monkeypatch.setattr(retrieval, "MOST_GRAMS", most)
        monkeypatch.setattr(retrieval, "HOT", 40)
        monkeypatch.setattr(retrieval, "QUERIES", 7)
        got = nearest(spark.createDataFrame(asked, "id long, t string"), spark.createDataFrame(bank, "id long, t string"), "id", "t", "id", "t").collect()
        assert {r.query_id: r.bank_id for r in got} == {i: b for i, (b, _) in expected.items()}
    assert all(abs(r.score - expected[r.query_id][1]) < 1e-9 for r in got)


def test_retrieval_of_oneself(spark):
    df = spark.createDataFrame([(1, "a-na"), (2, "a-na"), (3, "qqq")], "id long, t string")
    got = {r.query_id: r.bank_id for r in nearest(df, df, "id", "t", "id", "t", exclude_self=True).collect()}
    assert got == {1: 2, 2: 1, 3: 1}
    one = df.where("id = 1")
    assert nearest(one, one, "id", "t", "id", "t", exclude_self=True).first().bank_id == 1


def test_variants(spark):
    bank = spark.createDataFrame([("A", "a-na be-li2-ia", "to my lord", 1), ("B", "um-ma šu-ut-ma", "thus he", 2), ("C", "1 ma-na KÙ.BABBAR", "1 mina of silver.", 3)], "oare_id string, transliteration string, translation string, n long")
    asked = spark.createDataFrame([("1 ma-na KÙ.BABBAR", "x", 1)], "transliteration string, translation string, n long")
    out = variants.retrieval_augmented(bank, {"test": asked}, None, "n")
    row = out["retrieval_augmented"]["test"].first()
    assert row.retrieved_translation == "1 mina of silver." and row.transliteration.startswith("retrieved_source 1 ma-na")
    assert "retrieved_translation" not in out["retrieval_source_only"]["test"].first().transliteration
    with pytest.raises(ValueError):
        variants.retrieval_augmented(bank, {}, spark.createDataFrame([("A",), ("B",), ("C",)], "id string"), "n")
    genre = variants.genre_conditioned(asked.withColumn("genre", F.lit("Debt note"))).first()
    assert genre.transliteration.startswith("genre_debt_note source_text ") and genre.base_transliteration == "1 ma-na KÙ.BABBAR"
    assert variants.numeral_normalized(spark.createDataFrame([("ma-na 7.5 GÍN",)], "transliteration string")).first().numeral_annotation_count == 1


def test_metrics(spark):
    pairs = [(0, "the cat sat on the mat", "the cat sat on the mat"), (1, "a quick brown fox jumps", "a quick brown fox jumped"), (2, "", "something here")]
    df = spark.createDataFrame(pairs, "i int, h string, r string")
    s = metrics.statistics(df, "h", "r", "i")
    per = {r.i: r for r in metrics.sentence_scores(s).collect()}
    assert abs(per[0].bleu - 100) < 1e-9 and abs(per[0].chrf - 100) < 1e-9 and abs(per[0].combined - 100) < 1e-9
    assert abs(per[1].bleu - 100 * math.exp((math.log(4 / 5) + math.log(3 / 4) + math.log(2 / 3) + math.log(1 / 2)) / 4)) < 1e-9
    assert per[2].bleu == per[2].chrf == 0
    corpus = metrics.corpus_scores(s).first()
    assert 0 < corpus.bleu < 100 and abs(corpus.combined - math.sqrt(corpus.bleu * corpus.chrf)) < 1e-9
    assert metrics.tokens_13a('He said: "1,000.5 kg-3," ok-\nay') == ["He", "said", ":", '"', "1,000.5", "kg-3", ",", '"', "okay"]


def test_candidates(spark):
    df = spark.createDataFrame([(1, ["a b c", " a b c ", "a b d", "x"]), (2, ["only"]), (3, ["", " "]), (4, [])], "k int, c array<string>")
    assert {r.k: r.picked for r in metrics.pick_candidates(df, "k", "c").collect()} == {1: "a b c", 2: "only", 3: "", 4: ""}


def test_bootstrap_equals_scoring_every_resample(spark):
    rng = random.Random(1)
    words = "a b c d e f".split()
    said = lambda: " ".join(rng.choice(words) for _ in range(8))
    data = [(i, system, said(), said()) for i in range(6) for system in ("one", "two")]
    df = spark.createDataFrame(data, "idx long, system string, h string, r string")
    stats = metrics.statistics(df, "h", "r", "idx", "system")
    draws = metrics.numpy_draws(spark, 6, 20)
    got = metrics.paired_bootstrap(stats, draws, "idx", "system", "one", "two").first()
    assert got.resamples == 20 and got.ci_low <= got.ci_high and 0 <= got.p <= 1
    weights = {}
    for r in draws.collect():
        weights.setdefault(r.resample, {})[r.idx] = r.weight
    deltas = []
    for w in weights.values():
        rows_ = [(system, h, r) for i, system, h, r in data for _ in range(w.get(i, 0))]
        scores = {r.system: r.combined for r in metrics.corpus_scores(metrics.statistics(spark.createDataFrame(rows_, "system string, h string, r string"), "h", "r", "system"), "system").collect()}
        deltas.append(scores["one"] - scores["two"])
        if len(deltas) == 2:
            break
    scored = metrics.scored(draws.where("resample < 2").join(stats, "idx").groupBy("resample", "system").agg(*(F.sum(F.col(s) * F.col("weight")).alias(s) for s in metrics.STATISTICS)))
    by = {(r.resample, r.system): r.combined for r in scored.collect()}
    assert all(abs(by[k, "one"] - by[k, "two"] - d) < 1e-9 for k, d in enumerate(deltas))


def test_registry_and_seeds(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "run_id string, status string")
    new = spark.createDataFrame([("b", "z"), ("c", "w")], "run_id string, status string")
    out = runs.upsert_runs(old, new)
    assert tuple(out.columns) == runs.REGISTRY and {(r.run_id, r.status) for r in out.collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    one = spark.createDataFrame([("s", 1.0)], "size string, v double")
    assert runs.seed_statistics(one, "v", "size").first().sd == 0


def test_history(spark):
    df = spark.createDataFrame([(1, 9.0, 0), (1, 4.0, 1), (2, 3.2, 2), (3, 2.8, 3), (4, 2.3, 4)], "step int, value double, ordinal int").withColumn("metric", F.lit("train/loss"))
    got = [round(r.smoothed, 6) for r in history.smoothed(history.loss_series(df), 2).orderBy("step").collect()]
    assert got == [4.0, 3.6, 3.0, 2.55]
    scores = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 1.5, 3.0])], "i int, v double")
    stops = [r.i for r in history.early_stopping(scores, "v", ["i"], 2).where("stops").collect()]
    assert stops == [3]


def test_batches(spark):
    df = spark.createDataFrame([(i, i * 7 % 13) for i in range(50)], "k long, n int")
    out = batching.drop_last(batching.sortish(df, "k", "n", 4, 3), 4)
    assert out.count() == 48 and out.groupBy("batch").count().where("count <> 4").count() == 0
    one = batching.drop_last(batching.sortish(df.where("k = 0"), "k", "n", 2), 2)
    assert one.count() == 1
    plan = spark.range(10).select(F.col("id").alias("p"), F.lit(10).alias("n"))
    scale = [r.scale for r in batching.accumulation(plan, "p", "n", 4).orderBy("p").collect()]
    assert scale == [0.25] * 8 + [0.5] * 2
    ids = spark.createDataFrame([("aš",), ("abcdefghijklmnopqrstuvwxyz",), ("",)], "t string").select(batching.byte_ids(F.col("t"), 16).alias("x")).collect()
    assert ids[0].x == [100, 200, 164, 1] and len(ids[1].x) == 16 and ids[1].x[-1] == 1 and ids[2].x == [1]


def test_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a-na", "to"), (2, "um-ma", "thus")], "n long, transliteration string, translation string")
    out = {"plain": {"train": df, "test": df}}
    variants.write_variants(out, str(tmp_path), sinks.write_json)
    said = json.loads((tmp_path / "manifest.json").read_text())
    assert said["plain"]["train_rows"] == 2 and said["plain"]["train_source_bytes_max"] == 5


def test_python_shuffle_split(spark):
    df = spark.createDataFrame([(f"d{k:02}", k) for k in range(20)], "oare_id string, n int")
    train, held = splits.shuffled_split(df, 0.1)
    ids = sorted(f"d{k:02}" for k in range(20))
    random.Random(42).shuffle(ids)
    assert {r.oare_id for r in held.collect()} == set(ids[:2]) and train.count() == 18


def test_paper_numbers(spark):
    data = [(c, z, s, "independent", v) for c, z, s, v in [("base", "small", 1, 10.0), ("base", "small", 2, 12.0), ("tag", "small", 1, 11.0), ("tag", "small", 2, 12.0), ("tag", "large", 1, 5.0)]]
    df = spark.createDataFrame(data, "condition string, size string, seed int, split string, v double")
    out = runs.paper_numbers(df, "condition", "base", "size", "seed", "split", "v")
    assert out["baselines"].first()["mean"] == 11.0 and out["deltas"].first()["mean"] == 0.5 and out["per_seed"].count() == 2
    assert runs.gap_to(out["baselines"], "mean", 1.0).first().gap == 10.0


def test_named_functions(spark):
    from kalamos.functions.registry import chained

    df = spark.createDataFrame([("  ḫa₄ <gap> x",)], "t string")
    assert df.select(chained(F.col("t"), "plain_h", "plain_digits", "without_gap_tags", "lone_x")).first()[0] == "ha4 <gap>"
