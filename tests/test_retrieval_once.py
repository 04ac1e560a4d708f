"""What retrieval does once: training rows are prepared once, queries are walked once a bucket."""

import numpy as np
import pytest

from kalamos.operators import retrieval
from kalamos.plans import pipeline


def test_training_rows_are_prepared_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(k, f"a-na be-li {k}", f"to my lord {k}") for k in range(50)], "k long, transliteration string, translation string")
    said = pipeline.predict_nearest(rows.mapInPandas(counted, rows.schema), rows, "k", "k").collect()
    assert [r.prediction for r in sorted(said)] == [f"to my lord {k}" for k in range(50)]
    assert seen.value == 50


@pytest.mark.parametrize("entries", [0, 1_000, 111_000_000, 720_000_000])
def test_a_bucket_is_one_index(entries):
    slices, buckets = retrieval._grid(20_000, 277_000, entries, 12)
    assert slices >= 1 and slices * buckets >= 12
    assert entries / buckets < retrieval.ENTRIES and 277_000 / buckets <= retrieval.ROWS


@pytest.mark.parametrize("by", ["char", "char_wb"])
def test_first_buckets_seed_the_others(spark, monkeypatch, tmp_path, by):
    """Many buckets give the rows of one, ties included; queries are stored split."""
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("abdeik"), 3)) for _ in range(60)]
    texts = [" ".join(r.choice(words, 4)) for _ in range(700)] + [None, "", "qqq"]
    bank = spark.createDataFrame([(k - 1, t) for k, t in enumerate([*texts, *texts[:300]])], "id long, t string")  # equal rows of other ids, and the id -1
    asked = spark.createDataFrame([(k, t) for k, t in enumerate([*texts[::3], *(" ".join(r.choice(words, 4)) for _ in range(200)), "zzz", None])], "k long, t string")
    run = lambda: sorted(retrieval.nearest(asked, bank, "k", "t", "id", "t", analyzer=by).collect())
    one = run()
    folders: list[str] = []
    new = retrieval.new_folder
    monkeypatch.setattr(retrieval, "new_folder", lambda *a: folders.append(new(*a)) or folders[-1])
    monkeypatch.setattr(retrieval, "ROWS", 8)
    assert run() == one
    assert "t" not in (names := spark.read.parquet(f"{folders[0]}/slices").columns) and "text" not in names
    seeds = spark.read.parquet(f"{folders[0]}/seeds").select("query_id", "score").collect()
    last = {q: s for q, _, s in one}
    assert len(seeds) > 200 and all(s <= last[q] for q, s in seeds) and any(s < last[q] for q, s in seeds)


def test_a_bucket_is_left_where_nothing_reaches_the_best_so_far():
    texts = ["a-na be-li", "um-ma a-na", "be-li qi-bi"]
    row, gram, count = retrieval._profiles(texts, 3, 5, True)
    weight = count / np.sqrt(np.bincount(row, count * count))[row]
    bucket = retrieval._Bucket(np.arange(3), row, gram, weight, (np.unique(gram)[:4], np.arange(4), None))
    ask = lambda least: list(bucket.best(row, gram, weight, 3, np.full(3, least), None))
    assert [(q, b) for q, b, _ in ask(0.0)] == [(q, b) for q, b, _ in ask(1.0)] == [(0, 0), (1, 1), (2, 2)]
    assert ask(1.1) == []
