"""Problems 1, 4, 8 and 9 against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from kalamos.llm.leaks import leak_report, leaked_items, terms_of
from kalamos.llm.lookalike import plain_words
from kalamos.llm.neardup import near_duplicate_pairs, near_duplicate_report
from kalamos.llm.overlap import cross_split_overlaps, in_order, overlap_report
from kalamos.llm.spans import SharedSpans, points, rolling, stretches, window_minima
from tests.llm.test_forms import with_clashes

VOCABULARY = [f"{a}-{b}" for a in ("ma", "na", "šu", "ki", "ba", "el", "ḫa", "zi") for b in ("ak", "um", "tim", "ra", "lu", "ù")]


def share(a, b):
    one, two = plain_words(a), plain_words(b)
    return 2 * sum((Counter(one) & Counter(two)).values()) / (len(one) + len(two)) if one and two else None


def sentence(rng, least=6, most=25):
    return " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(least, most)))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        k = rng.randrange(len(words))
        how = rng.randrange(4)
        if how == 0:
            words[k] = rng.choice(VOCABULARY)
        elif how == 1 and len(words) > 3:
            del words[k]
        elif how == 2:
            words.insert(k, rng.choice(VOCABULARY))
        else:
            words[k] = f"[{words[k]}]!"
    if rng.random() < 0.2:
        cut = rng.randrange(len(words))
        words = words[cut:] + words[:cut]
    return " ".join(words)


def corpus(rng, n=60):
    rows = []
    for _ in range(n):
        a, b = sentence(rng), sentence(rng)
        for _ in range(rng.choice((1, 1, 2, 3))):
            rows.append((edited(rng, a, rng.randint(0, 2)), edited(rng, b, rng.randint(0, 2))))
    rows += [rows[0]] * 5 + [(None, rows[1][1]), (rows[2][0], None), ("", ""), (None, None), ("...", "!?"), ("x " * 5000, "y " * 5000), ("x " * 5000 + "z", "y " * 5000)]
    return [(i, *r) for i, r in enumerate(rows)]


def test_near_duplicates(spark):
    rows = corpus(random.Random(7))
    df = with_clashes(spark.createDataFrame(rows, "row_id long, transliteration string, translation string"))
    got = [tuple(r) for r in near_duplicate_pairs(df, "row_id", "transliteration", "translation").collect()]
    want = set()
    for (i, a, b), (j, c, d) in combinations(rows, 2):
        held = [s for s in (share(a, c), share(b, d)) if s is not None]
        if held and min(held) >= 0.75:
            want.add((i, j))
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.97 * len(want)
    shuffled = near_duplicate_pairs(df, "row_id", "transliteration", "translation", most_broadcast=0)
    assert sorted(tuple(r) for r in shuffled.collect()) == sorted(got)
    report = {r.id: r for r in near_duplicate_report(df, "row_id", "transliteration", "translation").collect()}
    assert report[0].copies >= 6 and set(report) == {i for i, a, b in rows if plain_words(a) or plain_words(b)}
    assert near_duplicate_pairs(df.where("false"), "row_id", "transliteration", "translation").count() == 0


def test_overlaps(spark):
    rng = random.Random(8)
    rows = corpus(rng)
    train = with_clashes(spark.createDataFrame([(i, a, rng.choice(["s1", "s2", None])) for i, a, _ in rows], "row_id long, transliteration string, source string"))
    tests = {}
    texts = {}
    for split in ("one", "two"):
        asked = [(k, edited(rng, rng.choice([r[1] for r in rows[:40] if r[1]]), rng.randint(0, 3))) for k in range(30)] + [(90, None), (91, ""), (92, "a b"), (93, "unknown words only here")]
        texts[split] = asked
        tests[split] = (with_clashes(spark.createDataFrame(asked, "test_id long, transliteration string")), "test_id")
    found = cross_split_overlaps(train, "row_id", "transliteration", tests).persist()
    got = {(r.split, r.test_id, r.row_id): r for r in found.collect()}
    want = {(s, k, i): share(t, a) for s, asked in texts.items() for k, t in asked for i, a, _ in rows if (share(t, a) or 0) >= 0.75}
    assert set(got) == set(want) and all(abs(got[k].share - v) < 1e-9 for k, v in want.items())
    assert all(0 <= r.test_coverage <= 1 and 0 <= r.row_coverage <= 1 for r in got.values())
    report = overlap_report(found, train, "row_id", "source").collect()
    assert sum(r.overlaps for r in report) == len(want)
    assert cross_split_overlaps(train.where("false"), "row_id", "transliteration", tests).count() == 0


def test_chain():
    assert in_order([1, 2, 3, 4, 5], [1, 2, 3, 4, 5]) == 5
    assert in_order([1, 2, 3, 9, 4, 5], [1, 2, 3, 8, 4, 5]) == 5
    assert in_order([1], [1]) == 1 and in_order([1, 2], [3, 4]) == 0


def test_leaks(spark):
    rng = random.Random(9)
    items = [(k, sentence(rng, 10, 20), "akk", rng.choice(["s", "t"])) for k in range(12)] + [(50, None, "en", "s"), (51, "", "en", "s"), (52, "?!", "en", None)]
    docs, want = [], set()
    for d in range(40):
        parts = [sentence(rng, 30, 60)]
        k, text, *_ = items[rng.randrange(12)]
        words = text.split()
        how = d % 5
        if how == 0:
            parts.append(text)
            want.add((d, k))
        elif how == 1:
            parts.append(" ".join(words[: max(1, int(0.7 * len(words)))]))
            want.add((d, k))
        elif how == 2:
            words[len(words) // 2] = "changed"
            broken = " ".join(words)
            parts.append(broken[:15] + "-\n" + broken[15:40] + "-\r\n " + broken[40:] if False else broken[:15] + "-\n" + broken[15:])
            want.add((d, k))
        elif how == 3:
            rng.shuffle(words)
            parts.append("  \n".join(words))
        parts.append(sentence(rng, 5, 50))
        docs.append((d, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "word " * 30000)]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame(items, "item_id long, text string, lang string, split string")
    found = leaked_items(df, "doc_id", "text", asked, "item_id", "text").persist()
    got = {(r.doc, r.item) for r in found.collect()}
    assert got == want
    report = {r.split: r for r in leak_report(found, asked, "item_id", "split").collect()}
    assert sum(r["items"] for r in report.values()) == len(items)
    assert leaked_items(df, "doc_id", "text", asked.where("false"), "item_id", "text").count() == 0
    assert leaked_items(df.where("false"), "doc_id", "text", asked, "item_id", "text").count() == 0


def test_broken_words():
    assert terms_of("ma-\nàk₄ t-\r\nhe to -\nbecause") == ["maàk4", "the", "to", "because"]
    assert terms_of("ma-àk₄") == ["maàk4"]


def test_rolling_and_windows():
    text = "abcabcabd" * 30
    hashes = rolling(points(text), 5)
    assert len(hashes) == len(text) - 4 and hashes[0] == hashes[3] and hashes[0] == rolling(points("abcab"), 5)[0]
    values = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    places = set(window_minima(values, 20).tolist())
    masked = values & ~np.uint64(0xFFFFFFF)
    assert all(k + int(np.argmin(masked[k : k + 20])) in places for k in range(481))
    assert window_minima(values[:5], 20).tolist() == [int(np.argmin(values[:5]))] and len(window_minima(values[:0], 3)) == 0


def test_shared_spans(spark):
    rng = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyzšḫ🏺 "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (299, 300, 301, 900)]
    docs = []
    for d in range(40):
        parts = [text(rng.randint(0, 500))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts += [p, text(rng.randint(1, 200))]
        docs.append((d, "".join(parts)))
    periodic = "ab" * 400
    docs += [(50, docs[3][1]), (51, docs[3][1]), (60, None), (61, ""), (62, "short"), (63, "short"), (70, periodic + text(100)), (71, text(50) + periodic), (72, "x" * 20000), (73, "y" + "x" * 400)]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, body string"))
    spans = SharedSpans(df, "doc_id", "body")
    got = [tuple(r) for r in spans.pair_ids().collect()]
    grams = {d: {t[i : i + 300] for i in range(len(t) - 299)} for d, t in docs if t}
    want = {(a, b) for a, b in combinations(sorted(grams), 2) if grams[a] & grams[b]}
    assert len(got) == len(set(got)) and set(got) == want
    texts = dict(docs)
    cover = {r.id: r.shared_chars for r in spans.coverage().collect()}
    for d in grams:
        others = set().union(*(grams[o] for o in grams if o != d))
        marked = set()
        for i in range(len(texts[d]) - 299):
            if texts[d][i : i + 300] in others:
                marked.update(range(i, i + 300))
        assert cover.get(d, 0) == len(marked)
    assert SharedSpans(df.where("false"), "doc_id", "body").pair_ids().count() == 0


def test_maximal_stretches():
    one, two = points("xx" + "abc" * 5 + "yy"), points("z" + "abc" * 5 + "w")
    assert (2, 1, 15) in stretches(one, two, [-1], False, 10)
