"""Problems 3, 6 and 7."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from kalamos.llm.encode import VOCABULARY, Encoder, encode_table
from kalamos.llm.groups import allocate, assign_splits, components, differencing, tablet_groups, tablet_id
from kalamos.llm.sentences import align_documents, assign, source_words
from tests.llm.test_forms import with_clashes


def hexes(rng):
    return "".join(rng.choice("0123456789abcdef") for _ in range(32))


def dashed(h):
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def written(rng, h):
    return rng.choice([dashed(h), dashed(h).upper(), f" {h.upper()}", "{" + dashed(h) + "}", f"urn:uuid:{dashed(h)}", f"\t{dashed(h)} ", h])


def test_tablet_ids(spark):
    rng = random.Random(1)
    h = hexes(rng)
    forms = [dashed(h), h, h.upper(), " " + h, "\t" + dashed(h).upper(), "{" + dashed(h) + "}", "urn:uuid:" + dashed(h), "id_" + h, ":".join(h[i : i + 2] for i in range(0, 32, 2))]
    got = spark.createDataFrame([(f,) for f in [*forms, "P 123", "", "  ", None, h[:31]]], "x string").select(tablet_id("x").alias("y")).collect()
    assert [r.y for r in got] == [dashed(h)] * len(forms) + ["P 123", None, None, None, h[:31]]


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 60
    if shape == "random":
        edges = [(f"n{rng.randrange(n):03}", f"n{rng.randrange(n):03}") for _ in range(40)]
    elif shape == "chain":
        order = list(range(n))
        rng.shuffle(order)
        edges = [(f"n{a:03}", f"n{b:03}") for a, b in zip(order, order[1:], strict=False)]
    else:
        edges = [("n059", f"n{k:03}") for k in range(59)]
    got = components(spark.createDataFrame([*edges, ("n000", None), (None, None)], "l string, r string"), "l", "r").collect()
    want = {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}
    assert {r.id: r.group for r in got} == want


def test_groups_and_splits(spark):
    rng = random.Random(5)
    tablets = [hexes(rng) for _ in range(60)]
    rows = [(i, written(rng, tablets[0] if rng.random() < 0.1 else rng.choice(tablets)) if rng.random() > 0.05 else rng.choice([None, "", " "])) for i in range(1500)]
    pairs = [(i, written(rng, rng.choice(tablets[:20]))) for i in range(500)]
    ties = [(written(rng, tablets[i]), written(rng, tablets[i + 1]), "join") for i in range(0, 12, 2)] + [(dashed(tablets[3]), dashed(tablets[5]), None), (dashed(tablets[5]), dashed(tablets[5]), "x"), (dashed(hexes(rng)), None, "x")]
    joins = spark.createDataFrame(ties, "left_id string, right_id string, relation string")
    one = with_clashes(spark.createDataFrame(rows, "row_id long, oare_id string"))
    two = spark.createDataFrame(pairs, "pair_id long, doc_id string")
    bare = lambda x: "".join(c for c in (x or "").lower().replace("urn:uuid:", "") if c in "0123456789abcdef")
    root = roots([(dashed(bare(a)), dashed(bare(b))) for a, b, _ in ties if a and b])
    groups = {r.id_written: r.group for r in tablet_groups(one, "oare_id", joins, "left_id", "right_id").collect()}
    assert groups == {w: root.get(dashed(bare(w)), dashed(bare(w))) for _, w in rows if w and w.strip()}
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    out = assign_splits({"c": (one, "row_id", "oare_id"), "s": (two, "pair_id", "doc_id")}, joins, "left_id", "right_id", targets, "split", "share").collect()
    assert len(out) == 2000 and len({(r.table, r.key) for r in out}) == 2000
    ids = {("c", i): w for i, w in rows} | {("s", i): w for i, w in pairs}
    seen = {}
    for r in out:
        w = ids[r.table, r.key]
        if w and w.strip():
            d = dashed(bare(w))
            seen.setdefault(root.get(d, d), set()).add(r.split)
    assert all(len(s) == 1 for s in seen.values())
    parts = Counter(r.split for r in out)
    assert abs(parts["train"] / 2000 - 0.8) < 0.05 and abs(parts["test"] / 2000 - 0.1) < 0.05
    empty = assign_splits({"c": (one.where("false"), "row_id", "oare_id")}, joins.where("false"), "left_id", "right_id", targets, "split", "share")
    assert empty.count() == 0


def test_differencing_balances():
    rng = random.Random(0)
    weights = [rng.randint(1, 100) for _ in range(200)]
    parts = [(np.array([w, 0, 0, 0]), [[k], [], [], []]) for k, w in enumerate(weights)]
    sums, held = differencing(parts, 4)
    assert sorted(k for h in held for k in h) == list(range(200)) and sums.sum() == sum(weights)
    assert all(sums[b] == sum(weights[k] for k in held[b]) for b in range(4)) and sums.max() - sums.min() <= 3
    assert allocate(np.array([50, 10, 10, 10, 10, 10]), [("a", 0.5), ("b", 0.5)]).count("a") in (1, 5)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = random.Random(6)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        score = [[rng.random() if rng.random() < 0.8 else -np.inf for _ in range(m)] for _ in range(n)]
        got = assign(np.array(score) - 0.4).tolist()
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used))
        worth = sum(score[i][j] if j >= 0 else 0.4 for i, j in enumerate(got))
        best = 0.0
        for choice in permutations([*range(m), *[-1] * n], n):
            best = max(best, sum(score[i][j] if j >= 0 else 0.4 for i, j in enumerate(choice)))
        assert abs(worth - best) < 1e-9
    assert len(assign(np.zeros((0, 3)))) == 0 and assign(np.zeros((2, 0))).tolist() == [-1, -1]


def test_alignment_of_planted_documents(spark):
    rng = random.Random(11)
    lexicon = {f"wo-{a}{b}": f"meaning{a}{b}" for a in "abcdefgh" for b in "klmnpq"}
    rows, truth, pair_id = [], set(), 0
    for d in range(60):
        n = rng.randint(4, 9)
        sources = [[rng.choice(list(lexicon)) for _ in range(6)] + [str(rng.randint(100, 999))] for _ in range(n)]
        targets, at = [], 0
        while at < n:
            how = rng.random()
            said = [" ".join([lexicon[w] if w in lexicon else w for w in sources[at]])]
            if how < 0.12:
                pass  # left out
            elif how < 0.24 and at + 1 < n:
                said = [said[0] + " " + " ".join(lexicon.get(w, w) for w in sources[at + 1])]
                truth |= {(f"d{d}", at, len(targets)), (f"d{d}", at + 1, len(targets))}
                targets += said
                at += 1
            else:
                truth.add((f"d{d}", at, len(targets)))
                targets += said
            at += 1
        for k in range(max(n, len(targets))):
            row = (pair_id, " ".join(sources[k]) if k < n else None, targets[k] if k < len(targets) else None, f"d{d}", k, None)
            rows.append(row)
            if rng.random() < 0.1:
                pair_id += 1
                rows.append((pair_id, *row[1:]))
            pair_id += 1
    rows += [(9000, "a b", "c d", None, 0, True), (9001, "a b", "c d", "dx", None, False), (9002, None, None, "dy", 0, None), (9003, "", "?!", "dz", 0, None)]
    df = with_clashes(spark.createDataFrame(rows, "pair_id long, transliteration string, translation string, doc_id string, sentence_idx int, anchor_valid boolean"))
    got = [(r.doc, r.src, r.tgt) for r in align_documents(df, "doc_id", "sentence_idx", "transliteration", "translation").collect()]
    assert len(got) == len(set(got))
    right = len(set(got) & truth)
    assert right / len(got) > 0.95 and right / len(truth) > 0.95
    assert align_documents(df.where("false"), "doc_id", "sentence_idx", "transliteration", "translation").count() == 0


@pytest.mark.parametrize("order", ["in step", "reversed", "shifted", "shuffled"])
def test_long_document_in_any_order(spark, order):
    n = 300
    place = {"in step": lambda k: k, "reversed": lambda k: n - 1 - k, "shifted": lambda k: (k + 100) % n}.get(order)
    places = [place(k) for k in range(n)] if place else random.Random(1).sample(range(n), n)
    rows = [(f"be-la o-th{'abcdefg'[k % 7]} {k}", None, "d", k) for k in range(n)] + [(None, f"lord other{k % 7} {k}", "d", places[k]) for k in range(n)]
    df = spark.createDataFrame(rows, "s string, t string, doc string, idx int")
    got = [(r.src, r.tgt) for r in align_documents(df, "doc", "idx", "s", "t").collect()]
    assert sorted(got) == [(k, places[k]) for k in range(n)]


def test_merged_spans_of_three(spark):
    rng = random.Random(3)
    lexicon = {f"wo{a}{b}": f"meaning{a}{b}" for a in "abcdefgh" for b in "klmnpq"}
    rows, truth = [], set()
    for d in range(80):
        sources = [[rng.choice(list(lexicon)) for _ in range(6)] for _ in range(9)]
        said = [[lexicon[w] for w in s] for s in sources]
        how = d % 4
        at = rng.randrange(7)
        if how == 0:  # three sources in one target
            said[at : at + 3] = [sum(said[at : at + 3], [])]
            truth |= {(f"d{d}", k, k if k < at else max(at, k - 2)) for k in range(9)}
        elif how == 1:  # one source in three targets
            sources[at : at + 3] = [sum(sources[at : at + 3], [])]
            truth |= {(f"d{d}", k if k < at else max(at, k - 2), k) for k in range(9)}
        else:
            truth |= {(f"d{d}", k, k) for k in range(9)}
        rows += [(f"d{d}", k, " ".join(s), None) for k, s in enumerate(sources)] + [(f"d{d}", k, None, " ".join(t)) for k, t in enumerate(said)]
    df = spark.createDataFrame(rows, "doc string, idx int, s string, t string")
    got = {(r.doc, r.src, r.tgt) for r in align_documents(df, "doc", "idx", "s", "t").collect()}
    assert len(got & truth) > 0.95 * len(truth) and len(got & truth) > 0.95 * len(got), (len(got), len(truth), len(got & truth))


def test_source_words():
    assert source_words("{d}ruḫ-šeṭ-wé-aš ma-àk₄ 3.25 GE.NA [x]! (m)a-na") == ["ruḫšeṭwéaš", "maàk", "3.25", "gena", "x", "ana"]


needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@needs_vocabulary
def test_encoding_equals_the_reference_tokenizer(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(VOCABULARY)
    public.encode_special_tokens = True
    rng = random.Random(12)
    pieces = ["a", "b", " ", "  ", "\n", "\r\n", "\t", "'s", "'ll", "é", "é", "\u0085", " ", "　", "\x1c", "\x00", "界", "🏺", "‍", "123", "ⅷ", "<|endoftext|>", "zzzzzz", "the", "ing", "---", "ḫ", "₄"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["a" * 5000, "ab" * 4000, " " * 3000, "word " * 20000, "", None]
    df = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.id: r.ids for r in encode_table(df, "doc_id", "text").collect()}
    assert all(got[i] == (public.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(texts))
    encoder = Encoder.of(VOCABULARY)
    assert all(encoder.decode(got[i]) == t for i, t in enumerate(texts) if t)
    assert encode_table(df.where("false"), "doc_id", "text").count() == 0


@needs_vocabulary
def test_compatibility_by_merging(spark):
    """Two tokens are compatible exactly if merging their bytes step by step leaves them."""
    encoder = Encoder.of(VOCABULARY)

    def merge(text):
        parts = [encoder.number[c] for c in text]
        while True:
            found = [(encoder.rank[encoder.merged[p]], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in encoder.merged]
            if not found:
                return parts
            _, k = min(found)
            parts[k : k + 2] = [encoder.merged[parts[k], parts[k + 1]]]

    rng = random.Random(13)
    tokens = rng.sample(sorted(encoder.text), 400)
    tokens = [t for t in tokens if merge(encoder.text[t]) == [t]]
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert encoder._compatible(a, b) == (merge(encoder.text[a] + encoder.text[b]) == [a, b])
