"""Problem 1 where few words stand in most records: keys that do not grow hot and still lose nothing."""

import itertools
import random

import numpy as np

from kalamos.llm import overlap
from kalamos.llm.words import bags, mix


def _flat(records):
    offsets = np.cumsum([0, *map(len, records)])
    return mix(np.array([w for r in records for w in r], np.uint64)), offsets


def _tokens(records, most):
    tokens, n = np.unique(bags(*_flat(records)), return_counts=True)
    order = np.argsort(-n, kind="stable")[:most]
    return tokens[order][::-1]


def _common(a, b):
    return sum(min(a.count(w), b.count(w)) for w in set(a))


def test_short_records_of_frequent_words_meet_without_loss():
    rng = random.Random(3)
    records = [[rng.choice(range(1, 9)) if rng.random() < 0.7 else rng.randrange(100, 400) for _ in range(rng.randint(1, 9))] for _ in range(700)]
    keys, rows = overlap.fingerprints(*_flat(records), 0.75, _tokens(records, 12))
    own = [set() for _ in records]
    for k, r in zip(keys.tolist(), rows.tolist(), strict=True):
        own[r].add(k)
    alike = [(x, y) for x, y in itertools.combinations(range(len(records)), 2) if 2 * _common(records[x], records[y]) >= 0.75 * (len(records[x]) + len(records[y]))]
    assert len(alike) > 500 and all(own[x] & own[y] for x, y in alike)


def test_three_words_in_a_row_still_select_a_common_hash():
    rng = random.Random(4)
    frequent = list(range(1, 7))
    for _ in range(300):
        row = [rng.choice(frequent) if rng.random() < 0.8 else rng.randrange(100, 900) for _ in range(3)]
        fresh = iter(rng.sample(range(10_000, 90_000), 40))
        two = [[next(fresh) for _ in range(9)] + row + [next(fresh) for _ in range(9)] for _ in range(2)]
        keys, rows = overlap._neighbours(*_flat(two), 1, np.isin(_flat(two)[0], mix(np.array(frequent, np.uint64))))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_frequent_words_make_few_pairs(spark):
    rng = random.Random(5)
    records = [[1, 2, 3, *(rng.randrange(100, 100_000) for _ in range(8))] for _ in range(400)]
    plain, rows = overlap.fingerprints(*_flat(records), 0.75, _tokens(records, 3))
    assert np.bincount(np.unique(plain, return_inverse=True)[1]).max() < 40
    table = overlap.sequence_table(spark.createDataFrame([(k, " ".join(f"w{w}" for w in r)) for k, r in enumerate(records)], "id long, text string"), "id", "text")
    assert len(overlap.frequent_tokens(table, 100, 2)) == 2 and len(overlap.frequent_tokens(table, 100)) == 3
