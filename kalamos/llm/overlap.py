"""Problem 1: records of evaluation splits that stand, exactly or almost, in the training split.

Winnowing fingerprints.  A record's plain words give two sequences: the words
as they stand, and their canonical order (by hash, a repeated word told apart
by its number), in which the order of the text plays no part.  Of either
sequence the rolling hashes of 2 neighbours are winnowed, keeping the minimum of
every window of 2, so that any 3 words in common in a row select a common hash.
Records of up to 12 words are settled without loss instead, by prefix keys: of
the words in canonical order, the first among which two must be common with any
record of enough common share give a key a pair; longer records give these keys
as far as they can match a short one.

Words of many training records (a list of fixed size) would make hot keys.  The
canonical order of the prefixes puts them last, and where all words of a pair are
frequent the key takes a third word that must be common as well; a winnowed hash of
two frequent neighbours is replaced by the two of three neighbours around it, so
any 3 words in common in a row still select a common hash.

Splits are joined on the selected minima; the training side shuffles only keys
that may stand in a test split (a filter of fixed size), and the parity sketch
carried along rejects hopeless pairs inside the join without loss.  For each
candidate the seeds are chained and extended by alignment.  In the canonical
order all seeds are collinear and the best alignment across the gaps is a merge
of the two sequences; its aligned words give the share that decides, and the
coverage of either record.  For records found, the seeds of the text's own order
are chained as well and extended word by word: ``in_order`` is the part of the
test record that stands in one line in the training record.

Copies in the training split are one class (equal word sequences) until the
last join.  Records without words (null, empty, signs only) match nothing.
Ids play no part in the comparison.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalamos.llm.keyfilter import key_filter, may_meet
from kalamos.llm.words import WordHashes, bags, mix, prefix_keys, row_of, sequence_signatures, sketch_condition, sketches
from kalamos.llm.work import written

SHARE = 0.75
SHORT = 12
FREQUENT, MOST_FREQUENT = 500, 256  # training records from which a word is frequent, words listed at most
_U = np.uint64
FOUND = "split string, test_id long, sig long, share double, test_coverage double, row_coverage double, in_order double"


def _grams(flat: np.ndarray, offsets: np.ndarray, k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of k neighbours and their rows."""
    if len(flat) < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    rows = row_of(offsets)
    n = len(flat) - k + 1
    rolled = np.full(n, salt, _U)
    for i in range(k):
        rolled = mix(rolled * _U(31) + flat[i : i + n])
    inside = rows[:n] == rows[k - 1 :]
    return rolled[inside], rows[:n][inside]


def _selected(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the minimum of each window of two neighbours is; all where the record has one hash only."""
    keep = np.zeros(len(values), bool)
    if not len(values):
        return keep
    pair = rows[:-1] == rows[1:]
    less = values[:-1] <= values[1:]
    keep[:-1] |= pair & less
    keep[1:] |= pair & ~less
    lone = np.ones(len(values), bool)
    lone[:-1] &= ~pair
    lone[1:] &= ~pair
    return keep | lone


def _winnow(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = _selected(values, rows)
    return values[keep], rows[keep]


def _neighbours(words: np.ndarray, offsets: np.ndarray, salt: int, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of 2 neighbours and their rows; of 3, with either neighbour of the two, where both are frequent."""
    values, rows = _grams(words, offsets, 2, salt)
    keep = _selected(values, rows)
    if not often.any():
        return values[keep], rows[keep]
    all_rows = row_of(offsets)
    place = np.flatnonzero(all_rows[:-1] == all_rows[1:])  # of the first word of each hash
    hot = often[place] & often[place + 1] & (np.diff(offsets)[rows] > 2)
    wide, wide_rows = _grams(words, offsets, 3, salt + 16)
    at = np.full(len(words) + 1, -1)
    at[np.flatnonzero(all_rows[:-2] == all_rows[2:])] = np.arange(len(wide))
    first = place[keep & hot]
    around = np.concatenate([at[first], np.where(first > 0, at[first - 1], -1)])
    around = np.unique(around[around >= 0])
    return np.concatenate([values[keep & ~hot], wide[around]]), np.concatenate([rows[keep & ~hot], wide_rows[around]])


def rare_first(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Numbers that stand for the tokens and put those of the list (least frequent first) behind all others."""
    if not len(frequent):
        return tokens >> _U(1)
    order = np.argsort(frequent)
    at = np.minimum(np.searchsorted(frequent[order], tokens), len(frequent) - 1)
    return np.where(frequent[order][at] == tokens, (_U(1) << _U(63)) + order[at].astype(_U), tokens >> _U(1))


def short_keys(tokens: np.ndarray, offsets: np.ndarray, share: float, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix keys (see :func:`prefix_keys`) of numbers by :func:`rare_first`.  Behind a frequent word all are frequent:
    a key that begins with one holds three words, of a prefix one longer, wherever three must be common.  Bags for which
    two can be enough give keys of both kinds."""
    values, owners = prefix_keys(tokens, offsets, share, longest)
    sizes, rows = np.diff(offsets), row_of(offsets)
    tokens = tokens[np.lexsort((tokens, rows))]
    hot = tokens >> _U(63) > 0
    some = np.bincount(rows[hot], minlength=len(sizes)) > 1
    if not some.any():
        return values, owners
    keep = ~some[owners]
    all_values, all_owners = [values[keep]], [owners[keep]]
    most = math.floor(longest * (2 - share) / share + 1e-9)
    for n in np.unique(sizes[some & (sizes <= most)]).tolist():
        own = np.flatnonzero(some & (sizes == n))
        common = max(1, math.ceil(share * n / (2 - share) - 1e-9))
        two, three = min(n, n - common + 2), min(n, n - common + 3)
        i, j = np.triu_indices(two, 1)
        a, b, c = np.array([(x, y, z) for x, y in zip(i.tolist(), j.tolist(), strict=True) for z in range(y + 1, three)], np.int64).reshape(-1, 3).T
        step = max(1, 4_000_000 // max(1, len(a) + len(i)))
        for start in range(0, len(own), step):
            part = own[start : start + step]
            place = offsets[part][:, None] + np.arange(n)[None, :]
            words, often = tokens[place], hot[place]
            pair = lambda x, y, w=words: mix(w[:, x] * _U(31) + mix(w[:, y] + _U(11)))
            found = [(pair(i, j), ~often[:, i] | (common < 3)), (mix(pair(a, b) * _U(31) + mix(words[:, c] + _U(13))), often[:, a])]
            if common == 1:
                found.append((mix(words + _U(7)), np.ones(words.shape, bool)))
            for keys, take in found:
                all_values.append(keys[take])
                all_owners.append(part[np.nonzero(take)[0]])
    return np.concatenate(all_values), np.concatenate(all_owners)


def canonical(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The words of each record as a set of (word, how-manyth), in the order of their hashes."""
    tokens = bags(flat, offsets)
    return tokens[np.lexsort((tokens, row_of(offsets)))]


NONE = np.zeros(0, _U)


def fingerprints(flat: np.ndarray, offsets: np.ndarray, share: float = SHARE, frequent: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes (48 bits) and their rows; ``frequent`` lists tokens, least frequent first."""
    sizes = np.diff(offsets)
    tokens = canonical(flat, offsets)
    listed = np.sort(frequent)
    often = lambda x: listed[np.minimum(np.searchsorted(listed, x), len(listed) - 1)] == x if len(listed) else np.zeros(len(x), bool)
    grams = [_neighbours(words, offsets, salt, often(names)) for salt, words, names in ((1, flat, mix(flat)), (2, tokens, tokens))]
    grams = [(v[sizes[r] > SHORT], r[sizes[r] > SHORT]) for v, r in grams]
    grams.append(short_keys(rare_first(tokens, frequent), offsets, share, SHORT))
    return (np.concatenate([v for v, _ in grams]) >> _U(16)).view(np.int64), np.concatenate([r for _, r in grams])


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            token, n = np.unique(bags(*_flat(batch.column("words"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])


def frequent_tokens(corpus: DataFrame, least: int | None = None, most: int | None = None) -> np.ndarray:
    """The tokens of at least so many records, at most so many of them; the least frequent come first."""
    counts = corpus.select("words").mapInArrow(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= (FREQUENT if least is None else least)).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT if most is None else most)
    return np.array([r.token for r in counts.collect()][::-1], np.int64).view(_U)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, offsets = words.batch(batch.column(1).to_pylist())
        kept = pa.array((flat & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sequence_signatures(flat, offsets).view(np.int64)), pa.array(sketches(bags(flat, offsets), offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), kept)],
            names=["id", "sig", "sketch", "words"],
        )


def sequence_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, sig, sketch, words`` of the records that hold words."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    return rows.mapInArrow(_sequences, "id long, sig long, sketch long, words array<int>").where("size(words) > 0")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return mix(lists.values.to_numpy().view(np.uint32).astype(_U))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _keys(share: float, frequent: np.ndarray, asked=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, rows = fingerprints(*_flat(batch.column("words")), share, frequent)
            if asked is not None:
                some = may_meet(asked.value, values)
                values, rows = values[some], rows[some]
            # one key once per record
            order = np.lexsort((values, rows))
            values, rows = values[order], rows[order]
            fresh = np.ones(len(values), bool)
            fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
            values, rows = values[fresh], rows[fresh]
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(batch.column("sig").to_numpy()[rows]), pa.array(batch.column("sketch").to_numpy()[rows])], names=["key", "sig", "sketch"])

    return run


def aligned(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each pair of records (flat words and offsets of either side), the words aligned in the canonical order.

    Both sequences are sorted and hold every token once, so the chain of all seeds, extended over the gaps, is the
    merge of the two: a token is aligned if it stands on both sides."""
    rows = np.concatenate([row_of(one[1]), row_of(other[1])])
    tokens = np.concatenate([canonical(*one), canonical(*other)])
    order = np.lexsort((tokens, rows))
    tokens, rows = tokens[order], rows[order]
    twice = (tokens[1:] == tokens[:-1]) & (rows[1:] == rows[:-1])
    return np.bincount(rows[1:][twice], minlength=len(one[1]) - 1)


def in_order(one: list[int], other: list[int]) -> int:
    """Words of ``one`` that a chain of seeds in the order of the texts covers, extended word by word both ways."""
    if len(one) == 1 or len(other) == 1:
        return int(bool(set(one) & set(other)))
    at: dict[tuple[int, int], list[int]] = {}
    for j in range(len(other) - 1):
        at.setdefault((other[j], other[j + 1]), []).append(j)
    seeds = [(i, j) for i in range(len(one) - 1) for j in reversed(at.get((one[i], one[i + 1]), ()))]
    # longest chain with both places rising
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(seeds):
        p = bisect_left(ends, j)
        ends[p : p + 1] = [j]
        last[p : p + 1] = [k]
        before.append(last[p - 1] if p else -1)
    line = []
    k = last[-1] if last else -1
    while k >= 0:
        line.append(seeds[k])
        k = before[k]
    line.reverse()
    covered: set[int] = set()
    for i, j in line:
        for x, y, step in ((i, j, 1), (i, j, -1)):
            while 0 <= x < len(one) and 0 <= y < len(other) and one[x] == other[y] and (step == 1 or x == i or x not in covered):
                covered.add(x)
                x, y = x + step, y + step
    return len(covered)


def _compare(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = _flat(batch.column("own")), _flat(batch.column("words"))
            n, m = np.diff(one[1]), np.diff(other[1])
            common = aligned(one, other)
            some = np.flatnonzero(2 * common >= share * (n + m) - 1e-9)
            kept = batch.take(pa.array(some))
            line = [in_order(a, b) for a, b in zip(kept.column("own").to_pylist(), kept.column("words").to_pylist(), strict=True)]
            common, n, m = common[some], n[some], m[some]
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(k) for k in range(3)), *map(pa.array, (2 * common / (n + m), common / n, common / m, np.array(line, float) / n))],
                names=["split", "test_id", "sig", "share", "test_coverage", "row_coverage", "in_order"],
            )

    return run


def cross_split_overlaps(train: DataFrame, id_col: str, text_col: str, tests: dict[str, tuple[DataFrame, str]], share: float = SHARE) -> DataFrame:
    """``split, test_id, row_id, share, test_coverage, row_coverage, in_order`` of every overlap.

    ``tests`` names each split with its table and id column; the text column is the same everywhere.
    """
    corpus = written(sequence_table(train, id_col, text_col), "corpus")
    sides = [sequence_table(df, column, text_col).withColumn("split", F.lit(name)) for name, (df, column) in tests.items()]
    asked = sides[0]
    for side in sides[1:]:
        asked = asked.unionAll(side)
    asked = written(asked, "tests")
    classes = corpus.select("sig", "sketch", "words").dropDuplicates(["sig"])
    asked_classes = asked.select("sig", "sketch", "words").dropDuplicates(["sig"])
    keys = "key long, sig long, sketch long"
    frequent = frequent_tokens(corpus)
    wanted = written(asked_classes.mapInArrow(_keys(share, frequent), keys), "test-keys")
    x, y = wanted.alias("x"), classes.mapInArrow(_keys(share, frequent, key_filter(wanted)), keys).alias("y")
    met = x.join(y, F.expr(f"x.key = y.key and {sketch_condition('x.sketch', 'y.sketch', share)}"))
    met = met.select(F.col("x.sig").alias("asked"), F.col("y.sig").alias("sig")).distinct()
    pairs = met.join(classes.select("sig", "words"), "sig").join(asked.select(F.col("sig").alias("asked"), "split", "id", F.col("words").alias("own")), "asked")
    found = pairs.select("split", "id", "sig", "own", "words").mapInArrow(_compare(share), FOUND)
    rows = corpus.select("sig", F.col("id").alias("row_id"))
    return found.join(rows, "sig").select("split", "test_id", "row_id", "share", "test_coverage", "row_coverage", "in_order")


def overlap_report(overlaps: DataFrame, train: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """``split, source, test_records, train_records, overlaps, exact, mean_coverage`` per split and source of the
    training rows; a null source is a source of its own."""
    source = train.select(F.col(id_col).cast("long").alias("row_id"), F.col(source_col).alias("source"))
    return (
        overlaps.join(source, "row_id")
        .groupBy("split", "source")
        .agg(
            F.countDistinct("test_id").alias("test_records"),
            F.countDistinct("row_id").alias("train_records"),
            F.count(F.lit(1)).alias("overlaps"),
            F.count_if(F.col("share") >= 1 - 1e-9).alias("exact"),
            F.round(F.avg("test_coverage"), 6).alias("mean_coverage"),
        )
    )
