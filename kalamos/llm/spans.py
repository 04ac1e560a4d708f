"""Problem 9: long stretches that stand verbatim in more than one record.

Seed and extend.  Rolling hashes of ``gram`` characters are winnowed: the
minimum of every window is an anchor, and ``window + gram - 1 = least`` means
that every stretch of ``least`` characters holds the same anchor wherever it
stands.  Documents are joined on anchors, the anchors of a pair name the
diagonals on which the two texts may agree, and each diagonal is extended both
ways, character by character, to its maximal stretches; those of at least
``least`` characters are kept.  Where an anchor stands more than once in a
document only its first place is joined; if the pair is then still open it is
settled exactly by its rolling hashes of ``least`` characters.

Scale: anchors are fixed-width and thin (about 2 per ``window`` characters);
copies of one text are one class, so a third of all rows with one text costs
one text; texts travel only once per class and once per candidate pair.

Characters are code points as they stand.  Null, empty and shorter texts share
nothing.  A text repeated within itself is not shared; two rows with the same
text of enough length are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kalamos.llm.words import mix
from kalamos.llm.work import written

LEAST, GRAM = 300, 200
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(chars: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k neighbouring characters, modulo 2**64."""
    n = len(chars)
    if n < k:
        return np.zeros(0, _U)
    up, down = _powers(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum(mix(chars.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the (first) minimum of every window, each once; of all values if there are fewer."""
    n = len(values)
    if n <= window:
        return np.array([int(np.argmin(values))]) if n else np.zeros(0, np.int64)
    # hash above, place below: one comparison orders both
    packed = (values & ~_U(0xFFFFFFF)) | np.arange(n, dtype=_U)
    blocks = -(-n // window)
    padded = np.full(blocks * window, _U(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    return np.unique((least[fresh] & _U(0xFFFFFFF)).astype(np.int64))


def anchors(text: str, gram: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes, the first place of each, and whether it stands again."""
    values = rolling(points(text), gram)
    places = window_minima(values, least - gram + 1)
    hashes, first, count = np.unique(values[places], return_index=True, return_counts=True)
    return hashes.view(np.int64), places[first].astype(np.int32), count > 1


def _anchor_rows(gram: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text) >= least:
                    one = anchors(text, gram, least)
                    found.append(one)
                    owner.append(np.full(len(one[0]), doc, np.int64))
            if not found:
                continue
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(np.concatenate(owner)), pa.array(columns[1]), pa.array(columns[2])], names=["hash", "doc", "place", "again"])

    return run


def _runs(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true, of at least ``least``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


def stretches(one: np.ndarray, two: np.ndarray, diagonals: list[int], again: bool, least: int) -> list[tuple[int, int, int]]:
    """``(start in one, start in two, length)`` of maximal common stretches on the diagonals; if an anchor stands
    more than once, of every maximal stretch, found by the hashes of ``least`` characters."""
    if again:
        a, b = rolling(one, least), rolling(two, least)
        order = np.argsort(b, kind="stable")
        lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
        hits = np.flatnonzero(hi > lo)
        # the first equal place in the other text is enough to cover every shared character of this one
        diagonals = sorted({*diagonals, *(int(order[lo[i]]) - int(i) for i in hits)})
    out = []
    for d in diagonals:
        start = max(0, -d)
        size = min(len(one) - start, len(two) - start - d)
        if size >= least:
            same = one[start : start + size] == two[start + d : start + d + size]
            out += [(start + a, start + d + a, b - a) for a, b in _runs(same, least)]
    return out


def _extend(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for one, two, diagonals, again, text, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = points(text), points(other)
                found = stretches(a, b, diagonals, False, least)
                if again:
                    # from either side, so that every shared character of both is covered
                    found = sorted({*stretches(a, b, diagonals, True, least), *((y, x, n) for x, y, n in stretches(b, a, [], True, least))})
                out += [(one, two, *f) for f in found]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["one", "two", "start_one", "start_two", "size"])

    return run


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = b"".join(xxhash.xxh3_64_digest(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(digests, np.int64))], names=["id", "sig"])


class SharedSpans:
    """All shared stretches of one table of documents."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, least: int = LEAST, gram: int = GRAM) -> None:
        self.least = least
        docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= least)
        signed = docs.mapInArrow(_sign, "id long, sig long")
        first = signed.groupBy("sig").agg(F.min("id").alias("doc"))
        #: id, doc: every long enough row and the first row with the same text
        self.members = written(signed.join(first, "sig").select("id", "doc"), "members")
        lone = self.members.where("id = doc").select("doc")
        self.texts = written(docs.withColumnRenamed("id", "doc").join(lone, "doc"), "texts")
        marks = written(self.texts.select("doc", "text").mapInArrow(_anchor_rows(gram, least), "hash long, doc long, place int, again boolean"), "anchors")
        x, y = marks.alias("x"), marks.alias("y")
        met = x.join(y, F.expr("x.hash = y.hash and x.doc < y.doc"))
        met = met.select(F.col("x.doc").alias("one"), F.col("y.doc").alias("two"), F.expr("y.place - x.place").alias("diagonal"), F.expr("x.again or y.again").alias("again"))
        self.pairs = met.groupBy("one", "two").agg(F.collect_set("diagonal").alias("diagonals"), F.max("again").alias("again"))

    def stretches(self) -> DataFrame:
        """``one, two, start_one, start_two, size``: maximal stretches between two different texts."""
        one = self.texts.select(F.col("doc").alias("one"), F.col("text").alias("text_one"))
        two = self.texts.select(F.col("doc").alias("two"), F.col("text").alias("text_two"))
        both = self.pairs.join(one, "one").join(two, "two").select("one", "two", "diagonals", "again", "text_one", "text_two")
        return both.mapInArrow(_extend(self.least), "one long, two long, start_one int, start_two int, size int")

    def pair_ids(self) -> DataFrame:
        """``id_a < id_b`` of every two rows that share a stretch, rows with the same text included."""
        links = self.stretches().select("one", "two").distinct()
        rows = self.members
        same = rows.alias("x").join(rows.alias("y"), F.expr("x.doc = y.doc and x.id < y.id")).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
        other = links.join(rows.toDF("id_1", "one"), "one").join(rows.toDF("id_2", "two"), "two")
        return same.unionAll(other.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")))

    def coverage(self) -> DataFrame:
        """``id, shared_chars, shared_share, stretches`` per row: characters that stand in another row, counted once;
        a row whose whole text stands in another is shared as a whole.  Rows that share nothing are left out."""
        found = self.stretches()
        ends = found.select(F.col("one").alias("doc"), F.col("start_one").alias("start"), "size").unionAll(found.select(F.col("two").alias("doc"), F.col("start_two").alias("start"), "size"))
        ends = ends.select("doc", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
        before = F.max("end").over(Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
        covered = ends.select("doc", fresh.alias("fresh")).groupBy("doc").agg(F.sum("fresh").alias("shared_chars"), F.count(F.lit(1)).alias("stretches"))
        copies = self.members.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"))
        sizes = self.texts.select("doc", F.length("text").cast("long").alias("chars"))
        per = copies.join(sizes, "doc").join(covered, "doc", "left")
        shared = F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.coalesce("shared_chars", F.lit(0)))
        per = per.select("doc", "chars", shared.alias("shared_chars"), F.coalesce("stretches", F.lit(0)).alias("stretches")).where("shared_chars > 0")
        return self.members.join(per, "doc").select("id", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 6).alias("shared_share"), "stretches")
