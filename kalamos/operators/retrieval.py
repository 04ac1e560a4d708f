"""Nearest neighbours under TF-IDF over character n-grams.

Weights are raw counts times ln((1+N)/(1+df))+1, rows have length one, the
score is the dot product.  Bank texts, query texts and document frequencies are
written to the shared folder; every task takes one bucket of the bank and one
slice of the queries and reads what it needs from there, so the driver holds no
rows, no n-grams and no blocks, no n-gram is hot, and a task returns one row per
query.  Queries are stored with their n-grams, as places among the frequencies, so
they are split once; the first buckets are searched first, and what they found is
what the rows of all others must reach.

A task scores term at a time over the posting lists of the rarer n-grams.  The
``HOT`` most frequent ones are not walked: the product of their weights is at most
the sum, over groups of them, of the products of both rows' lengths within the
group.  Only bank rows whose walked score and this bound reach the best score
known are scored exactly, so nothing is lost.

Ties go to the smallest id after rounding to 12 digits.  A query without a
common n-gram takes the smallest id of the bank, score 0.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalamos.functions import text as T
from kalamos.session import new_folder

_U = np.uint64
QUERIES, ROWS, HOT = 65_536, 8_192, 3072  # queries of a slice, bank rows of a bucket, n-grams bounded instead of walked
ENTRIES, AT_ONCE = 2_500_000, 256  # n-grams of bank rows held at once, queries bounded at once
FILLED = 0.94  # share of ENTRIES in a mean bucket, as buckets differ
GROUPS = 512  # of the hot ones, by frequency: n-grams that always come together are neighbours
MOST_GRAMS = 16_000_000  # entries of two numbers
FIRST, FEW = 24, 96  # rows of a bucket scored first, for what the others must reach; so few need no first ones
SLACK = 1e-5  # bounds are 32-bit numbers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _profiles(texts: list[str | None], least: int, most: int, by_word: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, gram, count`` of many texts, in the order of both; a word shorter than ``least`` counts once as a whole."""
    pieces = [f" {w} " for t in texts for w in (t or "").split()] if by_word else [t or "" for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len((t or "").split()) for t in texts]) if by_word else np.arange(len(texts))
    size = np.array([len(p) for p in pieces], np.int64)
    flat = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    piece = np.repeat(np.arange(len(pieces)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # code points to the end of the piece
    hashes, rows = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for n in range(1 if by_word else least, most + 1):
        start = np.flatnonzero(left >= n) if n >= least else np.flatnonzero((left == n) & (size[piece] == n))
        rolled = np.full(len(start), n, _U)
        for k in range(n):
            rolled = _mix(rolled * _U(0x9E3779B97F4A7C15) + flat[start + k])
        hashes.append(rolled)
        rows.append(owner[piece[start]])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    row, gram = row[order], np.concatenate(hashes)[order].view(np.int64)
    edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        gram[a:b].sort()
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], gram[at], np.diff(np.append(at, len(gram)))


def _gram_rows(least: int, most: int, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                row, gram, tf = _profiles(part.column(1).to_pylist(), least, most, by_word)
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy(zero_copy_only=False)[row]), pa.array(gram), pa.array(tf.astype(np.int32))], names=["id", "gram", "tf"])

    return run


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text``: runs of white space count as one blank."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(text_col), f"{T.WS}{{2,}}", " ").alias("text"))


def grams(df: DataFrame, id_col: str, text_col: str, least: int = 3, most: int = 5, analyzer: str = "char") -> DataFrame:
    """``id, gram, tf``: counts per row without a shuffle; n-grams are told apart by 64-bit hashes.  Runs of white
    space count as one blank."""
    return _texts(df, id_col, text_col).mapInArrow(_gram_rows(least, most, analyzer == "char_wb"), "id long, gram long, tf int")


def _counted(least: int, most: int, by_word: bool):
    """``gram, df``, already summed over a few millions of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counts() -> pa.RecordBatch:
            gram, df = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(df)], names=["gram", "df"])

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                held.append(_profiles(batch.column(1).slice(start, 500).to_pylist(), least, most, by_word)[1])
                if sum(map(len, held)) >= ENTRIES:
                    yield counts()
                    held = []
        yield counts()

    return run


def inverse_frequency(frequency: DataFrame, rows: int) -> DataFrame:
    return frequency.select("gram", (F.log((1.0 + rows) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weighted(profile: DataFrame, idf: DataFrame) -> DataFrame:
    """``id, gram, w, idf``: rows of length one; n-grams the bank does not know are dropped before."""
    raw = profile.join(idf, "gram").select("id", "gram", (F.col("tf") * F.col("idf")).alias("raw"), "idf")
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, "id").select("id", "gram", (F.col("raw") / F.col("norm")).alias("w"), "idf")


def _files(folder: str):
    """A written table as a dataset, in the order of its files; read in a task."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    place, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    names = sorted(f.path for f in place.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet"))
    return ds.dataset(names, filesystem=place, format="parquet") if names else None


@functools.lru_cache(maxsize=1)
def _frequencies(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of the bank and in how many rows each stands."""
    table = _files(folder).to_table(columns=["gram", "df"])
    return table.column("gram").to_numpy(), table.column("df").to_numpy()


class _Weights:
    """``row, gram, weight`` of a batch: of its texts or places by the written frequencies, a gram being its place among
    them, or as its lists already hold them."""

    def __init__(self, folder: str | None, rows: int, least: int, most: int, by_word: bool) -> None:
        self.folder, self.rows, self.how = folder, rows, (least, most, by_word)

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.folder is None:
            lists = batch.column(1)
            return np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
        df = _frequencies(self.folder)[1]
        if "places" in batch.schema.names:
            lists = batch.column("places")
            row, at = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
            return row, at, self._weights(row, batch.column("tf").flatten().to_numpy(), df[at], batch.num_rows)
        row, at, tf = self.places(batch)
        return row, at, self._weights(row, tf, df[at], batch.num_rows)

    def hot(self, grams: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Hot n-grams as the batches name them, their groups, and by place which of them it is, or -1."""
        if self.folder is None:
            return grams, group, None
        known = _frequencies(self.folder)[0]
        at, slot = np.searchsorted(known, grams), np.full(len(known), -1, np.int16)
        slot[at] = np.arange(len(at))
        return at, group, slot

    def places(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, place, count`` of a batch of texts: places among the frequencies, n-grams that have none are dropped."""
        row, gram, tf = _profiles(batch.column(1).to_pylist(), *self.how)
        known = _frequencies(self.folder)[0]
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1) if len(known) else np.zeros(len(gram), np.int64)
        held = known[at] == gram if len(known) else np.zeros(len(gram), bool)
        return row[held], at[held], tf[held]

    def _weights(self, row: np.ndarray, tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
        raw = tf * (np.log((1.0 + self.rows) / (1.0 + df)) + 1.0)
        return raw / np.sqrt(np.bincount(row, raw * raw, n))[row]


def _placed(weights: _Weights):
    """``id, places, tf`` of texts: what ``_Weights`` makes of them, but for the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                row, at, tf = weights.places(part)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32))
                lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at, tf))
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["id", "places", "tf"])

    return run


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size`` of every span, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class _Bucket:
    """Bank rows with their n-grams, the posting lists of the rarer ones, and their lengths within groups of the hot."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, gram: np.ndarray, weight: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray | None]) -> None:
        self.ids, self.weight, self.hot = ids, weight, hot
        self.grams, at = np.unique(gram, return_inverse=True)
        self.found = None if hot[2] is None else np.full(len(hot[2]), -1, np.int32)
        if self.found is not None:
            self.found[self.grams] = np.arange(len(self.grams))
        self.at = at.astype(np.int32)
        self.size = np.bincount(row, minlength=len(ids))
        self.start = np.cumsum(self.size) - self.size
        self.asked = np.zeros(len(self.grams))
        self.lengths = self._lengths(row, gram, weight, len(ids))
        slot = self._slot(self.grams).astype(np.int16)[self.at]
        del at, gram
        tail, often = np.flatnonzero(slot < 0), np.flatnonzero(slot >= 0)
        self.slots, self.often = slot[often], weight[often]
        self.often_size = np.bincount(row[often], minlength=len(ids))
        self.often_start = np.cumsum(self.often_size) - self.often_size
        tail = tail[np.argsort(self.at[tail], kind="stable")]
        self.rows, self.weights = row[tail], weight[tail]
        self.count = np.bincount(self.at[tail], minlength=len(self.grams))
        self.first = np.cumsum(self.count) - self.count

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        """The place among the hot n-grams, or -1."""
        known = self.hot[0]
        if self.hot[2] is not None:
            return self.hot[2][grams]
        if not len(known):
            return np.full(len(grams), -1)
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        return np.where(known[at] == grams, at, -1)

    def _lengths(self, row: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        slot = self._slot(gram)
        some = slot >= 0
        wide = GROUPS
        return np.sqrt(np.bincount(row[some] * wide + self.hot[1][slot[some]], weight[some] ** 2, n * wide)).reshape(n, wide).astype(np.float32)

    def _hot(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """What the hot n-grams add to the scores of these rows."""
        size = self.often_size[rows]
        place = _spans(self.often_start[rows], size)
        return np.bincount(np.repeat(np.arange(len(rows)), size), asked[self.slots[place]] * self.often[place], len(rows))

    def _exact(self, rows: np.ndarray) -> np.ndarray:
        size = self.size[rows]
        place = _spans(self.start[rows], size)
        return np.round(np.bincount(np.repeat(np.arange(len(rows)), size), self.asked[self.at[place]] * self.weight[place], len(rows)), 12)

    def best(self, row: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int, least: np.ndarray, own: np.ndarray | None) -> Iterator[tuple[int, int, float]]:
        """``query, id, score`` of the best of these rows for each of ``n`` queries, where it reaches ``least``."""
        bounds = self._lengths(row, gram, weight, n) @ self.lengths.T
        edges = np.searchsorted(row, np.arange(n + 1))
        if self.found is not None:
            at = self.found[gram]
            held = at >= 0
        else:
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            held = self.grams[at] == gram
        slot = self._slot(gram)
        for q in range(n):
            part = slice(edges[q], edges[q + 1])
            mine, w = at[part][held[part]], weight[part][held[part]]
            if not len(mine):
                continue
            size = self.count[mine]
            place = _spans(self.first[mine], size)
            walked = np.bincount(self.rows[place], np.repeat(w, size) * self.weights[place], len(self.ids))
            most = bounds[q] + walked
            if own is not None:
                most[self.ids == own[q]] = 0
            some = np.flatnonzero((most >= least[q] - SLACK) & (most > 0))
            if not len(some):
                continue
            often = slot[part] >= 0
            asked = np.zeros(len(self.hot[0]))
            asked[slot[part][often]] = weight[part][often]
            if len(some) > FEW:
                first = some[np.argpartition(most[some], -FIRST)[-FIRST:]]
                some = some[most[some] >= (walked[first] + self._hot(first, asked)).max() - SLACK]
            close = walked[some] + self._hot(some, asked)
            some = some[close >= max(least[q], close.max()) - SLACK]  # in one order of addition, so that equal rows are equal
            if not len(some):
                continue
            self.asked[mine] = w
            scores = self._exact(some)
            self.asked[mine] = 0
            yield q, self.ids[some[scores == scores.max()]].min(), scores.max()


def _best_of_bucket(folder: str, seeds: str | None, weights: _Weights, hot: tuple[np.ndarray, np.ndarray], exclude_self: bool):
    """The best row of a bucket for each query, where it is as good as the best of the buckets in ``seeds`` or better."""

    def known(place: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, owner = np.zeros(len(ids)), np.full(len(ids), -1)
        if seeds is not None and (found := _files(f"{seeds}/{place}")) is not None:
            one, bank, score = (found.to_table(columns=[c]).column(c).to_numpy() for c in ("query_id", "bank_id", "score"))
            order = np.argsort(one)
            at = order[np.minimum(np.searchsorted(one, ids, sorter=order), len(one) - 1)]
            held = one[at] == ids
            best[held], owner[held] = score[at[held]], bank[at[held]]
        return best, owner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = ids = best = owner = before = named = None
        held: list[tuple[np.ndarray, ...]] = []

        def ask() -> None:
            lows = np.cumsum([0, *(len(h[0]) for h in held)])
            one, row = np.concatenate([h[0] for h in held]), np.concatenate([h[1] + low for h, low in zip(held, lows, strict=False)])
            gram, weight = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            held.clear()
            bucket = _Bucket(one, row, gram, weight, named)
            del row, gram, weight
            if not len(bucket.grams):
                return
            done = 0
            for batch in queries.to_batches(batch_size=AT_ONCE, columns=queries.schema.names):
                if batch.num_rows:
                    span = slice(done, done + batch.num_rows)
                    for q, one, score in bucket.best(*weights(batch), batch.num_rows, best[span], ids[span] if exclude_self else None):
                        if score > best[done + q] or (score == best[done + q] and 0 < score and one < owner[done + q]):
                            best[done + q], owner[done + q] = score, one
                    done += batch.num_rows

        for batch in batches:
            if not batch.num_rows:
                continue
            if ids is None:
                place = f"slice={batch.column('slice')[0].as_py()}"
                queries = _files(f"{folder}/{place}")
                if queries is None:
                    return
                ids = queries.to_table(columns=["id"]).column("id").to_numpy()
                named = weights.hot(*hot)
                best, owner = known(place, ids)
                before = best.copy(), owner.copy()
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                held.append((part.column("id").to_numpy(zero_copy_only=False), *weights(part)))
                if sum(len(h[2]) for h in held) >= ENTRIES:
                    ask()
        if held:
            ask()
        if ids is not None:
            some = (best != before[0]) | (owner != before[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(owner[some]), pa.array(best[some])], names=["query_id", "bank_id", "score"])

    return run


def _grid(queries: int, bank: int, entries: int, tasks: int) -> tuple[int, int]:
    """Slices of the queries and buckets of the bank: at least so many tasks, with the fewest texts read in all.  A bucket
    is small enough to be one index, as the queries are walked once an index."""
    least, buckets = -(-queries // QUERIES), max(-(-bank // ROWS), int(entries // (FILLED * ENTRIES)) + 1)
    ways = [(s, max(-(-tasks // s), buckets)) for s in range(max(1, least), max(1, least, tasks) + 1)]
    return min(ways, key=lambda w: w[0] * bank + w[1] * queries)


def _vectors(texts: DataFrame, idf: DataFrame, how: tuple[int, int, str]) -> DataFrame:
    """``id, grams, weights`` by joins: the way for vocabularies beyond what a task can hold."""
    rows = weighted(grams(texts, "id", "text", *how), idf)
    row = F.array_sort(F.collect_list(F.struct("gram", "w"))).alias("v")
    return rows.groupBy("id").agg(row).select("id", F.col("v.gram").alias("grams"), F.col("v.w").alias("weights"))


def nearest(queries: DataFrame, bank: DataFrame, query_id: str, query_text: str, bank_id: str, bank_text: str, least: int = 3, most: int = 5, analyzer: str = "char", exclude_self: bool = False) -> DataFrame:
    """``query_id, bank_id, score``: the nearest bank row of every query.  With ``exclude_self`` a query never takes
    the bank row of its own id, unless the bank has no other."""
    spark, how = bank.sparkSession, (least, most, analyzer)
    folder = new_folder(spark, "nearest")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    held, asked = kept(_texts(bank, bank_id, bank_text), "bank"), kept(_texts(queries, query_id, query_text), "queries")
    size = held.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one")).first()
    if not size["n"]:
        raise ValueError("the bank is empty")
    second = held.where(F.col("id") != F.lit(size["one"])).agg(F.min("id")).first()[0]
    by_word = analyzer == "char_wb"
    counts = held.mapInArrow(_counted(least, most, by_word), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    frequency = kept(counts.orderBy("gram"), "frequency")
    idf = inverse_frequency(frequency, size["n"])
    top = np.array([r[0] for r in frequency.orderBy(F.desc("df"), "gram").limit(HOT).select("gram").collect()], np.int64)
    group = np.arange(len(top)) * GROUPS // HOT
    hot = (np.sort(top), group[np.argsort(top)])
    seen = frequency.agg(F.count(F.lit(1)).alias("grams"), F.coalesce(F.sum("df"), F.lit(0)).alias("entries")).first()
    shared = seen["grams"] <= MOST_GRAMS
    weights = _Weights(f"{folder}/frequency" if shared else None, size["n"], least, most, by_word)
    known = lambda texts: texts if shared else _vectors(texts, idf, how)
    slices, buckets = _grid(asked.count(), size["n"], seen["entries"], 2 * spark.sparkContext.defaultParallelism)
    by_slice = lambda df, one, name: df.withColumn("slice", F.pmod(F.xxhash64(one), F.lit(slices)).cast("int")).repartition(slices, "slice").write.partitionBy("slice").parquet(f"{folder}/{name}")
    by_slice(asked.mapInArrow(_placed(weights), "id long, places array<int>, tf array<int>") if shared else known(asked), "id", "slices")
    bucket = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(buckets))
    rows = known(held).select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def search(low: int, high: int, seeds: str | None) -> DataFrame:
        """``query_id, bank_id, score`` of the best rows of these buckets."""
        place = (F.col("slice") * F.lit(high - low) + bucket - F.lit(low)).cast("int")
        some = rows.where((bucket >= low) & (bucket < high)).repartitionById(slices * (high - low), place)
        found = some.mapInArrow(_best_of_bucket(f"{folder}/slices", seeds, weights, hot, exclude_self), "query_id long, bank_id long, score double")
        return best_of(found)

    def best_of(found: DataFrame) -> DataFrame:
        best = F.max_by(F.struct("bank_id", "score"), F.struct("score", (-F.col("bank_id")).alias("first"))).alias("b")
        return found.groupBy("query_id").agg(best).select("query_id", "b.bank_id", "b.score")

    first = -(-spark.sparkContext.defaultParallelism // slices)
    if buckets < 4 * first or not shared:  # beyond a shared vocabulary the bank's rows are made by joins, once
        top = search(0, buckets, None)
    else:
        by_slice(search(0, first, None), "query_id", "seeds")
        seeds = spark.read.schema("query_id long, bank_id long, score double").parquet(f"{folder}/seeds").select("query_id", "bank_id", "score")
        top = best_of(search(first, buckets, f"{folder}/seeds").unionAll(seeds))
    default = F.lit(size["one"]).cast("long")
    if exclude_self and second is not None:
        default = F.when(F.col("query_id") == size["one"], F.lit(second).cast("long")).otherwise(default)
    everyone = asked.select(F.col("id").alias("query_id")).distinct()
    return everyone.join(top, "query_id", "left").select("query_id", F.coalesce("bank_id", default).alias("bank_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
