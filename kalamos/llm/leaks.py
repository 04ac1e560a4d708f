"""Problem 8: held-out passages that stand, wholly or partly, in training documents.

Distributed positional inverted index.  ``PositionalIndex.build`` stores the
training side's postings once: documents are taken in shards of about
``SHARD`` words, and a shard is written as one row a term (its places in the
shard, as differences in variable bytes), ordered by term, and one row that says
which document begins where.  A shard is indexed where its documents lie, so
building shuffles nothing, and a term that stands everywhere is split over the
shards.  Any number of item sets can then be asked without reading a document:

1. the terms of the items are joined to the index for their numbers of places;
2. for each item its rarest terms are taken, as many as any passage of the part
   asked for must hold at least two of after the edits allowed;
3. their postings are joined to the items, and for each item and shard the lists,
   adjusted by the term's offset in the item, are intersected with play for all
   added and dropped words allowed: the diagonals on which a passage may lie;
4. each shard with candidates gathers the postings of those items' terms, and each
   diagonal is decided exactly: the most words that a passage of one document
   keeps within the allowed edits.  It is an exact phrase (no word changed) or a
   proximity match.

A document holds an item if one aligned passage, in the item's order, has at
least ``part`` of the item's plain words and at most ``changed`` of the
passage (never less than one word) is changed, added or left out inside it.
Line breaks, blanks and words broken at a line end make no difference.

Terms are told apart by 64-bit hashes.  Items and their postings meet in joins;
nothing is collected or sent to every task.  A task holds one shard: as many
words as one document at least, and ``SHARD`` or one document more at most.
Null, empty and wordless texts and items match nothing; repeated items each
count, and so do documents with the same id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalamos.llm.lookalike import HYPHENS, plain_words
from kalamos.llm.work import new_place, written

PART, CHANGED, SHARD = 0.5, 0.2, 250_000
REMEMBERED = 500_000
INDEX = "term long, shard long, n int, places binary, docs array<long>"
FOUND = "doc long, item long, matches int, words int, edits int, first int, last int"
_U = np.uint64
_broken = re.compile(f"[-­{HYPHENS}](?:\r\n|[\n\r\u0085  ])").sub


def terms_of(text: str | None) -> list[str]:
    """Plain words with line-end breaks closed and without hyphens, which a break may have swallowed."""
    return [t for t in (w.replace("-", "") for w in plain_words(_broken("", text))) if t] if text else []


def most_edits(words: int, changed: float) -> int:
    """The most edits that any passage with up to ``words`` matches may hold."""
    return max(1, math.floor(changed * words / (1 - changed) + 1e-9)) if changed < 1 else 2 * words


def align(item: np.ndarray, passage: np.ndarray, least: int, changed: float) -> tuple[int, int, int, int] | None:
    """Of all in-order alignments with at least ``least`` matches whose edits (words changed, added or left out) stay
    within the share, the one with the most matches, then the fewest edits: matches, edits, first and last place."""
    width, most = len(passage), most_edits(len(item), changed)
    one, none = 1 << 32, -(1 << 62)
    # by edits and place: matches (upper half) and first place (lower half); an alignment starts anywhere without edits
    fresh = np.arange(width + 1)
    state = np.full((most + 1, width + 1), none)
    state[0] = fresh
    best, last = np.full(most + 1, none), np.zeros(most + 1, int)
    for a in item.tolist():
        same = passage == a
        new = np.full((most + 1, width + 1), none)
        new[0] = fresh
        new[:, 1:][:, same] = state[:, :-1][:, same] + one
        ends = np.flatnonzero(same)
        if len(ends):
            at = new[:, ends + 1]
            top = at.argmax(axis=1)
            value = at[np.arange(most + 1), top]
            better = value > best
            best[better], last[better] = value[better], ends[top[better]]
        np.maximum(new[1:], state[:-1], out=new[1:])
        np.maximum(new[1:, 1:], state[:-1, :-1], out=new[1:, 1:])
        for e in range(1, most + 1):
            np.maximum(new[e, 1:], new[e - 1, :-1], out=new[e, 1:])
        state = new
    found = None
    for e in range(most + 1):
        matches = int(best[e]) >> 32
        if matches >= least and e <= max(1, changed * (matches + e) + 1e-9) and (found is None or matches > found[0]):
            found = (matches, e, int(best[e]) & (one - 1), int(last[e]))
    return found


class Terms:
    """Hashes of a text's terms; what a piece between blanks holds is remembered."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in _broken("", text).split() if text else ():
            found = known.get(piece)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[piece] = tuple(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms_of(piece))
            out += found
        return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable bytes (7 bits each, the highest bit says that more follow) and the number of bytes of each value."""
    values = values.astype(_U)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= (_U(1) << _U(7 * k))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        some = size > k
        more = (size[some] > k + 1).astype(np.uint8) << 7
        out[ends[some] - size[some] + k] = ((values[some] >> _U(7 * k)) & _U(127)).astype(np.uint8) | more
    return out, size


def unpack(lists: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The packed numbers of all rows, summed up within each row, and the offsets of the rows in them."""
    bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    raw = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    last = raw < 128
    offsets = np.append(0, np.cumsum(last))[bounds - bounds[0]]
    if not len(raw):
        return np.zeros(0, np.int64), offsets
    first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    sums = np.cumsum(np.add.reduceat((raw & 127).astype(_U) << (_U(7) * place.astype(_U)), first).astype(np.int64))
    return sums - np.repeat(np.append(0, sums)[offsets[:-1]], np.diff(offsets)), offsets


def posting_rows(shard: int, docs: list[int], sizes: list[int], words: np.ndarray) -> pa.RecordBatch:
    """One shard of the index: its words in the order of the documents become a row a term, and one without a term."""
    order = np.argsort(words, kind="stable")
    terms, first = np.unique(words[order], return_index=True)
    gaps = np.diff(order, prepend=0)
    gaps[first] = order[first]
    data, size = pack(gaps)
    ends = np.concatenate([[0], np.cumsum(size)])[np.append(first, len(order))]
    starts, many = pack(np.array(sizes))
    places = pa.Array.from_buffers(pa.binary(), len(terms) + 1, [None, pa.py_buffer(np.append(ends, ends[-1] + len(starts)).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes() + starts.tobytes())])
    count = np.append(np.diff(np.append(first, len(order))), len(docs)).astype(np.int32)
    own = pa.array([*[None] * len(terms), docs], pa.list_(pa.int64()))
    term = pa.array(np.append(terms.view(np.int64), 0), mask=np.append(np.zeros(len(terms), bool), True))
    return pa.RecordBatch.from_arrays([term, pa.array(np.full(len(count), shard)), pa.array(count), places, own], names=["term", "shard", "n", "places", "docs"])


def _index(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        terms, shard = Terms(), TaskContext.get().partitionId() << 32
        docs: list[int] = []
        sizes: list[int] = []
        words: list[int] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = terms(text)
                if own:
                    docs.append(doc)
                    sizes.append(len(own))
                    words += own
                if len(words) >= size:
                    yield posting_rows(shard, docs, sizes, np.array(words, _U))
                    shard, docs, sizes, words = shard + 1, [], [], []
        if docs:
            yield posting_rows(shard, docs, sizes, np.array(words, _U))

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        words = [np.array(terms(t), _U).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item", "terms"])


def seeds(frequency: np.ndarray, part: float, changed: float) -> np.ndarray:
    """Places in the item of its rarest terms, so many that every stretch of the wanted part holds enough of them for
    two to be left when some words are changed."""
    n = len(frequency)
    run = max(1, math.ceil(part * n))
    # a passage with more edits is so long that it holds two stretches apart, one of them with half of the edits
    wanted = min(run, max(1, math.floor(changed * (2 * run - 1) + 1e-9)) + 2)
    chosen = np.zeros(n, bool)
    runs = np.zeros(n - run + 1, np.int64)  # chosen places of each stretch
    for k in np.argsort(frequency, kind="stable").tolist():
        around = slice(max(0, k - run + 1), min(k, n - run) + 1)
        if runs[around].min() < wanted:
            chosen[k] = True
            runs[around] += 1
    return np.flatnonzero(chosen)


def _seed_rows(part: float, changed: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                entries.sort(key=lambda e: e["k"])
                chosen = seeds(np.array([e["total"] for e in entries]), part, changed).tolist()
                out += [(number, len(entries), k, entries[k]["term"]) for k in chosen if entries[k]["total"]]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["number", "n", "k", "term"])

    return run


def diagonals(hits: list[tuple[int, np.ndarray]], n: int, part: float, changed: float) -> np.ndarray:
    """Where the item may begin: places of its seeds minus their offsets that agree, within the play, with those of
    another seed."""
    least, play = max(1, math.ceil(part * n - 1e-9)), most_edits(n, changed)
    diagonal = np.concatenate([places - k for k, places in hits])
    seed = np.repeat([k for k, _ in hits], [len(places) for _, places in hits])
    if least < 3:
        return np.unique(diagonal)
    both = np.sort((diagonal << 20) | seed)  # one sort of plain numbers; items are shorter than 2 ** 20 words
    diagonal, seed = both >> 20, both & ((1 << 20) - 1)
    # a hit of another seed within the play: the last one before each run of hits of one seed, the first one after it
    turn = np.flatnonzero(seed[1:] != seed[:-1]) + 1
    of = np.searchsorted(turn, np.arange(len(seed)), "right")
    before, after = np.append(-1, turn - 1)[of], np.append(turn, len(seed))[of]
    near = (before >= 0) & (diagonal - diagonal[before] <= play)
    near |= (after < len(seed)) & (diagonal[np.minimum(after, len(seed) - 1)] - diagonal <= play)
    return np.unique(diagonal[near])


def _candidates(part: float, changed: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            places, offsets = unpack(hits.values.field("places"))
            seed, bounds = hits.values.field("k").to_numpy(), hits.offsets.to_numpy()
            items, shards, found = [], [], []
            for row, (item, n, shard) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("number", "n", "shard")), strict=True)):
                where = diagonals([(int(seed[e]), places[offsets[e] : offsets[e + 1]]) for e in range(bounds[row], bounds[row + 1])], n, part, changed)
                if len(where):
                    items.append(item)
                    shards.append(shard)
                    found.append(where)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(shards, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["number", "shard", "diagonals"])

    return run


class Shard:
    """The words of a shard as far as they are terms of the items asked there, put back from their postings."""

    def __init__(self) -> None:
        self.number: dict[int, int] = {}
        self.lists: list[np.ndarray] = []
        self.docs: list[int] = []
        self.flat: np.ndarray | None = None

    def add(self, term: int | None, places: np.ndarray, docs: list[int] | None) -> None:
        if term is None:
            self.docs = docs or []
            self.ends = places
            self.starts = np.append(0, places[:-1])
        else:
            self.number[term] = len(self.lists)
            self.lists.append(places)

    def search(self, terms: list[int], diagonal: np.ndarray, part: float, changed: float) -> list[tuple[int, int, int, int, int]]:
        """``(document's place, matches, edits, first word, last word)`` of the best passage of each document that holds one."""
        if self.flat is None:
            self.flat = np.full(int(self.ends[-1]), -1, np.int32)
            if self.lists:
                self.flat[np.concatenate(self.lists)] = np.repeat(np.arange(len(self.lists)), [len(p) for p in self.lists])
        words = np.array([self.number.get(t, -2) for t in terms], np.int32)
        n = len(words)
        least, play = max(1, math.ceil(part * n - 1e-9)), most_edits(n, changed)
        # how many places of the item's words lie near each diagonal: at least as many as the words that do
        near = np.sort(np.concatenate([self.lists[w] - k for k, w in enumerate(words.tolist()) if w >= 0]))
        diagonal = diagonal[np.searchsorted(near, diagonal + play, "right") - np.searchsorted(near, diagonal - play, "left") >= least]
        # every document that the stretch around a diagonal touches
        low = np.searchsorted(self.ends, diagonal - play, "right")
        high = np.maximum(np.searchsorted(self.starts, diagonal + n + play, "left"), low)
        many = high - low
        diagonal = np.repeat(diagonal, many)
        doc = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        start, end = self.starts[doc], self.ends[doc]
        found = np.zeros((len(diagonal), n), bool)
        for shift in range(-play, play + 1):
            at = diagonal[:, None] + np.arange(shift, n + shift)[None, :]
            inside = (at >= start[:, None]) & (at < end[:, None])
            found |= inside & (self.flat[np.clip(at, 0, len(self.flat) - 1)] == words[None, :])
        some = found.sum(1) >= least
        best: dict[int, tuple[int, int, int, int]] = {}
        reached: dict[int, int] = {}
        for d, k in zip(diagonal[some].tolist(), doc[some].tolist(), strict=True):
            if d <= reached.get(k, d - 1):
                continue
            begin, stop = int(self.starts[k]), int(self.ends[k])
            if begin <= d and d + n <= stop and (self.flat[d : d + n] == words).all():  # the whole phrase: no better passage
                if best.get(k, (0,))[:2] < (n, 0):
                    best[k] = (n, 0, d - begin, d + n - 1 - begin)
                reached[k] = d + play // 2
                continue
            low_, high_ = max(begin, d - play), min(stop, d + n + 2 * play)
            held = align(words, self.flat[low_:high_], least, changed)
            if held:
                matches, edits, first, last = held
                if (matches, -edits) > best.get(k, (0, 0))[:2]:
                    best[k] = (matches, -edits, low_ + first - begin, low_ + last - begin)
            reached[k] = d + play // 2
        return [(k, m, -e, f, t) for k, (m, e, f, t) in best.items()]


def _decide(part: float, changed: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, Shard()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part_ = batch.slice(start, 1000)
                out = []
                places, ends = unpack(part_.column("places").fill_null(b""))
                columns = part_.select(["shard", "term", "docs", "item", "terms", "diagonals"]).to_pydict()
                for row, (number, term, docs, item, terms, where) in enumerate(zip(*columns.values(), strict=True)):
                    if number != now:
                        now, shard = number, Shard()
                    if item is None:
                        shard.add(term, places[ends[row] : ends[row + 1]], docs)
                    else:
                        out += [(shard.docs[k], item, m, len(terms), e, f, t) for k, m, e, f, t in shard.search(terms, np.array(where), part, changed)]
                found = list(zip(*out, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=["doc", "item", "matches", "words", "edits", "first", "last"])

    return run


class PositionalIndex:
    """Stored postings of a table of documents."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path
        self.rows = spark.read.schema(INDEX).parquet(path)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, path: str | None = None, size: int = SHARD) -> PositionalIndex:
        """Index the documents into ``path`` (by default a place in the shared folder)."""
        spark = docs.sparkSession
        rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
        path = path or new_place(spark, "index")
        rows.mapInArrow(_index(size), INDEX).write.parquet(path)
        return cls(spark, path)

    def search(self, items: DataFrame, item_col: str, item_text: str, part: float = PART, changed: float = CHANGED) -> DataFrame:
        """``doc, item, matches, words, edits, first, last``: the best passage of each item in each document that holds
        it; ``first`` and ``last`` count the document's plain words."""
        postings = self.rows.where("term is not null")
        parts = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to decide: not to be merged
        asked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null and text <> ''")
        asked = written(asked.mapInArrow(_item_terms, "item long, terms array<long>").where("size(terms) > 0").withColumn("number", F.monotonically_increasing_id()), "items")
        terms = asked.select("number", F.posexplode("terms").alias("k", "term"))
        total = postings.select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("total"))
        entries = terms.join(total, "term", "left").groupBy("number").agg(F.collect_list(F.struct("k", "term", F.coalesce("total", F.lit(0)).alias("total"))).alias("entries"))
        chosen = entries.mapInArrow(_seed_rows(part, changed), "number long, n int, k int, term long")
        met = chosen.join(postings.select("term", "shard", "places"), "term").repartition(parts, "number", "n", "shard").groupBy("number", "n", "shard").agg(F.collect_list(F.struct("k", "places")).alias("hits"))
        found = met.mapInArrow(_candidates(part, changed), "number long, shard long, diagonals array<long>")
        found = written(found.join(asked, "number").select("shard", "item", "terms", "diagonals"), "candidates")
        needed = found.select("shard", F.explode(F.array_distinct("terms")).alias("term")).distinct()
        none = lambda name, kind: F.lit(None).cast(kind).alias(name)
        blank = [none("item", "long"), none("terms", "array<long>"), none("diagonals", "array<long>")]
        lists = postings.join(needed, ["term", "shard"], "left_semi").select("shard", "term", "places", none("docs", "array<long>"), *blank)
        heads = self.rows.where("term is null").join(found.select("shard").distinct(), "shard", "left_semi").select("shard", "term", "places", "docs", *blank)
        rows = found.select("shard", none("term", "long"), none("places", "binary"), none("docs", "array<long>"), "item", "terms", "diagonals")
        together = lists.unionAll(heads).unionAll(rows).repartition(parts, "shard").sortWithinPartitions("shard", F.col("item").asc_nulls_first())
        return together.mapInArrow(_decide(part, changed), FOUND)


def leaked_items(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, part: float = PART, changed: float = CHANGED) -> DataFrame:
    """Index the documents and ask all items: see :meth:`PositionalIndex.search`."""
    return PositionalIndex.build(docs, id_col, text_col).search(items, item_col, item_text, part, changed)


def leak_report(found: DataFrame, items: DataFrame, item_col: str, split_col: str) -> DataFrame:
    """``split, items, leaked, documents, exact``: per held-out split how many items there are and leaked, in how many documents."""
    side = items.select(F.col(item_col).cast("long").alias("item"), F.col(split_col).alias("split"))
    return (
        side.join(found, "item", "left")
        .groupBy("split")
        .agg(
            F.countDistinct("item").alias("items"),
            F.countDistinct(F.when(F.col("doc").isNotNull(), F.col("item"))).alias("leaked"),
            F.countDistinct("doc").alias("documents"),
            F.count_if((F.col("edits") == 0) & (F.col("matches") == F.col("words"))).alias("exact"),
        )
    )
