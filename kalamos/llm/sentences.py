"""Problem 6: which translations of a document render which of its sentences.

1. Induce a lexicon.  Over co-occurrence units (at first sentences that share
   names or numbers and other rows as they stand, in a second round the pairs
   aligned by the first) the association of every source word with every target
   word is measured by the log-likelihood ratio; pairs seen at least twice count,
   and the ``SENSES`` strongest positive ones are kept per source word.
2. Score.  A pair of sentences is scored by how much of either side's weight
   (rarer words weigh more) the other explains, by the lexicon or by the same
   name or number: the root of both shares' product.
3. Assign.  Pairs above the null cost are candidates, wherever in the document
   they stand; their connected components are solved one by one for the maximum
   weight by the Hungarian method.  Sentences may stay without partner and need
   not run in step.
4. Merged spans.  A sentence next to the span of a pair may join it, worth as
   much as it explains of what the span leaves open and as it is explained itself.
   Joining competes in the assignment: it is what a sentence gains without a
   partner of its own.  The assignment is solved again with the spans it has led
   to, spans of three and more growing from those of two, until nothing changes.

Scale: the lexicon is a table, joined to the words, never collected; words are
64-bit hashes before anything is shuffled and counts are reduced per task.  A
task holds one document at a time: scores are computed for some source sentences
against all targets at once, only candidates are kept, and memory follows the
largest component.

Null and wordless sentences have no partner.  Deliveries of the same document,
place and text count once; several texts at one place are one sentence.  Rows
without document or place are left out.  ``anchor_valid`` is not believed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kalamos.llm.lookalike import one_form, plain_words
from kalamos.llm.words import mix
from kalamos.llm.work import written

LEAST_RATIO, SENSES = 10.83, 4  # chi-square at 0.001 with one degree of freedom; senses kept per word
NULL_COST, MERGE_GAIN = 0.4, 0.4
CELLS = 2_000_000  # numbers of a score table held at once
_marker = re.compile(r"[{(]\w{1,4}[)}]").sub
_U = np.uint64
PAIR = "doc string, src int, tgt int, score double"
LEXICON = "s long, weight double, t array<long>, a array<double>"


def source_words(text: str | None) -> list[str]:
    """Plain words without the markers of names and gods; what remains is joined, without sign numbers."""
    out = []
    for w in plain_words(_marker("", one_form(text or ""))):
        joined = w if w[0].isdigit() else "".join(c for c in w if c not in "-." and not c.isdigit())
        if joined:
            out.append(joined)
    return out


def target_words(text: str | None) -> list[str]:
    return plain_words(text)


def hashes(words: list[str]) -> np.ndarray:
    """The distinct words as sorted 64-bit numbers."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], _U).view(np.int64))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: units, units of each word, units of each pair.  Words that stand on both sides explain themselves;
    a null side stands for no word."""
    for batch in batches:
        sides = []
        for name in ("source", "target"):
            lists = batch.column(name)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            sides.append((flat, np.repeat(np.arange(batch.num_rows), np.diff(offsets))))
        (s, i), (t, j) = sides
        # a word of both sides of a unit goes from both
        keys = np.concatenate([mix(s.view(_U) + mix(i.astype(_U))), mix(t.view(_U) + mix(j.astype(_U)))])
        _, where, many = np.unique(keys, return_inverse=True, return_counts=True)
        alone = many[where] == 1
        s, i, t, j = s[alone[: len(s)]], i[alone[: len(s)]], t[alone[len(keys) - len(t) :]], j[alone[len(keys) - len(t) :]]
        ones, one = np.unique(s, return_counts=True)
        twos, two = np.unique(t, return_counts=True)
        # every source word with every target word of its unit
        size, first = np.bincount(j, minlength=batch.num_rows), np.append(0, np.cumsum(np.bincount(j, minlength=batch.num_rows)))
        many = size[i]
        left = np.repeat(np.searchsorted(ones, s), many)
        at = np.repeat(first[i] - np.append(0, np.cumsum(many)[:-1]) if len(many) else many, many) + np.arange(many.sum())
        pair, n = np.unique(left * max(1, len(twos)) + np.searchsorted(twos, t)[at], return_counts=True)
        left, right = pair // max(1, len(twos)), pair % max(1, len(twos))
        none = lambda k: pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([none(1 + len(twos)), pa.array(ones), pa.array(ones[left])]),
                pa.concat_arrays([none(1), pa.array(twos), none(len(ones)), pa.array(twos[right])]),
                pa.array(np.concatenate([[batch.num_rows], two, one, n]).astype(np.int64)),
            ],
            names=["s", "t", "n"],
        )


def lexicon(units: DataFrame) -> DataFrame:
    """``s, weight, t, a``: per source word of ``source, target`` (arrays of distinct word hashes) its weight and its senses."""
    counts = units.select("source", "target").mapInArrow(_counts, "s long, t long, n long").groupBy("s", "t").agg(F.sum("n").alias("n"))
    counts = written(counts.where("n > 1 or s is null or t is null"), "cooccurrence")
    total = counts.where("s is null and t is null").select(F.col("n").alias("total"))
    total = int((total.first() or [0])[0])
    one = counts.where("s is not null and t is null").select("s", F.col("n").alias("ns"))
    two = counts.where("s is null and t is not null").select("t", F.col("n").alias("nt"))
    pairs = counts.where("s is not null and t is not null").join(one, "s").join(two, "t").withColumn("total", F.lit(total).cast("double"))

    def term(k: str, expected: str) -> str:
        return f"(case when {k} > 0 then {k} * ln({k} / ({expected})) else 0 end)"

    ratio = " + ".join(
        (
            term("n", "ns * nt / total"),
            term("(ns - n)", "ns * (total - nt) / total"),
            term("(nt - n)", "(total - ns) * nt / total"),
            term("(total - ns - nt + n)", "(total - ns) * (total - nt) / total"),
        )
    )
    pairs = pairs.withColumn("ratio", F.expr(f"2 * ({ratio})")).where(f"n * total > ns * nt and ratio >= {LEAST_RATIO}")
    # how far the target word follows the source word beyond its own frequency
    pairs = pairs.withColumn("follows", F.expr("(n / ns - nt / total) / greatest(1 - nt / total, 0.01)"))
    w = Window.partitionBy("s")
    pairs = pairs.withColumn("place", F.row_number().over(w.orderBy(F.desc("ratio"), "t"))).where(f"place <= {SENSES}")
    pairs = pairs.withColumn("most", F.max("follows").over(w))
    senses = pairs.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("t", F.expr("follows / most").alias("a")))).alias("senses"))
    weight = F.log(1 + F.lit(float(total)) / F.col("ns")).alias("weight")
    return one.join(senses, "s", "left").select("s", weight, F.col("senses.t").alias("t"), F.col("senses.a").alias("a"))


def assign(weight: np.ndarray) -> np.ndarray:
    """Maximum-weight assignment of rows to columns by the Hungarian method (shortest augmenting paths); -1 where a row
    stays alone, which is worth 0.  Cells of ``-inf`` are not allowed."""
    n, m = weight.shape
    cost = -weight
    u, v = np.zeros(n), np.zeros(m)
    row_of, column_of = np.full(m, -1), np.full(n, -1)
    for i in range(n):
        least, way, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        u[i] = min(0.0, float((cost[i] - v).min(initial=0.0)))
        reached, row, before = 0.0, i, -1
        alone, end = np.inf, -1  # the cheapest way to leave a row of the tree alone, and the column it has
        while True:
            now = reached + cost[row] - u[row] - v
            better = ~used & (now < least)
            least[better], way[better] = now[better], before
            if reached - u[row] < alone:
                alone, end = reached - u[row], before
            open_ = np.where(used, np.inf, least)
            j = int(open_.argmin()) if m else -1
            if j < 0 or open_[j] >= alone:
                reached, j = alone, end
                if j >= 0:
                    column_of[row_of[j]] = -1
                break
            reached = float(open_[j])
            if row_of[j] < 0:
                break
            used[j], before, row = True, j, row_of[j]
        u[i] += reached
        seen = np.flatnonzero(used)
        u[row_of[seen]] += reached - least[seen]
        v[seen] += least[seen] - reached
        while j >= 0:
            p = way[j]
            row = i if p < 0 else row_of[p]
            row_of[j], column_of[row], j = row, j, p
    return column_of


def components(i: np.ndarray, j: np.ndarray, rows: int) -> list[np.ndarray]:
    """The edges of each connected component of a bipartite graph."""
    parent = list(range(rows + (int(j.max()) + 1 if len(j) else 0)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), (j + rows).tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    own = np.array([root(a) for a in i.tolist()], np.int64)
    order = np.argsort(own, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else []


class Document:
    """The sentences of one document as numbers, and what explains what.

    Source words are given in the order of their sentences with their weights and senses, targets as the words of each
    sentence with theirs; the same word on both sides explains itself."""

    def __init__(self, place: np.ndarray, word: np.ndarray, weight: np.ndarray, bounds: np.ndarray, sense: np.ndarray, strength: np.ndarray, target: np.ndarray, size: np.ndarray, known: np.ndarray, worth: np.ndarray) -> None:
        self.starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        self.ends = np.append(self.starts[1:], len(place))
        self.weight = weight
        self.t_ends = np.cumsum(size)
        self.t_starts = self.t_ends - size
        self.terms, self.at = np.unique(target, return_inverse=True)
        value = np.zeros(len(self.terms))
        value[:] = worth[-1]  # of words that stand once
        hit = np.minimum(np.searchsorted(known, self.terms), max(len(known) - 1, 0))
        if len(known):
            value = np.where(known[hit] == self.terms, worth[hit], value)
        self.value = value[self.at]
        # links (entry, target word, strength), the same word with strength 1
        entry = np.concatenate([np.repeat(np.arange(len(word)), np.diff(bounds)), np.arange(len(word))])
        means, strong = np.concatenate([sense, word]), np.concatenate([strength, np.ones(len(word))])
        hit = np.minimum(np.searchsorted(self.terms, means), len(self.terms) - 1)
        some = self.terms[hit] == means
        order = np.argsort(entry[some], kind="stable")
        self.entry, self.term, self.strong = entry[some][order], hit[some][order], strong[some][order]
        self.link = np.searchsorted(self.entry, np.arange(len(word) + 1))
        self.whole = np.maximum(np.add.reduceat(weight, self.starts), 1e-12)
        self.other = np.maximum(np.add.reduceat(self.value, self.t_starts), 1e-12)

    def table(self, low: int, high: int) -> np.ndarray:
        """How strongly each target word is meant by the source words of sentences ``low`` to ``high``."""
        a, b = self.starts[low], self.ends[high - 1]
        out = np.zeros((b - a, len(self.terms)))
        links = slice(self.link[a], self.link[b])
        np.maximum.at(out, (self.entry[links] - a, self.term[links]), self.strong[links])
        return out

    def candidates(self, above: float, joining: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentence pairs with a score above the bound.  Also notes the pairs of which a side is explained well enough
        to be worth ``joining`` to a span."""
        self.source_may: set[tuple[int, int]] = set()
        self.target_may: set[tuple[int, int]] = set()
        n = len(self.starts)
        step = max(1, int(CELLS / max(1, len(self.at)) / max(1.0, len(self.weight) / n)))
        found = []
        for low in range(0, n, step):
            high = min(n, low + step)
            table, first = self.table(low, high), self.starts[low:high] - self.starts[low]
            best = np.maximum.reduceat(table[:, self.at], self.t_starts, axis=1)  # entry by target sentence
            ours = np.add.reduceat(best * self.weight[self.starts[low] : self.ends[high - 1], None], first, axis=0) / self.whole[low:high, None]
            meant = np.maximum.reduceat(table, first, axis=0)[:, self.at] * self.value
            theirs = np.add.reduceat(meant, self.t_starts, axis=1) / self.other
            score = np.sqrt(ours * theirs)
            for may, side in ((self.source_may, ours), (self.target_may, theirs)):
                i, j = np.nonzero(side >= joining * joining - 1e-9)
                may.update(zip((i + low).tolist(), j.tolist(), strict=True))
            i, j = np.nonzero(score > above)
            found.append((i + low, j, score[i, j]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def joins_source(self, i: int, group: list[int], j: int) -> float:
        """What source ``i`` is worth as a further part of the span that target ``j`` renders."""
        words = slice(self.t_starts[j], self.t_ends[j])
        at, value = self.at[words], self.value[words]
        done = np.max([self.table(g, g + 1)[:, at].max(0) for g in group], axis=0)
        mine = self.table(i, i + 1)[:, at]
        ours = float((mine.max(1) * self.weight[self.starts[i] : self.ends[i]]).sum() / self.whole[i])
        fresh, rest = float((value * np.maximum(0, mine.max(0) - done)).sum()), float((value * (1 - done)).sum()) or 1.0
        return (ours * min(1.0, fresh / rest)) ** 0.5

    def joins_target(self, j: int, group: list[int], i: int) -> float:
        """What target ``j`` is worth as a further rendering of source ``i``."""
        table, weight = self.table(i, i + 1), self.weight[self.starts[i] : self.ends[i]]
        part = lambda k: table[:, self.at[self.t_starts[k] : self.t_ends[k]]]
        done = np.max([part(g).max(1) for g in group], axis=0)
        mine = part(j)
        theirs = float((mine.max(0) * self.value[self.t_starts[j] : self.t_ends[j]]).sum() / self.other[j])
        fresh, rest = float((weight * np.maximum(0, mine.max(1) - done)).sum()), float((weight * (1 - done)).sum()) or 1.0
        return (theirs * min(1.0, fresh / rest)) ** 0.5


def solve(i: np.ndarray, j: np.ndarray, score: np.ndarray, alone_i: np.ndarray, alone_j: np.ndarray) -> np.ndarray:
    """The mate of every source (-1: none) of most weight, where staying alone is worth ``alone``; component by component."""
    mate = np.full(len(alone_i), -1)
    gain = score - alone_i[i] - alone_j[j]
    some = gain > 0
    i, j, gain = i[some], j[some], gain[some]
    for edges in components(i, j, len(alone_i)):
        if len(edges) == 1:
            mate[i[edges]] = j[edges]
            continue
        rows, r = np.unique(i[edges], return_inverse=True)
        columns, c = np.unique(j[edges], return_inverse=True)
        table = np.full((len(rows), len(columns)), -np.inf)
        table[r, c] = gain[edges]
        got = assign(table)
        mate[rows[got >= 0]] = columns[got[got >= 0]]
    return mate


def align(doc: Document, null: float = NULL_COST, least: float | None = MERGE_GAIN) -> list[tuple[int, int, float]]:
    """``(source place, target place, score)`` of one document, places counted in its sentences; without ``least``,
    no sentence joins a span."""
    n, m = len(doc.starts), len(doc.t_starts)
    i, j, score = doc.candidates(null, 2.0 if least is None else least)
    if least is None:
        mate = solve(i, j, score, np.full(n, null), np.zeros(m))
        return [(a, b, c) for a, b, c in zip(i.tolist(), j.tolist(), score.tolist(), strict=True) if mate[a] == b]
    value = dict(zip(zip(i.tolist(), j.tolist(), strict=True), score.tolist(), strict=True))
    remembered: dict[tuple, float] = {}

    def worth(key: tuple, of, *args) -> float:
        if key not in remembered:
            remembered[key] = of(*args)
        return remembered[key]

    alone_i, alone_j = np.full(n, null), np.zeros(m)
    state = None
    best: tuple[float, list[tuple[int, int, float]]] = (-1.0, [])
    for _ in range(2 * (n + m) + 2):
        mate = solve(i, j, score, alone_i, alone_j)
        pairs = [(a, int(b)) for a, b in enumerate(mate.tolist()) if b >= 0]
        back = {b: a for a, b in pairs}
        # spans grow from the pairs as long as a sentence without mate joins; a sentence with one learns what joining would give
        spans_i, spans_j = {b: [a] for a, b in pairs}, {a: [b] for a, b in pairs}
        joined: dict[tuple[str, int], tuple[float, int]] = {}
        offers_i, offers_j = np.full(n, null), np.zeros(m)
        grown = True
        while grown:
            grown = False
            offers: dict[tuple[str, int], tuple[float, int]] = {}
            for b, group in spans_i.items():
                if len(spans_j[back[b]]) > 1:
                    continue  # one source in several targets already
                for a in (min(group) - 1, max(group) + 1):
                    if (a, b) in doc.source_may and ("s", a) not in joined and a not in group:
                        w = worth(("s", a, b, *group), doc.joins_source, a, group, b)
                        if w >= least:
                            offers["s", a] = max(offers.get(("s", a), (0.0, -1)), (w, b))
            for a, group in spans_j.items():
                if len(spans_i[int(mate[a])]) > 1:
                    continue
                for b in (min(group) - 1, max(group) + 1):
                    if (a, b) in doc.target_may and ("t", b) not in joined and b not in group:
                        w = worth(("t", b, a, *group), doc.joins_target, b, group, a)
                        if w >= least:
                            offers["t", b] = max(offers.get(("t", b), (0.0, -1)), (w, a))
            for (side, k), (w, to) in sorted(offers.items(), key=lambda o: (-o[1][0], o[0])):
                if side == "s":
                    offers_i[k] = max(offers_i[k], null + w - least)
                    if mate[k] < 0 and len(spans_j[back[to]]) == 1:
                        spans_i[to].append(k)
                        joined[side, k], grown = (w, to), True
                else:
                    offers_j[k] = max(offers_j[k], w - least)
                    if k not in back and len(spans_i[int(mate[to])]) == 1:
                        spans_j[to].append(k)
                        joined[side, k], grown = (w, to), True
        found = [(a, b, value[a, b]) for a, b in pairs] + [(k, to, w) if side == "s" else (to, k, w) for (side, k), (w, to) in joined.items()]
        total = sum(value[a, b] - null for a, b in pairs) + sum(w - least for w, _ in joined.values())
        if total > best[0] + 1e-12:
            best = (total, found)
        # only sentences with a mate take their offers into the next solution: the others have joined or stay alone anyway
        next_i = np.where(mate >= 0, offers_i, alone_i)
        next_j = np.where(np.isin(np.arange(m), list(back)), offers_j, alone_j)
        now = (next_i.tobytes(), next_j.tobytes())
        if total <= best[0] - 1e-12 or now == state or (not (next_i > null).any() and not (next_j > 0).any()):
            break
        state, alone_i, alone_j = now, next_i, next_j
    return best[1]


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in batches:
        words = [hashes(source_words(t) if side == "s" else target_words(t)) for side, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(words, kind)], names=["doc", "idx", "side", "words"])


def sentence_words(df: DataFrame, doc: str, idx: str, source: str, target: str) -> DataFrame:
    """``doc, idx, side, words``: one row per sentence with its distinct words; several texts at one place are joined."""
    rows = df.select(F.col(doc).alias("doc"), F.col(idx).cast("int").alias("idx"), F.col(source).alias("s"), F.col(target).alias("t")).where("doc is not null and idx is not null")
    both = rows.select("doc", "idx", F.lit("s").alias("side"), F.col("s").alias("text")).unionAll(rows.select("doc", "idx", F.lit("t").alias("side"), F.col("t").alias("text")))
    both = both.where("text is not null and text <> ''").distinct()
    words = both.mapInArrow(_word_lists, "doc string, idx int, side string, words array<long>").where("size(words) > 0")
    return words.groupBy("doc", "idx", "side").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))


def _documents(null: float, least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, float]] = []
            for doc, src, tgt, document in documents(batch):
                out += [(doc, src[a], tgt[b], s) for a, b, s in align(document, null, least)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "src", "tgt", "score"])

    return run


def documents(batch: pa.RecordBatch) -> Iterator[tuple[str, list[int], list[int], Document]]:
    """Name, places of sources and targets, and the document, of every row of gathered entries."""

    def lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
        offsets = column.offsets.to_numpy()
        return (offsets - offsets[0]).astype(np.int64), column.values.slice(offsets[0], offsets[-1] - offsets[0])

    number = lambda of, kind=np.int64: of.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
    (s_at, sources), (t_at, targets), (w_at, weights) = (lists(batch.column(c)) for c in ("sources", "targets", "weights"))
    s_idx, s_word, s_weight = number(sources.field("idx")), number(sources.field("w")), number(sources.field("weight"), float)
    (m_at, means), (_, strong) = lists(sources.field("t")), lists(sources.field("a"))
    means, strong = number(means), number(strong, float)
    t_idx, (k_at, words) = number(targets.field("idx")), lists(targets.field("words"))
    words = number(words)
    w_word, w_weight = number(weights.field("w")), number(weights.field("weight"), float)
    top = batch.column("top").to_pylist()

    def spread(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows of lists, and the rows' bounds in them."""
        size = at[rows + 1] - at[rows]
        bounds = np.append(0, np.cumsum(size))
        return np.repeat(at[rows] - bounds[:-1], size) + np.arange(bounds[-1]), bounds

    for row, doc in enumerate(batch.column("doc").to_pylist()):
        own = np.arange(s_at[row], s_at[row + 1])
        own = own[np.lexsort((s_word[own], s_idx[own]))]
        senses, bounds = spread(m_at, own)
        said = np.arange(t_at[row], t_at[row + 1])
        said = said[np.argsort(t_idx[said], kind="stable")]
        of, ends = spread(k_at, said)
        known = slice(w_at[row], w_at[row + 1])
        by = np.argsort(w_word[known])
        document = Document(
            s_idx[own], s_word[own], s_weight[own], bounds, means[senses], strong[senses], words[of], np.diff(ends), w_word[known][by], np.append(w_weight[known][by], top[row])
        )
        yield doc, np.unique(s_idx[own]).tolist(), t_idx[said].tolist(), document


def align_with(words: DataFrame, lex: DataFrame, null: float = NULL_COST, least: float | None = MERGE_GAIN) -> DataFrame:
    """``doc, src, tgt, score`` of all documents with one lexicon."""
    rare = lex.agg(F.max("weight").alias("top")).first()
    top = float((rare and rare["top"]) or 1.0)
    source = words.where("side = 's'").select("doc", "idx", F.explode("words").alias("w"))
    source = source.join(lex.withColumnRenamed("s", "w"), "w", "left").select("doc", F.struct("idx", "w", F.coalesce("weight", F.lit(top)).alias("weight"), "t", "a").alias("e"))
    target = words.where("side = 't'")
    known = target.select("doc", F.explode("words").alias("w"))
    often = known.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = float(target.count() or 1)
    often = often.where("n > 1").select("w", F.log(1 + F.lit(total) / F.col("n")).alias("weight"))
    known = known.distinct().join(often, "w")
    gather = lambda df, e, name: df.groupBy("doc").agg(F.collect_list(e).alias(name))
    docs = gather(source, F.col("e"), "sources").join(gather(target, F.struct("idx", "words"), "targets"), "doc")
    docs = docs.join(gather(known, F.struct("w", "weight"), "weights"), "doc", "left")
    docs = docs.select("doc", "sources", "targets", "weights", F.log(1 + F.lit(total)).alias("top"))
    return docs.mapInArrow(_documents(null, least), PAIR)


def align_documents(df: DataFrame, doc: str, idx: str, source: str, target: str, rounds: int = 2) -> DataFrame:
    """``doc, src, tgt, score``: each source sentence with the translations that render it, wholly or in part."""
    words = written(sentence_words(df, doc, idx, source, target), "sentences")
    side = lambda s, name, place: words.where(f"side = '{s}'").select("doc", F.col("idx").alias(place), F.col("words").alias(name))
    sources, targets = side("s", "source", "src"), side("t", "target", "tgt")
    # The first units: sentences that share names or numbers, other rows as they stand.
    none = words.sparkSession.createDataFrame([], LEXICON)
    known = written(align_with(words, none, 0.0, None), "identical").select("doc", "src", "tgt")
    stand = sources.select("doc", "src").join(known, ["doc", "src"], "left_anti").join(targets.select("doc", F.col("tgt").alias("src"), "tgt"), ["doc", "src"])
    found = known.unionAll(stand.select("doc", "src", "tgt"))
    for _ in range(rounds):
        pairs = found.join(sources, ["doc", "src"]).join(targets, ["doc", "tgt"])
        found = written(align_with(words, written(lexicon(pairs), "lexicon")), "aligned")
    return found
