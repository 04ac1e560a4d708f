"""Problem 3: splits that keep all rows of one tablet together.

Ids are brought to one form (the same 32 hexadecimal digits, whatever stands
around or between them); stated joins tie ids together, directly or over
others.  Connected components are found with alternating large-star and
small-star rounds over edges only: every round is two group-bys and joins, its
result is written to the shared folder, and no component is ever gathered in
one place.

Splits by largest differencing: each partition of the components' weights is
balanced into ``bins`` equal bins by repeatedly combining the two partial
solutions that differ most, heaviest bins with lightest; the partitions' bins
(a bounded number of sums) are combined in the same way, and whole bins are
given to the splits by their open share, heaviest first.

Null, empty and blank ids tie nothing: such a row is a tablet of its own and is given to
a split by a hash of its key.  An id without 32 hexadecimal digits stands for
itself, as written.  Repeated, reversed and reflexive joins and joins with a null side change nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalamos.llm.work import written

BINS, PER_PART = 200, 200_000  # bins of a partition; groups that one task balances


def tablet_id(written_id: Column | str) -> Column:
    """8-4-4-4-12 in lower case where 32 hexadecimal digits stand together or apart; otherwise the id itself; null if blank."""
    raw = F.col(written_id) if isinstance(written_id, str) else written_id
    run = F.regexp_extract(raw, "(?i)(?<![0-9a-z])((?:[0-9a-f][^0-9a-zA-Z]*+){31}[0-9a-f])(?![0-9a-z])", 1)
    run = F.when(run != "", run).otherwise(raw)
    digits = F.lower(F.regexp_replace(run, "[^0-9a-fA-F]", ""))
    cut = F.concat_ws("-", *(F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(F.trim(raw) == "", F.lit(None)).when(F.length(digits) == 32, cut).otherwise(raw)


def components(edges: DataFrame, one: str, two: str, most_rounds: int = 60) -> DataFrame:
    """``id, group``: every id of an edge with the least id it is tied to."""
    e = edges.select(F.col(one).alias("u"), F.col(two).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    nodes = written(e.select(F.col("u").alias("id")).unionAll(e.select(F.col("v").alias("id"))).distinct(), "nodes")
    e, before = written(e, "edges"), None
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = mark(e)
    for _ in range(most_rounds):
        if now == before:
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now = now, mark(e)
    else:
        raise RuntimeError("components did not settle")
    root = e.groupBy("u").agg(F.min("v").alias("group")).withColumnRenamed("u", "id")
    return nodes.join(root, "id", "left").select("id", F.coalesce("group", "id").alias("group"))


def tablet_groups(ids: DataFrame, id_col: str, joins: DataFrame, left: str, right: str) -> DataFrame:
    """``id_written, group``: every distinct written id with its group's least id."""
    seen = ids.select(F.col(id_col).alias("id_written")).distinct().select("id_written", tablet_id("id_written").alias("id")).where("id is not null")
    tied = components(joins.select(tablet_id(left).alias("one"), tablet_id(right).alias("two")), "one", "two")
    return seen.join(tied, "id", "left").select("id_written", F.coalesce("group", "id").alias("group"))


def differencing(parts: list[tuple[np.ndarray, list[list]]], bins: int) -> tuple[np.ndarray, list[list]]:
    """Combine partial solutions (bin sums, contents) until one is left: always the two of the widest spread,
    the heaviest bins of one with the lightest of the other."""
    order = count()
    heap = [(-(float(sums.max() - sums.min())), next(order), sums, held) for sums, held in parts]
    heapq.heapify(heap)
    if not heap:
        return np.zeros(bins, np.int64), [[] for _ in range(bins)]
    while len(heap) > 1:
        _, _, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heapq.heappop(heap)
        up, down = np.argsort(a, kind="stable"), np.argsort(-b, kind="stable")
        sums = a[up] + b[down]
        held = []
        for i, j in zip(up.tolist(), down.tolist(), strict=True):
            one, two = held_a[i], held_b[j]
            held.append((one.extend(two) or one) if len(one) >= len(two) else (two.extend(one) or two))
        heapq.heappush(heap, (-float(sums.max() - sums.min()), next(order), sums, held))
    return heap[0][2], heap[0][3]


def _balance(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        groups: list[str] = []
        weights: list[int] = []
        for batch in batches:
            groups += batch.column(0).to_pylist()
            weights += batch.column(1).to_pylist()
        if not groups:
            return
        order = sorted(range(len(groups)), key=lambda k: (-weights[k], groups[k]))
        # the first step of differencing puts the next heaviest weights into different bins
        parts = []
        for start in range(0, len(order), bins):
            row = order[start : start + bins]
            sums = np.zeros(bins, np.int64)
            sums[: len(row)] = [weights[k] for k in row]
            parts.append((sums, [[k] for k in row] + [[] for _ in range(bins - len(row))]))
        _, held = differencing(parts, bins)
        place = TaskContext.get().partitionId()
        out = [(groups[k], weights[k], place, b) for b, inside in enumerate(held) for k in inside]
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["group", "weight", "part", "bin"])

    return run


def allocate(sums: np.ndarray, targets: list[tuple[str, float]], taken: dict[str, int] | None = None) -> list[str]:
    """A split for every bin: heaviest first, to the split whose share is open widest."""
    total = float(sums.sum()) + sum((taken or {}).values())
    whole = sum(share for _, share in targets) or 1.0
    open_ = {name: total * share / whole - (taken or {}).get(name, 0) for name, share in targets}
    out = [""] * len(sums)
    for b in np.argsort(-sums, kind="stable").tolist():
        best = max(open_, key=lambda name: (open_[name], name))
        out[b] = best
        open_[best] -= float(sums[b])
    return out


def group_splits(weights: DataFrame, targets: list[tuple[str, float]], bins: int = BINS) -> DataFrame:
    """``group, split`` for ``group, weight``; whole groups only."""
    spark: SparkSession = weights.sparkSession
    weights = written(weights.select("group", F.col("weight").cast("long")), "weights")
    parts = max(1, -(-weights.count() // PER_PART))
    placed = written(weights.repartition(parts, "group").mapInArrow(_balance(bins), "group string, weight long, part int, bin int"), "bins")
    sums = placed.groupBy("part", "bin").agg(F.sum("weight").alias("weight")).collect()  # parts * bins rows at most: one for a thousand groups
    solutions: dict[int, tuple[np.ndarray, list[list]]] = {}
    for part, b, weight in sorted(sums):
        vector, held = solutions.setdefault(part, (np.zeros(bins, np.int64), [[] for _ in range(bins)]))
        vector[b] = weight
        held[b].append((part, b))
    total, held = differencing([solutions[p] for p in sorted(solutions)], bins)
    names = allocate(total, targets)
    where = [(part, b, names[slot]) for slot, inside in enumerate(held) for part, b in inside]
    if not where:
        return spark.createDataFrame([], "group string, split string")
    # a small table as a rule; how it is joined is left to its measured size
    return placed.join(spark.createDataFrame(where, "part int, bin int, split string"), ["part", "bin"]).select("group", "split")


def assign_splits(tables: dict[str, tuple[DataFrame, str, str]], joins: DataFrame, left: str, right: str, targets: DataFrame, split_col: str, share_col: str, bins: int = BINS) -> DataFrame:
    """``table, key, split``: a split for every row of every table (name -> table, key column, id column)."""
    wanted = [(r[0], float(r[1])) for r in targets.where(f"{split_col} is not null and {share_col} > 0").groupBy(split_col).agg(F.max(share_col)).collect()]
    wanted.sort()
    if not wanted:
        raise ValueError("no split with a share")
    rows = None
    for name, (df, key, id_col) in tables.items():
        side = df.select(F.lit(name).alias("table"), F.col(key).cast("long").alias("key"), F.col(id_col).alias("id_written"))
        rows = side if rows is None else rows.unionAll(side)
    groups = written(tablet_groups(rows, "id_written", joins, left, right), "groups")
    weights = rows.groupBy("id_written").agg(F.count(F.lit(1)).alias("n")).join(groups, "id_written").groupBy("group").agg(F.sum("n").alias("weight"))
    split = groups.join(group_splits(weights, wanted, bins), "group").select("id_written", "split")
    whole = sum(s for _, s in wanted)
    point = F.pmod(F.xxhash64("table", "key"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    lone = F.lit(wanted[-1][0])
    for name, share in reversed(wanted[:-1]):
        reached = sum(s for n, s in wanted if n <= name)
        lone = F.when(point < reached / whole, name).otherwise(lone)
    return rows.join(split, "id_written", "left").select("table", "key", F.coalesce("split", lone).alias("split"))


def split_check(assigned: DataFrame, tables: dict[str, tuple[DataFrame, str, str]], targets: DataFrame, split_col: str, share_col: str, play: float = 0.02) -> DataFrame:
    """``split, rows, within, torn``: per wanted split its rows, whether its share of all rows is within ``play`` of the
    one wanted, and how many of its ids as written also have rows in another split."""
    ids = None
    for name, (df, key, id_col) in tables.items():
        side = df.select(F.lit(name).alias("table"), F.col(key).cast("long").alias("key"), tablet_id(id_col).alias("id"))
        ids = side if ids is None else ids.unionAll(side)
    by_id = assigned.join(ids, ["table", "key"]).groupBy("id", "split").agg(F.count(F.lit(1)).alias("n"))
    torn = by_id.where("id is not null").groupBy("id").agg(F.collect_set("split").alias("splits")).where("size(splits) > 1").select(F.explode("splits").alias("split"))
    torn = torn.groupBy("split").agg(F.count(F.lit(1)).alias("torn"))
    sizes = by_id.groupBy("split").agg(F.sum("n").alias("rows"))
    total = sizes.agg(F.sum("rows").alias("all"))
    wanted = targets.where(f"{split_col} is not null and {share_col} > 0").groupBy(F.col(split_col).alias("split")).agg(F.max(share_col).alias("share"))
    whole = wanted.agg(F.sum("share").alias("whole"))
    out = wanted.join(sizes, "split", "left").join(torn, "split", "left").crossJoin(total).crossJoin(whole)  # one row each
    rows = F.coalesce("rows", F.lit(0))
    return out.select("split", rows.alias("rows"), (F.abs(rows / F.col("all") - F.col("share") / F.col("whole")) <= play).alias("within"), F.coalesce("torn", F.lit(0)).alias("torn"))
