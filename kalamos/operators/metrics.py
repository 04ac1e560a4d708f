"""Corpus and sentence metrics as sums of per-sentence statistics.

BLEU (4-grams, 13a tokens, exponential smoothing, brevity penalty) and chrF++
(6 character and 2 word orders, beta 2) are closed forms over sums, so one
statistics table serves corpus scores, sentence scores, candidate selection
and the bootstrap.  The statistics come from one Arrow pass without a shuffle:
clipped counts of hundreds of n-grams per sentence would otherwise need as
many rows; everything after them is column arithmetic.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kalamos.operators.rows import first_seen

BLEU_ORDERS, CHAR_ORDERS, WORD_ORDERS, BETA = 4, 6, 2, 2.0
CHRF_ORDERS = CHAR_ORDERS + WORD_ORDERS
BLEU = [f"{kind}_{n}" for kind in ("match", "total") for n in range(1, BLEU_ORDERS + 1)] + ["hyp_len", "ref_len"]
CHRF = [f"{kind}_{n}" for kind in ("chrf_hyp", "chrf_ref", "chrf_match") for n in range(1, CHRF_ORDERS + 1)]
STATISTICS = BLEU + CHRF

_symbols = re.compile(r"([{-~\[-` -&(-+:-@/])")
_point_before = re.compile(r"([^0-9])([.,])")
_point_after = re.compile(r"([.,])([^0-9])")
_dash = re.compile(r"([0-9])(-)")


def tokens_13a(text: str) -> list[str]:
    """The common tokenisation of translations for BLEU, case kept."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, sign)
    text = _symbols.sub(r" \1 ", f" {text} ")
    text = _point_after.sub(r" \1 \2", _point_before.sub(r"\1 \2 ", text))
    return _dash.sub(r"\1 \2 ", text).split()


def _grams(units, n: int) -> Counter:
    return Counter(tuple(units[k : k + n]) if not isinstance(units, str) else units[k : k + n] for k in range(len(units) - n + 1))


def _word_units(text: str) -> list[str]:
    """Words with one punctuation mark split off: the last one, else the first one."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def pair_statistics(hypothesis: str, reference: str) -> list[int]:
    """All statistics of one sentence pair in the order of ``STATISTICS``."""
    one, two = tokens_13a(hypothesis), tokens_13a(reference)
    match, total = [], []
    for n in range(1, BLEU_ORDERS + 1):
        a = _grams(one, n)
        match.append(sum((a & _grams(two, n)).values()))
        total.append(max(0, len(one) - n + 1))
    hyp, ref, both = [], [], []
    flat_one, flat_two = "".join(hypothesis.split()), "".join(reference.split())
    words_one, words_two = _word_units(hypothesis), _word_units(reference)
    for side_one, side_two, orders in ((flat_one, flat_two, CHAR_ORDERS), (words_one, words_two, WORD_ORDERS)):
        for n in range(1, orders + 1):
            a, b = _grams(side_one, n), _grams(side_two, n)
            count = sum(b.values())
            hyp.append(sum(a.values()) if count else 0)
            ref.append(count)
            both.append(sum((a & b).values()))
    return [*match, *total, len(one), len(two), *hyp, *ref, *both]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hyps, refs = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        found = [pair_statistics(h or "", r or "") for h, r in zip(hyps, refs, strict=True)]
        columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(STATISTICS))]
        names = batch.schema.names[:-2]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=[*names, *STATISTICS])


def statistics(df: DataFrame, hypothesis: str, reference: str, *keep: str) -> DataFrame:
    """The kept columns and the statistics of every row; missing texts count as empty."""
    rows = df.select(*keep, F.col(hypothesis).alias("__hyp"), F.col(reference).alias("__ref"))
    schema = StructType([*(rows.schema[c] for c in keep), *(StructField(s, LongType()) for s in STATISTICS)])
    return rows.mapInArrow(_statistics, schema)


def _bleu(effective: bool) -> Column:
    matches = [F.col(f"match_{n}").cast("double") for n in range(1, BLEU_ORDERS + 1)]
    totals = [F.col(f"total_{n}").cast("double") for n in range(1, BLEU_ORDERS + 1)]
    logs, used, smooth = F.lit(0.0), F.lit(0), F.lit(1.0)
    for m, t in zip(matches, totals, strict=True):
        here = t > 0
        smooth = F.when(here & (m == 0), smooth * 2).otherwise(smooth)
        precision = F.when(m == 0, 100.0 / (smooth * F.greatest(t, F.lit(1.0)))).otherwise(100.0 * m / F.greatest(t, F.lit(1.0)))
        logs = logs + F.when(here, F.log(precision)).otherwise(0.0)
        used = used + here.cast("int")
    orders = F.greatest(used, F.lit(1)) if effective else F.lit(BLEU_ORDERS)
    h, r = F.col("hyp_len"), F.col("ref_len")
    brevity = F.when(h >= r, 1.0).when(h == 0, 0.0).otherwise(F.exp(1 - r / F.greatest(h, F.lit(1))))
    none = sum(matches[1:], matches[0]) == 0
    short = F.lit(False) if effective else used < BLEU_ORDERS
    return F.when(none | short, 0.0).otherwise(brevity * F.exp(logs / orders))


def _chrf() -> Column:
    precision, recall, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(1, CHRF_ORDERS + 1):
        h, r, m = F.col(f"chrf_hyp_{n}"), F.col(f"chrf_ref_{n}"), F.col(f"chrf_match_{n}")
        here = (h > 0) & (r > 0)
        precision = precision + F.when(here, m / h).otherwise(0.0)
        recall = recall + F.when(here, m / r).otherwise(0.0)
        used = used + here.cast("int")
    p, r = precision / F.greatest(used, F.lit(1)), recall / F.greatest(used, F.lit(1))
    low = BETA * BETA * p + r
    return F.when(low > 0, 100.0 * (1 + BETA * BETA) * p * r / low).otherwise(0.0)


def combined(bleu: Column, chrf: Column) -> Column:
    return F.sqrt(F.greatest(bleu * chrf, F.lit(0.0)))


def scored(sums: DataFrame, effective: bool = False) -> DataFrame:
    """``bleu, chrf, combined`` in place of the statistics."""
    out = sums.withColumns({"bleu": _bleu(effective), "chrf": _chrf()}).drop(*STATISTICS)
    return out.withColumn("combined", combined(F.col("bleu"), F.col("chrf")))


def corpus_scores(stats: DataFrame, *by: str) -> DataFrame:
    """Micro-averaged scores of all sentences, per group if asked."""
    return scored(stats.groupBy(*by).agg(*(F.sum(s).alias(s) for s in STATISTICS)))


def sentence_scores(stats: DataFrame) -> DataFrame:
    return scored(stats, effective=True)


def pick_candidates(df: DataFrame, key: str, candidates: str, most: int = 32) -> DataFrame:
    """Per key the candidate with the highest mean sentence chrF++ against the others (the first of equals); distinct
    stripped candidates only, at most ``most``, so a key never yields more than ``most`` squared pairs."""
    kept = df.select(key, first_seen(F.col(candidates), most).alias("c"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    one = kept.repartition(2 * cores)  # few bytes, much work: a fixed number of parts, which are not merged again
    one = one.select(key, "c", F.posexplode("c").alias("i", "hyp"))
    pairs = one.select(key, "i", "hyp", F.posexplode("c").alias("j", "ref")).where("i <> j")
    scores = sentence_scores(statistics(pairs, "hyp", "ref", key, "i", "hyp"))
    means = scores.groupBy(key, "i", "hyp").agg(F.round(F.avg("chrf"), 10).alias("mean"))
    best = means.groupBy(key).agg(F.max_by("hyp", F.struct("mean", (-F.col("i")).alias("first"))).alias("picked"))
    return kept.join(best, key, "left").select(key, F.coalesce("picked", F.get("c", F.lit(0)), F.lit("")).alias("picked"))


def check_alignment(one: DataFrame, two: DataFrame, order: str, doc: str) -> None:
    """Two prediction tables speak of the same documents in the same order."""
    left, right = one.select(order, F.col(doc).alias("d1")), two.select(order, F.col(doc).alias("d2"))
    bad = left.join(right, order, "full").where("not (d1 <=> d2)").limit(1).count()
    if bad:
        raise ValueError("the tables differ in rows or in the order of documents")


def hashed_draws(rows: DataFrame, key: str, rounds: int, seed: int, count: int) -> DataFrame:
    """``resample, key, weight``: how often each round draws each row; draws are digests, the same in any engine.
    Row keys must run from 0 to ``count`` - 1."""
    draws = rows.select(F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("resample"), F.col(key).alias("slot"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "resample", "slot")), 1, 12), 16, 10).cast("long")
    return draws.select("resample", (digest % count).alias(key)).groupBy("resample", key).agg(F.count(F.lit(1)).alias("weight"))


def numpy_draws(spark, count: int, rounds: int = 2000, seed: int = 12345) -> DataFrame:
    """The draws of NumPy's default generator; both systems use the same.  For counts that fit the driver."""
    if count * rounds > 50_000_000:
        raise ValueError("too many draws for the driver: use hashed draws")
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(rounds):
        idx, weight = np.unique(rng.integers(0, count, count), return_counts=True)
        rows.append(pa.table({"resample": pa.array([k] * len(idx), pa.int64()), "idx": pa.array(idx, pa.int64()), "weight": pa.array(weight, pa.int64())}))
    return spark.createDataFrame(pa.concat_tables(rows))


def _weighted_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of both systems' statistics under the weights of every round, one row a round and task: a matrix product."""
    total = np.zeros((0, 2 * len(STATISTICS)))
    for batch in batches:
        if not batch.num_rows:
            continue
        matrix = np.hstack([batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("one", "two")]).astype(float)
        rounds, offsets = batch.column("rounds").flatten().to_numpy(), np.append(0, np.cumsum(batch.column("rounds").value_lengths().to_numpy()))
        weight = batch.column("weights").flatten().to_numpy()
        size = max(len(total), int(rounds.max()) + 1)
        drawn = np.zeros((size, batch.num_rows))
        drawn[rounds, np.repeat(np.arange(batch.num_rows), np.diff(offsets))] = weight
        sums = drawn @ matrix
        sums[: len(total)] += total
        total = sums
    some = np.flatnonzero(total.any(axis=1))
    n = len(STATISTICS)
    sides = [pa.FixedSizeListArray.from_arrays(pa.array(total[some][:, k : k + n].astype(np.int64).ravel()), n).cast(pa.list_(pa.int64())) for k in (0, n)]
    yield pa.RecordBatch.from_arrays([pa.array(some), *sides], names=["resample", "one", "two"])


def resampled(stats: DataFrame, draws: DataFrame, key: str, system: str, one: str, two: str) -> DataFrame:
    """``resample, system`` and the statistics summed under the draws' weights.

    The draws of a row are gathered once (about as many as there are rounds), and each task multiplies its rows'
    statistics by their weights in all rounds, so what is shuffled is one row a round and task."""
    side = lambda name, to: stats.where(F.col(system) == name).select(key, F.array(*STATISTICS).alias(to))
    lists = draws.groupBy(key).agg(F.collect_list(F.struct("resample", "weight")).alias("d"))
    lists = lists.select(key, F.col("d.resample").alias("rounds"), F.col("d.weight").alias("weights"))
    rows = side(one, "one").join(side(two, "two"), key).join(lists, key).select("one", "two", "rounds", "weights")
    sums = rows.mapInArrow(_weighted_sums, "resample long, one array<long>, two array<long>")
    both = sums.select("resample", F.lit(one).alias(system), F.col("one").alias("s")).unionAll(sums.select("resample", F.lit(two).alias(system), F.col("two").alias("s")))
    return both.groupBy("resample", system).agg(*(F.sum(F.get("s", F.lit(k))).alias(name) for k, name in enumerate(STATISTICS)))


def paired_bootstrap(stats: DataFrame, draws: DataFrame, key: str, system: str, one: str, two: str) -> DataFrame:
    """One row: both observed scores, their difference, its 95 % interval and sign-flip share over the resamples.

    ``stats`` holds both systems' statistics per row key.  Instead of scoring every resample's sentences again, the
    statistics are summed under the draws' weights."""
    weighted = resampled(stats, draws, key, system, one, two)
    side = lambda df, name: df.where(F.col(system) == name).select(*([] if df is seen else ["resample"]), F.col("combined").alias(name))
    seen = corpus_scores(stats, system)
    rounds = scored(weighted)
    delta = side(rounds, one).join(side(rounds, two), "resample").select((F.col(one) - F.col(two)).alias("d"))
    observed = side(seen, one).crossJoin(side(seen, two)).withColumn("delta", F.col(one) - F.col(two))  # one row each
    spread = delta.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.avg((F.col("d") <= 0).cast("double")).alias("not_above"), F.avg((F.col("d") >= 0).cast("double")).alias("not_below"), F.count(F.lit(1)).alias("resamples"))
    flip = F.when(F.col("delta") > 0, F.col("not_above")).otherwise(F.col("not_below"))
    return observed.crossJoin(spread).select(F.col(one).alias("score_one"), F.col(two).alias("score_two"), "delta", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), flip.alias("p"), "resamples")


def best_rows(df: DataFrame, by: str, order: list[Column], most: int = 1) -> DataFrame:
    """The first ``most`` rows of every group in an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
