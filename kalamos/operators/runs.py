"""Statistics over runs: registry, seeds, interactions, qualitative picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the columns of the run registry, in order.
REGISTRY = (
    "run_id", "model_family", "model_size", "seed", "ablation", "config_path", "checkpoint_path", "summary_path",
    "independent_bleu", "independent_chrf", "independent_combined", "newtest_bleu", "newtest_chrf", "newtest_combined", "status", "notes",
)


def upsert_runs(registry: DataFrame, news: DataFrame, key: str = "run_id", columns: tuple[str, ...] = REGISTRY) -> DataFrame:
    """Rows of ``news`` replace those of the same key; columns in their fixed order, missing ones null."""
    kept = registry.join(news.select(key).distinct(), key, "left_anti")
    out = kept.unionByName(news, allowMissingColumns=True)
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in columns))


def seed_statistics(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """``runs, mean, sd`` over seeds; the spread of a single run is 0."""
    return runs.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def paired_deltas(runs: DataFrame, condition: str, baseline: str, value: str, *pairing: str) -> DataFrame:
    """Every run's value minus that of the baseline with the same pairing columns (size, seed, ...)."""
    base = runs.where(F.col(condition) == baseline).select(*pairing, F.col(value).alias("base"))
    rest = runs.where(F.col(condition) != baseline)
    return rest.join(base, list(pairing)).select(*pairing, condition, (F.col(value) - F.col("base")).alias("delta"))


def interactions(deltas: DataFrame, condition: str, size: str, small: str, large: str) -> DataFrame:
    """Per condition the mean delta at either size and their difference."""
    mean = lambda name: F.avg(F.when(F.col(size) == name, F.col("delta")))
    out = deltas.groupBy(condition).agg(mean(small).alias("small"), mean(large).alias("large"))
    return out.withColumn("interaction", F.col("small") - F.col("large"))


def sign_summary(df: DataFrame, value: str) -> DataFrame:
    """Counts of signs, the chance of unanimity under fair coins, least and mean size."""
    v = F.col(value)
    out = df.agg(F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), F.count(value).alias("n"), F.min(F.abs(v)).alias("least_abs"), F.avg(F.abs(v)).alias("mean_abs"))
    return out.withColumn("unanimous_p", F.pow(F.lit(0.5), F.col("n")))


def paper_numbers(runs: DataFrame, condition: str, baseline: str, size: str, seed: str, split: str, value: str) -> dict[str, DataFrame]:
    """The tables a report quotes: baselines per size and split, per-seed values, deltas with spread."""
    base = runs.where(F.col(condition) == baseline)
    deltas = paired_deltas(runs, condition, baseline, value, size, seed, split)
    return {
        "baselines": seed_statistics(base, value, size, split),
        "per_seed": base.select(size, seed, split, value),
        "deltas": seed_statistics(deltas, "delta", size, split, condition),
        "overall": deltas.groupBy(size, split).agg(F.avg("delta").alias("mean_delta")),
    }


def gap_to(df: DataFrame, value: str, constant: float) -> DataFrame:
    return df.withColumn("gap", F.col(value) - F.lit(constant))


def aligned_predictions(frames: dict[str, DataFrame], keys: list[str], column: str = "prediction") -> DataFrame:
    """All systems' predictions side by side, joined on the keys; repeated keys fan out."""
    sides = [df.select(*keys, F.col(column).alias(f"pred_{name}")) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, keys), sides)


def top_rows(df: DataFrame, condition: Column | None, order: list[Column], most: int = 8) -> DataFrame:
    """A category of examples: filtered, in an explicit order, the first few (a top-k plan, no full sort)."""
    return (df.where(condition) if condition is not None else df).orderBy(*order).limit(most)


def example_table(df: DataFrame, categories: dict[str, tuple[Column | None, list[Column]]], most: int = 8) -> DataFrame:
    """The first rows of every category, told apart by ``category``; a row may stand in several."""
    sides = [top_rows(df, condition, order, most).withColumn("category", F.lit(name)) for name, (condition, order) in categories.items()]
    return reduce(DataFrame.unionAll, sides)


# The scores, genres and lengths that make a sentence an example of its category.
READABLE = {"transliteration": (20, 200), "translation": (15, 200)}
FORMULAIC, LETTERS = ("debt-note", "memo"), ("letter",)
HIGH, VERY_HIGH, LOW, CHANGE = 40, 50, 15, 5


def contrasts(key: str, genre: str, full: str, other: str, part: str, small: str, small_changed: str, full_changed: str) -> dict[str, tuple[Column, list[Column]]]:
    """The categories of a comparison of systems, for :func:`example_table`; the arguments but the first two name score
    columns.  Where one system is far ahead, where a change helps the small system and harms the full one, formulaic
    texts that succeed, letters that fail, and what more data brings.  Equal rows stand in the order of the key."""
    c = F.col
    gain, loss = c(small_changed) - c(small), c(full_changed) - c(full)
    first = lambda order: [order, F.asc(key)]
    return {
        "system_gap": (c(full) > HIGH, first(F.desc(F.round(c(full) - c(other), 6)))),
        "change_by_size": ((gain > CHANGE) & (loss < -CHANGE), first(F.desc(F.round(gain - loss, 6)))),
        "formulaic_success": (c(genre).isin(*FORMULAIC), first(c(full).desc())),
        "letter_failure": (c(genre).isin(*LETTERS) & (c(full) > LOW) & (c(full) < HIGH), first(c(full).asc())),
        "more_data": (c(full) > VERY_HIGH, first(F.desc(F.round(c(full) - c(part), 6)))),
    }


def seed_curves(runs: DataFrame, value: str, point: str, *by: str) -> DataFrame:
    """Mean and spread along a scale (share of documents, learning rate, ...), with the single runs' least and most."""
    return runs.groupBy(*by, point).agg(
        F.count(value).alias("runs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most")
    )
