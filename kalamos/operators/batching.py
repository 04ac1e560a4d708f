"""From texts to padded batches: byte ids, length-bucketed order, accumulation schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalamos.operators.splits import hash_rank

PAD, EOS, BYTE_OFFSET, IGNORED = 0, 1, 3, -100


def byte_ids(text: Column, most: int) -> Column:
    """UTF-8 bytes shifted past the special ids, cut to ``most`` with the end mark last."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("([0-9A-F]{2})"), F.lit(1))
    ids = F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int") + BYTE_OFFSET)
    return F.concat(F.slice(ids, 1, most - 1), F.array(F.lit(EOS)))


def padded(ids: Column, size: Column | int, pad: int = PAD) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(ids, F.array_repeat(F.lit(pad), (size - F.size(ids)).cast("int")))


def attention(ids: Column, pad: int = PAD) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def labels(ids: Column, pad: int = PAD) -> Column:
    """Padding does not count in the loss."""
    return F.transform(ids, lambda x: F.when(x == pad, IGNORED).otherwise(x))


def fixed_length(df: DataFrame, source: str, target: str, source_size: int, target_size: int, prefix: str = "") -> DataFrame:
    """``input_ids, attention_mask, labels`` padded to fixed sizes."""
    one = padded(byte_ids(F.concat(F.lit(prefix), F.col(source)), source_size), source_size)
    two = padded(byte_ids(F.col(target), target_size), target_size)
    return df.withColumns({"input_ids": one, "labels": labels(two)}).withColumn("attention_mask", attention(F.col("input_ids")))


def dynamic_length(df: DataFrame, batch: str, source: str, target: str, source_size: int, target_size: int, prefix: str = "") -> DataFrame:
    """The same padded to the longest row of each batch."""
    out = df.withColumns({"__s": byte_ids(F.concat(F.lit(prefix), F.col(source)), source_size), "__t": byte_ids(F.col(target), target_size)})
    w = Window.partitionBy(batch)
    out = out.withColumns({"__a": F.max(F.size("__s")).over(w), "__b": F.max(F.size("__t")).over(w)})
    out = out.withColumns({"input_ids": padded(F.col("__s"), F.col("__a")), "labels": labels(padded(F.col("__t"), F.col("__b")))})
    return out.withColumn("attention_mask", attention(F.col("input_ids"))).drop("__s", "__t", "__a", "__b")


def sortish(df: DataFrame, key: str, length: str, batch_size: int, mega: int = 50, seed: int = 42) -> DataFrame:
    """A random order cut into stretches of ``batch_size * mega`` rows, each sorted by length (longest first), cut into
    batches.  The random order ranks digests within 4096 ranges, so no task sorts everything."""
    from kalamos.operators.splits import ranked

    rank = ranked(df, key, seed).select(key, (F.col("rank") - 1).alias("__r"), "total")
    out = df.join(rank, key).withColumn("mega_batch", F.floor(F.col("__r") / (batch_size * mega)))
    inside = F.row_number().over(Window.partitionBy("mega_batch").orderBy(F.desc(length), hash_rank(seed, key), key)) - 1
    out = out.withColumn("position", F.col("mega_batch") * (batch_size * mega) + inside)
    return out.withColumn("batch", F.floor(F.col("position") / batch_size)).drop("__r")


def drop_last(df: DataFrame, batch_size: int, total: str = "total") -> DataFrame:
    """Without the last, partial batch, unless it is the only one."""
    whole = F.floor(F.col(total) / batch_size)
    return df.where((F.col(total) < batch_size) | (F.col("batch") < whole))


def accumulation(df: DataFrame, position: str, total: str, accumulate: int) -> DataFrame:
    """Each micro-batch's optimizer step and scale; the trailing window scales by its own size."""
    rest = F.col(total) % accumulate
    trailing = F.col(position) >= F.col(total) - rest
    size = F.when((rest > 0) & trailing, rest).otherwise(accumulate)
    return df.withColumns({"optimizer_step": F.floor(F.col(position) / accumulate), "window_size": size.cast("long"), "scale": 1.0 / size})


def steps_per_epoch(batches: Column | int, accumulate: int) -> Column:
    return F.ceil((F.lit(batches) if isinstance(batches, int) else batches) / accumulate)
