"""Length limits, label masks and padded batches over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairing import CHUNK, in_chunks

IGNORE = -100


def length_filter(df: DataFrame, limit: int = 512, inputs: str = "inputs") -> DataFrame:
    return df.where(F.size(inputs) <= limit)


def prefix_fallback(inputs: Column, prefix: Column, limit: int) -> Column:
    return F.when(F.size(inputs) > limit, prefix).otherwise(inputs)


def truncated_outputs(inputs: Column, outputs: Column, limit: int = 512) -> Column:
    return F.slice(outputs, 1, F.greatest(F.lit(0), F.lit(limit) - F.size(inputs)))


def repeat(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), n)


def train_example(df: DataFrame, inputs: str = "inputs", outputs: str = "outputs") -> DataFrame:
    """input_ids = inputs + outputs; labels masked over the inputs; attention 1 everywhere."""
    i, o = F.col(inputs), F.col(outputs)
    return df.withColumn("input_ids", F.concat(i, o)).withColumn("labels", F.concat(repeat(IGNORE, F.size(i)), o)).withColumn("attention_mask", repeat(1, F.size(i) + F.size(o)))


def decode_example(df: DataFrame, inputs: str = "inputs", outputs: str = "outputs") -> DataFrame:
    return df.withColumn("input_ids", F.col(inputs)).withColumn("labels", F.col(outputs)).withColumn("attention_mask", repeat(1, F.size(inputs)))


def prompt_of(input_ids: Column, labels: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(input_ids.alias("i"), labels.alias("l")), lambda z: z["l"] == IGNORE), lambda z: z["i"])


def target_of(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != IGNORE)


def generated(output: Column, prompt_size: Column) -> Column:
    """What follows the prompt."""
    return F.slice(output, prompt_size + 1, F.greatest(F.size(output), F.lit(1)))


def with_batch(df: DataFrame, size: int, index: str = "row_idx") -> DataFrame:
    return df.withColumn("batch_id", F.floor(F.col(index) / size))


def batched(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows in order of the keys with row_idx and batch_id: batches of `size` consecutive rows, the last one shorter. Rows lie
    by chunk of whole batches (column _chunk), so what is done by batch from here on shuffles nothing."""
    return with_batch(in_chunks(df, *keys, chunk=size * max(1, CHUNK // size)), size)


def with_longest(df: DataFrame, batch: str, **arrays: str) -> DataFrame:
    """Rows with the sizes of their batch's longest arrays. Rows that lie by chunk of whole batches (batched()) stay where they
    are; for others a number a batch is joined back, so that arrays are not shuffled where these are few enough to broadcast."""
    if "_chunk" in df.columns:
        whole = Window.partitionBy("_chunk", batch)
        for n, c in arrays.items():
            df = df.withColumn(n, F.max(F.size(c)).over(whole))
        return df
    longest = df.groupBy(batch).agg(*[F.max(F.size(c)).alias(n) for n, c in arrays.items()])
    return df.join(longest, batch)


def pad_right(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """ids with 0, labels with -100, mask with 0, all to the longest ids of the batch."""
    d = with_longest(df, batch, _m="input_ids")
    for c, v in (("input_ids", 0), ("labels", IGNORE), ("attention_mask", 0)):
        d = d.withColumn(c, F.concat(F.col(c), repeat(v, F.col("_m") - F.size(c))))
    return d.select(*df.columns)


def pad_left(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """ids and mask to the longest ids, labels to the longest labels of the batch."""
    d = with_longest(df, batch, _m="input_ids", _l="labels")
    for c, v, m in (("input_ids", 0, "_m"), ("attention_mask", 0, "_m"), ("labels", IGNORE, "_l")):
        d = d.withColumn(c, F.concat(repeat(v, F.col(m) - F.size(c)), F.col(c)))
    return d.select(*df.columns)
