"""Running values over rows in order, without bringing the rows to one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairing import CHUNK, in_chunks

#: Associative combines: the aggregate over a stretch of rows, and of two stretches' values.
COMBINE: dict[str, tuple[Callable[[Column], Column], Callable[..., Column]]] = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def prefix_scan(df: DataFrame, order: list[str], values: dict[str, tuple[str, str]], by: list[str] | None = None, inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The rows of df with a running value for each entry of values, out: (combine, column): over the rows before it in order,
    and itself if inclusive, of its segment (equal columns `by`; all rows without). Null where there are none.

    Two levels: rows lie by chunk of consecutive places in order of (by, order) and are scanned there; a chunk's last segment
    goes on in the next, so the values that chunks carry over, a row a chunk, are scanned by segment and joined back by
    chunk. One shuffle of the rows, as what meets them lies by chunk too. Rows equal in by and order come in any order.
    """
    by = by or []
    d = in_chunks(df, *by, *order, name="_at", chunk=chunk)
    if "_chunk" not in d.columns:  # equal keys span chunks: places are known, chunks follow from them
        d = d.withColumn("_chunk", F.expr(f"_at div {chunk}"))
    segment = F.struct(*[F.col(c) for c in by], F.lit(0).alias("one"))
    d = d.withColumn("_segment", segment)
    inside = Window.partitionBy("_chunk", "_segment").orderBy("_at")
    for k, (combine, column) in enumerate(values.values()):
        of = COMBINE[combine][0](column)
        d = d.withColumn(f"_in{k}", of.over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        if not inclusive:
            d = d.withColumn(f"_before{k}", of.over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    ends = d.groupBy("_chunk").agg(F.min_by("_segment", "_at").alias("first"), F.max_by("_segment", "_at").alias("last"), *[F.max_by(f"_in{k}", "_at").alias(f"total{k}") for k in range(len(values))])
    # what a chunk's last segment has brought together up to its end, seen from the next chunk
    carried = Window.partitionBy("last").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = ends.select((F.col("_chunk") + 1).alias("_chunk"), F.col("last").alias("_carried"), *[COMBINE[c][0](f"total{k}").over(carried).alias(f"_c{k}") for k, (c, _) in enumerate(values.values())])
    d = d.join(carry, "_chunk", "left")
    same = F.col("_carried").eqNullSafe(F.col("_segment"))
    for k, (out, (combine, _)) in enumerate(values.items()):
        d = d.withColumn(out, COMBINE[combine][1](F.when(same, F.col(f"_c{k}")), F.col(f"_in{k}" if inclusive else f"_before{k}")))
    return d.select(*df.columns, *values)
