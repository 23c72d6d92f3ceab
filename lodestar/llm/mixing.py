"""Mixing sources to target weights.

Every document gets a hash-random key; within its source the documents are dealt over slices of the key range, sorted
inside each slice, and prefix sums of the sizes are put together from slice totals and sums inside slices. A source's
budget is then cut exactly: as many whole epochs as fit, and the part of one more up to the document where the prefix
sum reaches the budget. Only ids, sources, sizes and keys are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pairing import with_row_index
from .common import WORD, aliased, cut, pick, restored

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Hex digits of the key that name its slice: 16^3 slices a source.
SLICE_DIGITS = 3
#: Up to so many sources (a hundred bytes each) their cuts are broadcast; beyond, the join is salted.
BROADCAST_SOURCES, SALTS = 100_000, 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source (columns s_null, s): source_size, target. Sources take the repeating weights in code point order, null last.

    Targets share `share` times all sizes by weight; those above `most` times their source's size stop there and the
    excess goes to the rest by weight. That is target = min(cap, weight * level) with one level for all: what the sources
    below their caps share of what the others leave, found by rounds of one sum over all sources in which those that the
    level lifts to their cap stop there. A level only rises, so a round that stops none is the last; it is the level of
    the sources sorted by cap / weight. Works on one row per source, however many: they are numbered over ranges.
    """
    per = with_row_index(sizes.groupBy("s_null", "s").agg(F.sum("size").alias("source_size")), "s_null", "s", name="k", narrow=True)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("k", F.lit(len(weights))) + 1).cast("int")))
    per = cut(per.withColumn("cap", F.col("source_size") * F.lit(float(most))))
    everything = float(per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, stopped = 0.0, -1
    while True:
        at_cap = F.col("cap") < F.lit(level) * F.col("weight")
        r = per.agg(F.sum(F.when(at_cap, 1).otherwise(0)).alias("n"), F.sum(F.when(at_cap, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))).alias("rest")).first()
        if not r["rest"]:  # all stop at their caps, or there are none
            level = float("inf")
            break
        if r["n"] == stopped:
            break
        level, stopped = (everything - r["caps"]) / r["rest"], r["n"]
    return per.select("s_null", "s", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per row: id, size (words), source_size, target, taken (words the mix takes, repeats counted), epochs (whole passes).

    Null text has size 0. Null sources form one source, last in order. The key is a hash of seed, id (null ids as an id of
    their own) and size; rows with equal ids and sizes are interchangeable, so reruns agree. Empty tables give empty results; further columns are not read.
    """
    d = cut(sized(pick(df, {"doc_id": id_col, "source": source_col, "text": text_col}), seed))
    d = dealt(d, weights, share, most)
    return d.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken", "epochs")


def sized(d: DataFrame, seed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    d = d.select(
        *keep, "doc_id", F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
    )
    return d.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string")).cast("binary")))


def dealt(d: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Prefix sums over the sized rows, and what the mix takes of each."""
    d = d.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    targets = source_targets(d, weights, share, most)
    slices = d.groupBy("s_null", "s", "slice").agg(F.sum("size").alias("total"))
    offset = F.coalesce(F.sum("total").over(Window.partitionBy("s_null", "s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select("s_null", "s", "slice", offset.alias("offset"))
    slices = slices.join(targets, ["s_null", "s"])
    inside = Window.partitionBy("s_null", "s", "slice").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(inside)).join(slices, ["s_null", "s", "slice"])
    d = d.withColumn("budget", F.floor("target")).withColumn("before", F.col("offset") + F.col("upto") - F.col("size"))
    d = d.withColumn("epochs", F.expr("case when source_size > 0 then budget div source_size else 0 end"))
    return d.withColumn("taken", F.expr("epochs * size + greatest(0L, least(size, budget - epochs * source_size - before))"))


def repeat_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of df, all columns as they are, as often as the mix takes them: once for each whole epoch, and once more
    up to the document where the source's budget is cut (that one whole). Each source's cut is one key, joined back to
    the rows by source, so no text is shuffled. Rows without words, null texts too, come along with whole epochs only;
    null ids and sources, repeated rows and empty tables are as in mix(); columns of any name pass through."""
    plain = pick(df, {"doc_id": id_col, "source": source_col, "text": text_col})
    at = F.struct("key", "size", "doc_id")
    taken = dealt(cut(sized(plain, seed)), weights, share, most)
    cuts = cut(taken.groupBy("s_null", "s").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("taken") > F.col("epochs") * F.col("size"), at)).alias("last")))
    d, back = aliased(df)
    name = {c: n for n, c in back.items()}
    d = sized(d.withColumn("doc_id", F.col(name[id_col])).withColumn("source", F.col(name[source_col])).withColumn("text", F.col(name[text_col])), seed, tuple(back))
    if cuts.count() <= BROADCAST_SOURCES:
        d = d.join(F.broadcast(cuts), ["s_null", "s"])
    else:
        d = d.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
        d = d.join(cuts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["s_null", "s", "salt"])
    times = F.col("epochs") + F.when(F.coalesce(at <= F.col("last"), F.lit(False)) & (F.col("size") > 0), 1).otherwise(0)
    d = d.withColumn("n", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return restored(d, back)


def oracle_sql() -> str:
    case = " ".join(f"when {i} then {float(w)}" for i, w in enumerate(WEIGHTS))
    return rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
             md5(concat('{SEED}:', coalesce(cast(doc_id as varchar), 'null'), ':', cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as varchar))) as key from documents),
per as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
c as (select source, source_size, source_size * {float(MOST)}::double as cap, (case k % {len(WEIGHTS)} {case} end)::double as weight from per),
a as (select *, (sum(source_size) over () * {SHARE}::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
             / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as lev,
             row_number() over (order by cap / weight, source nulls last) as r from c),
l as (select arg_min(lev, r) as level from a where lev * weight <= cap),
t as (select source, source_size, least(cap, coalesce(level * weight, cap)) as target from a left join l on true),
f as (select d.*, source_size, target, cast(floor(target) as bigint) as budget,
             cast(sum(size) over (partition by d.source order by key, size, doc_id rows between unbounded preceding and current row) as bigint) - size as before
      from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from f)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) as bigint) as taken, cast(epochs as bigint) as epochs from e
"""
