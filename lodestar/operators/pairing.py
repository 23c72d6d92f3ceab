"""Row order as data, and the ways two tables are paired."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows that are numbered together, and the most such chunks: beyond, chunks grow, as one key a chunk is sent to all tasks.
CHUNK, MOST_CHUNKS = 512, 1 << 18
#: A key that holds more than this share of a side's rows is split into so many parts as it has shares of this size.
HEAVY_SHARE, MOST_PARTS = 0.02, 64


def with_row_index(df: DataFrame, *keys: str, name: str = "row_idx", total: str | None = None, narrow: bool = False) -> DataFrame:
    """Consecutive numbers from 0 in order of the keys, without bringing the rows to one task; total: a column with the number
    of all rows.

    Keys alone are sorted over ranges and kept by a checkpoint (_sorted). A table of keys is then done; the rows of another
    go once, by what its border keys say, to the chunk that holds their numbers (in_chunks). Rows of equal keys come in any
    order. df is read twice, so it gives the same rows each time; where ties span chunks, whole rows are sorted and kept.
    """
    if set(df.columns) <= set(keys):
        return _sorted(df, keys, name, total)
    return in_chunks(df, *keys, name=name, total=total).drop("_chunk")


def _ranged(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows sorted over ranges and kept, with their range (_p) and place (_at)."""
    return cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())).withColumn("_p", F.shiftrightunsigned("_at", 33))


def _placed(d: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    return d.join(F.broadcast(ranges), "_p").withColumn(name, F.col("_b") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_b")


def _sorted(df: DataFrame, keys: tuple[str, ...], name: str, total: str | None = None) -> DataFrame:
    """Rows sorted over ranges are numbered where they are; the counts of the ranges before are added: a table of one row a
    range, so small that it is broadcast."""
    d = _ranged(df, keys)
    ranges = d.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_p", before.alias("_b"), *([F.sum("_n").over(Window.partitionBy(F.lit(0))).alias(total)] if total else []))
    return _placed(d, ranges, name)


def _numbered(df: DataFrame, keys: tuple[str, ...], name: str) -> tuple[DataFrame, int]:
    """_sorted(), and the number of rows, which the driver then knows: from the counts, one a range."""
    d = _ranged(df, keys)
    counts = sorted((r["_p"], r["n"]) for r in d.groupBy("_p").agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    ranges = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_p bigint, _b bigint")
    return _placed(d, ranges, name), before[-1]


def in_chunks(df: DataFrame, *keys: str, name: str = "row_idx", total: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """with_row_index(), of rows that lie by chunk of `chunk` consecutive numbers: column _chunk, by which they are
    partitioned, so that windows, groups and joins by it need no shuffle. Numbers k * chunk to (k + 1) * chunk - 1 are chunk
    k in every table, as chunks begin at exact keys. Without _chunk where equal keys span two chunks."""
    return _chunked(df, keys, name, total, chunk)[0]


def _chunked(df: DataFrame, keys: tuple[str, ...], name: str, total: str | None, chunk: int) -> tuple[DataFrame, int]:
    places, n = _numbered(cut(df.select(*keys)), keys, "_place")  # kept first, as sorting over ranges reads its input twice
    chunk *= -(-max(1, n) // (chunk * MOST_CHUNKS))
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    # the last row before a border and the first after it; the last of all may end a chunk that no other follows
    ends = places.where(F.expr(f"_place >= {chunk - 1} and (_place + 1) % {chunk} <= 1")).groupBy(F.expr(f"(_place + 1) div {chunk}").alias("_c"))
    ends = ends.agg(F.min_by(key, "_place").alias("a"), F.max_by(key, "_place").alias("b"), F.count("*").alias("m")).where("m = 2")
    ends = ends.agg(F.array_sort(F.collect_list("b")).alias("borders"), F.coalesce(F.bool_or(F.col("a") == F.col("b")), F.lit(False)).alias("tied"))
    found = ends.first()
    if found["tied"]:
        return _sorted(df, keys, name, total), n
    borders = df.sparkSession.createDataFrame([(found["borders"],)], ends.select("borders").schema)  # MOST_CHUNKS keys at most
    steps = [1 << b for b in range(max(1, n // chunk).bit_length() - 1, -1, -1)]
    d = df.withColumn("_borders", borders.scalar()).withColumn("_key", key)
    # The key is handed from step to step, as Spark numbers arguments of lambdas anew from 0 where it compares expressions, and
    # takes a column that a lambda names for one of them if its number is as low, as in an application's first query: _chunk
    # would seem to need no column and be asked for where there is none. Borders, as they are many, would be copied each time.
    step = "a.lo + if(coalesce(get(_borders, cast(a.lo + s - 1 as int)) <= a.key, false), s, 0L)"
    search = f"aggregate(array({', '.join(f'{s}L' for s in steps)}), struct(0L as lo, _key as key), (a, s) -> struct({step} as lo, a.key as key), a -> a.lo)"
    d = d.withColumn("_chunk", F.expr(search)).drop("_borders", "_key")
    d = d.withColumn(name, F.row_number().over(Window.partitionBy("_chunk").orderBy(*keys)) - 1 + F.col("_chunk") * chunk)
    return (d.withColumn(total, F.lit(n).cast("bigint")) if total else d), n


def zip_sorted(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], mode: str = "truncate", name: str = "row_idx", chunk: int = CHUNK) -> DataFrame:
    """Pair the rows of two tables by their places in order of their keys: column `name`, those of left, those of right. Modes
    as in positional(). Both tables lie by chunk, so each is shuffled once; a chunk's rows meet as two arrays."""
    if mode not in ("truncate", "min", "strict", "left"):
        raise ValueError(f"no such mode: {mode}")
    (a, n), (b, m) = _chunked(left, tuple(left_keys), name, None, chunk), _chunked(right, tuple(right_keys), name, None, chunk)
    if mode == "strict" and n != m:
        raise ValueError(f"tables differ in length: {n} and {m}")
    if mode == "left" and n > m:
        raise ValueError("the right table is too short")
    if "_chunk" not in a.columns or "_chunk" not in b.columns or max(n, m) > chunk * MOST_CHUNKS:
        return positional(a.drop("_chunk"), b.drop("_chunk"), "truncate", name)
    a, b = (d.groupBy("_chunk").agg(F.array_sort(F.collect_list(F.struct(name, *[F.col(f"`{c}`") for c in d.columns if c not in (name, "_chunk")]))).alias(x)) for d, x in ((a, "_a"), (b, "_b")))
    d = a.join(b, "_chunk").select(F.explode(F.expr("slice(arrays_zip(_a, _b), 1, least(size(_a), size(_b)))")).alias("_z"))
    return d.select(F.col(f"_z._a.{name}").alias(name), *[F.col(f"_z._a.`{c}`").alias(c) for c in left.columns], *[F.col(f"_z._b.`{c}`").alias(c) for c in right.columns])


def heavy_keys(df: DataFrame, key: Column, share: float = HEAVY_SHARE) -> dict[int, int]:
    """Hashes of the keys that hold more than `share` of the rows (null is one), each with the number of parts that its rows
    are to be split into. One pass with a sketch of frequent items; at most 1 / share keys come back."""
    r = df.select(F.xxhash64(key).alias("h")).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {int(1 / share)}, {int(8 / share)})").alias("top")).first()
    return {t["item"]: min(MOST_PARTS, int(t["count"] / (share * r["n"])) + 1) for t in r["top"] or [] if t["count"] > share * r["n"]}


def key_join(left: DataFrame, right: DataFrame, key: str, skewed: bool = False) -> DataFrame:
    """Inner equi-join in which null keys meet, duplicates multiply, and other shared columns get _x and _y.

    skewed: keys that hold a large share of left's rows are found by a sketch first; their rows are dealt over parts, and
    right's rows with such a key are repeated for each part. So the largest task has a bounded share of left, however the
    keys are spread, and no setting of the session is needed. Null keys are one such key where they are many."""
    shared = (set(left.columns) & set(right.columns)) - {key}
    a = left.select([F.col(c).alias(f"{c}_x" if c in shared else c) for c in left.columns])
    b = right.select([F.col(c).alias("_key" if c == key else f"{c}_y" if c in shared else c) for c in right.columns])
    same = F.col(key).eqNullSafe(F.col("_key"))
    heavy = heavy_keys(left, F.col(key)) if skewed else {}
    if not heavy:
        return a.join(b, same).drop("_key")
    parts = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])

    def split(c: str) -> Column:
        return F.coalesce(F.try_element_at(parts, F.xxhash64(c)), F.lit(1))

    # a part is named by the row's other columns too, so that a task that runs again deals the same
    a = a.withColumn("_part", F.pmod(F.xxhash64(*[c for c in a.columns], F.monotonically_increasing_id()), split(key)).cast("int"))
    b = b.withColumn("_part_y", F.explode(F.sequence(F.lit(0), split("_key") - 1)))
    return a.join(b, same & (F.col("_part") == F.col("_part_y"))).drop("_key", "_part", "_part_y")


def positional(left: DataFrame, right: DataFrame, mode: str = "truncate", index: str = "row_idx") -> DataFrame:
    """Pair rows of equal index. Modes: truncate and min (to the shorter), strict (equal counts or an error), left (every
    left row, an error where the right side is too short)."""
    if mode in ("truncate", "min"):
        return left.join(right, index)
    if mode == "strict":
        n, m = left.count(), right.count()
        if n != m:
            raise ValueError(f"tables differ in length: {n} and {m}")
        return left.join(right, index)
    if mode == "left":
        marked = right.withColumn("_there", F.lit(True))
        d = left.join(marked, index, "left").withColumn("_ok", F.assert_true(F.col("_there").isNotNull(), "the right table is too short"))
        return d.where(F.col("_ok").isNull()).drop("_there", "_ok")
    raise ValueError(f"no such mode: {mode}")


def first_match(left: DataFrame, right: DataFrame, key: str, order: str | Column) -> DataFrame:
    """Inner lookup join with the first right row of each key; the first are found before anything is shuffled, and again
    after."""
    rest = [c for c in right.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(order))
    return left.join(right.groupBy(key).agg(first.alias("_f")).select(key, *[F.col("_f")[c].alias(c) for c in rest]), key)


def existing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def dimensions(versions: DataFrame, projects: DataFrame) -> DataFrame:
    """Every version with every project: two small constant tables, one row a run of the evaluation. Which of them is
    broadcast, if any, is left to Spark, which knows their sizes."""
    return versions.crossJoin(projects)


def head(df: DataFrame, n: int | None, index: str = "row_idx") -> DataFrame:
    """The first n rows by index; None and 0 mean all. A filter, so it moves below joins."""
    return df.where(F.col(index) < n) if n else df


def zip_arrays(df: DataFrame, *columns: str) -> DataFrame:
    """One row per position of parallel arrays, as far as the shortest goes."""
    n = F.least(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    cut_to = F.arrays_zip(*[F.slice(c, 1, n).alias(c) for c in columns])
    return df.withColumn("_z", F.explode(cut_to)).select(*[c for c in df.columns if c not in columns], *[F.col(f"_z.{c}").alias(c) for c in columns])
