"""Oracles found by similarity of test prefixes: an index over weighted token sets, searched for many prefixes at once by joins.

A prefix is the set of its tokens; a token weighs the more the fewer rows have it; two sets are as alike as the weight of what
they share is of the weight of both (weighted Jaccard). The index holds each distinct set once, under those of its tokens,
heaviest first, by which anything alike enough must meet it: what follows them is too light. A token of one row alone names
its set; the sets of any other lie in blocks of like sets with bounds (least total, most weight left, first id), so a search

1. takes the best blocks of each of a query's tokens by these bounds and compares the first of their sets, which gives a
   similarity and an id that an answer must beat,
2. joins the query's tokens with those blocks whose bounds beat that, and inside them with those sets whose bounds do,
3. compares what is left and keeps the best k, of equal ones the least ids.

Bounds know of a query no more than a token, its weights and what to beat, so queries that agree in these meet the blocks as
one. Nothing alike enough is lost, and a template that a large part of the rows share is settled by its first blocks: later
ones can only tie with larger ids. Equal sets are searched for once, on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship
from .pairing import key_join

#: Words, and every other character that is no white space.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t-\r]"
#: Sets in a block, a power of two.
BLOCK = 256
#: Room for rounding in bounds; exact similarities decide.
SLACK = 1 - 1e-9
#: Frequent terms that are sent to all tasks, at most; and rows of a table that is.
MOST_TERMS, SMALL = 200_000, 100_000
#: Words of 64 bits in a sieve, at most, as a power of two.
SIEVE = 20


def tokens(text: Column) -> Column:
    """The distinct tokens of a text, in order; none of a null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))))


@dataclass
class Index:
    """terms: token, weight, frequent, of tokens of two rows or more. sets: set, first, members (id, value: the first `depth`
    of the set's rows), total, tokens and weights, heaviest first. lone: token, set, first, total, rest, of tokens of one row.
    blocks: token, block, lo, rest, first, entries. rows: how many rows were indexed."""

    terms: DataFrame
    sets: DataFrame
    lone: DataFrame
    blocks: DataFrame
    rows: int
    depth: int
    least: float


def weight(rows: int, having: Column) -> Column:
    """Whole thousandths, so that sums are exact; 1 at least."""
    return F.floor(1000.0 * F.log(F.lit(float(rows)) / having)) + 1


def _small(d: DataFrame) -> DataFrame:
    """d, kept, to be broadcast where it has few rows."""
    return F.broadcast(d) if d.count() <= SMALL else d


def _among(d: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of d that a join with keys by this column needs, found before d is shuffled: just these where keys are few,
    else they and about one in 16 of the others, by a bit for the hash of each key. The bits are sent to all tasks; from 4
    million keys on they let more of the others pass, and none is lost."""
    keys = keys.select(key)
    n = keys.count()
    if n <= SMALL:
        return d.join(F.broadcast(keys), key, "left_semi")
    bit = F.pmod(F.xxhash64(key), F.lit(64 << min(SIEVE, (n // 4).bit_length())))
    bits = keys.select(bit.alias("_bit")).groupBy(F.expr("_bit div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits"))
    met = d.withColumn("_bit", bit).join(F.broadcast(bits), F.expr("_bit div 64 = _word"))
    return met.where("getbit(_bits, cast(_bit % 64 as int)) = 1").select(*d.columns)


def _weighed(sets: DataFrame, name: str, terms: DataFrame, rows: int, least: float) -> DataFrame:
    """sets (words: tokens in order, joined by blanks, and further columns) with their number, total, tokens and weights,
    heaviest first, of equal ones in order, and posts: token, rest (its weight and that of those after it) and lone of the
    tokens by which anything alike enough meets the set. Tokens that no two indexed rows have weigh what the rarest do. Frequent
    terms are sent to all tasks, others joined."""
    spark = sets.sparkSession
    ship(spark)
    d = sets.withColumn(name, F.monotonically_increasing_id())
    known = terms.where("frequent").select("token", F.col("weight").cast("bigint")).toArrow()
    sent = spark.sparkContext.broadcast((known["token"].combine_chunks(), known["weight"].to_numpy()))
    rare = terms.where("not frequent").select("token", "weight")
    rest_of = [c for c in d.columns if c != "words"]
    if not rare.isEmpty():
        d = cut(d)
        each = d.select(name, F.explode(F.split("words", " ")).alias("token")).join(F.broadcast(terms.where("frequent").select("token")), "token", "left_anti")
        each = key_join(each, rare, "token", skewed=True).groupBy(name).agg(F.collect_list("token").alias("rare"), F.collect_list("weight").alias("rare_weights"))
        d = d.join(each, name, "left")
    else:
        d = d.withColumn("rare", F.lit(None).cast("array<string>")).withColumn("rare_weights", F.lit(None).cast("array<bigint>"))
    unseen, share = 1 + _whole_ln(rows), least * SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            listed = pc.split_pattern(b.column("words"), " ")
            flat, size = listed.flatten(), pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
            w = np.full(len(flat), unseen, dtype=np.int64)
            lone = np.ones(len(flat), dtype=bool)
            for some, theirs in ((terms, weights), (b.column("rare").flatten(), b.column("rare_weights").flatten().to_numpy(zero_copy_only=False))):
                if len(some):
                    at = pc.fill_null(pc.index_in(flat, value_set=some.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
                    w = np.where(at >= 0, theirs[at], w)
                    lone &= at < 0
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((-w, row))  # stable: of equal weights the tokens stay in order
            flat, w, lone = flat.take(pa.array(order)), w[order], lone[order]
            ends, upto = np.cumsum(size), np.cumsum(w)
            total = upto[ends - 1] - np.concatenate(([0], upto[ends[:-1] - 1]))
            rest = upto[ends - 1][row] - upto + w
            posted = rest >= total[row] * share
            offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
            posts = pa.StructArray.from_arrays([flat.filter(pa.array(posted)), pa.array(rest[posted]), pa.array(lone[posted])], ["token", "rest", "lone"])
            firsts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[posted], minlength=len(size))))), pa.int32())
            new = [pa.array(total), pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, pa.array(w)), pa.ListArray.from_arrays(firsts, posts)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest_of], *new], names=[*rest_of, "total", "tokens", "weights", "posts"])

    kept = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in rest_of)
    return cut(d.mapInArrow(run, f"{kept}, total bigint, tokens array<string>, weights array<bigint>, posts array<struct<token: string, rest: bigint, lone: boolean>>"))


def _alike(common: Column, a: Column, b: Column) -> Column:
    return common.cast("double") / (a + b - common).cast("double")


def build(corpus: DataFrame, id_col: str = "id", text_col: str = "test_prefix", value_col: str = "target", depth: int = 4, least: float = 0.3) -> Index:
    """An index of the rows of corpus for searches that want fewer than `depth` answers, of similarity `least` or more. Texts
    without tokens are never found. corpus is read twice, so it gives the same rows each time."""
    rows = corpus.select(F.col(id_col).alias("id"), F.col(value_col).alias("value"), tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    # no token is empty, so that one counts the rows
    terms = rows.select(F.explode(F.concat("t", F.array(F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("having"))
    terms = cut(terms.where("having > 1 or token = ''"))
    n = terms.where("token = ''").agg(F.coalesce(F.max("having"), F.lit(0))).first()[0]
    terms = terms.where("token <> ''")
    many, held = terms.agg(F.count("*"), F.coalesce(F.sum("having"), F.lit(0))).first()
    terms = terms.select("token", weight(n, F.col("having")).alias("weight"), (F.col("having") > (held / MOST_TERMS if many > MOST_TERMS else 0)).alias("frequent"))
    first = Window.partitionBy("words").orderBy("id", "value")
    d = rows.select("id", "value", F.array_join("t", " ").alias("words")).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= depth)
    d = d.groupBy("words").agg(F.min("id").alias("first"), F.collect_list(F.struct("id", "value")).alias("members"))
    sets = _weighed(d, "set", terms, n, least)
    listed = sets.select("set", "first", "total", F.inline("posts"))
    cell = [F.floor(F.log(c) * 8).alias(f"{c}_cell") for c in ("total", "rest")]
    order = ("token", "total_cell", "rest_cell", "first", "set", "total", "rest")
    placed = listed.where("not lone").select("token", *cell, "first", "set", "total", "rest").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = placed.withColumn("block", F.monotonically_increasing_id()).withColumn("block", F.expr(f"block div {BLOCK}"))  # no two ranges share one
    blocks = blocks.groupBy("token", "total_cell", "rest_cell", "block")
    blocks = blocks.agg(F.min("total").alias("lo"), F.max("rest").alias("rest"), F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first", "set", "total", "rest"))).alias("entries"))
    blocks = cut(blocks.withColumn("block", F.struct("token", "total_cell", "rest_cell", "block")).drop("total_cell", "rest_cell"))
    return Index(terms, sets, listed.where("lone").drop("lone"), blocks, n, depth, least)


def search(index: Index, queries: DataFrame, id_col: str = "id", text_col: str = "test_prefix", k: int = 1, others: bool = False) -> DataFrame:
    """query, rank (1 to k), id, value, similarity: the indexed rows most alike to each query row, of equal ones the least id;
    only those of the index's least similarity or more. others: a row with the query's own id is no answer. Query ids are
    distinct. Queries without tokens and those that nothing is like have no rows."""
    wanted = k + others
    if wanted > index.depth:
        raise ValueError(f"the index keeps {index.depth} rows of equal sets, {wanted} are needed")
    rows = cut(queries.select(F.col(id_col).alias("query"), F.array_join(tokens(F.col(text_col)), " ").alias("words")).where("words <> ''"))
    asked = _weighed(rows.select("words", F.col("words").alias("text")).dropDuplicates(["words"]), "q", index.terms, index.rows, index.least)
    probes = asked.select("q", F.col("total").alias("q_total"), F.inline("posts")).withColumnRenamed("rest", "q_rest")
    compare = asked.select("q", F.col("total").alias("q_total"), F.arrays_zip("weights", "tokens").alias("q_tokens"))

    def compared(pairs: DataFrame) -> DataFrame:
        """pairs (q, set, first) alike enough, with their similarity and the set's members. Of the index's sets those in pairs
        are moved, and few others."""
        named = cut(pairs.select("set").distinct())
        sets = _among(index.sets.select("set", "members", "total", F.arrays_zip("weights", "tokens").alias("tokens")), named, "set")
        if named.count() <= SMALL:
            sets = F.broadcast(sets)
        common = F.aggregate(F.array_intersect("tokens", "q_tokens"), F.lit(0).cast("bigint"), lambda s, x: s + x["weights"])
        d = pairs.join(compare, "q").join(sets, "set")
        return d.select("q", "set", "first", "members", _alike(common, F.col("total"), F.col("q_total")).alias("similarity")).where(F.col("similarity") >= index.least)

    def best_of(d: DataFrame) -> DataFrame:
        best = Window.partitionBy("q").orderBy(F.desc("similarity"), "first", "set")
        return d.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= wanted)

    def bound(total: str, rest: str) -> Column:
        return _alike(F.least("q_rest", rest), F.col("q_total"), F.col(total))

    # tokens of one row name their sets
    alone = probes.where("lone")
    alone = alone.join(_among(index.lone, alone, "token"), "token").where(bound("total", "rest") >= index.least * SLACK)
    alone = cut(compared(cut(alone.select("q", "set", "first").distinct())))
    # 1. what an answer must beat: the last of the best `wanted` sets among the first in the best blocks of each of the query's
    # tokens. As many blocks as answers, since a block may hold a single set
    probes = cut(probes.where("not lone").drop("lone"))
    heads = index.blocks.select("token", "block", "lo", F.col("rest").alias("b_rest"), F.col("first").alias("b_first"))
    entries = index.blocks.select("block", "entries")
    kind = ["token", "q_total", "q_rest"]
    kinds = _small(cut(probes.select(*kind).distinct()))
    met = heads.join(kinds, "token").withColumn("bound", bound("lo", "b_rest")).where(F.col("bound") >= index.least * SLACK)
    nth = F.row_number().over(Window.partitionBy(*kind).orderBy(F.desc("bound"), "b_first", "block"))
    best = _small(cut(met.withColumn("_n", nth).where(F.col("_n") <= wanted).select(*kind, "block")))
    entry = F.transform("entries", lambda e: F.struct((-_alike(F.least(F.col("q_rest"), e["rest"]), F.col("q_total"), e["total"])).alias("down"), e["first"].alias("first"), e["set"].alias("set")))
    tried = _small(cut(entries.join(best, "block").select(*kind, F.explode(F.slice(F.array_sort(entry), 1, wanted)).alias("e")).select(*kind, "e.set", "e.first").distinct()))
    tried = cut(probes.join(tried, kind).select("q", "set", "first").distinct())
    beat = best_of(compared(tried).unionByName(alone).dropDuplicates(["q", "set"]))
    beat = cut(beat.where(F.col("_n") == wanted).select("q", F.col("similarity").alias("s"), F.col("first").alias("s_first")))

    # 2. and 3. all that may beat it; -1: there is nothing to beat
    def beats(b: Column, first: Column) -> Column:
        return (b >= index.least * SLACK) & ((b > F.col("s")) | ((b >= F.col("s") * SLACK) & (first <= F.col("s_first"))))

    probes = cut(probes.join(beat, "q", "left").withColumn("s", F.coalesce("s", F.lit(-1.0))))
    kinds = cut(probes.select(*kind, "s", "s_first").distinct().withColumn("kind", F.monotonically_increasing_id()))
    open_ = heads.join(_small(kinds), "token").where(beats(bound("lo", "b_rest"), F.col("b_first"))).drop("lo", "b_rest", "b_first", "token")
    met = entries.join(_small(cut(open_)), "block").withColumn("e", F.explode("entries")).drop("entries")
    met = met.where(beats(_alike(F.least("q_rest", F.col("e.rest")), F.col("q_total"), F.col("e.total")), F.col("e.first"))).select("kind", "e.set", "e.first").distinct()
    same = F.col("s_first").eqNullSafe(F.col("k_first"))
    named = kinds.select(*kind, "s", F.col("s_first").alias("k_first"), "kind")
    of = probes.join(_small(named), [*kind, "s"]).where(same).select("q", "kind")
    pairs = cut(of.join(_small(cut(met)), "kind").select("q", "set", "first").distinct())
    found = best_of(compared(pairs).unionByName(alone).dropDuplicates(["q", "set"]))
    found = found.join(asked.select("q", "text"), "q").select("text", "similarity", F.inline("members"))
    d = key_join(rows.select("query", F.col("words").alias("text")), cut(found), "text", skewed=True)
    if others:
        d = d.where(F.col("id") != F.col("query"))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id", "value"))).where(F.col("rank") <= k)
    return d.select("query", "rank", "id", "value", "similarity")


def _whole_ln(n: int) -> int:
    return math.floor(1000 * math.log(n)) if n else 0


def predict_by_search(df: DataFrame, index: Index, out: str = "prediction", id_col: str = "id", text_col: str = "test_prefix", others: bool = False) -> DataFrame:
    """df with the oracle of the indexed row most alike to each prefix, '' where nothing is alike enough."""
    found = search(index, df, id_col, text_col, 1, others).select(F.col("query").alias("_q"), F.col("value").alias("_v"))
    return df.join(found, F.col(id_col) == F.col("_q"), "left").withColumn(out, F.coalesce("_v", F.lit(""))).drop("_q", "_v")
