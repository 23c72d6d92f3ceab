"""Importance resampling towards a target distribution, over bucket-partitioned inverted postings.

The features of a text (runs of one and two words) fall in buckets. Documents are turned into postings (bucket, document,
count), packed by ranges of buckets and shuffled by range; a range is split into slices, as a common word gives a posting to
nearly every document. Where postings lie, each bucket's count is summed; these sums and the target corpus's meet by bucket
and give its gain, a log ratio of the two distributions. The gains of a range go back to its slices, whose postings become
contributions (document, count * gain), and these are reduced by document. Gumbel noise from a hash of the id makes the
highest scores a draw without replacement.

A document is known by its id and a hash of its text, so that rows may come in any order when a lost task runs again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.pairing import with_row_index
from .common import cut, pick, small_batches
from .hash_tree import CRC_TABLE, crc_sql

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 7, 25, 20
#: Ranges of buckets, and slices of a range: together the finest the postings can be dealt.
RANGES, SLICES = 16, 4096
#: Words whose features are made at once, so that a very long text needs little memory.
WORDS_AT_ONCE = 200_000

# Fixed value: what a word is, in lower-cased UTF-8; every byte of a character beyond ASCII belongs to one.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bucket_counts(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets of a text's features (sorted), how often each occurs, and the number of features. bytes.lower() changes
    A-Z alone."""
    words, crc = WORD.findall(text.lower()), zlib.crc32
    found, last = np.zeros(0, np.int64), None
    many = len(words) > WORDS_AT_ONCE
    total = np.zeros(buckets, np.int64) if many else None
    for at in range(0, len(words), WORDS_AT_ONCE):
        some = words[at : at + WORDS_AT_ONCE]
        single = list(map(crc, some))
        blank = [crc(b" ", x) for x in single]
        pair = list(map(crc, some[1:], blank))
        if last is not None:
            pair.append(crc(some[0], last))
        last = blank[-1]
        found = np.array(single + pair, np.int64) % buckets
        if many:
            total += np.bincount(found, minlength=buckets)
    n = max(0, 2 * len(words) - 1)
    if many:
        at = np.flatnonzero(total)
        return at, total[at], n
    at, counts = np.unique(found, return_counts=True)
    return at, counts, n


def _postings(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (range, slice, ids, hashes, n_features, bucket, doc, count): postings of some documents in a range of buckets, as
    packed arrays sorted by bucket, of which doc names one of ids and hashes by its place. Rows of range 0 list every
    document, with its number of features; those of others only where they have postings."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("range", pa.int32()), ("slice", pa.int32()), ("ids", pa.list_(to_arrow_type(id_type))), ("hashes", pa.list_(pa.int64())), ("n_features", pa.binary()), ("bucket", pa.binary()), ("doc", pa.binary()), ("count", pa.binary())])
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column(0), np.asarray(b.column(1))
            at, doc, count, n = [], [], [], np.zeros(len(ids), np.int64)
            for i, x in enumerate(b.column(2)):
                where, many, n[i] = bucket_counts((x.as_py() or "").encode(), buckets)
                at.append(where)
                count.append(many)
                doc.append(np.full(len(where), i, np.int32))
            at, doc, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, doc, count))
            order = np.argsort(at, kind="stable")
            at, doc, count = at[order], doc[order].astype(np.int32), count[order].astype(np.int32)
            borders = np.searchsorted(at * RANGES // buckets, np.arange(RANGES + 1))
            rows = {f.name: [] for f in schema}
            for r, (lo, hi) in enumerate(zip(borders, borders[1:], strict=False)):
                if not len(ids) or (r and lo == hi):
                    continue
                rows["range"].append(r)
                rows["slice"].append(int(hashes[0] % SLICES))
                if r:
                    used, local = np.unique(doc[lo:hi], return_inverse=True)
                else:
                    used, local = np.arange(len(ids)), doc[lo:hi]
                rows["ids"].append(ids.take(pa.array(used)).to_pylist())
                rows["hashes"].append(hashes[used])
                rows["n_features"].append(b"" if r else n.tobytes())
                rows["bucket"].append(at[lo:hi].astype(np.int32).tobytes())
                rows["doc"].append(local.astype(np.int32).tobytes())
                rows["count"].append(count[lo:hi].tobytes())
            if rows["range"]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    kind = id_type.simpleString()
    return d.mapInArrow(run, f"range int, slice int, ids array<{kind}>, hashes array<bigint>, n_features binary, bucket binary, doc binary, count binary")


def _sums(postings: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: counts of the postings by bucket, summed within each task first, in an array of a place a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at, count in zip(b.column("bucket"), b.column("count"), strict=True):
                total += np.bincount(np.frombuffer(at.as_py(), np.int32), np.frombuffer(count.as_py(), np.int32), minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return postings.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain from the sums (bucket, n) of both corpora: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), for the
    buckets that either has. At most `buckets` rows."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    d = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    everything = Window.partitionBy(F.lit(0))  # of a row a bucket
    d = d.withColumn("ss", F.sum("s").over(everything)).withColumn("tt", F.sum("t").over(everything))
    ratio = f"(cast(t + 1 as double) * cast(ss + {buckets} as double)) / (cast(s + 1 as double) * cast(tt + {buckets} as double))"
    return d.select("bucket", F.expr(f"cast(floor(1000D * ln({ratio})) as bigint)").alias("gain"))


def _contributions(postings: DataFrame, gains: DataFrame, buckets: int, id_type: str) -> DataFrame:
    """Rows (doc_id, h, gain, n_features, rows): what each range gives to each of its documents; rows is 1 in one of them."""
    packed = gains.groupBy(F.expr(f"cast(cast(bucket as bigint) * {RANGES} div {buckets} as int)").alias("range")).agg(F.collect_list("bucket").alias("at"), F.collect_list("gain").alias("gains"))
    # all gains together have `buckets` numbers, a bound that no corpus moves; a left join leaves the postings' exchange as it is for both readers
    d = postings.join(F.broadcast(packed), "range", "left").select("ids", "hashes", "n_features", "bucket", "doc", "count", "at", "gains")
    kind = to_arrow_type(postings.schema["ids"].dataType.elementType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, hashes, n, bucket, doc, count, at, gains = (b.column(i)[k] for i in range(8))
                ids = ids.values
                table = np.zeros(buckets, np.int64)
                if at.is_valid:
                    table[np.asarray(at.values)] = np.asarray(gains.values)
                each = table[np.frombuffer(bucket.as_py(), np.int32)] * np.frombuffer(count.as_py(), np.int32)
                total = np.zeros(len(ids), np.int64)
                np.add.at(total, np.frombuffer(doc.as_py(), np.int32), each)
                first = bool(n.as_py())
                features = np.frombuffer(n.as_py(), np.int64) if first else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays([ids.cast(kind), hashes.values, pa.array(total), pa.array(features), pa.array(np.full(len(ids), int(first), np.int64))], names=["doc_id", "h", "gain", "n_features", "rows"])

    return d.mapInArrow(run, f"doc_id {id_type}, h bigint, gain bigint, n_features bigint, rows bigint")


def importance_weights(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Per row: the id, h (a hash of its text), copy (0, 1, ... of rows equal in both), n_features, weight: the floored mean of
    the gains of a document's features, 0 without any.

    Null text has no features. Rows that repeat an id with other texts are documents of their own. Empty tables give empty
    results, an empty target gains that differ by the source alone; further columns are not read.
    """
    d = pick(df, {"doc_id": id_col, "text": text_col})
    kind = d.schema["doc_id"].dataType.simpleString()
    postings = _postings(d, buckets).repartition("range", "slice")
    aim = _postings(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), buckets)
    gains = bucket_gains(_sums(postings, buckets), _sums(aim, buckets), buckets)
    got = _contributions(postings, gains, buckets, kind).groupBy("doc_id", "h").agg(*[F.sum(c).alias(c) for c in ("gain", "n_features", "rows")])
    got = cut(got)
    d = got.select("doc_id", "h", F.expr("n_features div rows").alias("n_features"), F.expr("case when n_features = 0 then 0L else (gain - pmod(gain, n_features)) div n_features end").alias("weight"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy"))
    return d.select(F.col("doc_id").alias(id_col), "h", F.expr("copy - 1").alias("copy"), "n_features", "weight")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Per row: the id, n_features, weight, score (weight and Gumbel noise, in thousandths), rank: 1, 2, 3... of the documents
    drawn, null of the others.

    Of the N documents with min_words or more, floor(percent * N / 100) are drawn: the highest scores, ties to the smaller id
    (null last), then to the lesser hash. Null ids draw as ids of empty decimals; all else is as in importance_weights().
    One sort over ranges numbers the documents; no join is needed.
    """
    d = importance_weights(pick(df, {"doc_id": id_col, "text": text_col}), target, target_text=target_text, buckets=buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = d.withColumn("u", (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0)
    d = d.withColumn("score", (F.col("weight") + F.floor(-1000.0 * F.log(-F.log("u")))).cast("bigint"))
    d = d.withColumn("out", F.col("n_features") < 2 * min_words - 1).withColumn("down", -F.col("score")).withColumn("no_id", F.col("doc_id").isNull())
    d = cut(d.select("doc_id", "n_features", "weight", "score", "out", "down", "no_id", "h", "copy"))
    drawn = d.where("not out").count() * percent // 100
    d = with_row_index(d, "out", "down", "no_id", "doc_id", "h", "copy", name="place", narrow=True)
    return d.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", F.when(~F.col("out") & (F.col("place") < drawn), F.col("place") + 1).alias("rank"))


def oracle_sql() -> str:
    def features(table: str, key: str) -> str:
        return (
            f"select {key} as id, lower_words as w from (select {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as lower_words from {table})"
        )

    runs = "select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) as f from {}"
    return f"""
with table8 as ({CRC_TABLE}),
dw as ({features("documents", "doc_id")}), bw as ({features("benchmark", "item_id")}),
df as materialized ({runs.format("dw")}), bf as materialized ({runs.format("bw")}),
names as (select f, {crc_sql("f")} % {BUCKETS} as b from (select distinct f from (select f from df union all select f from bf)), table8),
dc as materialized (select id, b, count(*) as n from df join names using (f) group by id, b),
sc as (select b, sum(n)::bigint as s from dc group by b), tc as (select b, count(*) as t from bf join names using (f) group by b),
g as (select b, floor(1000::double * ln(((coalesce(t, 0) + 1)::double * ((select sum(s) from sc) + {BUCKETS})::double) / ((s + 1)::double * (coalesce((select sum(t) from tc), 0) + {BUCKETS})::double)))::bigint as gain from sc left join tc using (b)),
dg as (select id, sum(n * gain)::double as gain from dc join g using (b) group by id),
w as (select id as doc_id, greatest(0, 2 * len(w) - 1)::bigint as n_features, case when len(w) = 0 then 0 else floor(gain / (2 * len(w) - 1))::bigint end as weight from dw left join dg using (id)),
v as (select *, weight + floor(-1000::double * ln(-ln((cast(concat('0x', substring(sha256(concat('{SEED}:', doc_id)), 1, 8)) as bigint)::double + 0.5::double) / 4294967296::double)))::bigint as score from w),
r as (select *, row_number() over (partition by n_features >= {2 * MIN_WORDS - 1} order by score desc, doc_id) as k, (select count(*) from v where n_features >= {2 * MIN_WORDS - 1}) as many from v)
select doc_id, n_features, weight, score, case when n_features >= {2 * MIN_WORDS - 1} and k <= {PERCENT} * many // 100 then k end as rank from r
"""
