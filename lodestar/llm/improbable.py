"""Document fingerprints from improbable features.

Every 32-byte window of a text has an entropy; windows are ranked by how far their entropy lies from that of common
text, the rarest first. A window that is the best of at least 8 of the 32-window runs over it is a feature. Features
are hashed into a chain of Bloom filters (256 bytes, five bits a feature, 160 features a filter). Two fingerprints are
compared by the overlap of their filters' bits, normalised between what chance gives and the most there can be.

All arithmetic on windows is on integers, so that a window ranks alike wherever it stands. Texts are worked through in
batches of about a megabyte with numpy.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from .common import arrow_schema, pick, small_batches

WINDOW, RUN, POPULAR = 32, 32, 8
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Bits of entropy a byte of common text's windows; windows under LEAST bits carry too little to tell texts apart.
COMMON, LEAST = 3.6, 1.0
#: Code points of texts taken together, and bytes of one text taken at once.
BATCH, BLOCK = 1 << 19, 1 << 20
_SCALE = 1 << 16
_G = np.array([0, 0, *(round(c * np.log2(c) * _SCALE) for c in range(2, WINDOW + 2))], dtype=np.int32)
_STEP = np.diff(_G)  # what one more of the same byte adds to the sum of c * log2(c)
_FULL = np.int32(WINDOW * int(np.log2(WINDOW)) * _SCALE)
_FAR = np.int64(1) << 40


def window_ranks(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each byte position of the joined texts, the rank of the window that begins there (less is rarer; _FAR: none)."""
    n = len(raw)
    ranks = np.full(n, _FAR, dtype=np.int64)
    if n < WINDOW:
        return ranks
    place = np.arange(n) + np.repeat(np.arange(len(sizes)) * WINDOW, sizes)  # a gap between texts: counts never cross
    order = np.argsort(raw, kind="stable")
    keys = place[order]
    keys += raw[order].astype(np.int64) << 40
    low = np.searchsorted(keys, keys - (WINDOW - 1), "left")
    k = np.arange(n)
    before = np.empty(n, dtype=np.uint8)  # like bytes among the WINDOW - 1 before each
    after = np.empty(n, dtype=np.uint8)  # and among those after it; by the inverse of `low`
    before[order] = k - low
    after[order] = np.cumsum(np.bincount(low, minlength=n)) - k - 1
    came, went = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 1, dtype=np.int32)  # sums wrap; their differences are right
    np.cumsum(_STEP[before], dtype=np.int32, out=came[1:])
    np.cumsum(_STEP[after], dtype=np.int32, out=went[1:])
    base, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    m = n - WINDOW + 1
    total = (came[WINDOW : n + 1] - came[base[:m]]) - (went[:m] - went[base[:m]])
    entropy = (_FULL - total) // (WINDOW * _SCALE // 1024)  # in 1024ths of a bit a byte
    ok = (entropy >= int(LEAST * 1024)) & (k[:m] + WINDOW <= end[:m])
    ranks[:m][ok] = (8192 - np.abs(entropy - int(COMMON * 1024)))[ok]
    return ranks


def features(raws: list[bytes]) -> list[np.ndarray]:
    """The 64-bit feature hashes of each text, in text order. Texts without a feature give one hash for the whole."""
    out = _features(raws, [(0, len(b)) for b in raws])
    return [_whole(b) if b and not len(h) else h for b, h in zip(raws, out, strict=True)]


def _whole(raw: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), dtype=np.uint64)


def _features(raws: list[bytes], own: list[tuple[int, int]]) -> list[np.ndarray]:
    sizes = np.array([len(b) for b in raws], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    joined = b"".join(raws)
    raw = np.frombuffer(joined, dtype=np.uint8)
    n = len(raw)
    chosen = np.zeros(0, dtype=np.int64)
    if n >= WINDOW:
        ranks = window_ranks(raw, starts, sizes)
        low = (ranks << 22) | np.arange(n)  # ranks fit 41 bits, places in a batch 22
        low = np.concatenate((low, np.full(RUN, np.iinfo(np.int64).max, dtype=np.int64)))
        width = 1
        while width < RUN:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        best = low[:n][ranks < _FAR] & ((1 << 22) - 1)
        chosen = np.flatnonzero(np.bincount(best, minlength=n) >= POPULAR)
    if len(chosen):
        cells = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[chosen].view(np.uint64)
        h = np.full(len(chosen), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for k in range(WINDOW // 8):
            h = (h ^ cells[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    else:
        h = np.zeros(0, dtype=np.uint64)
    lows = np.searchsorted(chosen, starts + np.array([lo for lo, _ in own], dtype=np.int64))
    highs = np.searchsorted(chosen, starts + np.minimum(sizes, np.array([hi for _, hi in own], dtype=np.int64)))
    return [h[a:b] for a, b in zip(lows, highs, strict=True)]


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters: uint64 [filters, 32]."""
    count = -(-len(hashes) // PER_FILTER)
    bits = np.zeros(count * FILTER_BITS, dtype=np.uint8)
    base = (np.arange(len(hashes)) // PER_FILTER) * FILTER_BITS
    for k in range(HASHES):
        bits[base + ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64).reshape(count, FILTER_BITS // 64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: mean over the shorter chain's filters of the best normalised bit overlap with a filter of the other."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 1.0 if not len(b) else 0.0
    ca, cb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    best = []
    for x, c in zip(a, ca, strict=True):  # one row of the matrix at a time: memory grows with the longer chain only
        both = np.bitwise_count(b & x).sum(1)
        chance, most = c * cb / FILTER_BITS, np.minimum(c, cb)
        best.append(np.max(np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), both == most)))
    return float(min(1.0, max(0.0, np.mean(np.clip(best, 0, 1)))))


def digest(f: np.ndarray, n_features: int) -> str:
    return f"{n_features}:{base64.b64encode(f.tobytes()).decode()}"


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _describe(pairs: list[tuple]) -> Iterator[tuple]:
    """(id, text, next text) -> result rows, features in one go for the whole batch."""
    texts = [p[1] for p in pairs]
    same = [p[2] is pairs[i + 1][1] if i + 1 < len(pairs) else False for i, p in enumerate(pairs)]
    extra = [p[2] for p, s in zip(pairs, same, strict=True) if not s]
    changed = [edited_text(t, nxt) for _, t, nxt in pairs]
    raw_changed = [c.encode() for c in changed]
    found = grouped_features([t.encode() for t in [*texts, *extra]] + raw_changed)
    chains = [filters(h) for h in found]
    at, e = len(texts), len(texts) + len(extra)
    for i, (doc, text, _) in enumerate(pairs):
        if same[i]:
            following = chains[i + 1]
        else:
            following = chains[at]
            at += 1
        mine, other = chains[i], chains[e + i]
        yield (doc, len(text), hashlib.sha256(raw_changed[i]).hexdigest(), digest(mine, len(found[i])), digest(other, len(found[e + i])), likeness(mine, other), likeness(mine, following))


def grouped_features(raws: list[bytes]) -> list[np.ndarray]:
    """features() in groups that fit the 22 bits of a place."""
    out, group, size = [], [], 0
    for b in raws:
        if group and size + len(b) > BATCH:
            out += features(group)
            group, size = [], 0
        group.append(b)
        size += len(b)
        if size > BLOCK:  # a long text alone, block by block
            out += _long_features(group)
            group, size = [], 0
    return out + (features(group) if group else [])


def _long_features(group: list[bytes]) -> list[np.ndarray]:
    out = features(group[:-1]) if len(group) > 1 else []
    b, got = group[-1], []
    for lo in range(0, len(b), BLOCK):
        a = max(0, lo - RUN)
        got += _features([b[a : lo + BLOCK + RUN + WINDOW]], [(lo - a, lo - a + BLOCK)])
    h = np.concatenate(got)
    return [*out, h if len(h) else _whole(b)]


def ordinal(d: DataFrame) -> Column:
    """A double that ascends with doc_id, if not strictly: numbers as they are, other ids by the first six bytes of their
    text; null ids are least. Fractions and dates are ordered as numbers."""
    kind = d.schema["doc_id"].dataType
    if isinstance(kind, NumericType):
        x = F.col("doc_id").cast("double")
    elif isinstance(kind, DateType):
        x = F.unix_date("doc_id").cast("double")
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        x = F.col("doc_id").cast("timestamp").cast("double")
    else:
        x = F.conv(F.rpad(F.hex(F.substring(F.col("doc_id").cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.coalesce(x, F.lit(-1.7e308))


def with_buckets(d: DataFrame, buckets: int) -> DataFrame:
    """Deal rows over some `buckets` ranges of (doc_id, h), h a hash of the text; the first row of each range also goes to
    the range before (`ahead`), the very first to the last. An id that fills several ranges is cut by h."""
    from pyspark.ml.feature import Bucketizer

    d = d.withColumn("x", ordinal(d)).withColumn("h", F.xxhash64("text"))
    found = Counter(d.approxQuantile("x", [k / buckets for k in range(1, buckets)], 0.2 / buckets) if buckets > 1 else [])
    cuts = sorted(found) or [0.0]  # it wants one cut at least
    d = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="x", outputCol="b").transform(d)
    # a cut found k times is an id with rows for k ranges; it stands at the beginning of its own
    wide = [(x, k) for x, k in found.items() if k > 1]
    if wide:
        d = d.join(F.broadcast(d.sparkSession.createDataFrame(wide, "x double, k int")), "x", "left")
        part = F.least(F.col("k") - 1, F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * F.col("k")))
        d = d.withColumn("b", F.col("b").cast("bigint") * buckets + F.coalesce(part, F.lit(buckets - 1).cast("bigint")))
    else:
        d = d.withColumn("b", F.col("b").cast("bigint"))
    ranges = d.groupBy("b").agg(F.min(F.struct("x", "doc_id", "h")).alias("first"))  # one row a range, so are these windows
    last = F.max("b").over(Window.partitionBy())
    ranges = ranges.select("b", "first", F.coalesce(F.lag("b").over(Window.orderBy("b")), last).alias("prev"))
    here = F.struct(F.col("b").alias("b"), F.lit(False).alias("ahead"))
    back = F.struct(F.col("prev").alias("b"), F.lit(True).alias("ahead"))
    first = F.struct("x", "doc_id", "h").eqNullSafe(F.col("first"))
    d = d.join(F.broadcast(ranges), "b").select("doc_id", "text", "h", F.explode(F.when(first, F.array(here, back)).otherwise(F.array(here))).alias("to"))
    return d.select("doc_id", "text", "h", "to.b", "to.ahead")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty (an empty fingerprint; two of them are alike, 1.0). Ids are of any type with an order; null
    ids stand before all others. Rows with equal ids follow each other in order of a hash of their texts (then of the
    texts), so reruns agree; equal rows are each other's next. Of one row, it is its own next. Empty tables give empty
    results; further columns are not read. One shuffle of the texts, dealt by ranges of ids; the range heads are sent
    twice, nothing else is.
    """
    spark = df.sparkSession
    small_batches(spark)
    d = pick(df, {"doc_id": id_col, "text": text_col}).withColumn("text", F.coalesce("text", F.lit("")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = with_buckets(d, 4 * parts).repartition("b").sortWithinPartitions("b", "ahead", "doc_id", "h", "text")
    schema = arrow_schema(d, ["doc_id"], [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held = None
            for b in batches:
                for doc, text, bucket, ahead in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held is not None and held[2] == bucket:
                        yield held[0], held[1], text
                        held = None
                    if not ahead:
                        held = (doc, text, bucket)
            assert held is None, "a range without a row ahead"

        def pack(pairs: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*_describe(pairs), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        pairs, size = [], 0
        for p in rows():
            pairs.append(p)
            size += len(p[1])
            if size > BATCH:
                yield pack(pairs)
                pairs, size = [], 0
        if pairs:
            yield pack(pairs)

    ddl = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return d.select("doc_id", "text", "b", "ahead").mapInArrow(run, ddl).withColumnRenamed("doc_id", id_col)
