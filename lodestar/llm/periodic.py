"""Periodic runs of words, found by counting lags before any text is scanned.

A run is a stretch of words that repeats with smallest period q, has max(24, 3q) words or more, and that no neighbouring word
extends. At lag q its words match over max(24 - q, 2q) places or more, an island. So, for each text:

1. The matches at every lag are counted. Words are heavy or light by what is cheaper: for a heavy word the autocorrelation of
   its places by Fourier transform (of all heavy words by one inverse transform; counts are whole numbers, so rounding makes
   them exact), for light ones the differences of their pairs of places.
2. Lags are taken in ascending order, those with too few matches never scanned. A run explains its matches at the multiples
   of its period, which are taken off: two runs whose periods divide a lag cannot share a pair of words that far apart, nor can
   an island whose smallest period is that lag, so what is left is exact and a text of one word is scanned at one lag.
3. An island spans two grid points half its least length apart, so grid points that match in a row name the places that are
   scanned, and each scan goes only as far as words match.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pick

MIN_WORDS, MIN_REPEATS = 24, 3
#: Numbers in one block of transforms: bounds the memory that many heavy words take.
BLOCK = 1 << 21
#: Lags up to this are scanned whole: their grid would be as long as the text.
SHORT_LAG = 16
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lag_counts(ids: np.ndarray, longest: int) -> np.ndarray:
    """c[q]: the places i with ids[i] == ids[i + q], for q from 0 to longest. ids are 0, 1, 2, ..."""
    n = len(ids)
    counts = np.zeros(longest + 1, np.int64)
    if longest < 1:
        return counts
    order = np.argsort(ids, kind="stable")
    often = np.bincount(ids)
    heavy = np.flatnonzero(often.astype(np.float64) ** 2 > 2 * n * max(1.0, np.log2(n)))
    if len(heavy):
        size = 1 << (n + longest).bit_length()
        power = np.zeros(size // 2 + 1)
        some = max(1, BLOCK // size)
        for k in range(0, len(heavy), some):
            marks = (ids[None, :] == heavy[k : k + some, None]).astype(np.float64)
            power += (np.abs(np.fft.rfft(marks, size, axis=1)) ** 2).sum(axis=0)
        counts += np.rint(np.fft.irfft(power, size)[: longest + 1]).astype(np.int64)
        light = np.ones(len(often), bool)
        light[heavy] = False
        order = order[light[ids[order]]]
    # after[i]: how many later places the word of the i-th sorted place has; the i-th and (i + k)-th make a pair while k <= after
    of = ids[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    ends = np.repeat(np.r_[first[1:], len(of)], np.diff(np.r_[first, len(of)])) if len(of) else first
    after = ends - 1 - np.arange(len(of))
    at = np.argsort(-after, kind="stable")
    left = len(of) - np.searchsorted(np.sort(after), np.arange(1, (after.max() if len(of) else 0) + 2), side="left")
    for k in range(1, len(left) + 1):
        i = at[: left[k - 1]]
        if not len(i):
            break
        apart = order[i + k] - order[i]
        counts += np.bincount(apart[apart <= longest], minlength=longest + 1)
    return counts


def _stretch(ids: np.ndarray, q: int, at: int, step: int) -> int:
    """How many places in a row match at lag q from `at` on, forwards (step 1) or backwards (-1)."""
    n, some = len(ids) - q, 64
    begin = at
    while 0 <= at < n:
        lo, hi = (at, min(n, at + some)) if step > 0 else (max(0, at - some + 1), at + 1)
        other = np.flatnonzero(ids[lo:hi] != ids[lo + q : hi + q])
        if len(other):
            return abs(lo + int(other[0 if step > 0 else -1]) - begin)
        at, some = (hi if step > 0 else lo - 1), some * 2
    return abs(at - begin)


def islands(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches of `least` matching places or more at lag q."""
    n = len(ids) - q
    if q <= SHORT_LAG:
        same = np.r_[False, ids[:n] == ids[q:], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        long = lengths >= least
        return list(zip(starts[long].tolist(), lengths[long].tolist(), strict=True))
    grid = np.arange(0, n, least // 2)
    same = ids[grid] == ids[grid + q]
    found, end = [], 0
    for k in np.flatnonzero(same[:-1] & same[1:]):
        at = int(grid[k])
        if at < end:
            continue
        back, on = _stretch(ids, q, at, -1), _stretch(ids, q, at, 1)
        end = at + on
        if back + on - 1 >= least:
            found.append((at - back + 1, back + on - 1))
    return found


def _prime_factors(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*found, q] if q > 1 else found


def find_runs(ids: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. min_repeats is 3 or more, on which step 2 rests."""
    n = len(ids)
    longest = n // min_repeats
    if n < min_words or longest < 1:
        return []
    counts = lag_counts(ids, longest)
    lags = np.arange(longest + 1)
    least = np.maximum(min_words - lags, (min_repeats - 1) * lags)
    runs = []
    for q in np.flatnonzero(counts >= least).tolist():
        if not q or counts[q] < least[q]:  # since then explained
            continue
        smaller = [q // p for p in _prime_factors(q)]
        for start, length in islands(ids, q, int(least[q])):
            size = length + q
            if any(np.array_equal(ids[start : start + size - d], ids[start + d : start + size]) for d in smaller):
                continue
            runs.append((start, size, q))
            multiples = np.arange(2 * q, min(size, longest + 1), q)
            counts[multiples] -= size - multiples
    return sorted((s, n, q) for s, n, q in runs)


def words_and_runs(text: str | None, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The words of a text, and their runs. bytes.split() parts at blank, tab, LF, VT, FF and CR alone."""
    words = (text or "").encode().split()
    if len(words) < min_words:
        return words, []
    number: dict[bytes, int] = {}
    return words, find_runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64), min_words, min_repeats)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by a blank, without those that a run holds after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words).decode()


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """Per row: the id, runs (array of start, length, period in words, by start, then period), collapsed (the text's words
    joined by a blank, without those that a run repeats).

    Null and empty texts have no words and no runs. Rows with equal or null ids are each a row; empty tables give empty
    results; further columns are not read. No shuffle: a text is worked through whole where it is read.
    """
    if min_repeats < 3:
        raise ValueError("min_repeats is 3 or more")

    def make() -> Callable[[list[str | None]], dict[str, list]]:
        def run(texts: list[str | None]) -> dict[str, list]:
            found, collapsed = [], []
            for t in texts:
                words, runs = words_and_runs(t, min_words, min_repeats)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                collapsed.append(collapse(words, runs))
            return {"runs": found, "collapsed": collapsed}

        return run

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    d = pick(df, {"doc_id": id_col, "text": text_col})
    return map_texts(d, make, [("runs", RUNS, kind), ("collapsed", "string", pa.string())]).withColumnRenamed("doc_id", id_col)


def with_planted_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text, of which a tenth of the documents, by crc32 of the id, repeat a part to their end: word i >= a
    becomes word a + (i - a) % p. Null ids and texts without words stay as they are. DataFrame functions only."""
    d = pick(df, {"doc_id": id_col, "text": text_col})
    d = d.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("g", F.floor(F.col("h") / 10))
    d = d.withColumn("w", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    d = d.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, get(w, cast(a + (i - a) % p as int)))), ' ')")
    return d.select(F.col("doc_id").alias(id_col), F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias(text_col))


def longest_exponent(runs: Column) -> Column:
    """The run of the greatest length / period, compared as whole numbers; ties to the first by start, then period."""
    more = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    return F.reduce(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), more)


def run_digests(runs: DataFrame) -> DataFrame:
    """The columns of periodic_runs() as counts and digests."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = runs.withColumn("best", longest_exponent(F.col("runs")))
    return d.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
