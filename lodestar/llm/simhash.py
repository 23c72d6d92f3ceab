"""SimHash near-duplicate detection with pivot distance tables.

A document's 64-bit fingerprint has a bit set where over half of its word shingles' XXH64 hashes have it. For each
distinct fingerprint the Hamming distances to 16 reference fingerprints (pivots) are precomputed. By the triangle
inequality two fingerprints within r bits differ by at most r in every one of these coordinates: candidate pairs that
differ by more in any are discarded on the table, and survivors are verified on the fingerprints. Candidates meet in
bands: of r + 1 bands of bits at least one is equal if at most r bits differ. Groups of a band value that are too large
for one task are split by bands of their remaining bits, which loses no pair, as the same argument holds there.

Links inside a group are joined to local components before anything is sent, so that no group's pairs are ever rows;
components over all groups are found with alternating star contractions, each round cut by a checkpoint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aliased, cut, join_counted, map_texts, pick, restored, small_batches

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Groups beyond this many distinct fingerprints are split by further bands; so many levels at most.
LARGE_GROUP, LEVELS = 4096, 3
#: Rows that the linking step takes together.
LINK_ROWS = 200_000
#: Tables of links and classes have a partition for so many nodes, and LEAST_PARTS at least.
PART_NODES, LEAST_PARTS = 50_000, 8
_BLOCK = 1 << 16


def pivots(n: int = 16) -> list[int]:
    """Reference fingerprints from splitmix64, fixed for all runs."""
    out, state, m = [], 0x5EED, (1 << 64) - 1
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & m
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        out.append(z ^ (z >> 31))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str, k: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the k-word shingles of a text (A-Z lower-cased; fewer words: all of them), in blocks."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII letters and the six blanks alone
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    starts, ends = starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist()
    for lo in range(0, n, _BLOCK):
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[lo : lo + _BLOCK], ends[lo : lo + _BLOCK], strict=True)], dtype=np.uint64)


def fingerprint(text: str, k: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text; 0 where it has no word."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, k, seed):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return signed(int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")) if n else 0


def fingerprints(df: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (bigint) of each row; null text has fingerprint 0, as texts without words have."""

    def make():
        return lambda texts: {"fp": [fingerprint(t or "", k) for t in texts]}

    return map_texts(pick(df, {"doc_id": id_col, "text": text_col}), make, [("fp", "bigint", pa.int64())])


def pivot_table(distinct: DataFrame) -> DataFrame:
    """fp with its distances to the 16 pivots, eight to a bigint (columns pa, pb)."""
    ps = pivots()

    def packed(some: list[int]):
        out = F.lit(0).cast("bigint")
        for k, p in enumerate(some):
            out = out.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("bigint"), 8 * k))
        return out

    return distinct.select("fp", packed(ps[:8]).alias("pa"), packed(ps[8:]).alias("pb"))


def masks(bits: list[int], bands: int) -> list[list[int]]:
    """Deal bit numbers over bands, evenly and interleaved."""
    return [bits[i::bands] for i in range(bands)]


def mask_of(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def banded(table: DataFrame, radius: int, levels: int = LEVELS, large: int = LARGE_GROUP) -> DataFrame:
    """Rows of the pivot table under each group they meet in: columns key (string path of band values), fp, pa, pb."""
    bands = radius + 1
    top = masks(list(range(64)), bands)

    def keyed(rows: DataFrame, groups: list[list[int]], base) -> DataFrame:
        keys = F.array(*[F.concat(base, F.lit(f"{i}."), F.hex(F.col("fp").bitwiseAND(F.lit(mask_of(g)))), F.lit("/")) for i, g in enumerate(groups)])
        return rows.withColumn("key", F.explode(keys))

    open_rows = keyed(table, top, F.lit("")).withColumn("path", F.lit(""))
    done = None
    paths = {"": list(range(64))}
    for level in range(levels):
        sizes = open_rows.groupBy("key").count().where(F.col("count") > large).select("key", F.lit(True).alias("hot"))
        hot = cut(sizes)
        if level == levels - 1 or hot.isEmpty():
            break
        marked = open_rows.join(hot, "key", "left")
        settled = marked.where("hot is null").select("key", "fp", "pa", "pb")
        done = settled if done is None else done.unionByName(settled)
        more, deeper = None, {}
        for path, bits in paths.items():  # which bits remain depends on the bands taken so far, a few dozen cases at most
            for i, g in enumerate(masks(bits, bands)):
                rest = [b for b in bits if b not in set(g)]
                if len(rest) < bands:
                    continue
                deeper[f"{path}{i}"] = rest
                part = marked.where(F.col("hot") & (F.col("path") == path) & F.col("key").rlike(rf"(^|/){i}\.[0-9A-F]+/$"))
                part = part.withColumnRenamed("key", "up")
                part = keyed(part, masks(rest, bands), F.col("up")).withColumn("path", F.lit(f"{path}{i}")).select("fp", "pa", "pb", "key", "path")
                more = part if more is None else more.unionByName(part)
        if more is None:
            break
        open_rows, paths = cut(more), deeper
    last = open_rows.select("key", "fp", "pa", "pb")
    return last if done is None else done.unionByName(last)


def _components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least-index labels after joining a[i] with b[i]."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        hi, lo = np.maximum(la, lb), np.minimum(la, lb)
        np.minimum.at(label, hi, lo)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def apart_by(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows a and b; fp holds one 64-bit word a row, or several."""
    x = np.bitwise_count(fp[a] ^ fp[b])
    return x if fp.ndim == 1 else x.sum(axis=1, dtype=np.int32)


def link_groups(group: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group and first pivot distance: the index of each row's local component (its least row)."""
    n = len(fp)
    label = np.arange(n)
    here = np.arange(n)
    first = table[:, 0].astype(np.int16)
    held_a, held_b, held = [], [], 0
    shift = 1
    while True:
        here = here[here + shift < n]
        here = here[(group[here] == group[here + shift]) & (first[here + shift] - first[here] <= radius)]
        if not len(here):
            break
        for lo in range(0, len(here), 1 << 18):
            i = here[lo : lo + (1 << 18)]
            for cols in (slice(0, 4), slice(4, 8), slice(8, 16)):  # coordinates in steps: most pairs go at the first
                gap = np.abs(table[i, cols].astype(np.int16) - table[i + shift, cols].astype(np.int16)).max(axis=1)
                i = i[gap <= radius]
            i = i[apart_by(fp, i, i + shift) <= radius]
            if len(i):
                held_a.append(i)
                held_b.append(i + shift)
                held += len(i)
        if held > 1 << 20:
            label, held_a, held_b, held = _components(n, np.concatenate(held_a), np.concatenate(held_b), label), [], [], 0
        shift += 1
    if held:
        label = _components(n, np.concatenate(held_a), np.concatenate(held_b), label)
    return label


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that span, within each group, what links at `radius` bits or fewer connect."""
    spark = distinct.sparkSession
    small_batches(spark)
    rows = banded(pivot_table(distinct), radius)
    rows = rows.select(F.xxhash64("key").alias("g"), "fp", "pa", "pb").repartition("g").sortWithinPartitions("g", F.col("pa").bitwiseAND(255))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def link(m: np.ndarray) -> pa.RecordBatch:
            fp = m[:, 1].astype(np.uint64)
            table = np.ascontiguousarray(m[:, 2:4]).view(np.uint8)
            label = link_groups(m[:, 0], fp, table, radius)
            i = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_pydict({"u": m[i, 1], "v": m[label[i], 1]})

        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
            size += len(held[-1])
            if size >= LINK_ROWS:
                m = np.concatenate(held)
                end = np.searchsorted(m[:, 0], m[-1, 0])  # the last group may go on
                if end:
                    yield link(m[:end])
                held, size = [m[end:]], len(m) - end
        if size:
            yield link(np.concatenate(held))

    return rows.mapInArrow(run, "u bigint, v bigint").where("u <> v").distinct()


def forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that connect what the given ones connect: each task's pieces are cut down to stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(m: np.ndarray) -> np.ndarray:
            nodes, at = np.unique(m, return_inverse=True)
            at = at.reshape(m.shape)
            label = _components(len(nodes), at[:, 0], at[:, 1], np.arange(len(nodes)))
            i = np.flatnonzero(label != np.arange(len(nodes)))
            return np.stack([nodes[i], nodes[label[i]]], axis=1)

        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
            if sum(map(len, held)) > LINK_ROWS:
                held = [done(np.concatenate(held))]
                if len(held[0]) > LINK_ROWS // 2:
                    yield pa.RecordBatch.from_pydict({"u": held[0][:, 0], "v": held[0][:, 1]})
                    held = []
        if held:
            m = done(np.concatenate(held))
            yield pa.RecordBatch.from_pydict({"u": m[:, 0], "v": m[:, 1]})

    return edges.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, parts: int | None = None, rounds: int = 50) -> DataFrame:
    """Connected components by alternating large and small stars: rows (node, root), root the least node; nodes without an
    edge are absent. Joins are by node; adaptive execution splits those of a node with very many neighbours."""
    small_batches(edges.sparkSession)
    e = cut(forest(edges).distinct(), parts)
    for _ in range(rounds):
        # done when all edges lead to roots, and each node has one
        ends = e.select(F.col("u").alias("k"), F.lit(1).alias("down")).unionByName(e.select(F.col("v").alias("k"), F.lit(0).alias("down")))
        if ends.groupBy("k").agg(F.sum("down").alias("downs"), F.min("down").alias("up")).where("downs > 1 or downs = 1 and up = 0").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node hands its lesser neighbours, and itself, to the least of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        hand = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(hand.unionByName(small_low.select("u", F.col("m").alias("v"))).distinct(), parts)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id from rows (doc_id, fp): the least doc_id that links of `radius` bits or fewer reach."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    comp = components(near_links(distinct.select("fp"), radius), max(LEAST_PARTS, distinct.count() // PART_NODES))
    roots = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    found = join_counted(roots, least, "root", "m").select("fp", "component_id", "n")
    return join_counted(prints, found, "fp", "n").select("doc_id", "fp", "component_id")


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id.

    Null texts and texts without words have fingerprint zero and link like others. Null ids pass through and never are
    the least id of a class (null, where no row of a class has one). Repeated rows share their class. Empty tables give
    empty results; further columns are not read.
    """
    prints = cut(fingerprints(df, k, id_col, text_col))
    out = classes(prints, radius)
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by wide fingerprints -----------------------------------------------------------------------------------

#: Words of a shingle, least Jaccard similarity of two shingle sets, 64-bit words of a wide fingerprint, and the radius in
#: bits within which similarity is computed: sets at 0.8 differ in 19 of 128 bits on average, with a deviation of 4.
WIDE_SHINGLE, SIMILAR, WIDE_WORDS, WIDE_RADIUS = 5, 0.8, 2, 28
#: Fingerprints meet where sampled bits are equal in one of TABLES samples. As many bits are sampled as leave about
#: 2 ** SPARE_BITS strangers together, whatever the number of fingerprints, and KEY_BITS at least.
TABLES, KEY_BITS, SPARE_BITS = 8, 12, 2
#: Up to so many ids (8 bytes each) a set of ids is broadcast; beyond, joins on them shuffle.
BROADCAST_IDS = 1 << 20
#: Documents and list length of the sample that says which shingles are frequent: it sets an order, nothing is left out by it.
ORDER_DOCUMENTS, ORDER_SHINGLES = 10_000, 1 << 18
#: Posting lists up to this size are paired many at a time.
SMALL_LIST = 64
#: Rows of a shingle's list in one block: more are dealt over blocks, each two of which are a task's work.
LIST_ROWS = 4096
#: Counts of a set's shingles by the last bits of their hashes, a byte each, bound what two sets share.
CELLS = 128


def mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th 64-bit hash made from a hash (splitmix64's finaliser); the 0th is the hash itself."""
    if not j:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * j) & ((1 << 64) - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide_fingerprint(text: str, k: int = WIDE_SHINGLE, words: int = WIDE_WORDS) -> list[int]:
    """SimHash of 64 * words bits over the distinct shingles, as signed 64-bit words."""
    return wide_bits(distinct_hashes(text, k), words)


def wide_bits(h: np.ndarray, words: int = WIDE_WORDS) -> list[int]:
    if not len(h):
        return [0] * words
    ones = np.stack([np.unpackbits(mixed(h, j).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for j in range(words)])
    return np.packbits(ones * 2 > len(h), axis=1).reshape(-1, 8).view(">i8").astype(np.int64)[:, 0].tolist()


def cells(h: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of CELLS cells; all 255 where a count would not fit a byte."""
    n = np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return (n if n.max(initial=0) < 255 else np.full(CELLS, 255)).astype(np.uint8).tobytes()


def wide_fingerprints(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, same (a digest of the words, A-Z lower-cased), cells and f0 .. of each row."""
    def make():
        def run(texts):
            out = {"same": [], "cells": [], **{f"f{j}": [] for j in range(WIDE_WORDS)}}
            for t in texts:
                h = distinct_hashes(t or "", k)
                out["same"].append(hashlib.blake2b(b" ".join((t or "").encode().lower().split()), digest_size=16).digest())
                out["cells"].append(cells(h))
                for j, f in enumerate(wide_bits(h)):
                    out[f"f{j}"].append(f)
            return out

        return run

    return map_texts(pick(df, {"doc_id": id_col, "text": text_col}), make, [("same", "binary", pa.binary()), ("cells", "binary", pa.binary()), *[(f"f{j}", "bigint", pa.int64()) for j in range(WIDE_WORDS)]])


def wide_pivots(n: int = 16) -> np.ndarray:
    return np.array(pivots(n * WIDE_WORDS), dtype=np.uint64).reshape(n, WIDE_WORDS)


def samples(bits: int) -> np.ndarray:
    """The bit numbers of each table's key."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(64 * WIDE_WORDS)[:bits] for _ in range(TABLES)])


def stars(group: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (hub, row) within the radius for rows sorted by group, at most one a row, so fewer than rows in any group.

    In every group at once: the first row left leads; of the rows left near it the one nearest to the majority of their
    bits is the hub; it links the leader and what is near it, and these leave. Near: no pivot coordinate differs by more
    than the radius, and no more bits do.
    """
    left, hubs, rows = np.arange(len(fp)), [], []

    def near(center: np.ndarray, some: np.ndarray) -> np.ndarray:
        ok = np.abs(table[center] - table[some]).max(axis=1) <= radius
        ok[ok] = apart_by(fp, center[ok], some[ok]) <= radius
        return ok

    while len(left):
        starts = np.flatnonzero(np.concatenate(([True], group[left][1:] != group[left][:-1])))
        sizes = np.diff(np.concatenate((starts, [len(left)])))
        leader = left[starts]
        close = near(np.repeat(leader, sizes), left)
        circle, of = left[close], np.repeat(np.arange(len(starts)), sizes)[close]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        count = np.diff(np.concatenate((first, [len(of)])))
        several = np.flatnonzero(count > 1)  # the others lead nobody
        hub = leader.copy()
        if len(several):
            inside = np.repeat(count > 1, count)
            c, o = circle[inside], np.repeat(np.arange(len(several)), count[several])
            bounds = np.concatenate(([0], np.cumsum(count[several])[:-1]))
            ones = np.add.reduceat(np.unpackbits(fp[c].view(np.uint8).reshape(len(c), -1), axis=1), bounds, axis=0, dtype=np.int64)
            middle = np.packbits(ones * 2 > count[several][:, None], axis=1).view(np.uint64)
            far = np.bitwise_count(fp[c] ^ middle[o]).sum(axis=1, dtype=np.int64)
            hub[several] = c[np.lexsort((c, far, o))[bounds]]
            rest = np.repeat(hub, sizes)
            alone = np.repeat(hub == leader, sizes)
            taken = np.where(alone, close, False)
            taken[~alone] = near(rest[~alone], left[~alone])
            taken[starts] = True
            link = taken & (left != rest)
            hubs.append(rest[link])
            rows.append(left[link])
        else:
            taken = np.zeros(len(left), dtype=bool)
            taken[starts] = True
        left = left[~taken]
    return (np.concatenate(hubs), np.concatenate(rows)) if hubs else (np.arange(0), np.arange(0))


def whole_groups(batches: Iterator[pa.RecordBatch], link) -> Iterator[pa.RecordBatch]:
    """link(rows) for pieces of sorted rows that end where the first column changes."""
    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
        size += len(held[-1])
        if size >= LINK_ROWS:
            m = np.concatenate(held)
            end = np.searchsorted(m[:, 0], m[-1, 0])  # the last group may go on
            if end:
                yield from link(m[:end])
            held, size = [m[end:]], len(m) - end
    if size:
        yield from link(np.concatenate(held))


def wide_pairs(nodes: DataFrame, n: int, radius: int) -> DataFrame:
    """Pairs (u, v) of the n nodes (node, f0 ..) that meet in a table and differ in at most `radius` bits: for each node and
    table the hub of its star alone."""
    spark = nodes.sparkSession
    small_batches(spark)
    names = [f"f{j}" for j in range(WIDE_WORDS)]
    bits = min(48, max(KEY_BITS, n.bit_length() - SPARE_BITS))
    ddl = "key bigint, node bigint, " + ", ".join(f"{n} bigint" for n in names)
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), *[(n, pa.int64()) for n in names]])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = samples(bits), 1 << np.arange(bits)
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            on = np.unpackbits(np.stack(cols[1:], axis=1).view(np.uint8), axis=1, bitorder="little")
            key = np.concatenate([(t << bits) + on[:, at[t]].astype(np.int64) @ weight for t in range(TABLES)])
            yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(np.tile(c, TABLES)) for c in cols]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ps = wide_pivots()

        def link(m: np.ndarray) -> Iterator[pa.RecordBatch]:
            same = m[1:, 0] == m[:-1, 0]
            m = m[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(m) > 1 else m[:0]
            if len(m):
                fp = np.ascontiguousarray(m[:, 2:]).view(np.uint64)
                table = np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int16) for p in ps], axis=1)
                a, b = stars(m[:, 0], fp, table, radius)
                yield pa.RecordBatch.from_pydict({"u": m[a, 1], "v": m[b, 1]})

        yield from whole_groups(batches, link)

    dealt = nodes.select("node", *names).mapInArrow(deal, ddl)
    pairs = dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "u bigint, v bigint")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def fine_cells(h: np.ndarray) -> bytes:
    """A set's counts as in cells(), over a power of two of cells, half as many as the set has hashes or more."""
    size = 64
    while size < len(h) // 2:
        size *= 2
    n = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) <= 255 else b""


def may_be_similar(a: bytes, b: bytes, na: int, nb: int, least: float) -> bool:
    """False only where two sets' fine cells rule the similarity out."""
    if not a or not b:
        return True
    x, y = (np.frombuffer(c, dtype=np.uint8).astype(np.int64) for c in (a, b))
    while len(x) > len(y):
        x = x.reshape(2, -1).sum(0)
    while len(y) > len(x):
        y = y.reshape(2, -1).sum(0)
    return bool(np.minimum(x, y).sum() >= least / (1 + least) * (na + nb) - 1e-6)


def similar(pairs: DataFrame, df: DataFrame, k: int, least: float, parts: int | None = None) -> DataFrame:
    """The pairs whose texts' shingle sets have at least that Jaccard similarity. Counts by cell, a byte for two shingles or
    less, leave few pairs; the shingles of these are compared. Only texts of pairs are shingled."""

    def joined(pairs: DataFrame, describe: Callable[[np.ndarray], bytes]) -> DataFrame:
        """u, v, and for each of them n (its shingles) and what it is described by: columns na, a, nb, b."""
        ids = pairs.select(F.col("u").alias("_i")).unionByName(pairs.select(F.col("v").alias("_i"))).distinct()

        def make():
            def run(texts):
                sets = [distinct_hashes(t or "", k) for t in texts]
                return {"n": [len(h) for h in sets], "same": [hashlib.blake2b(h.tobytes(), digest_size=8).digest() for h in sets], "c": [describe(h) for h in sets]}

            return run

        each = map_texts(with_ids(df, ids, "doc_id", "left_semi"), make, [("n", "bigint", pa.int64()), ("same", "binary", pa.binary()), ("c", "binary", pa.binary())])
        # stored, so that both sides of the joins are plain shuffles: adaptive execution then splits the pairs of a hub
        each = cut(each.groupBy(F.col("doc_id").cast("bigint").alias("_i")).agg(F.max(F.struct("n", "same", "c")).alias("x")).select("_i", "x.n", "x.c"), parts)
        a, b = (each.select(F.col("_i").alias(c), F.col("n").alias(f"n{x}"), F.col("c").alias(x)) for c, x in (("u", "a"), ("v", "b")))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "na", "a", "nb", "b")

    def kept(rows: DataFrame, test: Callable[[tuple], bool]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m in batches:
                keep = pa.array(np.flatnonzero([test(r) for r in zip(*(m.column(i).to_pylist() for i in range(2, 6)), strict=True)]))
                yield pa.RecordBatch.from_arrays([m.column(0).take(keep), m.column(1).take(keep)], names=["u", "v"])

        return rows.mapInArrow(run, "u bigint, v bigint")

    def shared(r: tuple) -> bool:
        p, q = (np.frombuffer(x, dtype=np.uint64) for x in (r[1], r[3]))
        both = len(np.intersect1d(p, q, assume_unique=True))
        total = len(p) + len(q) - both
        return total == 0 or both >= least * total

    some = cut(kept(joined(pairs, fine_cells), lambda r: may_be_similar(r[1], r[3], r[0], r[2], least)), parts)
    return kept(joined(some, np.ndarray.tobytes), shared)


def frequent_shingles(texts: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that occur in three or more texts of a sample, and in how many."""
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // ORDER_DOCUMENTS))) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [distinct_hashes(t or "", k) for t in b.column(0).to_pylist()]
            if each:
                h, often = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": often})

    got = some.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    h, often = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    by = np.argsort(h)
    return h[by], often[by]


def distinct_hashes(text: str, k: int) -> np.ndarray:
    parts = [np.unique(h) for h in shingle_hashes(text, k)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def prefix(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles, rare ones first, of a set of distinct ones: two sets of similarity `least` share one of these."""
    often = np.zeros(len(h), dtype=np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], h), len(frequent[0]) - 1)
        often = np.where(frequent[0][at] == h, frequent[1][at], 0)
    return h[np.lexsort((h, often))][: len(h) - int(np.ceil(least * len(h) - 1e-6)) + 1]


def list_pairs(m: np.ndarray, held: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes from rows (list, node, root, size << 32 | place, side), their cells beside them, sorted by list: those
    of one list that have different roots, but for pairs whose sizes, or what follows the shingle in them, or cells rule
    the similarity out. A pair that passes does so at the first shingle it shares, so none is lost. A list is the rows of a
    shingle (side -1), or two blocks of them (sides 0 and 1) of which one meets the other."""
    starts = np.flatnonzero(np.concatenate(([True], m[1:, 0] != m[:-1, 0])))
    sizes = np.diff(np.concatenate((starts, [len(m)])))
    size, after = m[:, 3] >> 32, (m[:, 3] >> 32) - (m[:, 3] & 0xFFFFFFFF)
    unknown = held[:, 0] == 255

    def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of these pairs may be similar."""
        s, t = size[a], size[b]
        least_both = least / (1 + least) * (s + t) - 1e-6
        ok = np.flatnonzero((m[a, 2] != m[b, 2]) & ((m[a, 4] < 0) | (m[a, 4] != m[b, 4])) & (np.minimum(s, t) >= least * np.maximum(s, t) - 1e-6) & (np.minimum(after[a], after[b]) >= least_both))
        for lo in range(0, len(ok), 1 << 16):
            i = ok[lo : lo + (1 << 16)]
            both = np.minimum(held[a[i]], held[b[i]]).sum(axis=1, dtype=np.int64)
            ok[lo : lo + (1 << 16)] = np.where((both >= least_both[i]) | unknown[a[i]] | unknown[b[i]], i, -1)
        return ok[ok >= 0]

    large = np.flatnonzero(sizes > SMALL_LIST)
    for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
        # the root with the most rows comes first: none of its rows meet each other
        _, root, count = np.unique(m[s : s + n, 2], return_inverse=True, return_counts=True)
        order = s + np.argsort(root != count.argmax(), kind="stable")
        us, vs, found = [], [], 0
        for i in range(int(count.max()), n):
            b = order[:i][fit(np.full(i, order[i]), order[:i])]
            us.append(np.full(len(b), m[order[i], 1]))
            vs.append(m[b, 1])
            found += len(b)
            if found > LINK_ROWS or i == n - 1:
                yield np.concatenate(us), np.concatenate(vs)
                us, vs, found = [], [], 0
    here, shift = np.flatnonzero(np.repeat(sizes <= SMALL_LIST, sizes)), 1
    while len(here):
        here = here[here + shift < len(m)]
        here = here[m[here, 0] == m[here + shift, 0]]
        near = here[fit(here, here + shift)]
        if len(near):
            yield m[near, 1], m[near + shift, 1]
        shift += 1


def prefix_lists(roots: DataFrame, n: int, df: DataFrame, k: int, least: float) -> DataFrame:
    """Rows (h, node, root, at) of the shingles in rare-first prefixes that nodes (node, root) of different roots share."""
    spark = roots.sparkSession
    small_batches(spark)
    right = F.broadcast(roots) if n <= BROADCAST_IDS else roots.hint("merge")
    texts = df.join(right, F.col("doc_id").cast("bigint") == F.col("node"))
    sent = spark.sparkContext.broadcast(frequent_shingles(texts, n, k))
    names = ("h", "node", "root", "at")
    ddl = ", ".join(f"{c} bigint" for c in names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for b in batches:
            parts = []
            for t, node, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = distinct_hashes(t or "", k)
                if len(h):
                    first = prefix(h, frequent, least)
                    parts.append(np.stack([first.view(np.int64), *(np.full(len(first), x, dtype=np.int64) for x in (node, root)), (len(h) << 32) + np.arange(len(first))]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(parts, axis=1)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shared(m: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], m[1:, 0] != m[:-1, 0])))
            apart = np.minimum.reduceat(m[:, 2], starts) != np.maximum.reduceat(m[:, 2], starts)
            m = m[np.repeat(apart, np.diff(np.concatenate((starts, [len(m)]))))]
            if len(m):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.ascontiguousarray(m.T)], names=names)

        yield from whole_groups(batches, shared)

    return texts.select("text", "node", "root").mapInArrow(deal, ddl).repartition("h").sortWithinPartitions("h").mapInArrow(run, ddl)


def split_lists(lists: DataFrame, block: int) -> DataFrame:
    """Rows (h, node, root, at, side): lists of more than `block` rows are dealt over blocks by node, and each two blocks of a
    list are a list of their own, so that a shingle that a template gives to any number of texts is tried by many tasks."""
    large = cut(lists.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > block).select("h", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    if large.isEmpty():
        return lists.withColumn("side", F.lit(-1).cast("bigint"))
    large = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    d = lists.join(large, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    d = d.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    side = F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1).cast("bigint")
    h = F.when(F.col("blocks") > 1, F.xxhash64("h", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("h"))
    return d.select(h.alias("h"), "node", "root", "at", side.alias("side"))


def prefix_pairs(lists: DataFrame, sketches: DataFrame, least: float, block: int = LIST_ROWS) -> DataFrame:
    """Pairs (u, v) of nodes with different roots, among them all whose similarity is `least` or more, from the rows of
    prefix_lists() and the cells of each node."""
    small_batches(lists.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                m = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(5)], axis=1)
                yield m, np.frombuffer(b"".join(b.column(5).to_pylist()), dtype=np.uint8).reshape(-1, CELLS)

        def link(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            m, held = (np.concatenate(x) for x in zip(*parts, strict=True))
            for u, v in list_pairs(m, held, least):
                both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
                yield pa.RecordBatch.from_pydict({"u": both[:, 0], "v": both[:, 1]})

        parts, size = [], 0
        for m, held in rows():
            end = np.searchsorted(m[:, 0], m[-1, 0]) if size + len(m) >= LINK_ROWS // 4 else 0  # the last group may go on
            if end:
                yield from link([*parts, (m[:end], held[:end])])
                parts, size = [], 0
            parts.append((m[end:], held[end:]))
            size += len(m) - end
        if parts:
            yield from link(parts)

    rows = split_lists(lists, block).join(sketches, "node").select("h", "node", "root", "at", "side", "cells")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "u bigint, v bigint").distinct()


def with_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi- or anti-join with a set of ids (column _i) that is cheap to compute: broadcast while it is small, else shuffled by id."""
    right = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return df.join(right, F.col(id_col) == F.col("_i"), how)


def near_copy_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WIDE_SHINGLE, least: float = SIMILAR, radius: int = WIDE_RADIUS) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable) of rows with an id, by links between texts whose word shingles
    have a Jaccard similarity of `least` or more.

    Wide fingerprints, by their pivot tables, link most of what is near in few pairs: a star for each group. Shingles that
    rare-first prefixes share then name every pair that these left in different classes and that may reach the similarity,
    so none is lost. Similarity itself is computed on the shingle sets and decides on both.

    Equal texts (but for blanks and the case of A-Z) are one node from the start; texts without words, null ones too, are
    all alike. Ids must be whole numbers; rows that share an id are one document, rows with null ids are left out.
    """
    d = pick(df.where(F.col(f"`{id_col}`").isNotNull()), {"doc_id": id_col, "text": text_col})
    prints = cut(wide_fingerprints(d, k, "doc_id", "text"))
    names = [f"f{j}" for j in range(WIDE_WORDS)]
    nodes = cut(prints.groupBy("same").agg(F.min("doc_id").cast("bigint").alias("node"), F.count("*").alias("n"), *[F.first(n).alias(n) for n in ("cells", *names)]))
    n = nodes.count()
    parts = max(LEAST_PARTS, n // PART_NODES)
    links = cut(similar(cut(wide_pairs(nodes.select("node", *names), n, radius), parts), d, k, least, parts), parts)
    comp = components(links, parts)
    known = nodes.select("node").distinct().join(comp.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    roots = cut(known.select("node", F.coalesce("root", "node").alias("root")), parts)
    lists = cut(prefix_lists(roots, n, d, k, least))
    more = cut(similar(cut(prefix_pairs(lists, nodes.groupBy("node").agg(F.first("cells").alias("cells")), least), parts), d, k, least, parts), parts)
    if not more.isEmpty():  # what is linked now are classes
        by = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("u", "v"))
        again = components(more.join(next(by), "u").join(next(by), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")), parts)
        roots = cut(roots.join(again.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left").select("node", F.coalesce("_r", "root").alias("root")), parts)
    found = nodes.select("same", "node", "n").join(roots, "node").select("same", F.col("root").alias("component_id"), "n")
    return join_counted(prints.select("doc_id", "same"), found, "same", "n").select(F.col("doc_id").alias(id_col), "component_id")


def keep_one(df: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of df without those whose id isn't the least of its class; rows with null ids stay. Of rows that repeat a kept
    id one stays: these ids are found among ids alone, and only their rows are compared. Columns may have any names."""
    gone = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_i")).distinct()
    twice = classes.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_col).alias("_i"))
    d, back = aliased(df)
    key = next(n for n, c in back.items() if c == id_col)
    kept = with_ids(d, gone, key, "left_anti")
    if twice.isEmpty():
        return restored(kept, back)
    twice = cut(twice)
    first = Window.partitionBy(key).orderBy(F.xxhash64(*back))
    repeats = with_ids(kept, twice, key, "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return restored(with_ids(kept, twice, key, "left_anti").unionByName(repeats), back)
