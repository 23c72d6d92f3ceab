"""SimHash classes, near copies and improbable-feature digests against brute force."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import improbable, queries, simhash
from lodestar.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps, radius=2):
    """Least reachable key, comparing everything with everything."""
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(fps)
    u = np.array([fps[k] for k in keys], dtype=np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= radius):
            a, b = find(k), find(keys[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {k: fingerprint(t) for k, t in docs.items()}
    want = classes(fps)
    got = queries.op2_simhash_pivots(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("large", [4096, 20])
def test_classes_of_clustered_fingerprints(spark, large, monkeypatch):
    monkeypatch.setattr(simhash.banded, "__defaults__", (simhash.LEVELS, large))
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(10)]
    fps = {}
    for i in range(1200):
        x = r.choice(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 9])):
            x ^= 1 << r.randrange(64)
        fps[i] = x
    want = classes(fps)
    d = cut(spark.createDataFrame([(k, simhash.signed(v)) for k, v in fps.items()], "doc_id bigint, fp bigint"))
    assert all(want[x["doc_id"]] == x["component_id"] for x in simhash.classes(d).collect())


EDGE = [(1, "A b C"), (2, "a B c"), (2, "a B c"), (None, "a b c"), (5, None), (6, ""), (7, " \t\n"), (8, "w" * 10_000), (9, "x y " * 20_000)]


def test_simhash_edges(spark):
    d = spark.createDataFrame(EDGE, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.simhash_classes(d).collect())
    want = classes({k: fingerprint(t) for k, t in EDGE if k is not None})
    assert got == sorted((str(k), f"{fingerprint(t):016x}", want.get(k, 1)) for k, t in EDGE)
    assert simhash.simhash_classes(d.limit(0)).count() == 0
    kept = simhash.keep_one(d, cut(simhash.near_copy_classes(d)))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "5", "8", "9", "None"] and kept.columns == d.columns
    assert simhash.keep_one(d.limit(0), cut(simhash.near_copy_classes(d.limit(0)))).count() == 0


def similarity(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, pairs = [], []
    for b in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 400))]
        rows.append((10 * b, " ".join(words)))
        for c in range(1, r.randint(1, 6)):
            edited = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 40))):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            rows.append((10 * b + c, " ".join(edited)))
            pairs.append((10 * b, 10 * b + c))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copy_classes(d).collect()}
    text = dict(rows)
    near = [p for p in pairs if similarity(text[p[0]], text[p[1]]) >= 0.8]
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near) > 0
    assert all(c // 10 == k // 10 for k, c in got.items()), "unrelated documents stay apart"


def clusters(n, many, flips, seed=2):
    """n fingerprints around `many` middles, shuffled."""
    r = random.Random(seed)
    base = [r.getrandbits(128) for _ in range(many)]
    fps = []
    for i in range(n):
        x = base[i % many]
        for _ in range(r.randint(0, flips)):
            x ^= 1 << r.randrange(128)
        fps.append(x)
    fp = np.array([[x & (1 << 64) - 1, x >> 64] for x in fps], dtype=np.uint64)
    return fp, np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int16) for p in simhash.wide_pivots()], axis=1)


@pytest.mark.parametrize("n", [1500, 3000, 6000])
def test_a_group_of_clusters_gives_less_than_a_pair_a_row(n):
    fp, table = clusters(n, 20, 12)
    a, b = simhash.stars(np.zeros(n, dtype=np.int64), fp, table, simhash.WIDE_RADIUS)
    label = simhash._components(n, a, b, np.arange(n))
    assert len(a) < n and len(np.unique(b)) == len(b)
    assert len(np.unique(label)) == 20 and all(len(np.unique(label[i::20])) == 1 for i in range(20))
    assert (simhash.apart_by(fp, a, b) <= simhash.WIDE_RADIUS).all()


def test_stars_of_many_groups_at_once():
    fp, table = clusters(600, 30, 30)
    group = np.sort(np.random.default_rng(1).integers(0, 40, 600))
    a, b = simhash.stars(group, fp, table, simhash.WIDE_RADIUS)
    assert (group[a] == group[b]).all() and (simhash.apart_by(fp, a, b) <= simhash.WIDE_RADIUS).all() and len(np.unique(b)) == len(b)
    for g in range(40):  # one group gives the same alone
        at = np.flatnonzero(group == g)
        x, y = simhash.stars(np.zeros(len(at), dtype=np.int64), fp[at], table[at], simhash.WIDE_RADIUS)
        assert sorted(zip(at[x], at[y], strict=True)) == sorted((i, j) for i, j in zip(a, b, strict=True) if group[i] == g)
    linked = {*a.tolist(), *b.tolist()}
    for i in set(range(600)) - linked:
        assert not any(group[j] == group[i] and simhash.apart_by(fp, np.array([i]), np.array([j]))[0] <= simhash.WIDE_RADIUS for j in set(range(600)) - linked - {i})


def test_one_large_family(spark):
    """1,500 texts, each a few words off its forebear, and strangers: exactly the classes of all pairs of 0.8 or more."""
    r = random.Random(13)
    rows, made = [], []
    for i in range(1500):
        if i % 10 == 9:
            words = [f"x{i}y{j}" for j in range(60)]
        else:
            words = list(r.choice(made[-80:])) if made else [f"w{j}" for j in range(60)]
            for at in r.sample(range(60), r.randint(0, 2)):
                words[at] = f"e{i}z{at}"
            made.append(words)
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    where = collections.defaultdict(set)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        for j in set().union(*(where[x] for x in s)):
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            where[x].add(i)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copy_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 200


def test_cells_never_rule_out_similar_sets():
    r = np.random.default_rng(3)
    ruled = 0
    for n in (0, 1, 4, 40, 130, 700, 5000):
        for share in (0.3, 0.6, 0.79, 0.8, 0.81, 0.95, 1.0):
            for more in (1.0, 1.2):
                a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
                m = int(len(a) * more)
                both = min(len(a), m, round(share * (len(a) + m) / (1 + share)))
                b = np.unique(np.concatenate((a[:both], r.integers(0, 1 << 63, m - both, dtype=np.uint64))))
                jaccard = len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))
                fine = simhash.may_be_similar(simhash.fine_cells(a), simhash.fine_cells(b), len(a), len(b), 0.8)
                x, y = (np.frombuffer(simhash.cells(h), dtype=np.uint8).astype(int) for h in (a, b))
                coarse = x[0] == 255 or y[0] == 255 or np.minimum(x, y).sum() >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-6
                assert jaccard < 0.8 or fine and coarse
                ruled += not fine
    assert ruled > 15
    crowded = np.arange(600, dtype=np.uint64) << np.uint64(20)
    assert set(simhash.cells(crowded)) == {255} and simhash.fine_cells(crowded) == b"" and simhash.may_be_similar(b"", b"\x01" * 64, 600, 64, 0.8)


def test_components_of_paths_and_stars(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 90)] + [(100, x) for x in range(101, 400)] + [(500 + 2 * i, 501 + 2 * i) for i in range(50)] + [(7, 3), (3, 7), (1000, 120)]
    names = list(range(1001))
    r.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    want = {}
    for a, b in edges:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)).collect()}
    assert got == {k: v for k, v in want.items() if k != v}
    assert simhash.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_heavy_keys_join_without_a_shuffle(spark, monkeypatch):
    from lodestar.llm import common

    monkeypatch.setattr(common, "HEAVY", 3)
    d = spark.createDataFrame([(i, "a" if i < 10 else f"k{i // 2}") for i in range(20)], "doc_id bigint, same string")
    right = d.groupBy("same").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    got = common.join_counted(d, right, "same", "n")
    assert sorted((x["doc_id"], x["same"], x["least"]) for x in got.collect()) == sorted((i, "a" if i < 10 else f"k{i // 2}", 0 if i < 10 else i // 2 * 2) for i in range(20))


def test_star_of_near_copies(spark):
    """Copies nearer to each other than to the original, at distances of fingerprints, but under 0.8 among themselves."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(304)]
    rows = [(0, " ".join(words))]
    for c in range(1, 401):
        edited = list(words)
        for at in r.sample(range(1, 60), 6):
            edited[5 * at] = f"c{c}x{at}"
        rows.append((c, " ".join(edited)))
    text = dict(rows)
    assert all(0.8 <= similarity(text[0], text[c]) < 0.83 for c in range(1, 401)) and similarity(text[1], text[2]) < 0.8
    got = simhash.near_copy_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x["component_id"] for x in got} == {0}


def test_every_pair_at_the_similarity(spark):
    """Pairs at 0.8 exactly, and texts that differ in how often they repeat a block: none is lost, none is added."""
    r = random.Random(7)
    rows = []
    for b in range(0, 600, 2):
        words = [f"p{b}x{i}" for i in range(364)]
        edited = list(words)
        for at in r.sample(range(1, 70), 8):
            edited[5 * at] = f"q{b}x{at}"
        rows += [(b, " ".join(words)), (b + 1, " ".join(edited))]
    for b in range(600, 660, 2):
        words = [f"p{b}x{i}" for i in range(304)]
        at = r.randrange(250)
        rows += [(b, " ".join(words)), (b + 1, " ".join(words[:at] + 6 * words[at : at + 24] + words[at + 24 :]))]
    text = dict(rows)
    assert all(similarity(text[b], text[b + 1]) == 0.8 for b in range(0, 600, 2)) and all(similarity(text[b], text[b + 1]) > 0.95 for b in range(600, 660, 2))
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copy_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: k - k % 2 for k in text}


@pytest.mark.parametrize("block", [4096, 50])
def test_split_lists_give_the_same_pairs(spark, block):
    """One list of many texts, and short ones: every pair of different roots that sizes allow, whatever the blocks."""
    size = {i: 10 + i % 4 for i in range(400)}
    rows = [(7, i, i % 300, size[i] << 32) for i in range(400)] + [(8, i, i, size[i] << 32) for i in range(0, 400, 40)]
    lists = spark.createDataFrame(rows, "h bigint, node bigint, root bigint, at bigint").repartition(5)
    dense = bytes([255]) * simhash.CELLS
    sketches = spark.createDataFrame([(i, bytearray(dense)) for i in range(400)], "node bigint, cells binary")
    got = {(r["u"], r["v"]) for r in simhash.prefix_pairs(lists, sketches, 0.8, block).collect()}
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if i % 300 != j % 300 and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) - 1e-6}
    split = simhash.split_lists(lists, block)
    assert split.groupBy("h").count().agg(F.max("count")).first()[0] <= (400 if block > 400 else 3 * block)


def test_fingerprint_of_distinct_shingles():
    words = [f"w{i}" for i in range(304)]
    once, often = " ".join(words + words[:8]), " ".join(words + 9 * words[:8])
    assert similarity(once, often) > 0.98
    a, b = (np.array(simhash.wide_fingerprint(t)) for t in (once, often))
    assert np.bitwise_count((a ^ b).view(np.uint64)).sum() < 16


def brute_features(b):
    n, w, run = len(b), improbable.WINDOW, improbable.RUN
    whole = [int(x) for x in improbable._whole(b)] if b else []
    if n < w:
        return whole
    ranks = []
    for i in range(n - w + 1):
        s = sum(int(improbable._G[c]) for c in collections.Counter(b[i : i + w]).values())
        e = (int(improbable._FULL) - s) * 1024 // (w * improbable._SCALE)
        ranks.append(8192 - abs(e - int(improbable.COMMON * 1024)) if e >= improbable.LEAST * 1024 else None)
    votes = collections.Counter()
    for i in range(n - w + 1):
        if ranks[i] is not None:
            votes[min((ranks[k], k) for k in range(i, min(n - w + 1, i + run)) if ranks[k] is not None)[1]] += 1
    out, mask = [], (1 << 64) - 1
    for s in sorted(k for k, v in votes.items() if v >= improbable.POPULAR):
        h = 0x9E3779B97F4A7C15
        for k in range(w // 8):
            h = ((h ^ int.from_bytes(b[s + 8 * k : s + 8 * k + 8], "little")) * 0xFF51AFD7ED558CCD) & mask
            h ^= h >> 32
        out.append(h)
    return out or whole


def test_features(monkeypatch):
    r = random.Random(3)
    words = ["the", "of", "aaaaaaaaaaaaa", "xyz", "étè", "  ", "\n", "Qq%%%", "1234567"]
    raws = [" ".join(r.choice(words) for _ in range(r.randint(0, 80))).encode() for _ in range(40)] + [b"", b"a", b"a" * 500]
    want = [brute_features(b) for b in raws]
    assert [list(map(int, h)) for h in improbable.grouped_features(raws)] == want
    monkeypatch.setattr(improbable, "BLOCK", 300)
    monkeypatch.setattr(improbable, "BATCH", 200)
    assert [list(map(int, h)) for h in improbable.grouped_features(raws)] == want


def text_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_chain(text):
    """The number of features, and the bits set in each filter of the chain."""
    h = brute_features(text.encode())
    return len(h), [{(x >> 11 * k) & 2047 for x in h[lo : lo + 160] for k in range(5)} for lo in range(0, len(h), 160)]


def brute_likeness(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return float(not b)
    best = []
    for x in a:
        each = []
        for y in b:
            chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
            each.append((len(x & y) - chance) / (most - chance) if most > chance else float(len(x & y) == most))
        best.append(min(1.0, max(0.0, max(each))))
    return sum(best) / len(best)


def bits_of(digest):
    n, _, code = digest.partition(":")
    raw = base64.b64decode(code)
    return int(n), [{8 * i + j for i, byte in enumerate(raw[lo : lo + 256]) for j in range(8) if byte >> (7 - j) & 1} for lo in range(0, len(raw), 256)]


def test_fingerprints_and_likeness_of_the_tables(spark, sf, tmp_path):
    """The query's whole result, over the table's shorter texts, a copy, and texts without a window."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if len(r["text"] or "") < 9000][:60]
    rows += [(10**6, rows[3][1]), (10**6 + 1, rows[3][1]), (10**6 + 2, ""), (10**6 + 3, None), (10**6 + 4, "a" * 90)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_improbable_features(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    chains = [brute_chain(t or "") for _, t in rows]
    assert any(len(c) > 1 for _, c in chains)
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + following[:n]
        r, other = got[doc], brute_chain(edited)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert bits_of(r["fingerprint"]) == chains[i] and bits_of(r["edited_fingerprint"]) == other
        assert abs(r["near_edited"] - brute_likeness(chains[i][1], other[1])) < 1e-9
        assert abs(r["near_next"] - brute_likeness(chains[i][1], chains[(i + 1) % len(rows)][1])) < 1e-9


@pytest.mark.parametrize("kind", ["string", "bigint", "decimal(20,2)", "date", "timestamp"])
def test_order_of_any_ids(spark, kind):
    """Each text's next is the next in order of ids, whatever their type, also where one id fills many ranges."""
    ids = {"string": ["", "a", "a1", "b", "é", "zebra", "zebra2", None], "bigint": [-5, 0, 3, 2**62, 2**62 + 1, None], "decimal(20,2)": ["-1.50", "0.00", "0.01", None], "date": ["1999-01-01", "2020-02-03", None], "timestamp": ["1999-01-01 00:00:00", "2020-02-03 00:00:01", None]}[kind]
    r = random.Random(3)
    rows = [(str(i) if i is not None else None, f"text {k} " + "x" * r.randint(0, 9)) for k, i in enumerate(r.choices(ids, k=150))] + [(str(ids[0]), f"hot {k}") for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    seen = [(x["s"], x["text"]) for x in d.withColumn("s", F.col("doc_id").cast("string")).withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h").collect()]
    got = collections.Counter((str(x["s"]), x["edited_sha256"]) for x in improbable.fingerprint_edits(d.repartition(4)).withColumn("s", F.col("doc_id").cast("string")).collect())
    want = collections.Counter()
    for i, (s, t) in enumerate(seen):
        n = len(t) // 2
        want[str(s), hashlib.sha256((t[: len(t) - n] + seen[(i + 1) % len(seen)][1][:n]).encode()).hexdigest()] += 1
    assert got == want


def test_a_shared_id_is_cut_into_ranges(spark):
    d = spark.createDataFrame([(None if k % 3 else k, f"t{k}") for k in range(3000)], "doc_id bigint, text string")
    sizes = [x["count"] for x in improbable.with_buckets(d, 16).groupBy("b").count().collect()]
    assert sum(sizes) == 3000 + len(sizes) and max(sizes) < 600


def test_improbable_edges(spark):
    rows = [(5, "b" * 10 + " some words that are here, and others."), (1, "abc"), (1, "abd"), (None, "n"), (9, None), (7, ""), (3, "p q " * 9000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.lit("clash")).repartition(3)
    got = {(str(r["doc_id"]), r["n_chars"], r["edited_sha256"]): r for r in improbable.fingerprint_edits(d).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, text_hash(x[1] or "")))
    want = set()
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 2
        want.add((str(k), len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    assert set(got) == want
    one = improbable.fingerprint_edits(d.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["near_edited"] > 0.3
    assert improbable.fingerprint_edits(d.limit(0)).count() == 0


def test_likeness_bounds(spark, sf):
    got = queries.op5_improbable_features(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = collections.defaultdict(set)
    for r in got:
        same[docs[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.2
    assert not math.isnan(sum(r["near_edited"] for r in got))
