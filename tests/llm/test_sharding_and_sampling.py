"""The hash tree, importance resampling and periodic runs against plain Python, with their edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hash_tree, importance, periodic, queries
from lodestar.llm.hash_tree import Shard

# --- hash tree -------------------------------------------------------------------------------------------------------


def place(key, tree):
    """Region, rack and shard by plain descent."""

    def draw(name, weight):
        return -math.log((int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight

    leaves = [(s.region, s.rack, i, s.weight) for i, s in enumerate(tree) if s.weight]
    best = []
    for name in (lambda s: s[0], lambda s: f"{s[0]}/{s[1]}", lambda s: f"{s[0]}/{s[1]}/{s[2]}"):
        weights = Counter()
        for s in leaves:
            weights[name(s)] += s[3]
        best.append(min(weights, key=lambda x: draw(x, weights[x])))
        leaves = [s for s in leaves if name(s) == best[-1]]
    return leaves[0][2]


def shards_of(spark, tree, n=3000):
    d = hash_tree.descend(spark.range(n).withColumn("key", F.col("id").cast("string")), tree, "key")
    return {r["id"]: r["shard"] for r in d.select("id", "shard").collect()}


UNEVEN = (Shard("a", "x", 1.0), Shard("a", "x", 3.0), Shard("a", "y", 2.0), Shard("b", "x", 2.0), Shard("b", "it's", 0.0), Shard("c", "z", 8.0))


@pytest.mark.parametrize("tree", [hash_tree.layout(16), hash_tree.layout(18), hash_tree.layout(3), UNEVEN])
def test_descent_is_the_plain_one(spark, tree):
    got = shards_of(spark, tree)
    assert got == {i: place(str(i), tree) for i in got}
    n, whole = Counter(got.values()), sum(s.weight for s in tree)
    assert all(abs(n[i] - 3000 * s.weight / whole) < 6 * math.sqrt(3000 * s.weight / whole) + 1e-9 for i, s in enumerate(tree)), "shares go by weight; none for weight 0"


def test_movement_is_confined(spark):
    before = shards_of(spark, UNEVEN)
    for tree in (UNEVEN, hash_tree.grown(UNEVEN)):
        after = shards_of(spark, hash_tree.grown(tree))
        assert {b for i, b in after.items() if b != before[i]} == {len(tree)} and sum(a != before[i] for i, a in after.items()) > 100
        before = after
    before = shards_of(spark, UNEVEN)
    swapped = (Shard("a", "x", 3.0), Shard("a", "x", 1.0), *UNEVEN[2:])  # the rack weighs what it did
    moved = {(before[i], a) for i, a in shards_of(spark, swapped).items() if a != before[i]}
    assert moved == {(1, 0)}
    heavier = (*UNEVEN[:3], Shard("b", "x", 4.0), *UNEVEN[4:])
    assert {a for i, a in shards_of(spark, heavier).items() if a != before[i]} == {3}
    gone = (*UNEVEN[:3], Shard("b", "x", 0.0), *UNEVEN[4:])
    assert {before[i] for i, a in shards_of(spark, gone).items() if a != before[i]} == {3}


@pytest.mark.parametrize("tree", [(), (Shard("a", "b", 0.0),), (Shard("a", "b", -1.0), Shard("a", "b", 2.0))])
def test_trees_need_weight(tree):
    with pytest.raises(ValueError, match="weights"):
        hash_tree.levels(tree)


def test_shard_documents_edges(spark, tmp_path):
    rows = [(None, "same"), (None, "same"), (None, None), (1, ""), (1, None), (2, "é" * 100_000), (3, "x"), (3, "x")] + [(i, f"t{i % 3}") for i in range(10, 60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    d = d.withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1)).withColumn("_at", F.lit(2)).withColumn("a.b", F.lit(3))
    tree = hash_tree.layout(16)
    got = hash_tree.shard_documents(d, tree).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), place("" if i is None else str(i), tree), place("" if i is None else str(i), hash_tree.grown(tree))) for i, t in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == Counter(want)
    for s in {r["shard"] for r in got}:
        inside = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in inside] == list(range(len(inside)))
        assert [r["doc_id"] is not None for r in inside] == sorted(r["doc_id"] is not None for r in inside)
    assert hash_tree.shard_documents(d.limit(0), tree).count() == 0
    again = hash_tree.shard_documents(d.repartition(2), tree).select("doc_id", "shard", "slot").collect()
    assert Counter(again) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in got), "any order of rows"
    d = d.drop("shard")
    hash_tree.write_shards(d, tree, f"{tmp_path}/shards", rows_per_file=2)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((r["doc_id"], r["text"], r["slot"], r["a.b"], r["shard"]) for r in back.collect()) == Counter((i, t, 1, 3, place("" if i is None else str(i), tree)) for i, t in rows)
    with pytest.raises(ValueError, match="shard"):
        hash_tree.write_shards(back, tree, f"{tmp_path}/again")


def test_native_main_path(spark, sf):
    plan = queries.op11_hash_tree(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- importance resampling -------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, buckets):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return Counter(zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])


def resampled(rows, target, buckets=importance.BUCKETS, percent=25, min_words=20, seed=7):
    docs, aim = [features(t, buckets) for _, t in rows], Counter()
    for t in target:
        aim.update(features(t, buckets))
    source = sum(docs, Counter())
    big, goal = sum(source.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (big + buckets) / ((source[b] + 1) * (goal + buckets)))) for b in source}
    out = []
    for (i, _), f in zip(rows, docs, strict=True):
        n = sum(f.values())
        weight = sum(gain[b] * k for b, k in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= 2 * min_words - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, able[: percent * len(able) // 100]


def test_resample_on_the_tables(spark, sf):
    con = duckdb.connect()
    rows, target = (con.sql(f"select {c} from '{sf}/{t}.parquet'").fetchall() for c, t in (("doc_id, text", "documents"), ("text", "benchmark")))
    want, drawn = resampled(rows, [t for (t,) in target])
    rank = {r[0]: k + 1 for k, r in enumerate(drawn)}
    got = queries.op12_importance_postings(spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter((*r, rank.get(r[0])) for r in want)
    assert len(drawn) == sum(r[1] >= 39 for r in want) // 4 > 10


ODD = [(None, "a b " * 30), (None, "a b " * 30), (1, None), (2, ""), (3, "é'É x9_y"), (3, "A b " * 30), (3, "A b " * 30), (4, "w1 w2 w3 " * 4000), (5, "--")]


@pytest.mark.parametrize("buckets", [7, 10_000])
def test_resample_edges(spark, monkeypatch, buckets):
    monkeypatch.setattr(importance, "WORDS_AT_ONCE", 1000)
    rows = ODD + [(i, " ".join(f"t{random.Random(i).randrange(40)}" for _ in range(30))) for i in range(10, 90)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("bucket", F.lit("clash")).withColumn("h", F.lit(0)).withColumn("rank", F.lit(0))
    aim = spark.createDataFrame([(t,) for t in ["a b a", "t1 t2 t3", None, ""]], "text string")
    want, drawn = resampled(rows, ["a b a", "t1 t2 t3", None, ""], buckets)
    got = importance.resample(d, aim, buckets=buckets).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(want)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[3]) for r in drawn]
    assert importance.resample(d.limit(0), aim).count() == 0
    assert Counter(tuple(r)[:4] for r in importance.resample(d, aim.limit(0), buckets=buckets).collect()) == Counter(resampled(rows, [], buckets)[0])
    named = importance.resample(d.withColumn("doc_id", F.col("doc_id").cast("string")), aim, buckets=buckets)
    assert dict(named.dtypes)["doc_id"] == "string" and Counter(r["weight"] for r in named.collect()) == Counter(r[2] for r in want)


def test_postings_are_shuffled_once(spark, sf):
    docs, aim = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    d = importance._postings(docs.select("doc_id", "text"), 100).repartition("range", "slice")
    gains = importance.bucket_gains(importance._sums(d, 100), importance._sums(importance._postings(aim.select(F.lit(0).alias("doc_id"), "text"), 100), 100), 100)
    got = importance._contributions(d, gains, 100, "bigint")
    got.count()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString() or str(got._jdf.queryExecution().executedPlan()).count("Scan parquet") <= 3


# --- periodic runs ---------------------------------------------------------------------------------------------------


def brute_runs(words, min_words=24):
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(min_words, 3 * q):
                s = words[i : i + size]
                if min(d for d in range(1, q + 1) if all(a == b for a, b in zip(s, s[d:], strict=False))) == q:
                    found.append((i, size, q))
            i = max(j, i) + 1
    return sorted(found)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def digests(words, runs):
    best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2])) if runs else (None,) * 3
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def some_texts():
    r = random.Random(5)
    for k in range(150):
        size = r.choice([0, 1, 5, 23, 24, 30, 90, 200])
        words = [f"w{r.randrange(r.choice([1, 2, 3, 40]))}" for _ in range(size)]
        for _ in range(r.randrange(4)):
            q, many = r.choice([1, 2, 3, 4, 6, 12, 17, 30]), r.randrange(2, 9)
            part = [f"v{r.randrange(r.choice([1, 2, 9]))}" for _ in range(q)]
            at = r.randrange(len(words) + 1)
            words[at:at] = (part * many)[: q * many - r.randrange(q)]
        yield k, words


@pytest.mark.parametrize("min_words", [3, 24])
def test_runs_are_those_of_the_definition(min_words):
    runs = 0
    for _, words in some_texts():
        got = periodic.words_and_runs(" ".join(words), min_words)[1]
        assert got == brute_runs(words, min_words)
        runs += len(got)
    assert runs > 50


def test_lag_counts():
    r = np.random.default_rng(3)
    for n, kinds in ((1, 1), (50, 2), (400, 3), (3000, 2), (3000, 700)):
        ids = np.unique(r.integers(0, kinds, n) ** 2, return_inverse=True)[1]
        assert periodic.lag_counts(ids, n // 3).tolist()[1:] == [int((ids[:-q] == ids[q:]).sum()) for q in range(1, n // 3 + 1)]


def test_very_long_texts():
    assert periodic.words_and_runs("spam " * 300_000)[1] == [(0, 300_000, 1)]
    part = " ".join(f"w{i}" for i in range(20_000))
    assert periodic.words_and_runs(f"x {part} {part} {part} {part} y")[1] == [(1, 80_000, 20_000)]
    ids = np.random.default_rng(1).integers(0, 2, 8000)
    ids[1000:1900], ids[5000:8000] = np.tile(ids[:90], 10), np.tile(ids[2000:2750], 4)
    want = []
    for q in range(1, len(ids) // 3 + 1):  # every lag, scanned whole
        edge = np.flatnonzero(np.diff(np.r_[0, (ids[:-q] == ids[q:]).astype(int), 0]))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            part = ids[lo : hi + q]
            if len(part) >= max(24, 3 * q) and not any((part[:-d] == part[d:]).all() for d in range(1, q)):
                want.append((lo, len(part), q))
    assert periodic.find_runs(ids) == sorted(want) and len(want) > 1


def test_query_on_the_tables(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' where length(text) < 12000").fetchall()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, sf).collect()}
    for i, text in rows:
        words = planted(i, re.findall(r"[^\x20\x09-\x0D]+", text))
        assert got[i] == digests(words, brute_runs(words)), i
    assert sum(r[0] > 0 for r in got.values()) > 10


def test_runs_edges(spark):
    rows = [(None, None), (None, "a " * 40), (7, ""), (7, "x y " * 20), (7, "x y " * 20), (8, " \t"), (9, "nbsp stays a a"), (10, "é\x0b" * 30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit(1)).withColumn("start", F.lit(2))
    got = periodic.run_digests(periodic.periodic_runs(d))
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    assert Counter(map(tuple, got.collect())) == Counter((i, *digests(w, brute_runs(w))) for (i, _), w in zip(rows, split, strict=True))
    assert periodic.periodic_runs(d.limit(0)).count() == 0
    same = periodic.with_planted_repeats(d).where("doc_id is null").collect()
    assert Counter((r["doc_id"], r["text"]) for r in same) == Counter(rows[:2]), "null ids keep their texts"
    with pytest.raises(ValueError, match="3 or more"):
        periodic.periodic_runs(d, min_repeats=2)


def test_ties_go_to_the_first(spark):
    d = spark.createDataFrame([([(5, 30, 3), (0, 60, 6), (70, 30, 3)],), ([],)], f"runs {periodic.RUNS}")
    got = [r[0] for r in d.select(periodic.longest_exponent(F.expr("array_sort(runs)"))).collect()]
    assert tuple(got[0]) == (0, 60, 6) and got[1] is None

