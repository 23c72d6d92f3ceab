"""Language-model scores against plain Python, toxicity by held-out accuracy."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import lm_scoring, queries, toxicity


def brute(target, background, docs):
    """All counts in dictionaries."""
    sides = [[[b"\n", *w, b"\n"] for w in map(lm_scoring.tokens, texts) if w] for texts in (target, background)]
    one = [collections.Counter(w for d in x for w in d[1:]) for x in sides]
    two = [collections.Counter(p for d in x for p in zip(d, d[1:], strict=False)) for x in sides]
    v = len(one[0].keys() | one[1].keys())
    total = [x.total() for x in one]

    def loss(s, a, w):
        share = (one[s][w] + 1) / (total[s] + v + 1)
        return -math.log((two[s][a, w] + lm_scoring.MU * share) / (one[s][a] + lm_scoring.MU))

    out = {}
    for k, t in docs.items():
        ws = lm_scoring.tokens(t)
        pairs = list(zip([b"\n", *ws], [*ws, b"\n"], strict=True))
        out[k] = (len(ws), *[sum(loss(s, a, b) for a, b in pairs) / len(pairs) if ws else None for s in (0, 1)])
    return out


def same_scores(got, want):
    for k, (n, a, b) in want.items():
        assert got[k]["n_tokens"] == n
        if n:
            assert abs(got[k]["ce_target"] - a) < 1e-9 and abs(got[k]["ce_background"] - b) < 1e-9 and abs(got[k]["ce_diff"] - (a - b)) < 1e-9
        else:
            assert got[k]["ce_diff"] is None


def test_scores(spark):
    r = random.Random(4)
    good, other = [f"good{i}" for i in range(30)], [f"other{i}" for i in range(300)] + ["Same", "same"]
    docs = {i: " ".join(r.choice(good if i % 3 == 0 else other) for _ in range(r.randint(1, 60))) for i in range(150)} | {200: None, 201: "", 202: "unseen words é" * 3}
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 3)] + [(1, 0, 0), (2, 1, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x for x in lm_scoring.score_against_labelled(d, labels).collect()}
    want = brute([docs[i] for i in range(0, 150, 3)], list(docs.values()), docs)
    same_scores(got, want)
    assert max(got[i]["ce_diff"] for i in range(0, 150, 3)) < min(got[i]["ce_diff"] for i in range(1, 150, 3))


@pytest.mark.parametrize("chunk, ids", [(4_000_000, 1 << 20), (700, 0)])
def test_scores_of_the_tables(spark, sf, monkeypatch, chunk, ids):
    """The query, over whole tables; chunks of any size and either join give the same."""
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(lm_scoring, "BROADCAST_IDS", ids)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] == 1 and not r["toxic"]}
    assert good & docs.keys()
    got = {r["doc_id"]: r for r in queries.op1_cross_entropy_difference(spark, sf).collect()}
    assert len(got) == len(docs)
    same_scores(got, brute([t for k, t in docs.items() if k in good], list(docs.values()), docs))


def test_levels_of_sums(spark, sf, monkeypatch):
    """With few chunks a level, several levels give what one gives, and none has many more rows than the first."""
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 900)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(lm_scoring, "FAN", 4)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] == 1 and not r["toxic"]}
    calls, real = [], lm_scoring.merge_teams

    def counted(parts, kind, blocks):
        out = lm_scoring.cut(real(parts, kind, blocks))
        calls.append((parts.select("chunk").distinct().count(), parts.count(), out.count()))
        return out

    monkeypatch.setattr(lm_scoring, "merge_teams", counted)
    got = {r["doc_id"]: r for r in queries.op1_cross_entropy_difference(spark, sf).collect()}
    same_scores(got, brute([t for k, t in docs.items() if k in good], list(docs.values()), docs))
    assert len(calls) >= 2 and all(max(a, b) <= 3 * calls[0][1] for _, a, b in calls)


@pytest.mark.parametrize("chunks, fan", [(1, 1), (4096, 4096), (4097, 65), (1 << 24, 4096), ((1 << 24) + 1, 257), (12_500_000, 3536)])
def test_fan_of_levels(chunks, fan):
    """One level while FAN chunks suffice, then the least levels, all alike."""
    assert lm_scoring.fan_of(chunks) == fan


def test_rows_of_one_id_keep_their_order(spark, monkeypatch):
    """Where texts are shuffled to meet the target's ids, chunks of many rows of one id are the same in each read."""
    monkeypatch.setattr(lm_scoring, "BROADCAST_IDS", 0)
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 50)
    d = spark.range(0, 600, numPartitions=8).selectExpr("id % 3 as doc_id", "concat('word', id % 7, ' other', id) as text")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    both = lm_scoring.labelled(d, labels)
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()  # a written table
    read = [sorted(r["chunk"] for r in lm_scoring.chunks(both.withColumn("background", F.lit(True)), lm_scoring.Chunk.whole).select("chunk").collect()) for _ in range(3)]
    assert len(read[0]) > 3 and read[0] == read[1] == read[2]
    got = lm_scoring.score_against_labelled(d, labels).collect()
    assert len(got) == 600 and all(r["n_tokens"] == 2 and r["ce_diff"] is not None for r in got)


def test_losses_step_by_step(monkeypatch):
    """Texts worked out a few at a time have the losses that they have at once."""
    r = np.random.default_rng(2)
    chunk = lm_scoring.Chunk()
    for i in range(60):
        chunk.add(i, " ".join(f"w{x}" for x in r.integers(0, 30, r.integers(1, 50))), i % 2 == 0, True)
    code, flat, boundary = chunk.sorted()
    sizes = np.array(chunk.sizes)
    pairs, _ = lm_scoring.distinct_pairs(*lm_scoring.steps(flat, sizes, boundary), code)
    counts = [[r.integers(0, 9, len(x)).astype(np.uint64) for _ in (0, 1)] for x in (code, pairs)]
    want = lm_scoring.losses(sizes, flat, code, boundary, *counts, 40, [500, 300])
    for step in (1, 10, 100):
        monkeypatch.setattr(lm_scoring, "STEP", step)
        assert np.allclose(lm_scoring.losses(sizes, flat, code, boundary, *counts, 40, [500, 300]), want)
    with pytest.raises(ValueError, match="changed between two reads"):
        lm_scoring.losses(sizes, flat, code, boundary, counts[0], [c[:-1] for c in counts[1]], 40, [500, 300])


def test_models_are_distributions():
    """The shares of all words, the unseen one included, after each word sum to one on either side."""
    texts = ["a b a c", "b b d", "a"]
    words = sorted({w for t in texts for w in lm_scoring.tokens(t)}) + [b"\n"]
    for target in (texts[:1], texts):
        one = collections.Counter(w for t in target for w in [*lm_scoring.tokens(t), b"\n"])
        two = collections.Counter(p for t in target for p in zip([b"\n", *lm_scoring.tokens(t)], [*lm_scoring.tokens(t), b"\n"], strict=True))
        share = {w: (one[w] + 1) / (one.total() + len(words) + 1) for w in words} | {None: 1 / (one.total() + len(words) + 1)}
        for a in words:
            assert abs(sum((two[a, w] + lm_scoring.MU * share[w]) / (one[a] + lm_scoring.MU) for w in share) - 1) < 1e-12


def test_sides_long_texts_and_repeats(spark):
    """Rows of neither side are scored and counted nowhere; a text longer than a chunk; repeated rows; ids of another type."""
    rows = [("x", "a b c " * 3000, True, True), ("x", "a b c", False, True), ("x", "a b c", False, True), (None, "never seen here", None, False), ("y", "b a", True, None), ("z", None, True, True), ("z", " \n", False, False)]
    d = spark.createDataFrame(rows, "doc_id string, text string, good boolean, all boolean").withColumn("chunk", F.lit("clash"))
    got = lm_scoring.cross_entropy_difference(d, target_col="good", background_col="all").collect()
    docs = {i: t for i, (_, t, _, _) in enumerate(rows)}
    want = brute([t for _, t, g, _ in rows if g], [t for _, t, _, b in rows if b], docs)
    key = lambda i, n, a, b: (str(i), n, *(f"{x:.9f}" if x is not None else "" for x in (a, b)))
    assert sorted(key(r["doc_id"], r["n_tokens"], r["ce_target"], r["ce_background"]) for r in got) == sorted(key(rows[i][0], *w) for i, w in want.items())


def test_scores_without_rows(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert lm_scoring.score_against_labelled(d, labels).count() == 0
    some = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    assert lm_scoring.score_against_labelled(some, labels).where("ce_diff is not null").count() == 3


def rows(n, seed):
    r = random.Random(seed)
    clean, rude = [f"c{i}" for i in range(200)], ["fool", "fooly", "foolish", "nasty", "nastier"]
    out = []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.randint(5, 150))]
        k = r.choice([0, 0, 0, 1, 4, 9])
        for _ in range(k):
            words.insert(r.randrange(len(words)), r.choice(rude))
        out.append((i, " ".join(words), k))
    return out


def test_held_out_toxicity(spark):
    train, test = rows(1500, 1), rows(800, 2)
    d = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(k > 0)) for i, _, k in train] + [(None, 1)], "doc_id bigint, toxic int")
    m = toxicity.train(d, labels)
    assert m.thresholds == sorted(m.thresholds) and len(m.thresholds) == 3
    e = spark.createDataFrame([(i, t) for i, t, _ in test], "doc_id bigint, text string").withColumn("grade", F.lit("clash"))
    got = {r["doc_id"]: r for r in toxicity.severity(e, m).collect()}
    right = sum(got[i]["toxic"] == (k > 0) for i, _, k in test)
    assert right >= 0.97 * len(test)
    share = {i: k / len(t.split()) for i, t, k in test}
    some = sorted((i for i, _, k in test if k), key=share.__getitem__)
    third = len(some) // 3
    mean = [sum(got[i]["expected_severity"] for i in x) / len(x) for x in ([i for i, _, k in test if not k], some[:third], some[third:-third], some[-third:])]
    assert mean == sorted(mean) and mean[0] < 0.3 and mean[3] > mean[1] + 0.5, "severity follows the share of a text"
    kept = toxicity.reject_toxic(e, m)
    assert kept.columns == e.columns and kept.count() == sum(not r["toxic"] for r in got.values())


def plain_counts(text):
    found, n = collections.Counter(), 0
    for w in re.findall(r"\w+", text.lower()):
        n += 1
        for f in {"=" + w, *("^" + w[:k] for k in (4, 5, 6) if len(w) > k)}:
            found[f] += 1
    return {f: math.log(1 + 100 * c / n) for f, c in found.items()}


def plain_fit(rows, epochs):
    """The same regression with dictionaries."""
    top, n = max(g for _, g in rows), len(rows)
    n_toxic = sum(g > 0 for _, g in rows)
    xs = [plain_counts(t) for t, _ in rows]
    w = {}
    for f in {f for x in xs for f in x}:
        a = sum(f in x for x, (_, g) in zip(xs, rows, strict=True) if g > 0)
        b = sum(f in x for x, (_, g) in zip(xs, rows, strict=True) if g == 0)
        c, e = n_toxic - a, n - n_toxic - b
        if a + b >= toxicity.MIN_TEXTS and (a + b) * (c + e) and n * (a * e - b * c) ** 2 / ((a + b) * (c + e) * n_toxic * (n - n_toxic)) >= toxicity.MIN_CHI_SQUARE:
            w[f] = 0.0
    t, gw, gt = [0.5 + k / max(1, top - 1) for k in range(top)], dict.fromkeys(w, 1e-8), [1e-8] * top
    for _ in range(epochs):
        dw, dt = {f: 1e-4 * v for f, v in w.items()}, [0.0] * top
        for x, (_, g) in zip(xs, rows, strict=True):
            s = sum(w[f] * v for f, v in x.items() if f in w)
            side = 0.5 / (n_toxic if g else n - n_toxic)
            for k in range(top):
                e = (1 / (1 + math.exp(t[k] - s)) - (g > k)) * side
                dt[k] -= e
                for f, v in x.items():
                    if f in w:
                        dw[f] += e * v
        for f in w:
            gw[f] += dw[f] ** 2
            w[f] -= 0.5 * dw[f] / math.sqrt(gw[f])
        for k in range(top):
            gt[k] += dt[k] ** 2
            t[k] = max(t[k] - 0.5 * dt[k] / math.sqrt(gt[k]), t[k - 1] if k else -math.inf)
    return w, t


def test_fit_against_dictionaries():
    some = [(t, min(3, k)) for _, t, k in rows(150, 3)] + [("x" * 300, 1)] * 5
    want, thresholds = plain_fit(some, 40)
    m = toxicity.fit(some, epochs=40)
    assert want and m.weights.keys() == {f for f, v in want.items() if abs(v) > 1e-6}
    assert all(abs(m.weights[f] - want[f]) < 1e-8 for f in m.weights) and all(abs(a - b) < 1e-8 for a, b in zip(m.thresholds, thresholds, strict=True))


def test_one_rule_for_fit_and_use(spark):
    """A word of any length has its features when scored, too; scores are what plain Python makes of the weights."""
    long = "q" * 150
    m = toxicity.OrdinalModel({f"={long}": 2.0, "^fool": 1.0, "=ok": -0.5}, [0.5, 0.5, 1.0])
    texts = [f"{long} a b", f"{long} {long} fools Foolish ok", "ok", "", None, "\u0130 " + "ok " * 30_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in toxicity.severity(d, m).collect():
        s = sum(m.weights.get(f, 0) * v for f, v in plain_counts(texts[r["doc_id"]] or "").items()) if texts[r["doc_id"]] else 0
        p = [1 / (1 + math.exp(t - s)) for t in m.thresholds]
        assert abs(r["score"] - s) < 1e-9 and abs(r["expected_severity"] - sum(p)) < 1e-9 and r["toxic"] == (p[0] > 0.5)
        each = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
        assert r["grade"] == each.index(max(each)), "of equal grades the least; with equal thresholds the one between has no share"


def test_toxicity_query(spark, sf):
    """Over whole tables: sample, grades, fit and scores, each by plain rules."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    table = spark.read.parquet(f"{sf}/labels.parquet")
    labels = [(r["h"], r["doc_id"], r["toxic"] > 0) for r in table.withColumn("h", F.xxhash64("doc_id")).collect()]
    half = toxicity.SAMPLE_ROWS // 2
    chosen = sorted([x for s in (False, True) for x in sorted(x for x in labels if x[2] is s)[:half]])
    sample = [(docs[i], x) for _, i, x in chosen if docs.get(i) is not None]
    assert toxicity.training_rows(spark.read.parquet(f"{sf}/documents.parquet"), table) == sample
    counted = toxicity.Counts([t for t, _ in sample])
    grades = toxicity.made_grades(counted, np.array([x for _, x in sample])).tolist()
    words = [[w for w in re.findall(r"\w+", t.lower())] for t, _ in sample]
    on = collections.defaultdict(lambda: [0, 0])
    for ws, (_, x) in zip(words, sample, strict=True):
        for f in {f for w in ws for f in toxicity.expand(w)}:
            on[f][x] += 1
    n = [sum(not x for _, x in sample), sum(x for _, x in sample)]

    def marks(f):
        b, a = on[f]
        c, e = n[1] - a, n[0] - b
        return a >= 4 and (a + b) * (c + e) > 0 and sum(n) * (a * e - b * c) ** 2 / ((a + b) * (c + e) * n[0] * n[1]) >= 24 and math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1)) >= 2

    marked = {f for f in on if marks(f)}
    shares = [sum(any(f in marked for f in toxicity.expand(w)) for w in ws) / max(1, len(ws)) for ws in words]
    cuts = np.quantile([s for s, (_, x) in zip(shares, sample, strict=True) if x], [1 / 3, 2 / 3])
    assert grades == [1 + sum(s > c for c in cuts) if x else 0 for s, (_, x) in zip(shares, sample, strict=True)]
    m = toxicity.fit([(t, g) for (t, _), g in zip(sample, grades, strict=True)])
    got = queries.op9_ordinal_toxicity(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        s = sum(m.weights.get(f, 0) * v for f, v in plain_counts(docs[r["doc_id"]]).items()) if docs[r["doc_id"]] else 0
        assert abs(r["score"] - s) < 1e-6


def test_one_long_text_does_not_end_the_sample(spark):
    rows = [(i, ("w " * 40_000 if i == 3 else f"text {i}"), int(i % 2)) for i in range(40)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id bigint, toxic int")
    assert sorted(toxicity.training_rows(d, labels, max_bytes=2_000)) == sorted((t, x > 0) for i, t, x in rows if i != 3)
    one = labels.where("doc_id = 3 or toxic = 0")
    with pytest.raises(ValueError, match="labelled toxic"):
        toxicity.training_rows(d, one, max_bytes=2_000)


def test_toxicity_edges(spark):
    m = toxicity.fit([("a fool", 1), ("b", 0)] * 20)
    d = spark.createDataFrame([(1, None), (None, ""), (2, "A FOOL"), (2, "A FOOL"), (3, "b " * 50_000)], "doc_id bigint, text string")
    got = toxicity.severity(d, m).collect()
    assert len(got) == 5 and [r["toxic"] for r in got if r["doc_id"] == 2] == [True, True]
    assert toxicity.severity(d.limit(0), m).count() == 0 and toxicity.reject_toxic(d.limit(0), m).count() == 0
    none = toxicity.train(d.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert none.weights == {} and not any(r["toxic"] for r in toxicity.severity(d, none).collect())
    assert not any(r["toxic"] for r in toxicity.severity(d, toxicity.fit([("x", 0)])).collect())
