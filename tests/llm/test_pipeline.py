"""The pipeline against a version in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import sentencepiece

import corpus_pipeline
from lodestar.llm import queries, toxicity
from lodestar.llm.common import shared_dir, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    """n_words, n_symbols, n_lines, n_dup_lines, word_chars, n_repeat_words."""
    w = WORD.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(tri)
    covered = {i + o for i, t in enumerate(tri) if many[t] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), sum(map(len, w)), len(covered)


def kept_by_host_rules(rows):
    """Failures by host, a beta prior by moments, and verdicts, in plain Python."""
    each = []
    for r in rows:
        n, symbols, lines, dups, chars, repeats = measures(r["text"])
        each.append((r, n < 50 or 2 * repeats > n, (10 * symbols > n, 10 * dups > 3 * lines, 100 * repeats > 20 * n, chars < 3 * n or chars > 10 * n)))
    hosts = defaultdict(lambda: [0, 0, 0, 0, 0])
    for r, _, fails in each:
        h = hosts[r["source"]]
        h[0] += 1
        for k, f in enumerate(fails):
            h[k + 1] += f
    total = sum(h[0] for h in hosts.values())
    bad = defaultdict(lambda: [False] * 4)
    for k in range(4):
        m = sum(h[k + 1] for h in hosts.values()) / total
        var = sum((h[k + 1] / h[0]) ** 2 * h[0] for h in hosts.values()) / total - m * m
        strength = min(1e6, max(1.0, m * (1 - m) / var - 1)) if var > 1e-12 else 1e6
        for name, h in hosts.items():
            if (h[k + 1] + m * strength) / (h[0] + strength) > max(0.25, 2 * m):
                bad[name] = [x or i == k for i, x in enumerate(bad[name])]
    return [r for r, base, fails in each if not base and not any(f and v for f, v in zip(fails, bad[r["source"]], strict=True))]


def one_of_each(rows):
    """The least id of each class of links of 0.8 or more, over all pairs that share a shingle."""
    sets, where = {}, defaultdict(list)
    for r in rows:
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, s in sets.items():
        shared = Counter(j for x in s for j in where[x])
        for j, both in shared.items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                x, y = find(k), find(j)
                root[max(x, y)] = min(x, y)
        for x in s:
            where[x].append(k)
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def times_taken(rows):
    """How often each document is taken: weights 5, 2, 1 over sources by code point, caps at twice a source, hash order."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        gain, left = {s: left * weight[s] / total for s in open_}, 0.0
        for s in list(open_):
            target[s] += gain[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    out = Counter()
    for s in order:
        budget = int(target[s] + 1e-9)
        epochs = budget // sizes[s] if sizes[s] else 0
        left = budget - epochs * sizes[s]
        mine = []
        for r in rows:
            if r["source"] == s:
                n = len(WORD.findall(r["text"]))
                mine.append((hashlib.md5(f"mix-1:{r['doc_id']}:{n}".encode()).hexdigest(), n, r["doc_id"]))
        for _, n, k in sorted(mine):
            out[k] += epochs + (left > 0 and n > 0)
            left -= n
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_pipeline(spark, size):
    """run() against plain Python from end to end; the toxicity model's fit has its own test against plain Python."""
    sf = f"/root/testdata/{size}"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(docs, labels)

    def toxic(text):
        found, n = Counter(), 0
        for w in re.findall(r"\w+", text.lower()):
            n += 1
            found.update({f"={w}", *(f"^{w[:k]}" for k in (4, 5, 6) if len(w) > k)})
        return sum(model.weights[f] * math.log(1 + 100 * c / n) for f, c in found.items() if f in model.weights) > model.thresholds[0]

    rows = docs.collect()
    clean = [r for r in rows if not toxic(r["text"])]
    good = kept_by_host_rules(clean)
    single = one_of_each(good)
    assert len(rows) > len(clean) > len(good) > len(single) > 20
    times = times_taken(single)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    want = Counter()
    for r in single:
        ids = library.encode(r["text"], add_eos=True)
        want[r["doc_id"], len(ids), tuple(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += times[r["doc_id"]]
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want


def test_stages_return_documents(spark, sf):
    docs = table(spark, sf, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0 and (k == 4 or empty.columns == docs.columns)
        assert k == 4 or stage(spark, docs, sf).columns == docs.columns


def test_nulls_repeats_and_extra_columns(spark, sf):
    """Null ids, texts and sources, repeated rows, columns named like computed ones, and a text of a million words."""
    docs = table(spark, sf, "documents").limit(30)
    odd = docs.unionByName(docs.limit(5)).selectExpr("case when doc_id % 7 = 0 then null else doc_id end as doc_id", "case when doc_id % 5 = 0 then null else text end as text", "lang", "case when doc_id % 3 = 0 then null else source end as source", "n_chars", "1 as size", "'x' as host", "2 as toxic", "3 as _i", "4 as _n", "5 as `a.b`")
    long = " ".join(f"{i:x}z" for i in range(1_000_000))
    odd = odd.unionByName(spark.createDataFrame([(10**9, long, "en", "src0", len(long), 1, "x", 2, 3, 4, 5)], odd.schema)).cache()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns
        kept[name] = out.collect()
    assert sum(r["text"] is None for r in kept["toxicity"]) == odd.where("text is null").count(), "a null text is not toxic"
    assert all(r["text"] is not None for r in kept["quality rules"]) and any(r["doc_id"] == 10**9 for r in kept["quality rules"])
    by = Counter(r["doc_id"] for r in kept["SimHash near-dedup"])
    assert all(n == 1 for k, n in by.items() if k is not None) and by[10**9] == 1 and by[None] == odd.where("doc_id is null").count()
    taken = Counter((r["doc_id"], r["source"], r["text"]) for r in kept["mixing sources to target weights"])
    assert taken[10**9, "src0", long] in (1, 2)
    encoded = corpus_pipeline.encoding_stage(spark, odd, sf).collect()
    assert len(encoded) == odd.count() and {r["n_tokens"] for r in encoded if r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()} == {1}
    assert max(r["n_tokens"] for r in encoded) > 3_000_000


def test_folders_of_a_run_go(spark, sf):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("pipeline-*"))
    out = corpus_pipeline.run(spark, sf)
    n = out.count()
    (mine,) = set(folder.glob("pipeline-*")) - before
    assert [p.name for p in mine.iterdir()] == [str(len(corpus_pipeline.STAGES) - 1)], "only what the last stage returned is there"
    assert n and corpus_pipeline.run(spark, sf).count() == n
