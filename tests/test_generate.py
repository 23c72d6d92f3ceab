"""Beam search over the n-gram model against plain Python beams."""

import math
import random
from collections import Counter

import pytest

from lodestar.operators import generate as G


def plain(rows, beams, max_new, order):
    """{prompt: [(output, score)]} of all prompts."""
    counts = Counter()
    for p, o in rows:
        p, o = (p or [])[len(p or []) - min(len(p or []), order - 1) :], [*(o or []), G.END]
        s = p + o
        for j in range(len(p), len(s)):
            for m in range(min(order - 1, j) + 1):
                counts[tuple(s[j - m : j]), s[j]] += 1
    total, after = Counter(), {}
    for (c, t), n in counts.items():
        total[c] += n
        after.setdefault(c, []).append((-n, t))
    out = {}
    for p, _ in rows:
        p = tuple(p or ())
        live = [("", p[len(p) - min(len(p), order - 1) :], 0, False)]
        for _ in range(max_new):
            new = [b for b in live if b[3]]
            for text, last, score, done in live:
                if not done:
                    m = max((m for m in range(1, len(last) + 1) if last[len(last) - m :] in after), default=0)
                    c = last[len(last) - m :]
                    for n, t in sorted(after[c])[:beams]:
                        gain = math.floor(1000 * math.log(-n / total[c]))
                        new.append((f"{text} {t}".strip(), (*last, t)[-(order - 1) :], score + gain + G.BACKOFF * (len(last) - m), t == G.END))
            live = sorted(new, key=lambda b: (-b[2], b[0]))[:beams]
        ended = [(" ".join(t for t in b[0].split(" ") if t != G.END), b[2] / len(b[0].split(" "))) for b in live]
        out[p] = sorted(ended, key=lambda x: (-x[1], x[0]))
    return out


@pytest.mark.parametrize("order, beams, max_new", [(3, 5, 6), (2, 2, 4), (4, 3, 5)])
def test_beams_are_the_plain_ones(spark, order, beams, max_new):
    r = random.Random(order)
    rows = [([f"p{r.randrange(3)}" for _ in range(r.randrange(5))], [f"o{min(r.randrange(6), r.randrange(6))}" for _ in range(r.randrange(5))]) for _ in range(60)]
    rows += [(None, ["o1"]), (["q", "é"], None), (["unseen"], [])]
    d = spark.createDataFrame([(i, p, o) for i, (p, o) in enumerate(rows)], "id int, prompt array<string>, output array<string>").repartition(3)
    want = plain(rows, beams, max_new, order)
    got = {}
    for x in G.generate(d, G.train(d, order=order, beams=beams), beams=beams, max_new=max_new, order=order).collect():
        got.setdefault(x["id"], []).append((x["rank"], x["output"], x["score"]))
    assert len(got) == len(rows)
    for i, (p, _) in enumerate(rows):
        found = sorted(got[i])
        assert [k for k, _, _ in found] == list(range(1, len(found) + 1))
        assert [(o, s) for _, o, s in found] == want[tuple(p or ())], (i, p)


def test_predictions_and_edges(spark):
    train = spark.createDataFrame([(["a", "b"], ["x", "y"])] * 3 + [(["a", "b"], ["z"]), (["c"], ["y"])], "prompt array<string>, output array<string>")
    model = G.train(train)
    d = spark.createDataFrame([(1, ["k", "a", "b"]), (1, ["a", "b"]), (2, None), (3, ["never"])], "id int, prompt array<string>")
    got = G.predict_by_generation(d, model)
    assert got.columns == ["id", "prompt", "prediction"] and got.count() == 4
    assert {r["prediction"] for r in got.where("id = 1").collect()} == {"x y"}
    assert G.generate(d.limit(0), model).count() == 0
    empty = G.train(train.limit(0))
    assert {(r["output"], r["score"] <= 0) for r in G.generate(d, empty).collect()} == {("", True)}
