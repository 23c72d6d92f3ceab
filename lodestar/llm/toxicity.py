"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x - t_k): one weight vector for all ordered thresholds t_1 < t_2 < ... . Features are the words
of a text and their first 4, 5 and 6 characters, as log(1 + hundredths of the text's words), so that severity speaks of a
text's make-up and not of its length. Fitting sees a bounded sample of labelled rows on the driver; scoring is one pass over
whole texts by the same rule, with the weights of each word remembered by the task.

The labels know toxic and not toxic only. Grades are made from them: not toxic is 0; of toxic texts, grade 1, 2 or 3 says
in which third of the sampled toxic texts the share of their words lies that mark toxic texts. So a grade does not grow
with a text's length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aliased, map_texts, pick, restored

#: Labelled rows that fitting sees at most, drawn by a hash of the id; and UTF-8 bytes of text in all.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16 << 20
#: Features must occur in so many sampled texts, and in toxic ones so much more or less often than in others that chance
#: gives it to less than one feature in a million; so many are kept at most, the most telling first.
MIN_TEXTS, MIN_CHI_SQUARE, MAX_FEATURES = 4, 24.0, 60_000
#: Features mark toxic texts if they are so much more frequent there (log odds).
MARKED = 2.0
PREFIXES = (4, 5, 6)
GRADES = 3
#: Counts of features enter as shares of a text's words, in parts of this.
PARTS = 100
TOKEN = re.compile(r"\w+")
#: Longer words are not remembered.
KNOWN_CHARS, KNOWN_WORDS = 64, 200_000


def words(text: str) -> Counter:
    return Counter(TOKEN.findall(text.lower()))


def expand(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


@dataclass
class OrdinalModel:
    """weights by feature; thresholds ascending, one for each grade above 0."""

    weights: dict[str, float]
    thresholds: list[float]

    def score(self, text: str, known: dict[str, tuple[str, ...]] | None = None) -> float:
        """w.x of a text. known: remembers the features of words that have a weight."""
        known = {} if known is None else known
        weights, get = self.weights, known.get
        found: dict[str, int] = {}
        n_words = 0
        for w, n in words(text).items():
            fs = get(w)
            if fs is None:
                fs = tuple(f for f in expand(w) if f in weights)
                if len(w) <= KNOWN_CHARS:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    known[w] = fs
            n_words += n
            for f in fs:
                found[f] = found.get(f, 0) + n
        return sum(weights[f] * math.log1p(PARTS * n / n_words) for f, n in sorted(found.items()))

    def at_least(self, score: float) -> list[float]:
        return [1 / (1 + math.exp(min(50.0, max(-50.0, t - score)))) for t in self.thresholds]


class Counts:
    """The texts of a sample as a sparse matrix of features: parallel arrays text, feature, count; features by name, and
    each text's words and how often they occur."""

    def __init__(self, texts: list[str], step: int = 500):
        vocabulary: dict[str, int] = {}
        names: dict[str, int] = {}
        of: list[list[int]] = []
        parts, self.word_rows = [], []
        for lo in range(0, len(texts), step):
            row, word, n = [], [], []
            for i, t in enumerate(texts[lo : lo + step], lo):
                found = words(t)
                row += [i] * len(found)
                word += [vocabulary.setdefault(w, len(vocabulary)) for w in found]
                n += found.values()
            for w in list(vocabulary)[len(of) :]:
                of.append([names.setdefault(f, len(names)) for f in expand(w)])
            row, word, n = (np.array(x, dtype=np.int32) for x in (row, word, n))
            self.word_rows.append((row, word, n))
            many = np.array([len(of[w]) for w in word], dtype=np.int64)
            feature = np.array([f for w in word for f in of[w]], dtype=np.int64)
            key, at = np.unique(np.repeat(row, many).astype(np.int64) << 32 | feature, return_inverse=True)
            parts.append(((key >> 32).astype(np.int32), key.astype(np.int32), np.bincount(at, weights=np.repeat(n, many), minlength=len(key)).astype(np.int32)))
        self.names, self.of, self.texts = list(names), of, len(texts)
        self.text, self.feature, self.count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, dtype=np.int32)] * 3
        self.words = self.per_text(np.ones(len(of)))

    def per_text(self, weight: np.ndarray) -> np.ndarray:
        """Each text's words, each counting what its entry in `weight` says."""
        out = np.zeros(self.texts)
        for row, word, n in self.word_rows:
            np.add.at(out, row, n * weight[word])
        return out

    def telling(self, toxic: np.ndarray, min_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each feature: in how many toxic texts, in how many others, and its chi-square (0 where it is in too few)."""
        a = np.bincount(self.feature[toxic[self.text]], minlength=len(self.names)).astype(float)
        b = np.bincount(self.feature[~toxic[self.text]], minlength=len(self.names)).astype(float)
        na, nb = float(toxic.sum()), float((~toxic).sum())
        bottom = (a + b) * (na - a + nb - b) * na * nb
        chi = np.divide((na + nb) * (a * (nb - b) - b * (na - a)) ** 2, bottom, out=np.zeros_like(a), where=bottom > 0)
        return a, b, np.where(a + b >= min_texts, chi, 0.0)


def fit(rows: list[tuple[str, int]], epochs: int = 1500, l2: float = 1e-4, rate: float = 0.5, min_texts: int = MIN_TEXTS, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Fit to (text, grade) rows with Adagrad over the whole sample, in a fixed order. Grades run from 0; with fewer than
    two grades among the rows nothing is learnt and every text has severity of that grade (0 where there are no rows)."""
    return fit_counts(Counts([t for t, _ in rows]), np.array([g for _, g in rows], dtype=np.int64), epochs, l2, rate, min_texts, max_features)


def fit_counts(c: Counts, grades: np.ndarray, epochs: int = 1500, l2: float = 1e-4, rate: float = 0.5, min_texts: int = MIN_TEXTS, max_features: int = MAX_FEATURES) -> OrdinalModel:
    top = int(grades.max(initial=0))
    if len(np.unique(grades)) < 2:
        return OrdinalModel({}, [-50.0] * top)
    _, _, chi = c.telling(grades > 0, min_texts)
    kept = sorted(np.flatnonzero(chi >= MIN_CHI_SQUARE).tolist(), key=lambda f: (-chi[f], c.names[f]))[:max_features]
    place = np.full(len(c.names), -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    use = place[c.feature] >= 0
    row, col = c.text[use], place[c.feature[use]]
    val = np.log1p(PARTS * c.count[use] / c.words[row])
    n = [int((grades == 0).sum()), int((grades > 0).sum())]
    y = grades[:, None] > np.arange(top)[None, :]  # grade >= k + 1
    width = len(kept)
    w, t = np.zeros(width), np.linspace(0.5, 1.5, top)
    gw, gt = np.full(width, 1e-8), np.full(top, 1e-8)
    weight = np.where(grades > 0, 0.5 / max(1, n[1]), 0.5 / max(1, n[0])) * c.texts  # both sides count alike
    for _ in range(epochs):
        s = np.bincount(row, weights=w[col] * val, minlength=c.texts)
        p = 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -50, 50)))
        e = (p - y) * weight[:, None] / c.texts
        dw = np.bincount(col, weights=e.sum(1)[row] * val, minlength=width) + l2 * w
        dt = -e.sum(0)
        gw += dw * dw
        gt += dt * dt
        w -= rate * dw / np.sqrt(gw)
        t = np.maximum.accumulate(t - rate * dt / np.sqrt(gt))  # thresholds stay in order
    return OrdinalModel({f: float(x) for f, x in zip((c.names[i] for i in kept), w, strict=True) if abs(x) > 1e-6}, [float(x) for x in t])


def made_grades(c: Counts, toxic: np.ndarray) -> np.ndarray:
    """0 for texts that are not toxic; for toxic ones the third, from 1, in which their share of marked words lies among
    those of all toxic ones. A word is marked if it or a beginning of it is far more frequent in toxic texts, beyond chance."""
    if not toxic.any() or toxic.all():
        return toxic.astype(np.int64)
    a, b, chi = c.telling(toxic, MIN_TEXTS)
    odds = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))
    marked = (a >= MIN_TEXTS) & (chi >= MIN_CHI_SQUARE) & (odds >= MARKED)
    share = c.per_text(np.array([any(marked[f] for f in fs) for fs in c.of], dtype=float)) / np.maximum(c.words, 1)
    cuts = np.quantile(share[toxic], [k / GRADES for k in range(1, GRADES)])
    return np.where(toxic, 1 + (share[:, None] > cuts[None, :]).sum(1), 0)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> list[tuple[str, bool]]:
    """(text, toxic) of a bounded sample of labelled documents: the labels with the least hashes of their ids, half of
    them toxic where there are as many. Only sampled ids are joined with the texts; a text that does not fit what is left
    of max_bytes is passed over. Toxic texts of which none fits are an error, as no model could find any, and so are others.

    Labels without an id or a toxic flag, and null texts, are no rows; of labels that repeat an id the most toxic counts;
    of rows of docs that repeat an id the one whose text has the least hash counts, so the driver sees max_rows rows at most.
    Empty texts are rows without a feature; empty tables give no rows."""
    lab = pick(labels, {"doc_id": "doc_id", "toxic": "toxic"}).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lab = lab.withColumn("h", F.xxhash64("doc_id"))
    half = max_rows // 2
    some = [lab.where(F.col("toxic") > 0 if side else F.col("toxic") <= 0).orderBy("h", "doc_id").limit(half) for side in (False, True)]
    chosen = some[0].unionByName(some[1])  # at most max_rows rows of three numbers
    got = pick(docs, {"doc_id": "doc_id", "text": "text"}).join(F.broadcast(chosen), "doc_id").where("text is not null").select("text", "toxic", "h", "doc_id")
    first = Window.partitionBy("h", "doc_id").orderBy(F.xxhash64("text"), "text")
    got = got.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")  # cut to the first before it is shuffled, and again after
    out, size, unseen = [], 0, set()
    for r in got.orderBy("h", "doc_id", "text").toLocalIterator():
        n = len(r["text"].encode())
        if size + n > max_bytes:
            unseen.add(r["toxic"] > 0)
            continue
        size += n
        out.append((r["text"], r["toxic"] > 0))
    for side in unseen - {toxic for _, toxic in out}:
        raise ValueError(f"no text labelled {'toxic' if side else 'not toxic'} fits a sample of {max_bytes} bytes")
    return out


def train(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    """Fit to a bounded sample of labelled documents (see training_rows), with grades made from the toxic labels. Where no
    or only toxic rows are labelled, nothing can be learnt: no weights, and the severity of what there is."""
    rows = training_rows(docs, labels)
    c = Counts([t for t, _ in rows])
    return fit_counts(c, made_grades(c, np.array([x for _, x in rows], dtype=bool)))


def scorer(model: OrdinalModel, threshold: float = 0.5):
    """What map_texts() takes, and its columns: score, expected_severity, grade, toxic."""
    weights, thresholds = model.weights, model.thresholds

    def make():
        m = OrdinalModel(weights, thresholds)
        known: dict[str, tuple[str, ...]] = {}

        def run(texts):
            out = {"score": [], "expected_severity": [], "grade": [], "toxic": []}
            for t in texts:
                s = m.score(t or "", known)
                p = m.at_least(s)
                each = [a - b for a, b in zip([1.0, *p], [*p, 0.0], strict=True)]
                out["score"].append(s)
                out["expected_severity"].append(sum(p))
                out["grade"].append(max(range(len(each)), key=each.__getitem__))  # of equal ones the least
                out["toxic"].append(bool(p and p[0] > threshold))
            return out

        return run

    return make, [("score", "double", pa.float64()), ("expected_severity", "double", pa.float64()), ("grade", "int", pa.int32()), ("toxic", "boolean", pa.bool_())]


def severity(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: id, score, expected_severity (the sum over grades of P(grade >= k)), grade (the likeliest), toxic (P(grade >= 1) over the threshold).

    Null and empty texts have no features and score 0. Ids pass through, nulls and repeats included, one row out per row
    in. Empty tables give empty results; further columns are not read. The model is bounded by MAX_FEATURES.
    """
    make, out = scorer(model, threshold)
    return map_texts(pick(df, {"doc_id": id_col, "text": text_col}), make, out).withColumnRenamed("doc_id", id_col)


def reject_toxic(df: DataFrame, model: OrdinalModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df, all columns as they are, whose text isn't toxic; nothing is shuffled.

    Null and empty texts score 0, like texts without a known word; rows that repeat stay or go together. An empty df gives
    an empty result; columns of any name pass through."""
    make, out = scorer(model, threshold)
    d, back = aliased(df)
    text = next(n for n, c in back.items() if c == text_col)
    d = map_texts(d.withColumn("text", F.col(text)), make, out, keep=tuple(back))
    return restored(d.where("not toxic"), back)
