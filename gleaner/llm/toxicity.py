"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: case, accents on Latin letters, look-alike letters of
other scripts, digits and signs written for letters, words spelled with a mark
between letters, and marks after words. The lexicon's words and their weights are learned from a bounded
sample of labelled rows; so are exception phrases, word pairs around a lexicon
word that clean rows use. A text's score comes from its matches' weights, as a
sum and as a rate per length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, slices, stash

# Look-alikes of Latin letters in Cyrillic and Greek, and digits and signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ł": "l", "ø": "o", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
INVISIBLE = "­​‌‍⁠﻿"


def _fold_table() -> dict[int, str]:
    """Every code point up to U+24FF and the full-width and styled letters, to its folded form."""
    table = {}
    for block in (range(0x80, 0x2500), range(0xFF00, 0xFF5F), range(0x1D400, 0x1D800)):
        for cp in block:
            c = unicodedata.normalize("NFKD", chr(cp)).lower()
            c = "".join(LOOKALIKES.get(x, x) for x in c if not unicodedata.combining(x))
            if c != chr(cp):
                table[cp] = c
    return table | {ord(c): "" for c in INVISIBLE}


FOLD = _fold_table()
WORD = re.compile(r"[^\s]+")
SIGN = re.compile(r"[a-z][0134578@$!]+(?=[a-z])|(?<![0-9a-z])[0134578@$]+(?=[a-z])")
SPELLED = re.compile(r"(?<![a-z])(?:[a-z][.\-_*]){2,}[a-z](?![a-z])")
EDGE = re.compile(r"[^a-z\s]+")


def _letters(m: re.Match) -> str:
    return "".join(DIGITS.get(c, c) for c in m[0])


def fold(text: str) -> str:
    """Folded text: lower-case words of a to z, parted by one space, with a space at both ends."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(FOLD)
    t = SIGN.sub(_letters, t)
    t = SPELLED.sub(lambda m: EDGE.sub("", m[0]), t)
    t = EDGE.sub(" ", t)
    return f" {' '.join(t.split())} "


class ToxicityModel:
    """weights: word -> weight. exceptions: phrases in which a word doesn't count. curve: (bias, per sum, per rate)."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.auto = ahocorasick.Automaton()
        for w, x in weights.items():
            self.auto.add_word(f" {w} ", (len(w) + 2, x))
        for phrase in exceptions:
            self.auto.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.auto):
            self.auto.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """Sum of the weights of matches outside exception phrases; the same per 100 words."""
        folded = fold(text)
        if not len(self.auto):
            return 0.0, 0.0
        hits, spared = [], []
        for end, (k, x) in self.auto.iter(folded):
            (spared if x is None else hits).append((end - k + 1, end, x))
        if not hits:
            return 0.0, 0.0
        if spared:
            hits = [h for h in hits if not any(s[0] <= h[0] and h[1] <= s[1] for s in spared)]
        total = sum(h[2] for h in hits)
        return total, 100 * total / max(20, folded.count(" ") - 1)

    def score(self, text: str | None) -> float:
        total, rate = self.features(text or "")
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(total) + c * math.log1p(rate)))))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """y, text of the ``per_class`` ids of lowest hash of each label; copies of a text count once.

    The ids are picked from the labels alone, so no text is moved to find them.
    """
    d = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    order = [F.xxhash64(F.lit("tox"), "_id"), F.col("_id")]
    d = d.where("y = 1").orderBy(*order).limit(per_class).unionByName(d.where("y = 0").orderBy(*order).limit(per_class))  # each task keeps its own first rows
    picked = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text")).join(F.broadcast(d), F.col("_key") == F.col("_id"))  # at most 2 * per_class short rows
    return stash(picked.select("y", "text").dropDuplicates(["y", "text"]), "labelled")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000, max_words: int = 2000, max_exceptions: int = 2000, min_odds: float = 20.0, min_docs: int = 5) -> ToxicityModel:
    """A model of the labelled documents; at most ``per_class`` of a label are learned from.

    The lexicon holds the ``max_words`` words of highest weight, and at most
    ``max_exceptions`` phrases, those that most clean rows hold: bounds of the
    model, as ``per_class`` is of the sample.

    ``labels`` has the id and the label (1, 0 or null). A word enters the
    lexicon if at least ``min_docs`` toxic texts hold it, and at least one in 50
    of them, and if it is ``min_odds`` times as frequent there as in clean ones;
    its weight is the logarithm of that ratio over that of ``min_odds``. Without
    labelled rows every score is near 0.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = fold(text or "").split()
                c = seen.setdefault(y, Counter())
                c.update(set(own))
                c[""] += 1  # texts
        for y, c in seen.items():
            yield pa.RecordBatch.from_pydict({"y": pa.array([y] * len(c), pa.int32()), "w": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

    counts = sample.mapInArrow(words, "y int, w string, n long").groupBy("w").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    counts = stash(counts, "toxic-words")
    texts = counts.where(F.col("w") == "").first()
    nt, nc = (texts["t"], texts["c"]) if texts else (0, 0)
    odds = ((F.col("t") + 0.5) / (nt + 1)) / ((F.col("c") + 0.5) / (nc + 1))
    weight = F.least(F.lit(3.0), F.log(odds) / math.log(min_odds))
    found = counts.where((F.length("w") > 1) & (F.col("t") >= max(min_docs, nt / 50)) & (odds >= min_odds)).select("w", weight.alias("x"))
    weights = {r["w"]: r["x"] for r in found.orderBy(F.col("x").desc(), "w").limit(max_words).collect()}
    if not weights:
        return ToxicityModel({}, set())
    # word pairs around lexicon words: those that clean texts use and toxic ones don't are exceptions
    shared = dict(weights)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = fold(text or "").split()
                seen.update({(y, f"{a} {c}") for a, c in zip(own, own[1:], strict=False) if a in shared or c in shared})
        yield pa.RecordBatch.from_pydict({"y": pa.array([k[0] for k in seen], pa.int32()), "w": pa.array([k[1] for k in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    near = sample.mapInArrow(pairs, "y int, w string, n long").groupBy("w").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    exceptions = {r["w"] for r in near.where((F.col("c") >= 3) & (F.col("c") > 3 * F.col("t"))).orderBy(F.col("c").desc(), "w").limit(max_exceptions).collect()}
    model = ToxicityModel(weights, exceptions)
    plain = (model.weights, model.exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ToxicityModel(*plain)
        for b in batches:
            got = [m.features(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=["y", "a", "b"])

    points = sample.select(F.col("y"), "text").mapInArrow(measure, "y int, a double, b double").collect()  # 2 * per_class at most
    all_toxic = labels.where(F.col(label_col) == 1).count()
    all_clean = labels.where(F.col(label_col) == 0).count()
    model.curve = fit_curve(points, all_toxic, all_clean)
    return model


def fit_curve(points: list, all_toxic: int, all_clean: int) -> tuple[float, float, float]:
    """Logistic curve over log sums and log rates, with the classes weighted as in all labelled rows."""
    y = np.array([p[0] for p in points], float)
    if not (y == 1).any() or not (y == 0).any():
        return -4.0, 2.0, 1.0
    x = np.stack([np.ones(len(y)), np.log1p([p[1] for p in points]), np.log1p([p[2] for p in points])], 1)
    weight = np.where(y == 1, all_toxic / (y == 1).sum(), all_clean / (y == 0).sum())
    weight /= weight.mean()
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.1 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with toxic_score (0 to 1) and toxic_pred (1 from ``threshold`` on).

    Whole texts are scored; null and empty texts score like a text without a
    match. Other columns pass through; columns of these names are replaced.
    """
    shared = Shared(docs.sparkSession, (model.weights, model.exceptions, model.curve), lambda parts: ToxicityModel(*parts))  # bounded by max_words
    keep = [c for c in docs.columns if c not in ("toxic_score", "toxic_pred")]
    at = keep.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", toxic_score double, toxic_pred int"

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.get()
        for b in (piece for whole in batches for piece in slices(whole, at)):
            scores = [m.score(x.as_py()) for x in b.column(at)]
            arrays = [b.column(i) for i in range(len(keep))]
            arrays += [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "toxic_score", "toxic_pred"])

    return docs.select(*keep).mapInArrow(classify, schema)
