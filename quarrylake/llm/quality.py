"""Quality classifier: random-indexing word vectors and a two-layer network.

Each known word has a sparse random index vector; its context vector is the sum of the index vectors
of the words around it in the fitting sample.  A document is the mean of both over all its words (rare
words stand for their shape), and a two-layer numpy network scores it.  A temperature fitted on rows
that the network has not seen turns its margin into a calibrated probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_in, id_out, thrifty

DIMENSIONS, NONZERO, REACH = 64, 4, 2
WORDS, SEEN = 30_000, 3
#: Labelled documents that the classifier is fitted on at most, and bytes of each and of all together.
SAMPLE, LONGEST, SAMPLE_BYTES = 6000, 1 << 18, 32 << 20
HIDDEN, EPOCHS, RATE = 32, 60, 3e-3
THRESHOLD = 0.3
_LETTERS = regex.compile(r"\p{Ll}+")
_CAPITALS = regex.compile(r"\p{Lu}+")
_DIGITS = regex.compile(r"\p{N}+")


def shape(word: str) -> str:
    """Letter runs and digits reduced to one sign each, the rest of the word as it is (16 signs at most)."""
    return "\0" + _DIGITS.sub("0", _CAPITALS.sub("A", _LETTERS.sub("a", word)))[:16]


def index_vector(word: str) -> tuple[list[int], list[int]]:
    seed = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7)
    rng = np.random.default_rng(seed)
    return rng.choice(DIMENSIONS, NONZERO, replace=False).tolist(), rng.choice([-1, 1], NONZERO).tolist()


@dataclass
class QualityModel:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float
    prior: float

    def ids(self, text: str) -> np.ndarray:
        words = text.split()
        known = self.vocabulary.get
        ids = [known(w, -1) for w in words]
        if -1 in ids:
            ids = [known(shape(w), 0) if i < 0 else i for i, w in zip(ids, words, strict=True)]
        return np.array(ids, np.int64)

    def pooled(self, text: str) -> np.ndarray:
        ids = self.ids(text)
        n = len(ids)
        mean = np.zeros(self.vectors.shape[1], np.float64)
        for s in range(0, n, 16_384):
            mean += self.vectors[ids[s : s + 16_384]].sum(axis=0, dtype=np.float64)
        mean /= max(1, n)
        half = self.vectors.shape[1] // 2
        again = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
        return np.r_[mean, np.log1p(n), np.log(1e-3 + np.linalg.norm(mean[:half])), np.log(1e-3 + np.linalg.norm(mean[half:])), len(np.unique(ids)) / max(1, n), again]

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.mean) / self.spread @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margin(np.array([self.pooled(t) for t in texts])) / self.temperature, -35, 35)))


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Vocabulary (0: anything else) and, per word, its normalised context vector and its index vector."""
    counts = Counter(w for t in texts for w in t.split())
    common = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:WORDS] if n >= SEEN]
    shapes = Counter(shape(w) for w in counts)
    common += [s for s, n in sorted(shapes.items(), key=lambda x: (-x[1], x[0]))[: WORDS // 4] if n >= SEEN]
    vocabulary = {w: i + 1 for i, w in enumerate(common)}
    places = np.zeros((len(common) + 1, NONZERO), np.int64)
    signs = np.zeros((len(common) + 1, NONZERO))
    for w, i in vocabulary.items():
        places[i], signs[i] = index_vector(w)
    size = (len(common) + 1) * DIMENSIONS
    context = np.zeros(size)
    for t in texts:
        ids = []
        for w in t.split():
            i = vocabulary.get(w)
            s = vocabulary.get(shape(w), 0) if i is None else i
            ids.append(s)
        ids = np.array(ids, np.int64)
        for d in range(1, REACH + 1):
            for a, b in ((ids[d:], ids[:-d]), (ids[:-d], ids[d:])):
                for j in range(NONZERO):
                    np.add.at(context, a * DIMENSIONS + places[b, j], signs[b, j])
    context = context.reshape(-1, DIMENSIONS)
    context /= np.maximum(1e-9, np.linalg.norm(context, axis=1, keepdims=True))
    own = np.zeros((len(common) + 1, DIMENSIONS))
    own[np.arange(len(own))[:, None], places] = signs
    return vocabulary, np.hstack([context, own]).astype(np.float32)


def fit(texts: list[str], labels: list[int]) -> QualityModel | None:
    """Fits vectors, network and temperature; every eighth row is kept for the temperature."""
    if not texts:
        return None
    y = np.array(labels, np.float64)
    vocabulary, vectors = word_vectors(texts)
    width = vectors.shape[1] + 5
    model = QualityModel(vocabulary, vectors, np.zeros(width), np.ones(width), (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0), 1.0, float(y.mean()))
    x = np.array([model.pooled(t) for t in texts])
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - model.mean) / model.spread
    kept_back = np.arange(len(y)) % 8 == 7
    train, check = np.flatnonzero(~kept_back), np.flatnonzero(kept_back)
    rng = np.random.default_rng(11)
    w = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
    first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for s in range(0, len(train), 64):
            rows = train[s : s + 64]
            hidden = np.tanh(x[rows] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -35, 35)))
            slope = (p - y[rows]) / len(rows)
            back = slope[:, None] * w[2] * (1 - hidden**2)
            grads = [x[rows].T @ back + 1e-4 * w[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * w[2], slope.sum()]
            step += 1
            for v, g, m1, m2 in zip(w, grads, first, second, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                v -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    model.layers = (w[0], w[1], w[2], float(w[3]))
    if len(check):
        z = np.tanh(x[check] @ w[0] + w[1]) @ w[2] + float(w[3])
        loss = lambda t: float(np.logaddexp(0, -np.where(y[check] > 0.5, z, -z) / t).mean())
        model.temperature = min(np.geomspace(0.5, 20, 80), key=loss)
    return model


def training_sample(df: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[list[str], list[int]]:
    """At most ``sample`` labelled texts and SAMPLE_BYTES of them, chosen by a hash of the id; none longer than LONGEST."""
    known = labels.filter(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    chosen = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    texts = df.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    order = (F.xxhash64("i"), "i", "t")
    few = texts.filter(F.octet_length("t") <= LONGEST).join(F.broadcast(chosen), "i").orderBy(*order).limit(sample)
    rows = few.withColumn("bytes", F.sum(F.octet_length("t").cast("long")).over(Window.orderBy(*order))).filter(F.col("bytes") <= SAMPLE_BYTES).collect()
    return [r["t"] for r in rows], [r["y"] for r in rows]


def classify(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of ``df``.

    Labels are read only where ``learn`` (over the columns of ``labels``) holds and the label is 0 or
    1; a label given twice counts as the larger.  Null text counts as empty and is scored like any
    other text.  Without a usable label every score is 0.5.  An empty table gives no rows.
    """
    model = df.sparkSession.sparkContext.broadcast(fit(*training_sample(df, labels, learn, id_col, text_col, label_col, sample)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            score = model.value.scores(texts) if model.value else np.full(len(texts), 0.5)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "predicted": (score >= threshold).astype(np.int32)})

    picked = df.select(id_in(id_col), F.col(text_col).alias("text"))
    return id_out(picked.mapInPandas(thrifty(run), "doc_id long, score double, predicted int"))
