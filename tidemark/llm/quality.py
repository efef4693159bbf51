"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from one pass over a text's bytes and words. Trees are grown level by level on
binned statistics of at most ``MAX_LABELLED`` labelled documents, then flattened into arrays, so
that a batch is scored by a few numpy gathers a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stage
from .toxicity import MAX_LABELLED, sample_labels

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "lower", "upper", "digit", "other_bytes",
    "space", "newline", "stop_comma", "sign", "bar", "bang", "commonest_word", "title_words", "sign_words", "long_words", "distinct_lines",
)
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[[44, 46]], _CLASS[124], _CLASS[33] = 5, 6, 7, 9, 10
_CLASS[[c for c in range(33, 127) if _CLASS[c] == 0]] = 8


def statistics(text: bytes) -> list[float]:
    n = len(text)
    words = text.split()
    m = len(words)
    shares = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=11) / max(n, 1)
    if not m:
        return [np.log1p(n), 0.0, 0.0, 0.0, 0.0, *shares[1:11].tolist(), 0.0, 0.0, 0.0, 0.0, 0.0]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=m)
    kinds, counts = np.unique(np.fromiter(map(hash, words), dtype=np.int64, count=m), return_counts=True)
    lines = text.split(b"\n")
    title = sum(w[:1].isupper() for w in words) / m
    signs = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m
    return [
        np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), len(kinds) / m, *shares[1:11].tolist(),
        counts.max() / m, title, signs, float((lengths > 20).mean()), len(set(lines)) / len(lines),
    ]


@dataclass
class Trees:
    """Flat arrays over all trees: node i of tree t at t * 2**(depth + 1) - 1 + i, as in a heap."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    trees: int
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        size = 2 ** (self.depth + 1) - 1
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = t * size + node
                node = 2 * node + 1 + (x[rows, self.feature[at]] > self.threshold[at])
            total += self.value[t * size + node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: int = 10) -> Trees:
    """Logistic loss, second order. Splits that don't gain send all rows left."""
    size = 2 ** (depth + 1) - 1
    feature, threshold, value = np.zeros(trees * size, dtype=np.int64), np.full(trees * size, np.inf), np.zeros(trees * size)
    positive = y.mean() if len(y) else 0.5
    base = float(np.log((positive * len(y) + 0.5) / ((1 - positive) * len(y) + 0.5)))
    model = Trees(feature, threshold, value, trees, depth, base)
    if not len(y) or positive in (0.0, 1.0):
        return model
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1)
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            gain = np.zeros(width)
            cut = np.zeros((width, 2), dtype=np.int64)
            for j in range(k):
                if not len(edges[j]):
                    continue
                at = local * bins + binned[:, j]
                hist = [np.bincount(at, weights=w, minlength=width * bins).reshape(width, bins).cumsum(1) for w in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (ga, ha, na) = hist, [c[:, -1:] for c in hist]
                won = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                won[(nl < least) | (na - nl < least)] = 0
                won[:, len(edges[j]) :] = 0
                best = won.argmax(1)
                top = won[np.arange(width), best]
                cut[top > gain] = np.stack([np.full(width, j), best], axis=1)[top > gain]
                gain = np.maximum(gain, top)
            for i in range(width):
                if gain[i] > 1e-6:
                    j, b = cut[i]
                    feature[t * size + first + i], threshold[t * size + first + i] = j, edges[j][b]
            at = t * size + node
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        sums = [np.bincount(node, weights=w, minlength=size) for w in (g, h)]
        value[t * size : (t + 1) * size] = rate * sums[0] / (sums[1] + ridge)
        total += value[t * size + node]
    return model


def _with(rows: DataFrame, model: Trees | None, name: str, kind: str) -> DataFrame:
    """The column ``name`` with the statistics, or with the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py() or b"") for t in b.column("text")]).reshape(-1, len(STATISTICS))
            out = pa.array(model.score(x)) if model else pa.array(x.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(name), out], [name, "out"])

    return rows.mapInArrow(run, f"{name} {kind}, out {'double' if model else 'array<double>'}")


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> Trees:
    """Fit on at most ``most`` documents with labels for which ``keep`` holds."""
    keep = F.lit(True) if keep is None else keep
    chosen = stage(sample_labels(labels, label_col, keep, id_col=id_col, most=most), "labels-sample")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # of rows that share an id the one with the least text counts, so that the sample is bounded
    rows = rows.groupBy("doc_id").agg(F.min("text").cast("binary").alias("text"), F.max("label").alias("label"))
    # a bounded number of rows, of some numbers each; their order must not matter to the fit
    got = sorted((r.out, r.label) for r in _with(rows.select("text", "label"), None, "label", "int").collect())
    x = np.array([g[0] for g in got]).reshape(-1, len(STATISTICS))
    return fit(x, np.array([g[1] for g in got], dtype=float))


def score(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score.

    Defined cases: null and empty texts have the statistics of no bytes and score by them; very
    long texts are read whole; repeated rows score alike; null ids return; an empty table gives no
    rows; other columns are ignored; without labels of both kinds all score the same.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return _with(rows, model, "doc_id", docs.schema[id_col].dataType.simpleString()).withColumnRenamed("out", "score")
