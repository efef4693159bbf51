"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding undoes disguises: look-alike letters, digits and signs that stand for letters, accents and
case; i and l, which the digit 1 stands for alike, are one letter. The lexicon (whole words and
word beginnings with their log odds) and the exception phrases (in which a term doesn't count) are
learned from labelled documents, at most ``MAX_LABELLED`` of them; a logistic curve over the
weights' sum and its share of the text's length gives the score.

Evidence alone decides what is learned. An entry needs 1 in ``EVIDENCE`` of the toxic documents of
the sample, or ``LEAST`` of them, so there are at most ``EVIDENCE`` times as many entries as a
document has words and beginnings; exceptions are phrases round an entry in ``LEAST`` clean
documents or more, so fewer than the entries' places in the sample. Both are bounded by the sample,
whatever the corpus is.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stage

#: Labelled rows that are learned from, at most: those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
#: The share (one in so many) and the number of documents that must hold what is learned.
EVIDENCE, LEAST = 200, 3
#: Letters of the shortest beginning, and of the longest that the first pass counts.
SHORTEST, LONGEST = 4, 9
#: What stands for a letter. Latin look-alikes of Cyrillic and Greek letters, then
#: digits and signs.
LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
}
_TABLE = str.maketrans(LOOKALIKE)
_ACCENTS = re.compile("[̀-ͯ]+")
_OTHER = re.compile("[^a-z]+")
#: Signs count as letters only inside a word: elsewhere they are punctuation.
_SIGNS = re.compile(r"(?<![\w!|$@])[!|$@]+|[!|$@]+(?![\w!|$@])")
_DIGITS = re.compile(r"\b[0-9]+\b")


def fold(text: str) -> str:
    """Letters a-z with single spaces between words and at both ends."""
    text = _DIGITS.sub(" ", _SIGNS.sub(" ", text))
    text = text.lower()
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
    return f" {_OTHER.sub(' ', text.translate(_TABLE)).strip()} "


@dataclass
class Lexicon:
    """terms: ``" word "`` or the beginning ``" wor"`` to weight. exceptions: folded phrases."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    #: Of the logistic curve: constant, log of the sum, share of length.
    curve: tuple[float, float, float] = (-2.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight, False))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0, True))
        found.make_automaton()
        return found


def measure(text: str, machine: ahocorasick.Automaton) -> tuple[float, int]:
    """Sum of the weights (each word's best), and the number of folded words."""
    return _matched(fold(text), machine)


def _matched(folded: str, machine: ahocorasick.Automaton) -> tuple[float, int]:
    n = folded.count(" ") - 1 if len(folded) > 2 else 0
    if not len(machine):
        return 0.0, n
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []  # phrases, merged where they meet
    for end, (length, weight, exception) in machine.iter(folded):
        start = end - length + 1
        if exception:
            while spared and spared[-1][1] >= start:  # ends ascend, starts may not
                start = min(start, spared.pop()[0])
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared:
        starts, ends = zip(*spared, strict=True)
        best = {s: w for s, w in best.items() if (k := bisect_right(starts, s)) == 0 or s >= ends[k - 1]}
    return sum(best.values()), n


def features(total: float, n: int) -> tuple[float, float]:
    return np.log1p(total), np.log1p(1000.0 * total / (n + 100))


def _patterns(folded: str) -> set[str]:
    """Words and their first beginnings, with the space before them."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def _longer(stems: set[str], upto: int):
    """Patterns: the beginnings, of ``upto`` letters at most, that go on from one of ``stems``."""
    size = len(next(iter(stems)))

    def of(folded: str) -> set[str]:
        words = {w for w in folded.split() if len(w) >= size and f" {w[: size - 1]}" in stems}
        return {f" {w[:k]}" for w in words for k in range(size, min(len(w), upto) + 1)}

    return of


def _counted(rows: DataFrame, patterns) -> DataFrame:
    """pattern, toxic, clean: documents of each label that hold it. rows: folded, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            out = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0]))]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(out, ["pattern", "toxic", "clean"])

        for b in batches:
            for folded, label in zip(b.column("folded"), b.column("label").to_pylist(), strict=True):
                counts[label].update(patterns(folded.as_py()))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _log_odds(n_toxic: int, n_clean: int) -> Column:
    return F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))


def sample_labels(labels: DataFrame, label_col: str, keep: Column, *, id_col: str = "doc_id", most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, label of at most ``most`` labelled ids; an id labelled twice has its larger label."""
    rows = labels.filter(keep & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> Lexicon:
    """Fit on documents with labels for which ``keep`` (over the labels' columns) holds."""
    keep = F.lit(True) if keep is None else keep
    chosen = stage(sample_labels(labels, label_col, keep, id_col=id_col, most=most), "labels-sample")
    # at most ``most`` ids: safe to broadcast whatever the table's size; of rows that share an id
    # the one with the least text counts, so that the sample is bounded whatever repeats
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(rows.select("text", "label").repartition(parts).mapInArrow(_folded, "folded string, label int"), "labelled")
    n_toxic, n_all = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    n_clean = n_all - n_toxic
    if not n_toxic or not n_clean:
        # nothing says what toxic looks like: as if one clean document at least were known
        return Lexicon({}, [], (float(np.log(0.5 / (max(n_clean, 1) + 0.5))), 0.0, 0.0))
    least = max(LEAST, n_toxic // EVIDENCE)
    weight = _log_odds(n_toxic, n_clean)
    telling = (F.col("weight") >= 2.5) & (F.col("clean") <= F.col("toxic"))
    terms: dict[str, float] = {}
    patterns, longest = _patterns, LONGEST
    while True:
        # a beginning is in no more documents than a shorter one of it: only those with enough
        # evidence at the greatest length can go on
        held = _counted(rows, patterns).filter(F.col("toxic") >= least).withColumn("weight", weight)
        found = held.filter(telling | (F.length("pattern") == longest + 1) & ~F.endswith("pattern", F.lit(" "))).withColumn("tells", telling).collect()
        terms |= {r.pattern: float(r.weight) for r in found if r.tells}
        stems = {r.pattern for r in found if len(r.pattern) == longest + 1 and r.pattern[-1] != " "}
        if not stems:
            break
        patterns, longest = _longer(stems, 2 * longest), 2 * longest
    terms = _shortest(terms)
    words = Lexicon(terms).automaton()

    def phrases(folded: str) -> set[str]:
        out = set()
        if len(words):
            for end, (length, _, _) in words.iter(folded):
                start = end - length + 1
                stop = folded.find(" ", start + 1)
                before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
                if before >= 0:
                    out.add(folded[before : stop + 1])
                if after > 0:
                    out.add(folded[start : after + 1])
        return out

    spare = _counted(rows, phrases).filter((F.col("clean") >= LEAST) & (weight <= 0))
    lexicon = Lexicon(terms, sorted(r.pattern for r in spare.collect()))
    # two numbers and a label of each sampled row
    got = _measured(rows, lexicon, ["label"], "label int", folded=True).collect()
    x = np.array([[1.0, *features(r.total, r.n)] for r in got])
    lexicon.curve = _logistic(x, np.array([r.label for r in got], dtype=float))
    return lexicon


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [fold(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column("label")], ["folded", "label"])


def _shortest(terms: dict[str, float]) -> dict[str, float]:
    """``terms`` without those that another one begins."""
    out: dict[str, float] = {}
    for term in sorted(terms, key=lambda t: (len(t), t)):
        stem = term.rstrip()
        if not any(stem[:k] in out for k in range(SHORTEST + 1, len(stem) + 1)):
            out[term] = terms[term]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Newton steps with a ridge, so that separable labels give a finite curve."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * 0.1
        step = np.linalg.solve(hess, x.T @ (y - p) - 0.1 * ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _measured(rows: DataFrame, lexicon: Lexicon, names: list[str], schema: str, *, folded: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for b in batches:
            if folded:
                got = [_matched(t.as_py(), machine) for t in b.column("folded")]
            else:
                got = [measure(t.as_py() or "", machine) for t in b.column("text")]
            out = [b.column(n) for n in names] + [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*names, "total", "n"])

    return rows.mapInArrow(run, f"{schema}, total double, n long")


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score.

    Defined cases: a null or empty text scores what no matches score; matches in very long texts
    all count; repeated rows score alike; null ids return; an empty table gives no rows; other
    columns are ignored. Without labels of both kinds the lexicon is empty, and all score the same,
    below 0.5.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = _measured(rows, lexicon, ["doc_id"], f"doc_id {kind}")
    a, b, c = lexicon.curve
    x = F.lit(a) + F.lit(b) * F.log1p("total") + F.lit(c) * F.log1p(F.lit(1000.0) * F.col("total") / (F.col("n") + 100))
    return got.select("doc_id", (1 / (1 + F.exp(-x))).alias("score"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay.

    The score is a column of each row, so no join is needed and repeated rows are judged alike.
    """

    @F.pandas_udf("double")
    def total(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = lexicon.automaton()  # once a task
        a, b, c = lexicon.curve
        for texts in batches:
            x = [features(*measure(t or "", machine)) for t in texts]
            yield pd.Series([1 / (1 + np.exp(-(a + b * s + c * d))) for s, d in x], dtype=float)

    return docs.filter(total(F.col(text_col)) < threshold)
