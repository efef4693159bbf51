"""Documents to token files: toxicity, near-duplicates, benchmark passages, mix, token ids.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and its result is
written as Parquet and read again for the next. All but the last return the columns of documents.
As a stage's result is written before the next one is called, what it staged is deleted then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as _decontaminate
from tidemark.llm import mixing as _mixing
from tidemark.llm import near_copies as _near_copies
from tidemark.llm import token_output as _token_output
from tidemark.llm import toxicity as _toxicity
from tidemark.llm._common import stage, table
from tidemark.llm.queries import fold, vocabulary
from tidemark.staging import collected, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _tidy(apply: Stage) -> Stage:
    """Deletes what the stage before left, whose result has been written by now."""

    @wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        with collected() as own:
            out = apply(spark, docs, sf_dir)
        _left[:] = own
        return out

    return run


@_tidy
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Learns from the same labels as op5."""
    lexicon = _toxicity.learn(docs, table(spark, sf_dir, "labels"), keep=fold(5) != 0)
    return _toxicity.without_toxic(docs, lexicon)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays.

    Near: Jaccard similarity 0.8 or more of the sets of five-word shingles. The four words and
    four bits of op4 bind its own query only.
    """
    return _near_copies.without_near_copies(docs, size=5, similarity=0.8)


@_tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two benchmark items or more go; a single item's are cut out."""
    return _decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars" if "n_chars" in docs.columns else None)


@_tidy
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target, in slot order: a row for each round that takes of the document."""
    return _mixing.mixed(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


@_tidy
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, read back from the token files."""
    return _token_output.token_output(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: No SQL says what a learned classifier, a fingerprint or a tokenizer does: tests/llm has a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, apply in STAGES:
        out = apply(spark, docs, sf_dir)
        with collected() as own:
            docs = stage(out, name)
        release(spark, written)
        written = own
    return docs
