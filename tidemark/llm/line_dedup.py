"""Line dedup over the whole corpus, with keep bitmaps instead of text.

Lines become (hash, document, position) rows, range-partitioned by (hash, document) and sorted by
position as secondary key. The range partitioning already clusters (hash, document), so the first
occurrence in each document is streamed off the sorted run by a window without another exchange;
and since the document is part of the range key, a line found in a third of all documents is cut
over many partitions. Counting first occurrences by hash combines before its shuffle. Dropped
positions return as one run-length bitmap per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import let, lower_ascii, row_key, stage, text_of

#: Code points stripped from both ends of a line for its key (fixed values).
STRIP = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(STRIP)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_lines(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1, partitions: int | None = None
) -> DataFrame:
    """Per document with dropped lines: (k1, k2, runs), runs the run-length bitmap of lost lines.

    ``k1, k2`` is the document's key, see :func:`row_key`. ``runs`` is array<struct<start, len>>
    in line order; lines outside every run stay.
    """
    lines = docs.select(*row_key(id_col, text_col), F.posexplode(_lines(text_of(text_col))).alias("pos", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).filter(F.char_length("line") >= min_chars)
    # written first: the ranges are found by a sample of these, not by splitting all texts again
    lines = stage(lines.select(F.unhex(F.md5("line")).alias("h"), "k1", "k2", "pos"), "line-hashes")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(n, "h", "k1", "k2").sortWithinPartitions("h", "k1", "k2", "pos")
    in_doc = Window.partitionBy("h", "k1", "k2").orderBy("pos")
    ranged = stage(ranged.withColumn("first", F.row_number().over(in_doc) == 1), "lines")
    counts = ranged.filter("first").groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"))
    # written, so that the join below has a plain shuffle on both sides, which AQE splits if skewed
    lost = stage(counts.filter(F.col("n_docs") >= min_docs).select("h"), "lost-lines")
    dropped = ranged.select("h", "k1", "k2", "pos").join(lost, "h")
    # repeated rows of the table share a key and so give each position more than once
    found = dropped.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda p, i: (i == 0) | (F.element_at("at", F.greatest(i, F.lit(1))) != p - 1))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.element_at("at", F.least(i + 2, F.size("at"))) != p + 1))
    runs = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda z: F.struct(z["s"].alias("start"), (z["e"] - z["s"] + 1).alias("len")),
    )
    return found.select("k1", "k2", runs.alias("runs"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, runs (bitmap of lost lines), kept (text).

    A line is what lies between ``\\n``; its key drops white space at both ends and lower-cases
    A-Z. Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose
    all their lines everywhere. Defined cases: null or empty text is one empty line, which stays;
    repeated rows (same id and text) count as one document and get the same result; a null id is
    an id like another; an empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"), *row_key(id_col, text_col))
    marks = repeated_lines(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_chars=min_chars)
    rows = base.join(marks, ["k1", "k2"], "left")
    n_dropped = F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["len"]), F.lit(0))
    return rows.select(
        "doc_id",
        F.size(_lines(F.col("body"))).cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
        "runs",
        _kept().alias("kept"),
    )


def _kept() -> Column:
    """The text without its lost runs: the slices between them, joined by newlines."""

    def cut(lines: Column) -> Column:
        n = F.size("runs")
        gaps = F.transform(
            F.sequence(F.lit(0), n),
            lambda i: F.struct(
                F.when(i == 0, 0).otherwise(F.get("runs", i - 1)["start"] + F.get("runs", i - 1)["len"]).alias("a"),
                F.coalesce(F.get("runs", i)["start"], F.size(lines)).alias("b"),
            ),
        )
        full = F.filter(gaps, lambda g: g["b"] > g["a"])
        return F.array_join(F.transform(full, lambda g: F.array_join(F.slice(lines, g["a"] + 1, g["b"] - g["a"]), "\n")), "\n")

    return F.when(F.col("runs").isNull(), F.col("body")).otherwise(let(_lines(F.col("body")), cut))
