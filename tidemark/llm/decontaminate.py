"""Benchmark decontamination by a hash set of normalised n-grams.

The windows of the benchmark are hashed; every window of every training document is hashed in
the same way, exploded and probed against the set of hashes within one generated-code stage, so
only hits are ever materialised, with the words that stand there; a hit counts once its words are
found among the benchmark's windows. The set holds one long a window and is broadcast up to
``BROADCAST_BYTES``; beyond, the probes, which are a few longs each and carry no text, go through a
shuffled join, and hits get their words from the texts afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, lower_ascii, row_key, stage, text_of

#: The set of hashes is broadcast up to this size; each takes some ``HASH_BYTES`` there.
BROADCAST_BYTES, HASH_BYTES = 64 << 20, 32


#: What lies between words, in text that isn't lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column, *, lower: bool = True) -> Column:
    """Splitting at the gaps costs less than extracting the words; only the ends can be empty."""
    return F.array_remove(F.split(lower_ascii(text) if lower else text, GAP, -1), "")


def _hash(h: Column, at: Column, n: int) -> Column:
    """Of the window of ``n`` words at ``at``; ``h`` holds a hash of each word."""
    return F.xxhash64(*[F.get(h, at + i) for i in range(n)])


def word_hashes(w: Column) -> Column:
    """Each word's hash, so that a word isn't hashed again in each window that holds it."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _hashes(w: Column, sizes: list[int]) -> Column:
    """array<array<long>>, of each size the hashes of all windows; ``w`` has a hash of each word."""

    def of(n: int) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: _hash(w, i, n))
        return F.when(F.size(w) >= n, many).otherwise(F.array().cast("array<bigint>"))

    return F.array(*[of(n) for n in sizes])


def windows(bench: DataFrame, *, n: int = 8, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows: wid, h, n, window (its words); and which items have them: wid, item."""
    w = bench.select(F.col(item_col).cast("string").alias("item"), words(text_of(text_col)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(n)))
    w = w.select("item", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("at"))
    pairs = stage(w.select("item", "n", F.slice("w", F.col("at") + 1, F.col("n")).alias("window")).distinct(), "benchmark-pairs")
    wins = pairs.select("n", "window").distinct().withColumn("wh", word_hashes(F.col("window")))
    hashed = F.when(F.lit(False), F.lit(0).cast("long"))
    for k in range(1, n + 1):
        hashed = hashed.when(F.col("n") == k, _hash(F.col("wh"), F.lit(0), k))
    wins = stage(wins.select(F.monotonically_increasing_id().alias("wid"), hashed.alias("h"), "n", "window"), "benchmark-windows")
    items = pairs.filter("item is not null").join(wins, ["n", "window"]).select("wid", "item")
    return wins, items


def hits(docs: DataFrame, bench: DataFrame, *, n: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """Per document with verified hits: k1, k2, at (sorted word positions), items (sorted ids as strings)."""
    wins, items = windows(bench, n=n, item_col=item_col, text_col=bench_text_col)
    sizes = sorted(r[0] for r in wins.select("n").distinct().collect()) or [n]  # at most n values
    split = docs.select(*row_key(id_col, text_col), words(text_of(text_col)).alias("w"))
    probes = split.select("k1", "k2", "w", F.posexplode(let(word_hashes(F.col("w")), lambda h: _hashes(h, sizes))).alias("s", "hs"))
    # one long each: no row is built for a window before its hash was found
    probes = probes.select("k1", "k2", "w", "s", F.posexplode("hs").alias("at", "h"))
    hashes = wins.select("h").distinct()
    there = F.slice("w", F.col("at") + 1, F.element_at(F.array(*map(F.lit, sizes)), F.col("s") + 1)).alias("there")
    if hashes.count() * HASH_BYTES <= BROADCAST_BYTES:
        met = probes.join(F.broadcast(hashes), "h", "left_semi").select("k1", "k2", "at", "h", there)
    else:
        met = stage(probes.select("k1", "k2", "s", "at", "h").join(hashes, "h", "left_semi"), "window-hits")
        met = met.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "at", "h")).alias("met"))
        met = split.join(met, ["k1", "k2"]).select("k1", "k2", "w", F.inline("met")).select("k1", "k2", "at", "h", there)
    found = met.join(wins, "h").filter(F.col("there") == F.col("window")).select("k1", "k2", "at", "n", "wid")
    found = stage(found, "verified-hits")
    at = found.select("k1", "k2", F.sequence("at", F.col("at") + F.col("n") - 1).alias("at")).groupBy("k1", "k2")
    at = at.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("at"))
    held = found.select("k1", "k2", "wid").distinct().join(items, "wid").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return at.join(held, ["k1", "k2"], "left").select("k1", "k2", "at", F.coalesce("items", none).alias("items"))


def decontaminate(docs: DataFrame, bench: DataFrame, *, n: int = 8, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items, contaminated.

    A window is ``n`` consecutive words of an item, or all of a shorter one. A word inside any
    occurrence of a window is hit; a document with windows of at least ``min_items`` items is
    contaminated. Defined cases: null or empty texts have no words and no hits; items without
    words have no windows; repeated rows get the same result each; an item id that occurs twice is
    one item, and a null item id is none; empty tables give no rows or no hits; other columns are
    ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.size(words(text_of(text_col), lower=False)).cast("long").alias("n_words"))
    found = hits(docs, bench, n=n, id_col=id_col, text_col=text_col, item_col=item_col, bench_text_col=bench_text_col)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    rows = base.join(found, ["k1", "k2"], "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id",
        "n_words",
        size("at").alias("n_hit"),
        size("items").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (size("items") >= min_items).alias("contaminated"),
    )


def remove(docs: DataFrame, bench: DataFrame, *, n: int = 8, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` without contaminated documents; hit words of the others are cut from their text.

    A hit word goes with the separators before it. Documents without hits are returned as they
    are. All columns stay; ``length_col``, if given, gets the new text's code points. Nulls,
    repeated rows and empty tables as in :func:`decontaminate`.
    """
    found = hits(docs, bench, n=n, id_col=id_col, text_col=text_col)
    k1, k2 = row_key(id_col, text_col)
    marks = found.select(F.col("k1").alias("_tm_k1"), F.col("k2").alias("_tm_k2"), F.col("at").alias("_tm_at"), F.size("items").alias("_tm_items"))
    rows = docs.join(marks, (k1 == F.col("_tm_k1")) & (k2 == F.col("_tm_k2")), "left")
    rows = rows.filter(F.col("_tm_items").isNull() | (F.col("_tm_items") < min_items))
    gap, word = f"(?:{GAP})?", GAP.replace("[", "[^")

    def cut(text: Column) -> Column:
        # each piece is a word with the separators before it; what follows the last word stays
        pieces = F.regexp_extract_all(text, F.lit(gap + word), F.lit(0))
        tail = F.regexp_extract(text, gap + "$", 0)
        hit = F.map_from_arrays(F.col("_tm_at"), F.col("_tm_at"))
        keep = F.filter(pieces, lambda p, i: ~F.map_contains_key(hit, i))
        return F.concat(F.array_join(keep, ""), tail)

    text = F.when(F.col("_tm_at").isNull(), F.col(text_col)).otherwise(let(F.col(text_col), cut))
    rows = rows.withColumn(text_col, text)
    if length_col:
        rows = rows.withColumn(length_col, F.when(F.col("_tm_at").isNull(), F.col(length_col)).otherwise(F.char_length(F.col(text_col)).cast("long")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
