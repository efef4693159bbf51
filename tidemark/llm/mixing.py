"""Mixing sources to target weights by a low-discrepancy schedule.

Slots are numbered 0, 1, 2, ...; slot k's point frac(k * golden ratio) falls in one source's
stretch of the cumulative weights, so every prefix of the schedule is close to the weights. Slots
are ranked per source; each source's documents, shuffled by hash, form a stream of words cut into
blocks of equal word counts, and the source's r-th slot takes the r-th block, going round again
after the last. The slots drawn decide what is taken: a source gets its target within the few
blocks by which its share of the points departs from its weight, and only its last slot takes part
of a block, where the whole would pass the target.

Running positions come from range partitions, each with the sum of those before it, so neither a
source with any share of all rows nor a row repeated any number of times is ever in one task. No
table that grows with the sources is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, running, stage, text_of

#: The golden ratio's fraction (fixed value).
GOLDEN = 0.6180339887498949
#: The weights, repeating over the sources in order.
WEIGHTS = (5, 2, 1)
#: Words of a block, at most, and blocks that the smallest target should have; but no more than
#: ``SLOTS`` slots in all where larger blocks do.
BLOCK, FINE, SLOTS = 1024, 1024, 1 << 20
#: Cells of the unit interval, at least, by which points meet the sources' stretches.
CELLS = 4096


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes``: source, source_size. Adds place, weight and target.

    Targets are weight * level, held at ``most`` times the size; the level follows in closed form
    from the sources in order of most * size / weight, since those below it are the capped ones.
    """
    s = running(sizes, [F.col("source").isNotNull().cast("int") * -1, F.col("source")], {"place": F.lit(1)}, "mix-places")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = running(s, [F.col("cap") / F.col("weight"), F.col("place")], {"capped": "cap", "shut": "weight"}, "mix-levels")
    s = stage(s, "mix-caps")
    words, open_ = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # the level if a source and those after it are open: right for the first that it doesn't cap
    level = (F.lit(words * total) - F.col("capped")) / (F.lit(open_) - F.col("shut"))
    fits = s.withColumn("level", level).filter(F.col("level") <= F.col("cap") / F.col("weight"))
    found = fits.agg(F.min(F.struct("shut", "level"))["level"].alias("level")).first().level
    target = F.col("cap") if found is None else F.least("cap", F.col("weight") * F.lit(found))
    return s.select(*sizes.columns, "place", "weight", target.alias("target"))


def points(slot: Column) -> Column:
    """frac(slot * golden ratio); two steps keep it exact to some 2**-30 for any slot number."""
    far = (GOLDEN * (1 << 20)) % 1.0
    return F.pmod(F.shiftright(slot, 20) * F.lit(far) + F.pmod(slot, F.lit(1 << 20)) * F.lit(GOLDEN), F.lit(1.0))


def schedule(goal: DataFrame, n: int) -> DataFrame:
    """``goal``: place, quota. slot, place, rank, last: the first ``n`` slots.

    Points and stretches meet by cell. A cell holds its share of the points, so with as many cells
    as sources the pairs tried are in proportion to the slots, wherever the sources' ends crowd.
    """
    spark = goal.sparkSession
    # the place of a stretch isn't needed for its order: any order of the sources will do
    ends = stage(running(goal.filter("quota > 0").select("place", "quota"), ["place"], {"lo": "quota"}, "mix-ladder"), "mix-ends")
    words, sources = ends.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    cells, scale = max(CELLS, sources), F.lit(float(max(words, 1)))
    ends = ends.select("place", (F.col("lo") / scale).alias("lo"), ((F.col("lo") + F.col("quota")) / scale).alias("hi"))
    cell = lambda u: F.least(F.floor(u * F.lit(float(cells))), F.lit(cells - 1))
    pieces = ends.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    drawn = spark.range(n).select(F.col("id").alias("slot"), points(F.col("id")).alias("u"))
    drawn = drawn.withColumn("cell", cell(F.col("u"))).join(pieces, "cell").filter((F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi")))
    ranked = stage(running(drawn.select("slot", "place"), ["place", "slot"], {"nth": F.lit(1)}, "mix-drawn"), "mix-slots")
    # tables of sources are written: with their size known, none shuffles slots or rows by source
    counts = stage(ranked.groupBy("place").agg(F.min("nth").alias("first"), F.max("nth").alias("end")), "mix-counts")
    return ranked.join(counts, "place").select("slot", "place", (F.col("nth") - F.col("first")).alias("rank"), (F.col("nth") == F.col("end")).alias("last"))


def block_words(goal: DataFrame, block: int | None) -> tuple[int, int]:
    """Words of a block, and the number of slots that the quotas of ``goal`` need."""
    words, least = goal.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.min(F.when(F.col("quota") > 0, F.col("quota")))).first()
    block = block or max(1, min(BLOCK, max((least or 0) // FINE, words // SLOTS)))
    return block, -(-words // block)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, block: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rid: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as three tables.

    Documents: rid, doc_id, source, size, source_size, target.
    Slots: slot, place, rank, round, blk, take: the schedule in order, with the block that each
    takes and the words of it.
    Shares: rid, round, words, slot, size: what a document gives in a round, from its start, and
    the first slot that takes any of it.
    """
    if not 0 < most <= 2:
        raise ValueError("most must be over 0 and at most 2: a source is gone round twice")
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("k1"), (F.monotonically_increasing_id() if rid is None else rid).alias("rid"))
    # ids and order are written once: later steps and reruns of tasks see the same ones
    rows = stage(rows, "mix-documents")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(stage(sizes, "mix-sizes"), weights=weights, total=total, most=most)
    goal = stage(goal.withColumn("quota", F.round("target").cast("long")), "mix-targets")
    block, n = block_words(goal, block)

    placed = rows.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.select("rid", "doc_id", "source", "k1", "size", "place", "source_size", "target")
    placed = stage(running(placed, ["place", "k1", "doc_id", "rid"], {"begin": "size"}, "mix-shuffled"), "mix-positions")
    bases = stage(placed.groupBy("place").agg(F.min("begin").alias("base")), "mix-bases")

    blocks = F.ceil(F.col("source_size") / F.lit(block))
    slots = schedule(goal.select("place", "quota"), n).join(goal.select("place", "source_size", "quota"), "place")
    slots = slots.withColumns({"blk": F.pmod("rank", blocks), "round": F.floor(F.col("rank") / blocks)}).filter("round < 2")
    whole = F.least(F.lit(block), F.col("source_size") - F.col("blk") * block)
    left = F.col("quota") - F.col("round") * F.col("source_size") - F.col("blk") * block
    take = F.when(F.col("last"), F.least(whole, F.greatest(F.lit(0), left))).otherwise(whole)
    slots = stage(slots.withColumn("take", take).filter("take > 0").select("slot", "place", "rank", "round", "blk", "take"), "mix-schedule")

    pieces = placed.filter("size > 0").join(bases, "place").withColumn("begin", F.col("begin") - F.col("base"))
    spans = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))
    pieces = pieces.select("rid", "place", "begin", "size", F.explode(spans).alias("blk"))
    start = F.col("blk") * block
    part = F.least(F.col("begin") + F.col("size"), start + F.col("take")) - F.greatest("begin", start)
    met = pieces.join(slots, ["place", "blk"]).withColumn("part", part).filter("part > 0")
    shares = met.groupBy("rid", "round").agg(F.sum("part").alias("words"), F.min("slot").alias("slot"), F.max("size").alias("size"))
    return placed.select("rid", "doc_id", "source", "size", "source_size", "target"), slots, shares


def mixing(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size (words), source_size, target, taken (repeats counted).

    Sources in code point order, null last, have the weights in turn and share ``total`` times all
    words; a target stops at ``most`` (at most 2) times its source's size and the excess goes to
    the others by weight. A source's taken words miss its target by a few blocks at most, by the
    discrepancy of the schedule; a block has ``block`` words, by default a 1024th of the smallest
    target, within limits. Defined cases: null or empty texts have size 0 and nothing taken; null
    sources are one source; repeated rows count each; ties in the shuffle are broken by id; a
    source without words has target 0; an empty table gives no rows; other columns are ignored.
    """
    rows, _, shares = mix(docs, **options)
    taken = shares.groupBy("rid").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None, slot_col: str | None = None, **options) -> DataFrame:
    """The documents of the mix in slot order: one row for each round that takes any words.

    All columns are kept, and ``slot_col``, if given, is the first slot that takes of the row. A
    document taken in part (one at most a source and round) is cut after its last taken word.
    """
    own = stage(docs.withColumn("_tm_rid", F.monotonically_increasing_id()), "mix-rows")
    _, _, shares = mix(own, text_col=text_col, rid=F.col("_tm_rid"), **options)
    names = {"rid": "_tm_rid", "words": "_tm_words", "slot": "_tm_slot", "round": "_tm_round"}
    shares = shares.select(*[F.col(a).alias(b) for a, b in names.items()], (F.col("words") < F.col("size")).alias("_tm_cut"))
    got = own.join(shares, "_tm_rid").orderBy("_tm_slot", "_tm_rid", "_tm_round")
    head = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(head, 1, F.col("_tm_words").cast("int")), "")
    got = got.withColumn(text_col, F.when(F.col("_tm_cut"), cut).otherwise(F.col(text_col)))
    if length_col:
        got = got.withColumn(length_col, F.when(F.col("_tm_cut"), F.char_length(text_col).cast("long")).otherwise(F.col(length_col)))
    found = [F.col(f"`{c}`") for c in docs.columns]
    return got.select(*found, *([F.col("_tm_slot").alias(slot_col)] if slot_col else []))
