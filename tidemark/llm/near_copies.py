"""Near copies by exact similarity of word-shingle sets, found by SimHash and, beyond it, MinHash.

A text is the set of its word shingles; equal sets are collapsed first. Sets in one component of
SimHash fingerprints at ``BITS`` or fewer differing bits (simhash.py: two segments, Hamming balls,
full verification, alternating stars) are candidates. That alone would lose links: copies of
similarity 0.8 differ in up to 17 of 64 bits. So two sets that agree in one of ``BANDS`` bands of
``ROWS`` minima each are candidates too: at Jaccard similarity 0.8 a pair shares no band once in a
million, and more similar pairs more rarely still. Below, a component counts as one more band.

Candidates that hang together come to one place with their sets, and each pair there is compared
in full, if they are ``CHUNK`` or fewer. In larger groups each set is first compared with the head
of each band that it shares. What hangs together by these links needs no more comparing within
itself: a band's sets that don't belong to its most frequent component are compared with all its
sets, chunk by chunk, so no group has to fit into one task, and a group of near copies of any size
takes work in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import row_key, stage
from .graph import components
from .simhash import SEED, first, first_rows, hung, majority, shingles, with_root

#: Fingerprints link at this many differing bits or fewer.
BITS = 4
BANDS, ROWS = 35, 5
#: Sets of a chunk, about: a unit of work compares two chunks at most.
CHUNK = 256
#: The candidates' keys are broadcast as a pre-filter up to this size; each takes some ``KEY_BYTES``
#: there.
BROADCAST_BYTES, KEY_BYTES = 32 << 20, 32
_RANDOM = np.random.default_rng(SEED)
_A = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; texts without words all have the same one."""
    found = shingles(text, size)
    return np.unique(found) if len(found) else np.zeros(1, dtype="<u8")


def _minima(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):  # what fits the cache
        np.minimum(least, (_A * x[at : at + 1024] + _B).min(axis=1), out=least)
    return least


def _keys(minima: np.ndarray) -> np.ndarray:
    """Rows of minima to rows of one key for each band."""
    rows = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = (key ^ rows[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(29))
    return key.view(np.int64)


def sketches(docs: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, k1, k2 (the row's key), fp (hash of the shingle set), simhash, keys (one of each band)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                fp, bits, least = [], [], []
                for t in b.column("text"):
                    found = shingle_set(t.as_py() or b"", size)
                    fp.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    bits.append(majority(found))
                    least.append(_minima(found))
                keys = _keys(np.array(least))
                ends = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                prints = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fp, bits)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *prints, found], [*names, "fp", "simhash", "keys"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, fp long, simhash long, keys array<long>")


def classes(ids: DataFrame) -> DataFrame:
    """``ids``: fp, simhash, fp being distinct. key, fp: one key for each component of fingerprints."""
    prints = ids.select(F.col("simhash").alias("fp"), F.col("fp").alias("least")).groupBy("fp").agg(F.min("least").alias("least"))
    roots = with_root(prints, BITS).select(F.col("fp").alias("simhash"), F.xxhash64(F.lit("simhash"), "root").alias("key"))
    return stage(ids.join(roots, "simhash").select("key", "fp"), "near-copy-classes")


def _bands(ids: DataFrame, named: DataFrame, *also: str) -> DataFrame:
    """key, fp, ``also``: a row for each band of ``ids`` and for each row of ``named`` (``classes``)."""
    return named.select("key", "fp", *also).union(ids.select(F.explode("keys").alias("key"), "fp", *also))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and fp: a key's other fps hang on its first."""
    last_key, last_fp = 0, None
    for b in batches:
        key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy()
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate(([last_fp is None or key[0] != last_key], key[1:] != key[:-1])))
        heads = np.concatenate(([0 if last_fp is None else last_fp], fp[starts]))
        head = heads[np.searchsorted(starts, np.arange(len(key)), side="right")]
        yield pa.RecordBatch.from_arrays([pa.array(head[head != fp]), pa.array(fp[head != fp])], ["a", "b"])
        last_key, last_fp = int(key[-1]), int(head[-1])


def _alike(sets: list[np.ndarray], similarity: float, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of the first one that it hangs together with.

    ``known``: labels; sets of one label hang together already and aren't compared.
    """
    group = np.arange(len(sets))
    if known is not None:
        _, at, place = np.unique(known, return_index=True, return_inverse=True)
        group = at[place]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(values), dtype=bool)
    for i, start in enumerate(starts[:-1]):
        if (group[i:] == group[i]).all():
            continue
        own = codes[start : start + sizes[i]]
        held[own] = True
        both = np.add.reduceat(held[codes[start:]], starts[i:] - start, dtype=np.int64)
        held[own] = False
        near = np.unique(group[i:][both / (sizes[i] + sizes[i:] - both) >= similarity])
        if len(near) > 1:
            group[np.isin(group, near)] = near[0]
    return group


def _near_first(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets are alike to the first one."""
    head = sets[0]
    both = np.array([np.isin(s, head, assume_unique=True, kind="sort").sum() for s in sets])
    return both / (len(head) + np.array([len(s) for s in sets]) - both) >= similarity


def _verified(units: DataFrame, at: list[str], similarity: float, *, stars: bool = False) -> DataFrame:
    """Edges a, b found within units of work. ``units``: the columns ``at``, fp, label, set.

    With ``stars`` the row with a null label is the head, and each other row is compared with it;
    otherwise all rows are compared with those of other labels.
    """
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            fps, sets = np.array([u[0] for u in unit], dtype=np.int64), [u[2] for u in unit]
            if stars:
                near = _near_first(sets, similarity)
                near[0] = False
                head = np.zeros(len(fps), dtype=np.int64)
            else:
                head = _alike(sets, similarity, np.array([u[1] for u in unit], dtype=np.int64))
                near = head != np.arange(len(head))
            return pa.RecordBatch.from_arrays([pa.array(fps[near]), pa.array(fps[head[near]])], ["a", "b"])

        place, unit = None, []
        for b in batches:
            places = zip(*(b.column(c).to_pylist() for c in at), strict=True)
            rows = zip(places, b.column("fp").to_pylist(), b.column("label").to_pylist(), b.column("set"), strict=True)
            for own, fp, label, s in rows:
                if own != place:
                    if len(unit) > 1:
                        yield out()
                    place, unit = own, []
                if not unit or unit[-1][0] != fp:
                    unit.append((fp, label, np.frombuffer(s.as_py(), dtype="<u8")))
        if len(unit) > 1:
            yield out()

    order = F.col("label").asc_nulls_first() if stars else F.col("fp")
    sorted_ = units.repartition(n, *at).sortWithinPartitions(*at, order, "fp")
    return sorted_.mapInArrow(run, "a long, b long")


def _chunks(count: str) -> Column:
    return F.ceil(F.col(count) / CHUNK).cast("int")


def _chunk(fp: str, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(fp), chunks).cast("int")


def links(docs: DataFrame, ids: DataFrame, *, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    """``ids``: fp, least, simhash, keys, fp being distinct. Edges a, b between sets that are alike."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = classes(ids)
    keyed = _bands(ids, named).repartition(n, "key").sortWithinPartitions("key", "fp")
    met = stage(keyed.mapInArrow(_stars, "a long, b long").distinct(), "near-copy-candidates")
    groups = stage(components(met), "near-copy-groups")
    counts = stage(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "near-copy-counts")
    members = groups.join(counts, "root").withColumnRenamed("node", "fp")
    members = stage(members.join(ids, "fp").select("fp", "least.k1", "least.k2", "root", (F.col("n") > CHUNK).alias("large")), "near-copy-members")
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    n_members, n_large = members.agg(F.count(F.lit(1)), F.count_if("large")).first()
    if n_members * KEY_BYTES <= BROADCAST_BYTES:
        texts = texts.join(F.broadcast(members.select("k1").distinct()), "k1", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "root", "large"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                found = [shingle_set(t.as_py() or b"", size).tobytes() for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, pa.binary())], [*names, "set"])

    # repeated rows combine before the shuffle: one text for each key
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    found = texts.join(members, ["k1", "k2"]).select("fp", "root", "large", "text")
    found = found.mapInArrow(sets, "fp long, root long, large boolean, set binary")
    if not n_large:
        return stage(_verified(found.withColumn("label", F.col("fp")), ["root"], similarity), "near-copy-links")
    found = stage(found, "near-copy-sets")
    small = found.filter("not large").withColumn("label", F.col("fp"))
    own = found.filter("large").select("fp", "set")
    first = stage(_verified(small, ["root"], similarity).union(_to_heads(met, own, similarity)), "near-copy-links")
    rest = _to_others(ids, named, own.select("fp"), first)
    rest = _verified(rest.join(own, "fp"), ["key", "kind", "low", "high"], similarity)
    return first.union(stage(rest, "near-copy-more-links"))


def _to_heads(met: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """Links of the sets of large groups to the heads of their bands; a head's sets come in chunks."""
    edges = met.select(F.col("a").alias("head"), F.col("b").alias("fp")).join(own.select("fp"), "fp")  # a band's sets are in one group
    many = stage(edges.groupBy("head").agg(F.count(F.lit(1)).alias("n")), "near-copy-heads")  # so a frequent head is no hot key
    at = edges.join(many, "head").select("head", _chunk("fp", _chunks("n")).alias("chunk"), "fp", F.col("fp").alias("label"))
    heads = many.select("head", F.explode(F.sequence(F.lit(0), _chunks("n") - 1)).alias("chunk"), F.col("head").alias("fp"), F.lit(None).cast("long").alias("label"))
    return _verified(at.unionByName(heads).join(own, "fp"), ["head", "chunk"], similarity, stars=True)


def _to_others(ids: DataFrame, named: DataFrame, large: DataFrame, edges: DataFrame) -> DataFrame:
    """key, kind, low, high, fp, label: the units in which what is left of large groups is compared.

    A band's sets outside its most frequent component so far, in chunks, meet each other's chunks
    and those of that component.
    """
    roots = stage(components(edges), "near-copy-roots").withColumnRenamed("node", "fp")
    labelled = large.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("label"))
    rows = stage(_bands(ids.join(labelled, "fp"), named.join(labelled, "fp"), "label"), "near-copy-bands")
    by = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = by.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")).filter(F.col("n") > F.col("main.n"))
    mixed = stage(mixed.select("key", F.col("main.label").alias("main"), F.col("main.n").alias("n_main"), (F.col("n") - F.col("main.n")).alias("n_rest")), "near-copy-mixed-bands")
    rows = rows.join(mixed, "key").withColumns({"mains": _chunks("n_main"), "rests": _chunks("n_rest"), "is_main": F.col("label") == F.col("main")})
    rows = rows.withColumn("own", _chunk("fp", F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))))
    unit = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))
    each = lambda count, to: F.transform(F.sequence(F.lit(0), F.col(count) - 1), to)
    of_main = each("rests", lambda o: unit(0, o, F.col("own")))
    of_rest = F.concat(each("mains", lambda o: unit(0, F.col("own"), o)), each("rests", lambda o: unit(1, F.least(o, F.col("own")), F.greatest(o, F.col("own")))))
    return rows.select("key", "fp", "label", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_rest)).alias("u")).select("key", "u.*", "fp", "label")


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies; all columns stay.

    Texts whose sets of shingles of ``size`` words have a Jaccard similarity of ``similarity`` or
    more are linked, and groups are what hangs together by links. The row with the smallest id
    stays; null ids come last, ties go by the row's key, and of repeated rows one stays. Defined
    cases: texts without words are alike; fewer words than ``size`` make one shingle.
    """
    rows = stage(sketches(docs, id_col=id_col, text_col=text_col, size=size), "sketches")
    ids = stage(rows.groupBy("fp").agg(F.min(first()).alias("least"), F.first("simhash").alias("simhash"), F.first("keys").alias("keys")), "distinct-sets")
    edges = links(docs, ids, id_col=id_col, text_col=text_col, size=size, similarity=similarity)
    return first_rows(docs, hung(ids.select("fp", "least"), edges), id_col=id_col, text_col=text_col)
