"""SimHash near-duplicates by multi-index hashing.

Fingerprints (64 bits over hashed word shingles) are collapsed to distinct ones first. Each is cut
into two 32-bit segments. Two fingerprints within 4 bits agree in one segment up to 2 bits, so the
Hamming balls of radius 1 around both segments' values share a centre: each fingerprint enters 33
keys per segment, rows are hashed by key and sorted, and the rows of a key are compared in full.
Random meetings are rare with 2**32 keys a segment, so the work grows in proportion to the input.

A key that more than ``MAX_PAIRED`` fingerprints share isn't paired: those fingerprints are linked
exactly instead through all 2,081 centres within 2 bits of the whole 64-bit value. Any two of one
such centre are within 4 bits, and any two within 4 bits have one, so a chain to the centre's least
fingerprint gives the same components, in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import row_key, stage
from .graph import components

SEED = 42
#: Rows of one key that are compared pair by pair.
MAX_PAIRED = 256
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Hashes of the word shingles of one text, repeated ones too; none for a text without words.

    A-Z are lower-cased; bytes.split() takes the contract's six white spaces.
    """
    words = text.lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)] if words else [], dtype="<u8")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype="<u8")


def fingerprint(text: bytes, size: int = 4) -> int:
    """Of one text; zero without words."""
    return majority(shingles(text, size))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """doc_id, k1, k2 (the row's key), fp (the fingerprint's 64 bits as a signed long)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"", size) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fp.view(np.int64))], [*names, "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, fp long")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under the 33 keys of each segment; a key holds the segment in bit 32."""
    masks = np.concatenate(([0], 1 << np.arange(32))).astype(np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 8192):
            fp = b.column("fp").slice(at, 8192).to_numpy().view(np.uint64)
            low, high = (fp & np.uint64(0xFFFFFFFF)).astype(np.int64), (fp >> np.uint64(32)).astype(np.int64)
            keys = np.concatenate([(low[:, None] ^ masks).ravel(), ((high[:, None] ^ masks) | (1 << 32)).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(np.repeat(fp.view(np.int64), 33), 2))], ["key", "fp"])


def _pairs(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified links among rows sorted by key, and the fingerprints of keys that are too full."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    full = np.repeat(sizes > MAX_PAIRED, sizes)
    dense = fp[full]
    key, fp = key[~full], fp[~full]
    u, part = fp.view(np.uint64), key >> 32
    own = np.where(part == 1, (u >> np.uint64(32)).astype(np.int64), (u & np.uint64(0xFFFFFFFF)).astype(np.int64))
    mask = own ^ (key & 0xFFFFFFFF)  # 0, or the bit in which the value differs from the centre
    left, right = [], []
    for d in range(1, MAX_PAIRED):
        i = np.flatnonzero(key[d:] == key[:-d])
        if not len(i):
            break
        j = i + d
        # a pair meets at several centres: only the least of them counts
        centre = key[i] & 0xFFFFFFFF
        other = centre ^ mask[i] ^ mask[j]
        once = np.where(mask[i] == mask[j], mask[i] == 0, centre < other)
        near = once & (np.bitwise_count(u[i] ^ u[j]) <= bits)
        left.append(fp[i[near]])
        right.append(fp[j[near]])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), dense


def links(fps: DataFrame, *, bits: int = 4) -> DataFrame:
    """``fps``: distinct fp. Edges a, b whose components are those of all pairs within ``bits``."""
    if bits not in (0, 2, 4):
        # two segments with balls of radius 1 find no more, and centres need an even distance
        raise ValueError("bits must be 0, 2 or 4")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
            a, b = np.concatenate([a, dense]), np.concatenate([b, dense])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        rest_k = rest_f = np.zeros(0, dtype=np.int64)
        for batch in batches:
            key = np.concatenate([rest_k, batch.column("key").to_numpy()])
            fp = np.concatenate([rest_f, batch.column("fp").to_numpy()])
            if not len(key):
                continue
            at = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if len(key) - at > 2 * MAX_PAIRED:  # surely full: pass on all but enough to stay so
                at_end = len(key) - MAX_PAIRED - 1
                a, b, dense = _pairs(key[:at], fp[:at], bits)
                yield out(a, b, np.concatenate([dense, fp[at:at_end]]))
                rest_k, rest_f = key[at_end:], fp[at_end:]
                continue
            if at:
                yield out(*_pairs(key[:at], fp[:at], bits))
            rest_k, rest_f = key[at:], fp[at:]
        if len(rest_k):
            yield out(*_pairs(rest_k, rest_f, bits))

    keyed = fps.select("fp").mapInArrow(_segments, "key long, fp long").repartition(n, "key").sortWithinPartitions("key")
    found = stage(keyed.mapInArrow(verify, "a long, b long"), "simhash-links")
    pairs = found.filter("a != b")
    dense = found.filter("a = b").select(F.col("a").alias("fp")).distinct()
    if dense.isEmpty():
        return pairs

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = [1 << i for i in range(64)]
        two = [a ^ b for k, a in enumerate(one) for b in one[:k]]
        radius = bits // 2
        masks = np.array([0, *(one if radius else []), *(two if radius > 1 else [])], dtype=np.uint64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                fp = b.column("fp").slice(at, 256).to_numpy()
                keys = (fp.view(np.uint64)[:, None] ^ masks).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(fp, len(masks)))], ["key", "fp"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for b in batches:
            key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy()
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            a, c = fp[:-1][same], fp[1:][same]
            if last and last[0] == key[0]:
                a, c = np.append(a, last[1]), np.append(c, fp[0])
            last = (int(key[-1]), int(fp[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    near = dense.mapInArrow(balls, "key long, fp long").repartition(n, "key").sortWithinPartitions("key")
    return pairs.union(near.mapInArrow(chain, "a long, b long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at ``bits`` or fewer differing bits are linked; component_id is the smallest id
    reachable. Defined cases: a text without words (null, empty) has fingerprint zero and links
    like any other; fewer words than ``size`` make one shingle; null ids return with their
    component, but name one only if it has no other id (then null); repeated rows share a
    component; an empty table gives no rows; other columns are ignored.
    """
    fp = stage(fingerprints(docs, id_col=id_col, text_col=text_col, size=size).drop("k1", "k2"), "fingerprints")
    rooted = with_root(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), bits)
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    named = stage(rooted.join(least, "root").select("fp", "component_id"), "named")
    return fp.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_root(distinct: DataFrame, bits: int) -> DataFrame:
    """``distinct``: fp, least. Adds root, the least fingerprint of fp's component."""
    ids = stage(distinct, "distinct-fingerprints")
    return hung(ids, links(ids.select("fp"), bits=bits))


def hung(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``ids``: fp, least. Adds root, the least fp of fp's component under ``edges`` (a, b)."""
    roots = stage(components(edges), "fingerprint-roots")
    found = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return stage(found.select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")


def first() -> Column:
    """Orders the rows of a group: the first of them stays."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all columns stay.

    The row with the smallest id stays; null ids come last, ties go by the row's key, and of
    repeated rows one stays.
    """
    fp = stage(fingerprints(docs, id_col=id_col, text_col=text_col, size=size), "fingerprints")
    return first_rows(docs, with_root(fp.groupBy("fp").agg(F.min(first()).alias("least")), bits), id_col=id_col, text_col=text_col)


def first_rows(docs: DataFrame, rooted: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are the least of their root, each once."""
    stay = rooted.groupBy("root").agg(F.min("least").alias("least"))
    stay = stay.select(F.col("least.k1").alias("_tm_k1"), F.col("least.k2").alias("_tm_k2"))
    k1, k2 = row_key(id_col, text_col)
    own = docs.withColumns({"_tm_k1": k1, "_tm_k2": k2}).join(stage(stay, "kept-rows"), ["_tm_k1", "_tm_k2"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("_tm_k1", "_tm_k2").orderBy("_tm_k1"))
    return own.withColumn("_tm_nth", nth).filter("_tm_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
