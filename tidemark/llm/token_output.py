"""Token ids in Simple-8b files.

Documents are tokenised, put in ascending id order and written as binary shards by the executors;
reading the shards back needs no tokenizer.

File format (little-endian), one shard per file, named so that names sort as the documents do:

    magic ``TMS8B001``, then u64 x 4: documents, ids, blocks, words
    documents x (i64 doc_id, u8 is null, u64 number of ids)       as three arrays
    (blocks + 1) x u64: the word at which each block of ``BLOCK`` ids starts
    words x u64: Simple-8b words

A word's top four bits select how many ids its low 60 bits hold, first id lowest. Ids that fit no
selector take an escape: selector 15 and the raw value in the next word. A block's last word may be
padded with zeros; block offsets let a reader decode any block, or all of them at once.
"""

from __future__ import annotations

import contextlib
import gc
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import new_path, shared_dir, stage

MAGIC = b"TMS8B001"
#: Bits and count of each selector, most ids first; 60 bits a word.
SELECTORS = ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1))
ESCAPE = 15
BLOCK = 4096
#: A shard closes once it has so many ids; at most one document more.
SHARD_IDS = 4_000_000


#: The selector that just holds an id, by its bits; ESCAPE beyond 60.
_CLASS = np.array([0, *(next((s for s, (bits, _) in enumerate(SELECTORS) if bits >= n), ESCAPE) for n in range(1, 65))], dtype=np.uint8)
_COUNTS = np.array([c for _, c in SELECTORS] + [1, 1], dtype=np.int64)
_SMALL = _CLASS[np.frompyfunc(int.bit_length, 1, 1)(np.arange(65536)).astype(np.int64)]


def _classes(ids: np.ndarray) -> np.ndarray:
    if int(ids.max()) < 65536:
        return _SMALL[ids]
    return _CLASS[np.frompyfunc(int.bit_length, 1, 1)(ids).astype(np.int64)]


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy Simple-8b of each block of BLOCK ids (uint64): words, and where each block starts.

    All blocks advance together, a word each at a time, so that nothing here loops over ids.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    width = BLOCK + 60  # a block's last word may be padded with zeros
    padded = np.zeros((blocks, width), dtype=np.uint64)
    full = n // BLOCK
    padded[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    padded[full:, : n - full * BLOCK] = ids[full * BLOCK :]
    need = _classes(padded.ravel()).reshape(blocks, width)
    power = {1: need}  # windows' greatest class, by their length
    for k in (2, 4, 8, 16, 32):
        half = power[k // 2]
        power[k] = np.maximum(half[:, : -(k // 2)], half[:, k // 2 :])
    pick = np.full((blocks, BLOCK), ESCAPE, dtype=np.uint8)
    for s in range(len(SELECTORS) - 1, -1, -1):  # from few ids a word to many
        count = SELECTORS[s][1]
        k = 1 << (count.bit_length() - 1)
        most = np.maximum(power[k][:, :BLOCK], power[k][:, count - k : count - k + BLOCK])
        np.copyto(pick, np.uint8(s), where=most <= s)
    step = _COUNTS[pick]
    head = np.zeros((blocks, BLOCK), dtype=bool)
    row, at = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    end = np.minimum(n - row * BLOCK, BLOCK)
    while len(row):
        head[row, at] = True
        at = at + step[row, at]
        on = at < end[row]
        if not on.all():
            row, at = row[on], at[on]
    r, c = np.nonzero(head)
    flat, first = padded.ravel(), r * width + c
    chosen = pick[r, c]
    far = chosen == ESCAPE
    ends = np.cumsum(1 + far)
    place = ends - 1 - far
    out = np.zeros(int(ends[-1]), dtype=np.uint64)
    for s, (bits, count) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == s)
        if len(own):
            start = first[own]
            word = flat[start]
            for k in range(1, count):
                word |= flat[start + k] << np.uint64(k * bits)
            out[place[own]] = word | np.uint64(s << 60)
    out[place[far]] = np.uint64(ESCAPE << 60)
    out[place[far] + 1] = flat[first[far]]
    starts = np.concatenate((place[np.flatnonzero(np.diff(r, prepend=-1))], [len(out)]))
    return out, starts


def decode_words(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of all blocks; ``starts``: the word at which each begins, and the end."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.array([c for _, c in SELECTORS] + [0, 1])[sel]
    for i in np.flatnonzero(sel == ESCAPE).tolist():
        # the word after an escape is raw and may look like one itself
        if sel[i] == ESCAPE:
            sel[i + 1], count[i + 1] = -1, 0
    blocks = len(starts) - 1
    sums = np.concatenate(([0], np.cumsum(count)))
    extra = sums[starts[1:]] - sums[starts[:-1]] - np.minimum(n - np.arange(blocks) * BLOCK, BLOCK)
    # padding belongs to a block's last word: that it ends early shifts all blocks behind it
    first = sums[:-1] - np.repeat(np.concatenate(([0], np.cumsum(extra)[:-1])), np.diff(starts))
    size = count.copy()
    last = starts[1:] - 1
    last = last - (sel[last] == -1)
    size[last] -= extra
    for s, (bits, per) in enumerate(SELECTORS):
        own = np.flatnonzero(sel == s)
        mask = np.uint64((1 << bits) - 1)
        cut = own[size[own] < per]
        own = own[size[own] == per]
        low, at = words[own], first[own]
        for k in range(per if len(own) else 0):
            out[at + k] = (low >> np.uint64(k * bits)) & mask
        for i in cut.tolist():
            for k in range(int(size[i])):
                out[first[i] + k] = (words[i] >> np.uint64(k * bits)) & mask
    far = np.flatnonzero(sel == ESCAPE)
    out[first[far]] = words[far + 1]
    return out


def encode_shard(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    step = 64 * BLOCK  # what fits a core's cache
    parts = [encode_words(ids[i : i + step]) for i in range(0, len(ids), step)] or [encode_words(ids)]
    bases = np.cumsum([0, *(len(w) for w, _ in parts)])
    words = np.concatenate([w for w, _ in parts])
    offsets = np.concatenate([*(starts[:-1] + base for (_, starts), base in zip(parts, bases, strict=False)), bases[-1:]])
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join(
        [
            MAGIC,
            struct.pack("<4Q", len(doc_ids), len(ids), len(offsets) - 1, len(words)),
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            null.tobytes(),
            np.array(sizes, dtype="<u8").tobytes(),
            offsets.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def decode_shard(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids (None for null), ids per document, all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, n, blocks, n_words = struct.unpack_from("<4Q", data, 8)
    at = 40
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * (blocks + 1))
    ids = decode_words(words, offsets, n)
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], sizes, ids


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: The parts of a vocabulary file for which pieces may be cut here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def cut_here(path: str) -> bool:
    """Whether the vocabulary file normalises and cuts as :class:`WordBpe` does."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    parts = doc.get("normalizer") == NORMALIZER and doc.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    model = all(doc.get("model", {}).get(k) == v for k, v in MODEL.items())
    added = all("<|" in t["content"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in doc.get("added_tokens", []))
    return parts and model and added and not (doc.get("truncation") or doc.get("post_processor"))


class Known(dict):
    """Text to ids, made on first use."""

    #: Bytes held, about, before it starts anew: what bounds a worker's memory, whatever the texts
    #: are. ``ENTRY`` is what a key and its ids take besides their own bytes.
    MOST, ENTRY = 128 << 20, 180

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, text: str) -> bytes:
        got = self.make(text)
        if self.held >= self.MOST:
            self.clear()
            self.held = 0
        self[text] = got
        self.held += self.ENTRY + len(text) + len(got)
        return got


class WordBpe:
    """The ids that the tokenizers library gives, with its work done once a piece.

    For vocabularies whose normaliser is NFC, white space to one space, lower case, and whose
    pre-tokenizer takes the pieces of ``PIECES`` and drops white space: texts of ASCII and Latin-1
    letters are cut here, where Python's classes are the library's; other texts are cut at the
    contract's white space only and each chunk goes through the library whole. With any other
    vocabulary every text goes through the library whole.
    """

    #: The pre-tokenizer's alternatives over ASCII and Latin-1, after lower-casing.
    PIECES = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")
    PLAIN = re.compile("[\\x09-\\x0D\x20-~\xc0-\xff]*")
    CHUNKS = re.compile("[^\\x09-\\x0D\x20]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut_here = cut_here(path)
        if self.cut_here:
            with contextlib.suppress(AttributeError):  # not in all versions
                self.model._resize_cache(0)  # pieces come once; what repeats is cached here
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in shown]
        self.signs = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.plain, self.chunks = Known(self._plain), Known(self._chunk)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.signs.__getitem__, piece.encode()))
        return pack([t.id for t in self.model.tokenize(piece)])

    def _plain(self, chunk: str) -> bytes:
        """A piece is cut into itself alone, so chunks and pieces share one cache."""
        parts = self.PIECES.findall(chunk)
        return self._piece(chunk) if len(parts) == 1 else b"".join(map(self.plain.__getitem__, parts))

    def _chunk(self, chunk: str) -> bytes:
        return pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """All ids of the text, little-endian u32."""
        if not self.cut_here:
            return self._chunk(text)
        if "<|" not in text and self.PLAIN.fullmatch(text):
            # in such a text split() finds no other white space than the contract's
            return b"".join(map(self.plain.__getitem__, text.lower().split()))
        return b"".join(map(self.chunks.__getitem__, self.CHUNKS.findall(text)))


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """Of this process: its caches outlive a task."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write shards to ``folder``, which all executors can write to. Returns one row per shard.

    Columns: part, shard, name, n_docs, n_ids. Rows go to range partitions by id and are sorted in
    them, ties by the text; a task writes its shards under names of its own and moves them into
    place, so a task that runs twice leaves the same files.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column: the files hold ids as 64-bit integers")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        ids, doc_ids, sizes, total, shard = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{shard:06d}.s8b"
            data = encode_shard(doc_ids, sizes, np.frombuffer(b"".join(ids), "<u4").astype(np.uint64))
            temporary = f"{base}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "name": name, "n_docs": len(doc_ids), "n_ids": total}])

        was_on = gc.isenabled()
        gc.disable()  # the caches hold no cycles, and walking them takes long
        try:
            for b in batches:
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    got = words.encode(text.as_py()) + end
                    ids.append(got)
                    doc_ids.append(doc_id)
                    sizes.append(len(got) // 4)
                    total += len(got) // 4
                    if total >= SHARD_IDS:
                        yield close()
                        ids, doc_ids, sizes, total, shard = [], [], [], 0, shard + 1
            if doc_ids:
                yield close()
        finally:
            if was_on:
                gc.enable()  # the worker is used again

    return stage(rows.mapInArrow(run, "part long, shard long, name string, n_docs long, n_ids long"), "token-shards")


def read_tokens(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Per document, from the files alone but for the order of the shards.

    doc_id, start, n_tokens, ids_crc32. The table of shards has a row for each of up to
    ``SHARD_IDS`` ids; their starts are running sums over it.
    """
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("name", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                doc_ids, sizes, ids = decode_shard(data.as_py())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["name", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    got = files.mapInArrow(run, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return got.join(starts, "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, vocabulary: str, *, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, write and read back. Per document: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; each document ends with ``end_id``. Defined
    cases: a null or empty text is the end id alone; null ids come first; repeated ids each
    return, ordered by text; ids that aren't integers are refused; very long texts stay in one
    shard; an empty table gives no rows and no files; other columns are ignored. ``folder`` defaults to a new one under the shared folder.
    """
    spark = docs.sparkSession
    if folder is None:
        shared_dir(spark)
        folder = new_path(spark, "tokens")
    shards = write_tokens(docs, folder, vocabulary, end_id=end_id, id_col=id_col, text_col=text_col)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder, shards)
