"""Token ids in a compact file format: canonical length-limited Huffman codes in independent blocks.

Every whole text is encoded by the tokenizer as it is and its ids written; Spark sums the global counts of the ids. From these the
package-merge algorithm makes code lengths of at most ``MAX_BITS``, and the lengths alone fix the
canonical codes. The documents are then dealt out by ranges of doc_id and written in ascending order.

File format, in a folder:

``codebook/``  one row per id that occurs: id, bits.
``blocks/``    one row per block: shard, first_token (tokens before it in its shard), n_tokens, payload. Shards
               ascend with doc_id, blocks within a shard with first_token. A block stands alone. Its payload
               is, little-endian: magic ``HUF1``, n_docs, n_tokens and n_bytes of the bit stream as uint32;
               per document a null flag (uint8), the doc_id (int64) and the number of tokens (uint32); for
               every ``STRIDE``-th token the offset of its first bit (uint32); then the bit stream, most
               significant bit first, in whole 32-bit words.

A block holds whole documents, at least one and about ``BLOCK_TOKENS`` ids. Decoding looks up ``MAX_BITS``
bits at a time in one table, at all check points of a block at once.

Spark writes and reads the rows (Parquet is the container), so any store that Spark reaches will do.

Defined results: null text counts as empty and has the end id only. Null doc_ids come first. Documents that
repeat a doc_id follow one another, in the order of their ids' checksum. An empty table gives no rows. Columns
other than doc_id and text are not read. The strings of special tokens in a text get these tokens' ids.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, steps, written

MAX_BITS = 20
STRIDE = 128
BLOCK_TOKENS = 1 << 17
SHARD_TOKENS = 1 << 24
#: Text bytes that go to the tokenizer at once; its result takes some hundred times as much. A longer text goes alone.
ENCODED_BYTES = 1 << 18
_MAGIC = b"HUF1"


# --- tokens ---------------------------------------------------------------------------------------


_tokenizers: dict[str, object] = {}


def tokenizer_of(path: str):
    """The tokenizer in a file, loaded once a worker. Spark spreads the texts, so the library's own threads stay off."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for part, _, _ in steps(batches, "text", ENCODED_BYTES):
            texts = part.column("text").fill_null("").to_pylist()
            ids = [np.array([*x.ids, end_id], np.uint32) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
            kind, width = ("<u2", 2) if max(int(x.max()) for x in ids) < 1 << 16 else ("<u4", 4)
            n = pa.array([len(x) for x in ids], pa.int64())
            packed = pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(np.full(len(ids), width, np.int8)), packed], ["doc_id", "n_tokens", "width", "ids"])

    return run


def _ids(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if width == 2 else "<u4").astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in batches:
        for width in (2, 4):
            own = batch.filter(pc.equal(batch.column("width"), width))
            ids = np.frombuffer(b"".join(own.column("ids").to_pylist()), "<u2" if width == 2 else "<u4")
            found, n = np.unique(ids, return_counts=True)
            for k, v in zip(found.tolist(), n.tolist()):
                total[k] = total.get(k, 0) + v
    yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "n"])


# --- code -----------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits, by package-merge. Counts are positive."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} ids don't fit codes of {most} bits")
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.float64)
    # Each level keeps, in order of weight, which of its items are leaves; the others are pairs of the level below.
    levels, row, leaf = [], weight, np.ones(n, bool)
    for _ in range(most - 1):
        levels.append(leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        row, leaf = both[at], at < n
    levels.append(leaf)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: ids sorted by (bits, id) get consecutive codes."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        size = int(self.ids.max()) + 1 if len(ids) else 1
        span = np.left_shift(np.int64(1), MAX_BITS - self.bits)  # table entries of each code
        first = np.cumsum(span) - span
        self.code_of, self.bits_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids] = (first >> (MAX_BITS - self.bits)).astype(np.uint64)
        self.bits_of[self.ids] = self.bits
        self._span = span

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each value of the next MAX_BITS bits: the id and its bits."""
        ids, bits = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
        used = int(self._span.sum())
        ids[:used], bits[:used] = np.repeat(self.ids, self._span), np.repeat(self.bits, self._span)
        return ids, bits


def encode_bits(ids: np.ndarray, book: Codebook) -> tuple[bytes, np.ndarray]:
    """The bit stream and the bit offsets of the check points."""
    n = book.bits_of[ids]
    end = np.cumsum(n, dtype=np.int64)
    start = end - n
    if len(ids) and end[-1] >= 1 << 32:
        raise ValueError("a block's codes don't fit the 32 bits of its check points")
    words = np.zeros((int(end[-1]) + 31) // 32 + 2 if len(ids) else 1, np.uint64)
    if len(ids):
        word, room = start >> 5, 64 - (start & 31) - n
        value = book.code_of[ids] << room.astype(np.uint64)  # in a 64-bit window that begins at the word
        for shift, step in ((32, 0), (0, 1)):
            part = (value >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first] + step] |= np.bitwise_or.reduceat(part, first)
    return words.astype(">u4").tobytes(), start[::STRIDE].astype("<u4")


def decode_bits(stream: bytes, points: np.ndarray, n_tokens: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids, one from each check point per step."""
    if not n_tokens:
        return np.empty(0, np.uint32)
    words = np.frombuffer(stream, ">u4").astype(np.uint64)
    words = np.concatenate([words, np.zeros(2, np.uint64)])
    ids_of, bits_of = table
    out = np.zeros((len(points), STRIDE), np.uint32)
    at = points.astype(np.int64)
    last = n_tokens - STRIDE * (len(points) - 1)
    limit, mask = len(words) - 2, np.uint64((1 << MAX_BITS) - 1)
    for k in range(STRIDE):
        if k == last:
            at = at[:-1]
            if not len(at):
                break
        word = np.minimum(at >> 5, limit)
        window = (words[word] << np.uint64(32)) | words[word + 1]
        key = ((window >> (np.uint64(64 - MAX_BITS) - (at & 31).astype(np.uint64))) & mask).astype(np.int64)
        out[: len(at), k] = ids_of[key]
        at = at + bits_of[key]
    return out.reshape(-1)[:n_tokens]


# --- blocks ---------------------------------------------------------------------------------------

_HEADER = struct.Struct("<4sIII")


def pack(docs: list[tuple[int | None, np.ndarray]], book: Codebook) -> tuple[int, bytes]:
    """One block of (doc_id, ids)."""
    ids = np.concatenate([x for _, x in docs])
    stream, points = encode_bits(ids, book)
    flags = bytes(d is None for d, _ in docs)
    keys = np.array([d or 0 for d, _ in docs], "<i8").tobytes()
    sizes = np.array([len(x) for _, x in docs], "<u4").tobytes()
    return len(ids), b"".join([_HEADER.pack(_MAGIC, len(docs), len(ids), len(stream)), flags, keys, sizes, points.tobytes(), stream])


def unpack(payload: bytes, table: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int | None, np.ndarray]]:
    magic, n_docs, n_tokens, n_bytes = _HEADER.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a block of this format")
    at = _HEADER.size
    flags = payload[at : at + n_docs]
    docs = np.frombuffer(payload, "<i8", n_docs, at + n_docs)
    sizes = np.frombuffer(payload, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    n_points = -(-n_tokens // STRIDE)
    points = np.frombuffer(payload, "<u4", n_points, at)
    at += 4 * n_points
    ids = decode_bits(payload[at : at + n_bytes], points, n_tokens, table)
    off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for null, doc, a, b in zip(flags, docs.tolist(), off.tolist(), off[1:].tolist()):
        yield (None if null else doc), ids[a:b]


def _write_blocks(codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(*codes.value)
        docs: list[tuple[int | None, np.ndarray]] = []
        size, before, shard = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, size, before
            n, payload = pack(docs, book)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], ["shard", "first_token", "n_tokens", "payload"])
            docs, size, before = [], 0, before + n
            return row

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "doc_id", "width", "ids"))
            for shard, doc, width, packed in zip(*columns):
                ids = _ids(packed, width)
                if docs and size + len(ids) > BLOCK_TOKENS:
                    yield flush()
                docs.append((doc, ids))
                size += len(ids)
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenise ``docs`` and write them to ``path`` in ascending doc_id order. ``tokenizer`` is a path that every worker can open."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokens = written(rows.mapInArrow(_tokenise(tokenizer, end_id), "doc_id long, n_tokens long, width byte, ids binary"), "tokens")
    counts = tokens.select("width", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    ids, n = counts.column("id").to_numpy(), counts.column("n").to_numpy()
    bits = code_lengths(n)
    spark.createDataFrame(pa.table({"id": ids, "bits": bits.astype(np.int32)})).coalesce(1).write.parquet(f"{path}/codebook")
    shards = max(int(-(-int(n.sum()) // SHARD_TOKENS)), spark.sparkContext.defaultParallelism if len(n) else 1)
    order = ["doc_id", "tie", "at"]
    placed = tokens.withColumns({"tie": F.crc32("ids"), "at": F.monotonically_increasing_id()}).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    blocks = placed.withColumn("shard", F.spark_partition_id()).select("shard", "doc_id", "width", "ids").mapInArrow(_write_blocks(spark.sparkContext.broadcast((ids, bits))), "shard int, first_token long, n_tokens long, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def _read_blocks(codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Codebook(*codes.value).table()
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload").to_pylist()):
                docs = list(unpack(payload, table))
                n = np.fromiter((len(x) for _, x in docs), np.int64, len(docs))
                ids = pa.array([x.astype("<u4").tobytes() for _, x in docs], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), ids], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents in the files: doc_id, start (ids of all documents before), n_tokens, ids (packed little-endian uint32)."""
    codes = spark.read.parquet(f"{path}/codebook").toArrow()
    book = spark.sparkContext.broadcast((codes.column("id").to_numpy(), codes.column("bits").to_numpy()))
    blocks = spark.read.parquet(f"{path}/blocks")
    # One number a shard comes to the driver; a shard is about SHARD_TOKENS ids.
    sizes = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before = [(shard, total - n) for (shard, n), total in zip(sizes, accumulate(n for _, n in sizes))]
    shards = F.broadcast(spark.createDataFrame(before, "shard int, before long"))
    placed = blocks.join(shards, "shard").select((F.col("before") + F.col("first_token")).alias("start"), "payload")
    return placed.mapInArrow(_read_blocks(book), "doc_id long, start long, n_tokens long, ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """Of ``read_tokens``: doc_id, start, n_tokens, ids_crc32."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def stored(docs: DataFrame, tokenizer: str, *, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new folder in the shared one and return the documents read back, with their packed ids."""
    path = shared_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id=end_id)
    return read_tokens(docs.sparkSession, path)
