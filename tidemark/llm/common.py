"""Helpers shared by the corpus operators: folds, shared scratch tables, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step holds at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty string (crc32 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. The session's setting wins; only where it is unset and the master is local (tests) is one made here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir()
    if kept is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: there is no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        kept = spark.sparkContext.getCheckpointDir()
    return kept.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, for clusters that don't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(target))
    context._tidemark_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/corpus-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a Parquet table into the shared folder and read it back.

    The files stay until the cluster clears its checkpoint folder, as later lazy reads need them.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(columns: list[str], *wanted: str) -> tuple[str, ...]:
    """The wanted names, with underscores put before those that a column has already."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``most`` text bytes each: (slice, bytes, offsets). Whole texts only."""
    for batch in batches:
        data, off = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def texts_of(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    raw, cut = data.tobytes(), off.tolist()
    return [raw[a:b] for a, b in zip(cut, cut[1:])]


def ascii_lower_table() -> bytes:
    table = bytearray(range(256))
    table[65:91] = bytes(range(97, 123))
    return bytes(table)


ASCII_LOWER = ascii_lower_table()


# --- word hashes ----------------------------------------------------------------------------------

_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.empty(0, np.uint64)] * 2
_PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers


def word_hashes(data: np.ndarray, off: np.ndarray, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes that ``inside``, 256 booleans, admits), and the n + 1 word offsets of the texts."""
    own = inside[data]
    before = np.zeros(len(data), bool)
    before[1:] = own[:-1]
    first = off[:-1][np.diff(off) > 0]
    before[first] = False
    starts = np.flatnonzero(own & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = own[1:]
    after[off[1:][np.diff(off) > 0] - 1] = False
    ends = np.flatnonzero(own & ~after) + 1
    random = _RANDOM[np.frombuffer(ASCII_LOWER, np.uint8)] if lower else _RANDOM
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of whole words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        power, inverse = _power_tables(max(_PIECE, b - a) + 1)
        running = np.zeros(b - a + 1, np.uint64)
        np.cumsum(random[data[a:b]] * power[: b - a], out=running[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = mix((running[e] - running[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out, np.searchsorted(starts, off)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in a text (of the whole text if it has fewer words, but some), and their n + 1 offsets."""
    counts = np.diff(bounds)
    n = len(words)
    end = max(0, n - size + 1)
    code = np.full(end, size, np.uint64)
    for k in range(size):
        code = mix(code * np.uint64(_BASE) + words[k : k + end])
    owner = np.repeat(np.arange(len(counts)), counts)
    keep = np.flatnonzero(owner[:end] == owner[size - 1 :]) if end else np.empty(0, np.int64)
    full = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return code[keep], np.concatenate([[0], np.cumsum(full)])
    extra = np.empty(len(short), np.uint64)
    for i, text in enumerate(short.tolist()):
        own = words[bounds[text] : bounds[text + 1]]
        h = np.full(1, len(own), np.uint64)
        for k in range(len(own)):
            h = mix(h * np.uint64(_BASE) + own[k : k + 1])
        extra[i] = h[0]
    sizes = full.copy()
    sizes[short] = 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(offsets[-1], np.uint64)
    is_short = np.zeros(len(out), bool)
    is_short[offsets[:-1][short]] = True
    out[is_short], out[~is_short] = extra, code[keep]
    return out, offsets
