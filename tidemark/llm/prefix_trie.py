"""A trie of the shared prefixes of conversations that begin with another one's head, without building their texts.

Conversation c is rebuilt as the first h turns of conversation c - c % 5 (its base), then its own turns after its first h;
h = crc32 of the decimal c, modulo 9. A run of turns is an element (length, hash, bytes) of a monoid: hashes of two runs
combine as ``a * B^len(b) + b`` in four fields modulo 2^31 - 1 (124 bits). Prefix products of the original conversations are
taken once, blockwise: each range partition for itself, carried over where a conversation goes on in the next. A rebuilt
prefix is then put together from three of them, the base's head and two of the own ones; no text is copied.

A node is a group of rebuilt prefixes of one depth and fingerprint. Equality is verified, not taken for granted: a turn is
stored as a 128-bit reference, for which all turns with it are compared in full, and each node must hold one reference only.
As a parent's fingerprint follows from the child's and the reference, by induction all members of a node then have equal
turns. Should either check fail, everything is done again with another seed.

Sums over subtrees need no walk over the tree: a node's smallest member owns it, a conversation owns its nodes from some depth
on, and each leaf has one owner. Leaves below a node are its members that own a leaf; the saved bytes below it are, for each
member, the bytes from the node's depth up to where its own nodes begin. All steps are linear in the turns.

A conversation's rows are ordered by turn (null first), then role and text; null role or text is empty; rows that repeat count
as turns of their own. Rows without conv_id belong to no conversation and are left out. A conversation without a turn left
ends at the root. No rows: no nodes. Other columns are not read. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MODULUS = np.uint64((1 << 31) - 1)
BASES = (1103515245, 1664525015, 1566083941, 1812433253)
#: The longest head, and so the number of first turns that are kept for each conversation.
MOST_HEAD = 8
#: Ids that go into one piece of a node's list at most.
PIECE = 4096
_SHIFT = PIECE.bit_length() - 1
#: Seeds tried before giving up; one is enough unless 124 bits collide.
SEEDS = 4


# --- the monoid -----------------------------------------------------------------------------------


def _lanes(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    low = np.uint64((1 << 31) - 1)
    x, y = x.astype(np.uint64), y.astype(np.uint64)
    return [x >> np.uint64(31), x & low, y >> np.uint64(31), y & low]


def _packed(lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = lanes
    return ((a << np.uint64(31)) | b).astype(np.int64), ((c << np.uint64(31)) | d).astype(np.int64)


def _of_reference(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """What a turn's reference stands for in the four fields."""
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    return [v % MODULUS for v in (h1 >> half, h1 & low, h2 >> half, h2 & low)]


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    out, square, left = np.ones(len(exponent), np.uint64), np.uint64(base % int(MODULUS)), exponent.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % MODULUS, out)
        square, left = square * square % MODULUS, left >> np.uint64(1)
    return out


def combined(first: list[np.ndarray], second: list[np.ndarray], length: np.ndarray) -> list[np.ndarray]:
    """Hashes of runs followed by runs of the given lengths."""
    return [(a * _power(base, length) + b) % MODULUS for base, a, b in zip(BASES, first, second)]


def parents(fingerprint: list[np.ndarray], turn: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of runs without their last turn."""
    return [(f + MODULUS - t) % MODULUS * np.uint64(pow(base, -1, int(MODULUS))) % MODULUS for base, f, t in zip(BASES, fingerprint, turn)]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False)


_POWERS: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    kept = _POWERS.get(base, np.ones(1, np.uint64))
    while len(kept) <= n:
        kept = np.concatenate([kept, kept * _power(base, np.array([len(kept)]))[0] % MODULUS])
    _POWERS[base] = kept
    return kept


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix products of each conversation's rows in this partition, which come in order: (conv_id, part, k, x, y, s, h1, h2, n_bytes)."""
    part = TaskContext.get().partitionId()
    last = None  # conversation, its rows, bytes and fields so far
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, h1, h2, size = (_column(batch, c) for c in ("conv_id", "h1", "h2", "n_bytes"))
        new = np.ones(n, bool)
        new[1:] = conv[1:] != conv[:-1]
        start = np.flatnonzero(new)
        segment = np.cumsum(new) - 1
        k = np.arange(n) - start[segment] + 1
        total = np.concatenate([[0], np.cumsum(size)])
        s = total[1:] - total[start][segment]
        fields = []
        for base, turn in zip(BASES, _of_reference(h1, h2)):
            up, down = _table(base, n + 1), _table(pow(base, -1, int(MODULUS)), n + 1)
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turn * down[k] % MODULUS)])
            fields.append((run[1:] - run[start][segment]) % MODULUS * up[k] % MODULUS)
        if last is not None and last[0] == conv[0]:
            to = start[1] if len(start) > 1 else n
            before = [np.full(to, f, np.uint64) for f in last[3]]
            for f, g in zip(fields, combined(before, [f[:to] for f in fields], k[:to])):
                f[:to] = g
            k[:to] += last[1]
            s[:to] += last[2]
        last = (conv[-1], k[-1], s[-1], [f[-1] for f in fields])
        x, y = _packed(fields)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (conv, np.full(n, part, np.int64), k, x, y, s, h1, h2, size)], ["conv_id", "part", "k", "x", "y", "s", "h1", "h2", "n_bytes"])


def _carries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of a divided conversation the product of the parts before it: (conv_id, part, k, x, y, s)."""
    for batch in batches:
        rows = []
        for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist()):
            k, s, fields = 0, 0, [np.zeros(1, np.uint64)] * 4
            for p in sorted(parts, key=lambda p: p["part"]):
                x, y = _packed(fields)
                rows.append((conv, p["part"], k, int(x[0]), int(y[0]), s))
                fields = combined(fields, _lanes(np.array([p["x"]]), np.array([p["y"]])), np.array([p["k"]]))
                k, s = k + p["k"], s + p["s"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["conv_id", "part", "k", "x", "y", "s"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of the part combined after what was before it."""
    for batch in batches:
        fields = _lanes(_column(batch, "x"), _column(batch, "y"))
        k = _column(batch, "k")
        if batch.column("before_k").null_count < batch.num_rows:
            fields = combined(_lanes(_column(batch, "before_x"), _column(batch, "before_y")), fields, k)
        x, y = _packed(fields)
        own = [_column(batch, c) for c in ("conv_id", "h1", "h2", "n_bytes")]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (own[0], k + _column(batch, "before_k"), x, y, _column(batch, "s") + _column(batch, "before_s"), *own[1:])], ["conv_id", "pos", "x", "y", "s", "h1", "h2", "n_bytes"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of base head and own suffix: the own prefix with its first h turns exchanged for the base's."""
    for batch in batches:
        get = {c: _column(batch, c) for c in batch.schema.names}
        head, cut, own = (_lanes(get[f"{p}x"], get[f"{p}y"]) for p in ("base_", "cut_", ""))
        change = [(a + MODULUS - b) % MODULUS for a, b in zip(head, cut)]
        x, y = _packed(combined(change, own, get["pos"] - get["h"]))
        depth, s = get["pos"] - get["h"] + get["head"], get["s"] - get["cut_s"] + get["base_s"]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (get["conv_id"], depth, x, y, s, get["h1"], get["h2"], get["n_bytes"])], ["conv_id", "depth", "x", "y", "s", "h1", "h2", "n_bytes"])


def _with_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = _packed(parents(_lanes(_column(batch, "x"), _column(batch, "y")), _of_reference(_column(batch, "h1"), _column(batch, "h2"))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x), pa.array(y)], [*batch.schema.names, "px", "py"])


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined ids from its pieces, which come in order; one piece is in memory at a time."""
    at, digest = None, None

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], ["depth", "x", "y", "ends_sha256"])

    for batch in batches:
        rows = []
        for *key, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "x", "y", "ids"))):
            if key != at:
                if at is not None:
                    rows.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield made(rows)
    if at is not None:
        yield made([(*at, digest.hexdigest())])


# --- the trie -------------------------------------------------------------------------------------


def _turns(conversations: DataFrame, seed: int) -> DataFrame:
    """Turns with their 128-bit references."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    return rows.select("*", F.xxhash64(F.lit(2 * seed), "role", "text").alias("h1"), F.xxhash64("text", F.lit(2 * seed + 1), "role").alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"))


def _one_content(turns: DataFrame) -> bool:
    """Whether all turns of a reference are equal in full."""
    whole = F.struct("role", "text")
    return turns.groupBy("h1", "h2").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).where("low <> high").isEmpty()


def prefix_products(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, x, y, s, h1, h2, n_bytes) of all turns: the product of the conversation's turns up to each.

    Turns are dealt by ranges, so that a conversation of any length is divided among tasks. A conversation that goes on in the next
    part is one for each boundary at most, so the carried products are no more than twice the number of partitions.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    partial = "conv_id long, part long, k long, x long, y long, s long, h1 long, h2 long, n_bytes long"
    sorted_ = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "h1", "h2", "n_bytes")
    parts = written(sorted_.mapInArrow(_prefixes, partial), "products")
    ends = parts.groupBy("conv_id", "part").agg(F.max(F.struct("k", "x", "y", "s")).alias("e")).select("conv_id", F.struct("part", "e.*").alias("e"))
    divided = ends.groupBy("conv_id").agg(F.collect_list("e").alias("parts")).where(F.size("parts") > 1)
    carries = divided.mapInArrow(_carries, "conv_id long, part long, k long, x long, y long, s long")
    carries = carries.select("conv_id", "part", *(F.col(c).alias(f"before_{c}") for c in "kxys"))
    return parts.join(F.broadcast(carries), ["conv_id", "part"], "left").mapInArrow(_carried, "conv_id long, pos long, x long, y long, s long, h1 long, h2 long, n_bytes long")


def rebuilt_prefixes(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, x, y, s, h1, h2, n_bytes, length) of all prefixes of the rebuilt conversations but the empty ones, and (conv_id, length) of the conversations."""
    first = F.when(F.col("pos") <= MOST_HEAD, F.struct("pos", "x", "y", "s", "h1", "h2", "n_bytes"))
    known = products.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(first)).alias("first"))
    known = written(known.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)), "conversations")
    base = known.select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"), F.col("first").alias("base_first"))
    both = known.join(base, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base_id"), "left")
    zero, h = F.lit(0).cast("long"), F.col("h")
    head = F.least(h, F.coalesce("base_n", zero))
    both = both.withColumns({"head": head, "length": head + F.greatest(F.col("n") - h, zero)})
    at = {"base": F.try_element_at("base_first", F.greatest("head", F.lit(1)).cast("int")), "cut": F.try_element_at("first", F.greatest(h, F.lit(1)).cast("int"))}
    used = {"base": F.col("head") > 0, "cut": h > 0}
    fields = [F.coalesce(F.when(used[p], at[p][c]), zero).alias(f"{p}_{c}") for p in at for c in "xys"]
    copied = both.select("conv_id", "length", F.explode(F.slice("base_first", 1, F.col("head").cast("int"))).alias("t"))
    columns = ["x", "y", "s", "h1", "h2", "n_bytes"]
    copied = copied.select("conv_id", F.col("t.pos").alias("depth"), *(F.col(f"t.{c}").alias(c) for c in columns), "length")
    own = products.join(both.select("conv_id", "h", "head", "length", *fields), "conv_id").where(F.col("pos") > h)
    lengths = both.select("conv_id", "length")
    own = own.drop("length").mapInArrow(_rebuilt, "conv_id long, depth long, x long, y long, s long, h1 long, h2 long, n_bytes long")
    own = own.join(lengths, "conv_id")
    return copied.unionByName(own), lengths


def _nodes(prefixes: DataFrame) -> DataFrame:
    kept = [f(c).alias(f"{n}_{c}") for c in ("h1", "h2") for n, f in (("low", F.min), ("high", F.max))]
    nodes = prefixes.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"), *kept)
    one = (F.col("low_h1") == F.col("high_h1")) & (F.col("low_h2") == F.col("high_h2"))
    rows = nodes.select("depth", "x", "y", "conv_id", "n_convs", "n_bytes", F.col("low_h1").alias("h1"), F.col("low_h2").alias("h2"), one.alias("one"))
    return rows.mapInArrow(_with_parents, "depth long, x long, y long, conv_id long, n_convs long, n_bytes long, h1 long, h2 long, one boolean, px long, py long")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    for seed in range(SEEDS):
        turns = _turns(conversations, seed)
        if not _one_content(turns):
            continue
        prefixes, lengths = rebuilt_prefixes(prefix_products(turns))
        prefixes = written(prefixes, "prefixes")
        nodes = written(_nodes(prefixes), "nodes")
        if nodes.where("NOT one").isEmpty():
            return _described(nodes, prefixes, lengths)
    raise RuntimeError(f"fingerprints collide under {SEEDS} seeds")


def _described(nodes: DataFrame, prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    key, zero = ["depth", "x", "y"], F.lit(0).cast("long")
    children = nodes.where("depth > 1").groupBy(F.col("depth") - 1, "px", "py").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children.toDF(*key, "n_children"), key, "left").withColumn("n_children", F.coalesce("n_children", zero))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    nodes = written(nodes.join(above, ["depth", "px", "py"], "left").select(*key, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_bytes"), "linked")

    owners = nodes.where("n_convs > 1").select(*key, F.col("conv_id").alias("owner"))
    not_owned = prefixes.join(owners, key).where("conv_id <> owner").groupBy("conv_id").agg(F.max("s").alias("until"))
    leaves = nodes.where("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    members = not_owned.join(leaves, "conv_id", "full_outer")
    saved = F.greatest(F.coalesce("until", zero) - (F.col("s") - F.col("n_bytes")), zero)
    sums = prefixes.join(members, "conv_id").groupBy(*key).agg(F.sum(F.coalesce("leaf", zero)).alias("n_leaves"), F.sum(saved).alias("saved_tokens"))

    last = prefixes.where("depth = length").select(*key, "conv_id").unionByName(lengths.where("length = 0").select(*(zero.alias(c) for c in key), "conv_id"))
    pieces = last.groupBy(*key, F.shiftright("conv_id", _SHIFT).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = pieces.repartition(*key).sortWithinPartitions(*key, "piece").mapInArrow(_list_digests, "depth long, x long, y long, ends_sha256 string")

    totals = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).join(totals).where("n_convs > 0")  # one row each
    root = root.select(
        *(zero.alias(c) for c in key), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens")
    )
    smallest = root.select(F.col("conv_id").alias("top"))
    parent = F.when(F.col("depth") == 1, F.col("top")).otherwise(F.col("parent_conv_id"))
    below = nodes.join(sums, key, "left").join(F.broadcast(smallest))
    below = below.select(*key, "conv_id", parent.alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    rows = below.unionByName(root).join(ends, key, "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
