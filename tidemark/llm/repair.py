"""Repair of the role structure of conversations by weighted CYK parsing of spans.

The roles of a repaired conversation match ``(s?(ua)+)?``. With the states of that language (0 nothing yet, 1 after s, 2 after u,
3 after a), the nonterminal X(p, q) derives what leads from p to q, and the repair grammar is in Chomsky normal form: X(p, q) ->
X(p, r) X(r, q), and for one row X(p, q) -> keep, rerole or delete it. Empty texts of user and assistant may be inserted anywhere: the
insertion closure stands on both sides of each row's cell. A cell holds the least (cost, audit) of its span, costs first, then the
audit's ASCII order. Cells are combined bottom-up, spans of one row to those of two, four, eight and so on. As these nonterminals
lose nothing at a cut, every split of a span gives the same cells, so one is taken and a conversation costs as much as it has rows.

Least audits may be put together from least audits: both audits of one span have a letter other than I for each row, so if they cost
the same, none is the beginning of the other (what follows would be inserts alone, which cost), and what is added decides nothing.

Rows come by turn (null first), then role and text. A null id, turn, role or text is one space, as everywhere in the contract of
``damaged``; rows with a null conv_id are one conversation. Rows that repeat are duplicates after the first. Other columns are not
read. Texts may be of any length. No rows: no result.

Conversations of up to ``MOST_ROWS`` rows and ``MOST_BYTES`` of text are repaired each in one go; larger ones in blocks, whose cells are
combined. Both ways give the same result. Of a conversation in blocks, only the cells (letters for each row) and one block meet in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: The language: (state, role initial) -> state.
ARCS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
#: Beyond so many rows, or bytes of text, a conversation is repaired in blocks of BLOCK rows.
MOST_ROWS, MOST_BYTES, BLOCK = 100_000, 64 << 20, 4096

PAIRS = [(p, q) for p in range(4) for q in range(4) if p <= q or (p, q) == (3, 2)]
RULES = [[(PAIRS.index((p, r)), PAIRS.index((r, q))) for r in range(4) if (p, r) in PAIRS and (r, q) in PAIRS] for p, q in PAIRS]
Cells = tuple  # for each of PAIRS the least (cost, audit), or None


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of two spans, one after the other."""
    out = []
    for rules in RULES:
        best = None
        for i, j in rules:
            a, b = left[i], right[j]
            if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                found = (a[0] + b[0], a[1] + b[1])
                if best is None or found < best:
                    best = found
        out.append(best)
    return tuple(out)


def _inserts() -> Cells:
    """Cells of a span without rows: the cheapest inserts that lead from one state to another."""
    best = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, r), (cost, audit) in list(best.items()):
            for (state, role), q in ARCS.items():
                if state == r and role != "s":
                    best[p, q] = min(best.get((p, q), (99, "")), (cost + INSERT, audit + "I"))
    return tuple(best.get(pair) for pair in PAIRS)


EMPTY = _inserts()


def kind_of(initial: str, fault: str) -> str:
    """A row as the grammar sees it: its role's initial (o if not s, u or a), in upper case if truncated; - if it has to go."""
    if fault in ("blank", "duplicate"):
        return "-"
    kind = initial if initial in ("s", "u", "a") else "o"
    return kind.upper() if fault == "truncated" else kind


@lru_cache(None)
def _row(kind: str) -> Cells:
    best: dict[tuple[int, int], tuple[int, str]] = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != "-":
        more = TRUNCATED * kind.isupper()
        for (p, role), q in ARCS.items():
            ways = [(more, "K")] * (role == kind.lower()) + [(REROLE + more, "R")] * (role != "s")
            best[p, q] = min([*ways, *([best[p, q]] if (p, q) in best else [])], default=None) if ways else best.get((p, q))
    own = tuple(best.get(pair) for pair in PAIRS)
    return combined(combined(EMPTY, own), EMPTY)


@lru_cache(1 << 16)
def _short(kinds: str) -> Cells:
    return _row(kinds) if len(kinds) == 1 else combined(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def joined(spans: list[Cells]) -> Cells:
    """Cells of adjacent spans, combined bottom-up."""
    while len(spans) > 1:
        spans = [combined(*spans[k : k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0] if spans else EMPTY


def parsed(kinds: str) -> Cells:
    return joined([_short(kinds[k : k + 4]) for k in range(0, len(kinds), 4)])


def least(cells: Cells) -> tuple[int, str]:
    return min(cells[PAIRS.index((0, q))] for q in ACCEPTED if cells[PAIRS.index((0, q))] is not None)


def fault_of(text: str, later: bool) -> str:
    """A row's first fault."""
    rest = text.strip(WHITE)
    if not rest:
        return "blank"
    if later:
        return "duplicate"
    return "" if rest[-1] in ".!?" else "truncated"


class _Rebuilt:
    """A repaired conversation from its edits in order: its turns as they come, and the digest of those so far."""

    def __init__(self):
        self.state, self.digest, self.turns = 0, hashlib.sha256(), 0

    def edit(self, letter: str, role: str = "", text: str = "") -> tuple[int, str, str, str] | None:
        """The turn (its number from 1, the edit, role, text), if there is one."""
        if letter == "D":
            return None
        if letter != "K":
            role = "assistant" if self.state == 2 else "user"
        text = "" if letter == "I" else text
        self.state = ARCS[self.state, role[:1]]
        self.digest.update((("\n" if self.turns else "") + f"{role}:{text}").encode())
        self.turns += 1
        return self.turns, letter, role, text


_NOBODY = object()
_FAULTS = ("blank", "duplicate", "truncated")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, number long, edit string, role string, text string"
_NAMES = [c.split(" ")[0] for c in RESULT.split(", ")]


def _one(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> tuple[tuple, list[tuple]]:
    """A conversation's numbers, and its repaired turns."""
    faults, seen = [], set()
    for _, role, text in rows:
        key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        faults.append(fault_of(text, key in seen))
        seen.add(key)
    cost, audit = least(parsed("".join(kind_of(r[1][:1], f) for r, f in zip(rows, faults))))
    rebuilt, left, lines = _Rebuilt(), iter(rows), []
    for letter in audit:
        _, role, text = next(left) if letter != "I" else (None, "", "")
        lines.append(rebuilt.edit(letter, role, text))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    return (conv_id, gaps, *(faults.count(f) for f in _FAULTS), illegal, cost, audit, rebuilt.digest.hexdigest()), [(conv_id, *x) for x in lines if x]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    columns = [c.split(" ", 1) for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(columns)], [n for n, _ in columns])


def _records(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns))


def _grouped(records: Iterator[tuple], key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Records in order, gathered while their first ``key`` values stay the same."""
    at, rows = _NOBODY, []
    for r in records:
        if r[:key] != at:
            if rows:
                yield at, rows
            at, rows = r[:key], []
        rows.append(r[key:])
    if rows:
        yield at, rows


def _in_lots(rows: Iterator[tuple], schema: str, size: int = 1024) -> Iterator[pa.RecordBatch]:
    lot = []
    for r in rows:
        lot.append(r)
        if len(lot) >= size:
            yield _batch(lot, schema)
            lot = []
    yield _batch(lot, schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Conversations that come whole and in order: (conv_id, turn, role, text, copies)."""
    for (conv_id,), rows in _grouped(_records(batches), 1):
        yield _one(conv_id, [(turn, role, text) for turn, role, text, copies in rows for _ in range(copies)])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _in_lots((numbers for numbers, _ in _each(batches)), RESULT)


def _whole_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _in_lots((turn for _, turns in _each(batches) for turn in turns), TURNS)


# --- conversations in blocks ----------------------------------------------------------------------

_ROWS = "conv_id long, part long, block long, seq long, role string, text string, kind string, fault string, initial string"
_CELLS = "conv_id long, part long, block long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>"
_EDITS = "conv_id long, part long, block long, edits string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _numbered(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows():
            for seq, (conv_id, role, text, later) in enumerate(_records(batches)):
                fault = fault_of(text, later)
                yield conv_id, part, seq // block, seq, role, text, kind_of(role[:1], fault), fault, role[:1]

        return _in_lots(rows(), _ROWS)

    return run


def _block_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for key, own in _grouped(_records(batches), 3):
            kinds, faults, initials = (list(x) for x in zip(*own))
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            cells = parsed("".join(kinds))
            costs, audits = [c and c[0] for c in cells], [c and c[1] for c in cells]
            yield *key, len(kinds), *(faults.count(f) for f in _FAULTS), illegal, initials[0], initials[-1], costs, audits

    return _in_lots(rows(), _CELLS, 16)


def _block_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each block of a conversation, and (part -1) the whole conversation's numbers."""

    def rows():
        for (conv_id,), blocks in _grouped(_records(batches, 16), 1):
            spans = [tuple(None if c is None else (c, a) for c, a in zip(b[-2], b[-1])) for b in blocks]
            cost, audit = least(joined(spans))
            at = 0
            for k, b in enumerate(blocks):
                left, to = b[2], at
                while left:
                    left -= audit[to] != "I"
                    to += 1
                to = len(audit) if k == len(blocks) - 1 else to
                yield conv_id, b[0], b[1], audit[at:to], None, None, None, None, None, None
                at = to
            between = sum(a[-3] + b[-4] not in LEGAL for a, b in zip(blocks, blocks[1:]))
            yield conv_id, -1, -1, None, *(sum(b[i] for b in blocks) for i in (3, 4, 5)), between + sum(b[6] for b in blocks), cost, audit

    return _in_lots(rows(), _EDITS, 64)


def _block_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn or None, digest at the end) of conversations whose rows come in order, each block after its edits (seq -1); one block's edits are in memory at a time."""
    at, rebuilt, edits = _NOBODY, _Rebuilt(), iter(())
    for conv_id, seq, role, text in _records(batches):
        if conv_id != at or seq < 0:
            for letter in edits:
                yield at, rebuilt.edit(letter), None
        if conv_id != at:
            if at is not _NOBODY:
                yield at, None, rebuilt.digest.hexdigest()
            at, rebuilt = conv_id, _Rebuilt()
        if seq < 0:
            edits = iter(text)
            continue
        for letter in edits:
            yield at, rebuilt.edit(letter, role, text), None
            if letter != "I":
                break
    for letter in edits:
        yield at, rebuilt.edit(letter), None
    if at is not _NOBODY:
        yield at, None, rebuilt.digest.hexdigest()


def _block_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _in_lots(((conv_id, digest) for conv_id, _, digest in _block_turns(batches) if digest), "conv_id long, repaired_sha256 string")


def _block_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _in_lots(((conv_id, *turn) for conv_id, turn, _ in _block_turns(batches) if turn), TURNS)


def _joined(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null equals null; the right side's keys go."""
    other = right.withColumnsRenamed({c: f"other_{c}" for c in columns})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in columns))
    return left.join(other, same, how).drop(*(f"other_{c}" for c in columns))


def _in_blocks(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of conversations of any size: the distinct rows, the edits, and the rows in order with each block's edits before them. Duplicates are found by counts, order by ranges, cells by block."""
    distinct = written(rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "distinct")
    first = distinct.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("first"))
    copies = _joined(distinct, first, ["conv_id", "role", "text"]).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    later = ~(F.col("turn").eqNullSafe(F.col("first.turn")) & (F.col("copy") == 1))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    ordered = copies.withColumn("later", later).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "later")
    numbered = written(ordered.mapInArrow(_numbered(block), _ROWS), "numbered")

    place = ["conv_id", "part", "block"]
    cells = numbered.select(*place, "seq", "kind", "fault", "initial").repartition(*place).sortWithinPartitions(*place, "seq").drop("seq").mapInArrow(_block_cells, _CELLS)
    edits = written(cells.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_block_edits, _EDITS), "edits")
    begin = edits.where("part >= 0").select(*place, F.lit(-1).cast("long").alias("seq"), F.lit("").alias("role"), F.col("edits").alias("text"))
    lines = numbered.select(*place, "seq", "role", "text").unionByName(begin)
    return distinct, edits, lines.repartition("conv_id").sortWithinPartitions(*place, "seq").select("conv_id", "seq", "role", "text")


def _numbers(rows: DataFrame, block: int) -> DataFrame:
    distinct, edits, lines = _in_blocks(rows, block)
    digests = lines.mapInArrow(_block_digests, "conv_id long, repaired_sha256 string")
    turns = distinct.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    both = _joined(_joined(edits.where("part < 0"), digests, ["conv_id"]), turns, ["conv_id"])
    return both.select("conv_id", "gaps", *_FAULTS, "illegal", "cost", "audit", "repaired_sha256")


# --- the operator ---------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): every row with the damage that crc32(``conv_id:turn``) % 20 deals it; dropped ones have 0 copies and no text."""
    conv_id, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    code = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        conv_id.alias("conv_id"),
        turn.alias("turn"),
        F.when(code == 0, "").when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code <= 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as ``repaired`` takes them, as they are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, F.lit(1).cast("long").alias("copies"))


def _divided(rows: DataFrame, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Rows of the conversations that are repaired in one go, ordered; those of the others, if there are any; the others' ids.

    There is at most one large conversation for each ``most_rows`` rows or ``most_bytes`` bytes, so their ids may be broadcast.
    """
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text").cast("long") * F.greatest("copies", F.lit(1))).alias("size"))
    large = written(sizes.where((F.col("n") > most_rows) | (F.col("size") > most_bytes)).select("conv_id"), "large")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    some = not large.isEmpty()
    small = _joined(rows, F.broadcast(large), ["conv_id"], "left_anti") if some else rows
    return small.repartition("conv_id").sortWithinPartitions(*order), _joined(rows, F.broadcast(large), ["conv_id"], "left_semi") if some else None, large


def repaired(rows: DataFrame, *, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, copies): faults, the least cost, its edits in order, and the repaired text's digest."""
    small, rest, large = _divided(rows, most_rows, most_bytes)
    whole = small.mapInArrow(_whole, RESULT)
    if rest is None:
        return whole
    every = _joined(large, _numbers(rest, block), ["conv_id"], "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    filled = [F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in _NAMES[1:]]
    return whole.unionByName(every.select("conv_id", *filled))


def repaired_turns(rows: DataFrame, *, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, number (from 1), edit (K, R or I), role, text."""
    small, rest, _ = _divided(rows, most_rows, most_bytes)
    turns = small.mapInArrow(_whole_turns, TURNS)
    return turns if rest is None else turns.unionByName(_in_blocks(rest, block)[2].mapInArrow(_block_lines, TURNS))


def repairs(conversations: DataFrame, **sizes: int) -> DataFrame:
    """``conversations`` damaged by the contract's rule, then repaired."""
    return repaired(damaged(conversations), **sizes)
