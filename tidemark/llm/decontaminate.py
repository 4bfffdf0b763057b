"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The training words stream through the automaton, which tracks the longest match that ends at each word.
A match of at least ``window`` words covers windows of an item; a shorter item counts when it occurs
whole. Runs of words that are too short to hold a window of benchmark vocabulary are passed over.

The items are read in blocks whose bytes are counted first, and a worker holds the automaton of one block at
a time, so its memory doesn't grow with the benchmark. With one block the documents are never shuffled; with
several, what each finds is brought together by the digest of the text.

Defined results: null text has no words; an item without words is never found; a null item id counts as
the empty string; items with equal ids count once. Overlapping spans are merged. Rows that repeat are treated
one by one; an empty table of documents gives no rows, an empty benchmark finds nothing. A text of any length
is read whole. ``decontaminated`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, steps, texts_of, written

#: Some 60 bytes of automaton for each byte of a block.
BLOCK_BYTES = 2 << 20


def _word_table() -> bytes:
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    table[48:58] = bytes(range(48, 58))
    table[65:91] = table[97:123] = bytes(range(97, 123))
    return bytes(table)


WORD_TABLE = _word_table()
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class SuffixAutomaton:
    """Of the items' word sequences. ``hits`` finds the spans of windows and the items they belong to.

    A state keeps four integers: its link, its length, and its first transition's word and target. Most states have no
    other; the rest are in one dictionary for all states. Items are numbered.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.link, self.length, self.word, self.target = array("i"), array("i"), array("i"), array("i")
        self.more: dict[int, int] = {}  # state and word: target
        self.words_of: dict[int, list[int]] = {}  # the other words of a state
        self._state(-1, 0)
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        sequences = [(number[name], array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])) for name, words in items if words]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        # The last state up the links, itself included, that is still as long as a window: it stands for the window that ends there.
        self.holder = array("i", range(len(self.link)))
        for state in by_length:
            if self.length[self.link[state]] >= window:
                self.holder[state] = self.holder[self.link[state]]
        self.owner = array("i", [-1]) * len(self.link)  # the item of a state's windows, and the others if there are several
        self.owners: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for name, sequence in sequences:
            state, length = 0, 0
            for word in sequence:
                state, length = self.step(state, length, word)
                if length >= window:
                    holder = self.holder[state]
                    if self.owner[holder] < 0:
                        self.owner[holder] = name
                    elif self.owner[holder] != name:
                        self.owners.setdefault(holder, set()).add(name)
            if len(sequence) < window:
                self.whole.setdefault(state, []).append((len(sequence), name))
        # The nearest state up the links, itself included, at which a short item ends; 0 if there is none.
        self.nearest = array("i", [0]) * len(self.link)
        for state in by_length:
            self.nearest[state] = state if state in self.whole else self.nearest[self.link[state]]
        self.shortest = min((len(s) for _, s in sequences), default=window)

    def _after(self, state: int, word: int) -> int:
        """The target of a transition, -1 if there is none."""
        return self.target[state] if self.word[state] == word else self.more.get(state << 32 | word, -1)

    def _lead(self, state: int, word: int, target: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.target[state] = word, target
            return
        key = state << 32 | word
        if key not in self.more:
            self.words_of.setdefault(state, []).append(word)
        self.more[key] = target

    def _extend(self, last: int, word: int) -> int:
        found = self._after(last, word)
        if found >= 0:
            return found if self.length[found] == self.length[last] + 1 else self._clone(last, word, found)
        state = self._state(0, self.length[last] + 1)
        at = last
        while at >= 0 and (found := self._after(at, word)) < 0:
            self._lead(at, word, state)
            at = self.link[at]
        if at >= 0:
            self.link[state] = found if self.length[found] == self.length[at] + 1 else self._clone(at, word, found)
        return state

    def _clone(self, at: int, word: int, found: int) -> int:
        twin = self._state(self.link[found], self.length[at] + 1)
        self.word[twin], self.target[twin] = self.word[found], self.target[found]
        for other in self.words_of.get(found, ()):
            self._lead(twin, other, self.more[found << 32 | other])
        self.link[found] = twin
        while at >= 0 and self._after(at, word) == found:
            self._lead(at, word, twin)
            at = self.link[at]
        return twin

    def _state(self, link: int, length: int) -> int:
        for column, value in ((self.link, link), (self.length, length), (self.word, -1), (self.target, -1)):
            column.append(value)
        return len(self.link) - 1

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest suffix of what was read that occurs in an item."""
        while (after := self._after(state, word)) < 0:
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.length[state]
        return after, length + 1

    def hits(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [from, to) that windows cover, merged, and the items with windows there."""
        state = length = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for at, word in enumerate(ids, 1):
            state, length = self.step(state, length, word)
            reach = 0
            if length >= self.window:
                reach = length
                holder = self.holder[state]
                found.add(self.owner[holder])
                found |= self.owners.get(holder, set())
            short = self.nearest[state]
            while short:
                for size, name in self.whole[short]:
                    if size <= length:
                        reach = max(reach, size)
                        found.add(name)
                short = self.nearest[self.link[short]]
            if reach:
                start = at - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))
        return spans, {self.names[k] for k in found}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, broadcast, window: int) -> SuffixAutomaton:
    """A worker holds one block's automaton at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton([(name, words_of(x)) for name, x in broadcast.value], window)
    return _built[key]


def _finds(automaton: SuffixAutomaton, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Of each text: the number of words, the merged spans and the items found."""
    get, least = automaton.vocabulary.get, min(automaton.window, automaton.shortest)
    words = [words_of(x) for x in texts_of(data, off)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids = np.full(starts[-1] + 1, -1, np.int32)
    for start, size, own in zip(starts.tolist(), sizes.tolist(), words):
        ids[start : start + size] = [get(w, -1) for w in own]
    edge = np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8))
    runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in words]
    items: list[set[str]] = [set() for _ in words]
    for k, (a, b) in zip(owner.tolist(), runs.tolist()):
        got, found = automaton.hits(ids[a:b].tolist())
        base = a - int(starts[k])
        spans[k] += [(base + x, base + y) for x, y in got]
        items[k] |= found
    return sizes, [merged(x) for x in spans], items


def _scan(broadcast, window: int, text: str, finish):
    """Every row with what the only block finds in it."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, broadcast, window)
        for part, data, off in steps(batches, text):
            yield finish(part, *_finds(automaton, data, off))

    return run


SPANS = "array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def span_column(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS)


def _hits(broadcast, window: int):
    """(key, spans, items) of the texts in which one of several blocks finds something."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, broadcast, window)
        for part, data, off in steps(batches, "text"):
            _, spans, items = _finds(automaton, data, off)
            hit = [i for i, x in enumerate(spans) if x]
            columns = [part.column("key").take(pa.array(hit, pa.int64())), span_column([spans[i] for i in hit]), pa.array([sorted(items[i]) for i in hit], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "spans", "items"])

    return run


def _finish(text: str, names: tuple[str, str], finish):
    """Every row with what all blocks together found in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in steps(batches, text):
            sizes = np.fromiter((len(words_of(x)) for x in texts_of(data, off)), np.int64, part.num_rows)
            spans = [merged([(x["start"], x["end"]) for x in own or ()]) for own in part.column(names[0]).to_pylist()]
            items = [set(x or ()) for x in part.column(names[1]).to_pylist()]
            yield finish(part.drop_columns(list(names)), sizes, spans, items)

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text") + F.length("item") + 64)).first()[0] or 0
    count = int(-(-total // most)) or 1
    for k in range(count):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(x["item"], bytes(x["text"])) for x in block.collect()]


def scanned(docs: DataFrame, benchmark: DataFrame, finish, schema, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``finish`` of every row, its number of words, its spans of word numbers and its items. With several blocks each passes over the texts on its own, and what they find is brought together by the text's digest."""
    share = docs.sparkSession.sparkContext.broadcast
    blocks = [share(block) for block in _blocks(benchmark, item_id, item_text, block_bytes)]
    if len(blocks) == 1:
        return docs.mapInArrow(_scan(blocks[0], window, text, finish), schema)
    key, spans, items = free_names(docs.columns, "text_key", "spans", "items")
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    keyed = docs.select(digest.alias("key"), F.col(text).alias("text"))
    found = reduce(DataFrame.union, [keyed.mapInArrow(_hits(block, window), f"key string, spans {SPANS}, items array<string>") for block in blocks])
    # Copies of a text find the same, so a set is no larger than what the blocks find in one text.
    own = written(found.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias(spans), F.array_distinct(F.flatten(F.collect_set("items"))).alias(items)), "benchmark-hits")
    both = docs.withColumn(key, digest).join(own.withColumnRenamed("key", key), key, "left").drop(key)
    return both.select(*docs.columns, spans, items).mapInArrow(_finish(text, (spans, items), finish), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted array), spans (array of [from, to) word numbers). Other columns are not read."""

    def finish(part: pa.RecordBatch, sizes: np.ndarray, spans: list, items: list) -> pa.RecordBatch:
        hit = pa.array([sum(b - a for a, b in x) for x in spans], pa.int64())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), hit, pa.array([sorted(x) for x in items], pa.list_(pa.string())), span_column(spans)], ["doc_id", "n_words", "n_hit", "items", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return scanned(rows, benchmark, finish, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans {SPANS}", text="text", **options)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars", max_coverage: float = 0.5, min_span: int = 10, **options) -> DataFrame:
    """The columns of ``docs``. A document of which windows cover more than ``max_coverage`` goes; from the others every
    span of at least ``min_span`` words is cut out, with what stands between its words. ``n_chars`` follows the text."""

    def finish(part: pa.RecordBatch, sizes: np.ndarray, spans: list, items: list) -> pa.RecordBatch:
        keep = [i for i, x in enumerate(spans) if sum(b - a for a, b in x) <= max_coverage * int(sizes[i])]
        at = part.schema.names.index(text)
        texts = part.column(at)
        long = {i: own for i in keep if (own := [x for x in spans[i] if x[1] - x[0] >= min_span])}
        if long:
            texts = texts.to_pylist()
            for i, own in long.items():
                texts[i] = _without(texts[i], own)
            texts = pa.array(texts, part.schema.field(at).type)
        arrays = [texts if i == at else part.column(i) for i in range(part.num_columns)]
        return pa.RecordBatch.from_arrays(arrays, part.schema.names).take(pa.array(keep, pa.int64()))

    out = scanned(docs, benchmark, finish, docs.schema, text=text, **options)
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text).cast(kind if isinstance(kind, T.IntegralType) else "long")))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()
