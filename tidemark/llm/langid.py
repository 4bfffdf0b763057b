"""Language identification with bit-sliced Bloom filters over character n-grams.

Row r of the filter is a bit mask of languages, so the AND of an n-gram's few rows names every language
that contains it. A text's decision counts, per language, the n-grams found there (the popcount of that
language's bit), takes off what the filter's false positives are expected to add, and picks the largest.

An n-gram belongs to a language if its share there is at least ``min_share`` of its largest share in any
language: quotations and mixed pages bring every n-gram into every language sooner or later. The counts
behind this cover all documents with a language outside the held-out fold, summed by Spark. Every member
and every language enters the filter: it has ``ROOM`` rows for each n-gram of the largest language (``ROWS``
at least), and a mask word of 8 bytes a row for each 64 languages. Spark sets the bits and ORs them by row.
A filter of up to ``MAX_WORDS`` mask words is broadcast. A larger one stays a table: the n-grams of all different texts
are counted, each different one is joined to its rows, and the masks to the counts; decisions and scores are the same.

Defined results: null text, and text without a letter, is ``und`` with score 0. Ties go to the language
that sorts first. Rows that repeat a doc_id are decided one by one. With nothing learned all are ``und``. No
documents: no rows. Texts are read whole, whatever their length, some at a time. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, steps, written

#: The least rows of a filter, and the rows for each n-gram of its largest language.
ROWS = 1 << 21
ROOM = 14
HASHES = 3
#: Bits of a mask word, and filter rows fetched at once.
WORD, FETCHED = 64, 1 << 21
#: A larger filter (128 MB) isn't fetched or broadcast.
MAX_WORDS = 1 << 24
ORDERS = (2, 3, 4)
MOD, HELD_OUT = 4, 2


def characters(part: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, lower-cased, runs of other characters than letters as one space, a space around each text; the text of each; letters a text."""
    texts = [(x or "").lower() for x in part.column(column).to_pylist()]
    points = np.frombuffer("".join([f" {x} " for x in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
    kinds = np.unique(points)
    letter = np.fromiter((chr(c).isalpha() for c in kinds.tolist()), bool, len(kinds))[np.searchsorted(kinds, points)]
    points = np.where(letter, points, 32)
    again = np.zeros(len(points), bool)
    again[1:] = ~letter[1:] & ~letter[:-1] & (owner[1:] == owner[:-1])
    return points[~again].astype(np.uint64), owner[~again], np.bincount(owner[letter], minlength=len(texts))


def grams(points: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the n-grams, a code point in 21 bits folded into 64, and the text of each."""
    for n in ORDERS:
        if len(points) < n:
            continue
        end = len(points) - n + 1
        code = np.full(end, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + points[k : k + end] * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        inside = owner[:end] == owner[n - 1 :]
        yield code[inside], owner[:end][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def settle(lang: str) -> None:
        codes, n = totals.get(lang, (np.empty(0, np.uint64), np.empty(0, np.int64)))
        found, more = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        both, at = np.unique(np.concatenate([codes, found]), return_inverse=True)
        totals[lang] = both, np.bincount(at, np.concatenate([n, more])).astype(np.int64)

    for part, _, _ in steps(batches, "text"):
        langs = np.array(part.column("lang").to_pylist(), object)
        points, owner, _ = characters(part)
        for codes, own in grams(points, owner):
            for lang in set(langs):
                waiting.setdefault(lang, []).append(codes[(langs == lang)[own]])
                if sum(map(len, waiting[lang])) > 2_000_000:
                    settle(lang)
        while sum(len(c) for c, _ in totals.values()) > 4_000_000:
            lang = max(totals, key=lambda x: len(totals[x][0]))
            yield from _rows(lang, *totals.pop(lang))
    for lang in list(waiting):
        settle(lang)
    for lang, (codes, n) in totals.items():
        yield from _rows(lang, codes, n)


def _rows(lang: str, codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(codes), 1 << 16):
        own = codes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n[at : at + (1 << 16)])], ["lang", "code", "n"])


def places(codes: np.ndarray, size: int = ROWS) -> list[np.ndarray]:
    """The filter rows of each n-gram, by double hashing."""
    a = codes * np.uint64(0xD6E8FEB86659FD93)
    a ^= a >> np.uint64(32)
    b = (a * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(17) | np.uint64(1)
    return [((a + np.uint64(k) * b) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


def filter_size(most: int) -> int:
    """Filter rows, a power of two, for a largest language of so many n-grams."""
    return max(ROWS, 1 << (ROOM * most - 1).bit_length()) if most else ROWS


def build_filter(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sliced filter of one mask word with language k in bit k, and each language's false positive rate."""
    rows = np.zeros(ROWS, np.uint64)
    for k, codes in enumerate(members):
        for place in places(codes):
            rows[place] |= np.uint64(1 << k)
    fill = np.array([((rows >> np.uint64(k)) & np.uint64(1)).mean() for k in range(len(members))])
    return rows, fill**HASHES


def _bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            k = part.column("k").to_numpy()
            bit = (np.uint64(1) << (k % WORD).astype(np.uint64)).view(np.int64)
            for place in places(part.column("code").to_numpy().view(np.uint64), size):
                yield pa.RecordBatch.from_arrays([pa.array((k // WORD).astype(np.int32)), pa.array(place), pa.array(bit)], ["word", "row", "mask"])

    return run


def filter_masks(members: DataFrame, size: int) -> DataFrame:
    """(word, row, mask) of the filter of (k, code) rows: those rows that have a bit."""
    masks = members.select("k", "code").mapInArrow(_bits(size), "word int, row long, mask long").groupBy("word", "row").agg(F.bit_or("mask").alias("mask"))
    return written(masks, "filter-rows")


def false_positives(masks: DataFrame, languages: int, size: int) -> np.ndarray:
    """The false positive rate of each language."""
    bits = [F.sum(F.shiftrightunsigned("mask", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(WORD)]
    fill = np.zeros(max(1, -(-languages // WORD)) * WORD)
    for r in masks.groupBy("word").agg(*bits).collect():  # a row for each 64 languages
        fill[r["word"] * WORD : (r["word"] + 1) * WORD] = r[1:]
    return (fill[:languages] / size) ** HASHES


def fetched_filter(masks: DataFrame, languages: int, size: int) -> np.ndarray:
    """The filter, one array of rows a mask word."""
    filled = np.zeros((max(1, -(-languages // WORD)), size), np.uint64)
    at_once = max(1, FETCHED // len(filled))
    for at in range(0, size, at_once):
        table = masks.where((F.col("row") >= at) & (F.col("row") < at + at_once)).toArrow()
        filled[table.column("word").to_numpy(), table.column("row").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return filled


def summed_filter(members: DataFrame, languages: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter of (k, code) rows, one array of rows a mask word, and each language's false positive rate."""
    masks = filter_masks(members, size)
    return fetched_filter(masks, languages, size), false_positives(masks, languages, size)


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, code, n) of each text, and one row without a code for its letters."""
    for part, _, _ in steps(batches, "text"):
        keys = np.array(part.column("key").to_pylist(), object)
        points, owner, letters = characters(part)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.nulls(len(keys), pa.int64()), pa.array(letters.astype(np.int64))], ["key", "code", "n"])
        for codes, own in grams(points, owner):
            order = np.lexsort((codes, own))
            codes, own = codes[order], own[order]
            new = np.ones(len(codes), bool)
            new[1:] = (codes[1:] != codes[:-1]) | (own[1:] != own[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(codes)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[own[at]], pa.string()), pa.array(codes[at].view(np.int64)), pa.array(n)], ["key", "code", "n"])


def _code_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for place in places(part.column("code").to_numpy().view(np.uint64), size):
                yield pa.RecordBatch.from_arrays([part.column("code"), pa.array(place)], ["code", "row"])

    return run


def _joined(rows: DataFrame, masks: DataFrame, names: list[str], wrong: np.ndarray, size: int) -> DataFrame:
    """The decisions by joins: an n-gram's languages are the AND of its rows' masks."""
    keyed = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    counts = written(keyed.dropDuplicates(["key"]).select("key", "text").mapInArrow(_text_grams, "key string, code long, n long"), "text-grams")
    own = counts.where("code IS NOT NULL")
    placed = own.select("code").distinct().mapInArrow(_code_rows(size), "code long, row long")
    met = placed.join(masks, "row").groupBy("code", "word").agg(F.count(F.lit(1)).alias("rows"), F.bit_and("mask").alias("mask"))
    met = met.where((F.col("rows") == HASHES) & (F.col("mask") != 0)).drop("rows")
    bits = [F.sum(F.col("n") * F.shiftrightunsigned("mask", k).bitwiseAND(F.lit(1))).cast("double").alias(f"b{k}") for k in range(WORD)]
    found = own.join(met, "code").groupBy("key", "word").agg(*bits)
    texts = counts.groupBy("key").agg(F.sum(F.when(F.col("code").isNull(), F.col("n"))).alias("letters"), F.sum(F.when(F.col("code").isNotNull(), F.col("n")).otherwise(0)).cast("double").alias("total"))
    rates = [F.lit(float(x)) for x in np.append(wrong, np.zeros(-len(wrong) % WORD))]

    def right(k: int, total: Column) -> Column:
        """Of language k of a word."""
        rate = F.element_at(F.array(*rates), F.col("word") * WORD + k + 1)
        return F.struct((F.greatest(F.col(f"b{k}") - rate * total, F.lit(0.0)) / (1 - rate)).alias("right"), (-(F.col("word") * WORD + k)).alias("k"))

    best = found.join(texts, "key").select("key", F.array_max(F.array(*(right(k, F.col("total")) for k in range(min(WORD, len(names)))))).alias("best"))
    best = best.groupBy("key").agg(F.max("best").alias("best"))
    said = texts.join(best, "key", "left")
    first = F.when(F.coalesce(F.col("best.right"), F.lit(0.0)) > 0, -F.col("best.k")).otherwise(0)
    known = F.col("letters") > 0
    score = F.when(known, F.coalesce("best.right", F.lit(0.0)) / F.greatest("total", F.lit(1.0))).otherwise(0.0)
    said = said.select("key", F.when(known, F.element_at(F.array(*map(F.lit, names)), (first + 1).cast("int"))).otherwise("und").alias("lang_pred"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return keyed.select("doc_id", "key").join(said, "key").drop("key")


def _decide(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, filled, wrong = model.value
        for part, _, _ in steps(batches, "text"):
            points, owner, letters = characters(part)
            n = part.num_rows
            found, total = np.zeros((len(names), n)), np.zeros(n)
            for codes, own in grams(points, owner):
                total += np.bincount(own, minlength=n)
                at = places(codes, filled.shape[1])
                for word, rows in enumerate(filled):
                    mask = rows[at[0]]
                    for place in at[1:]:
                        mask = mask & rows[place]
                    some = int(np.bitwise_or.reduce(mask)) if len(mask) else 0
                    for k in range(word * WORD, min(len(names), (word + 1) * WORD)):
                        if some >> (k % WORD) & 1:
                            found[k] += np.bincount(own[(mask >> np.uint64(k % WORD)) & np.uint64(1) > 0], minlength=n)
            known = (letters > 0) & bool(names)
            if names:
                right = np.maximum(found - wrong[:, None] * total, 0) / (1 - wrong[:, None])
                best = right.argmax(axis=0)
                score = np.where(known, right.max(axis=0) / np.maximum(total, 1), 0.0)
            else:
                best, score = np.zeros(n, int), np.zeros(n)
            said = [names[k] if yes else "und" for k, yes in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(said, pa.string()), pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, *, min_share: float = 0.5, min_count: int = 2, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the share of its n-grams that the language has, corrected)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    learned = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", MOD) != HELD_OUT))
    counts = written(learned.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "gram-counts")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("total"))
    tops = shares.groupBy("code").agg(F.max("share").alias("top"))
    members = shares.join(tops, "code").where((F.col("share") >= min_share * F.col("top")) & (F.col("n") >= min_count))
    names = sorted(x["lang"] for x in sizes.collect())
    order = spark.createDataFrame(list(enumerate(names)), "k long, lang string")
    kept = written(members.join(F.broadcast(order), "lang").select("k", "code"), "members")
    most = max((x["count"] for x in kept.groupBy("k").count().collect()), default=0)
    size = filter_size(most)
    masks = filter_masks(kept, size)
    wrong = false_positives(masks, len(names), size)
    if names and size * -(-len(names) // WORD) > max_words:
        found = _joined(rows.select("doc_id", "text"), masks, names, wrong, size)
    else:
        model = spark.sparkContext.broadcast((names, fetched_filter(masks, len(names), size), wrong))
        found = rows.select("doc_id", "text").mapInArrow(_decide(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold("doc_id", MOD) == HELD_OUT).alias("held_out"), "lang_pred", "score")
