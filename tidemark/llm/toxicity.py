"""Toxicity by class-conditional Kneser-Ney models of how words are spelled.

A text is the sequence of its words (runs of letters and digits of any script, lower-cased), and a word is
the sequence of its characters with a space before and after it. Each class has an interpolated Kneser-Ney
model of a character given the ``ORDER - 1`` before it in its word. What a class has seen too rarely backs
off to lower orders that both classes share; these are counted over the vocabulary of the whole corpus: in
how many different words a sequence occurs. The score compares the two log-likelihoods of the whole text,
each divided by its number of characters, so a text's length neither hides nor makes toxicity.

Nothing about the vocabulary or the alphabet is closed: the words of every document, the sequences in them
and their counts are Spark tables that grow with the corpus. Their log-ratios are looked up in a broadcast
table if there are at most ``MAX_BROADCAST`` sequences (12 bytes each); beyond that the words are given
their sums by joins, and the documents theirs by another. Both ways give the same scores.

Learning takes the labelled rows outside the held-out fold (beyond MAX_LABELS a hashed sample of them). A
word counts once a text, and a text's words weigh at most as much as ``FULL_WEIGHT`` words in all, or a few
long texts would set a class's mixture of languages and topics. A fifth of the rows only calibrate.

Defined results: without labels of both classes every score is the same. Null text counts as empty; a text
without words has the log-ratio 0. Rows that repeat a doc_id are scored one by one, and each counts with the
label of that id. Equal texts have equal scores. An empty table gives no rows; columns other than doc_id
and text (and doc_id and the label) are not read. Very long texts are read in pieces that end between words, and
runs of more than ``LONGEST`` letters are cut into words of so many.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, mix, steps, written
from .labelled import MAX_LABELS, id_array, label_arrays, labelled_rows, look_up, platt, sigmoid

ORDER = 4
DISCOUNT = 0.75
#: A text's words together weigh at most so many words, in units of 1 / UNIT.
FULL_WEIGHT, UNIT = 200, 1024
MAX_BROADCAST = 2_000_000
#: Words a task remembers, and characters of a text that are read at once.
REMEMBERED, PIECE = 300_000, 1 << 21
#: A run of more letters (a script without spaces, say) is several words.
LONGEST = 64
MOD, HELD_OUT = 5, 0

WORD, GAP = re.compile(r"[^\W_]+"), re.compile(r"[\W_]")


def spelled(text: str | None) -> Counter[str]:
    """How often each word occurs."""
    counts: Counter[str] = Counter()
    text, at = text or "", 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
        to = gap.end() if gap else len(text)
        counts.update(WORD.findall(text[at:to].lower()))
        at = to
    for word in [w for w in counts if len(w) > LONGEST]:
        n = counts.pop(word)
        for k in range(0, len(word), LONGEST):
            counts[word[k : k + LONGEST]] += n
    return counts


# --- counts ---------------------------------------------------------------------------------------


def _count(known):
    """The distinct words of a task's texts, with the weights that they have in texts of each label."""

    def flush(found: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
        words, weights = list(found), np.array(list(found.values()), np.int64).reshape(-1, 2)
        for at in range(0, len(words), 1 << 16):
            to = at + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(words[at:to], pa.string()), pa.array(weights[at:to, 1]), pa.array(weights[at:to, 0])], ["word", "toxic", "plain"])
        found.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for part, _, _ in steps(batches, "text"):
            labels = look_up(id_array(part.column("doc_id")), known.value).tolist()
            for text, label in zip(part.column("text").to_pylist(), labels):
                words = spelled(text)
                weight = round(UNIT * min(1.0, FULL_WEIGHT / len(words))) if words else 0
                for word in words:
                    own = found.get(word)
                    if own is None:
                        own = found[word] = [0, 0]
                    if label >= 0:
                        own[label] += weight
            if len(found) > REMEMBERED:
                yield from flush(found)
        yield from flush(found)

    return run


def sequences(words: DataFrame) -> DataFrame:
    """(gram, types, toxic, plain): for every character of a word, and the space after it, the sequence of up to ORDER characters that ends there."""
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(2), F.length("word") + 2), lambda j: F.substring(padded, F.greatest(F.lit(1), j - (ORDER - 1)), F.least(j, F.lit(ORDER))))
    rows = words.select(F.explode(grams).alias("gram"), "toxic", "plain")
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("types"), *((F.sum(c) / UNIT).alias(c) for c in ("toxic", "plain")))


def _history(gram: str) -> Column:
    return F.expr(f"left({gram}, length({gram}) - 1)")


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(gram, shared): the probability of the last character of each sequence of less than ORDER ones, from the numbers of words they occur in; a word's first sequences are of the order of their length."""
    symbols = grams.agg(F.countDistinct(F.right("gram", F.lit(1)))).first()[0]
    below, levels = None, []
    for k in range(1, ORDER):
        own = grams.where(F.length("gram") >= k).groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.sum("types").alias("n")).withColumn("history", _history("gram"))
        totals = own.groupBy("history").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        both = own.join(totals, "history")
        if below is None:
            both = both.withColumn("lower", F.lit(1.0 / max(1, symbols)))
        else:
            both = both.withColumn("suffix", F.right("gram", F.lit(k - 1))).join(below.select(F.col("gram").alias("suffix"), F.col("shared").alias("lower")), "suffix")
        below = both.select("gram", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("lower")) / F.col("total")).alias("shared"))
        levels.append(below)
    return reduce(DataFrame.union, levels)


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio): log P(last character | those before it, toxic) - log P(the same, plain)."""
    shared = shared_backoff(grams).select(F.col("gram").alias("suffix"), "shared")
    placed = grams.withColumns({"suffix": F.right("gram", F.lit(ORDER - 1)), "history": _history("gram")})
    sums = [x for c in ("toxic", "plain") for x in (F.sum(c).alias(f"all_{c}"), F.sum(F.least(F.col(c), F.lit(DISCOUNT))).alias(f"freed_{c}"))]
    both = placed.join(placed.groupBy("history").agg(*sums), "history").join(shared, "suffix")

    def log_p(c: str) -> Column:
        own = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + F.col(f"freed_{c}") * F.col("shared")) / F.col(f"all_{c}")
        return F.log(F.when(F.col(f"all_{c}") > 0, own).otherwise(F.col("shared")))

    return both.select("gram", (log_p("toxic") - log_p("plain")).alias("ratio"))


# --- scores ---------------------------------------------------------------------------------------


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the sequences of all words one after another, and where each word's begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes  # each word's space before it
    at = np.arange(1, len(points))
    first = np.repeat(starts, sizes)
    code = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        inside = at - k >= first
        own = np.where(inside, points[np.maximum(at - k, 0)] + np.uint64(1), np.uint64(0))
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + own)
    return code, starts


def code_table(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of (gram, ratio) rows, and their ratios."""
    grams, ratio = table.column("gram").to_pylist(), table.column("ratio").to_numpy().astype(np.float64)
    if not grams:
        return np.empty(0, np.uint64), np.empty(0)
    # The sequence is what the code at its last character covers; the characters before it begin a "word" of it.
    points = np.frombuffer("".join(g.rjust(ORDER, "\0") for g in grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER).astype(np.uint64)
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    code = np.zeros(len(grams), np.uint64)
    for k in range(ORDER):
        own = np.where(sizes > k, points[:, ORDER - 1 - k] + np.uint64(1), np.uint64(0))
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + own)
    order = np.argsort(code)
    if len(np.unique(code)) != len(code):
        raise ValueError("two sequences have one code")
    return code[order], ratio[order]


class WordRatios(dict):
    """Remembers the summed log-ratio of words."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        self.keys_, self.ratio = table

    def learn(self, words: list[str]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        words = [w for w in words if w not in self]
        if not words or not len(self.keys_):
            self.update(dict.fromkeys(words, 0.0))
            return
        code, starts = codes(words)
        at = np.minimum(np.searchsorted(self.keys_, code), len(self.keys_) - 1)
        self.update(zip(words, np.add.reduceat(np.where(self.keys_[at] == code, self.ratio[at], 0.0), starts).tolist()))


_remembered: dict[str, WordRatios] = {}


def _score(table):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _remembered:
            _remembered.clear()
            _remembered[key] = WordRatios(table.value)
        ratio = _remembered[key]
        for part, _, _ in steps(batches, "text"):
            out = np.zeros(part.num_rows)
            for i, text in enumerate(part.column("text").to_pylist()):
                words = spelled(text)
                if words:
                    ratio.learn(list(words))
                    out[i] = sum(n * ratio[w] for w, n in words.items()) / sum(n * (len(w) + 1) for w, n in words.items())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out)], ["doc_id", "x"])

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, _ in steps(batches, "text"):
        for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
            words = spelled(text)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["key", "word", "n"])


def _joined(rows: DataFrame, words: DataFrame, ratios: DataFrame) -> DataFrame:
    """The scores by joins: sums of each word, then of each different text."""
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(2), F.length("word") + 2), lambda j: F.substring(padded, F.greatest(F.lit(1), j - (ORDER - 1)), F.least(j, F.lit(ORDER))))
    of_word = words.select("word", F.explode(grams).alias("gram")).join(ratios, "gram").groupBy("word").agg(F.sum("ratio").alias("ratio"))
    keyed = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = keyed.dropDuplicates(["key"]).select("key", "text").mapInArrow(_occurrences, "key string, word string, n long")
    sums = found.join(of_word, "word").groupBy("key").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum(F.col("n") * (F.length("word") + 1))).alias("x"))
    return keyed.join(sums, "key", "left").select("doc_id", F.coalesce("x", F.lit(0.0)).alias("x"))


def toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_labels: int = MAX_LABELS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per document: doc_id, held_out, log_ratio (a character), score, predicted."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = written(labelled_rows(labels, label, mod=MOD, held_out=HELD_OUT, most=max_labels), "toxic-labels")
    calibrates = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    sample = label_arrays(known.where(~calibrates))
    both = len(np.unique(sample[1])) == 2
    counted = rows.mapInArrow(_count(spark.sparkContext.broadcast(sample)), "word string, toxic long, plain long")
    words = written(counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")), "toxic-words")
    grams = written(sequences(words), "toxic-sequences")
    ratios = written(log_ratios(grams), "toxic-ratios")
    if not both:
        ratios = ratios.withColumn("ratio", F.lit(0.0))
    if ratios.count() <= max_broadcast:
        scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(code_table(ratios.toArrow()))), "doc_id long, x double")
    else:
        scored = _joined(rows, words, ratios)
    scored = written(scored, "toxic-scores")
    slope, intercept = platt(scored.join(known.where(calibrates), "doc_id"))
    score = sigmoid(F.lit(slope) * F.col("x") + F.lit(intercept))
    return scored.select("doc_id", (fold("doc_id", MOD) == HELD_OUT).alias("held_out"), F.col("x").alias("log_ratio"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
