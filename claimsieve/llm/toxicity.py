"""Toxicity by noisy-channel deobfuscation.

A disguised word is seen as a clean word that went through a channel: letters became look-alike signs, were
repeated, or were pulled apart by signs and spaces. The likeliest clean word is found by Viterbi search over the
lattice of possible letters, under a letter trigram model counted over all texts. The restored words are then scored
by a lexicon of words and word beginnings learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import remainder, text_or_empty
from claimsieve.llm.labels import labelled_sample, row_weight, times
from claimsieve.operators.layout import reliable

SLOTS = 1 << 18  # of the letter model: a fixed size, whatever the input
ROWS_PER_CLASS = 10_000
LEXICON = 3_000
MIN_PLACES = 4  # different words before it, at least, that a lexicon entry needs in toxic rows
THRESHOLD = 0.5
MODULUS, HELD_OUT = 5, 0
CACHE = 300_000
#: Sign: letters it may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
FILLERS = "._-*~'`·,:/\\^=#%&"
DISGUISE, FILL, STRETCH = 2.5, 1.5, 1.0  # channel costs in nats
EDGE = ".,;:!?\"'()[]{}<>«»“”¿¡*#%&$~_-|+=/\\^`·"
SPACED = re.compile(r"(?<!\S)(?:\w[ ._*-]{1,2}){2,24}\w(?![^\W_])")
ODD = re.compile(r"[0-9@$!|+(€£¡._*~'`·,:/\\^=#%&-]|([^\W\d_])\1\1")
LETTER = re.compile(r"[^\W\d_]")


def slots_of(text: str) -> np.ndarray:
    """The slot of each letter trigram; words are padded, all other signs count as the edge of a word."""
    codes = np.frombuffer(("  " + text.lower() + " ").encode("utf-32-le"), dtype=np.uint32)
    return trigram_slots(codes)


def trigram_slots(codes: np.ndarray) -> np.ndarray:
    low = codes < 128
    edge = (low & ~((codes >= 97) & (codes <= 122))) | ((codes >= 0x2000) & (codes < 0x2070))
    codes = np.where(edge, np.uint32(32), codes).astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed * np.uint64(5) + codes[2:]) * np.uint64(0x165667B19E3779F9)
    return (mixed >> np.uint64(46)).astype(np.int64)


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts, in ``SLOTS`` cells. Each task adds up its texts; cells are summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(cells, slots_of(text.as_py()), 1)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"cell": used, "n": cells[used]})

    cells = docs.select(text_or_empty(docs)).mapInArrow(count, "cell bigint, n bigint")
    total = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, dtype=np.int64)
    out[total.cell.to_numpy(dtype=np.int64)] = total.n.to_numpy(dtype=np.int64)
    return out


class Restorer:
    """Viterbi decoding of one word under the letter model."""

    def __init__(self, cells: np.ndarray) -> None:
        self.logs = np.log(cells + 0.05) - math.log(float(cells.sum()) + 1.0)
        self.known: dict[str, float] = {}

    def letter_cost(self, context: str, letter: str) -> float:
        """-log p(letter | two letters before), by the joint over the pair's total of likely continuations."""
        key = context + letter
        cost = self.known.get(key)
        if cost is None:
            codes = np.array([ord(c) for c in key], dtype=np.uint32)
            joint = self.logs[trigram_slots(codes)[0]]
            every = "abcdefghijklmnopqrstuvwxyz "
            table = np.array([[ord(context[0]), ord(context[1]), ord(c)] for c in every + ("" if letter in every else letter)], dtype=np.uint32)
            whole = np.logaddexp.reduce([self.logs[trigram_slots(row)[0]] for row in table])
            cost = self.known[key] = float(whole - joint)
            if len(self.known) > 500_000:
                self.known.clear()
        return cost

    def restore(self, word: str) -> str:
        """The likeliest clean form of a word. States are the last two letters and the last sign read."""
        best: dict[tuple[str, str], tuple[float, str]] = {("  ", ""): (0.0, "")}
        for sign in word:
            after: dict[tuple[str, str], tuple[float, str]] = {}

            def offer(state: tuple[str, str], cost: float, text: str) -> None:
                if state not in after or cost < after[state][0]:
                    after[state] = (cost, text)

            letters = [(sign, 0.0)] if LETTER.match(sign) else []
            letters += [(c, DISGUISE) for c in LOOKALIKES.get(sign, "")]
            for (context, last), (cost, text) in best.items():
                if sign in FILLERS or not letters:
                    offer((context, last), cost + FILL, text)
                for c, price in letters:
                    offer((context[1] + c, c), cost + price + self.letter_cost(context, c), text + c)
                    if c == last:
                        offer((context, last), cost + price + STRETCH, text)
            best = dict(sorted(after.items(), key=lambda x: x[1][0])[:64])
        ends = [(cost + self.letter_cost(context, " "), text) for (context, _), (cost, text) in best.items()]
        return min(ends)[1] if ends else word


def words_of(text: str) -> list[str]:
    return text.lower().split()


def restored(text: str, restorer: Restorer, cache: dict[str, str]) -> list[str]:
    """Words of a text, disguised ones restored, and the words that single letters spell."""
    out = []
    for word in words_of(text):
        clean = cache.get(word)
        if clean is None:
            clean = word.strip(EDGE)
            if len(clean) <= 64 and LETTER.search(clean) and ODD.search(clean):
                clean = restorer.restore(clean)
            if len(cache) >= CACHE:
                cache.clear()
            cache[word] = clean
        out.append(clean)
    for m in SPACED.finditer(text.lower()):
        spelt = restorer.restore(re.sub(r"[\W_]", "", m[0]))
        out += [spelt, spelt[1:], spelt[:-1]]  # the first or last letter may be a word of its own
    return out


def entries_of(word: str) -> list[str]:
    """The lexicon entries that a word may match: itself and its beginnings of four to six letters."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)] if word else []


def lexicon(
    sample: DataFrame, cells: np.ndarray, stands_for: dict[int, float], entries: int = LEXICON, min_places: int = MIN_PLACES
) -> dict[str, float]:
    """Entries that mark toxic rows, with their log odds: at most ``entries``.

    A row of a label stands for ``stands_for`` rows, so places are carried on to those that all rows would fill. An entry counts once per different word before it (in 64 cells), so a row that was copied, exactly or
    nearly, a thousand times adds no more than one row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, cache = Restorer(cells), {}
        seen: dict[tuple[str, int], int] = {}

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"entry": [k for k, _ in seen], "label": [v for _, v in seen], "places": np.array(list(seen.values()), dtype=np.uint64).view(np.int64)},
                schema=pa.schema([("entry", pa.string()), ("label", pa.int32()), ("places", pa.int64())]),
            )

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                before, value = "", label.as_py()
                for word in restored(text.as_py(), restorer, cache):
                    bit = 1 << (xxhash.xxh3_64_intdigest(before) & 63)
                    for entry in entries_of(word):
                        seen[entry, value] = seen.get((entry, value), 0) | bit
                    before = word
            if len(seen) > 2_000_000:
                yield table()
                seen.clear()
        yield table()

    counted = sample.select("text", "label").repartition(8, "text").mapInArrow(count, "entry string, label int, places bigint")
    toxic = F.bit_count(F.coalesce(F.bit_or(F.when(F.col("label") == 1, F.col("places"))), F.lit(0)))
    clean = F.bit_count(F.coalesce(F.bit_or(F.when(F.col("label") == 0, F.col("places"))), F.lit(0)))
    counted = counted.groupBy("entry").agg(toxic.alias("t"), clean.alias("c"))
    t, c = (64 * (1 - F.pow(1 - F.col(n) / 64, F.lit(stands_for[v]))) for n, v in (("t", 1), ("c", 0)))
    odds = F.log((t + 0.5) / (c + 0.5))
    kept = counted.filter(F.col("t") >= min_places).withColumn("odds", odds).filter("odds >= 1.5")
    return {r.entry: r.odds for r in kept.orderBy(F.desc("odds"), "entry").limit(entries).collect()}


FEATURES = ["best", "total", "hits"]


def marks(docs: DataFrame, cells: np.ndarray, words: dict[str, float], columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with best, total and hits: the weights of the different lexicon entries in a text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, cache, weight = Restorer(cells), {}, {}

        def weight_of(word: str) -> tuple[float, str]:
            found = weight.get(word)
            if found is None:
                if len(weight) >= CACHE:
                    weight.clear()
                found = weight[word] = max(((words.get(e, 0.0), e) for e in entries_of(word)), default=(0.0, ""))
            return found

        for batch in batches:
            best, total, hits = [], [], []
            for text in batch.column(batch.num_columns - 1):
                found = {weight_of(w) for w in set(restored(text.as_py(), restorer, cache))}
                values = [v for v, _ in found if v > 0.0]
                best.append(max(values, default=0.0))
                total.append(min(sum(values), 40.0))
                hits.append(float(min(len(values), 10)))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array(hits, pa.float64())],
                names=[*columns, *FEATURES],
            )

    rows = docs.select(*columns, text_or_empty(docs).alias("text_of_row"))
    return rows.mapInArrow(mark, f"{schema}, best double, total double, hits double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS):
    """(letter model, lexicon, bias and weights). The letter model is counted over all texts, the rest is fitted on at
    most ``rows_per_class`` rows of each label outside the held-out remainder, weighted by the rows they stand for."""
    cells = letter_counts(docs)
    sample, whole = labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, rows_per_class)
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = (whole.get(1, 0) + 1) / (sum(whole.values()) + 2)
        return cells, {}, (math.log(share / (1 - share)), [0.0] * len(FEATURES))
    stands_for = times(whole, counts)
    words = lexicon(sample, cells, stands_for)
    table = marks(sample.repartition(8, "text"), cells, words, ["label"])
    table = reliable(table)
    table = table.withColumn("weight", row_weight(stands_for))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    fitted = LogisticRegression(labelCol="label", weightCol="weight", regParam=0.002, standardization=False, maxIter=60).fit(vectors)
    return cells, words, (float(fitted.intercept), [float(w) for w in fitted.coefficients.toArray()])


def scored(docs: DataFrame, model) -> DataFrame:
    """``docs`` without text, with held_out, score and predicted.

    Null and empty texts are scored as an empty text, a null doc_id is never held out. Columns of ``docs``
    that carry the names of the added columns are replaced.
    """
    cells, words, (bias, weights) = model
    own = ("held_out", "score", "predicted", *FEATURES)
    rest = [c for c in docs.columns if c not in own and c != "text"]
    names = [f"column_{i}" for i in range(len(rest))]
    hidden = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(rest, names, strict=True)], docs["text"].alias("text"))
    rows = marks(hidden, cells, words, names)
    margin = F.lit(bias)
    for name, weight in zip(FEATURES, weights, strict=True):
        margin = margin + weight * F.col(name)
    score = 1.0 / (1.0 + F.exp(-margin))
    held_out = F.coalesce(remainder(F.col(names[rest.index("doc_id")]), MODULUS) == HELD_OUT, F.lit(False))
    return rows.select(
        *[F.col(n).alias(c) for c, n in zip(rest, names, strict=True)], held_out.alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"), "hits"
    )
