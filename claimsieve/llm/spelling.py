"""Spelling variants: words one edit apart, found with a bit-sliced position index.

Two words one edit apart agree before the edit and after it, so they share the first half of the shorter one's
letters or its last half. Each such half, with the length of the shorter word, names a group; a word is in four
groups: as the shorter and as the longer word, by its start and by its end. A pair counts in one group only: by its start
if both halves agree.

The words of neighbouring groups form a block of about ``BLOCK`` words. Its index has one bitset over the block's words
for each (position, letter). A query word goes through its letters once and tracks, for all words of the block
at a time, the set without an error and three sets with one: a letter replaced (same position), one more in
the query (position shifted down) or one less (shifted up). Several queries of one length go together, as rows of a matrix.

Groups of more than ``BLOCK`` words are dealt out: each part indexes its share and is asked by all words of the group. What
leaves a block is one row per word: the number of its near words and the best of them, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import UPPER, text_or_empty
from claimsieve.operators.layout import reliable

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(UPPER, UPPER.lower())
SLIP = 97
LEAST_LETTERS, LEAST_TIMES = 5, 3
BLOCK = 2_048
WIDE = 32  # letters; blocks of longer words have fewer words
QUERIES = 256
HELD = 400_000
BOTH, INDEXED, ASKING = range(3)


def slipped(run: str, crc: int) -> str:
    """The run without one letter, for one draw in ``SLIP``: slips that a corpus is given on purpose."""
    if crc % SLIP:
        return run
    i = crc % len(run)
    return run[:i] + run[i + 1 :]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, with the slips that crc32 of ``doc_id:run`` draws.

    Tasks add up what they see and pass on at most ``HELD`` words at a time. A null text has no words; a null doc_id is
    drawn for as an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(RUN.findall(text.as_py().translate(LOWER))).items():
                    word = slipped(run, zlib.crc32(run.encode(), start))
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) > HELD:
                    yield rows()
        yield rows()

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")
    found = docs.select(key, text_or_empty(docs).alias("text")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


class Block:
    """The bit-sliced index of some words: 64 of them in a machine word."""

    def __init__(self, words: list[str]) -> None:
        self.n = len(words)
        self.lengths = np.fromiter(map(len, words), dtype=np.int64, count=self.n)
        width = int(self.lengths.max())
        codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(self.n, width)
        letters, numbers = np.unique(codes, return_inverse=True)
        self.number = {chr(c): i for i, c in enumerate(letters.tolist()) if c}
        numbers = numbers.reshape(self.n, width)
        self.longs = -(-self.n // 64)
        # place 0 is before every word and the last two are behind it: no letter is there
        self.bits = np.zeros((width + 3, len(letters) + 1, self.longs), dtype=np.uint64)
        self.of_length = np.zeros((width + 4, self.longs), dtype=np.uint64)
        for lane in range(min(64, self.n)):  # one word of each machine word at a time
            rows = np.arange(lane, self.n, 64)
            bit = np.uint64(1 << lane)
            self.bits[np.arange(width) + 1, numbers[rows], (rows // 64)[:, None]] |= np.where(codes[rows] != 0, bit, np.uint64(0))
            self.of_length[self.lengths[rows], rows // 64] |= bit
        self.width, self.nowhere = width, len(letters)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): numbers of all pairs one edit apart; the queries have one length."""
        length = len(queries[0])
        number, nowhere, end = self.number, self.nowhere, self.width + 2
        letters = np.array([[number.get(c, nowhere) for c in q] for q in queries])
        zero = np.full((len(queries), self.longs), ~np.uint64(0))
        replaced, longer, shorter = (np.zeros_like(zero) for _ in range(3))
        for i in range(length):
            here = self.bits[min(i + 1, end), letters[:, i]]
            down, up = self.bits[min(i, end), letters[:, i]], self.bits[min(i + 2, end), letters[:, i]]
            replaced = (replaced & here) | (zero & ~here)
            longer = (longer & down) | zero  # the query's letter is the one too many
            shorter = (shorter | zero) & up  # the word has one letter more before the query's
            zero = zero & here
        sizes = [self.of_length[k] if k < len(self.of_length) else np.uint64(0) for k in (length, length - 1, length + 1)]
        hit = (replaced & sizes[0]) | (longer & sizes[1]) | ((shorter | zero) & sizes[2])
        return np.nonzero(np.unpackbits(hit.view(np.uint8), axis=-1, bitorder="little"))


def one_pair_once(a: np.ndarray, b: np.ndarray, shorter: np.ndarray, by_end: np.ndarray) -> np.ndarray:
    """Which pairs (arrays of words a, b) count in a group: one of the two is as long as the group's shorter word, and a
    group by the end takes only pairs whose starts differ."""
    out = np.zeros(len(a), dtype=bool)
    for i, (x, y, n, end) in enumerate(zip(a, b, shorter.tolist(), by_end.tolist(), strict=True)):
        half = n // 2
        out[i] = min(len(x), len(y)) == n and not (end and x[:half] == y[:half])
    return out


def keyed(words: DataFrame) -> DataFrame:
    """(key, shorter, by_end, word, n): a row for each of a word's groups."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("shorter")).filter(F.col("shorter") >= LEAST_LETTERS)
    half = F.floor(F.col("shorter") / 2).cast("int")
    start = F.struct(F.lit(False).alias("by_end"), F.substring("word", F.lit(1), half).alias("part"))
    end = F.struct(F.lit(True).alias("by_end"), F.substring("word", half - F.col("shorter"), F.col("shorter") - half).alias("part"))
    rows = rows.select("word", "n", "shorter", F.explode(F.array(start, end)).alias("g"))
    return rows.select(F.xxhash64("shorter", "g.by_end", "g.part").alias("key"), "shorter", "g.by_end", "word", "n")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best): per word with near words how many there are and the one of largest n (ties: smallest
    in code-point order); a word may have several rows, whose counts add up."""
    rows = keyed(words)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    sizes = sizes.select(F.col("key").alias("s_key"), F.ceil(F.col("size") / block).alias("parts"))
    rows = rows.join(sizes, F.col("key") == F.col("s_key"))
    own = F.pmod(F.xxhash64("word"), F.col("parts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    shares = F.transform(every, lambda p: F.struct(p.alias("part"), F.when(F.col("parts") == 1, BOTH).otherwise(ASKING).alias("role")))
    indexed = F.array(F.struct(own.alias("part"), F.lit(INDEXED).alias("role")))
    shares = F.when(F.col("parts") == 1, shares).otherwise(F.concat(indexed, shares))
    rows = rows.select("key", "shorter", "by_end", "word", "n", F.explode(shares).alias("s"))
    rows = rows.select("key", F.col("s.part").alias("part"), F.col("s.role").alias("role"), "shorter", "by_end", "word", "n")
    dealt = rows.repartition("key", "part").sortWithinPartitions("shorter", "key", "part", "role")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in blocks(batches, block):
            yield best_of(group)

    return dealt.mapInArrow(search, "word string, n_near bigint, best_n bigint, best string")


def blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(indexed, asking) rows: whole groups up to about a block's size, or one part of a large group with some of the
    words that ask it. Groups are never cut on their indexed side."""
    held: list[pa.RecordBatch] = []  # whole groups and the beginning of the last one

    def starts(table: pa.Table) -> np.ndarray:
        keys, parts = table.column("key").to_numpy(), table.column("part").to_numpy()
        return np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1

    def sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        role = table.column("role").to_numpy()
        return table.filter(pa.array(role != ASKING)), table.filter(pa.array(role != INDEXED))

    def ready(table: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
        """Blocks of whole groups."""
        ends, low = [*starts(table).tolist(), table.num_rows], 0
        letters = table.column("shorter").to_numpy() + 1
        for this, after in zip(ends, [*ends[1:], None], strict=True):
            if after is None or (after - low) * max(1.0, letters[after - 1] / WIDE) > block:
                yield sides(table.slice(low, this - low))
                low = this

    rows, index = 0, None  # index: the indexed side of a large group whose asking words still come
    for batch in batches:
        if not batch.num_rows:
            continue
        if index is not None:
            table = pa.Table.from_batches([batch])
            same = (table.column("key").to_numpy() == index[0]) & (table.column("part").to_numpy() == index[1])
            n = int(same.sum())  # sorted: the group's rows come first
            if n:
                yield index[2], sides(table.slice(0, n))[1]
            if n == table.num_rows:
                continue
            index, batch = None, batch.slice(n)
        held.append(batch)
        rows += batch.num_rows
        if rows < 4 * block:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ends = starts(table)
        last = int(ends[-1]) if len(ends) else 0
        if last:
            yield from ready(table.slice(0, last))
        rest = table.slice(last)
        if rest.num_rows > 2 * block and rest.column("role")[-1].as_py() == ASKING:  # a part of a large group, whose indexed words all came first
            indexed, asking = sides(rest)
            yield indexed, asking
            index = (rest.column("key")[0].as_py(), rest.column("part")[0].as_py(), indexed)
            held, rows = [], 0
        else:
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield from ready(pa.Table.from_batches(held).combine_chunks())


def best_of(sides: tuple[pa.Table, pa.Table]) -> pa.RecordBatch:
    indexed, asking = sides
    names = ["word", "n_near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    if not indexed.num_rows or not asking.num_rows:
        return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)
    words = np.array(indexed.column("word").to_pylist(), dtype=object)
    times, keys = indexed.column("n").to_numpy(), indexed.column("key").to_numpy()
    queries = np.array(asking.column("word").to_pylist(), dtype=object)
    asked, shorter, by_end = (asking.column(c).to_numpy() for c in ("key", "shorter", "by_end"))
    index = Block(words.tolist())
    lengths = np.fromiter(map(len, queries), dtype=np.int64, count=len(queries))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for low in range(0, len(rows), QUERIES):
            some = rows[low : low + QUERIES]
            q, w = index.near(queries[some].tolist())
            found.append((some[q], w))
    q, w = (np.concatenate(x) for x in zip(*found, strict=True))
    same = asked[q] == keys[w]  # other groups of the block find their pairs themselves
    q, w = q[same], w[same]
    once = one_pair_once(queries[q], words[w], shorter[q], by_end[q])
    q, w = q[once], w[once]
    out: dict[int, list] = {}
    for a, b in zip(q.tolist(), w.tolist(), strict=True):
        n, word = int(times[b]), words[b]
        best = out.get(a)
        if best is None:
            out[a] = [1, n, word]
        else:
            best[0] += 1
            if n > best[1] or (n == best[1] and word < best[2]):
                best[1:] = n, word
    columns = [[queries[a] for a in out], *([best[i] for best in out.values()] for i in range(3))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last word that following forms reaches, by doubling the steps.

    Each form is at least twice as frequent as its word, so chains are as short as the logarithm of a count.
    """
    hops = reliable(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = hops.select(F.col("word").alias("a_word"), F.col("root").alias("a_root"))
        joined = hops.join(ahead, F.col("root") == F.col("a_word"), "left")
        joined = reliable(joined.select("word", F.coalesce("a_root", "root").alias("root"), F.col("a_root").isNotNull().alias("moved")))
        hops = joined.select("word", "root")
        if not joined.filter("moved").take(1):
            return hops


def spelling_variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of ``docs``, see :func:`word_counts`.

    ``form`` is the near word of largest n if that is at least twice the word's n. Documents without text, repeated rows
    and null ids take part like others (a repeated row counts again); other columns are not read.
    """
    words = reliable(word_counts(docs))
    near = near_words(words, block).groupBy(F.col("word").alias("k_word")).agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    )
    rows = words.join(near, F.col("word") == F.col("k_word"), "left")
    has_form = -F.col("b.minus") >= 2 * F.col("n")
    form_n = F.when(has_form, -F.col("b.minus"))
    rows = rows.select("word", F.when(has_form, F.col("b.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form_n.alias("form_n"))
    rows = reliable(rows)
    last = roots(rows).withColumnsRenamed({"word": "r_word", "root": "r_root"})
    rows = rows.join(last, F.col("word") == F.col("r_word"), "left")
    return rows.select("word", "form", F.coalesce("r_root", "word").alias("root"), "n", "n_near", "form_n")
