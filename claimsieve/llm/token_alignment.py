"""Alignment of two tokenizers: groups of tokens between shared cuts, and links between overlapping tokens.

A shared cut is a byte place where a token of either tokenizer ends. Cuts are found by divide and conquer. In a region
between two known cuts, bisect gives the tokens of both sides at the middle, and the ends of one side are looked up among
those of the other, each time leaping to the later one, until both agree: the first cut right of the middle. If there is
none, the same goes leftwards. The region falls into the halves beside the cut, without the part just seen to be
empty; a region without a cut is a leaf, its tokens are one group. All regions of a level, of all documents of a
batch, are searched together.

Links are the pairs of tokens whose bytes overlap. How often a pair of ids is linked in the whole corpus needs all
documents: they are encoded once and their ids written to the shared folder; pairs are added up inside the tasks and
then by Spark. The counts of at most ``KNOWN`` pairs, the most frequent ones, go to all tasks; the links of rarer
pairs are joined with their counts by Spark, so the result is the same for every bound.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
from tokenizers import Tokenizer

from claimsieve.llm.common import text_or_empty
from claimsieve.llm.sentence_pieces import slices
from claimsieve.llm.token_counts import byte_of_sign, classes_in, compiled, piece_starts
from claimsieve.operators.layout import reliable, shared_folder

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GAP = "▁"
UNITS = re.compile(" +[^ ]*")
WORDS, LONG_WORD = 150_000, 48
LETTERS = 300_000  # of the texts that are handled together
KNOWN = 1_000_000
HELD = 1_000_000
BUCKETS = 16  # of pair counts for each power of two


class TokenizerPair:
    """Both tokenizers, the bytes of their tokens, and what writes their ids."""

    def __init__(self, files: tuple[bytes, bytes, bytes]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        byte_file, tables, piece_file = files
        self.a = Tokenizer.from_str(byte_file.decode())
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.classes = classes_in(tables)
        self.b = SentencePieceProcessor(model_proto=piece_file)
        sign, vocab = byte_of_sign(), self.a.get_vocab(with_added_tokens=True)
        self.a_raw = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.a_raw[i] = bytes(sign[c] for c in s) if all(c in sign for c in s) else s.encode()
        self.b_raw = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in raw], dtype=np.int64) for raw in (self.a_raw, self.b_raw))
        # the text of an id with the sign after it: next token of its side, end of the first side, end of the group, last of all
        most = max(len(self.a_raw), len(self.b_raw))
        self.written = [f"{i}{sign}".encode() for i in range(most) for sign in (",", "|", ";", "")]
        self.a_words = Words(lambda words: (e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)))
        self.b_words = Words(lambda words: self.b.encode([w[1:] for w in words], num_threads=1))
        self.b_words.keep(" ", [self.b.piece_to_id(GAP)])  # the library has nothing for no letters
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(piece_file)
        norm, pieces = proto.normalizer_spec, [p.piece for p in proto.pieces if p.type == 1]
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("the second tokenizer must keep the text and add a space")
        if not proto.trainer_spec.byte_fallback or any(GAP in s.lstrip(GAP) for s in pieces):
            raise ValueError("the second tokenizer must have byte pieces, and none that goes on after a word's end")

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) else piece.replace(GAP, " ").encode()

    def forget(self) -> None:
        """Let go of the words: steps that only look at ids do not need them."""
        self.a_words.drop()
        self.b_words.drop()

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts by the library; what it splits a text into is encoded once and kept."""
        split = []
        for text in texts:
            places = np.flatnonzero(piece_starts(text, self.classes)).tolist()
            split.append([text[x:y] for x, y in pairwise(places)])
        return self.a_words.ids(split)

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts by the library, which no piece lets go on from the end of a word into the gap behind it."""
        split = [UNITS.findall(" " + text) for text in texts]
        return self.b_words.ids(split)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where a text is empty or holds a literal gap sign, which the second side would spell as a
        space. All other texts are spelled byte by byte, see ``__init__``; the lengths are checked."""
        texts = ["" if GAP in t else t for t in texts]
        a, b = self.encode_a([" " + t if t else "" for t in texts]), self.encode_b(texts)
        none = np.empty(0, dtype=np.int32)
        for i, text in enumerate(texts):
            size = 1 + len(text.encode("utf-8", "replace"))
            if not text or self.a_size[a[i]].sum() != size or self.b_size[b[i]].sum() != size:
                a[i] = b[i] = none
        return a, b


class Words(dict):
    """Ids of words as bytes. When there are too many, those not met since the last time are forgotten."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.older, self.kept = encode, {}, {}

    def keep(self, word: str, ids: list[int]) -> None:
        """A word that is never forgotten."""
        self[word] = self.kept[word] = array("i", ids).tobytes()

    def drop(self) -> None:
        """Forget all words but those to keep."""
        self.older = {}
        self.clear()
        self.update(self.kept)

    def ids(self, split: list[list[str]]) -> list[np.ndarray]:
        """The ids of texts from those of their words; unknown words are encoded together."""
        if len(self) > WORDS:
            seen = dict(self)
            self.drop()
            self.older = seen
        older, missing, fresh = self.older, [], {}
        for w in set().union(*split).difference(self):
            if w in older:
                self[w] = older[w]
            else:
                missing.append(w)
        if missing:
            fresh = dict(zip(missing, (array("i", ids).tobytes() for ids in self.encode(missing)), strict=True))
            self.update(fresh)
        out = [np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.int32) for words in split]
        for w in missing:
            if len(w) > LONG_WORD:
                del self[w]
        return out


LOADED: dict[tuple[bytes, bytes, bytes], TokenizerPair] = {}


def pair_of(files: tuple[bytes, bytes, bytes]) -> TokenizerPair:
    """The tokenizers, kept by a worker from task to task."""
    if files not in LOADED:
        LOADED.clear()
        LOADED[files] = TokenizerPair(files)
    return LOADED[files]


def load(byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> tuple[bytes, bytes, bytes]:
    """The bytes of both files and the table of character classes, read by the driver: of bounded size."""
    return Path(byte_model).read_bytes(), compiled(byte_model), Path(piece_model).read_bytes()


# ---- cuts, groups and links of a batch -------------------------------------------------------------------------


def leap(x: np.ndarray, y: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, up: bool) -> np.ndarray:
    """The nearest common value of two sorted arrays from each place ``at`` upwards (or downwards) inside (low, high); -1 if
    there is none. Both arrays hold a value from which the search ends."""

    def seek(values: np.ndarray, place: np.ndarray) -> np.ndarray:
        if up:
            return values[np.minimum(np.searchsorted(values, place), len(values) - 1)]
        return values[np.maximum(np.searchsorted(values, place, side="right") - 1, 0)]

    out = np.full(len(at), -1, dtype=np.int64)
    live = np.arange(len(at))
    p = seek(x, at)
    while len(live):
        q = seek(y, p)
        inside = (q < high[live]) if up else (q > low[live])
        same = (p == q) & inside
        out[live[same]] = p[same]
        goes_on = inside & ~same
        live, q = live[goes_on], q[goes_on]
        p = seek(x, q)
        inside = (p < high[live]) if up else (p > low[live])
        same = (p == q) & inside
        out[live[same]] = p[same]
        goes_on = inside & ~same
        live, p = live[goes_on], p[goes_on]
    return out


def shared_cuts(a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The common values of two sorted arrays of token ends, by divide and conquer between known ones (``edges``)."""
    a, b = (np.concatenate([edges[:1], x]) for x in (a, b))  # so that a search to the left ends
    found = [edges[1:]]
    low, high = edges[:-1], edges[1:]
    while len(low):
        wide = high - low > 1
        low, high = low[wide], high[wide]
        middle = (low + high) // 2
        right = leap(a, b, middle, low, high, True)
        left = np.full(len(low), -1, dtype=np.int64)
        lost = np.flatnonzero(right < 0)
        left[lost] = leap(a, b, middle[lost] - 1, low[lost], high[lost], False)
        found += [right[right >= 0], left[left >= 0]]
        hit, back = right >= 0, left >= 0
        # right of the middle a region goes on behind its cut; what lies between the middle and the cut is empty
        kept = np.stack([hit | back, hit], axis=1)
        ends = np.stack([np.where(hit, middle, left), high], axis=1)
        low, high = np.stack([low, right], axis=1)[kept], ends[kept]  # in text order, which bisect likes
    return np.sort(np.concatenate(found))


class Batch:
    """The tokens of some documents, laid end to end."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], pair: TokenizerPair) -> None:
        self.n = len(a)
        self.n_a, self.n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
        self.a, self.b = (np.concatenate([*side, np.empty(0, dtype=np.int32)]) for side in (a, b))
        self.a_ends, self.b_ends = np.cumsum(pair.a_size[self.a]), np.cumsum(pair.b_size[self.b])
        self.pair = pair
        #: Where each document ends, in tokens and in bytes.
        self.a_last, self.b_last = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.ends = np.concatenate([[0], self.a_ends])[self.a_last]

    def cuts(self) -> np.ndarray:
        edges = np.unique(np.concatenate([[0], self.ends]))
        return shared_cuts(self.a_ends, self.b_ends, edges) if len(edges) > 1 else np.empty(0, dtype=np.int64)

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(behind its last token of the first side, of the second side, number of its document) for every group."""
        cuts = self.cuts()
        of_doc = np.searchsorted(self.ends, cuts)
        return np.searchsorted(self.a_ends, cuts, side="right"), np.searchsorted(self.b_ends, cuts, side="right"), of_doc

    def written(self) -> tuple[np.ndarray, list[bytes]]:
        """Per document the number of groups and the text ``a1,a2|b1;a3|b2,b3``."""
        a_to, b_to, of_doc = self.groups()
        n_groups = np.bincount(of_doc, minlength=self.n)
        sign_a, sign_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        sign_a[a_to - 1], sign_b[b_to - 1] = 1, 2
        sign_b[self.b_last[self.n_b > 0] - 1] = 3
        # a token stands behind those of its side and those of the other side in the groups before (and in its own)
        a_from, b_from = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (a_to, b_to))
        place_a = np.arange(len(self.a)) + np.repeat(b_from, a_to - a_from)
        place_b = np.arange(len(self.b)) + np.repeat(a_to, b_to - b_from)
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        order[place_a], order[place_b] = 4 * self.a.astype(np.int64) + sign_a, 4 * self.b.astype(np.int64) + sign_b
        table, ends = self.pair.written, [0, *(self.a_last + self.b_last).tolist()]
        return n_groups, [b"".join(map(table.__getitem__, order[x:y].tolist())) for x, y in pairwise(ends)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(id pair, number of the document) of every link: between two neighbouring ends of either side lies one."""
        ends = np.sort(np.concatenate([self.a_ends, self.b_ends]), kind="stable")  # merges the two runs
        ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
        a, b = self.a[np.searchsorted(self.a_ends, ends)], self.b[np.searchsorted(self.b_ends, ends)]
        return a.astype(np.int64) * len(self.pair.b_raw) + b, np.searchsorted(self.ends, ends)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, dtype=np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def lists(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat, kind))


def id_bytes(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids as values of four bytes an id, one for each row."""
    offsets = 4 * np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype("<i4"))])


# ---- Spark jobs --------------------------------------------------------------------------------------------


def alignments(docs: DataFrame, files: tuple[bytes, bytes, bytes]) -> DataFrame:
    """(doc_id, groups): one row per row of ``docs``, groups an array of (a array<int>, b array<int>) in text order.

    A null or empty text, or one that a side does not spell byte by byte, has no groups. Other columns are not read.
    """
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        for part in (part for whole in batches for part in slices(whole, 1, LETTERS)):
            batch = Batch(*pair.encode(part.column(1).to_pylist()), pair)
            a_to, b_to, of_doc = batch.groups()
            sides = [lists(batch.a, a_to, pa.int32()), lists(batch.b, b_to, pa.int32())]
            groups = pa.StructArray.from_arrays(sides, ["a", "b"])
            ends = np.cumsum(np.bincount(of_doc, minlength=batch.n))
            groups = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), groups)
            yield pa.RecordBatch.from_arrays([part.column(0), groups], names=["doc_id", "groups"])

    rows = docs.select("doc_id", text_or_empty(docs).alias("text"))
    return rows.mapInArrow(align, f"doc_id {key_type}, groups array<struct<a: array<int>, b: array<int>>>")


def encoded(docs: DataFrame, files: tuple[bytes, bytes, bytes]) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, a, b): the ids of both sides, written once.

    ``a`` and ``b`` are four bytes an id, one value a row: as arrays they took a multiple of that in the JVM, which lays
    out levels and items one by one. ``row`` tells rows apart, also those that repeat.
    """
    key_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b"]
    kind = f"doc_id {key_type}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, a binary, b binary"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        for part in (part for whole in batches for part in slices(whole, 1, LETTERS)):
            batch = Batch(*pair.encode(part.column(1).to_pylist()), pair)
            n_groups, texts = batch.written()
            numbers = [pa.array(x, pa.int64()) for x in (batch.n_a, batch.n_b, n_groups)]
            digests = pa.array([sha256(x).hexdigest() if x else "" for x in texts], pa.string())
            ids = [id_bytes(batch.a, batch.a_last), id_bytes(batch.b, batch.b_last)]
            yield pa.RecordBatch.from_arrays([part.column(0), *numbers, digests, *ids], names=names)

    rows = docs.select("doc_id", text_or_empty(docs).alias("text")).mapInArrow(align, kind)
    path = shared_folder(docs.sparkSession, "tokens")
    rows.select(F.monotonically_increasing_id().alias("row"), "*").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def batch_of(part: pa.RecordBatch, a: int, b: int, pair: TokenizerPair) -> Batch:
    sides = [[np.frombuffer(x.as_buffer(), dtype="<i4") for x in part.column(i)] for i in (a, b)]
    return Batch(*sides, pair)


def token_slices(batch: pa.RecordBatch, a: int, tokens: int = 150_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many tokens each."""
    start, size = 0, 0
    for i, length in enumerate(pc.binary_length(batch.column(a)).to_pylist()):
        size += length // 4
        if size > tokens:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def pair_counts(tokens: DataFrame, files: tuple[bytes, bytes, bytes]) -> DataFrame:
    """(pair, n, best): how many links hold a pair of ids, and whether no other pair of its second id has more.

    A task adds up what it sees and passes on at most ``HELD`` pairs at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        pair.forget()
        keys, times, waiting = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), []

        def added() -> tuple[np.ndarray, np.ndarray]:
            both = np.concatenate([keys, *(k for k, _ in waiting)])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([times, *(n for _, n in waiting)])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, dtype=np.int64)
            waiting.clear()
            return both[first], np.add.reduceat(n, first) if len(first) else n

        for part in (part for whole in batches for part in token_slices(whole, 0)):
            waiting.append(counted(batch_of(part, 0, 1, pair).links()[0]))
            if sum(len(k) for k, _ in waiting) > HELD // 2:
                keys, times = added()
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_pydict({"pair": keys, "n": times})
                    keys, times = keys[:0], times[:0]
        keys, times = added()
        yield pa.RecordBatch.from_pydict({"pair": keys, "n": times})

    found = tokens.select("a", "b").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    size = len(pair_of(files).b_raw)
    found = reliable(found)
    most = found.groupBy(F.pmod("pair", F.lit(size)).alias("m_b")).agg(F.max("n").alias("most"))
    found = found.join(F.broadcast(most), F.pmod("pair", F.lit(size)) == F.col("m_b"))  # a row per id of the second tokenizer
    return reliable(found.select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def bucket(n):
    return F.floor(F.log2(n) * BUCKETS)


def known_pairs(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of the largest counts, at most ``most``, and the others."""
    sizes = sorted((r.k, r.rows) for r in counts.groupBy(bucket("n").alias("k")).agg(F.count(F.lit(1)).alias("rows")).collect())
    total, least = 0, 1 << 20
    for k, rows in reversed(sizes):
        total += rows
        if total > most:
            break
        least = k
    return counts.filter(bucket("n") >= least), counts.filter(bucket("n") < least)


def alignment_digest(docs: DataFrame, files: tuple[bytes, bytes, bytes], known: int = KNOWN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row of ``docs``.

    A null or empty text, or one that a side does not spell byte by byte, has no tokens: zeros and ''. Rows that repeat
    are rows of their own and count as often; a null doc_id stays; other columns are not read.
    """
    tokens = encoded(docs, files)
    counts = pair_counts(tokens, files)
    frequent, rare = known_pairs(counts, known)
    table = frequent.orderBy("pair").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(
        (table.pair.to_numpy(dtype=np.int64), table.n.to_numpy(dtype=np.int64), table.best.to_numpy(dtype=bool))
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        pair.forget()
        keys, times, best = shared.value
        for part in (part for whole in batches for part in token_slices(whole, 1, LETTERS)):
            batch = batch_of(part, 1, 2, pair)
            links, of_doc = batch.links()
            at = np.minimum(np.searchsorted(keys, links), max(0, len(keys) - 1))
            hit = keys[at] == links if len(keys) else np.zeros(len(links), dtype=bool)
            doc, at = of_doc[hit], at[hit]
            sums = np.zeros((3, batch.n), dtype=np.int64)
            sums[0] = np.bincount(of_doc, minlength=batch.n)
            np.add.at(sums[1], doc, best[at])
            np.add.at(sums[2], doc, times[at])
            pairs = len(pair.a_raw) * len(pair.b_raw)
            missing, n = counted(of_doc[~hit] * pairs + links[~hit])
            ends = np.searchsorted(missing // pairs, np.arange(batch.n), side="right")
            fields = pa.StructArray.from_arrays([pa.array(missing % pairs, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), fields)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in sums), left], names=["row", "n_links", "n_best", "count_sum", "rest"])

    kind = "row bigint, n_links bigint, n_best bigint, count_sum bigint, rest array<struct<pair: bigint, n: bigint>>"
    found = reliable(tokens.select("row", "a", "b").mapInArrow(look_up, kind))
    rest = found.select(F.col("row").alias("t_row"), F.explode("rest").alias("t"))
    rest = rest.select("t_row", F.col("t.pair").alias("t_pair"), F.col("t.n").alias("times"))
    rest = rest.join(rare, F.col("t_pair") == F.col("pair")).groupBy("t_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("t_best"), F.sum(F.col("times") * F.col("n")).alias("t_sum")
    )
    sums = found.join(rest, F.col("row") == F.col("t_row"), "left").select(
        F.col("row").alias("f_row"), "n_links", (F.col("n_best") + F.coalesce("t_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("t_sum", F.lit(0))).alias("count_sum"),
    )
    head = tokens.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    out = head.join(sums, F.col("row") == F.col("f_row"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
