"""SentencePiece encoding and decoding by a max-plus scan.

The pieces that occur in a text are the nodes of a lattice. A step from a piece to the next one weighs 0 or the
score of the next piece, or minus infinity where it is not allowed; the encoding is the heaviest path. For a unigram
model every step is allowed and weighs its score. For a merge (BPE) model a step is allowed if merging the two
pieces' letters gives just these two pieces; exactly one path is then finite, and it is what merging the
whole text gives.

A long document is cut into chunks. A chunk that starts inside a word does not know which piece crosses its
edge, so it computes the weights from every possible piece at its left edge to every one at its right edge. These
matrices are combined associatively, which fixes the piece at each edge, and then every chunk finds its own pieces.
Where a word starts, no piece can cross, and the matrix has a single entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from claimsieve.llm.common import null_safe, text_or_empty
from claimsieve.operators.layout import reliable

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
GAP = "▁"
START, UNKNOWN = -2, -3
LONG_WORD = 40
CACHE = 1 << 20  # letters of words kept, and as many of those kept before
SPINES = 8_000
STEPS = 50_000
BASE = 0x100000001B3
NONE = -np.inf


class PieceModel:
    """Pieces, scores and allowed steps. Small (one model file), so it travels with the task."""

    def __init__(self, data: bytes) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation keep the text, as a round trip needs")
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with byte pieces can write every text")
        self.merges = proto.trainer_spec.model_type == 2
        self.prefix = norm.add_dummy_prefix
        self.surface = [p.piece for p in proto.pieces]
        self.score = np.array([p.score for p in proto.pieces])
        kinds = [p.type for p in proto.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.ids = {s: i for i, s in enumerate(self.surface) if kinds[i] == 1}
        if any(GAP in s.lstrip(GAP) for s in self.ids):
            raise ValueError("a piece goes on after a word's end; words are then no unit")
        self.unknown_score = float(self.score.min()) - 10.0
        self.spines: dict[int, tuple[list, list]] = {}
        self.ranks = {s: -float(self.score[i]) for s, i in self.ids.items()}
        if self.merges:
            for s in [*self.ids]:
                tree = self.merge_tree(s)
                if tree is None:
                    del self.ids[s], self.ranks[s]
        self.longest = max(map(len, self.ids))
        newline = "" if "\n" in self.ids else "\n"
        self.words = re.compile(f"{newline}|{GAP}*[^{GAP}{newline}]+|{GAP}+" if newline else f"{GAP}*[^{GAP}]+|{GAP}+")
        self.step_keys = np.zeros(1 << 20, dtype=np.int64)  # the steps seen lately, one a cell
        self.step_weights = np.zeros(1 << 20)
        self.allowed_memo: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = 0  # of the words in ``cache``
        self.table()

    # ---- allowed steps --------------------------------------------------------------------------

    def rank(self, s: str) -> float:
        """The place of a piece in the order of merges; infinite for a string that is none."""
        return self.ranks.get(s, np.inf)

    def merge_tree(self, s: str) -> tuple[list, list] | None:
        """What stands at the left and the right end of a piece while its letters are merged.

        Each entry is (string, rank at which it is merged into a longer one). None if merging gives other pieces.
        """
        parts, left, right = list(s), [], []
        while len(parts) > 1:
            ranks = [self.rank(a + b) for a, b in pairwise(parts)]
            best = int(np.argmin(ranks))
            if ranks[best] == np.inf:
                return None
            if best == 0:
                left.append((parts[0], ranks[best]))
            if best == len(parts) - 2:
                right.append((parts[-1], ranks[best]))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [*left, (s, np.inf)], [*right, (s, np.inf)]

    def allowed(self, a: int, b: int) -> bool:
        """Whether merging the letters of two neighbouring pieces leaves both as they are.

        A merge across them happens if an end of the first and a start of the second exist together and their
        merge comes before either grows; of equal merges the left one comes first.
        """
        if not self.merges or a < 0 or b < 0:
            return True
        key = a << 32 | b
        known = self.allowed_memo.get(key)
        if known is None:
            known = self.stays(self.spine(a)[1], self.spine(b)[0])
            if len(self.allowed_memo) > STEPS:
                self.allowed_memo.clear()
            self.allowed_memo[key] = known
        return known

    def stays(self, right: list, left: list) -> bool:
        """Whether no end of one piece and start of the next one are merged."""
        find = self.ranks.get
        for x, x_from, x_until in right:
            for y, y_from, y_until in left:
                r = find(x + y)
                if r is not None and r < x_until and r <= y_until and self.together(x_from, y_from, x_until, y_until):
                    return False
        return True

    def spine(self, piece: int) -> tuple[list, list]:
        """:meth:`merge_tree` of a piece, :func:`timed`; those asked for lately are kept."""
        found = self.spines.get(piece)
        if found is None:
            if len(self.spines) >= SPINES:
                self.spines.clear()
            left, right = self.merge_tree(self.surface[piece])
            found = self.spines[piece] = list(timed(left)), list(timed(right))
        return found

    @staticmethod
    def together(x_from: float, y_from: float, x_until: float, y_until: float) -> bool:
        return max(x_from, y_from) <= min(x_until, y_until)

    # ---- lookup of substrings by hash ---------------------------------------------------------------

    def table(self) -> None:
        names = [*self.ids]
        self.hash_of = np.array([self.hash(s) for s in names], dtype=np.uint64)
        self.id_of = np.array([self.ids[s] for s in names], dtype=np.int64)
        self.lengths = np.array([len(s) for s in self.surface])
        if len(np.unique(self.hash_of)) != len(names):
            raise ValueError("two pieces have one hash")
        self.tables, left, factor = [], np.arange(len(names)), 0x9E3779B97F4A7C15
        while len(left):  # what finds its cell taken goes to the next table; two or three are enough
            cells = np.full(1 << 19, -1, dtype=np.int32)
            at = (self.hash_of[left] * np.uint64(factor)) >> np.uint64(45)
            cells[at] = left
            self.tables.append((np.uint64(factor), cells))
            left = left[cells[at] != left]
            factor = (factor * 0xD1342543DE82EF95 + 2) & 0xFFFFFFFFFFFFFFFF | 1

    @staticmethod
    def hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * BASE + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = None
        for factor, cells in self.tables:
            at = cells[(hashes * factor) >> np.uint64(45)]
            taken = np.flatnonzero(at >= 0)  # behind an empty cell nothing went to the next table
            at, hashes = at[taken], hashes[taken]
            left = taken if left is None else left[taken]
            hit = self.hash_of[at] == hashes
            out[left[hit]] = self.id_of[at[hit]]
            left, hashes = left[~hit], hashes[~hit]
            if not len(left):
                break
        return out

    # ---- words ------------------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The pieces of many short words at once: the max-plus recurrence with one word a row."""
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = codes.reshape(n, width).astype(np.uint64)
        total = np.zeros((n, width + 1), dtype=np.uint64)
        for i in range(width):
            total[:, i + 1] = total[:, i] * np.uint64(BASE) + codes[:, i]
        powers = [np.uint64(pow(BASE, k, 1 << 64)) for k in range(self.longest + 1)]
        last = np.full((n, width + 1), -1, dtype=np.int64)
        last[:, 0] = START
        weight = np.full((n, width + 1), NONE)
        weight[:, 0] = 0.0
        for i in range(1, width + 1):
            waiting = np.flatnonzero(size >= i)
            for k in range(min(i, self.longest), 0, -1):
                rows = waiting[weight[waiting, i - k] > NONE]
                if not len(rows):
                    continue
                piece = self.find(total[rows, i] - total[rows, i - k] * powers[k])
                if k == 1:
                    piece = np.where(piece < 0, UNKNOWN, piece)
                else:
                    hit = piece >= 0
                    rows, piece = rows[hit], piece[hit]
                if not len(rows):
                    continue
                before = last[rows, i - k]
                step = self.steps(before, piece)
                new = weight[rows, i - k] + step
                better = (new > NONE) & (new >= weight[rows, i])  # of equal ones the shortest piece, as met last
                rows, piece, new = rows[better], piece[better], new[better]
                weight[rows, i] = new
                last[rows, i] = piece
                if self.merges and len(rows):  # one path to a place is finite, so the others need no look
                    waiting = waiting[weight[waiting, i] == NONE]
        return self.paths(words, size, last)

    def paths(self, words: list[str], size: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Walk back from the end of every word, one piece of each word at a time."""
        n, at, taken = len(words), size.copy(), []
        while at.any():
            here = np.where(at > 0, last[np.arange(n), at], -1)
            taken.append(here)
            at -= np.where(at > 0, np.where(here >= 0, self.lengths[here], 1), 0)
        table = np.array(taken[::-1], dtype=np.int32).T
        used = table != -1
        ends = np.cumsum(used.sum(axis=1)) * 4
        flat = table[used].tobytes()
        out = [flat[a:b] for a, b in pairwise([0, *ends.tolist()])]
        for row in np.flatnonzero((table == UNKNOWN).any(axis=1)):
            path, i = [], 0
            for piece in table[row][used[row]].tolist():
                path.append(piece if piece >= 0 else words[row][i])
                i += int(self.lengths[piece]) if piece >= 0 else 1
            out[row] = self.written(path)
        return out

    def steps(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        if not self.merges:
            return np.where(piece >= 0, self.score[piece], self.unknown_score)
        keys = (before + 8) * (1 << 32) + piece + 8
        cell = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self.step_keys[cell] != keys)
        for i in new[np.unique(keys[new], return_index=True)[1]].tolist():
            self.step_keys[cell[i]] = keys[i]
            self.step_weights[cell[i]] = 0.0 if self.allowed(int(before[i]), int(piece[i])) else NONE
        out = self.step_weights[cell]
        for i in np.flatnonzero(self.step_keys[cell] != keys):  # two steps of one cell
            out[i] = 0.0 if self.allowed(int(before[i]), int(piece[i])) else NONE
        return out

    def written(self, path: list) -> bytes:
        """Ids of a path; an unknown letter by its bytes."""
        ids = []
        for p in path:
            ids.extend([p] if isinstance(p, int) else [self.byte_id[b] for b in p.encode("utf-8", "replace")])
        return np.array(ids, dtype=np.int32).tobytes()

    def encode_normal(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in normal form, each starting and ending where a word does."""
        pieces = [self.words.findall(t) for t in texts]
        if self.letters > CACHE:  # words not met since the last time are forgotten
            self.cache, self.older, self.letters = {}, self.cache, 0
        cache, older, long, unknown = self.cache, self.older, {}, []
        for w in set().union(*pieces).difference(cache):
            if len(w) > LONG_WORD:  # never kept: such a word may be a whole text
                long[w] = self.backtrace(w, "", "", START, START)
                continue
            self.letters += len(w)
            if w in older:
                cache[w] = older[w]
            else:
                unknown.append(w)
        unknown.sort(key=len)
        for low in range(0, len(unknown), 8_192):
            part = unknown[low : low + 8_192]
            cache.update(zip(part, self.encode_words(part), strict=True))
        cache.update(long)
        out = [b"".join(map(cache.__getitem__, words)) for words in pieces]
        for w in long:
            del cache[w]
        return out

    # ---- chunks that start or end inside a word ------------------------------------------------------

    def scan(self, text: str, left: str, right: str, entry: int | None, hard_right: bool):
        """Nodes (end, piece, start) with the weight from each entry, and the step before.

        ``entry`` None: every piece across the left edge; START: a word starts there.
        """
        whole, at, end = left + text + right, len(left), len(left) + len(text)
        limit = len(whole) if hard_right else end
        nodes: dict[int, dict[tuple, dict[int, tuple[float, tuple | None]]]] = {}

        def piece_at(a: int, b: int):
            found = self.ids.get(whole[a:b])
            return UNKNOWN if found is None and b == a + 1 else found

        if entry == START:
            nodes[at] = {(START, at): {START: (0.0, None)}}
        else:
            for a in range(max(0, at - self.longest), at):
                for b in range(at, min(limit, a + self.longest) + 1):
                    state = (at - a) * 64 + (b - at)
                    if entry in (None, state) and (p := piece_at(a, b)) is not None:
                        nodes.setdefault(b, {})[p, a] = {state: (0.0, None)}
        for i in range(at, end):
            here = nodes.get(i)
            if not here:
                continue
            for k in range(1, min(self.longest, limit - i) + 1):
                p = piece_at(i, i + k)
                if p is None:
                    continue
                cost = 0.0 if self.merges else self.score[p] if p >= 0 else self.unknown_score
                target = nodes.setdefault(i + k, {}).setdefault((p, i), {})
                for key, origins in here.items():
                    if self.allowed(key[0], p):
                        for origin, (w, _) in origins.items():
                            if origin not in target or w + cost > target[origin][0]:
                                target[origin] = (w + cost, key)
        return nodes, at, end

    def transfer(self, text: str, left: str, right: str, soft_left: bool, soft_right: bool) -> list[tuple[int, int, float]]:
        """The matrix of a chunk: (entry, exit, weight) of all finite entries."""
        nodes, _, end = self.scan(text, left, right, START if soft_left else None, not soft_right)
        best: dict[tuple[int, int], float] = {}
        for b in range(end, end + self.longest + 1):
            for (_, a), origins in nodes.get(b, {}).items():
                if a < end and (b == end or not soft_right):
                    state = START if soft_right else (end - a) * 64 + (b - end)
                    for origin, (w, _) in origins.items():
                        best[origin, state] = max(w, best.get((origin, state), NONE))
        return [(i, o, w) for (i, o), w in best.items()]

    def backtrace(self, text: str, left: str, right: str, entry: int, exit_: int) -> bytes:
        """Ids of the pieces that start in a chunk, given the pieces at its edges."""
        nodes, at, end = self.scan(text, left, right, entry, exit_ != START)
        whole = left + text + right
        if exit_ == START:
            b, ends = end, {k: o for k, o in nodes.get(end, {}).items()}
        else:
            a, b = end - exit_ // 64, end + exit_ % 64
            ends = {k: o for k, o in nodes.get(b, {}).items() if k[1] == a}
        key = max((k for k in ends if entry in ends[k]), key=lambda k: ends[k][entry][0])
        path = []
        while key is not None and key[0] != START and key[1] >= at:
            path.append(key[0] if key[0] >= 0 else whole[key[1]])
            before = nodes[b][key][entry][1]
            b, key = key[1], before
        return self.written(path[::-1])

    # ---- texts --------------------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        text = text.replace(" ", GAP)
        return GAP + text if self.prefix and text else text

    def cuts(self, text: str, size: int = CHUNK) -> list[tuple[int, int, bool]]:
        """(start, end, whether a word starts at the end): chunks of at most ``size`` letters of a normal text."""
        out, start = [], 0
        while len(text) - start > size:
            end = start + size
            word = text.rfind(GAP, start + 1, end + 1)
            while word > start and text[word - 1] == GAP:
                word -= 1
            soft = word > start
            end = word if soft else end
            out.append((start, end, soft))
            start = end
        return [*out, (start, len(text), True)]


def timed(spine: list) -> Iterator[tuple[str, float, float]]:
    """(string, rank from which it is there, rank at which it grows)."""
    since = -np.inf
    for s, until in spine:
        yield s, since, until
        since = max(since, until)


LOADED: dict[bytes, PieceModel] = {}


def pieces_of(model: bytes) -> PieceModel:
    """The model, with the words it has seen: kept by a worker from task to task."""
    if model not in LOADED:
        LOADED.clear()
        LOADED[model] = PieceModel(model)
    return LOADED[model]


class PieceBytes:
    """What writes ids as text again, without what encoding needs."""

    def __init__(self, model: bytes) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(GAP, " ").encode() for p in proto.pieces]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)
def bytes_of(model: bytes) -> PieceBytes:
    """Kept by a worker from task to task."""
    return PieceBytes(model)


def load(path: str = MODEL) -> bytes:
    """The model file's bytes, read by the driver: a vocabulary, so of bounded size."""
    return SentencePieceProcessor(model_file=path).serialized_model_proto()


def list_array(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(b) // 4 for b in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def slices(batch: pa.RecordBatch, column: int, letters: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many letters of text each."""
    start, size = 0, 0
    for i, text in enumerate(batch.column(column)):
        size += len(text.as_buffer() or b"")
        if size > letters:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, model: bytes, chunk: int = CHUNK, spelled: bool = False) -> DataFrame:
    """(doc_id, check, token_ids array<int>): one row per row of ``docs``; ``check`` is the hash of the text.

    With ``spelled`` also text, which the ids spell: written by the worker that made them, so that a task has one.

    A null text counts as empty and has no ids. Texts of up to ``chunk`` letters are encoded where they are read;
    longer ones are cut into chunks that Spark deals out. The ids are the same for every chunk size. A
    literal U+2581 is written like a space. Rows that repeat in full give equal rows.
    """
    rows = docs.select("doc_id", F.xxhash64(text_or_empty(docs)).alias("check"), text_or_empty(docs).alias("text"))
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in (part for whole in batches for part in slices(whole, 2, 600_000)):
            ids = pieces.encode_normal([pieces.normal(t) for t in batch.column(2).to_pylist()])
            columns = {"doc_id": batch.column(0), "check": batch.column(1), "token_ids": list_array(ids)}
            if spelled:
                decode_one = bytes_of(model).decode
                columns["text"] = pa.array([decode_one(np.frombuffer(b, dtype=np.int32)) for b in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {key_type}, check bigint, token_ids array<int>" + ", text string" * spelled
    short = rows.filter(F.char_length("text") <= chunk).mapInArrow(whole, schema)
    long = encode_long(rows.filter(F.char_length("text") > chunk), model, chunk, key_type)
    return short.unionByName(decode(long, model, [*long.columns]) if spelled else long)


def encode_long(rows: DataFrame, model: bytes, chunk: int, key_type: str) -> DataFrame:
    columns = ["doc_id", "check", "nth", "run", "hard", "soft_left", "soft_right", "left", "text", "right"]
    kind = f"doc_id {key_type}, check bigint, nth int, run int, hard boolean, soft_left boolean, soft_right boolean, left string, text string, right string"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model)
        for frame in frames:
            for doc_id, check, text in frame.itertuples(index=False):
                text = pieces.normal(text)
                out, soft_left, run = [], True, 0
                for nth, (a, b, soft) in enumerate(pieces.cuts(text, chunk)):
                    out.append(
                        (doc_id, check, nth, run, not (soft and soft_left), soft_left, soft,
                         "" if soft_left else text[max(0, a - pieces.longest) : a], text[a:b], "" if soft else text[b : b + pieces.longest])
                    )
                    soft_left = soft
                    run += soft
                yield pd.DataFrame(out, columns=columns)

    # distinct: rows that repeat in full have the same chunks, and get their ids once each by the join below
    chunks = rows.dropDuplicates(["doc_id", "check"]).mapInPandas(cut, kind)
    chunks = reliable(chunks.repartition("doc_id", "check", "nth"))
    keys = ["doc_id", "check", "run"]

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model)
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                for i, o, w in pieces.transfer(r.text, r.left, r.right, r.soft_left, r.soft_right):
                    out.append((r.doc_id, r.check, r.run, r.nth, i, o, w))
            yield pd.DataFrame(out, columns=[*keys, "nth", "entry", "exit", "weight"])

    hard = chunks.filter("hard").mapInPandas(matrices, f"doc_id {key_type}, check bigint, run int, nth int, entry int, exit int, weight double")
    edges = hard.groupBy(*keys).applyInPandas(combine, f"doc_id {key_type}, check bigint, run int, nth int, entry int, exit int")
    edges = edges.select(*[F.col(c).alias(f"e_{c}") for c in ("doc_id", "check", "nth")], "entry", "exit")
    known = chunks.join(edges, null_safe(chunks, edges, [(c, f"e_{c}") for c in ("doc_id", "check", "nth")]), "left")
    known = known.select("doc_id", "check", "nth", "left", "text", "right", "entry", "exit")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            ids = []
            for r in batch.to_pylist():
                soft = r["entry"] is None
                ids.append(pieces.encode_normal([r["text"]])[0] if soft else pieces.backtrace(r["text"], r["left"], r["right"], r["entry"], r["exit"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), list_array(ids)], names=["doc_id", "check", "nth", "ids"])

    parts = known.mapInArrow(trace, f"doc_id {key_type}, check bigint, nth int, ids array<int>")
    parts = parts.groupBy(F.col("doc_id").alias("p_id"), F.col("check").alias("p_check")).agg(F.array_sort(F.collect_list(F.struct("nth", "ids"))).alias("parts"))
    every = rows.select("doc_id", "check")
    joined = every.join(parts, null_safe(every, parts, [("doc_id", "p_id"), ("check", "p_check")]))
    return joined.select("doc_id", "check", F.flatten("parts.ids").alias("token_ids"))


def combine(frame: pd.DataFrame) -> pd.DataFrame:
    """The piece at each edge of a run of chunks: products of the matrices from the left and from the right meet there."""
    steps = [part for _, part in sorted(frame.groupby("nth"), key=lambda x: x[0])]
    forward: list[dict[int, float]] = [{START: 0.0}]
    for part in steps:
        after: dict[int, float] = {}
        for i, o, w in zip(part.entry, part.exit, part.weight, strict=True):
            if i in forward[-1]:
                after[o] = max(after.get(o, NONE), forward[-1][i] + w)
        forward.append(after)
    backward: list[dict[int, float]] = [{START: 0.0}]
    for part in reversed(steps):
        before: dict[int, float] = {}
        for i, o, w in zip(part.entry, part.exit, part.weight, strict=True):
            if o in backward[-1]:
                before[i] = max(before.get(i, NONE), backward[-1][o] + w)
        backward.append(before)
    backward.reverse()
    edge = [max((s for s in f if s in b), key=lambda s: (f[s] + b[s], s)) for f, b in zip(forward, backward, strict=True)]
    out = frame.groupby("nth", as_index=False).first()[["doc_id", "check", "run", "nth"]].sort_values("nth")
    return out.assign(entry=edge[:-1], exit=edge[1:])


def decode(tokens: DataFrame, model: bytes, columns: list[str]) -> DataFrame:
    """``columns`` and text: the text that token_ids spell. Each row by itself."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*columns).schema.fields)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = bytes_of(model)
        for batch in batches:
            texts = [pieces.decode(np.asarray(x.values)) for x in batch.column(batch.num_columns - 1)]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*columns, "text"])

    return tokens.select(*columns, F.col("token_ids").alias("to_spell")).mapInArrow(spell, f"{kinds}, text string")


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_hash, round_trip): encoded, decoded, and compared with the text by its hash."""
    model = load(path)
    tokens = encode(docs, model, spelled=True)
    n_tokens, same = F.size("token_ids").cast("long"), F.xxhash64("text") == F.col("check")
    return tokens.select("doc_id", n_tokens.alias("n_tokens"), F.xxhash64("token_ids").alias("ids_hash"), same.alias("round_trip"))


def with_digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, token_ids, n_tokens) of every row of ``docs``."""
    return encode(docs, load(path)).select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))
