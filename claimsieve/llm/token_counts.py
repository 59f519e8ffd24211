"""Token counts by a tokenizer compiled into a finite-state transducer.

Two machines are compiled from the tokenizer file.

- The splitter has one class for every code point (letter, digit, other sign, white space), read off the tokenizer itself.
  Whether a piece starts at a place follows from the four characters before and the three from there on, so
  all places of a text are decided at once.
- The transducer reads the bytes of a piece. The tokens of every prefix of a piece are known from pairs of tokens
  that may stand side by side: a prefix has exactly one sequence of tokens all of whose neighbours may. A state
  holds, for every place where a token may still be growing, the node of the growing token in the tree of
  tokens, the token before it and the number of tokens up to there. Its transition on a byte is deterministic and is
  annotated with the number of tokens that the byte adds (negative where tokens merge). States are made when first
  met and forgotten when they are too many, which changes no count.

A document of more than ``CHUNK`` characters is cut into chunks anywhere, inside words as well. A chunk gives a state map:
for every state in which it may be entered, the state in which it is left and the tokens added. The context
on its left shows the entry states: one if a piece starts in the context, else those reached from every place there. A
state that turns out to be missing is added by running its chunk again. Maps compose associatively; they are
combined ``FAN`` at a time, level by level.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby, pairwise
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import null_safe, text_or_empty
from claimsieve.llm.sentence_pieces import slices
from claimsieve.operators.layout import reliable

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
LIMIT = 512
CHUNK = 32_768
CONTEXT = 256
BEFORE, AFTER = 4, 3  # characters that decide whether a piece starts at a place
FAN = 64
WHITE, LETTER, DIGIT, OTHER = range(4)
#: What may follow an apostrophe as a piece of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
CODE_POINTS = 0x110000
STATES = 250_000
WORDS, LONG_WORD = 250_000, 48
PAIRS = 400_000
NEVER = 1 << 40

#: Per growing token one number: its node, the token before it plus one, the count plus COUNTS // 2.
State = tuple[int, ...]
COUNTS, TOKENS = 1 << 12, 1 << 20
START: State = (COUNTS // 2,)


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: visible Latin-1 signs for themselves, the other
    bytes in turn for the code points from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def classes_of(splitter: tokenizers.pre_tokenizers.PreTokenizer) -> np.ndarray:
    """The class of every code point: that of the sample sign it joins in one piece.

    Neighbouring code points of one Unicode category are tried together, and one by one if they make more than one piece.
    """
    out = np.zeros(CODE_POINTS, dtype=np.uint8)
    guess = {"L": (LETTER, "a"), "N": (DIGIT, "1")}
    known = (c for c in range(CODE_POINTS) if not 0xD800 <= c < 0xE000)
    for category, run in groupby(known, key=lambda c: (unicodedata.category(chr(c))[0], c >> 12)):
        run = list(run)
        kind, sample = guess.get(category[0], (OTHER, "!"))
        if len(splitter.pre_tokenize_str(sample + "".join(map(chr, run)))) == 1:
            out[run] = kind
            continue
        for c in run:
            for kind, sample in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")):
                if len(splitter.pre_tokenize_str(sample + chr(c))) == 1:
                    out[c] = kind
    return out


def compiled(path: str = MODEL) -> bytes:
    """The tables of a tokenizer file as bytes that travel with the tasks: of bounded size, made on the driver.

    Only byte-level BPE with the usual split and without normalisation has these tables; others are refused.
    """
    return _compiled(Path(path).read_text(encoding="utf-8"))


def _compiled(text: str) -> bytes:
    if text in _TABLES:
        return _TABLES[text]
    spec = json.loads(text)
    model, split, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model["type"] != "BPE" or not plain or spec["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"]:
        raise ValueError("only byte-level BPE without normalisation can be compiled")
    if split["add_prefix_space"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added spaces and added tokens that take their surroundings are not supported")
    splitter = tokenizers.Tokenizer.from_str(text).pre_tokenizer
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    tables = {"vocab": model["vocab"], "merges": merges, "special": [t["content"] for t in added]}
    data = zlib.compress(json.dumps(tables).encode(), 1)
    _TABLES[text] = len(data).to_bytes(8, "big") + data + zlib.compress(classes_of(splitter).tobytes(), 1)
    return _TABLES[text]


_TABLES: dict[str, bytes] = {}


def classes_in(data: bytes) -> np.ndarray:
    """The classes of all code points, from what :func:`compiled` made."""
    size = int.from_bytes(data[:8], "big")
    return np.frombuffer(zlib.decompress(data[8 + size :]), dtype=np.uint8)


def piece_starts(text: str, classes: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each place of a text, its end included."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = classes[codes]
    white, n = kind == WHITE, len(codes)
    out = np.ones(n + 1, dtype=bool)
    if n < 2:
        return out
    followed = np.append(~white[2:], False)  # by a sign that is not white
    after_white = np.where(white[1:], followed, codes[:-1] != 32)
    out[1:n] = np.where(white[:-1], after_white, kind[1:] != kind[:-1])
    for at in np.flatnonzero((codes == 39) & out[:n]).tolist():
        for ending in ENDINGS:
            if text.startswith(ending, at + 1):
                out[at + 1 : at + 1 + len(ending)] = False
                out[at + 1 + len(ending)] = True
    return out


class Transducer:
    """Splitter and transducer of one tokenizer."""

    def __init__(self, data: bytes) -> None:
        size = int.from_bytes(data[:8], "big")
        tables = json.loads(zlib.decompress(data[8 : 8 + size]))
        self.classes = classes_in(data)
        sign = byte_of_sign()
        spelled = {s: bytes(map(sign.__getitem__, s)) for s in tables["vocab"] if all(c in sign for c in s)}
        self.special = tables["special"]
        longest_first = sorted(self.special, key=len, reverse=True)
        self.is_special = re.compile("|".join(map(re.escape, longest_first))) if self.special else None
        ids = {raw: tables["vocab"][s] for s, raw in spelled.items() if s not in self.special}
        self.bytes_of = {i: raw for raw, i in ids.items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for n, (a, b) in enumerate(tables["merges"]):
            self.rank.setdefault((spelled[a], spelled[b]), n)
        self.ends = {i: ends for i, raw in self.bytes_of.items() if (ends := self.ends_of(raw))}
        self.down: dict[int, int] = {}  # node << 8 | byte -> node of the tree of tokens
        self.token_at = [-1]
        for raw, i in ids.items():
            node = 0
            for b in raw:
                key = node << 8 | b
                if key not in self.down:
                    self.down[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.down[key]
            self.token_at[node] = i
        self.beside_memo: dict[int, bool] = {}
        self.words: dict[str, int] = {}
        self.forget()

    # ---- the transducer -----------------------------------------------------------------------------

    def forget(self) -> None:
        self.states: list[State] = [START]
        self.number: dict[State, int] = {START: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def ends_of(self, raw: bytes) -> tuple[list, list] | None:
        """What stands at the left and the right end of a token while its bytes are merged, the pair of lowest rank
        first: (part, rank from which it is there, rank at which it grows). None if merging gives other tokens."""
        parts, left, right = [raw[i : i + 1] for i in range(len(raw))], [], []
        since_left = since_right = -1
        while len(parts) > 1:
            ranks = [self.rank.get(p, NEVER) for p in pairwise(parts)]
            best = min(ranks)
            if best == NEVER:
                return None
            i = ranks.index(best)
            if i == 0:
                left.append((parts[0], since_left, best))
                since_left = best
            if i == len(parts) - 2:
                right.append((parts[-1], since_right, best))
                since_right = best
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [*left, (raw, since_left, NEVER)], [*right, (raw, since_right, NEVER)]

    def beside(self, a: int, b: int) -> bool:
        """Whether token b may follow token a in a piece (a = -1: at its start).

        It may not if some part at the end of a merges with some part at the start of b: both are there at a time, and
        the merge comes before either grows (of equal ranks the left one comes first).
        """
        key = (a + 1) << 32 | b
        known = self.beside_memo.get(key)
        if known is None:
            known = b in self.ends and (a < 0 or not any(
                (r := self.rank.get((x, y), NEVER)) < x_until and r <= y_until and r < NEVER and max(x_from, y_from) <= min(x_until, y_until)
                for x, x_from, x_until in self.ends[a][1]
                for y, y_from, y_until in self.ends[b][0]
            ))
            if len(self.beside_memo) > PAIRS:
                self.beside_memo.clear()
            self.beside_memo[key] = known
        return known

    def step(self, state: State, byte: int) -> tuple[State, int]:
        grown, added = [], None
        for item in state:
            node = self.down.get(item // (COUNTS * TOKENS) << 8 | byte)
            if node is None:
                continue
            rest = item % (COUNTS * TOKENS)
            grown.append(node * (COUNTS * TOKENS) + rest)
            token = self.token_at[node]
            if token >= 0 and added is None and self.beside(rest // COUNTS - 1, token):
                added, last = rest % COUNTS - COUNTS // 2 + 1, token
        if added is None:
            raise ValueError("no token ends here: not every byte is a token")
        return (*(item - added for item in grown), (last + 1) * COUNTS + COUNTS // 2), added

    def move(self, at: int, byte: int) -> tuple[int, int]:
        state, added = self.step(self.states[at], byte)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        found = self.moves[at << 8 | byte] = (self.number[state], added)
        return found

    def read(self, state: State, raw: bytes) -> tuple[State, int]:
        """(state, tokens added) after some bytes."""
        if len(self.states) > STATES:
            self.forget()
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
        moves, total = self.moves, 0
        for byte in raw:
            at, added = moves.get(at << 8 | byte) or self.move(at, byte)
            total += added
        return self.states[at], total

    def count_words(self, words: Iterable[str]) -> int:
        """Tokens of whole pieces. Counts of pieces met lately are kept: transitions on a whole piece at once."""
        known, total = self.words, 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.read(START, word.encode("utf-8", "replace"))[1]
                if len(word) <= LONG_WORD:
                    if len(known) >= WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total

    # ---- the splitter -------------------------------------------------------------------------------

    def starts(self, text: str) -> np.ndarray:
        return piece_starts(text, self.classes)

    def count(self, text: str) -> int:
        """Tokens of a whole text. Strings of special tokens count as one each and split the text."""
        if self.is_special is None or not any(s in text for s in self.special):
            return self.count_plain(text)
        return len(self.is_special.findall(text)) + sum(map(self.count_plain, self.is_special.split(text)))

    def count_plain(self, text: str) -> int:
        if not text:
            return 0
        places = np.flatnonzero(self.starts(text)).tolist()
        return self.count_words([text[a:b] for a, b in pairwise(places)])

    # ---- chunks -------------------------------------------------------------------------------------

    def cuts(self, text: str, chunk: int) -> list[tuple[str, str, str, bool]]:
        """(left, text, right, whether left starts where its segment does): chunks of about ``chunk`` characters.

        Strings of special tokens are never cut, and no context reaches over one.
        """
        spans = [m.span() for m in self.is_special.finditer(text)] if self.is_special else []
        ends, nth, out, at = [0, *(b for _, b in spans)], 0, [], 0
        begins = [*(a for a, _ in spans), len(text)]
        while at < len(text):
            end = min(at + chunk, len(text))
            while nth < len(spans) and spans[nth][1] <= at:
                nth += 1
            first = nth  # the segment in which the chunk starts is the one before span ``first``
            last = first
            while last < len(spans) and spans[last][1] <= end:
                last += 1
            if last < len(spans) and spans[last][0] < end:
                end = spans[last][0] if spans[last][0] > at else spans[last][1]
                last += end == spans[last][1]
            low = max(ends[first], at - CONTEXT)
            out.append((text[low:at], text[at:end], text[end : min(begins[last], end + AFTER)], low == ends[first]))
            at = end
        return out

    def entries(self, left: str, head: str, right: str, from_start: bool) -> list[State]:
        """The states in which a chunk may be entered, as its context shows them."""
        if not left or not head + right:
            return [START]
        places = np.flatnonzero(self.starts(left + head[:AFTER] + right[:AFTER])[: len(left) + 1])
        places = places if from_start else places[places >= BEFORE]
        if len(places):
            return [self.read(START, left[places[-1] :].encode("utf-8", "replace"))[0]]
        raw, found = left.encode("utf-8", "replace"), set()
        for i in range(len(raw)):
            if i < len(raw) // 2:
                found.add(START)
            found = {self.read(s, raw[i : i + 1])[0] for s in found}
        return sorted(found)

    def state_map(self, left: str, text: str, right: str, from_start: bool, given: list[State] | None = None) -> list[tuple[State, State, int]]:
        """(entry, exit, tokens added) of a chunk for the states in which it may be entered, or for given ones."""
        parts = self.is_special.split(text) if self.is_special else [text]
        fixed = len(parts) - 1 + sum(map(self.count_plain, parts[1:-1]))
        ends_here = not right
        if len(parts) > 1:
            exit_, added = self.tail(parts[-1], right, ends_here)
            fixed += added
            head, right_of_head = parts[0], ""
        else:
            exit_, head, right_of_head = None, text, right
        near = left[-BEFORE:]
        flags = self.starts(near + head + right_of_head[:AFTER])[len(near) : len(near) + len(head) + 1].copy()
        flags[-1] |= not right_of_head
        flags[0] |= not near
        places = np.flatnonzero(flags).tolist()
        if places:
            first, last = head[: places[0]], head[places[-1] :]
            fixed += self.count_words([head[a:b] for a, b in pairwise(places)])
            if last:
                after, added = self.read(START, last.encode("utf-8", "replace"))
                fixed += added
            else:
                after = START
        else:
            first, after = head, None
        out = []
        for entry in self.entries(left, head, right_of_head, from_start) if given is None else given:
            state, added = self.read(entry, first.encode("utf-8", "replace"))
            leave = exit_ if exit_ is not None else after if after is not None else state
            out.append((entry, leave, fixed + added))
        return out

    def tail(self, text: str, right: str, ends_here: bool) -> tuple[State, int]:
        """The state and the count after a chunk's last segment, which starts at its own start."""
        if not text:
            return START, 0
        places = np.flatnonzero(self.starts(text + right[:AFTER])[: len(text) + 1]).tolist()
        added = self.count_words([text[a:b] for a, b in pairwise(places)])
        if ends_here or places[-1] == len(text):
            return START, added + (self.count_words([text[places[-1] :]]) if places[-1] < len(text) else 0)
        state, more = self.read(START, text[places[-1] :].encode("utf-8", "replace"))
        return state, added + more


LOADED: dict[bytes, Transducer] = {}


def transducer_of(data: bytes) -> Transducer:
    """The transducer with the states it has made: kept by a worker from task to task."""
    if data not in LOADED:
        LOADED.clear()
        LOADED[data] = Transducer(data)
    return LOADED[data]


def packed(state: State) -> bytes:
    return np.array(state, dtype=np.int64).tobytes()


def unpacked(data: bytes) -> State:
    return tuple(np.frombuffer(data, dtype=np.int64).tolist())


def composed(frame: pd.DataFrame) -> pd.DataFrame:
    """The map of up to ``FAN`` neighbouring maps. Each is a function, so the product has a row per entry of the first."""
    steps = [part for _, part in sorted(frame.groupby("nth"), key=lambda x: x[0])]
    rows = [(e, x, n) for e, x, n in zip(steps[0].entry, steps[0].exit, steps[0].n, strict=True)]
    for part in steps[1:]:
        after = {e: (x, n) for e, x, n in zip(part.entry, part.exit, part.n, strict=True)}
        rows = [(e, after[x][0], n + after[x][1]) for e, x, n in rows if x in after]
    first = frame.iloc[0]
    out = pd.DataFrame(rows, columns=["entry", "exit", "n"])
    return out.assign(doc_id=first.doc_id, check=first.check, nth=first.part)[["doc_id", "check", "nth", "entry", "exit", "n"]]


def long_counts(rows: DataFrame, data: bytes, chunk: int, key_type: str) -> DataFrame:
    """(doc_id, check, n): tokens of texts of more than a chunk; rows that repeat in full are counted once."""
    chunk_kind = f"doc_id {key_type}, check bigint, nth bigint, left string, text string, right string, from_start boolean"
    map_kind = f"doc_id {key_type}, check bigint, nth bigint, entry binary, exit binary, n bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer_of(data)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time: they are long
                parts = machine.cuts(batch.column(2)[i].as_py(), chunk)
                same = [pa.array([c[i].as_py()] * len(parts), c.type) for c in (batch.column(0), batch.column(1))]
                columns = zip(*((nth, *part) for nth, part in enumerate(parts)), strict=True)
                arrays = [*same, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "check", "nth", "left", "text", "right", "from_start"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer_of(data)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                given = None if "state" not in r else [unpacked(r["state"])]
                for entry, leave, n in machine.state_map(r["left"], r["text"], r["right"], r["from_start"], given):
                    out.append((r["doc_id"], r["check"], r["nth"], packed(entry), packed(leave), n))
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            names = ["doc_id", "check", "nth", "entry", "exit", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    place = ["doc_id", "check", "nth"]
    chunks = reliable(rows.dropDuplicates(["doc_id", "check"]).mapInArrow(cut, chunk_kind).repartition(*place))
    found = reliable(chunks.mapInArrow(maps, map_kind))
    fresh = found
    while True:  # states that are left but not entered: their chunks run again, see the module's text
        left = fresh.select(F.col("doc_id").alias("w_id"), F.col("check").alias("w_check"), (F.col("nth") + 1).alias("w_nth"), F.col("exit").alias("state")).distinct()
        pairs = [("w_id", "doc_id"), ("w_check", "check"), ("w_nth", "nth"), ("state", "entry")]
        wanted = left.join(found, null_safe(left, found, pairs), "left_anti")
        asked = wanted.join(chunks, null_safe(wanted, chunks, pairs[:3])).select(*chunks.columns, "state")
        fresh = reliable(asked.mapInArrow(maps, map_kind))
        if not fresh.take(1):
            break
        found = reliable(found.unionByName(fresh))
    last = found.agg(F.max("nth")).first()[0] or 0
    while last > 0:
        found = found.withColumn("part", F.floor(F.col("nth") / FAN)).groupBy("doc_id", "check", "part").applyInPandas(composed, map_kind)
        last //= FAN
    start = packed(START)
    return found.filter(F.col("entry") == F.lit(start)).select(F.col("doc_id").alias("l_id"), F.col("check").alias("l_check"), "n")


def token_counts(docs: DataFrame, data: bytes, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of ``docs``, as the tokenizer's library counts.

    ``data`` is what :func:`compiled` made of the tokenizer file. A null text counts as empty. Strings of special tokens
    inside a text count as those tokens. Rows that repeat give equal rows; a null doc_id stays; other columns are
    not read. The counts are the same for every chunk size.
    """
    text = text_or_empty(docs)
    rows = docs.select("doc_id", F.xxhash64(text).alias("check"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer_of(data)
        for batch in (part for whole in batches for part in slices(whole, 2)):
            n = pa.array([machine.count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    short = rows.filter(F.char_length("text") <= chunk).select("doc_id", "n_bytes", "text")
    short = short.mapInArrow(count, f"doc_id {key_type}, n_bytes bigint, n_tokens bigint")
    long = rows.filter(F.char_length("text") > chunk)
    counts = long_counts(long.select("doc_id", "check", "text"), data, chunk, key_type)
    long = long.select("doc_id", "check", "n_bytes")
    long = long.join(counts, null_safe(long, counts, [("doc_id", "l_id"), ("check", "l_check")]))
    both = short.unionByName(long.select("doc_id", "n_bytes", F.col("n").alias("n_tokens")))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)
