"""Token counts against the tokenizer's library."""

from __future__ import annotations

import random

import pytest
import tokenizers
from conftest import TINY
from test_operators import docs_and_empty, table

from claimsieve.llm import queries, token_counts

SIGNS = ["'s", "'re", "'", "r", "e", " ", "  ", "\n", "\t", "é", "Ω", "日本", "3", "½", "!", "<|endoftext|>", "a", "th"]
SIGNS += ["　", "🙂", "'ll", "'v", "aaaa", "_-", "\x85", "̈", "​", "<|endof", "text|>"]


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(token_counts.compiled())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(token_counts.MODEL)


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def by_chunks(machine, text, chunk):
    """The maps of all chunks, one after the other; also how many entry states the context did not show."""
    state, total, missed = token_counts.START, 0, 0
    for part in machine.cuts(text, chunk):
        found = {e: (x, n) for e, x, n in machine.state_map(*part)}
        if state not in found:
            missed += 1
            found = {e: (x, n) for e, x, n in machine.state_map(*part, [state])}
        state, n = found[state]
        total += n
    assert total == 0 or state == token_counts.START
    return total, missed


def test_counts_and_maps(machine, library):
    draw = random.Random(1)
    for _ in range(3_000):
        text = "".join(draw.choice(SIGNS) for _ in range(draw.randrange(40)))
        assert machine.count(text) == count(library, text) == by_chunks(machine, text, draw.randrange(1, 30))[0]


def test_long_pieces(machine, library, monkeypatch):
    draw = random.Random(2)
    texts = ["a" * 5_000, "ab" * 3_000, "".join(draw.choice("abcdefghij") for _ in range(6_000)), "日本語" * 1_500, "é" * 4_000]
    texts += ["thequickbrown" * 400, "=" * 5_000, " " * 4_000, "\n" * 3_000 + "x"]
    for text in texts:
        assert machine.count(text) == count(library, text)
        assert by_chunks(machine, text, 997)[0] == count(library, text)
    monkeypatch.setattr(token_counts, "CONTEXT", 6)  # too little to show the state
    results = [by_chunks(machine, text, 50) for text in texts]
    assert [n for n, _ in results] == [count(library, text) for text in texts] and any(missed for _, missed in results)


def test_states_are_forgotten(machine, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 5)
    monkeypatch.setattr(token_counts, "WORDS", 3)
    monkeypatch.setattr(token_counts, "PAIRS", 4)
    text = "the theory of everything, in other words: nothing's there " * 3
    machine.words.clear()
    assert machine.count(text) == count(library, text)


@pytest.mark.parametrize("chunk", [700, 32_768])
def test_operator(spark, library, monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "FAN", 3)
    monkeypatch.setattr(token_counts, "CONTEXT", 12)
    draw = random.Random(3)
    extra = [(20, "x" * 3_000), (21, "".join(draw.choice("abcde") for _ in range(2_500))), (22, "a <|endoftext|>" * 200), (20, "same id " * 99)]
    docs, none = docs_and_empty(spark, extra)
    data = token_counts.compiled()
    assert token_counts.token_counts(none, data).collect() == []
    got = [tuple(r) for r in token_counts.token_counts(docs, data, 100, chunk).collect()]
    texts = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := count(library, r.text), n > 100) for r in texts]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_other_tokenizers_are_refused(tmp_path):
    own = tokenizers.Tokenizer(tokenizers.models.WordLevel({"a": 0}, "a"))
    own.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "words.json"))
    with pytest.raises(ValueError):
        token_counts.compiled(str(tmp_path / "words.json"))


def test_query(spark, library):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, len((r.text or "").encode()), n := count(library, r.text), n > 512) for r in docs}
    assert {tuple(r) for r in queries.REGISTRY["op12_token_counts"](spark, TINY).collect()} == want


def test_extra_columns(spark, library):
    docs = table(spark, [(1, "a b c")]).withColumnsRenamed({"score": "n_tokens", "kept": "check", "labels": "l_id", "lang": "w_id"})
    assert [tuple(r) for r in token_counts.token_counts(docs, token_counts.compiled(), chunk=2).collect()] == [(1, 5, 3, False)]
