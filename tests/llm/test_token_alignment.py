"""Alignment of two tokenizers against a plain version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers
from conftest import TINY
from test_operators import docs_and_empty, table

from claimsieve.llm import queries, token_alignment


@pytest.fixture(scope="module")
def pair():
    return token_alignment.TokenizerPair(token_alignment.load())


@pytest.fixture(scope="module")
def libraries():
    first = tokenizers.Tokenizer.from_file(token_alignment.BYTE_MODEL)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_MODEL)


def plain(libraries, pair, rows):
    """Per row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha), token by token."""
    first, second = libraries
    links, heads = [], []
    for doc, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        spelled = [b"".join(raw[i] for i in ids) for raw, ids in ((pair.a_raw, a), (pair.b_raw, b))]
        if not text or any(x != (" " + text).encode() for x in spelled):
            a = b = []
        spans = []
        for raw, ids in ((pair.a_raw, a), (pair.b_raw, b)):
            at = 0
            spans.append([(at, at := at + len(raw[i]), i) for i in ids])
        ends = sorted({y for _, y, _ in spans[0]} & {y for _, y, _ in spans[1]})
        groups, at = [], [0, 0]
        for end in ends:
            texts = []
            for k, side in enumerate(spans):
                low = at[k]
                while at[k] < len(side) and side[at[k]][1] <= end:
                    at[k] += 1
                texts.append(",".join(str(i) for _, _, i in side[low : at[k]]))
            groups.append("|".join(texts))
        found, j = [], 0
        for x, y, i in spans[0]:
            while j and spans[1][j][0] > x:
                j -= 1
            while spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < y:
                found.append((i, spans[1][k][2]))
                k += 1
        links.append(found)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        heads.append((doc, len(a), len(b), len(groups), sha))
    count = Counter(x for found in links for x in found)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for (doc, n_a, n_b, n_groups, sha), found in zip(heads, links, strict=True):
        out.append((doc, n_a, n_b, n_groups, len(found), sum(count[x] == most[x[1]] for x in found), sum(count[x] for x in found), sha))
    return out


def test_cuts_equal_intersection():
    draw = random.Random(8)
    for _ in range(400):
        edges = np.unique([0, *(draw.randrange(1, 200) for _ in range(draw.randrange(1, 4)))])
        if len(edges) < 2:
            continue
        sides = [np.unique([*edges[1:], *(draw.randrange(1, edges[-1] + 1) for _ in range(draw.randrange(60)))]) for _ in range(2)]
        got = token_alignment.shared_cuts(*sides, edges)
        assert got.tolist() == np.intersect1d(*sides).tolist()


ROWS = [
    (1, "plain words, and 日本語 with émigré's naïveté"), (2, "a ▁ b"), (3, "<|endoftext|> as text"), (3, "<s> </s> <unk> <0x0A>"), (4, "  two  spaces \n\n\t"),
    (5, "x" * 900), (6, "🙂🙃" * 40), (7, "\x00 odd \x7f signs  "), (8, "repeat"), (8, "repeat"), (9, " "),
]


@pytest.mark.parametrize("known", [0, 50, 1_000_000])
def test_operator(spark, pair, libraries, known):
    docs, none = docs_and_empty(spark, ROWS)
    files = token_alignment.load()
    assert token_alignment.alignment_digest(none, files).collect() == []
    got = [tuple(r) for r in token_alignment.alignment_digest(docs, files, known).collect()]
    want = plain(libraries, pair, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(got, key=str) == sorted(want, key=str)


def test_groups(spark, pair):
    rows = table(spark, ROWS).withColumnsRenamed({"score": "groups", "kept": "a", "labels": "row"})
    for r in token_alignment.alignments(rows, token_alignment.load()).collect():
        for g in r.groups:
            assert b"".join(pair.a_raw[i] for i in g.a) == b"".join(pair.b_raw[i] for i in g.b) != b""
    written = {r.doc_id: ";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in r.groups) for r in token_alignment.alignments(rows, token_alignment.load()).collect()}
    digests = {r.doc_id: r.groups_sha256 for r in token_alignment.alignment_digest(rows, token_alignment.load()).collect()}
    assert all(digests[d] == (hashlib.sha256(x.encode()).hexdigest() if x else "") for d, x in written.items() if d != 3)


def test_query(spark, pair, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.REGISTRY["op11_token_alignment"](spark, TINY).collect()} == set(plain(libraries, pair, rows))


def test_steps_over_ids_hold_no_words():
    pair = token_alignment.TokenizerPair(token_alignment.load())
    texts = ["one  two three", "  ", "straße two"]
    before = [[ids.tolist() for ids in side] for side in pair.encode(texts)]
    assert len(pair.a_words) > 3 and len(pair.b_words) > 3
    pair.forget()
    assert len(pair.a_words) + len(pair.a_words.older) + len(pair.b_words.older) == 0 and list(pair.b_words) == [" "]
    assert [[ids.tolist() for ids in side] for side in pair.encode(texts)] == before


def test_ids_are_kept_as_bytes(spark, pair):
    """Four bytes an id and one value a row, so that the JVM lays out no items; a row without tokens has none."""
    docs = table(spark, [(1, "Two words, and more"), (2, None), (3, "naïve 漢字")])
    tokens = token_alignment.encoded(docs, token_alignment.load())
    assert [dict(tokens.dtypes)[c] for c in ("a", "b")] == ["binary", "binary"]
    for r in tokens.collect():
        assert [len(r.a), len(r.b)] == [4 * r.n_a, 4 * r.n_b]
        sides = [np.frombuffer(x, dtype="<i4") for x in (r.a, r.b)]
        expected = pair.encode([{1: "Two words, and more", 2: "", 3: "naïve 漢字"}[r.doc_id]])
        assert [x.tolist() for x in sides] == [x[0].tolist() for x in expected]
