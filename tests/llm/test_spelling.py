"""Spelling variants against a brute-force version."""

from __future__ import annotations

import random
import re
import string
import zlib
from collections import Counter

import pytest
from conftest import TINY
from test_operators import docs_and_empty, table

from claimsieve.llm import queries, spelling


def near(a, b):
    """One insertion, deletion or replacement apart, by comparing the two words from both ends."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    words = brute_counts(rows)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    form, out = {}, set()
    found = {}
    for w in words:
        found[w] = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(found[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(found[w]), words.get(form[w])))
    return out


def test_block_equals_comparison():
    draw = random.Random(4)
    words = sorted({"".join(draw.choice("abé") for _ in range(draw.randrange(1, 9))) for _ in range(700)})
    index = spelling.Block(words[::2])
    for length in range(1, 11):
        asked = [w for w in words if len(w) == length] or ["a" * length]
        got = {(asked[q], words[::2][w]) for q, w in zip(*index.near(asked), strict=True)}
        assert got == {(a, b) for a in asked for b in words[::2] if near(a, b)}


@pytest.mark.parametrize("block", [8, 2_048])
def test_operator(spark, block):
    draw = random.Random(6)
    words = ["".join(draw.choice(string.ascii_lowercase[:5] + "é") for _ in range(draw.randrange(5, 9))) for _ in range(60)]
    rows = []
    for doc in range(200):
        text = []
        for _ in range(60):
            w = draw.choice(words[: draw.randrange(1, 61)])
            if draw.random() < 0.5:
                i = draw.randrange(len(w))
                w = draw.choice([w[:i] + w[i + 1 :], w[:i] + "d" + w[i:], w[:i] + "b" + w[i + 1 :]])
            text.append(w.capitalize() if draw.random() < 0.1 else w)
        rows.append((doc, draw.choice([" ", "-", "1", "\n"]).join(text)))
    rows += [(None, "abcde abcde abcde"), (900, None), (901, ""), (902, "x" * 5_000), (902, "x" * 5_000), (903, "x" * 5_000 + " " + "x" * 4_999)]
    rows += [(904, ("x" * 4_999 + " ") * 3), (905, "ÀÖ×÷ÿ " * 4)]
    got = spelling.spelling_variants(table(spark, rows), block).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute_counts(rows))
    assert any(r.root != r.form for r in got if r.form)


def test_odd_rows(spark):
    docs, none = docs_and_empty(spark)
    assert spelling.spelling_variants(none).collect() == []
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    clashing = docs.withColumnsRenamed({"score": "word", "kept": "n", "labels": "key", "lang": "form"})
    assert {tuple(r) for r in spelling.spelling_variants(clashing).collect()} == brute(rows)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.REGISTRY["op13_spelling_variants"](spark, TINY).collect()} == brute(rows)
