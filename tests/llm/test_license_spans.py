"""Spans of the license scan: verified against plain Python, and repetitive texts that are no notice."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from claimsieve.llm import license_scan

MPL = license_scan.NOTICES["mpl"]
SCHEMA = "doc_id long, text string"


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark):
    draw = random.Random(8)
    parts = ["CC", "by", "cc-by", "General", "public", "license", "All rights", "reserved", "é", "x9", "\n", "rights"]
    rows = [(i, draw.choice([" ", "-", ", "]).join(draw.choice(parts) for _ in range(draw.randrange(60)))) for i in range(150)]
    rows.append((150, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_scan(docs).collect()}
    assert got == {i: brute_base(t) for i, t in rows}


def test_repetitive_texts_are_no_notice(spark):
    rows = [
        (1, " ".join(["go to the park sun walk tree"] * 8)),
        (2, " ".join(["one of the cats and to the dogs under this source and a form is there"] * 12)),
        (3, " ".join(reversed(MPL.split()))),
        (4, " ".join(f"{a} {b} and then" for a, b in reversed(list(itertools.pairwise(MPL.split()))))),
        (5, "to the " * 5_000),
    ]
    out = license_scan.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.labels for r in out} == {""} and all(r.score < 0.6 for r in out)


def test_changed_notices_are_found(spark):
    words = MPL.split()
    texts = [
        " ".join([*words[:6], "really", "very", *words[6:]]),  # words put in
        " ".join([*words[:3], *words[4:]]),  # one left out
        f"x {MPL} and {MPL}",
        f"{MPL} {MPL}",
        " ".join(w + " of the to the" if n == 4 else w for n, w in enumerate(words)),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert all(r.labels == "mpl" and r.score >= license_scan.MIN_COVER for r in license_scan.license_scan(docs).collect())
    spans = {r.s_id: (r.first, r.last, r.places) for r in license_scan.scan(docs).filter("label = 'mpl'").collect()}
    n = len(words)
    assert spans[2] == (1, n + 2, 2) and spans[3] == (0, n, 2)
    assert [spans[i][2] for i in (0, 1, 4)] == [1, 1, 1]


@pytest.mark.parametrize("seed", range(5))
def test_rising(seed):
    draw = random.Random(seed)
    hits = list({(draw.randrange(6), draw.randrange(12)) for _ in range(9)})
    run = license_scan.rising(hits)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(run)) and set(run) <= set(hits)
    rises = [c for n in range(1, 7) for c in itertools.combinations(sorted(hits), n) if all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(c))]
    longest = max(map(len, rises))
    assert len(run) == longest and run[-1][1] == min(c[-1][1] for c in rises if len(c) == longest)


def test_clashing_columns(spark):
    names = "s_id s_check b_places b_first b_last b_labels m_labels m_cover own_id own_check row words_of_row check label".split()
    docs = spark.createDataFrame([(1, "cc by", *names), (None, None, *names)], SCHEMA + "".join(f", {n} string" for n in names))
    out = license_scan.license_scan(docs).collect()
    assert sorted(r.n_base for r in out) == [0, 1] and all(r[n] == n for r in out for n in names)
