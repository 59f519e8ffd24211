"""The pipeline stage by stage, and as a whole, against plain Python."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import pytest
import sentencepiece
from conftest import TINY
from test_operators import brute_components

import corpus_pipeline
from claimsieve.llm import mixing, sentence_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with a null id, repeated rows, a copy in other spacing, near copies, a null and an empty text."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select(*COLUMNS)
    schema, rows = docs.schema, [tuple(r) for r in docs.collect()]
    good = [r for r in rows if 60 < len((r[1] or "").split()) < 400][:12]
    top = max(r[0] for r in rows)
    for i, r in enumerate(good):
        words = r[1].split()
        words[len(words) // 2] = "replaced"
        rows.append((top + 10 + i, " ".join(words), *r[2:]))
    rows += [good[0], good[0], (None, good[1][1] + " and a tail of its own", *good[1][2:])]
    rows += [(top + 100, "  " + good[2][1].replace(" ", "\t", 3), *good[2][2:]), (top + 101, None, None, None, 0), (top + 102, "", "en", "other", 0)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{TINY}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def key(rows):
    return sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in rows))


def brute_exact(rows):
    """Of texts equal without white space the one with most code points, then smallest doc_id (no id first, as Spark orders it)."""
    best = {}
    for r in rows:
        text = r[1] or ""
        name = re.sub("[\x20\x09-\x0d]", "", text)
        rank = (-len(text), r[0] is not None, r[0] or 0)
        if name not in best or rank < best[name][0]:
            best[name] = (rank, r)
    return [r for _, r in best.values()]


def brute_near(rows):
    """Rows without doc_id stay and link nothing; of the others the first of each component."""
    found = brute_components([(r[0], r[1]) for r in rows if r[0] is not None])
    return [r for r in rows if r[0] is None or found[r[0]][1] == r[0]]


def brute_slots(sizes, weights):
    """Source of every block: the released block with the earliest deadline, ties to the first source; phases as sources end."""
    left, out = {s: -(-n // mixing.BLOCK_ROWS) for s, n in sizes.items()}, []
    while any(left.values()):
        active = sorted(s for s, n in left.items() if n)
        total = sum(Fraction(weights[s]) for s in active)
        share, done, slot = {s: Fraction(weights[s]) / total for s in active}, dict.fromkeys(active, 0), 0
        while all(left[s] for s in active):
            ready = [s for s in active if int(done[s] / share[s]) <= slot]
            nxt = min(ready, key=lambda s: (-int(-(done[s] + 1) / share[s] // 1), s))
            out.append(nxt)
            done[nxt], left[nxt], slot = done[nxt] + 1, left[nxt] - 1, slot + 1
    return out


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    given = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, docs.schema), folder)
        assert out.columns == docs.columns
        return [tuple(r) for r in out.collect()]

    kept = step("quality", given)
    assert not Counter(key(kept)) - Counter(key(given))
    ids = {r[0] for r in kept}
    named = {q: [d for d in {r[0] for r in given} if marks.get(d) == q] for q in (0, 1)}
    assert sum(d in ids for d in named[1]) >= 0.95 * len(named[1])
    assert sum(d in ids for d in named[0]) <= 0.2 * len(named[0])

    unique = step("exact_dedup", given)
    assert key(unique) == key(brute_exact(given))
    apart = step("near_dedup", unique)
    assert key(apart) == key(brute_near(unique))
    assert len(apart) < len(unique) < len(given)
    assert key(step("mixture", apart)) == key(apart)


def test_whole_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = [tuple(r) for r in corpus_pipeline.keep_quality(spark, docs, folder).collect()]
    rows = brute_near(brute_exact(good))
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    out = corpus_pipeline.run(spark, folder).orderBy("position").collect()
    expected = [(r[0] if r[0] is not None else -1, library.encode(r[1] or "")) for r in rows]
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.token_ids)) for r in out) == sorted(expected)
    assert all(r.n_tokens == len(r.token_ids) for r in out)

    counts = Counter(r[3] for r in rows if r[3] is not None)
    weights = mixing.tempered(sorted(counts.items()))
    sizes = counts | ({} if all(r[3] is not None for r in rows) else {"\U0010ffff": sum(r[3] is None for r in rows)})
    weights["\U0010ffff"] = sum(weights.values()) / len(weights)
    source_of = {r[0]: r[3] if r[3] is not None else "\U0010ffff" for r in rows}
    by_slot = {}
    for r in out:
        by_slot.setdefault(r.position // mixing.BLOCK_ROWS, set()).add(source_of[r.doc_id])
    assert [by_slot[s] for s in sorted(by_slot)] == [{s} for s in brute_slots(sizes, weights)]
    assert len({r.position for r in out}) == len(out)


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
