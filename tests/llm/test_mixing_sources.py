"""Hundreds and thousands of sources, each with its own weight."""

from __future__ import annotations

import random

from claimsieve.llm import mixing


def off_by(weights, blocks):
    """The largest distance of any source from its share after any slot of the first phase."""
    taken, total, worst = [0] * len(weights), sum(weights), 0.0
    for place, block, phase, release, deadline in mixing.schedule(weights, blocks):
        if phase:
            break
        assert block == taken[place] and release <= sum(taken) < deadline
        slots = sum(taken) + 1
        worst = max(worst, abs(taken[place] - (slots - 1) * weights[place] / total))  # lowest just before a block
        taken[place] += 1
        worst = max(worst, abs(taken[place] - slots * weights[place] / total))
    return worst


def test_thousands_of_sources():
    draw = random.Random(3)
    weights = [draw.random() ** 3 + 1e-4 for _ in range(5_000)]
    assert off_by(weights, [3] * 5_000) < 1


def test_three_hundred_sources_of_equal_size(spark):
    docs = spark.range(3_000).selectExpr("id as doc_id", "concat('s', id % 300) as source", "string(id) as text")
    counts = mixing.source_counts(docs)
    assert len(counts) == 300
    out = mixing.mix(docs, mixing.tempered(counts), block_rows=1).orderBy("slot").collect()
    assert [r.slot for r in out] == list(range(3_000))
    for first in range(0, 3_000, 300):  # equal weights: every 300 slots hold each source once
        assert len({r.source for r in out[first : first + 300]}) == 300
