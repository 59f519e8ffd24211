"""Trees of near copies: those over the same sets are one."""

from __future__ import annotations

import random

from test_operators import brute_components, table

from claimsieve.llm import ngram_join


def half_alike(pairs: int) -> list[tuple[int, str]]:
    """Pairs of texts that share half of their shingles: they meet in many trees, and none of them links."""
    draw = random.Random(8)
    rows = []
    for _ in range(pairs):
        words = [f"w{draw.randrange(100_000)}" for _ in range(200)]
        other = words[:150] + [f"w{draw.randrange(100_000)}" for _ in range(50)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    return rows


def test_trees_over_the_same_sets_are_one(spark, monkeypatch):
    seen, bridges = [], ngram_join.bridges

    def counted(trees, labels, described):
        seen.append(trees.count())
        return bridges(trees, labels, described)

    monkeypatch.setattr(ngram_join, "bridges", counted)
    rows = half_alike(10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(table(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert seen == [20]  # a row for each set of each of the ten trees; more than five times as many shingles are shared


def test_pairs_at_the_limit_meet_in_a_tree(spark):
    """Sets that link by one shingle, or miss by one, whichever shingles they share."""
    draw = random.Random(9)
    rows = []
    for size in (1, 4, 7, 21, 35, 70, 140):
        for _ in range(6):
            words = [f"w{draw.randrange(1_000_000)}" for _ in range(size + 4)]
            for cut in (3 * size // 4 - 1, 3 * size // 4, -(-3 * size // 4), size):
                rows.append((len(rows), " ".join(words[: max(cut, 0) + 4])))
            rows.append((len(rows), " ".join([*words[size // 7 :], *(f"w{draw.randrange(1_000_000)}" for _ in range(size // 7))])))
    draw.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_a_large_group_is_joined_without_its_pairs(spark, monkeypatch):
    """Copies of one text with three words changed in each: a pair links only if two of their changes lie close together, so a
    few stars over the whole group leave most of it apart."""
    seen, bridges = [], ngram_join.bridges

    def counted(trees, labels, described):
        seen.append(bridges(trees, labels, described).count())
        return bridges(trees, labels, described)

    monkeypatch.setattr(ngram_join, "bridges", counted)
    draw = random.Random(10)
    base = [f"w{draw.randrange(1_000_000)}" for _ in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        for place in draw.sample(range(200), 3):
            words[place] = f"v{draw.randrange(1_000_000)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(table(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert seen[0] <= 2 * len(rows)  # of 79,800 pairs


def test_sets_without_a_partner_in_reach_leave_the_tree(spark):
    """Two texts with a common end of 40 shingles, 160 and 100 of their own: their sizes are near enough for no link."""
    draw = random.Random(11)
    tail = [f"w{draw.randrange(1_000_000)}" for _ in range(44)]
    rows = [(i, " ".join([*(f"w{draw.randrange(1_000_000)}" for _ in range(n)), *tail])) for i, n in enumerate((160, 100))]
    twin = " ".join([*rows[1][1].split()[:-1], "end"])
    for texts, left in ((rows, 0), ([*rows, (2, twin)], 2)):
        docs = table(spark, texts)
        known = ngram_join.sets_of(docs, ngram_join.common_shingles(docs)).filter("s is not null")
        trees = ngram_join.trees_of(known)
        assert trees.select("s").distinct().count() == left
