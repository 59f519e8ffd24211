from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimsieve.operators import dictionary, layout, terms


def rows_of(seed=1, n=80):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    rows = [(i // 2, [draw.choice(words) for _ in range(draw.randrange(12))]) for i in range(n)]
    return [*rows, rows[0], rows[0], (None, ["w1", "w2", "w1", "w2"]), (7, None), (8, ["once", "w1", "w2"])]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")


def found(df):
    return sorted(((r["term"], r["df"], r["total"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("max_rows", [0, 1, 5, 500])
@pytest.mark.parametrize("longest", [1, 3, 4])
def test_frequency_equals_that_of_all_grams(spark, monkeypatch, max_rows, longest):
    monkeypatch.setattr(terms, "PART", 40)
    df = table(spark, rows_of())
    n = F.lit(df.count())
    want = terms.document_frequency(terms.term_counts(df, longest=longest), n)
    assert found(terms.token_frequency(df, n, longest=longest, max_rows=max_rows)) == found(want)


@pytest.mark.parametrize("odd", [["a b", "a", "b"], ["a", None, "b"]])
def test_odd_tokens(spark, odd):
    df = table(spark, [(1, odd), (2, odd), (3, ["c"])])
    want = terms.document_frequency(terms.term_counts(df), F.lit(3))
    assert found(terms.token_frequency(df, F.lit(3))) == found(want)


def test_grams_leave_their_rows_as_numbers_and_added_up(spark):
    df = table(spark, [(i, ["aaaa", "bbbb", "cccc"] * 20) for i in range(50)]).coalesce(1)
    known = spark.sparkContext.broadcast(pa.array(["aaaa", "bbbb", "cccc"]))
    codes = terms.gram_codes(df, 3, "tokens", known)
    assert [f.dataType.simpleString() for f in codes.schema] == ["bigint"] * 3
    assert codes.count() == 3
    assert codes.agg(F.sum("df"), F.sum("total")).first()[:] == (150, 50 * 58)


def test_parts_of_a_batch_have_a_bound_and_hold_every_row():
    lists = pa.array([[1] * 9, None, [], [2, 2], [3] * 4, [4]])
    batch = pa.RecordBatch.from_arrays([lists], names=["x"])
    parts = list(layout.row_parts(batch, lists, 5))
    assert pa.Table.from_batches(parts).column("x").to_pylist() == lists.to_pylist()
    assert [p.num_rows for p in parts] == [1, 3, 2]


def test_words_and_weights_do_not_depend_on_the_size_of_parts(spark, monkeypatch):
    df = table(spark, rows_of())
    mapping = pa.table({"token": ["w1", "w2"], "new": ["", "zz"]})
    vocab = (["w1", "w2", "w1 w2"], np.array([1.0, 2.0, 3.0]))

    def both():
        swapped = dictionary.replace_words(df, mapping)
        full = df.filter("tokens is not null")
        weighed = terms.tfidf_rows(full, *vocab)
        return sorted(map(str, swapped.collect())), sorted(map(str, weighed.collect()))

    whole = both()
    for module in (dictionary, terms):
        monkeypatch.setattr(module, "ITEMS", 7)
    assert both() == whole
