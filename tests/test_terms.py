from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimsieve.functions.stem import with_stem
from claimsieve.operators import dictionary, terms

ROWS = [
    (1, ["cat", "dog", "cat", "dog", "cat"]),
    (2, ["dog", "cow"]),
    (3, []),
    (4, ["cat", "dog", "cow", "cow"]),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")


def grams(words):
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_ngrams(spark):
    found = terms.ngrams(table(spark, [(1, ["aone", "btwo"])]))
    assert sorted(r["term"] for r in found.collect()) == ["aone", "aone btwo", "btwo"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "zz"]), max_size=12), min_size=1, max_size=6))
def test_term_counts_equal_brute_force(spark, docs):
    rows = list(enumerate(docs))
    got = {(r["doc_id"], r["term"]): r["tf"] for r in terms.term_counts(table(spark, rows)).collect()}
    assert got == {(d, t): n for d, words in rows for t, n in Counter(grams(words)).items()}


def test_pruning_idf_and_top_k(spark):
    rows = [(1, ["every", "some"]), (2, ["every", "some"]), (3, ["every", "once"])]
    counts = terms.term_counts(table(spark, rows), longest=1)
    vocab = terms.vocabulary(counts, F.lit(3)).collect()
    assert [(r["term"], r["pos"], r["df"], r["total"]) for r in vocab] == [("some", 0, 2, 2)]
    assert vocab[0]["idf"] == pytest.approx(math.log(4 / 3) + 1)
    top = terms.vocabulary(terms.term_counts(table(spark)), F.lit(4), 1, 1.0, 2).collect()
    assert [r["term"] for r in top] == ["cat", "dog"]


def test_tfidf_rows_are_unit_and_both_ways_agree(spark):
    df = table(spark)
    counts = terms.term_counts(df)
    vocab = terms.vocabulary(counts, terms.row_count(df), 1, 1.0, 6)
    short = {(r["doc_id"], r["term"]): r["value"] for r in terms.tfidf(df, vocab).collect()}
    joined = {(r["doc_id"], r["term"]): r["value"] for r in terms.tfidf_join(counts, vocab).collect()}
    assert short == pytest.approx(joined)
    for doc in (1, 2, 4):
        assert sum(v * v for (d, _), v in short.items() if d == doc) == pytest.approx(1.0)
    assert not any(d == 3 for d, _ in short)
    words, weights = terms.vocabulary_list(vocab)
    assert terms.tfidf_rows(df, words, weights).filter("doc_id = 3").first()["indices"] == []


def test_tfidf_rows_do_not_shuffle(spark):
    df = table(spark)
    plan = terms.tfidf_rows(df, ["cat"], terms.np.array([1.0]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    counted = terms.term_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in counted


# word:stem pairs from the published description of the algorithm, and of its extensions
PAIRS = """
caresses:caress ponies:poni ties:tie caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled
motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall
hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit
rational:ration valenci:valenc digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile
analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis
hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic
formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv
allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit
replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ
homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control
roll:roll dying:die died:die spied:spi flies:fli dies:die enjoy:enjoy generalization:gener oscillators:oscil
"""


def test_published_stems(spark):
    pairs = [p.split(":") for p in PAIRS.split()]
    df = with_stem(spark.createDataFrame(pairs, "word string, expected string"), "word")
    assert df.filter("stem <> expected").collect() == []


def test_large_dictionary_takes_the_other_way(spark):
    df = table(spark, [(1, ["running", "cats", "as", "running"]), (2, [])])
    small = {r["doc_id"]: r["tokens"] for r in dictionary.stem_tokens(df, min_length=3).collect()}
    large = dictionary.stem_tokens(df, min_length=3, max_dictionary=1)
    assert small == {r["doc_id"]: r["tokens"] for r in large.collect()} == {1: ["run", "cat", "run"], 2: []}


def test_rows_with_equal_keys_stay_apart_at_any_dictionary_size(spark):
    rows = [(1, ["dogs", "ran"]), (1, ["cats"]), (1, ["cats"]), (2, ["cats", "dogs", "running"])]
    lemmas = spark.createDataFrame([("dogs", "dog"), ("cats", "cat"), ("ran", "run")], "token string, lemma string")
    for swap in (dictionary.stem_tokens, lambda df, **more: dictionary.lemma_lookup(df, lemmas, **more)):
        found = [sorted(map(repr, swap(table(spark, rows), max_dictionary=n).collect())) for n in (100, 2, 1)]
        assert len(found[0]) == 4 and found[0] == found[1] == found[2]


def test_lemma_lookup(spark):
    df = table(spark, [(1, ["geese", "fly", "geese"]), (2, ["fly"])])
    lemmas = spark.createDataFrame([("geese", "goose"), ("mice", "mouse"), ("fly", "fl")], "token string, lemma string")
    for limit in (10, 1):
        got = dictionary.lemma_lookup(df, lemmas, min_length=3, max_dictionary=limit)
        assert {r["doc_id"]: r["tokens"] for r in got.collect()} == {1: ["goose", "goose"], 2: []}


def test_vocabulary_by_length_equals_that_of_all_grams(spark):
    rng = random.Random(5)
    names = [f"w{i}" for i in range(40)]
    rows = [(i, [rng.choice(names[: rng.choice((3, 8, 40))]) for _ in range(rng.randrange(30))]) for i in range(300)]
    rows += [(300, []), (301, ["w0"]), (302, ["w1", "w2", "w3"]), (None, ["w1", "w2", "w3"])]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    n = terms.row_count(df)
    for top, most, bound in ((20, 0.95, 1000), (20, 0.3, 1000), (500, 0.95, 1000), (50_000, 0.95, 100_000), (500, 0.95, 30)):
        whole = terms.vocabulary(terms.term_counts(df), n, 2, most, top).collect()
        by_length = terms.token_vocabulary(df, n, max_df=most, max_features=top, max_rows=bound).collect()
        assert sorted(by_length) == sorted(whole) and whole
    spaced = spark.createDataFrame([(1, ["a b", "c"]), (2, ["a", "b", "c"]), (3, ["a", "b"])], df.schema)
    whole = terms.vocabulary(terms.term_counts(spaced), terms.row_count(spaced), 2).collect()
    assert sorted(terms.token_vocabulary(spaced, terms.row_count(spaced)).collect()) == sorted(whole)


def test_grams_of_rare_words_stay_in_their_row(spark):
    rows = [(1, ["a", "b", "x", "a", "b"]), (2, ["b", "a", "y"]), (3, ["a"]), (4, ["b", "x"])]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    two = terms.grams_of_frequent(df, pa.array(["a", "b"]), 2, "doc_id", "tokens")
    assert {r[0]: r[1] for r in two.collect()} == {1: ["a b", "a b"], 2: ["b a"], 3: [], 4: []}
    three = terms.grams_of_frequent(df, pa.array(["a b", "b x", "x a"]), 3, "doc_id", "tokens", rows=1)
    assert {r[0]: r[1] for r in three.collect()} == {1: ["a b x", "b x a", "x a b"], 2: [], 3: [], 4: []}
