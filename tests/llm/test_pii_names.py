"""Names, coreference, long secrets and clashing columns of the surrogates."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from claimsieve.llm import pii

#: text, what must be gone
PRIVATE = [
    ("Mr John Ronald Tolkien wrote", ["John", "Ronald", "Tolkien"]),
    ("Mr McDonald came", ["McDonald", "Donald"]),
    ("Mrs Smith-Jones came", ["Smith", "Jones"]),
    ("Mr Ivanov Mrs Ivanova came", ["Ivanov", "Ivanova"]),
    ("Mr O'Brien and Mr O’Neil came", ["Brien", "Neil"]),
    ("Mr J. Smith and Mr J.R.R. Tolkien came", ["J.", "Smith", "Tolkien"]),
    ("Dr. Anna Smith and Prof Ernst Mach came", ["Anna", "Smith", "Ernst", "Mach"]),
    ("Herr Ludwig van Beethoven came", ["Ludwig", "Beethoven"]),
    ("Mr Don Smith came", ["Smith"]),
    ("Mr SMITH came", ["SMITH"]),
    ("password=" + "a1" * 120 + " end", ["a1a1"]),
    ("token = " + "b2" * 120 + " end", ["b2b2"]),
    ("key sk-" + "c3" * 40 + " end", ["c3c3"]),
    ('password="d4d4d4d4d4" end', ["d4d4"]),
]


@pytest.fixture(scope="module")
def replaced(spark):
    rows = [(i, t) for i, (t, _) in enumerate(PRIVATE)]
    return {r.doc_id: r for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}


@pytest.mark.parametrize("number", range(len(PRIVATE)))
def test_nothing_private_is_left(replaced, number):
    text, private = PRIVATE[number]
    got = replaced[number].text
    assert not [p for p in private if p in got]
    assert got.split()[0] == text.split()[0] or "=" in text
    assert got.split()[-1] == text.split()[-1]


def test_forms(replaced):
    assert re.fullmatch(r"Mrs \w+-\w+ came", replaced[2].text)
    assert re.fullmatch(r"Mr \w+ Mrs \w+ came", replaced[3].text) and replaced[3].n_entities == 2
    assert re.fullmatch(r"Mr [A-Z]\. \w+ and Mr [A-Z]\.([A-Z])\.\1\. \w+ came", replaced[5].text)
    assert re.fullmatch(r"Herr \w+ van \w+ came", replaced[7].text)
    assert replaced[9].text.split()[1].isupper()
    assert len(replaced[10].text) == len(PRIVATE[10][0])


def test_short_mentions_keep_the_family(spark):
    rows = [(1, "Mrs Anna Smith met Mrs Smith's friend Dr Anna Brown."), (2, "Mr Smith and Mrs Anna Smith; Mrs Clara Smith.")]
    out = {r.doc_id: r.text for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    given, family, given_of_brown, brown = re.fullmatch(r"Mrs (\w+) (\w+) met Mrs \2's friend Dr (\w+) (\w+)\.", out[1]).groups()
    assert given == given_of_brown and brown != family and given in pii.GIVEN["Latn", "f"]
    clara = re.fullmatch(rf"Mr {family} and Mrs {given} {family}; Mrs (\w+) {family}\.", out[2]).group(1)
    assert clara != given


def test_many_names_stay_distinct(spark):
    """More given names than the lists hold: names grow, none is shared, none is a real one."""
    ids = spark.range(3000).select(F.concat(F.lit("q"), F.lower(F.hex("id"))).alias("core"), "id")
    given = ids.select(F.lit("given").alias("kind"), "core", F.when(F.col("id") % 2 == 0, "f").otherwise("m").alias("gender"))
    real = spark.createDataFrame([("given", n.lower(), "f") for n in pii.GIVEN["Latn", "f"][:9]], given.schema)
    made = pii.surrogate_table(given.unionByName(real), "k").collect()
    assert len({r.made for r in made}) == len(made) == 3009
    assert not {r.made.lower() for r in made} & {r.core for r in made}
    assert all(r.made.endswith("a") for r in made if r.gender == "f")


def test_keys(spark):
    docs = spark.createDataFrame([(1, "Mrs Anna Smith, card 4111 1111 1111 1111")], "doc_id long, text string")
    one, same, other, fresh = (pii.surrogates(docs, k).first().text for k in ("a", "a", "b", None))
    assert one == same and len({one, other, fresh}) == 3


def test_clashing_columns_and_repeated_rows(spark):
    names = "news found mention kind core made l_id l_check own_id own_check check_of_row row nth kinds".split()
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t, *names) for i, t in [(1, "Mr Ivan Smith"), (1, "Mr Ivan Smith"), (None, "Mr Ivan Smith"), (2, None), (3, "plain")]]
    out = pii.surrogates(spark.createDataFrame(rows, schema), "k").collect()
    assert sorted(out[0].asDict()) == sorted(["doc_id", "text", *names, "n_entities"])
    assert all(r.news == "news" and r.row == "row" and r.own_id == "own_id" for r in out)
    assert len({r.text for r in out if r.text and r.text != "plain"}) == 1 and sum(r.n_entities for r in out) == 3


def test_long_runs_of_capitals(spark):
    """A heading of 20,000 capitalised words, and a title at its start, ends the run in no stack."""
    text = "Mr " + " ".join(["Word-Word"] * 20_000) + " Mrs Smith"
    out = pii.surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert out.n_entities == 2 and "Smith" not in out.text and out.text.startswith("Mr ")
