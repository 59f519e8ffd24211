"""Columns of the caller keep their values, whatever names the operators use inside."""

from __future__ import annotations

import pytest

from claimsieve.llm import exact_dedup, license_scan, line_dedup, mixing, ngram_join, pii, quality, toxicity

NAMES = (
    "label n weight check digest keep_id place bucket slot draw block phase position p_place w_place w_source r_place ranges o_place nth "
    "covered c_id c_check check_of_row own_id own_check row news found l_id b_first s_id kept_0 m_id m_check words_of_row stats_of_row "
    "text_of_row n_shingles component_id h size keep core kind"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["cc by a line\nb\nc", "cc by a line\nb\nc", "Mr Ivan Smith here", None, ""]
    rows = [(i, t, "a" if i % 2 else None, *NAMES) for i, t in enumerate(texts)] + [(None, "no id", "a", *NAMES)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string" + "".join(f", {n} string" for n in NAMES))


def fitted(module, fit):
    def apply(docs):
        labels = docs.sparkSession.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
        return module.scored(docs, getattr(module, fit)(docs, labels))

    return apply


@pytest.mark.parametrize(
    "operator",
    [
        license_scan.license_scan, line_dedup.line_dedup, pii.surrogates, exact_dedup.keep_first, ngram_join.one_per_component,
        lambda d: mixing.mixed(d, {"a": 1.0}), fitted(quality, "fit_quality"), fitted(toxicity, "fit_toxicity"),
    ],
    ids=["op1", "op3", "op9", "op10", "op4", "op6", "op5", "op7"],
)
def test_clashing_columns(docs, operator):
    out = operator(docs)
    rows = out.collect()
    assert rows and len(set(out.columns)) == len(out.columns)
    assert all(r[n] == n for r in rows for n in NAMES)
