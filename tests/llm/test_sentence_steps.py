from __future__ import annotations

import numpy as np
import pytest
import sentencepiece

from claimsieve.llm import sentence_pieces


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.PieceModel(sentence_pieces.load())


WORDS = ["internationalisation", "understanding", "counterrevolutionary", "qzxvkj", "straße", "中文字", "a"]


def test_a_place_that_is_reached_asks_for_no_further_step(model):
    asked, steps = [], model.steps

    def counted(before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        asked.append(len(piece))
        return steps(before, piece)

    model.steps = counted
    try:
        found = model.encode_words([sentence_pieces.GAP + w for w in WORDS])
    finally:
        del model.steps
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    assert [np.frombuffer(ids, dtype=np.int32).tolist() for ids in found] == library.encode(WORDS)
    assert sum(asked) < 2.5 * sum(len(w) + 1 for w in WORDS)


def test_every_piece_is_found_by_its_hash(model):
    names = [*model.ids]
    hashes = np.array([model.hash(s) for s in names], dtype=np.uint64)
    assert model.find(hashes).tolist() == [model.ids[s] for s in names]
    assert (model.find(hashes ^ np.uint64(1 << 40)) == -1).sum() >= len(names) - 1


def test_unigram_weights_choose_the_heaviest_path(model):
    """The recurrence without merges against the one letter by letter."""
    model.merges = False
    try:
        words = [sentence_pieces.GAP + w for w in WORDS]
        assert model.encode_words(words) == [model.backtrace(w, "", "", sentence_pieces.START, sentence_pieces.START) for w in words]
    finally:
        model.merges = True


def test_ids_are_spelled_by_the_worker_that_made_them(spark, monkeypatch):
    """A second Python step over all rows would hold a second worker in every task."""
    monkeypatch.setattr(sentence_pieces, "CHUNK", 64)
    rows = [(1, "plain words " * 3), (2, None), (3, ""), (4, "a▁b 中文字\x00"), (5, "understanding " * 40), (5, "understanding " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = sentence_pieces.encode(docs, sentence_pieces.load(), chunk=64, spelled=True)
    got = {(r.doc_id, tuple(r.token_ids), r.text) for r in encoded.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    assert got == {(d, tuple(library.encode(t or "")), (t or "").replace("▁", " ")) for d, t in rows}
    assert encoded.count() == len(rows)
    plan = sentence_pieces.digest(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("MapInArrow")
    assert sorted((r.doc_id, r.round_trip) for r in sentence_pieces.digest(docs).collect()) == [
        (1, True), (2, True), (3, True), (4, False), (5, True), (5, True),
    ]
