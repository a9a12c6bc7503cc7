"""The classifier on held-out rows, and its features against a plain count."""

import zlib

import numpy as np
import pyarrow.parquet as pq

from cilens.llm import common, quality


def test_weights_tell_held_out_documents(folder):
    text = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in labels}
    weights = quality.follow_the_leader([(*quality.sparse_row(text[i].encode()), float(y)) for i, y in labels.items() if not out[i]])
    ids = [i for i in labels if out[i]]
    right = (quality.dot_products([text[i].encode() for i in ids], weights) >= 0) == np.array([labels[i] == 1 for i in ids])
    assert right.mean() >= 0.9


def test_a_score_is_the_dot_product_of_the_sparse_row():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << quality.BITS) + 1)
    texts = ["", " ", "a", "The the THE!! the,", "é É 12 12 x" * 40, "a b c\nd e f"]
    for text in texts:
        i, x = quality.sparse_row(text.encode())
        alone = quality.dot_products([text.encode()], weights)[0]
        assert np.isclose(alone, weights[i] @ x.astype(float) + weights[-1], atol=1e-4)
    assert np.allclose(quality.dot_products([t.encode() for t in texts], weights), [quality.dot_products([t.encode()], weights)[0] for t in texts])


def test_long_texts_are_cut_without_loss(monkeypatch):
    weights = np.random.default_rng(2).normal(size=(1 << quality.BITS) + 1)
    text = ("some words go on, and ON!! " * 400).encode()
    whole = quality.dot_products([text], weights)
    monkeypatch.setattr(quality, "STEP_BYTES", 1000)
    monkeypatch.setattr(quality, "blocks", lambda t: common.blocks(t, 1000))
    assert np.allclose(quality.dot_products([text], weights), whole)


def test_odd_rows(spark, odd, nothing, folder):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (4, None)], "doc_id int, quality int")
    weights = quality.train(odd, labels)
    scored = quality.score(odd, weights)
    assert sorted(scored.columns) == sorted(odd.columns) and scored.count() == 9
    empty = {r.score for r in scored.where("text is null or text = ''").collect()}
    assert len(empty) == 1
    assert quality.score(nothing, weights).count() == 0 and quality.good(odd, weights, 0.0).count() == 9
    untaught = quality.train(nothing, labels.limit(0))
    assert not untaught.any() and {r.score for r in quality.score(odd, untaught).collect()} == {0.5}


def test_query_learns_from_its_share_only(spark, folder):
    rows = quality.query(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in rows)
