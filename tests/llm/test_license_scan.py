"""Families on notices that the model has not seen, and on the licence lines of documents."""

import re

import pytest

from cilens.llm import common, license_scan as L


@pytest.fixture(scope="module")
def weights(spark, folder):
    return L.train(common.table(spark, folder, "documents"))


def test_unseen_notices(weights):
    cases = {"Copyright 2020 Joe. Licensed under the Apache License, Version 2.0": "apache-2.0", "Released to the world under the MIT License.": "mit",
             "This work is licensed under the Zork Agreement.": "unknown", "Our tool is distributed under the terms of the Mozilla Public License 2.0.": "mpl-2.0"}
    assert {t: [h[7] for h in L.found_in([t], weights)] for t in cases} == {t: [f] for t, f in cases.items()}
    assert L.found_in(["the quick brown fox", "", "Is and retitioning ouen the of"], weights) == []


def test_documents_lines(spark, folder, weights):
    family = {"Apache License": "apache-2.0", "MIT License": "mit", "GNU General": "gpl", "CC BY-NC": "cc-by-nc"}
    text = {r.doc_id: r.text or "" for r in common.table(spark, folder, "documents").collect()}
    want = {(i, m.start(), m.end(), next(f for name, f in family.items() if name in m.group()))
            for i, t in text.items() for m in re.finditer(r"^(Licensed under|Released under|This work is licensed).*$", t, re.M)}
    found = {(r.doc_id, r.start, r.end, r.family) for r in L.scan(common.table(spark, folder, "documents"), weights).collect()}
    assert want and want <= found and len(found - want) <= 0.05 * len(want) + 1


def test_place_and_long_texts(weights, monkeypatch):
    text = "é ordinary words\n" * 500 + "Released under the MIT License.\nmore"
    whole = L.found_in(["x", text], weights)
    assert [(h[0], h[1], text[h[2]:h[3]], h[7]) for h in whole] == [(1, 500, "Released under the MIT License.", "mit")]
    monkeypatch.setattr(L, "STEP_BYTES", 2000)
    monkeypatch.setattr(L, "blocks", lambda t: common.blocks(t, 2000))
    assert L.found_in(["x", text], weights) == whole


def test_odd_rows(spark, odd, nothing, weights):
    assert L.scan(odd, weights).count() == 0 and L.scan(nothing, weights).count() == 0
    assert L.train(nothing).shape == weights.shape
