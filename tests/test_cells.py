"""Nearest vectors through cells against the full search."""

import json

import numpy as np
import pytest

from cilens.operators import cells, retrieval

ITEMS = "item_id bigint, part string, vec array<double>"
QUERIES = "query_id bigint, part string, vec array<double>"


def clusters(count, size, dim, seed, spread=0.05):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(count, dim))
    return np.concatenate([c + spread * draw.normal(size=(size, dim)) for c in centres])


def plain(items, asked, n):
    out = []
    for q, part, vec in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(vec, w)), i) for i, p, w in items if p == part and w is not None and vec is not None and len(w) == len(vec))
        out += [(q, i, hit) for hit, (_, i) in enumerate(near[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 16])
def test_cells_find_what_a_full_search_finds(spark, block):
    x = clusters(12, 40, 6, 1)
    # most rows in one part; exact copies tie by id; another length, a null vector and a part of two rows beside them
    items = [(i, "hot", x[i].tolist()) for i in range(len(x))] + [(1000 + i, "hot", x[i].tolist()) for i in range(0, 30)]
    items += [(2000 + i, "cold", x[i].tolist()) for i in range(2)] + [(3000, "hot", [1.0, 2.0]), (3001, "hot", None)]
    asked = [(i, p, v) for i, p, v in items if i % 20 == 0] + [(9000, "none", [1.0]), (9001, "hot", [0.0, 0.0]), (9002, "hot", None)]
    index = cells.build(spark.createDataFrame(items, ITEMS), 16)
    found, seen = cells.search(index, spark.createDataFrame(asked, QUERIES), 5, block=block)
    assert sorted((r.query_id, r.item_id, r.hit) for r in found.collect()) == plain(items, asked, 5)
    share = [r for r in cells.share_seen(index, seen).collect() if json.loads(r.part) == {"part": "hot", "dim": 6}][0]
    assert share.pairs == (len(x) + 30) * len([1 for _, p, v in asked if p == "hot" and v and len(v) == 6])
    assert share.computed < 0.4 * share.pairs, "cells far away are not compared"


def test_cells_without_structure_and_repeated_rows(spark):
    draw = np.random.default_rng(4)
    items = [(i, "a", draw.integers(0, 3, 8).astype(float).tolist()) for i in range(200)]
    items += items[:5]  # repeated rows are items of their own
    asked = [(i, p, v) for i, p, v in items[:200] if i % 20 == 0]
    found, _ = cells.search(cells.build(spark.createDataFrame(items, ITEMS), 8), spark.createDataFrame(asked, QUERIES), 4)
    full = retrieval.nearest(spark.createDataFrame(items, ITEMS), spark.createDataFrame(asked, QUERIES), 4)
    assert sorted((r.query_id, r.item_id, r.cost) for r in found.collect()) == sorted((r.query_id, r.item_id, r.cost) for r in full.collect())


def test_cells_of_nothing(spark):
    index = cells.build(spark.createDataFrame([], ITEMS))
    found, _ = cells.search(index, spark.createDataFrame([(1, "a", [1.0])], QUERIES))
    assert found.count() == 0
    index = cells.build(spark.createDataFrame([(1, "a", [1.0])], ITEMS))
    assert cells.search(index, spark.createDataFrame([], QUERIES))[0].count() == 0
