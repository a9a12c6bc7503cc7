"""Whitening against plain matrices and exact whole numbers."""

import math

import numpy as np
import pytest

from cilens.llm import whitening as W


def plain(vectors, weights):
    """{x: (n, deviation, whitened up to sign, explained)} by plain loops over the distinct vectors."""
    distinct = {}
    for v in vectors:
        x = tuple(math.floor(256 * c) for c in v)
        distinct[x] = distinct.get(x, 0) + 1
    if weights == "one":
        distinct = dict.fromkeys(distinct, 1)
    n, d = sum(distinct.values()), len(next(iter(distinct)))
    total = [sum(w * x[j] for x, w in distinct.items()) for j in range(d)]
    x, w = np.array(list(distinct), float), np.array(list(distinct.values()), float)
    centred = x - np.array(total) / n
    cov = (centred * w[:, None]).T @ centred / n
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(-values)[:4]
    z = centred @ directions[:, order] / np.sqrt(values[order])
    return {k: (n, sum((n * k[j] - total[j]) ** 2 for j in range(d)), z[i], values[order] / np.trace(cov)) for i, k in enumerate(distinct)}


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_against_plain_matrices(spark, weights):
    rng = np.random.default_rng(5)
    vectors = [[float(c) for c in np.float32(rng.normal(size=6) * [9, 5, 3, 2, 1, .5] - 2)] for _ in range(300)]
    vectors += vectors[:40] + [vectors[7]] * 500
    rows = list(enumerate(vectors)) + [(9000, None), (9001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9002, [float("nan")] * 6), (9003, [float("inf")] + [0.0] * 5)]
    docs = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id int, embedding array<float>, x int, n string").repartition(5)
    want, found = plain(vectors, weights), {}
    for r in W.whitened(docs, weights=weights).collect():
        found.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(found) == list(range(len(vectors)))
    signs = [None] * 4
    for i, v in enumerate(vectors):
        n, deviation, z, explained = want[tuple(math.floor(256 * c) for c in v)]
        assert sorted(found[i]) == [1, 2, 3, 4]
        for k in range(4):
            r = found[i][k + 1]
            signs[k] = signs[k] or (1 if r.whitened * z[k] > 0 else -1)
            assert (r.n, r.deviation) == (n, deviation) and abs(signs[k] * r.whitened - z[k]) < 1e-8
            assert abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-9


def test_query_covers_every_row(spark, folder):
    rows = W.query(spark, folder).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    want = plain(list(vectors.values()), "one")
    assert len(rows) == 4 * len(vectors) and max(r.identity_error for r in rows) <= 1e-9
    assert all((r.n, r.deviation) == want[tuple(math.floor(256 * c) for c in vectors[r.vec_id])][:2] for r in rows)


def test_odd_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert W.whitened(make([])).count() == 0 and W.whitened(make([(1, None), (2, [])])).count() == 0
    alone = W.whitened(make([(None, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(alone, key=lambda r: r.component)][::2] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # lengths do not mix, a flat direction has no whitened value, and huge entries do not crash
    mixed = W.whitened(make([(1, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [5.0]), (4, [6.0]), (5, [7.0]), (6, [1e300, 0.0, 1.0]), (7, [-1e300, 0.0, 1.0])])).collect()
    by = {(r.vec_id, r.component): r for r in mixed}
    assert len(by) == 2 * 2 + 3 + 2 * 3 and by[1, 1].n == 2 and by[3, 1].n == 3
    assert abs(by[1, 1].whitened) == abs(by[2, 1].whitened) == 1 and by[1, 2].whitened is None and by[1, 2].explained == 0
    assert by[6, 1].deviation is None and abs(by[6, 1].whitened) == pytest.approx(1)
    assert by[4, 1].deviation == 0 and by[3, 1].identity_error < 1e-12


def test_packing_is_exact():
    import pyarrow as pa

    rows = [[0.0, -0.0], [127.99, -128.0], [128.0, 1.0], [8388608.0, 2.0], [-0.001, 0.001]]
    got = W._packed({"id": pa.array(range(5)), "v": pa.array(rows)})
    assert [W.unpack(x).tolist() for x in got["x"]] == [[math.floor(256 * c) for c in row] for row in rows]
    assert [x[0] for x in got["x"]] == [2, 2, 4, 8, 2]
