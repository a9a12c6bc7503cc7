"""Near duplicates against all pairs in plain Python."""

import random

import numpy as np
import pytest
import xxhash

from cilens.llm import simhash
from cilens.llm.components import components


def plain_fingerprint(text, shingle=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, most=4):
    """Smallest index reachable over pairs that differ in few bits."""
    root = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= most and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def near_copies(rng, groups, size):
    texts = []
    for _ in range(groups):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(size):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(own))
    return texts


def test_fingerprint_follows_its_definition():
    rng = random.Random(1)
    for text in ["", " ", "a", "A b", "É é", "a b c d e", *near_copies(rng, 3, 2)]:
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_every_close_pair_shares_a_pattern_and_passes_the_ring():
    rng = random.Random(2)
    masks = [m % (1 << 64) for m in simhash._patterns()]
    assert len(masks) == 35
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)
        assert simhash.ring_holds(np.array([a ^ b], np.uint64))[0]
        assert simhash.linked(np.array([a], np.uint64), np.array([b], np.uint64))[0]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2, 5])
def test_classes_equal_all_pairs_also_where_buckets_are_crowded(spark, bucket):
    texts = near_copies(random.Random(3), 6, 25) + ["", " ", "only one"]
    rows = [(1000 - 3 * k, t) for k, t in enumerate(texts)]
    prints = [plain_fingerprint(t) for _, t in rows]
    root = roots(prints)
    least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in found} == {rows[k][0]: (prints[k], least[root[k]]) for k in range(len(rows))}
    assert len(set(root)) < len(set(prints))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(200)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7), (0, 1)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(201)} | {k: 5000 for k in range(5000, 5100)}


def test_odd_rows(spark, odd, nothing):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 9 and simhash.near_duplicates(nothing).count() == 0
    assert {r.component_id for r in found if r.fp == 0} == {1}  # null, empty and blank texts are one group
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, "no id"), (1, ""), (4, "same words here again and again"),
                                                                                   (4, "one id, another text"), (5, "é日本語 𝄞 a\tb\r\nc")])
    assert simhash.one_of_each(nothing).count() == 0


def test_larger_buckets_are_picked_out_before_the_shuffle(spark, monkeypatch):
    texts = near_copies(random.Random(5), 4, 20)
    prints = spark.createDataFrame([(simhash.fingerprint(t),) for t in texts], "fp long").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the tables are too large for it
    try:
        found = simhash.links(prints)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(simhash, "SENT_BYTES", 0)
        other = simhash.links(prints)
        assert "SortMergeJoin" in other._jdf.queryExecution().executedPlan().toString()
        classes = [sorted(map(tuple, components(df).collect())) for df in (found, other)]
        assert classes[0] == classes[1] and classes[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
