"""Fingerprints against exact shares of shingles and a plain successor."""

import hashlib

import numpy as np
import pytest

from cilens.llm import minhash as M


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("buckets", [1, None])
def test_query_against_exact_shares(spark, folder, buckets):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    found = {r.doc_id: r for r in M.edited(docs, buckets=buckets).collect()}
    assert len(found) == len(rows)
    wrong, by_text = [], {}
    for k, (doc_id, text) in enumerate(rows):
        after, half, r = rows[(k + 1) % len(rows)][1], len(text) // 2, found[doc_id]
        edited = text[:len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own = shingles(text)
        wrong += [r.near_edited - share(own, shingles(edited)), r.near_next - share(own, shingles(after))]
        by_text.setdefault(text, set()).add(r.fingerprint)
    assert np.sqrt(np.mean(np.square(wrong))) < 0.05 and abs(np.mean(wrong)) < 0.01
    assert all(len(prints) == 1 for prints in by_text.values())


def test_only_expressions_are_used(spark, folder):
    plan = M.query(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_an_empty_bin_tries_all_bins_in_the_order_of_their_ranks():
    assert [row[5] for row in M._tries()] == sorted(range(M.BINS), key=lambda j: (M._rank(5, j), j))[:3]
    assert all(len({M._rank(i, j) for j in range(M.BINS)}) == M.BINS for i in range(M.BINS))


def test_densified_fingerprints_equal_a_plain_loop(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(n)) for k, n in enumerate((1, 4, 5, 6, 12, 60, 200, 900))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    words = df.selectExpr("k", "transform(split(t, ' '), w -> xxhash64(w)) w")
    hashed = {r.k: r.h for r in words.selectExpr("k", """case when size(w) < 5 then array(xxhash64(w)) else
        transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) end h""").collect()}
    for r in M.with_fingerprint(df, "t", "f").collect():
        least = {}
        for h in hashed[r.k]:
            least[(h >> 57) + 64] = min(h, least.get((h >> 57) + 64, h))
        filled = [least[i] if i in least else least[min(least, key=lambda j, i=i: (M._rank(i, j), j))] for i in range(M.BINS)]
        assert r.f == "".join(f"{h & 255:02x}" for h in filled)


def test_odd_rows(spark, odd, nothing):
    rows = M.edited(odd, buckets=3).collect()
    assert len(rows) == 9 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    twice = [r for r in rows if r.doc_id == 4 and r.n_chars == len("same words here again and again")]
    assert len(twice) == 2 and twice[0].fingerprint == twice[1].fingerprint
    assert M.edited(nothing).count() == 0 and M.edited(odd.limit(1)).count() == 1
