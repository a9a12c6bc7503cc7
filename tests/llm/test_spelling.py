"""Spelling variants against plain loops over all words and all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cilens.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(rows):
    count = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_near(words):
    """Words near each word, by comparing it with all that equal it in one place of two."""
    halves = {}
    for w in words:  # one edit leaves the first or the last three characters as they are
        for key in (w[:3], w[-3:] + "$"):
            halves.setdefault(key, []).append(w)
    return {w: {v for key in (w[:3], w[-3:] + "$") for v in halves[key] if one_edit(w, v)} for w in words}


def plain(rows):
    words = plain_words(rows)
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None)
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_plain_loops(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert found(S.query(spark, folder)) == plain(docs)


def test_chains_of_forms_and_random_words(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abÉé", k=rng.randint(6, 9))) for _ in range(300)] + ["ÀÿÀÿÀÿÀÿ", "×÷×÷×÷×÷"]
    text = " ".join(rng.choices(words, [rng.choice((1, 3, 40)) for _ in words], k=6000))
    chain = " ".join(["plurals"] * 2 + ["plurale"] * 25 + ["plurage"] * 300 + ["plumage"] * 4000)
    rows = [(k, text[k * 500:(k + 1) * 500]) for k in range(200)] + [(None, chain), (None, chain), (7, None), (8, ""), (9, "𝄞zebrafish日zebrafish" * 3)]
    want = plain(rows)
    assert want["plurals"][:2] == ("plurale", "plumage")
    docs = spark.createDataFrame([(i, t, 1, "w", "near") for i, t in rows], "doc_id int, text string, n int, word string, form string").repartition(3)
    assert found(S.variants(docs)) == want


@pytest.mark.parametrize("parts", [3, 7, 12])
def test_signatures_lose_no_near_pair(spark, parts):
    rng = random.Random(parts)
    words = {"".join(rng.choices("abcdeé", k=rng.randint(7, 8))) for _ in range(400)} | {"a" * 9, "a" * 8, "b" + "a" * 8}
    words |= {w[:k] + rng.choice("abzÿ") + w[k + 1:] for w in list(words)[:200] for k in (0, 3)} | {w[1:] for w in list(words)[:100]}
    words = sorted(w for w in words if len(w) >= 7)
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    pairs = {(r.a, r.b) for r in S.near_pairs(table, parts).collect()}
    assert pairs == {(a, b) for i, a in enumerate(words) for b in words[i + 1:] if one_edit(a, b)}


def test_signatures_tell_words_apart(spark):
    rng = random.Random(2)
    words = spark.createDataFrame([("".join(rng.choices("abcdefghijklmnop", k=14)), 2) for _ in range(500)], "word string, n bigint")
    sigs = S.signatures(words, S.balanced_parts(words))
    assert sigs.count() == 500 * 21 and sigs.select("sig").distinct().count() > 0.99 * 500 * 21


def test_long_texts_and_long_runs(spark, monkeypatch):
    monkeypatch.setattr(S, "STEP", 1000)
    text = "alphabet, " * 300 + "é" * 2500 + " alphabet" * 200 + "\n" + "x" * 999 + "Ç" + "y" * 5000
    assert [b"".join(S._pieces(t)) for t in (text.encode(), b"", b"a" * 5000)] == [text.encode(), b"", b"a" * 5000]
    for piece in S._pieces(text.encode()):
        piece.decode()
    cols = {"id": _column(["4"]), "text": _column([text])}
    got = Counter()
    for out in S._counted(cols):
        for w, n in zip(out["word"].to_pylist(), out["n"].to_pylist()):
            got[w] += n
    assert {w: n for w, n in got.items() if n >= 2} == plain_words([(4, text)])
    assert len(max(got, key=len)) in (5999, 6000)


def _column(values):
    import pyarrow as pa

    return pa.array(values)


def test_checksums_equal_the_library():
    data = np.frombuffer(bytes(random.Random(1).randbytes(4000)), np.uint8)
    start = np.array([0, 5, 5, 17, 100, 200], np.int64)
    end = np.array([0, 6, 40, 24, 3900, 264], np.int64)
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(6)], np.uint32)
    assert S._checksums(data, start, end, before).tolist() == [zlib.crc32(data[a:b].tobytes(), zlib.crc32(b"%d:" % k)) for k, (a, b) in enumerate(zip(start, end))]


def test_odd_rows(spark, odd, nothing):
    assert found(S.variants(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert S.variants(nothing).count() == 0
