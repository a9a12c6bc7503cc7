"""Leaks against the full edit-distance table."""

import random

import numpy as np
import pyarrow.parquet as pq

from cilens.llm import decontaminate as D


def least_edits(pattern, text):
    row, step = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    letters = np.frombuffer(text, np.uint8)
    for c in pattern:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (letters != c))
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def planted(rng, items, hosts, n):
    texts = []
    for k in range(n):
        t = list(items[k % len(items)][1])
        for _ in range(rng.choice([0, 3, int(0.05 * len(t)), int(0.08 * len(t)), int(0.1 * len(t)), int(0.13 * len(t)), int(0.2 * len(t))])):
            p, act = rng.randrange(len(t)), rng.random()
            if act < 0.4:
                t[p] = rng.choice("abcdefg ")
            elif act < 0.7:
                del t[p]
            else:
                t.insert(p, rng.choice("xyz,"))
        host = rng.choice(hosts)[:1500]
        cut = rng.randrange(len(host) + 1)
        texts.append(host[:cut] + " " + "".join(t).upper() + " " + host[cut:])
    return texts


def test_search_finds_exactly_what_the_table_finds(folder):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    hosts = [r["text"] or "" for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    index = D.Items(items)
    texts = planted(random.Random(4), items, hosts, 60)
    got = {(h[0], h[1]): h for h in D.search(texts, index)}
    near = 0
    for k, text in enumerate(texts):
        plain = D.normal(text)
        for n, (item_id, _) in enumerate(items):
            edits = least_edits(index.texts[n], plain)
            assert ((k, item_id) in got) == (edits <= index.budget[n])
            if edits <= index.budget[n]:
                near += edits > 0
                _, _, found, start, end = got[(k, item_id)]
                assert found == edits and least_edits(index.texts[n], D.normal(text[start:end])) == edits
    assert near >= 10


def test_places_of_normal_text():
    for text in ["", "  A--b ", "É,é!x", "İx y", "...", "a\n\nb"]:
        plain, at = D.normal(text), D.places(text)
        assert len(at) == len(plain)
        assert all(b == 32 or b >= 128 or text[i].lower().startswith(chr(b)) for b, i in zip(plain, at))


def test_odd_rows_and_blocks(spark, odd, nothing):
    item = "a passage of the benchmark that is long enough to be searched for"
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(8, f"so: {item.upper()}!"), (8, f"so: {item.upper()}!"), (9, "short")], "doc_id int, text string"))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "Short."), (5, "x" * 40)], "item_id int, text string")
    for size in (D.BLOCK_BYTES, 30):  # one block of items, and several
        found = sorted(D.contaminated(docs, bench, block_bytes=size).collect())
        assert [tuple(r) for r in found] == [(8, 1, 0, 4, 4 + len(item)), (8, 1, 0, 4, 4 + len(item)), (9, 4, 0, 0, 5)]
        assert D.clean(docs, bench, block_bytes=size).count() == 9
    assert D.contaminated(nothing, bench).count() == 0 and D.contaminated(odd, bench.limit(0)).count() == 0
    assert D.clean(odd, bench).columns == odd.columns and D.clean(nothing, bench).count() == 0
