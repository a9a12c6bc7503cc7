"""Ids against the library, files against arrays."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cilens.llm import token_store as T
from cilens.llm.common import scratch_path

BITS = ["a", " ", " ", "the", "é", "\n", "\t", "\x1c", "\x85", "᠎", "　", "'s", "'ll", "12", "!!", "日", "<|endoftext|>", "x y", "\r", "​", "\xa0", "\nOf"]


def library_ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_parts_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(T, "_KNOWN_WORDS", 3000)  # some words are forgotten on the way
    rng = random.Random(2)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(15000)]
    encoder = T.Encoder(public_tokenizers.path(T.TOKENIZER))
    assert encoder.by_parts
    got = [ids for a in range(0, len(texts), 1000) for ids in encoder(texts[a:a + 1000])]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == library_ids(texts)


def token_file(docs, ids):
    out = io.BytesIO()
    T.encode_file(out, docs, ids)
    return T.TokenFile(pa.BufferReader(out.getvalue()))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_any_token_is_found_by_itself(n):
    rng = random.Random(n)
    ids = np.array([rng.choice([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 50256]) for _ in range(n)], "<u4")
    file = token_file([(None, 0), (7, n)], ids)
    assert [file.token(i) for i in range(n)] == ids.tolist()
    for _ in range(30):
        a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
        assert (file.tokens(a, b) == ids[a:b]).all()
    assert file.documents(0, 2)[0] == [None, 7] and file.documents(0, 2)[1].tolist() == [0, 0, n]
    with pytest.raises(IndexError):
        file.token(n)


def expected(rows):
    """Ids with the end id, in the order of the store: null ids first; rows of one id stand together."""
    out = {}
    for (i, t), ids in zip(rows, library_ids([t or "" for _, t in rows])):
        out.setdefault(i, []).append(zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
    return out


def test_store_gives_back_what_was_written(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    want = expected([tuple(r) for r in docs.collect()])
    store = scratch_path(spark, "tokens")
    T.write(docs, store, file_tokens=20_000, partitions=3)
    files = T.manifest(spark, store).collect()
    assert len(files) > 3 and sorted(f.base for f in files)[0] == 0
    rows = sorted(T.read(spark, store).collect())
    assert {r.doc_id: [r.ids_crc32] for r in rows} == want
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens


def test_odd_rows(spark, odd, nothing):
    for df, partitions in ((odd, 2), (nothing, 2)):
        store = scratch_path(spark, "tokens")
        T.write(df, store, partitions=partitions)
        rows = T.read(spark, store).collect()
        assert {i: sorted(c) for i, c in expected([(r.doc_id, r.text) for r in df.collect()]).items()} == {
            i: sorted(r.ids_crc32 for r in rows if r.doc_id == i) for i in {r.doc_id for r in rows}}
        order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i))
