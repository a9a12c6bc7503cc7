"""Pieces, spans and normalisation against the library."""

import random
from itertools import product

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from cilens.llm import sentencepieces as S

TEXTS = ["", " ", "  two  spaces ", "é日本語 𝄞 a\tb\nc", "a" * 50 + " ▁▁x", "<s> </s>"]


def texts(n):
    rng = random.Random(3)
    bits = ["a", " ", "the", "é", "𝄞", "\n", "▁", "<s>", "\t", "日", "̀", "　", "ﬁ", "①"]
    return TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_spans_equal_the_library():
    own = S.pieces(public_tokenizers.path(S.MODEL))
    for text in texts(1500):
        ids = own.library.encode(text)
        start, end = own.spans(text, ids)
        assert list(zip(start.tolist(), end.tolist())) == [(p.begin, p.end) for p in own.library.encode(text, return_type="proto").pieces]
        assert "".join(text.encode()[s:e].decode() for s, e in zip(start, end)) == text


@pytest.mark.parametrize("rule", ["nmt_nfkc", "identity"])
def test_normalisation_equals_the_library(rule):
    for prefix, trim, escape in product((False, True), repeat=3):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=trim, escape_whitespaces=escape)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(library.serialized_model_proto())
        own = S.Normaliser.of(model)
        for text in texts(150):
            want, places = library.Normalize(text, with_offsets=True)
            got, at = own(text.encode())
            plain = got.decode()
            assert plain == want
            assert list(places) == [len(text.encode()[:at[len(plain[:k].encode())]].decode()) for k in range(len(plain) + 1)]


def test_query_equals_the_library(spark, folder):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(S.MODEL))
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = S.query(spark, folder).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, odd, nothing):
    found = S.encode(odd)
    assert all(r.round_trip and len(r.ids) == len(r.starts) == len(r.ends) for r in found.collect())
    assert sorted(r.text for r in S.decode(found).collect()) == sorted(r.text or "" for r in odd.collect())
    assert S.encode(nothing).count() == 0 and S.digests(nothing).count() == 0 and S.digests(odd).count() == 9
