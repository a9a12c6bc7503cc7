"""The stages on whole tables, each against a plain version of itself."""

import numpy as np
import sentencepiece
import public_tokenizers

import corpus_pipeline as P
from cilens.llm import decontaminate, sentencepieces
from cilens.llm.common import cut_lineage, table

from test_shingles import plain_roots  # noqa: E402


def test_stages(spark, folder):
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "sentencepiece"]
    docs = table(spark, folder, "documents")
    columns, held = docs.columns, [docs]
    for _, stage in P.STAGES:
        held.append(cut_lineage(stage(spark, held[-1], folder)))
    assert all(df.columns == columns for df in held[:-1])
    rows = [{r.doc_id: r for r in df.collect()} for df in held]

    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    assert np.mean([(i in rows[1]) == (y == 1) for i, y in labels.items()]) >= 0.95

    ids = sorted(rows[1])
    root = plain_roots([rows[1][i].text or "" for i in ids])
    assert set(rows[2]) == {ids[k] for k in set(root)}

    items = decontaminate.Items([(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()])
    leaks = {ids[0] for ids in decontaminate.search([r.text or "" for r in rows[2].values()], items)}
    assert set(rows[3]) == {i for k, i in enumerate(rows[2]) if k not in leaks}

    assert set(rows[4]) == set(rows[3]) and all(r.n_chars == len(r.text or "") for r in rows[4].values())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepieces.MODEL))
    assert {i: r.ids for i, r in rows[5].items()} == {i: library.encode(r.text or "") for i, r in rows[4].items()}
    assert all(r.round_trip for r in rows[5].values())


def test_stages_on_odd_rows(spark, odd, nothing, folder):
    for df in (odd, nothing):
        for name, stage in P.STAGES:
            out = stage(spark, df, folder)
            assert out.columns == df.columns or name == "sentencepiece"
            assert out.count() <= df.count()
