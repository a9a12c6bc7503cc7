"""Entities against the plain patterns, disclosure against counts by hand."""

import hashlib
import math
import random
import re

from cilens.llm import pii

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_entities(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(part) > 255 for part in m.group().split(".")) or kind == 3 and not 10 <= len(digits) <= 15:
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_entities_equal_the_plain_patterns():
    rng, found = random.Random(1), 0
    bits = ["1", "22", "255", "256", "0", ".", ".", "-", " ", "@", "@", "a", "b.c", "+", "(", ")", "%", "é", "\n", "4111111111111111", "999", "000"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
        want = plain_entities(text)
        found += len(want)
        assert pii.entities(text) == want
    assert found > 5000


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1.2.3" * 60_000, "+" * 300_000, "@" * 300_000, "+1" + " " * 300_000):
        pii.entities(text)


def filler(rng):
    return " ".join(f"word{chr(97 + rng.randrange(8))}{chr(97 + rng.randrange(8))}" for _ in range(30))


def test_terms_that_only_stand_near_an_entity_are_found(spark):
    rng = random.Random(2)
    rows = [(k, filler(rng)) for k in range(200)]
    # two contexts give Zanzibar away; Once is seen in one context alone, copies of it included
    rows += [(300 + k, f"{filler(rng)} Zanzibar boss.man@corp.example.com {filler(rng)}") for k in range(4)]
    rows += [(400 + k, "Once 10.1.2.3 upon") for k in range(3)]
    found = {r.doc_id: r for r in pii.spans(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    text = dict(rows)
    for k in range(300, 304):
        words = {text[k][m.s:m.e]: m.k for m in found[k].more}
        assert words.get("Zanzibar") == 5 and not any(w.startswith("word") and n == 5 for w, n in words.items())
    assert not any(found[k].more for k in [*range(200), 400, 401, 402])
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert "Zanzibar" not in clean[300] and "[EMAIL]" in clean[300] and clean[400] == "Once [IP] upon" and clean[5] == text[5]


def plain_telling(texts):
    """Terms and what becomes of them, by counting pairs of entity and term in plain loops."""
    held, near, counts = {}, {}, {}
    for i, text in enumerate(texts):
        spans = pii.entities(text)
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer("[A-Za-z\u0080-\U0010ffff]{3,}", text)]
        for word in {w for _, _, w in words}:
            counts[word] = counts.get(word, 0) + 1
        free = [w for w in words if all(w[1] <= x or w[0] >= y for x, _, y in spans)]
        for s, k, e in spans:
            name = (k, text[s:e].lower())
            held.setdefault(name, set()).add(i)
            around = [w for w in free if w[1] <= s][-pii.REACH:] + [w for w in free if w[0] >= e][:pii.REACH]
            for _, _, word in around:
                near.setdefault((name, word), []).append((i, frozenset(w for _, _, w in around) - {word}))
    out = {}
    for (name, word), seen in near.items():
        n, total = len({i for i, _ in seen}), counts[word]
        share, z = n / total, pii.SURE ** 2
        low = (share + z / (2 * total) - pii.SURE * ((share * (1 - share) + z / (4 * total)) / total) ** 0.5) / (1 + z / total)
        most = math.log(len(texts) / len(held[name]))
        d = math.log(n * len(texts) / (total * len(held[name]))) / most if most > 0 else 0
        # contexts of these texts either hardly meet or are near copies
        unrelated = any(len(a & b) < 0.5 * len(a | b) for _, a in seen for _, b in seen)
        if unrelated and low >= pii.SHARE and d >= pii.GENERALISE:
            out[word] = max(out.get(word, 0), 5 if d >= pii.REMOVE else 4)
    return out


def test_disclosure_equals_counts_in_plain_loops(spark):
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    vocabulary = [letters(6) for _ in range(3000)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [words(20) for _ in range(300)]
    texts += [f"{words(9)} quarterback boss@corp.example.com {words(9)}" for _ in range(8)]
    texts += [f"{words(9)} landmark {'boss@corp.example.com' if k < 11 else ''} {words(9)}" for k in range(12)]
    texts += [f"{words(9)} sometimes {'10.1.2.3' if k < 3 else ''} {words(9)}" for k in range(14)]
    copy = f"{words(9)} oncewritten 10.9.9.9 {words(9)}".split()
    texts += [" ".join(copy[:k % 5] + [letters(5)] + copy[k % 5 + 1:]) for k in range(12)]  # near copies: one context
    found = {}
    for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        found |= {texts[r.doc_id][m.s:m.e].lower(): m.k for m in r.more}
    want = plain_telling(texts)
    assert found == want and {"quarterback", "landmark"} <= set(found) and not {"sometimes", "oncewritten"} & set(found)


def test_rare_words_near_an_entity_by_chance_stay_in_a_large_corpus(spark):
    # each rare word stands near the twice-seen entity in two of its 21 documents, beside 100,000 other documents
    rows = spark.range(100_000).selectExpr("id as doc_id", "concat('plain text number ', translate(string(id), '0123456789', 'abcdefghij')) as text")
    rng = random.Random(9)
    chance = [(200_000 + k, f"{filler(rng)} seldomly {'rare.mail@corp.example.com' if k < 2 else ''} {filler(rng)}") for k in range(21)]
    chance += [(300_000 + k, f"{filler(rng)} Zanzibar boss.man@corp.example.com {filler(rng)}") for k in range(6)]
    clean = pii.sanitised(rows.unionByName(spark.createDataFrame(chance, "doc_id bigint, text string")))
    text = {r.doc_id: r.text for r in clean.where("doc_id >= 200000").collect()}
    assert all("seldomly" in text[k] for k, _ in chance[:21]) and not any("Zanzibar" in text[k] for k, _ in chance[21:])
    assert not any("[EMAIL]" in t and "@" in t for t in text.values())
    assert clean.where("doc_id < 200000 and text not like 'plain text number%'").isEmpty()


def test_the_neighbourhood_is_counted_in_words_only():
    text = "early " + "x" * 500 + " " + "y" * 400 + " boss@corp.example.com " + "1" * 1000 + " late"
    (_, terms), = pii.nearby(text, pii.entities(text))
    assert [t[2][:5] for t in terms] == ["early", "xxxxx", "yyyyy", "late"]
    many = "1.2.3.4 " * 50_000 + "word"
    assert [t[2] for _, terms in pii.nearby(many, pii.entities(many)) for t in terms] == ["word"] * 50_000


def test_columns_that_clash_with_inner_names(spark):
    docs = spark.createDataFrame([(1, "a boss@corp.example.com", "x", "y")], "doc_id int, text string, __pii_id string, h string")
    assert pii.sanitised(docs).collect() == [(1, "a [EMAIL]", "x", "y")]


def test_document_words_count_documents():
    texts = ["a bee see bee", "", "see SEE dog", "bee"]
    words, counts = pii._document_words([t.encode() for t in texts])
    names = dict(zip(pii._hashes([w.encode() for w in ("bee", "see", "dog")]).tolist(), ("bee", "see", "dog")))
    assert {names[int(w)]: int(n) for w, n in zip(words.view("int64"), counts)} == {"bee": 2, "see": 2, "dog": 1}


def test_odd_rows(spark, odd, nothing):
    found = pii.spans(odd).collect()
    assert len(found) == 9 and not any(r.base or r.more for r in found)
    clean = pii.sanitised(odd)
    assert clean.columns == odd.columns and sorted(map(str, clean.collect())) == sorted(map(str, odd.collect()))
    assert pii.spans(nothing).count() == 0 and pii.sanitised(nothing).count() == 0


def test_masks_of_overlapping_spans():
    assert pii.masked("call +1 (523) 555-1055 now", []) == "call [PHONE] now"
    assert pii.masked("x 4111 1111 1111 1111 y", [(0, 5, 1)]) == " [CARD] y"


def test_disclosing_terms_are_masked_wherever_they_stand(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, filler(rng)) for k in range(200)]
    rows += [(300 + k, f"{filler(rng)} Zanzibar boss.man@corp.example.com {filler(rng)} é zanzibar") for k in range(40)]
    rows += [(500, "𝄞 é ZANZIBAR, zanzibars zanzibar@x.example.com"), (501, "long " * 500_000 + "Zanzibar"), (None, "Zanzibar"), (None, "Zanzibar")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for block in (pii.TERM_BLOCK, 1):
        monkeypatch.setattr(pii, "TERM_BLOCK", block)
        clean = pii.sanitised(docs).collect()
        assert len(clean) == len(rows)
        text = {r.doc_id: r.text for r in clean}
        assert not any("zanzibar" in t.lower() for i, t in text.items() if i != 500)
        assert text[500].endswith(", zanzibars [EMAIL]") and "ZANZIBAR" not in text[500] and text[500].startswith("𝄞 é ")
        assert text[5] == rows[5][1] and len(pii.spans(docs).collect()) == len(rows)


def test_query_counts_and_digests_of_whole_texts(spark, folder):
    rows = pii.query(spark, folder).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(r.n_email for r in rows) > 0 < sum(r.n_phone for r in rows)
    for r in rows:
        base = pii.entities(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(kind == k for _, kind, _ in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.span_text(base).encode()).hexdigest()
