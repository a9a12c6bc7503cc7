"""The ledger against plain regular expressions, and what an update leaves unscanned."""

import hashlib
import random
import re

import pytest

from cilens.llm import secret_scan as S
from cilens.llm.common import scratch_path

PLAIN = (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"))


def plain(text):
    """Spans of the base rules, (start, kind, end)."""
    spans = [(m.start(), 0, m.end()) for m in PLAIN[0].finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in PLAIN[1].finditer(text) if len(m.group()) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in PLAIN[2].finditer(text) if len(m.group()) >= 24])


def report(spark, docs):
    ledger = S.Ledger(spark, scratch_path(spark, "blobs"))
    return S.located(S.update(ledger, docs), ledger).collect()


def test_query_against_plain_expressions(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = S.query(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        spans = plain(texts[r.doc_id])
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == want for _, k, _ in spans) for want in range(3))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_random_texts_long_ones_and_wide_characters(spark):
    rng = random.Random(3)
    parts = ["token", "Secret", "API_KEY", "apikey", ":", "=", " ", "'", '"', "abc", "abcdef0123", "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "é", "𝄞", "\n", "ſecret", "_", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)]
    texts += ["secret: token: abcdefgh", "𝄞 token=" + "x" * 500_000, "password=abcdef " * 40_000, "word " * 200_000 + "passwd: hunter22"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: [tuple(p) for p in r.places if p["rank"] < 3] for r in report(spark, docs)}
    assert all(found[k] == plain(t) for k, t in enumerate(texts))
    assert len(found[402]) == 40_000


def test_updates_scan_only_unseen_pairs_and_findings_reach_all_paths(spark):
    ledger = S.Ledger(spark, scratch_path(spark, "blobs"), "repo string, path string")
    docs = lambda rows: spark.createDataFrame(rows, "repo string, path string, text string")
    first = [("r", "a", "token=abcdef1"), ("r", "b", "token=abcdef1"), ("r", "c", "plain"), ("r", "d", None)]
    second = [("r", "a", "changed password=hunter22"), ("s", "moved", "token=abcdef1"), ("r", "c", "plain")]
    S.update(ledger, docs(first), S.BASE[:1])
    address = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.blob for r in ledger.read("scans").collect()} == {address(t) for _, _, t in first}
    S.update(ledger, docs(second), S.BASE[:1])
    scans = [(r.blob, k) for r in ledger.read("scans").collect() for k in r.rules]
    assert len(scans) == len(set(scans)) == 4
    # a new rule version scans all of the blobs it is shown, an old one none of them
    changed = S.Rule("assign", S.BASE[0].pattern, 2, 12, version=2)
    S.update(ledger, docs(first + second), (*S.BASE[:1], changed))
    scans = [(r.blob, k) for r in ledger.read("scans").collect() for k in r.rules]
    assert len(scans) == len(set(scans)) == 8 and sum(k == "assign@2" for _, k in scans) == 4
    every = ledger.read("paths")
    held = {(r.repo, r.path, len(r.places)) for r in S.located(every, ledger, S.BASE[:1]).collect()}
    assert held == {("r", "a", 1), ("r", "b", 1), ("r", "c", 0), ("r", "d", 0), ("s", "moved", 1)}
    assert sum(len(r.places) for r in S.located(every, ledger, (changed,)).collect()) == 0
    assert every.count() == 2 * len(first + second)  # each version recorded each time
    # an update that died after its findings were written is repeated without counting twice
    ledger.append("findings", ledger.read("findings"))
    assert {len(r.places) for r in S.located(every, ledger, S.BASE[:1]).collect()} == {0, 1}


def test_odd_rows_and_a_hot_blob(spark, odd, nothing):
    assert len(report(spark, odd)) == 9 and report(spark, nothing) == []
    docs = spark.range(5000).selectExpr("id doc_id", "if(id % 3 = 0, concat('token=abcdef', id), 'one secret=abcdefgh') text")
    rows = report(spark, docs)
    assert len(rows) == 5000 and all(len(r.places) == 1 for r in rows)


def test_only_expressions_are_used(spark, odd):
    ledger = S.Ledger(spark, scratch_path(spark, "blobs"))
    texts = odd.selectExpr("sha2(text, 256) blob", "text", "array('assign@1') todo")
    for df in (S.matches(texts, S.RULES), S.located(S.update(ledger, odd), ledger)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("rule", S.RULES, ids=lambda r: r.name)
def test_rules_carry_their_version(rule):
    assert rule.key == f"{rule.name}@1" and re.compile(rule.pattern).groups >= rule.group
