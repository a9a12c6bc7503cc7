"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail and internet addresses, payment cards and phone numbers, found by pattern and check.
A term near an entity can give it away. Over the whole corpus, with p the share of documents, the point-wise mutual
information log p(t, e) / (p(t) p(e)) says how strongly term t reveals entity e, and the entity's own information
-log p(e) is the most it can reach. Their ratio is the disclosure of t for e, and terms are generalised from a
disclosure of ``GENERALISE`` on and removed from ``REMOVE`` on; terms that occur everywhere have a low ratio and stay.
The ratio alone rises with the corpus for any rare word, so a term must also stand near e in most of its documents:
the lower bound of the share p(e | t), at ``SURE`` standard errors, has to reach ``SHARE``, which no number of other
documents changes. And it must do so in unrelated contexts: near copies of one context, which share one of their
``CONTEXT_KEYS`` min-wise keys, count as one. A term found so is masked wherever it stands, in all documents.

One pass over the texts writes, per document, the entities and the terms within ``REACH`` words of them, and per
task the number of its documents that hold each word. What follows joins narrow tables: pairs of entity and term are
counted with a map-side combine, and word counts are summed only for terms that can still disclose something. A
second pass marks the words that are disclosing terms.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cilens.llm.common import LOWER, STEP_BYTES, arrow_schema, blocks, cut_lineage, map_rows, runs, slice_hashes, steps, table, whole_text

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
REACH = 8
GENERALISE = 0.7
REMOVE = 0.9
#: Least share of a term's documents, by its lower confidence bound, in which it stands near the entity; and that bound's width.
SHARE = 0.5
SURE = 1.96
#: Min-wise keys of a context; two contexts are unrelated if all of them differ.
CONTEXT_KEYS = 4
#: Disclosing terms that are sent to the tasks at a time.
TERM_BLOCK = 1 << 20
#: What a span's text becomes; a generalised term keeps the fact that a word stood there.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile("[A-Za-z\u0080-\U0010ffff]{3,}+")
_TURNS = np.array([2 * k * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for k in range(1, CONTEXT_KEYS + 1)], np.uint64)
_HELD = 1 << 20


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # a match holds exactly one @, so each is looked at once; the local part reaches back as far as it can
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the protected entities, by start, then kind; leftmost matches that do not overlap per kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _only_digits(m.group())) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_only_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def nearby(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[bytes, list[tuple[int, int, str]]]]:
    """For each entity its name and the terms around it, (start, end, word): the nearest ``REACH`` on either side.

    One pass over the words holds the last few and the entities that still wait for words. A word that runs into an entity is none.
    """
    around: list[tuple[list, list]] = [([], []) for _ in spans]
    last, opened, waiting, over, at = deque(maxlen=REACH), 0, [], 0, 0
    for m in _TERM.finditer(text) if spans else ():
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            over, at = max(over, spans[at][2]), at + 1
        if a < over:  # runs into an entity
            continue
        while opened < at:
            around[opened][0].extend(last)
            waiting.append(opened)
            opened += 1
        for k in waiting:
            around[k][1].append((a, b, m.group()))
        if waiting:
            waiting = [k for k in waiting if len(around[k][1]) < REACH]
        last.append((a, b, m.group()))
    for k in range(opened, len(spans)):
        around[k][0].extend(last)
    names = [f"{KINDS[k]}:{text[s:e].lower() if k < 2 else _only_digits(text[s:e])}".encode() for s, k, e in spans]
    return [(name, before + after) for name, (before, after) in zip(names, around)]


def _hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.empty(0, np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    return slice_hashes(LOWER[data], np.concatenate(([0], ends[:-1])) if words else ends, ends).view(np.int64)


def _contexts(terms: list[int]) -> list[list[int]]:
    """For each term of one context, min-wise keys of the other words in it; zeros where there are none."""
    h = np.array(terms, np.int64).view(np.uint64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.where((h[:, None] != h[None, :])[:, :, None], (h[:, None] * _TURNS)[None], none).min(axis=1, initial=none)
    return np.where(least == none, np.uint64(0), least).view(np.int64).tolist()


_SCHEMA = ("doc_id bigint, h bigint, base array<struct<s:int,k:int,e:int>>, entities array<bigint>, "
           "near array<struct<s:int,e:int,entity:bigint,term:bigint,contexts:array<bigint>,first:boolean>>, words array<bigint>, counts array<int>")


def _document_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, number of the texts that hold it)."""
    parts = []
    for a, b in steps(map(len, texts)):
        alone = b == a + 1 and len(texts[a]) > STEP_BYTES
        held = []
        for block in blocks(texts[a]) if alone else (b"\n".join(texts[a:b]),):
            data = np.frombuffer(block, np.uint8)
            start, end, kind = runs(data)
            word = (kind == 1) & (end - start >= 3)
            start, end = start[word], end[word]
            doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[a:b]]), start, side="right") if not alone else np.zeros(len(start), np.int64)
            h = slice_hashes(LOWER[data], start, end)
            # each text's words are contiguous, so sorting by word and keeping the last text seen finds the repeats
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            held.append(h[keep])
        parts.append(np.unique(np.concatenate(held)) if alone else held[0])
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _scan(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        word, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return word, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    def told(word, count):
        for a in range(0, len(word), 50_000):
            yield make([[None], [None], [None], [None], [None], [word[a:a + 50_000].view(np.int64)], [count[a:a + 50_000].astype(np.int32)]])

    for batch in batches:
        ids, text_hash, texts = (batch.column(k).to_pylist() for k in range(3))
        base, named, near = [], [], []
        for text in texts:
            spans = entities(text)
            around = nearby(text, spans)
            base.append([{"s": s, "k": k, "e": e} for s, k, e in spans])
            names = _hashes([name for name, _ in around]).tolist()
            named.append(list(set(names)))
            words = _hashes([t[2].encode("utf-8", "surrogatepass") for _, terms in around for t in terms]).tolist()
            rows, seen, at = [], set(), 0
            for name, (_, terms) in zip(names, around):
                here = words[at:at + len(terms)]
                at += len(terms)
                for (s, e, _), word, keys in zip(terms, here, _contexts(here) if here else ()):
                    rows.append({"s": s, "e": e, "entity": name, "term": word, "contexts": keys, "first": (name, word) not in seen})
                    seen.add((name, word))
            near.append(rows)
        nothing = [None] * len(ids)
        yield make([ids, text_hash, base, named, near, nothing, nothing])
        held.append(_document_words([t.encode("utf-8", "surrogatepass") for t in texts]))
        if sum(len(w) for w, _ in held) > _HELD:
            held[:] = [merged()]
            if len(held[0][0]) > _HELD // 2:
                yield from told(*held.pop())
    if held:
        yield from told(*merged())


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    whole = whole_text(docs, text)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("t"))


def _marked(texts: list[str], terms: np.ndarray, kinds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's words whose hashes are among the sorted ``terms``; words that run into an entity are none."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def among(h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        return np.where(terms[at] == h, kinds[at], 0)

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for a, b in steps(map(len, raw)):
        if b == a + 1 and len(raw[a]) > STEP_BYTES:  # word by word, so that no cut meets one
            words = _TERM.finditer(texts[a])
            while some := list(islice(words, 50_000)):
                kind = among(_hashes([m.group().encode("utf-8", "surrogatepass") for m in some]))
                out[a] += [(some[k].start(), int(kind[k]), some[k].end()) for k in np.flatnonzero(kind).tolist()]
            continue
        data = np.frombuffer(b"\n".join(raw[a:b]), np.uint8)
        start, end, sort = runs(data)
        word = (sort == 1) & (end - start >= 3)
        start, end = start[word], end[word]
        kind = among(slice_hashes(LOWER[data], start, end).view(np.int64))
        first = np.cumsum([0, *[len(t) + 1 for t in raw[a:b]]])
        for k in np.flatnonzero(kind).tolist():
            row = int(np.searchsorted(first, start[k], side="right")) - 1
            s = len(raw[a + row][:start[k] - first[row]].decode("utf-8", "surrogatepass"))
            word_text = data[start[k]:end[k]].tobytes().decode("utf-8", "surrogatepass")
            out[a + row].append((s, int(kind[k]), s + len(word_text)))
    for row, found in enumerate(out):
        if found:
            spans = entities(texts[row])
            out[row] = [(s, k, e) for s, k, e in found if all(e <= x or s >= y for x, _, y in spans)]
    return out


def _everywhere(docs: DataFrame, telling: DataFrame, text: str) -> DataFrame:
    """(doc_id, h, more): every occurrence of the disclosing terms (term, k) in any document; the texts are read once per block of terms."""
    schema = "doc_id bigint, h bigint, more array<struct<s:int,k:int,e:int>>"
    parts, found = -(-telling.count() // TERM_BLOCK), None
    for part in range(parts):
        block = telling.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).orderBy("term").toArrow()
        sent = docs.sparkSession.sparkContext.broadcast((block["term"].to_numpy(), block["k"].to_numpy()))

        def work(cols, sent=sent):
            marked = _marked(cols["t"].to_pylist(), *sent.value)
            held = [k for k, spans in enumerate(marked) if spans]
            return {"doc_id": cols["doc_id"].take(pa.array(held, pa.int64())), "h": cols["h"].take(pa.array(held, pa.int64())),
                    "more": [[{"s": s, "k": k, "e": e} for s, k, e in marked[row]] for row in held]} if held else None

        rows = map_rows(_keyed(docs, text), work, schema).dropDuplicates(["doc_id", "h"])
        found = rows if found is None else found.union(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return cut_lineage(found.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("more")).alias("more")) if parts > 1 else found)


def find(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(base, more): the entities of every row, (doc_id, h, base), and the disclosing terms, (doc_id, h, more), of rows
    that have any, once for equal rows. h is xxhash64 of the text; spans are structs of start s, kind k and end e.
    """
    scanned = cut_lineage(_keyed(docs, text).mapInArrow(partial(_scan, arrow_schema(_SCHEMA)), _SCHEMA))
    rows = scanned.where("base is not null")
    total = rows.count()
    near = rows.where("size(near) > 0").select("doc_id", "h", F.explode("near").alias("n")).select("doc_id", "h", "n.*")
    keys = [F.get("contexts", F.lit(k)) for k in range(CONTEXT_KEYS)]
    pairs = (near.groupBy("entity", "term").agg(F.sum(F.col("first").cast("bigint")).alias("n_pair"), *[F.min(k).alias(f"least{i}") for i, k in enumerate(keys)],
                                                *[F.max(k).alias(f"most{i}") for i, k in enumerate(keys)])
             .where(" and ".join(f"least{i} <> most{i}" for i in range(CONTEXT_KEYS))).select("entity", "term", "n_pair"))
    pairs = cut_lineage(pairs)
    held = rows.where("size(entities) > 0").select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    words = (scanned.where("words is not null").select(F.explode(F.arrays_zip("words", "counts")).alias("z"))
             .select(F.col("z.words").alias("term"), F.col("z.counts").alias("n")).join(pairs.select("term").distinct(), "term")
             .groupBy("term").agg(F.sum("n").alias("n_term")))
    size = F.lit(float(max(total, 1)))
    known = F.log(F.col("n_pair") * size / (F.col("n_term") * F.col("n_entity")))
    most = F.log(size / F.col("n_entity"))
    z = F.lit(SURE * SURE)
    share = F.least(F.col("n_pair") / F.col("n_term"), F.lit(1.0))
    sure = (share + z / (2 * F.col("n_term")) - F.lit(SURE) * F.sqrt((share * (1 - share) + z / (4 * F.col("n_term"))) / F.col("n_term"))) / (1 + z / F.col("n_term"))
    telling = cut_lineage(pairs.join(held, "entity").join(words, "term")
                          .withColumn("d", F.when(most > 0, known / most).otherwise(F.lit(0.0))).where((F.col("d") >= GENERALISE) & (sure >= SHARE))
                          .groupBy("term").agg(F.max(F.when(F.col("d") >= REMOVE, 5).otherwise(4)).alias("k")))
    more = _everywhere(docs, telling, text)
    return rows.select("doc_id", "h", "base"), more


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, h, base, more) for every row of ``docs``, ``more`` sorted and empty where no term discloses.

    A null text is empty. Each row counts as a document, repeated ones too, but copies and near copies of one context
    do not make a term disclosing. Null ids are kept. Other columns are not read; an empty table gives no rows.
    """
    base, more = find(docs, text)
    m = more.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.array_sort("more").alias("more"))
    out = base.join(m, base["doc_id"].eqNullSafe(m["_id"]) & (base["h"] == m["_h"]), "left")
    return out.select("doc_id", "h", "base", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>")).alias("more"))


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with entities and disclosing terms replaced by ``MASKS``; a null text stays null, other columns stay."""
    stem = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of the input, so none clashes
    more = find(docs, text)[1].toDF(f"{stem}id", f"{stem}h", f"{stem}more")
    same = docs["doc_id"].cast("bigint").eqNullSafe(more[f"{stem}id"]) & (F.xxhash64(whole_text(docs, text)) == more[f"{stem}h"])
    joined = docs.join(more, same, "left").select(*[docs[c] for c in docs.columns], more[f"{stem}more"])
    at = joined.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, terms = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            clean = [t if t is None else masked(t, [(m["s"], m["k"], m["e"]) for m in more or ()]) for t, more in zip(texts, terms)]
            columns = [pa.array(clean, c.type) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def masked(text: str, more: list[tuple[int, int, int]]) -> str:
    """The text with its entities and some further spans replaced; of overlapping spans, one mask for the whole stretch."""
    out, end = [], 0
    for s, k, e in sorted([*entities(text), *more]):
        if s >= end:
            out += [text[end:s], MASKS[KINDS[k]]]
        end = max(end, e)
    return "".join([*out, text[end:]])


def _of_kind(kind: int, span: Column) -> Column:
    return span["k"] == kind


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = spans(table(spark, folder, "documents"))
    names = F.array(*map(F.lit, KINDS))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    counts = [F.size(F.filter("base", partial(_of_kind, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        told(F.array_sort(F.concat("base", "more"))).alias("spans"))
