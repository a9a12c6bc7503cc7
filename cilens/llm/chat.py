"""Transcript parsing: a hidden Markov model recovers who speaks, and turns are rendered in one canonical form.

A row's text is cut into blocks at lines that begin with a speaker marker. A block shows its marker, if any, its
length, its number of lines, whether it ends in a question and whether it holds code. The hidden states are roles;
start, transition and emission probabilities are smoothed counts over conversations whose roles are given, the
held-out third left aside, and the most likely roles of a conversation are found by Viterbi.

A conversation of any length is cut into segments of ``SEGMENT`` rows. The best path through a segment, for each role
before it and each role at its end, is a small matrix, and matrices of neighbouring segments combine, so a tree of
them gives the best path's roles at all segment ends; each segment is then decoded by itself.
"""

from __future__ import annotations

import re
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cilens.llm.common import cut_lineage, map_rows, table, whole_text
from cilens.operators.prefix import positions

ROLES = ("system", "user", "assistant", "tool")
SEGMENT = 512
#: Names that speakers go by; the first letters alone count only before a colon.
NAMES = {
    "system": ("system", "sys", "instruction"),
    "user": ("user", "human", "question", "customer", "client", "prompter", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "model", "agent", "a"),
    "tool": ("tool", "function", "observation"),
}
_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
_ANY = "|".join(sorted(_OF, key=len, reverse=True))
_LONG = "|".join(sorted((n for n in _OF if len(n) > 1), key=len, reverse=True))
_MARKER = re.compile(
    rf"^[ \t]*(?:\[?\d{{1,2}}:\d\d(?::\d\d)?\]?[ \t]+)?(?:"
    rf"(?:\#{{1,6}}[ \t]*)?(?:\*\*|__)?(?P<colon>{_ANY})(?:\*\*|__)?[ \t]*:(?:\*\*|__)?"
    rf"|<\|(?:im_start\|>|start_header_id\|>)?(?P<tag>{_LONG})(?:\|>|<\|end_header_id\|>|$)"
    rf"|\[(?P<bracket>{_LONG})\][ \t]*:?"
    rf"|\#{{1,6}}[ \t]*(?P<heading>{_LONG})[ \t]*$)", re.I | re.M)
_END = re.compile(r"<\|(?:im_end|eot_id|end)\|>[ \t]*")
_LENGTHS, _LINES = 16, 4
_PLAIN_WEIGHT = 0.5
_MARKED_WEIGHT = 1000.0


def blocks(text: str) -> list[tuple[int, str]]:
    """(marker, content) of a text's blocks: marker 0 is none, else one more than the number of its role."""
    found = [(m.start(), m.end(), 1 + _OF[(m["colon"] or m["tag"] or m["bracket"] or m["heading"]).lower()]) for m in _MARKER.finditer(text)]
    out = []
    if not found or text[:found[0][0]].strip():
        out.append((0, text[:found[0][0]] if found else text))
    for (_, e, marker), after in zip(found, [*found[1:], (len(text), 0, 0)]):
        out.append((marker, text[e:after[0]]))
    return [(marker, _END.sub("", content).strip()) for marker, content in out]


def features(marker: int, content: str) -> tuple[int, int, int, int, int]:
    return (marker, min(_LENGTHS - 1, len(content).bit_length()), min(_LINES - 1, content.count("\n")),
            int(content.rstrip("\"')*_ ").endswith("?")), int("```" in content))


_SIZES = (len(ROLES) + 1, _LENGTHS, _LINES, 2, 2)


def code(marker: int, content: str) -> int:
    return int(np.ravel_multi_index(features(marker, content), _SIZES))


def render(role: str, content: str) -> str:
    return f"<|im_start|>{role}\n{content}<|im_end|>\n"


def _exact(counts: np.ndarray) -> np.ndarray:
    return np.round(np.log(counts / counts.sum(axis=1, keepdims=True)) * 2**20).astype(np.int64)


class Model:
    """Log probabilities: ``step`` from a role, or from the start in its last row, to a role; ``seen`` of a code by role.

    They are whole multiples of 2^-20, so that sums are exact and a path's value does not depend on how it is cut.
    """

    def __init__(self, emissions: list[tuple[int, int, int]], transitions: list[tuple[int, int, int]]):
        n = len(ROLES)
        step = np.full((n + 1, n), _PLAIN_WEIGHT)
        for a, b, count in transitions:
            step[a, b] += count
        self.step = _exact(step)
        parts = []
        for k, size in enumerate(_SIZES):
            held = np.full((n, size), _PLAIN_WEIGHT)
            if k == 0:  # a marker names its role, whatever the rows that teach say
                held[np.arange(n), np.arange(n) + 1] += _MARKED_WEIGHT
            for role, seen, count in emissions:
                held[role, np.unravel_index(seen, _SIZES)[k]] += count
            if k == 0:
                held[np.arange(n), np.arange(n) + 1] = np.maximum(held[np.arange(n), np.arange(n) + 1], held.sum() / (n + 1))
            parts.append(_exact(held))
        every = np.stack(np.unravel_index(np.arange(np.prod(_SIZES)), _SIZES))
        self.seen = sum(part[:, at].T for part, at in zip(parts, every))

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """Best log probability of passing all blocks, by the role before (last row: the start) and the role at the end."""
        out = self.step + self.seen[codes[0]]
        for c in codes[1:]:
            out = (out[:, :, None] + self.step[None, :-1]).max(axis=1) + self.seen[c]
        return out

    def path(self, codes: np.ndarray, entry: int, end: int) -> list[int]:
        """The best roles of all blocks between a role before and the last block's role."""
        score, back = self.step[entry] + self.seen[codes[0]], []
        for c in codes[1:]:
            ways = score[:, None] + self.step[:-1]
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + self.seen[c]
        out = [end]
        for ways in reversed(back):
            out.append(int(ways[out[-1]]))
        return out[::-1]


def _product(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for part in parts[1:]:
        out = (out[:, :, None] + part[None, :-1]).max(axis=1)
    return out


_SHAPE = (len(ROLES) + 1, len(ROLES))


def _ends(parts: list[np.ndarray], entry: int, end: int) -> list[tuple[int, int]]:
    """(role before, role at the end) of each part on the best path from ``entry`` to ``end``."""
    score, back = parts[0][entry], []
    for part in parts[1:]:
        ways = score[:, None] + part[:-1]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    roles = [end]
    for ways in reversed(back):
        roles.append(int(ways[roles[-1]]))
    roles = [entry, *reversed(roles)]
    return list(zip(roles, roles[1:]))


def _segment_ends(leaves: DataFrame) -> DataFrame:
    """(ck, idx, entry, exit) for every segment (ck, idx, m); conversations are halved by a factor of ``SEGMENT`` per level."""
    levels = [leaves.select("ck", "idx", "m")]
    while levels[-1].where("idx > 0").limit(1).count():
        kids = levels[-1].groupBy("ck", F.floor(F.col("idx") / SEGMENT).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "m"))).alias("kids"))

        def combine(cols):
            made = [_product([np.reshape(k["m"], _SHAPE) for k in kids]) for kids in cols["kids"].to_pylist()]
            return {"ck": cols["ck"], "idx": cols["up"], "m": [m.ravel() for m in made], "kids": cols["kids"]}

        levels.append(cut_lineage(map_rows(kids, combine, "ck string, idx bigint, m array<bigint>, kids array<struct<idx:bigint,m:array<bigint>>>")))

    def top(cols):
        end = [int(np.reshape(m, _SHAPE)[-1].argmax()) for m in cols["m"].to_pylist()]
        return {"ck": cols["ck"], "idx": cols["idx"], "entry": [len(ROLES)] * len(end), "exit": end}

    ends = map_rows(levels[-1].select("ck", "idx", "m"), top, "ck string, idx bigint, entry int, exit int")
    for level in reversed(levels[1:]):
        def down(cols):
            out = {"ck": [], "idx": [], "entry": [], "exit": []}
            for ck, kids, entry, end in zip(*(cols[c].to_pylist() for c in ("ck", "kids", "entry", "exit"))):
                for kid, (a, b) in zip(kids, _ends([np.reshape(k["m"], _SHAPE) for k in kids], entry, end)):
                    for name, value in zip(out, (ck, kid["idx"], a, b)):
                        out[name].append(value)
            return out

        ends = cut_lineage(map_rows(level.join(ends, ["ck", "idx"]).select("ck", "kids", "entry", "exit"), down, "ck string, idx bigint, entry int, exit int"))
    return ends


def held_out(conv_id: Column) -> Column:
    """Conversations that never teach: crc32 of the id as text leaves remainder 1 by 3; a null id reads as empty text."""
    return F.crc32(F.coalesce(conv_id.cast("string"), F.lit(""))) % 3 == 1


def _placed(rows: DataFrame) -> DataFrame:
    """(ck, conv_id, turn, h, position, role, codes): what the model needs of every row, in order of its conversation."""
    def work(cols):
        return {c: cols[c] for c in ("ck", "conv_id", "turn", "t", "h", "role")} | {
            "codes": [[code(*b) for b in blocks(t)] for t in cols["text"].to_pylist()]}

    narrow = map_rows(rows, work, "ck string, conv_id bigint, turn bigint, t bigint, h bigint, role int, codes array<int>")
    return cut_lineage(positions(cut_lineage(narrow), ["ck"], F.floor(F.col("t") / 256), ["t", "h"]).withColumn("position", F.col("position") - 1))


def train(placed: DataFrame) -> Model:
    """A model from rows with a known role in conversations that are not held out; with none, all roles are alike."""
    known = placed.where(F.col("role").isNotNull() & ~held_out(F.col("conv_id")))
    # both results have at most as many rows as there are codes and roles
    emissions = known.where("size(codes) = 1").groupBy("role", F.col("codes")[0].alias("code")).count().collect()
    here = known.select("ck", "position", "role")
    before = here.select("ck", (F.col("position") + 1).alias("position"), F.col("role").alias("a"))
    steps = here.join(before, ["ck", "position"]).groupBy("a", F.col("role").alias("b")).count().union(
        here.where("position = 0").groupBy(F.lit(len(ROLES)).alias("a"), F.col("role").alias("b")).count()).collect()
    return Model([(r["role"], r["code"], r["count"]) for r in emissions], [(r["a"], r["b"], r["count"]) for r in steps])


def parse(rows: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """(conv_id, turn, position, block, role, given, content, rendered) for every block of every row.

    ``rows`` has conv_id, turn, a text and, if ``model`` is to be learned here, role; role is never read while
    decoding. Rows of a conversation go by turn, nulls first, then by xxhash64 of the text; rows without conv_id form
    one conversation. A null or empty text is one empty block. Repeated rows are further turns. A role other than
    ``ROLES`` counts as not given. An empty table gives no rows; other columns are not read.
    """
    whole = whole_text(rows, text)
    named = F.lower(F.trim(rows["role"].cast("string"))) if "role" in rows.columns else F.lit(None).cast("string")
    number = F.coalesce(*[F.when(named == role, k) for k, role in enumerate(ROLES)]).cast("int")
    base = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("ck"), F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 63))).alias("t"),
        F.xxhash64(whole).alias("h"), number.alias("role"), whole.alias("text"))
    placed = _placed(base)
    model = model or train(placed)
    leaves = placed.groupBy("ck", F.floor(F.col("position") / SEGMENT).alias("idx")).agg(
        F.sort_array(F.collect_list(F.struct("position", "t", "h", "conv_id", "turn", "role", "codes"))).alias("rows"))

    def measure(cols):
        codes = [np.concatenate([r["codes"] for r in held]) for held in cols["rows"].to_pylist()]
        return {"ck": cols["ck"], "idx": cols["idx"], "m": [model.matrix(c).ravel() for c in codes], "rows": cols["rows"]}

    kind = "array<struct<position:bigint,t:bigint,h:bigint,conv_id:bigint,turn:bigint,role:int,codes:array<int>>>"
    leaves = cut_lineage(map_rows(leaves, measure, f"ck string, idx bigint, m array<bigint>, rows {kind}"))

    def decode(cols):
        out = {name: [] for name in ("ck", "conv_id", "turn", "t", "h", "position", "given", "roles")}
        for ck, held, entry, end in zip(*(cols[c].to_pylist() for c in ("ck", "rows", "entry", "exit"))):
            path, at = model.path(np.concatenate([r["codes"] for r in held]), entry, end), 0
            for r in held:
                size = len(r["codes"])
                values = (ck, r["conv_id"], r["turn"], r["t"], r["h"], r["position"], r["role"], path[at:at + size])
                at += size
                for name, value in zip(out, values):
                    out[name].append(value)
        return out

    decoded = map_rows(leaves.drop("m").join(_segment_ends(leaves), ["ck", "idx"]), decode,
                       "ck string, conv_id bigint, turn bigint, t bigint, h bigint, position bigint, given int, roles array<int>")
    texts = base.select("ck", "t", "h", "text").dropDuplicates(["ck", "t", "h"])
    return _rendered(decoded.join(texts, ["ck", "t", "h"]).select("conv_id", "turn", "position", "given", "roles", "text"))


def _rendered(rows: DataFrame) -> DataFrame:
    def work(cols):
        out = {name: [] for name in ("conv_id", "turn", "position", "block", "role", "given", "content", "rendered")}
        for conv_id, turn, position, given, roles, text in zip(*(c.to_pylist() for c in cols.values())):
            for block, (role, (_, content)) in enumerate(zip(roles, blocks(text), strict=True)):
                values = (conv_id, turn, position, block, ROLES[role], None if given is None else ROLES[given], content, render(ROLES[role], content))
                for name, value in zip(out, values):
                    out[name].append(value)
        return out

    return map_rows(rows, work, "conv_id bigint, turn bigint, position bigint, block int, role string, given string, content string, rendered string")


def query(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse(table(spark, folder, "conversations"))
    return parsed.select("conv_id", "turn", "position", "block", "role", "given", held_out(F.col("conv_id")).alias("held_out"),
                         F.char_length("content").cast("bigint").alias("n_chars"), F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))
