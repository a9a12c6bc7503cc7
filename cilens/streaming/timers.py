"""Stream operators with keyed state that ends by event time.

Each key with state sets a time; when the watermark passes it, the state is removed. What a stream holds so grows
with the keys that are live, not with all keys it has ever seen.

Spark itself leaves out late rows by the watermark of the batch before, but removes state by the current one. The steps
therefore leave out rows behind the current one, so that no late row meets a key whose state is gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cilens import rules


def _upto(rows: pd.DataFrame, end: tuple[int, int]) -> pd.DataFrame:
    return rows[(rows["us"] < end[0]) | ((rows["us"] == end[0]) & (rows["event_id"] <= end[1]))]


def until_terminal(events: DataFrame, terminal: Column, delay: str = "2 hours", keep_seconds: int = rules.DAY) -> DataFrame:
    """Events of a stream up to each incident's first terminal one, by time and event.

    ``events`` has incident_id, event_id and at. Only an ended incident has state: a mark that is removed when the
    watermark is ``keep_seconds`` past the latest event the incident sent. Events that arrive before then are swallowed
    and put the removal off; one that arrives after it opens the incident anew. Of the rows of a batch those behind an
    end already seen are let go at once. Rows without time are dropped, as are rows behind the watermark, ``delay`` after
    the newest; rows without incident never end.
    """
    marked = events.where("at IS NOT NULL").withWatermark("at", delay).select(
        "incident_id", "event_id", "at", F.unix_micros("at").alias("us"),
        F.coalesce(terminal & F.col("incident_id").isNotNull(), F.lit(False)).alias("terminal"))

    def step(key, pieces: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = state.getCurrentWatermarkMs() * 1000
        ended, latest = state.exists, state.get[0] if state.exists else 0
        end, held = None, []
        for piece in pieces:
            piece = piece[piece["us"] > passed]
            if not len(piece):
                continue
            latest = max(latest, int(piece["us"].max()))
            if ended:
                continue
            hits = piece[piece["terminal"]]
            if len(hits):
                first = min(zip(hits["us"].tolist(), hits["event_id"].tolist()))
                if end is None or first < end:
                    end = first
                    held = [_upto(rows, end) for rows in held]
            held.append(piece if end is None else _upto(piece, end))
        until = latest // 1000 + keep_seconds * 1000
        if ended and until * 1000 <= passed:
            state.remove()
        elif ended or end is not None:
            state.update((latest,))
            state.setTimeoutTimestamp(until)
        for rows in held:
            if len(rows):
                yield pd.DataFrame({"incident_id": key[0], "event_id": rows["event_id"], "terminal": rows["terminal"]})

    return marked.groupBy("incident_id").applyInPandasWithState(
        step, "incident_id string, event_id bigint, terminal boolean", "latest bigint", "append", "EventTimeTimeout")


def _per_second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums per provider and second inside a task, ahead of the shuffle."""
    for batch in batches:
        yield batch.groupby(["provider", "t_sec"], as_index=False, sort=False).agg(requests=("tokens", "size"), tokens=("tokens", "sum"))


def sliding_use(requests: DataFrame, delay: str = "10 minutes", seconds: int = rules.MINUTE, size: int = 10 * rules.MINUTE,
                most: int = rules.QUOTA["tpm"]) -> DataFrame:
    """Requests and tokens of each second that has any, and those of the window before it, as an updating stream.

    ``requests`` has provider, t_sec and tokens; a null provider counts as an empty one, null tokens as none, a row without
    time is dropped. The window holds the seconds less than ``seconds`` back, without the second itself; a request is charged
    at most ``most`` tokens. A second is given out again when requests that arrive later change its window; those of
    seconds that ended ``delay`` before the newest are dropped.

    Time is cut into slices of ``size`` seconds, and a request whose window reaches into the next slice enters that one too,
    so that a slice knows all it needs. Tasks sum per second before the shuffle: a provider with most of the traffic costs a row
    per task and second. State is a count and a sum per second of a slice and the window before it; it goes as soon as
    the watermark is past the slice.
    """
    back = seconds - 1

    def step(key, pieces: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, passed = int(key[1]) * size, state.getCurrentWatermarkMs()
        if (start + size) * 1000 <= passed:
            state.remove()
            return
        use = np.frombuffer(state.get[0], dtype="<i8").reshape(2, -1).copy() if state.exists else np.zeros((2, back + size), dtype="<i8")
        changed = np.zeros(back + size, dtype=np.int64)
        for piece in pieces:
            piece = piece[(piece["t_sec"] + 1) * 1000 > passed]
            place = piece["t_sec"].to_numpy() - start + back
            np.add.at(use[0], place, piece["requests"].to_numpy())
            np.add.at(use[1], place, piece["tokens"].to_numpy())
            changed[place] = 1
        state.update((use.tobytes(),))
        state.setTimeoutTimestamp((start + size) * 1000)
        upto = np.concatenate([np.zeros((2, 1), dtype=np.int64), np.cumsum(use, axis=1)], axis=1)
        changes = np.concatenate([[0], np.cumsum(changed)])
        at = np.arange(back, back + size)
        at = at[(use[0, at] > 0) & (changes[at + 1] > changes[at - back])]
        if len(at):
            before = upto[:, at] - upto[:, at - back]
            yield pd.DataFrame({"provider": key[0], "t_sec": at - back + start, "requests": use[0, at], "tokens": use[1, at],
                                "requests_minute": before[0], "tokens_minute": before[1]})

    charged = requests.where("t_sec IS NOT NULL").select(
        F.coalesce("provider", F.lit("")).alias("provider"), F.col("t_sec").cast("bigint").alias("t_sec"),
        F.coalesce(F.when(F.col("tokens").isNotNull(), F.least("tokens", F.lit(most))), F.lit(0)).cast("bigint").alias("tokens"))
    summed = charged.mapInPandas(_per_second, "provider string, t_sec bigint, requests bigint, tokens bigint")
    slices = F.sequence(F.floor(F.col("t_sec") / size), F.floor((F.col("t_sec") + back) / size))
    # the time of a row is the end of its second
    timed = summed.withColumn("at", F.timestamp_seconds(F.col("t_sec") + 1)).withWatermark("at", delay)
    return timed.select("provider", "t_sec", "requests", "tokens", "at", F.explode(slices).alias("slice")).groupBy("provider", "slice").applyInPandasWithState(
        step, "provider string, t_sec bigint, requests bigint, tokens bigint, requests_minute bigint, tokens_minute bigint", "use binary", "update", "EventTimeTimeout")
