"""The stages of documents as a stream: a state machine for each document, timeouts, and windows.

Stages only go forward. An event that does not is reported as such and changes nothing; the last stage and failure are
final. A document that is not finished and has been silent for STUCK of event time behind the watermark is reported once
as stuck; its next event takes it up again. Within a micro-batch a document's events are taken in their order of time
(ties: by the order of the stages), so what comes out does not depend on how files fall into partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanledger.streaming.ingest import STAGES

ORDER = list(STAGES)
FINAL = ("READY", "FAILED")
LATE, STUCK = "10 minutes", "30 minutes"
#: How a row came about: the stage moved forward, did not, or nothing came for long.
ADVANCED, REFUSED, TIMED_OUT = "advanced", "refused", "stuck"
SCHEMA = "doc_id string, stage string, ts timestamp, kind string"


def transitions(status: DataFrame, order: list[str] | None = None, final: tuple[str, ...] = FINAL, late: str = LATE, stuck: str = STUCK) -> DataFrame:
    """``doc_id``, ``stage``, ``ts``, ``kind`` for a stream of ``doc_id``, ``stage``, ``ts``; unknown stages are refused."""
    rank = {s: k for k, s in enumerate(order or ORDER)}
    last, silence = len(rank), pd.Timedelta(stuck)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, seen, done = state.get if state.exists else (-1, 0, False)
        if state.hasTimedOut:
            name = next((s for s, k in rank.items() if k == at), None)
            state.update((at, seen, done))  # without a new timeout: it is reported once
            yield pd.DataFrame({"doc_id": [key[0]], "stage": [name], "ts": [pd.Timestamp(seen, unit="us")], "kind": [TIMED_OUT]})
            return
        rows = pd.concat(list(frames))
        rows["place"] = rows.stage.map(rank).fillna(last)
        rows = rows.sort_values(["ts", "place", "stage"], kind="stable")
        kinds = []
        for stage, place in zip(rows.stage, rows.place):
            moves = not done and at < place < last
            kinds.append(ADVANCED if moves else REFUSED)
            if moves:
                at, done = int(place), stage in final
        seen = max(seen, int(rows.ts.max().value // 1000) if rows.ts.dt.unit == "ns" else int(rows.ts.max().timestamp() * 1e6))
        state.update((at, seen, done))
        if not done:
            state.setTimeoutTimestamp(max((seen + int(silence.value // 1000)) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"doc_id": rows.doc_id.values, "stage": rows.stage.values, "ts": rows.ts.values, "kind": kinds})

    s = status.select(F.col("doc_id").cast("string").alias("doc_id"), "stage", "ts").withWatermark("ts", late)
    return s.groupBy("doc_id").applyInPandasWithState(step, SCHEMA, "at int, seen long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def windows(status: DataFrame, size: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Stages per window; works on a stream (late rows beyond the watermark are left out) and on a table."""
    s = status.withWatermark("ts", late) if status.isStreaming else status
    return s.groupBy(F.window("ts", size).alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "stage", "n")
