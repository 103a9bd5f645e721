"""Sliding-window rate limiter: a request is admitted while fewer than ``limit`` admitted ones lie in the window before it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "client bigint, id bigint, ts timestamp, admitted boolean"


def decide(held: deque, times: list[float], limit: int, seconds: float) -> list[bool]:
    """Decisions for ascending times; held keeps the admitted ones and is updated."""
    out = []
    for t in times:
        while held and held[0] <= t - seconds:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


def _frame(client: int, rows: pd.DataFrame, held: deque, limit: int, seconds: float) -> pd.DataFrame:
    rows = rows.sort_values(["ts", "id"])
    ok = decide(held, (rows["ts"].astype("int64") / 1e9 if str(rows["ts"].dtype).endswith("ns]") else rows["ts"].astype("datetime64[ns]").astype("int64") / 1e9).tolist(), limit, seconds)
    return pd.DataFrame({"client": client, "id": rows["id"], "ts": rows["ts"], "admitted": ok})


def admitted(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Batch twin over (client, id, ts): one group per client."""
    return events.groupBy("client").applyInPandas(lambda key, rows: _frame(key[0], rows, deque(), limit, seconds), SCHEMA)


def admitted_stream(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Streaming form: the admitted times of each client are its state, dropped when the client has been idle."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0] if state.exists else [])
        yield _frame(key[0], pd.concat(list(batches)), held, limit, seconds)
        state.update((list(held),))
        state.setTimeoutDuration(int(seconds * 2000))

    return events.groupBy("client").applyInPandasWithState(step, SCHEMA, "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
