"""Streaming forms of the replays: one small state for each key, kept between micro-batches.

Requests of a key are taken in order of time and event_id within a micro-batch, and micro-batches in order of arrival.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from pagesift.operators.replay import Breaker, Cache, Limiter, timed


def _stateful(log: DataFrame, keys: list[str], machine: type, *settings) -> DataFrame:
    names = ["event_id", *(f.split()[0] for f in machine.FIELDS.split(", "))]

    def run(key, batches, state):
        now = machine(*settings, *state.get) if state.exists else machine(*settings)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = [(event, *now(at, ok)) for event, at, ok in rows[["event_id", "at", "ok"]].itertuples(index=False)]
        state.update(now.state())
        yield pd.DataFrame(out, columns=names)

    rows = timed(log).select(*keys, "event_id", "at", "ok")
    return rows.groupBy(*keys).applyInPandasWithState(run, f"event_id long, {machine.FIELDS}", machine.STATE, "append", GroupStateTimeout.NoTimeout)


def rate_limit(log: DataFrame, limit: int, window: float) -> DataFrame:
    return _stateful(log, ["endpoint", "subject"], Limiter, limit, window)


def ttl_cache(log: DataFrame, ttl: float) -> DataFrame:
    return _stateful(log, ["endpoint", "subject"], Cache, ttl)


def circuit_breaker(log: DataFrame, threshold: int, recovery: float) -> DataFrame:
    return _stateful(log, ["endpoint"], Breaker, threshold, recovery)
