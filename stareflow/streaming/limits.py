"""The rate limit as a stream: state is kept for each client and holds no more times than the rate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "key string, at double, id long, allowed boolean"


def rate_limited_stream(calls: DataFrame, rate: int = 60, window: float = 60.0) -> DataFrame:
    """calls(key, at, id) with allowed, as operators.sequences.rate_limited() has it, for calls that arrive
    in order of time. Each call is answered in the batch that brings it."""

    def step(key, frames, state):
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        allowed = []
        for t in rows["at"]:
            passed = [x for x in passed if t - x <= window]
            allowed.append(len(passed) < rate)
            if allowed[-1]:
                passed.append(float(t))
        state.update((passed,))
        yield rows.assign(key=key[0], allowed=allowed)[["key", "at", "id", "allowed"]]

    return calls.groupBy("key").applyInPandasWithState(step, OUT, "passed array<double>", "append", GroupStateTimeout.NoTimeout)
