"""Attempts at documents as they arrive, with state by document: an extension, for runs that send failures back.

A document's state is the newest attempt seen, how many there were, and whether one was good; that is all that is kept, however
often it is tried. An attempt that is no newer than the newest seen is a repeat or comes too late, and changes nothing. The first
good attempt settles a document; a document of which nothing has been heard for `patience` of event time is given up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "newest long, attempts int, settled boolean"


def settled(attempts: DataFrame, patience: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(doc_id, verdict, attempts, value) of a stream of attempts (doc_id, attempt, arrived, ok, value): good with the value of the first
    good attempt and how many it took, or given_up without one. Attempts of a document are numbered upwards. Rows older than
    the watermark, `late` behind the newest arrival, are dropped by Spark; state goes when patience has run out. Appends."""
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    value = attempts.schema["value"].dataType.simpleString()
    kind = attempts.schema["doc_id"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, n, done = state.get if state.exists else (-(2**62), 0, False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame([(key[0], "given_up", n, None)], columns=["doc_id", "verdict", "attempts", "value"])
            return
        lots = [[f[c].array for c in ("attempt", "ok", "value", "arrived")] for f in frames]  # one document's of a batch
        number, good = (np.concatenate([np.asarray(x[k]) for x in lots]) for k in (0, 1))
        last = max(int(x[3].max().timestamp() * 1000) for x in lots)
        tries, at = np.unique(number, return_index=True)  # in order, the first of those with one number
        new = at[tries > newest]
        out = []
        if len(new) and not done:
            hit = np.flatnonzero(good[new])
            n += int(hit[0]) + 1 if len(hit) else len(new)
            if len(hit):
                done, k = True, int(new[hit[0]])
                found = next(x[2][k - b] for x, b in zip(lots, accumulate((len(x[0]) for x in lots), initial=0)) if k - b < len(x[0]))
                out.append((key[0], "good", n, found))
        if len(new) or not state.exists:
            newest = int(number[new[-1]]) if len(new) else newest
            state.update((newest, n, done))
        at = max(last, state.getCurrentWatermarkMs()) + wait
        state.setTimeoutTimestamp(at)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "verdict", "attempts", "value"])

    some = attempts.select("doc_id", "attempt", "arrived", "ok", "value").withWatermark("arrived", late)
    return some.groupBy("doc_id").applyInPandasWithState(step, f"doc_id {kind}, verdict string, attempts int, value {value}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
