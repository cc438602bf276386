"""The map as Structured Streaming: keyed state over a stream of operations.

Each micro-batch is a group commit: what it holds becomes visible and durable
together, and a query restarted from its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidefold.plans.transitions import MapState

OUT = "seq bigint, item bigint, op string, status string, result double"


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one key in a micro-batch, in order of seq."""
    own = MapState(*state.get, live=True) if state.exists else MapState()
    rows = pd.concat(list(batches)).sort_values("seq")
    rows = rows.astype(object).where(rows.notna(), None)
    out = [(r.seq, key[0], r.op, *own.apply(r.op, r.val)) for r in rows.itertuples(index=False)]
    if own.live:
        state.update((None if own.value is None else float(own.value),))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["seq", "item", "op", "status", "result"])


def statuses(log: DataFrame) -> DataFrame:
    """What every operation of a stream returns, as the stream goes."""
    return log.select("seq", "op", "item", "val").groupBy("item").applyInPandasWithState(_apply, OUT, "val double", "append", GroupStateTimeout.NoTimeout)


def start(log: DataFrame, path: str, checkpoint: str, seconds: float | None = None):
    """Write statuses below ``path``; with ``seconds`` a commit that often, else all that is there and stop."""
    writer = statuses(log).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
