"""Token deltas put together as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def completed_items(deltas: DataFrame) -> DataFrame:
    """Items whose deltas have all arrived: ``(item_id, text)``.

    ``deltas`` has ``item_id BIGINT, seq BIGINT, delta STRING, last BOOLEAN``;
    the last delta tells how many there are, and order of arrival is free. A delta
    that arrives again before its item is complete counts once. The state of an
    item is what has arrived of it, dropped on completion.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, texts, expected = state.get if state.exists else ([], [], -1)
        arrived = dict(zip(seqs, texts, strict=True))
        for frame in frames:
            arrived.update(zip(frame["seq"].tolist(), frame["delta"].tolist(), strict=True))
            ends = frame.loc[frame["last"], "seq"]
            if len(ends):
                expected = int(ends.iloc[0]) + 1
        if expected == len(arrived):
            if state.exists:
                state.remove()
            whole = "".join(arrived[seq] for seq in sorted(arrived))
            yield pd.DataFrame({"item_id": [key[0]], "text": [whole]})
        else:
            state.update((list(arrived), list(arrived.values()), expected))

    return deltas.groupBy("item_id").applyInPandasWithState(
        step,
        "item_id BIGINT, text STRING",
        "seqs ARRAY<BIGINT>, texts ARRAY<STRING>, expected BIGINT",
        "append",
        GroupStateTimeout.NoTimeout,
    )
