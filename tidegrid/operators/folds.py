"""Order-dependent state machines over sorted rows, in constant memory per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def sorted_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    schema: str,
    start: Callable[[], object],
    step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]],
) -> DataFrame:
    """Feed each key's rows in order to ``step(state, rows) -> (state, out)``.

    Rows arrive in Arrow batches of the sorted partition, so no key is held in
    memory as a whole; only ``state`` crosses a batch border. Meant for the few
    keys that need a true sequential rule; filter to those first.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            changed = (batch[keys] != batch[keys].shift()).any(axis=1).cumsum()
            for _, rows in batch.groupby(changed, sort=False):
                key = tuple(rows.iloc[0][keys])
                if key != current:
                    current, state = key, start()
                state, out = step(state, rows)
                if len(out):
                    yield out

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema)
