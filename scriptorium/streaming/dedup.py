"""Entity dedup over a stream: chunks of a document may come in different micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long a document's names are remembered after the last of its chunks.
DAYS = 7


def dedup_stream(entities: DataFrame, days: float = DAYS, dedup_single: bool = False) -> DataFrame:
    """The first of a document's entities that agree in lower-case stripped text and label, over all micro-batches.

    entities: a stream with model, doc_id, chunk_idx, n_chunks, entity_idx, text, label. What came in one batch is taken in
    the order of chunks; what came in an earlier batch is before what comes later. If chunks come in order, the result is
    that of operators.dedup on all of them. State is kept by document, its names and labels, and goes after `days` without a
    chunk of the document; a name that comes again after that counts as new. With an
    availableNow trigger set spark.sql.streaming.noDataMicroBatches.enabled to false: the wait for time-outs would go on.
    """
    columns = entities.columns

    def run(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        known = set(seen)
        part = pd.concat(list(parts)).sort_values(["chunk_idx", "entity_idx"], kind="stable")
        keep = []
        for text, label, n in zip(part["text"], part["label"], part["n_chunks"], strict=True):
            name = f"{(text or '').strip().lower()}\n{label or ''}"
            good = not name.startswith("\n") and not name.endswith("\n") and name not in known
            if n <= 1 and not dedup_single:
                good = True
            elif good:
                known.add(name)
                seen.append(name)
            keep.append(good)
        state.update((seen,))
        state.setTimeoutDuration(int(days * 86_400_000))
        yield part.loc[keep, columns]

    return entities.groupBy("model", "doc_id").applyInPandasWithState(run, entities.schema, "seen array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
