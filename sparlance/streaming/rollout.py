"""Streams: the rollout of dialogs whose messages arrive one by one, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparlance.plans import sqltree

TURN_SCHEMA = "dialog_id string, turn_index int, history_length int, generated_sql string, syntax_valid boolean"
STATE_SCHEMA = "roles array<string>, contents array<string>, turn int"


def stream_rollout(messages: DataFrame, generate: Callable[[list[dict]], str], idle: str | None = None) -> DataFrame:
    """Generated-history rollout over a stream of (dialog_id, position, role, content).

    The history of a dialog is the state of its group; each assistant slot gives a row and puts the generated
    statement into the history. Messages of a batch are taken by position. With `idle`, the state of a dialog
    without messages for so long is dropped; the query then runs batches without data too.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["dialog_id", "turn_index", "history_length", "generated_sql", "syntax_valid"])
            return
        roles, contents, turn = map(lambda x: list(x) if not isinstance(x, int) else x, state.get) if state.exists else ([], [], 0)
        out = []
        for m in pd.concat(list(batches)).sort_values("position").itertuples():
            said = m.content
            if m.role == "assistant":
                history = [{"role": r, "content": c} for r, c in zip(roles, contents)]
                said = generate(history)
                out.append((key[0], turn, len(history), said, sqltree.canonical(said) is not None))
                turn += 1
            roles.append(m.role)
            contents.append(said)
        state.update((roles, contents, turn))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["dialog_id", "turn_index", "history_length", "generated_sql", "syntax_valid"])

    return messages.groupBy("dialog_id").applyInPandasWithState(step, TURN_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) of events in fixed windows, with a bound on lateness when streaming."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
