"""T1 (stream): per-session context as keyed state.

``applyInPandasWithState`` keyed by session: the state holds the last
all turns (``role: text``), each incoming turn is emitted with the
history before it, then appended. Sessions are kept unless a timeout is given. Turns of one session
are expected in turn order across micro-batches (within a batch they are
sorted); the output then equals the batch operator ``operators.session``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


OUTPUT_SCHEMA = "conv_id bigint, turn bigint, n_history int, history string"
STATE_SCHEMA = "entries array<string>"


def _carry(history: int | None, timeout_ms: int | None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entries = list(state.get[0]) if state.exists else []
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        turns = pd.concat(frames).sort_values("turn")
        out_turn, out_n, out_hist = [], [], []
        for turn, role, text in zip(turns["turn"], turns["role"], turns["text"]):
            out_turn.append(int(turn))
            out_n.append(len(entries))
            out_hist.append("\n".join(entries))
            entries.append(f"{'' if role is None else role}: {'' if text is None else text}")
            if history is not None:
                entries = entries[-history:]
        state.update((entries,))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"conv_id": [key[0]] * len(out_turn), "turn": out_turn,
                            "n_history": pd.Series(out_n, dtype="int32"), "history": out_hist})

    return fn


def session_context_stream(turns: DataFrame, history: int | None = None, timeout_ms: int | None = None,
                           session: str = "conv_id") -> DataFrame:
    """Streaming turns ``(conv_id, turn, role, text)`` -> turns with their context.

    All earlier turns are carried, as in the batch operator. ``history`` limits
    them, and ``timeout_ms`` forgets a session after that idle time; both are for
    callers that want to bound the state.
    """
    kind = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return turns.groupBy(session).applyInPandasWithState(
        _carry(history, timeout_ms), OUTPUT_SCHEMA, STATE_SCHEMA, "append", kind)
