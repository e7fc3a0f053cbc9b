"""Streams of keys folded over alignments, with the state of each session kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.editing import Editor

OUTPUT = "session_id long, aligned1 string, aligned2 string, cursor long, active long, n_keys long"
STATE = "original1 string, original2 string, aligned1 string, aligned2 string, cursor long, active long, n_keys long"


def stream_edits(keys: DataFrame) -> DataFrame:
    """The state of each session after the keys that have arrived.

    ``keys``: session_id, seq_no, key, aligned1, aligned2. The strings of a
    session's first row start it. Keys are folded in the order of seq_no
    within a micro-batch; a later batch goes on from the kept state, which
    holds the first strings too, for Reset.
    """

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(rows).sort_values("seq_no", kind="stable")
        if state.exists:
            first, second, a, b, cursor, active, n = state.get
            editor = Editor([a, b], cursor, active - 1, [first, second])
        else:
            editor, n = Editor([arrived["aligned1"].iloc[0], arrived["aligned2"].iloc[0]]), 0
        for k in arrived["key"]:
            editor.press(k)
        now = (*editor.rows, editor.cursor, editor.active + 1, n + len(arrived))
        state.update((*editor.original, *now))
        yield pd.DataFrame([(key[0], *now)], columns=["session_id", "aligned1", "aligned2", "cursor", "active", "n_keys"])

    return keys.groupBy("session_id").applyInPandasWithState(fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
