"""Open documents: texts kept up to date from open, change and close events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.align import apply_edits

#: path, seq, event (open, change, close), start and end (line, column; null: the whole text), text
EVENTS = "path string, seq long, event string, start_line int, start_col int, end_line int, end_col int, text string"
VERSIONS = "path string, seq long, version long, text string"


def step(state: tuple[int, str] | None, row: Any) -> tuple[int, str] | None:
    """(version, text) after an event; None for a closed document, which later changes leave closed."""
    if row.event == "open":
        return 0, row.text or ""
    if row.event == "close" or state is None:
        return None
    whole = row.start_line is None or row.start_line != row.start_line
    start, end = (None, None) if whole else ((int(row.start_line), int(row.start_col)), (int(row.end_line), int(row.end_col)))
    return state[0] + 1, apply_edits(state[1], [(start, end, row.text or "")])


def _fold(rows: Any, state: tuple[int, str] | None) -> tuple[list[tuple], tuple[int, str] | None]:
    out = []
    for row in rows.sort_values("seq").itertuples():
        state = step(state, row)
        if state is not None:
            out.append((row.path, row.seq, *state))
    return out, state


def replay(events: DataFrame) -> DataFrame:
    """The text after every event of open documents, from a table of events."""

    def run(rows: Any) -> Any:
        import pandas as pd

        return pd.DataFrame(_fold(rows, None)[0], columns=["path", "seq", "version", "text"])

    return events.groupBy("path").applyInPandas(run, VERSIONS)


def follow(events: DataFrame) -> DataFrame:
    """The same from a stream; a document's version and text are its state, which closing removes."""

    def run(key: tuple, batches: Iterator[Any], state: GroupState) -> Iterator[Any]:
        import pandas as pd

        out, now = _fold(pd.concat(list(batches)), state.get if state.exists else None)
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update(now)
        yield pd.DataFrame(out, columns=["path", "seq", "version", "text"])

    return events.groupBy("path").applyInPandasWithState(run, VERSIONS, "version long, text string", "append", "NoTimeout")
