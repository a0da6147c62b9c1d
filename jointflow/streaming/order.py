"""Rows of a stream that arrive out of order, put in order for each key."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessorHandle, ValueState

#: The frame of a closing mark: nothing of its key comes after it.
END = (1 << 63) - 1

_KINDS = {"LONG": int, "INT": int, "DOUBLE": float, "BOOLEAN": bool}


class InOrder:
    """Rows of a key wait until a row ``disorder`` frames ahead of theirs has come, then go on sorted by frame.

    The clock is the key's own, the highest frame it has seen, so slow and fast videos do not disturb each other. A row without
    ``det_idx`` is a mark: it moves the clock and goes no further; one at frame ``END`` releases all that waits. What
    waits is a key's rows of ``disorder`` frames at most.
    """

    def __init__(self, columns: Sequence[tuple[str, str]], disorder: int) -> None:
        self.columns = list(columns)
        self.disorder = disorder

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting: ListState = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in self.columns))
        self.clock: ValueState = handle.getValueState("clock", "frame_idx LONG")

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows that are due, of those given and those that waited."""
        names = [n for n, _ in self.columns]
        clock = int(pdf["frame_idx"].max())
        if self.clock.exists():
            clock = max(clock, int(self.clock.get()[0]))
        self.clock.update((clock,))
        pdf = pdf.loc[pdf["det_idx"].notna(), names]
        if self.waiting.exists():
            held = pd.DataFrame.from_records(list(self.waiting.get()), columns=names)
            pdf = pd.concat([held.astype(pdf.dtypes.to_dict()), pdf], ignore_index=True) if len(pdf) else held
        due = pdf["frame_idx"] <= (END if clock == END else clock - self.disorder)
        rest = pdf[~due]
        if len(rest):
            values = [[_KINDS[t](x) if x == x else (x if t == "DOUBLE" else None) for x in rest[n].tolist()] for n, t in self.columns]
            self.waiting.put(list(zip(*values)))
        elif self.waiting.exists():
            self.waiting.clear()
        return pdf[due].reset_index(drop=True)
