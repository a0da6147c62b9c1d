"""Track ids on a stream of flat detections: the batch tracker with its live tracks kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from jointflow.operators.tracking import TrackerConfig, in_walk_order, two_stage_tracker
from jointflow.streaming.exercise import use_rocksdb
from jointflow.streaming.order import InOrder

_CORNERS = ("x1", "y1", "x2", "y2")
_IN = [("frame_idx", "LONG"), ("det_idx", "INT"), ("conf", "DOUBLE"), *[(c, "DOUBLE") for c in _CORNERS]]
_STATE = "frame_idx LONG, next_id LONG, id ARRAY<LONG>, last ARRAY<LONG>, place ARRAY<DOUBLE>"
_OUT = "video_id STRING, frame_idx LONG, det_idx INT, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, track_id LONG, late BOOLEAN"


class _TrackWalker(StatefulProcessor):
    """State per video: the frame it has come to, its live tracks, the next id, and frames that wait for those before them."""

    def __init__(self, config: TrackerConfig, disorder: int):
        self.config = config
        self.order = InOrder(_IN, disorder)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracks", _STATE)
        self.tracker = two_stage_tracker(self.config)
        self.order.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True)
        pdf = in_walk_order(self.order(given))
        if not len(pdf):
            return
        at, next_id, ids, last, place = self.state.get() if self.state.exists() else (None, 1, [], [], [])
        # A frame is walked once, as a whole.
        late = pd.Series(False, index=pdf.index) if at is None else pdf["frame_idx"] <= at
        track = pd.Series(pd.NA, index=pdf.index, dtype="Int64")
        own = pdf[~late]
        if len(own):
            state = {
                "id": np.array(ids, np.int64),
                "last": np.array(last, np.int64),
                "place": np.array(place, float).reshape(-1, 8),
                "next": np.array([next_id]),
            }
            track[~late], state = self.tracker.resume(own, state)
            frame = int(own["frame_idx"].iloc[-1])
            alive = np.flatnonzero(frame - state["last"] <= self.config.max_lost)
            self.state.update(
                (
                    frame,
                    int(state["next"][0]),
                    state["id"][alive].tolist(),
                    state["last"][alive].tolist(),
                    state["place"][alive].ravel().tolist(),
                )
            )
        yield pdf.assign(video_id=key[0], track_id=track, late=late)[[c.split()[0] for c in _OUT.split(", ")]]

    def close(self) -> None:
        pass


def stream_tracks(rows: DataFrame, config: TrackerConfig = TrackerConfig(), disorder: int = 1, with_late: bool = False) -> DataFrame:
    """Flat detections of a stream (``video_id, frame_idx, det_idx, conf, bbox``) with ``track_id``, as
    :func:`~jointflow.operators.tracking.assign_tracks` gives it for the whole table.

    A frame is walked, as a whole, when a frame ``disorder`` or more ahead of it has come in its video, so detections of a frame may be spread
    over files and micro-batches, and come up to ``disorder`` frames late. Rows of frames walked already come out with
    ``late`` true and without an id if asked for, and are dropped otherwise; the metric ``late_rows`` counts them. Rows without
    ``det_idx`` move the video's clock only; one at frame :data:`~jointflow.streaming.order.END` ends the video. A detection without a
    confidence counts as sure. State per video: its live tracks and the rows that wait. A video's rows of one
    micro-batch are walked in one task, as a tracker is sequential; bound the micro-batch.
    """
    if disorder < 1:
        raise ValueError("a frame is whole only once a later one has come: disorder is 1 at least")
    use_rocksdb(rows.sparkSession)
    narrow = rows.select(
        "video_id",
        "frame_idx",
        "det_idx",
        F.coalesce("conf", F.lit(1.0)).alias("conf"),
        *[F.col(f"bbox.{c}").alias(c) for c in _CORNERS],
    )
    walked = narrow.groupBy("video_id").transformWithStateInPandas(
        _TrackWalker(config, disorder), outputStructType=_OUT, outputMode="Append", timeMode="None"
    )
    walked = walked.observe("late_rows", F.count(F.when(F.col("late"), 1)).alias("n"))
    box = F.struct(*_CORNERS).alias("bbox")
    made = walked.select("video_id", "frame_idx", "det_idx", "conf", box, "track_id", "late")
    return made if with_late else made.where("not late").drop("late")
