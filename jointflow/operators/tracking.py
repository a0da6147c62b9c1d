"""Persistent track ids for flat detections.

A tracker is sequential, and one video may hold a large share of all rows. Videos are
therefore cut into segments of ``segment_frames`` frames that are tracked side by side. Each segment first assumes that
its tracker has seen the ``warmup_frames`` frames before it only. Then the live tracks with which a segment ended are
compared with those its successor assumed, as exact numbers; segments that assumed wrongly are tracked again from the
true ones, until none is left. So ids are those of a tracker that walks whole videos, however the cut falls. After a
gap longer than the tracker remembers, both sides are empty and nothing is tracked twice.

The tracker associates boxes in two stages, first the confident detections and then the weaker ones (ByteTrack, 2021), with
constant velocity in place of a Kalman filter and greedy in place of optimal matching. Its live tracks are a set: ties are
told by place, not by age. A tracker of one's own that has a method ``resume`` gets a video piece by piece with the state it returned
for the piece before; one given as a plain function has no state to hand on and gets whole videos unless a cut is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jointflow.schema import PERSON_KEY
from jointflow.session import written

SEGMENT_FRAMES = 9_000

_CORNERS = ("x1", "y1", "x2", "y2")
_TRACKLET = ("video_id", "segment", "local_id")


@dataclass(frozen=True)
class TrackerConfig:
    """Detections from ``high`` start tracks, those from ``low`` can only continue one. A track ends
    after ``max_lost`` frames without a detection."""

    high: float = 0.5
    low: float = 0.1
    match_iou: float = 0.2
    max_lost: int = 30


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    height = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = width.clip(0) * height.clip(0)
    area_a = (a[:, 2] - a[:, 0]).clip(0) * (a[:, 3] - a[:, 1]).clip(0)
    area_b = (b[:, 2] - b[:, 0]).clip(0) * (b[:, 3] - b[:, 1]).clip(0)
    union = area_a[:, None] + area_b[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def _match(predicted: np.ndarray, boxes: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Greedy one-to-one matches ``(track position, box position)`` by IoU, then by position."""
    if not len(predicted) or not len(boxes):
        return []
    scores = _iou(predicted, boxes)
    rows, cols = np.nonzero(scores >= least)
    order = np.lexsort((cols, rows, -scores[rows, cols]))
    used_rows, used_cols, pairs = set(), set(), []
    for r, c in zip(rows[order].tolist(), cols[order].tolist()):
        if r not in used_rows and c not in used_cols:
            used_rows.add(r)
            used_cols.add(c)
            pairs.append((r, c))
    return pairs


#: Pairs of a track and a box up to which plain numbers are faster than arrays.
FEW_PAIRS = 400


def _match_few(predicted: list[tuple], boxes: list[tuple], least: float) -> list[tuple[int, int]]:
    """The same as :func:`_match` for few finite boxes and a positive ``least``."""
    areas = [max(x2 - x1, 0.0) * max(y2 - y1, 0.0) for x1, y1, x2, y2 in boxes]
    scored = []
    for r, (x1, y1, x2, y2) in enumerate(predicted):
        for c, (u1, v1, u2, v2) in enumerate(boxes):
            width = (x2 if x2 < u2 else u2) - (x1 if x1 > u1 else u1)
            if width > 0:
                height = (y2 if y2 < v2 else v2) - (y1 if y1 > v1 else v1)
                if height > 0:
                    inter = width * height
                    union = (x2 - x1) * (y2 - y1) + areas[c] - inter
                    if union > 0 and inter / union >= least:
                        scored.append((-(inter / union), r, c))
    scored.sort()
    used_rows, used_cols, pairs = set(), set(), []
    for _, r, c in scored:
        if r not in used_rows and c not in used_cols:
            used_rows.add(r)
            used_cols.add(c)
            pairs.append((r, c))
    return pairs


#: Live tracks as arrays: local id, last frame, and last box with its speed in eight numbers.
State = dict[str, np.ndarray]


def _empty() -> State:
    return {"id": np.empty(0, np.int64), "last": np.empty(0, np.int64), "place": np.empty((0, 8))}


def _ordered(state: State, frame: int, max_lost: int) -> State:
    """The tracks that can still be found at ``frame``, in order of place and last frame."""
    alive = np.flatnonzero(frame - state["last"] <= max_lost)
    place, last, ids = state["place"][alive], state["last"][alive], state["id"][alive]
    order = alive[np.lexsort((ids, last, *place.T[::-1]))]
    return {k: state[k][order] for k in ("id", "last", "place")}


class TwoStageTracker:
    """A tracker whose live tracks can be handed on: rows sorted by frame and detection in, local ids (or NA) out.

    Works frame by frame; its state is the live tracks only.
    """

    def __init__(self, config: TrackerConfig) -> None:
        self.config = config

    def __call__(self, rows: pd.DataFrame) -> pd.Series:
        return self.resume(rows, None)[0]

    def resume(self, rows: pd.DataFrame, state: State | None) -> tuple[pd.Series, State]:
        config, state = self.config, _empty() if state is None else state
        frames = rows["frame_idx"].to_numpy()
        conf = rows["conf"].to_numpy(dtype=float)
        boxes = rows[list(_CORNERS)].to_numpy(dtype=float)
        ids = np.zeros(len(rows), dtype=np.int64)
        # A walk that is to be continued counts its ids on, also past those of tracks that have ended.
        next_id = int(state["next"][0]) if "next" in state else int(state["id"].max(initial=0)) + 1
        finite = bool(np.isfinite(boxes).all() and np.isfinite(state["place"]).all())
        plain = finite and config.match_iou > 0
        # A track is (place, last frame, id), and tracks are sorted as such: frames have few, for which arrays are slow.
        tracks = list(zip(map(tuple, state["place"].tolist()), state["last"].tolist(), state["id"].tolist()))
        edges = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(rows)] if len(rows) else []
        for begin, end in zip(edges, edges[1:]):
            frame = int(frames[begin])
            tracks = sorted((t for t in tracks if frame - t[1] <= config.max_lost), key=None if finite else _with_nan_last)
            given, placed = conf[begin:end].tolist(), list(map(tuple, boxes[begin:end].tolist()))
            strong = [i for i, c in enumerate(given) if c >= config.high]
            weak = [i for i, c in enumerate(given) if config.low <= c < config.high]
            named = [0] * len(given)
            free = list(range(len(tracks)))
            for group in (strong, weak):
                if not group or not free:
                    continue
                ahead = []
                for t in free:
                    (x1, y1, x2, y2, dx1, dy1, dx2, dy2), last, _ = tracks[t]
                    gap = frame - last
                    ahead.append((x1 + dx1 * gap, y1 + dy1 * gap, x2 + dx2 * gap, y2 + dy2 * gap))
                here = [placed[i] for i in group]
                if plain and len(ahead) * len(here) <= FEW_PAIRS:
                    found = _match_few(ahead, here, config.match_iou)
                else:
                    found = _match(np.array(ahead), np.array(here), config.match_iou)
                for r, c in found:
                    t, row = free[r], group[c]
                    place, last, name = tracks[t]
                    steps = max(frame - last, 1)
                    tracks[t] = (placed[row] + tuple([(to - at) / steps for to, at in zip(placed[row], place)]), frame, name)
                    named[row] = name
                taken = {r for r, _ in found}
                free = [t for r, t in enumerate(free) if r not in taken]
            for row in strong:
                if not named[row]:
                    named[row] = next_id
                    tracks.append((placed[row] + (0.0,) * 4, frame, next_id))
                    next_id += 1
            ids[begin:end] = named
        state = {
            "id": np.array([t[2] for t in tracks], np.int64),
            "last": np.array([t[1] for t in tracks], np.int64),
            "place": np.array([t[0] for t in tracks], float).reshape(-1, 8),
            "next": np.array([next_id]),
        }
        return pd.Series(ids, index=rows.index, dtype="Int64").replace(0, pd.NA), state


def _with_nan_last(track: tuple) -> tuple:
    place, last, name = track
    return [(x != x, 0.0 if x != x else x) for x in place], last, name


def two_stage_tracker(config: TrackerConfig = TrackerConfig()) -> TwoStageTracker:
    return TwoStageTracker(config)


def _segments(rows: DataFrame, segment_frames: int | None, warmup_frames: int) -> DataFrame:
    """Rows with their segment, and again with the next one where they are in its warm-up."""
    if segment_frames is None:
        return rows.withColumn("segment", F.lit(0).cast("bigint")).withColumn("own", F.lit(True))
    here = F.floor(F.col("frame_idx") / F.lit(segment_frames)).cast("bigint")
    ahead = F.floor((F.col("frame_idx") + warmup_frames) / F.lit(segment_frames)).cast("bigint")
    return (
        rows.withColumn("_home", here)
        .withColumn("segment", F.explode(F.sequence(here, ahead)))
        .withColumn("own", F.col("segment") == F.col("_home"))
        .drop("_home")
    )


def in_walk_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows by frame and detection; of rows with equal keys (a frame delivered twice) the surest one, or the one with the greatest corners, alone."""
    by = ["frame_idx", "det_idx", "conf", *_CORNERS]
    ordered = pdf.sort_values(by, ascending=[True, True] + [False] * (len(by) - 2), kind="stable")
    return ordered.drop_duplicates(["frame_idx", "det_idx"], ignore_index=True)


_RUN = "kind string, video_id string, segment long, frame_idx long, det_idx int, local_id long, place array<double>"


def _run_rows(kind: str, video: str, segment: int, state: State) -> pd.DataFrame:
    n = len(state["id"])
    return pd.DataFrame(
        {
            "kind": [kind] * n,
            "video_id": video,
            "segment": segment,
            "frame_idx": state["last"],
            "det_idx": np.arange(n, dtype=np.int32),
            "local_id": state["id"],
            "place": list(state["place"]),
        }
    )


def _tracked_segment(
    tracker: TwoStageTracker, pdf: pd.DataFrame, segment_frames: int, start: State | None
) -> pd.DataFrame:
    """A segment's ids (``row``) and the live tracks it began (``start``) and ended with (``end``)."""
    pdf = in_walk_order(pdf)
    video, segment = pdf["video_id"].iloc[0], int(pdf["segment"].iloc[0])
    own = pdf[pdf["own"]]
    if start is None:
        _, start = tracker.resume(pdf[~pdf["own"]], _empty())
    border, max_lost = segment * segment_frames, tracker.config.max_lost
    start = _ordered(start, border, max_lost)
    start["id"] = np.arange(1, len(start["id"]) + 1)  # slots, in order of place
    ids, end = tracker.resume(own, start)
    rows = own[["video_id", "segment", "frame_idx", "det_idx"]].assign(kind="row", local_id=ids, place=None)
    parts = [rows, _run_rows("start", video, segment, start), _run_rows("end", video, segment, end)]
    return pd.concat([p.astype({"local_id": "Int64"}) for p in parts])[[c.split()[0] for c in _RUN.split(", ")]]


def _states(runs: DataFrame, segment_frames: int, max_lost: int) -> DataFrame:
    """Per segment: the live tracks it assumed, and those its predecessor handed on that can still be found.

    Live tracks of one frame are few; only they are gathered.
    """
    track = F.struct("place", F.col("frame_idx").alias("last"), "local_id")
    gathered = runs.groupBy("video_id", "segment").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "start", track))).alias("start"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "end", track))).alias("end"),
    )
    order = Window.partitionBy("video_id").orderBy("segment")
    handed = F.coalesce(F.lag("end").over(order), F.filter("start", lambda t: F.lit(False)))
    border = F.col("segment") * F.lit(segment_frames)
    return gathered.withColumn("prev_segment", F.lag("segment").over(order)).withColumn(
        "handed", F.filter(handed, lambda t: border - t["last"] <= max_lost)
    )


def _without_names(tracks: str):
    return F.transform(tracks, lambda t: F.struct(t["place"].alias("place"), t["last"].alias("last")))


def _resumed(rows: DataFrame, tracker: TwoStageTracker, segment_frames: int, warmup_frames: int) -> tuple[DataFrame, DataFrame]:
    """Ids of all segments as if videos had been tracked in one piece, and the states that link them."""
    max_lost = tracker.config.max_lost
    cut = _segments(rows, segment_frames, warmup_frames)
    key = ["video_id", "segment"]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tracked_segment(tracker, pdf, segment_frames, None) if pdf["own"].any() else pd.DataFrame(columns=[c.split()[0] for c in _RUN.split(", ")])

    def again(pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        tracks = given["handed"].iloc[0]
        state = _empty() if not len(tracks) else {
            "id": np.array([t["local_id"] for t in tracks]),
            "last": np.array([t["last"] for t in tracks]),
            "place": np.array([t["place"] for t in tracks], dtype=float),
        }
        return _tracked_segment(tracker, pdf, segment_frames, state)

    runs = written(cut.groupBy(*key).applyInPandas(first, _RUN), "segments")
    while True:
        states = written(_states(runs, segment_frames, max_lost), "segment-states")
        wrong = states.where(_without_names("start") != _without_names("handed")).select(*key, "handed")
        if wrong.isEmpty():
            return runs.where("kind = 'row'"), states
        # Only these are tracked again; the first of them for the last time.
        own = cut.where("own").join(wrong.select(*key), key, "left_semi")
        better = own.groupBy(*key).cogroup(wrong.groupBy(*key)).applyInPandas(again, _RUN)
        runs = written(runs.join(wrong.select(*key), key, "left_anti").unionByName(better), "segments")


def track_with(
    rows: DataFrame,
    tracker: Callable[[pd.DataFrame], pd.Series],
    segment_frames: int | None = None,
    warmup_frames: int = 60,
) -> DataFrame:
    """Set ``track_id`` of flat detections with a tracker of one's own.

    ``tracker`` gets the rows of one video (``frame_idx, det_idx, conf, x1, y1, x2, y2``) in
    order and returns a local id per row, NA for none. Ids of the result count from 1 per
    video in order of appearance. With ``segment_frames`` it gets a segment at a time, begun ``warmup_frames`` earlier, and
    tracks of neighbours are linked by the detections both saw: right for trackers that forget all within the warm-up,
    which must be at most ``segment_frames``. Only keys, confidence and box travel to
    Python; the other columns are joined back.

    A tracker with a method ``resume(rows, state)`` that returns ``(ids, state)`` gets a video in pieces of whole frames, in order,
    with None as state at its start. A video is then one walk in one task, but sorted outside of memory and
    never held whole: a task has one Arrow batch, one frame and the state at a time. Ids must not depend on where the pieces end.
    """
    if segment_frames is not None and not callable(tracker):
        raise ValueError("a tracker that only resumes walks whole videos; leave segment_frames out")
    if segment_frames is None and hasattr(tracker, "resume"):
        local = written(_walked(_narrow(rows), tracker), "tracklets")
        return _assigned(rows, local, None)
    if segment_frames is not None and not 0 < warmup_frames <= segment_frames:
        raise ValueError("warmup_frames must be positive and at most segment_frames")
    narrow = _narrow(rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_walk_order(pdf)
        pdf["local_id"] = tracker(pdf)
        return pdf[["video_id", "segment", "frame_idx", "det_idx", "own", "local_id"]]

    local = written(
        _segments(narrow, segment_frames, warmup_frames)
        .groupBy("video_id", "segment")
        .applyInPandas(
            run,
            "video_id string, segment long, frame_idx long, det_idx int, own boolean, local_id long",
        ),
        "tracklets",
    )
    links = _links(local).withColumn("prev_segment", F.col("segment") - 1)
    return _assigned(rows, local.filter("own"), links)


def _narrow(rows: DataFrame) -> DataFrame:
    return rows.select(*PERSON_KEY, "conf", *[F.col(f"bbox.{c}").alias(c) for c in _CORNERS])


def _walked(narrow: DataFrame, tracker) -> DataFrame:
    """Local ids of a tracker with a state: each video is one walk over its sorted rows, a batch at a time."""
    names = ["video_id", "frame_idx", "det_idx", "local_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state, held = None, None, None

        def walk(ready: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal video, state
            for name, own in ready.groupby("video_id", sort=False):
                if name != video:
                    video, state = name, None
                own = in_walk_order(own)
                own["local_id"], state = tracker.resume(own, state)
                yield own[names]

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            # The last frame may go on in the next batch.
            last = rows.iloc[-1]
            open_frame = (rows["video_id"] == last["video_id"]) & (rows["frame_idx"] == last["frame_idx"])
            yield from walk(rows[~open_frame])
            held = rows[open_frame]
        if held is not None:
            yield from walk(held)

    ordered = narrow.dropna(subset=list(PERSON_KEY)).repartition("video_id").sortWithinPartitions(*PERSON_KEY)
    local = ordered.mapInPandas(run, "video_id string, frame_idx long, det_idx int, local_id long")
    return local.withColumns({"segment": F.lit(0).cast("bigint"), "own": F.lit(True)})


def _assigned(rows: DataFrame, local: DataFrame, links: DataFrame | None) -> DataFrame:
    """Ids joined back to the rows; ``links`` is None if each video is one segment. A detection that was delivered more than once has the id of its best copy in all its rows."""
    ids = _global_ids(local, links)
    assigned = local.join(ids, list(_TRACKLET), "left").select(*PERSON_KEY, F.col("id").alias("track_id"))
    columns = [c for c in rows.columns if c != "track_id"]
    # One id for each row: never to be broadcast, however small its files.
    return rows.select(*columns).join(assigned.hint("merge"), list(PERSON_KEY), "left")


def _links(local: DataFrame) -> DataFrame:
    """``(video_id, segment, local_id, prev_id)``: the track of the segment before that goes on here.

    Decided by the latest detection both trackers gave an id, one to one.
    """
    tracked = local.filter(F.col("local_id").isNotNull())
    before = tracked.filter("own").select(
        *PERSON_KEY, (F.col("segment") + 1).alias("segment"), F.col("local_id").alias("prev_id")
    )
    warm = tracked.filter(~F.col("own")).drop("own")
    # A warm-up spans one segment at most, so the segment before holds all of it.
    # A plan by the size of these files, which is small for their rows, would broadcast all of them.
    shared = warm.join(before.hint("merge"), [*PERSON_KEY, "segment"])
    latest = F.struct("frame_idx", "det_idx")
    best = shared.groupBy(*_TRACKLET).agg(
        F.max_by("prev_id", latest).alias("prev_id"), F.max(latest).alias("seen")
    )
    return (
        best.groupBy("video_id", "segment", "prev_id")
        .agg(F.max_by("local_id", F.struct("seen", "local_id")).alias("local_id"))
        .select(*_TRACKLET, "prev_id")
    )


def _global_ids(local: DataFrame, links: DataFrame | None) -> DataFrame:
    """``(video_id, segment, local_id, id)``: chains of linked tracklets share one id.

    ``links`` name the tracklet before; one may live through a segment without a row of its own.
    """
    if links is None:
        seen = local.filter(F.col("local_id").isNotNull()).groupBy(*_TRACKLET).agg(F.min(F.struct("frame_idx", "det_idx")).alias("first"))
        return seen.select(*_TRACKLET, F.row_number().over(Window.partitionBy("video_id").orderBy("first")).alias("id"))
    nowhere = links.select(*_TRACKLET, F.lit(None).cast("long").alias("frame_idx"), F.lit(None).cast("int").alias("det_idx"))
    tracklets = (
        local.filter(F.col("local_id").isNotNull())
        .select(*_TRACKLET, "frame_idx", "det_idx")
        .unionByName(nowhere)
        .groupBy(*_TRACKLET)
        .agg(F.min(F.when(F.col("frame_idx").isNotNull(), F.struct("frame_idx", "det_idx"))).alias("first"))
    )
    # The head of a tracklet's chain, found by following ever longer jumps: each round doubles them,
    # so rounds grow with the logarithm of the longest chain. Tracklets are one row per track
    # and segment.
    jumps = written(
        tracklets.join(links, list(_TRACKLET), "left").select(
            *_TRACKLET,
            "first",
            F.when(
                F.col("prev_id").isNotNull(),
                F.struct(F.col("prev_segment").alias("segment"), F.col("prev_id").alias("local_id")),
            ).alias("to"),
            F.struct("segment", "local_id").alias("head"),
        ),
        "jumps",
    )
    while not jumps.filter(F.col("to").isNotNull()).isEmpty():
        target = jumps.select(
            "video_id",
            F.struct("segment", "local_id").alias("to"),
            F.col("to").alias("next"),
            F.col("head").alias("next_head"),
        )
        jumps = written(
            jumps.join(target, ["video_id", "to"], "left").select(
                *_TRACKLET,
                "first",
                F.col("next").alias("to"),
                F.coalesce("next_head", "head").alias("head"),
            ),
            "jumps",
        )
    # Ids in order of first appearance: heads before the segment, plus the rank inside it.
    heads = jumps.filter(
        (F.col("head.segment") == F.col("segment")) & (F.col("head.local_id") == F.col("local_id"))
    )
    in_segment = Window.partitionBy("video_id", "segment").orderBy("first")
    earlier = (
        Window.partitionBy("video_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = (
        heads.groupBy("video_id", "segment")
        .count()
        .withColumn("base", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    numbered = (
        heads.withColumn("rank", F.row_number().over(in_segment))
        .join(bases, ["video_id", "segment"])
        .select("video_id", "head", (F.col("base") + F.col("rank")).alias("id"))
    )
    return jumps.join(numbered, ["video_id", "head"]).select(*_TRACKLET, "id")


def assign_tracks(
    rows: DataFrame,
    config: TrackerConfig = TrackerConfig(),
    segment_frames: int | None = SEGMENT_FRAMES,
) -> DataFrame:
    """Set ``track_id`` by two-stage association; it stays NULL on weak detections of no track.

    The result does not depend on ``segment_frames``. A detection without a confidence counts as sure.
    """
    tracker = two_stage_tracker(config)
    if segment_frames is None:
        sure = rows.withColumns({"_conf": F.col("conf"), "conf": F.coalesce("conf", F.lit(1.0))})
        return track_with(sure, tracker).withColumn("conf", F.col("_conf")).drop("_conf")
    conf = F.coalesce("conf", F.lit(1.0)).alias("conf")
    narrow = rows.select(*PERSON_KEY, conf, *[F.col(f"bbox.{c}").alias(c) for c in _CORNERS])
    local, states = _resumed(narrow, tracker, segment_frames, min(2 * config.max_lost, segment_frames))
    pairs = F.inline(F.arrays_zip(F.transform("start", lambda t: t["local_id"]).alias("local_id"), F.transform("handed", lambda t: t["local_id"]).alias("prev_id")))
    links = states.where("prev_segment is not null").select("video_id", "segment", "prev_segment", pairs)
    return _assigned(rows, local, links)
