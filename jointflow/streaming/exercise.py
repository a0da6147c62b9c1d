"""Repetition counting on a stream: the batch scan with its state kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from jointflow.config import Registry, StateTransform
from jointflow.functions.labels import rep_feedback
from jointflow.operators.exercise import tracked_angles
from jointflow.schema import EXERCISE_STATE, PERSON_KEY, TRACK_KEY
from jointflow.streaming.order import END

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups into which tracks are hashed. One call counts all tracks of a group together, as a call for every track costs more than the
#: counting. Running queries depend on this number and the next.
BUCKETS = 1024
#: Pages of a group: its tracks are kept in so many entries of its map, by track id, as reading and writing an entry for every track
#: costs more than the counting. A call reads and writes the pages of the tracks it has rows of.
PAGES = 4

# A page in columns: tracks one after the other; of phase, count and angle each track has one per machine.
_TRACKS = "video_id ARRAY<STRING>, track_id ARRAY<LONG>"
_STATE = (
    f"{_TRACKS}, frame_idx ARRAY<LONG>, det_idx ARRAY<INT>, seen_ms ARRAY<LONG>, "
    "down ARRAY<BOOLEAN>, reps ARRAY<LONG>, angle ARRAY<DOUBLE>"
)
_OUT = (
    "video_id STRING, frame_idx LONG, det_idx INT, track_id LONG, machine INT, "
    "rep_count LONG, down BOOLEAN, angle DOUBLE, late BOOLEAN"
)


def advance(angle, seen, down_limit, up_limit, start_down, start_reps, start_angle, starts=None):
    """Run one counter over a track's next rows: ``(down, reps, angle)`` per row.

    ``seen`` is false where a row has no angle (NaN is an angle). A row forces the phase, flips it
    (only if the limits are the wrong way round) or leaves it. With ``starts``, the place of the first row of each row's
    track, the rows are those of several tracks one after the other, and what they start from is given per row.
    """
    at = np.arange(len(seen))
    first = np.zeros(len(seen), dtype=np.int64) if starts is None else starts

    def counted(marks):
        upto = np.cumsum(marks)
        return upto - (upto[first] - marks[first])

    def latest(marks):
        """The place of the last marked row of the track up to each row, or one before the track's first."""
        place = np.maximum.accumulate(np.where(marks, at, -1))
        return place, place >= first

    with np.errstate(invalid="ignore"):
        below, above = seen & (angle < down_limit), seen & (angle > up_limit)
    flips = counted(below & above) % 2 == 1
    # As seen from the start of the run: undo the flips so far.
    place, some = latest(below ^ above)
    base = np.where(some, (below ^ flips)[place], start_down)
    down = base.astype(bool) ^ flips
    was = np.where(at == first, start_down, np.roll(down, 1)).astype(bool)
    reps = start_reps + counted(was & ~down)
    place, some = latest(seen)
    return down, reps, np.where(some, angle[place], start_angle)


class _RepCounter(StatefulProcessor):
    """State per (video, track), on the pages of its group: where it is in the video, when it was last counted, and phase, count and angle per machine.

    With ``disorder`` there are pages of each track's clock, the highest frame it has seen, and its rows that wait.
    """

    def __init__(self, limits: Sequence[tuple[int, float, float]], ttl_ms: int | None, disorder: int):
        self.limits = list(limits)
        self.ttl_ms = ttl_ms
        self.disorder = disorder
        columns = [("frame_idx", "LONG", np.int64), ("det_idx", "INT", np.int32)]
        for machine, *_ in limits:
            columns += [(f"angle{machine}", "DOUBLE", float), (f"seen{machine}", "BOOLEAN", bool)]
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        #: The tracks on the pages in hand.
        self.state: dict[tuple[str, int], tuple] = {}
        self.pages = handle.getMapState("tracks", "page INT", _STATE, self.ttl_ms)
        if self.disorder:
            waiting = ", ".join([f"{_TRACKS}, clock ARRAY<LONG>, n ARRAY<LONG>", *[f"{n} ARRAY<{t}>" for n, t, _ in self.columns]])
            self.waiting = handle.getMapState("waiting", "page INT", waiting)

    def _read(self, pages: Sequence[int], now: int) -> None:
        """Take the tracks on these pages in hand, but for those not counted for the time to live."""
        n, self.state = len(self.limits), {}
        for page in pages:
            if (kept := self.pages.getValue((page,))) is None:
                continue
            videos, ids, frames, dets, seen, *parts = kept
            for k, track in enumerate(zip(videos, ids)):
                if self.ttl_ms is None or seen[k] + self.ttl_ms > now:
                    self.state[track] = (frames[k], dets[k], seen[k], *[p[k * n : k * n + n] for p in parts])

    def _write(self, pages: Sequence[int]) -> None:
        for page, tracks in _paged(self.state, pages):
            frames, dets, seen, *parts = zip(*[self.state[t] for t in tracks])
            flat = [[x for own in part for x in own] for part in parts]
            self.pages.updateValue((page,), (*map(list, zip(*tracks)), list(frames), list(dets), list(seen), *flat))

    def _due(self, given: pd.DataFrame) -> pd.DataFrame:
        """The rows that are due, of those given and those that waited; the others wait on."""
        keys = list(TRACK_KEY)
        clocks = given.groupby(keys, sort=False)["frame_idx"].max()
        clocks = {(video, int(track)): int(clock) for (video, track), clock in clocks.items()}
        pages = _pages(clocks)
        parts, known = [], {}
        for page in pages:
            if (kept := self.waiting.getValue((page,))) is None:
                continue
            videos, ids, clock, n, *values = kept
            known.update(zip(zip(videos, ids), clock))
            if sum(n):
                made = {name: np.array([np.nan if x is None else x for x in v] if kind is float else v, dtype=kind)
                        for (name, _, kind), v in zip(self.columns, values)}
                parts.append(pd.DataFrame({"video_id": np.repeat(np.array(videos, object), n), "track_id": np.repeat(np.array(ids, np.int64), n), **made}))
        known.update({track: max(known.get(track, clock), clock) for track, clock in clocks.items()})
        kinds = {n: kind for n, _, kind in self.columns}
        rows = given.loc[given["det_idx"].notna(), [*keys, *kinds]].astype(kinds)
        rows = pd.concat([*parts, rows], ignore_index=True) if parts else rows.reset_index(drop=True)
        group, tracks = _grouped(rows)
        clock = np.array([known[t] for t in tracks], dtype=np.int64)[group]
        due = rows["frame_idx"].to_numpy() <= np.where(clock == END, END, clock - self.disorder)
        rest, of = rows[~due], group[~due]
        order = np.argsort(of, kind="stable")
        rest, ends = rest.iloc[order], np.cumsum(np.bincount(of, minlength=len(tracks)))
        values = [rest[n].to_numpy() for n in kinds]
        places = {t: np.arange(end - n, end) for t, end, n in zip(tracks, ends, np.diff(ends, prepend=0))}
        for page, own in _paged(known, pages):
            at = [places.get(t, ends[:0]) for t in own]
            kept = ([known[t] for t in own], [len(x) for x in at], *[v[np.concatenate(at)].tolist() for v in values])
            self.waiting.updateValue((page,), (*map(list, zip(*own)), *kept))
        return rows[due].reset_index(drop=True)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        # A track's rows of one micro-batch come in any order and several pieces, and a row that
        # was delivered twice counts once, in one micro-batch as over several.
        given = pd.concat(list(rows), ignore_index=True)
        pdf = self._due(given) if self.disorder else given[given["det_idx"].notna()]
        group, tracks = _grouped(pdf)
        order = np.lexsort((pdf["det_idx"].to_numpy(), pdf["frame_idx"].to_numpy(), group))
        pdf, group = pdf.iloc[order].reset_index(drop=True), group[order]
        frame, det = pdf["frame_idx"].to_numpy(np.int64), pdf["det_idx"].to_numpy(np.int32)
        n, none = len(self.limits), (np.iinfo(np.int64).min, -1)
        now = 0 if self.ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
        pages = _pages(tracks)
        self._read(pages, now)
        before = [self.state.get(t) or (*none, now, [False] * n, [0] * n, [0.0] * n) for t in tracks]
        old_frame = np.array([b[0] for b in before], dtype=np.int64)[group]
        old_det = np.array([b[1] for b in before], dtype=np.int64)[group]
        late = (frame < old_frame) | ((frame == old_frame) & (det <= old_det))
        late[1:] |= (group[1:] == group[:-1]) & (frame[1:] == frame[:-1]) & (det[1:] == det[:-1])
        out = [c.split()[0] for c in _OUT.split(", ")]
        if late.any():
            yield pdf[late].assign(machine=-1, rep_count=0, down=False, angle=0.0, late=True)[out]
        pdf, group = pdf[~late].reset_index(drop=True), group[~late]
        if not len(pdf):
            return
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        starts = np.repeat(begin, np.diff(begin, append=len(pdf)))
        last = np.append(begin[1:], len(pdf)) - 1
        after = []
        for i, (machine, down_limit, up_limit) in enumerate(self.limits):
            down0, reps0, angle0 = (
                np.array([b[part][i] for b in before], dtype=kind)[group] for part, kind in ((3, bool), (4, np.int64), (5, float))
            )
            on, count, held = advance(
                pdf[f"angle{machine}"].to_numpy(dtype=float),
                pdf[f"seen{machine}"].to_numpy(dtype=bool),
                down_limit,
                up_limit,
                down0,
                reps0,
                angle0,
                starts,
            )
            after.append((on[last].tolist(), count[last].tolist(), held[last].tolist()))
            yield pdf.assign(machine=machine, rep_count=count, down=on, angle=held, late=False)[out]
        ends = zip(group[last].tolist(), pdf["frame_idx"].to_numpy()[last].tolist(), pdf["det_idx"].to_numpy(np.int32)[last].tolist())
        for k, (g, frame_idx, det_idx) in enumerate(ends):
            self.state[tracks[g]] = (frame_idx, det_idx, now, *[[a[part][k] for a in after] for part in range(3)])
        self._write(pages)

    def close(self) -> None:
        pass


def _grouped(rows: pd.DataFrame) -> tuple[np.ndarray, list[tuple[str, int]]]:
    """Per row the number of its track, and the tracks by number."""
    by = rows.groupby(list(TRACK_KEY), sort=False)
    firsts = rows.loc[~rows.duplicated(list(TRACK_KEY)), list(TRACK_KEY)]
    return by.ngroup().to_numpy(), list(zip(firsts["video_id"].tolist(), firsts["track_id"].tolist()))


def _pages(tracks: Iterable[tuple[str, int]]) -> list[int]:
    """The pages these tracks are on."""
    return sorted({track % PAGES for _, track in tracks})


def _paged(tracks: Iterable[tuple[str, int]], pages: Sequence[int]) -> Iterator[tuple[int, list[tuple[str, int]]]]:
    """Each of ``pages`` that has some of the tracks, and these."""
    by_page: dict[int, list] = {page: [] for page in pages}
    for track in tracks:
        by_page[track[1] % PAGES].append(track)
    return ((page, own) for page, own in by_page.items() if own)


def use_rocksdb(spark: SparkSession) -> None:
    """State lives on disk and in the checkpoint, so it may outgrow executor memory. A micro-batch adds what it changed to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def stream_exercise_states(
    persons: DataFrame,
    config: Mapping[str, Mapping],
    registry: Registry | None = None,
    ttl_ms: int | None = None,
    with_late: bool = False,
    disorder: int = 0,
) -> DataFrame:
    """State of every active exercise for every person row of a stream, as the batch scan gives it.

    The joints are evaluated in the JVM; only keys and one angle per exercise reach the stateful
    step. Rows inside a micro-batch may come in any order. Micro-batches must follow the frame order of each track up to
    ``disorder`` frames: with 0 all rows are counted as they come; else a row waits in the state until its track has been seen
    ``disorder`` frames further on, and rows are counted in order. A row without ``det_idx`` is a mark that moves its track's clock only; one at frame
    :data:`~jointflow.streaming.order.END` ends the track and releases what still waits. Rows not newer than a
    track's state came too late to be counted, repeated rows as well: the metric ``late_rows`` of every micro-batch tells how
    many, and ``with_late`` keeps them as rows without a state and with ``late`` true, for
    :func:`~jointflow.sources.detections.stream_states` to write to a table of their own. A track's rows of one micro-batch
    are sorted in one task, so bound the micro-batch (``max_files`` of the source). With ``ttl_ms`` the state of a track
    not seen for that long (processing time) is dropped and the track starts over; such a query must
    be stopped or triggered once, as it runs empty batches to watch the clock.

    Custom transforms run in the plan of the stream, on every row as it comes: one whose rows depend on their own person row alone
    gives the same states as in a batch (a row delivered twice gives its states twice), and Spark refuses one with windows or other
    state over rows when the query starts.
    """
    registry = registry or Registry()
    machines = registry.machines(config)
    own = [_own_states(persons, *custom, with_late) for custom in registry.custom(config)]
    if own and not machines:
        return reduce(DataFrame.unionByName, own)
    if not machines:
        types = {f.name: f.dataType for f in EXERCISE_STATE.fields}
        types |= {"late": T.BooleanType()} if with_late else {}
        none = [F.lit(None).cast(t).alias(n) for n, t in types.items() if n not in persons.columns]
        return persons.where("false").select("*", *none).select(*[F.col(n).cast(t).alias(n) for n, t in types.items()])
    use_rocksdb(persons.sparkSession)
    angles = tracked_angles(persons, machines, ())
    # Rows reach Python as named tuples, whose fields cannot start with an underscore.
    angles = angles.select(
        *PERSON_KEY,
        "track_id",
        F.pmod(F.xxhash64(*TRACK_KEY), F.lit(BUCKETS)).alias("bucket"),
        *[F.col(f"_m{m.ordinal}_angle").alias(f"angle{m.ordinal}") for m in machines],
        *[F.col(f"_m{m.ordinal}_angle").isNotNull().alias(f"seen{m.ordinal}") for m in machines],
    )
    counted = angles.groupBy("bucket").transformWithStateInPandas(
        _RepCounter([(m.ordinal, m.down, m.up) for m in machines], ttl_ms, disorder),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
    counted = counted.observe("late_rows", F.count(F.when(F.col("late"), 1)).alias("n"))
    if not with_late:
        counted = counted.where("not late")
    name = F.create_map(*[F.lit(v) for m in machines for v in (m.ordinal, m.name)])
    reps = F.when(~F.col("late"), F.col("rep_count"))
    made = counted.withColumns(
        {
            "exercise": name[F.col("machine")],
            "rep_count": reps,
            "phase": F.when(~F.col("late"), F.when(F.col("down"), F.lit("down")).otherwise(F.lit("up"))),
            # NaN leaves pandas as NULL, and an angle is never NULL.
            "angle": F.when(~F.col("late"), F.coalesce("angle", F.lit(float("nan")))),
            "feedback": F.when(~F.col("late"), rep_feedback(F.col("rep_count"))),
        }
    )
    made = made.select(*EXERCISE_STATE.fieldNames(), *(["late"] if with_late else []))
    return reduce(DataFrame.unionByName, own, made)


def _own_states(
    persons: DataFrame, ordinal: int, name: str, settings: Mapping, transform: StateTransform, with_late: bool
) -> DataFrame:
    """State rows of a custom transform, in the stream's own plan."""
    rows = transform(persons.where("det_idx IS NOT NULL"), settings).withColumn("exercise", F.lit(name))
    if lacking := [n for n in EXERCISE_STATE.fieldNames() if n not in rows.columns]:
        raise ValueError(f"the rows of transform {name} lack {', '.join(lacking)}")
    late = [F.lit(False).alias("late")] if with_late else []
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in EXERCISE_STATE.fields], *late)
