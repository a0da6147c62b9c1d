"""Repetition counting on a stream in which one track may hold most rows of a micro-batch.

A run of a track's rows acts on a counter as a small summary: the phase it ends in for either phase it may start in, the
repetitions it adds for either, and its last angle. Summaries of neighbouring runs compose. Each micro-batch cuts its long tracks
into chunks, makes one summary per (track, chunk) in the JVM, folds the summaries of a track onto the state that the micro-batch before
left, and joins each chunk's start to its rows. No task holds a whole track, and no row passes through Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jointflow.config import Machine, Registry
from jointflow.operators import exercise as ex
from jointflow.schema import EXERCISE_STATE, PERSON_KEY, TRACK_KEY, TRACK_ORDER
from jointflow.session import discard, written
from jointflow.sources.versions import Versions

_CHUNK = "_chunk"
_LAST = ("last_frame", "last_det")


def state_schema(machines: Sequence[Machine]) -> T.StructType:
    """A track's state between micro-batches: its last row and, per counter, phase, repetitions and angle."""
    own = [f"_m{m.ordinal}_{part}" for m in machines for part in ("down0 BOOLEAN", "reps0 LONG", "angle0 DOUBLE")]
    return T._parse_datatype_string(", ".join(["video_id STRING, track_id LONG, last_frame LONG, last_det INT", *own]))


def _summaries(scanned: DataFrame, phases: Mapping, tags: Sequence[str]) -> DataFrame:
    """One row per (track, chunk): what its rows do to each counter."""
    packed = []
    for t in tags:
        _, _, forced, flip = phases[t]
        packed += [forced.alias(f"{t}_forced"), F.col(f"{t}_reps_False"), F.col(f"{t}_reps_True"), F.col(f"{t}_held")]
        packed += [] if flip is None else [flip.alias(f"{t}_flip")]
    order = F.struct(*TRACK_ORDER)
    return (
        scanned.groupBy(*TRACK_KEY, _CHUNK)
        .agg(F.max_by(F.struct(*packed), order).alias("end"), F.max(F.when(~F.col("_late"), order)).alias("_counted"))
        .select(*TRACK_KEY, _CHUNK, "_counted", "end.*")
    )


def _folded(summaries: DataFrame, before: DataFrame, phases: Mapping, tags: Sequence[str]) -> DataFrame:
    """Summaries with each counter's phase, repetitions and angle at the start and the end of the chunk."""
    initial = {c: v for t in tags for c, v in ((f"{t}_down0", False), (f"{t}_reps0", 0), (f"{t}_angle0", 0.0))}
    chunks = summaries.join(before, list(TRACK_KEY), "left")
    chunks = chunks.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in initial.items()})
    window = Window.partitionBy(*TRACK_KEY).orderBy(_CHUNK)
    signals = {t: (F.col(f"{t}_forced"), None if phases[t][3] is None else F.col(f"{t}_flip")) for t in tags}
    chunks, runs = ex._phases(chunks, signals, window)
    chunks = chunks.withColumns({f"{t}_start": runs[t][1](F.col(f"{t}_down0")) for t in tags})
    gain = {t: F.when(F.col(f"{t}_start"), F.col(f"{t}_reps_True")).otherwise(F.col(f"{t}_reps_False")) for t in tags}
    chunks = chunks.withColumns({f"{t}_gain": gain[t] for t in tags})
    upto = ex._upto(window, -1)
    added = {}
    for t in tags:
        added[f"{t}_base"] = F.col(f"{t}_reps0") + F.coalesce(F.sum(f"{t}_gain").over(upto), F.lit(0))
        added[f"{t}_from"] = F.coalesce(F.last(f"{t}_held", ignorenulls=True).over(upto), f"{t}_angle0")
        added[f"{t}_down"] = runs[t][0](F.col(f"{t}_down0"))
    return chunks.withColumns(added)


def advance_tracks(
    rows: DataFrame, before: DataFrame, machines: Sequence[Machine], cut: ex.Cut = "auto"
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(states, late, after, chunks)``: a micro-batch counted on from the states ``before``.

    ``rows`` come from :func:`~jointflow.operators.exercise.tracked_angles` and should be a table; they may come in any order.
    ``before`` has the columns of :func:`state_schema`, at most one row per track. Rows not newer than their track's last one, and all but one of
    rows with the same track, frame and position, are ``late`` and count for nothing (of different such rows, which one counts is not defined).
    ``after`` has a row for every track in ``rows``. ``chunks`` is the written table that the other results read.
    """
    tags = [f"_m{m.ordinal}" for m in machines]
    cutter = ex._cutter(rows, cut) or (lambda df: df.withColumn(_CHUNK, F.lit(0).cast("bigint")))
    placed = cutter(rows).withColumn(_CHUNK, F.coalesce(_CHUNK, F.lit(0).cast("bigint")))
    placed = placed.join(before.select(*TRACK_KEY, *_LAST), list(TRACK_KEY), "left")
    window = Window.partitionBy(*TRACK_KEY, _CHUNK).orderBy(*TRACK_ORDER)
    at = F.struct(*TRACK_ORDER)
    frame, det = F.col("last_frame"), F.col("last_det")
    old = (F.col("frame_idx") < frame) | ((F.col("frame_idx") == frame) & (F.col("det_idx") <= det))
    late = F.coalesce(old, F.lit(False)) | F.coalesce(F.lag(at).over(window) == at, F.lit(False))
    marked = placed.withColumn("_late", late)
    # A row without an angle moves no counter, and neither does a late one.
    marked = marked.withColumns({f"{t}_angle": F.when(~F.col("_late"), F.col(f"{t}_angle")) for t in tags})
    scanned, phases = ex._scan(marked, machines, window, [False, True])
    chunks = written(_folded(_summaries(scanned, phases, tags), before, phases, tags), "track-chunks")

    starts = chunks.select(*TRACK_KEY, _CHUNK, *[f"{t}_{c}" for t in tags for c in ("start", "base", "from")])
    joined = scanned.where("not _late").join(starts, [*TRACK_KEY, _CHUNK])
    states = []
    for m, t in zip(machines, tags):
        start = F.col(f"{t}_start")
        reps = F.when(start, F.col(f"{t}_reps_True")).otherwise(F.col(f"{t}_reps_False"))
        held = F.coalesce(f"{t}_held", f"{t}_from")
        states.append(ex._state(m, phases[t][0](start), phases[t][1](start), F.col(f"{t}_base") + reps, held))
    counted = ex.state_rows(joined.select(*PERSON_KEY, "track_id", F.array(*states).alias("states")))

    ends = [
        end.alias(f"{t}_{name}")
        for t in tags
        for name, end in (
            ("down0", F.col(f"{t}_down")),
            ("reps0", F.col(f"{t}_base") + F.col(f"{t}_gain")),
            ("angle0", F.coalesce(f"{t}_held", f"{t}_from")),
        )
    ]
    after = chunks.groupBy(*TRACK_KEY).agg(
        F.max_by(F.struct(*ends), _CHUNK).alias("end"),
        F.max("_counted").alias("counted"),
        F.max(F.when(frame.isNotNull(), F.struct(*_LAST))).alias("kept"),
    )
    after = after.select(
        *TRACK_KEY,
        F.coalesce("counted.frame_idx", "kept.last_frame").alias("last_frame"),
        F.coalesce("counted.det_idx", "kept.last_det").alias("last_det"),
        "end.*",
    )
    return counted.select(*EXERCISE_STATE.fieldNames()), marked.where("_late").select(*PERSON_KEY, "track_id"), after, chunks


def count_stream(
    persons: DataFrame,
    config: Mapping[str, Mapping],
    path: str,
    checkpoint: str,
    registry: Registry | None = None,
    cut: ex.Cut = "auto",
    available_now: bool = True,
) -> StreamingQuery:
    """Count a stream of persons: states under ``path/states``, late rows under ``path/late``, the tracks' states under ``path/tracks``.

    The same states as :func:`~jointflow.streaming.exercise.stream_exercise_states` with ``disorder=0``, for streams whose micro-batches are large or
    whose tracks are few. Each micro-batch writes folders of its own, which it overwrites when it is run again, so every row is counted once for each ``checkpoint``.
    Rows without video, track, frame or position are in no result. The states of the tracks it touches are broadcast only
    below ``BROADCAST_TRACKS`` of them, counted each time. Transforms and an empty config are refused.
    """
    registry = registry or Registry()
    if custom := [name for _, name, *_ in registry.custom(config)]:
        raise ValueError(f"transforms have no summary: {', '.join(custom)}")
    machines = registry.machines(config)
    if not machines:
        raise ValueError("no active exercise")
    tracks = Versions(f"{path}/tracks", TRACK_KEY, _LAST, state_schema(machines))

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = written(ex.tracked_angles(batch.where("det_idx IS NOT NULL"), machines, ()), "micro-batch")
        touched = written(rows.select(*TRACK_KEY).distinct(), "touched-tracks")
        few = touched.count() <= ex.BROADCAST_TRACKS
        sent = F.broadcast if few else (lambda df: df)
        before = written(tracks.read(batch.sparkSession, batch_id - 1, sent(touched)), "states-before")
        states, late, after, chunks = advance_tracks(rows, sent(before), machines, cut)
        states.write.mode("overwrite").parquet(f"{path}/states/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        tracks.write(after, batch_id)
        discard(rows, touched, before, chunks)

    writer = persons.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
