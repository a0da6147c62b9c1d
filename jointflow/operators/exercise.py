"""Per-track repetition counting as window expressions.

A track's rows drive a two-state counter (up, down) per exercise. Every row either
sets the phase, flips it (only possible when ``down > up``) or leaves it alone, so a run
of rows acts on the phase as one of those three again. That makes the scan splittable, for the case
that one track holds a large share of all rows: such a track is cut into chunks of frames, each
chunk is scanned for both possible starting phases, the few chunk results are folded per
track, and the phase, count and angle found at each chunk's start are joined back. Tracks
of ordinary length are scanned in one piece by the same windows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from jointflow.config import Machine, Registry
from jointflow.functions.labels import rep_feedback
from jointflow.functions.pose import with_side_angles
from jointflow.schema import EXERCISE_STATE, PERSON_KEY, TRACK_KEY, TRACK_ORDER
from jointflow.session import written

#: Rows a chunk of a long track should have. Tracks of up to twice as many (18 hours at 30 frames
#: a second) stay in one piece.
CHUNK_ROWS = 1_000_000
#: Chunk borders of long tracks to send to every executor at most (8 bytes each, some 50 per track); with more
#: the tracks are joined by shuffle.
BROADCAST_TRACKS = 100_000
#: Chunks of a track at most; beyond that they grow.
MOST_CHUNKS = 1_000

#: How to cut tracks: ``"auto"`` cuts only long ones, a number cuts all of them every so many frames, None
#: none.
Cut = int | str | None

Phase = Callable[[Column], Column]

_CHUNK = "_chunk"


def _upto(window: WindowSpec, offset: int) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, offset)


def _signals(machine: Machine, angle: Column) -> tuple[Column, Column | None]:
    """``(set, flip)``: the phase a row forces (true is down, NULL is none), and whether it flips.

    NaN compares above every number in Spark, so it is excluded explicitly.
    """
    below = ~F.isnan(angle) & (angle < F.lit(machine.down))
    above = ~F.isnan(angle) & (angle > F.lit(machine.up))
    if machine.down <= machine.up:
        return F.when(below, F.lit(True)).when(above, F.lit(False)), None
    forced = F.when(below & ~above, F.lit(True)).when(above & ~below, F.lit(False))
    return forced, F.coalesce(below & above, F.lit(False))


def _phases(
    df: DataFrame, signals: Mapping[str, tuple[Column, Column | None]], window: WindowSpec
) -> tuple[DataFrame, dict[str, tuple[Phase, Phase, Column, Column | None]]]:
    """Add the running phase of every machine.

    Returns, per machine, the phase after and before each row as functions of the starting phase
    (true is down), plus the ``(set, flip)`` signals of the run up to and including the row.

    With flips, a forced phase is stored as seen from the start of the run, that is undoing the
    flips so far; the last one stored and the flips so far then give the phase of any row.
    """
    flips = {
        f"{tag}_flips": F.sum(flip.cast("long")).over(_upto(window, 0))
        for tag, (_, flip) in signals.items()
        if flip is not None
    }
    if flips:
        df = df.withColumns(flips)
    added, result = {}, {}
    for tag, (forced, flip) in signals.items():
        odd = odd_before = None
        if flip is not None:
            odd = F.col(f"{tag}_flips") % 2 == 1
            odd_before = (F.col(f"{tag}_flips") - flip.cast("long")) % 2 == 1
            forced = F.when(forced.isNotNull(), forced != odd)
        added[f"{tag}_now"] = F.last(forced, ignorenulls=True).over(_upto(window, 0))
        added[f"{tag}_was"] = F.last(forced, ignorenulls=True).over(_upto(window, -1))
        now, was = F.col(f"{tag}_now"), F.col(f"{tag}_was")
        result[tag] = (
            _phase_since(now, odd),
            _phase_since(was, odd_before),
            now if odd is None else F.when(now.isNotNull(), now != odd),
            None if odd is None else now.isNull() & odd,
        )
    return df.withColumns(added), result


def _phase_since(forced: Column, odd: Column | None) -> Phase:
    if odd is None:
        return lambda start: F.coalesce(forced, start)
    return lambda start: F.coalesce(forced, start) != odd


def _scan(df: DataFrame, machines: Sequence[Machine], window: WindowSpec, starts: Sequence[bool]):
    """Running phase, repetitions for each of ``starts`` and carried angle, per machine."""
    signals = {f"_m{m.ordinal}": _signals(m, F.col(f"_m{m.ordinal}_angle")) for m in machines}
    df, phases = _phases(df, signals, window)
    added = {}
    for tag, (now, was, _, _) in phases.items():
        for start in starts:
            done = was(F.lit(start)) & ~now(F.lit(start))
            added[f"{tag}_reps_{start}"] = F.sum(done.cast("long")).over(_upto(window, 0))
        added[f"{tag}_held"] = F.last(f"{tag}_angle", ignorenulls=True).over(_upto(window, 0))
    return df.withColumns(added), phases


def _state(machine: Machine, down: Column, was_down: Column, reps: Column, held: Column) -> Column:
    return F.struct(
        F.lit(machine.ordinal).alias("ordinal"),
        F.lit(machine.name).alias("exercise"),
        reps.alias("rep_count"),
        F.when(down, F.lit("down")).otherwise(F.lit("up")).alias("phase"),
        F.coalesce(held, F.lit(0.0)).alias("angle"),
        rep_feedback(reps).alias("feedback"),
        (was_down & ~down).alias("completed"),
    )


def tracked_angles(persons: DataFrame, machines: Sequence[Machine], keep: Sequence[str]) -> DataFrame:
    """Only what the scan needs crosses the shuffle: keys, one angle per exercise, kept columns."""
    names = [*PERSON_KEY, "track_id", *[c for c in keep if c not in (*PERSON_KEY, "track_id")]]
    df = with_side_angles(
        _tracked(persons),
        {f"_m{m.ordinal}": (m.joints, m.min_confidence) for m in machines if m.angle is None},
    )
    own = {f"_m{m.ordinal}_angle": m.angle for m in machines if m.angle is not None}
    if own:
        df = df.withColumns(own)
    return df.select(*names, *[f"_m{m.ordinal}_angle" for m in machines])


def _tracked(persons: DataFrame) -> DataFrame:
    """Rows without a track (or frame number) belong to no state and are left out."""
    return persons.filter(
        F.col("video_id").isNotNull() & F.col("track_id").isNotNull() & F.col("frame_idx").isNotNull()
    )


def _cutter(persons: DataFrame, cut: Cut) -> Callable[[DataFrame], DataFrame] | None:
    """A function adding the chunk of each row, NULL for tracks left in one piece; None if all are.

    ``"auto"`` counts the rows per track in a job of its own. It reads three columns and is combined
    before its shuffle. Borders between chunks are quantiles of the frame numbers of the track's rows, from
    sketches of bounded size that are combined before their shuffle as well: a gap in the numbers moves no rows into one
    chunk. At most one track in ``2 * CHUNK_ROWS`` rows can be long, but whether their list
    is small enough to be broadcast is checked all the same.
    """
    if cut is None:
        return None
    if cut != "auto":
        chunk = F.floor(F.col("frame_idx") / F.lit(cut))
        return lambda df: df.withColumn(_CHUNK, chunk).filter(F.col(_CHUNK).isNotNull())
    rows = _tracked(persons).select(*TRACK_KEY, "frame_idx")
    counts = rows.groupBy(*TRACK_KEY).agg(F.count("*").alias("n"))
    long = written(counts.filter(F.col("n") > 2 * CHUNK_ROWS), "long-tracks")
    found = long.agg(F.count("*").alias("tracks"), F.max("n").alias("most")).first()
    if found["tracks"] == 0:
        return None
    pieces = min(MOST_CHUNKS, -(-found["most"] // CHUNK_ROWS))
    few = found["tracks"] * pieces <= BROADCAST_TRACKS
    keys = long.select(*TRACK_KEY)
    fractions = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    borders = F.percentile_approx("frame_idx", fractions, F.lit(max(10_000, 100 * pieces))).alias("_borders")
    own = rows.join(F.broadcast(keys) if few else keys, list(TRACK_KEY), "left_semi")
    borders = written(own.groupBy(*TRACK_KEY).agg(borders), "track-borders")
    listed = F.broadcast(borders) if few else borders
    frame = F.col("frame_idx")
    before = F.filter("_borders", lambda border: border < frame)
    chunk = F.when(F.col("_borders").isNotNull(), F.size(before).cast("bigint"))
    return (
        lambda df: df.join(listed, list(TRACK_KEY), "left").withColumn(_CHUNK, chunk).drop("_borders")
    )


def _chunk_entries(rows: DataFrame, machines: Sequence[Machine]) -> tuple[DataFrame, dict]:
    """One row per (track, chunk): the state of every machine on entering it.

    ``rows`` are already scanned per chunk, so the grouping needs no further shuffle; only this
    small table is shuffled by track and folded in chunk order.
    """
    scanned, phases = rows
    tags = [f"_m{m.ordinal}" for m in machines]
    packed = []
    for tag in tags:
        _, _, forced, flip = phases[tag]
        packed += [
            forced.alias(f"{tag}_forced"),
            F.col(f"{tag}_reps_False"),
            F.col(f"{tag}_reps_True"),
            F.col(f"{tag}_held"),
        ]
        if flip is not None:
            packed.append(flip.alias(f"{tag}_flip"))
    last = F.max_by(F.struct(*packed), F.struct(*TRACK_ORDER)).alias("last")
    chunks = scanned.groupBy(*TRACK_KEY, _CHUNK).agg(last).select(*TRACK_KEY, _CHUNK, "last.*")

    window = Window.partitionBy(*TRACK_KEY).orderBy(_CHUNK)
    signals = {
        tag: (
            F.col(f"{tag}_forced"),
            F.col(f"{tag}_flip") if phases[tag][3] is not None else None,
        )
        for tag in tags
    }
    chunks, folded = _phases(chunks, signals, window)
    chunks = chunks.withColumns({f"{t}_start": folded[t][1](F.lit(False)) for t in tags})
    chunks = chunks.withColumns(
        {
            f"{t}_gain": F.when(F.col(f"{t}_start"), F.col(f"{t}_reps_True")).otherwise(
                F.col(f"{t}_reps_False")
            )
            for t in tags
        }
    )
    added = {}
    for t in tags:
        added[f"{t}_base"] = F.coalesce(F.sum(f"{t}_gain").over(_upto(window, -1)), F.lit(0))
        added[f"{t}_from"] = F.last(f"{t}_held", ignorenulls=True).over(_upto(window, -1))
    return chunks.withColumns(added), folded


#: The states of a person row, one entry per exercise.
STATES = (
    "array<struct<ordinal:int,exercise:string,rep_count:bigint,phase:string,angle:double,"
    "feedback:string,completed:boolean>>"
)


def track_states(
    persons: DataFrame,
    machines: Sequence[Machine],
    cut: Cut = "auto",
    keep: Sequence[str] = (),
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """One row per person row with ``states``, an array with one entry per machine.

    ``keep`` names further person columns to carry along. Every person row yields states, also
    rows without an angle: they repeat the state reached before. ``cut="auto"`` first counts rows
    per track; where ``persons`` is costly to compute, write it to a table before, give another
    ``cut``, or name rows to count instead in ``sized_by``: any that hold at least these rows.
    Without machines the arrays are empty.
    """
    if not machines:
        names = [*PERSON_KEY, "track_id", *[c for c in keep if c not in (*PERSON_KEY, "track_id")]]
        return _tracked(persons).select(*names, F.array().cast(STATES).alias("states"))
    df = tracked_angles(persons, machines, keep)
    names = [c for c in df.columns if not c.startswith("_m")]
    cutter = _cutter(persons if sized_by is None else sized_by, cut)
    if cutter is None:
        return _scan_whole(df, machines).select(*names, "states")

    window = Window.partitionBy(*TRACK_KEY, _CHUNK).orderBy(*TRACK_ORDER)
    scanned, phases = _scan(cutter(df), machines, window, [False, True])
    # The chunk results come from the rows of cut tracks only, without the kept columns. With
    # nothing kept and all tracks cut, both scans read one and the same shuffle.
    narrow = cutter(tracked_angles(persons, machines, ())).filter(F.col(_CHUNK).isNotNull())
    entries, _ = _chunk_entries(_scan(narrow, machines, window, [False, True]), machines)
    carried = [f"_m{m.ordinal}_{c}" for m in machines for c in ("start", "base", "from")]
    joined = scanned.join(
        entries.select(*TRACK_KEY, _CHUNK, *carried), [*TRACK_KEY, _CHUNK], "left"
    )
    states = []
    for m in machines:
        t = f"_m{m.ordinal}"
        start = F.coalesce(f"{t}_start", F.lit(False))
        reps = F.when(start, F.col(f"{t}_reps_True")).otherwise(F.col(f"{t}_reps_False"))
        states.append(
            _state(
                m,
                phases[t][0](start),
                phases[t][1](start),
                F.coalesce(f"{t}_base", F.lit(0)) + reps,
                F.coalesce(f"{t}_held", f"{t}_from"),
            )
        )
    return joined.select(*names, F.array(*states).alias("states"))


def _scan_whole(df: DataFrame, machines: Sequence[Machine]) -> DataFrame:
    window = Window.partitionBy(*TRACK_KEY).orderBy(*TRACK_ORDER)
    df, phases = _scan(df, machines, window, [False])
    up = F.lit(False)
    states = []
    for m in machines:
        t = f"_m{m.ordinal}"
        now, was, _, _ = phases[t]
        states.append(
            _state(m, now(up), was(up), F.col(f"{t}_reps_False"), F.col(f"{t}_held"))
        )
    return df.withColumn("states", F.array(*states))


def with_custom_states(
    states: DataFrame, persons: DataFrame, config: Mapping[str, Mapping], registry: Registry
) -> DataFrame:
    """``states`` rows with the states of the config's transforms put in their place among the others.

    One join per transform on the person key, with narrow rows on the transform's side. A person
    for whom a transform gives no row has no entry of it.
    """
    for ordinal, name, settings, transform in registry.custom(config):
        own = transform(persons, settings)
        state = F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.lit(name).alias("exercise"),
            *[F.col(c).cast(EXERCISE_STATE[c].dataType).alias(c) for c in ("rep_count", "phase", "angle", "feedback")],
            (F.col("completed") if "completed" in own.columns else F.lit(False)).alias("completed"),
        )
        own = own.groupBy(*PERSON_KEY).agg(F.min(state).alias("_own"))
        added = F.when(F.col("_own").isNotNull(), F.array("_own")).otherwise(F.array().cast(STATES))
        states = states.join(own, list(PERSON_KEY), "left")
        states = states.withColumn("states", F.array_sort(F.concat("states", added.cast(STATES)))).drop("_own")
    return states


def final_states(
    persons: DataFrame, machines: Sequence[Machine], cut: Cut = "auto"
) -> DataFrame:
    """Last state per (video, track, exercise).

    Grouping follows the partitioning of the scan, so the rows are shuffled once; of cut tracks
    only the chunk results go on, nothing is joined back to the rows.
    """
    if not machines:
        none = track_states(persons, machines).select(*TRACK_KEY, F.inline(F.flatten(F.array("states"))))
        return none.drop("ordinal", "completed")
    cutter = _cutter(persons, cut)
    df = tracked_angles(persons, machines, ())
    if cutter is None:
        rows = _scan_whole(df, machines)
        last = F.max_by("states", F.struct(*TRACK_ORDER)).alias("states")
    else:
        window = Window.partitionBy(*TRACK_KEY, _CHUNK).orderBy(*TRACK_ORDER)
        rows, folded = _chunk_entries(_scan(cutter(df), machines, window, [False, True]), machines)
        states = []
        for m in machines:
            t = f"_m{m.ordinal}"
            now, was, _, _ = folded[t]
            states.append(
                _state(
                    m,
                    now(F.lit(False)),
                    was(F.lit(False)),
                    F.col(f"{t}_base") + F.col(f"{t}_gain"),
                    F.coalesce(f"{t}_held", f"{t}_from"),
                )
            )
        last = F.max_by(F.array(*states), F.coalesce(F.col(_CHUNK), F.lit(0))).alias("states")
    return (
        rows.groupBy(*TRACK_KEY)
        .agg(last)
        .select(*TRACK_KEY, F.inline("states"))
        .drop("ordinal", "completed")
    )


def state_rows(states: DataFrame) -> DataFrame:
    """Exercise-state rows out of the ``states`` arrays."""
    # An expression and not the column itself: else a filter on its size is derived and pushed down,
    # which builds the array twice.
    return states.select(*PERSON_KEY, "track_id", F.inline(F.flatten(F.array("states"))))


def exercise_states(
    persons: DataFrame,
    config: Mapping[str, Mapping],
    registry: Registry | None = None,
    cut: Cut = "auto",
) -> DataFrame:
    """State of every active exercise for every person row.

    All counters share one scan; custom transforms are unioned with it.
    """
    registry = registry or Registry()
    columns = EXERCISE_STATE.fieldNames()
    machines = registry.machines(config)
    parts = []
    if machines:
        parts.append(state_rows(track_states(persons, machines, cut)).select(*columns))
    for _, name, settings, transform in registry.custom(config):
        own = transform(persons, settings).withColumn("exercise", F.lit(name))
        parts.append(own.select(*[F.col(f.name).cast(f.dataType) for f in EXERCISE_STATE.fields]))
    if not parts:
        return persons.sparkSession.createDataFrame([], EXERCISE_STATE)
    return reduce(DataFrame.unionByName, parts)


def latest_states(states: DataFrame) -> DataFrame:
    """Last state row per (video, track, exercise) of an exercise_state table."""
    kept = [c for c in EXERCISE_STATE.fieldNames() if c not in (*TRACK_KEY, "exercise")]
    last = F.max_by(F.struct(*kept), F.struct(*TRACK_ORDER)).alias("last")
    return states.groupBy(*TRACK_KEY, "exercise").agg(last).select(*TRACK_KEY, "exercise", "last.*")


def rep_events(states: DataFrame) -> DataFrame:
    """Rows on which a repetition completes."""
    return state_rows(states).filter("completed")


def attach_states(persons: DataFrame, states: DataFrame, exercise: str) -> DataFrame:
    """Person rows with the state of ``exercise``; the initial state where there is none."""
    own = states.filter(F.col("exercise") == exercise).select(
        *PERSON_KEY, "rep_count", "phase", "angle", "feedback"
    )
    # The state of a track that was not updated yet.
    initial = {"rep_count": 0, "phase": "up", "angle": 0.0, "feedback": ""}
    return (
        persons.join(own, list(PERSON_KEY), "left")
        .withColumn("exercise", F.lit(exercise))
        .withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in initial.items()})
    )


def person_exercises(persons: DataFrame, machines: Sequence[Machine]) -> DataFrame:
    """Every person row once per active exercise.

    The exercises are a literal array bounded by the config, unfolded in place: no join.
    """
    active = F.array(
        *[F.struct(F.lit(m.ordinal).alias("ordinal"), F.lit(m.name).alias("exercise")) for m in machines]
    ).cast("array<struct<ordinal:int,exercise:string>>")
    return persons.select("*", F.inline(active))


def exercise_map(states: DataFrame) -> DataFrame:
    """``exercises`` map per person row: name to state, and the names in drawing order.

    ``states`` is the output of :func:`track_states`, so this is a projection.
    """
    entry = lambda s: F.struct(
        s["exercise"].alias("key"),
        F.struct(*[s[c].alias(c) for c in ("rep_count", "phase", "angle", "feedback")]).alias("value"),
    )
    return states.select(
        *PERSON_KEY,
        "track_id",
        F.transform("states", lambda s: s["exercise"]).alias("exercise_names"),
        F.map_from_entries(F.transform("states", entry)).alias("exercises"),
    )
