"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.views import CONFIG, SQUAT
from jointflow.config import Machine, Registry, active_exercises, config_df, registry_df
from jointflow.functions import boxes as box_functions
from jointflow.functions import pose
from jointflow.functions.labels import color_slot
from jointflow.operators import detections as det
from jointflow.operators import exercise as ex
from jointflow.operators import overlay as draw
from jointflow.operators.hooks import detect_with
from jointflow.operators.tracking import TrackerConfig, assign_tracks, track_with
from jointflow.plans import frame_loop as loop
from jointflow.plans.frame_loop import frame_states
from jointflow.schema import (
    DETECTIONS,
    EXERCISE_STATE,
    FRAME_KEY,
    PERSON,
    PERSON_KEY,
)
from jointflow.session import shared_folder, state_tasks
from jointflow.sources import detections as io
from jointflow.streaming.chunked import count_stream
from jointflow.streaming.exercise import stream_exercise_states
from jointflow.streaming.order import END
from jointflow.streaming.tracking import stream_tracks

Query = Callable[[SparkSession, str], DataFrame]

LEG = ("hip", "knee", "ankle")
ARM = ("shoulder", "elbow", "wrist")
STATE = ("rep_count", "phase", "angle", "feedback")
CORNERS = ("x1", "y1", "x2", "y2")
DAY_MS = 24 * 3600 * 1000

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def registry() -> Registry:
    return Registry().register("elbow")


def machines(config: Mapping = CONFIG) -> list[Machine]:
    return registry().machines(config)


def corners(box: str = "bbox") -> list[Column]:
    return [F.col(f"{box}.{c}").alias(c) for c in CORNERS]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names or ("angle",)})


def squat_rows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    states = ex.track_states(views.persons(spark, sf_dir), machines(SQUAT), **options)
    return ex.state_rows(states)


# Sources and sinks


@query
def scan_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.write_detections(views.detections(spark, sf_dir), shared_folder(spark, "detections"))
    points = F.aggregate(
        F.col("kpt_conf"), F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.size(p), F.lit(0))
    )
    conf = F.aggregate(F.col("box_conf"), F.lit(0.0), lambda total, c: total + c)
    return io.scan_detections(spark, path).select(
        *FRAME_KEY,
        F.size("boxes").cast("bigint").alias("n_boxes"),
        F.col("track_ids").isNotNull().alias("tracked"),
        points.alias("n_points"),
        F.round(conf, 4).alias("conf"),
    )


#: Rows of a micro-batch at most. A track's rows of one micro-batch are sorted in one task, and all of
#: them may be of one track.
LANDING_ROWS = 5_000_000


def _land(spark: SparkSession, sf_dir: str, steps: int):
    """Person files in a landing folder, in ranges of frames one after the other: at least ``steps``,
    and as many as keep a landing small."""
    persons = views.persons(spark, sf_dir)
    path = shared_folder(spark, "landing")
    last, rows = views.events(spark, sf_dir).agg(F.max("event_id"), F.count("*")).first()
    steps = max(steps, -(-rows // LANDING_ROWS))
    for step in range(steps):
        first, end = step * (last + 1) // steps, (step + 1) * (last + 1) // steps
        part = persons.filter((F.col("frame_idx") >= first) & (F.col("frame_idx") < end))
        part.write.mode("append").parquet(path)
        yield path


@query
def stream_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = shared_folder(spark, "persons"), shared_folder(spark, "checkpoint")
    for path in _land(spark, sf_dir, 1):
        persons = io.stream_detections(spark, path, 16, schema=PERSON)
        _finish(io.stream_states(persons, out, checkpoint))
    return io.scan_persons(spark, out).select(
        *PERSON_KEY,
        "track_id",
        "conf",
        F.col("bbox.x1").alias("x1"),
        F.col("keypoints").isNotNull().alias("has_points"),
        pose.joint_xy("left_knee")["y"].alias("y13"),
        pose.joint_score("right_ankle").alias("s16"),
    )


@query
def exercise_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings with how often each exercise's angle is seen and past its limits."""
    active = machines()
    angles = pose.with_side_angles(
        views.persons(spark, sf_dir), {m.name: (m.joints, m.min_confidence) for m in active}
    )
    seen = angles.select(
        F.inline(F.array(*[F.struct(F.lit(m.name).alias("name"), F.col(f"{m.name}_angle").alias("angle"),
                                    F.lit(m.down).alias("down"), F.lit(m.up).alias("up")) for m in active]))
    )
    counts = seen.groupBy("name").agg(
        F.count("*").alias("n_rows"),
        F.count("angle").alias("n_angle"),
        F.count_if(F.col("angle") < F.col("down")).alias("n_down"),
        F.count_if(F.col("angle") > F.col("up")).alias("n_up"),
    )
    measured = ("n_rows", "n_angle", "n_down", "n_up")
    return (
        config_df(spark, CONFIG)
        .join(counts, "name", "left")
        .withColumns({n: F.coalesce(n, F.lit(0)) for n in measured})
    )


@query
def sink_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ex.exercise_states(views.persons(spark, sf_dir), SQUAT, registry())
    path = io.write_states(states, shared_folder(spark, "states"))
    return rounded(io.read_table(spark, path, EXERCISE_STATE))


# Detections


@query
def conf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det.filter_confidence(views.boxes(spark, sf_dir))
    return rows.select(*PERSON_KEY, "conf", *corners())


@query
def conf_filter_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = det.parse_detections(det.filter_frames(views.detections(spark, sf_dir)))
    return persons.select(*PERSON_KEY, "conf", *corners())


@query
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.suppress_duplicates(views.boxes(spark, sf_dir).select(*PERSON_KEY, "conf", "bbox")).select(
        *PERSON_KEY, "conf", *corners()
    )


@query
def nms_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = det.suppress_frames(views.detections(spark, sf_dir))

    def total(array: str, value) -> Column:
        return F.aggregate(F.col(array), F.lit(0.0), lambda s, v: s + F.coalesce(value(v), F.lit(0.0)))

    return kept.select(
        *FRAME_KEY,
        F.size("boxes").cast("bigint").alias("n_kept"),
        total("boxes", lambda b: b["x1"]).alias("x1"),
        total("boxes", lambda b: b["y2"]).alias("y2"),
        total("kpt_xy", lambda p: F.get(p, F.lit(13))["x"]).alias("knees"),
    )


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes with every detection slot of a frame in a place of its own, so tracks are known."""
    left = F.col("det_idx") * 1000.0 + F.col("bbox.x1") % 10
    top = F.col("bbox.y1") % 10
    lane = F.struct(left.alias("x1"), top.alias("y1"), (left + 100).alias("x2"), (top + 100).alias("y2"))
    return views.boxes(spark, sf_dir).select(*PERSON_KEY, "conf", lane.alias("bbox"))


@query
def track_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_tracks(_lanes(spark, sf_dir), segment_frames=400).select(*PERSON_KEY, "track_id")


@query
def track_assign_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker on boxes that jump about; there is no SQL for it."""
    rows = views.boxes(spark, sf_dir).select(*PERSON_KEY, "conf", "bbox")
    return assign_tracks(rows).select(*PERSON_KEY, "track_id")


class _BySlot:
    """A tracker with a state: every slot keeps the number it got when it was first seen in the video."""

    def resume(self, rows: pd.DataFrame, state: dict | None) -> tuple[pd.Series, dict]:
        known = dict(state or {})
        for slot in rows["det_idx"].unique():
            known.setdefault(slot, len(known) + 1)
        return rows["det_idx"].map(known), known


@query
def tracker_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.boxes(spark, sf_dir).select(*PERSON_KEY, "conf", "bbox")
    return track_with(rows, _BySlot()).select(*PERSON_KEY, "track_id")


@query
def parse_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.parse_detections(views.detections(spark, sf_dir)).select(
        *PERSON_KEY,
        "track_id",
        "conf",
        *corners(),
        F.col("keypoints").isNotNull().alias("has_points"),
        pose.joint_xy("left_knee")["x"].alias("x13"),
        pose.joint_score("left_knee").alias("s13"),
    )


@query
def tracked_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = det.tracked_only(views.detections(spark, sf_dir))
    return frames.select(*FRAME_KEY, F.size("boxes").cast("bigint").alias("n_boxes"))


# Pose columns


@query
def joint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = []
    for joint, name in (("left_knee", "knee"), ("right_wrist", "wrist")):
        at = pose.joint_xy(joint)
        columns += [at["x"].alias(f"{name}_x"), at["y"].alias(f"{name}_y")]
        columns.append(pose.joint_score(joint).alias(f"{name}_score"))
    return views.persons(spark, sf_dir).select(*PERSON_KEY, "track_id", *columns)


@query
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = [pose.side_gate(side, LEG, 0.5).alias(f"{side}_ok") for side in pose.SIDES]
    return views.persons(spark, sf_dir).select(*PERSON_KEY, "track_id", *gates)


@query
def side_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = pose.chosen_side(LEG, 0.5).alias("side")
    return views.persons(spark, sf_dir).select(*PERSON_KEY, "track_id", side)


@query
def joint_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pose.with_side_angles(views.persons(spark, sf_dir), {"knee": (LEG, 0.5), "elbow": (ARM, 0.5)})
    return rounded(
        df.select(*PERSON_KEY, "track_id", "knee_angle", "elbow_angle"), "knee_angle", "elbow_angle"
    )


@query
def bbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.struct(*[(F.col(f"bbox.{c}") - 60.75).alias(c) for c in CORNERS]).alias("bbox")
    pixels = box_functions.pixel_box(F.col("bbox")).alias("bbox")
    return (
        views.persons(spark, sf_dir)
        .select(*PERSON_KEY, moved)
        .select(*PERSON_KEY, pixels)
        .select(*PERSON_KEY, *corners())
    )


# Exercises and their states


@query
def active_exercises_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active exercises with how many person rows show each side."""
    active = machines()
    sides = pose.with_side_angles(
        views.persons(spark, sf_dir), {m.name: (m.joints, m.min_confidence) for m in active}
    )
    seen = sides.select(
        F.inline(F.array(*[F.struct(F.lit(m.name).alias("name"), F.col(f"{m.name}_side").alias("side"))
                           for m in active]))
    ).groupBy("name", "side").agg(F.count("*").alias("n_persons"))
    chosen = active_exercises(config_df(spark, CONFIG), registry_df(spark, registry()))
    return seen.join(F.broadcast(chosen), "name").select("ordinal", "name", "side", "n_persons")


QUERIES["active_exercises"] = QUERIES.pop("active_exercises_")


@query
def person_exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ex.person_exercises(views.persons(spark, sf_dir), machines())
    return rows.select(*PERSON_KEY, "track_id", "ordinal", "exercise")


@query
def state_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state beside the person it belongs to: one scan, the kept columns ride along."""
    states = ex.track_states(views.persons(spark, sf_dir), machines(SQUAT), keep=("bbox",))
    rows = states.select(*PERSON_KEY, "track_id", F.col("bbox.x1").alias("x1"), F.inline(F.flatten(F.array("states"))))
    return rounded(rows.select(*PERSON_KEY, "track_id", "exercise", *STATE, "x1"))


@query
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: where every track stands in every exercise."""
    return rounded(ex.final_states(views.persons(spark, sf_dir), machines()))


@query
def exercise_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = ex.exercise_map(ex.track_states(views.persons(spark, sf_dir), machines()))
    columns = []
    for name in ("squat", "elbow"):
        state = F.col("exercises")[name]
        columns += [
            state["rep_count"].alias(f"{name}_reps"),
            state["phase"].alias(f"{name}_phase"),
            F.round(state["angle"], 4).alias(f"{name}_angle"),
            state["feedback"].alias(f"{name}_feedback"),
        ]
    names = F.concat_ws(",", "exercise_names").alias("names")
    return mapped.select(*PERSON_KEY, "track_id", names, *columns)


@query
def phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squat_rows(spark, sf_dir).select(*PERSON_KEY, "track_id", "phase")


@query
def rep_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squat_rows(spark, sf_dir).select(*PERSON_KEY, "track_id", "rep_count", "phase")


@query
def rep_count_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks small enough that every track is cut many times."""
    rows = squat_rows(spark, sf_dir, cut=500)
    return rounded(rows.select(*PERSON_KEY, "track_id", "rep_count", "phase", "angle"))


@query
def angle_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(squat_rows(spark, sf_dir).select(*PERSON_KEY, "track_id", "angle"))


@query
def feedback_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squat_rows(spark, sf_dir).select(*PERSON_KEY, "track_id", "feedback")


@query
def rep_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ex.track_states(views.persons(spark, sf_dir), machines(SQUAT))
    rows = ex.rep_events(states).select(*PERSON_KEY, "track_id", "rep_count", "angle", "feedback")
    return rounded(rows)


@query
def rep_count_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"squat": {**CONFIG["squat"], "down_threshold": 120, "up_threshold": 60}}
    states = ex.track_states(views.persons(spark, sf_dir), machines(config), cut=2000)
    return ex.state_rows(states).select(*PERSON_KEY, "track_id", "rep_count", "phase", "feedback")


# Drawing lists


def _drawn(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*PERSON_KEY, "track_id", *names)


def _with_states(persons: DataFrame) -> DataFrame:
    return ex.track_states(persons, machines(), keep=("bbox", "keypoints"))


@query
def skeleton_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = draw.skeleton_segments(views.persons(spark, sf_dir))
    return _drawn(lines, "idx", *CORNERS, "thickness")


@query
def keypoint_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    dots = draw.keypoint_dots(views.persons(spark, sf_dir))
    return _drawn(dots, "idx", "x1", "y1", "size", "thickness")


@query
def id_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = draw.id_labels(views.persons(spark, sf_dir))
    return _drawn(labels, "x1", "y1", "size", "thickness", "text")


@query
def exercise_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ex.track_states(views.persons(spark, sf_dir), machines(), keep=("bbox",))
    return _drawn(draw.exercise_labels(states), "idx", "x1", "y1", "size", "thickness", "text")


@query
def track_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.persons(spark, sf_dir).select(
        *PERSON_KEY,
        "track_id",
        color_slot(F.col("track_id")).alias("color_idx"),
        color_slot(-F.col("track_id")).alias("negative_idx"),
    )


@query
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = det.parse_detections(views.detections(spark, sf_dir))
    return draw.overlay(_with_states(persons))


# Streaming


#: Frames by which the rows of a frame land apart in the queries of disorder, and the bound given to the stream.
APART, DISORDER = 32, 40


def _land_apart(spark: SparkSession, rows: DataFrame, last: int, count: int, steps: int):
    """Rows in a landing folder, half of every frame ``APART`` frames behind the other half; marks that end each key come last."""
    path = shared_folder(spark, "landing")
    place = F.col("frame_idx") + APART * F.pmod(F.xxhash64("frame_idx", "det_idx"), F.lit(2))
    steps = max(steps, -(-count // LANDING_ROWS))
    end = last + 1 + APART
    for step in range(steps):
        part = rows.where((place >= step * end // steps) & (place < (step + 1) * end // steps))
        part.write.mode("append").parquet(path)
        yield path
    keys = [c for c in ("video_id", "track_id") if c in rows.columns]
    given = {"frame_idx": F.lit(END)} | {k: F.col(k) for k in keys}
    empty = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    rows.select(*keys).distinct().select(*empty).write.mode("append").parquet(path)
    yield path


@query
def stream_track_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker on a stream whose files come out of order and split frames."""
    rows = _lanes(spark, sf_dir)
    last, count = rows.agg(F.max("frame_idx"), F.count("*")).first()
    out, checkpoint = shared_folder(spark, "tracks"), shared_folder(spark, "checkpoint")
    for path in _land_apart(spark, rows, last, count, 3):
        tracked = stream_tracks(io.stream_detections(spark, path, schema=rows.schema), disorder=DISORDER)
        _finish(io.stream_states(tracked, out, checkpoint))
    return spark.read.schema(tracked.schema).parquet(out).select(*PERSON_KEY, "track_id")


@query
def stream_rep_count_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting on a stream of persons whose files come out of order."""
    persons = views.persons(spark, sf_dir)
    last, count = views.events(spark, sf_dir).agg(F.max("event_id"), F.count("*")).first()
    out, checkpoint = shared_folder(spark, "states"), shared_folder(spark, "checkpoint")
    for path in _land_apart(spark, persons, last, count, 2):
        arriving = io.stream_detections(spark, path, schema=PERSON)
        _finish(io.stream_states(stream_exercise_states(arriving, CONFIG, registry(), disorder=DISORDER), out, checkpoint))
    return rounded(spark.read.schema(EXERCISE_STATE).parquet(out))


#: Seconds after which a stream that should have come to its end is given up.
STREAM_LIMIT = 900


def _finish(stream) -> None:
    """Wait for a stream that reads to the end of its input."""
    if not stream.awaitTermination(STREAM_LIMIT):
        stream.stop()
        raise TimeoutError("the stream did not come to its end")


def _stream(
    spark: SparkSession, sf_dir: str, config: Mapping, steps: int, sink, ttl_ms: int | None = None
) -> str:
    """Run the stateful query to the end of the input after each landing; the state carries over."""
    out, checkpoint = shared_folder(spark, "states"), shared_folder(spark, "checkpoint")
    for path in _land(spark, sf_dir, steps):
        persons = io.stream_detections(spark, path, schema=PERSON)
        states = stream_exercise_states(persons, config, registry(), ttl_ms)
        _finish(sink(states, out, checkpoint))
    return out


@query
def stream_rep_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stream(spark, sf_dir, CONFIG, 2, io.stream_states)
    return rounded(spark.read.schema(EXERCISE_STATE).parquet(out))


@query
def stream_rep_count_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting by summaries of chunks, every track cut."""
    out, checkpoint = shared_folder(spark, "states"), shared_folder(spark, "checkpoint")
    for path in _land(spark, sf_dir, 2):
        _finish(count_stream(io.stream_detections(spark, path, schema=PERSON), CONFIG, out, checkpoint, registry(), cut=200))
    return rounded(io.read_table(spark, f"{out}/states", EXERCISE_STATE))


@query
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stream(spark, sf_dir, CONFIG, 2, io.stream_latest)
    return rounded(
        io.read_latest(spark, out).select("video_id", "track_id", "exercise", *STATE)
    )


@query
def state_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that are dropped a day after a track was last seen."""

    def once(states: DataFrame, out: str, checkpoint: str):
        writer = states.writeStream.format("parquet").option("path", out)
        with state_tasks(spark):
            return writer.option("checkpointLocation", checkpoint).trigger(once=True).start()

    out = _stream(spark, sf_dir, SQUAT, 1, once, ttl_ms=DAY_MS)
    return rounded(spark.read.schema(EXERCISE_STATE).parquet(out))


# Hooks


def _detect(frames: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a model: boxes, ids and confidences by formula from the ids seen in the frame."""

    def value(e, k, prime):
        r = e % prime
        return (r * r * (37 * k + 11) + r * (101 * k + 7) + (7919 * k + 13)) % prime

    out = []
    for row in frames.itertuples():
        e = np.sort(np.asarray(row.ids, dtype=np.int64))
        x1, y1 = value(e, 1, views.PRIME_X) % 120, value(e, 2, views.PRIME_Y) % 90
        x2 = x1 + 60 + value(e, 5, views.PRIME_W) % 100
        y2 = y1 + 80 + value(e, 6, views.PRIME_H) % 120
        conf = (300 + value(e, 83, views.PRIME_SCORE) % 700) / 1000.0
        boxes = [dict(zip(CORNERS, map(float, b))) for b in zip(x1, y1, x2, y2)]
        out.append((row.video_id, row.frame_idx, None, boxes, conf, e, None, None))
    return pd.DataFrame(out, columns=DETECTIONS.fieldNames())


@query
def detector_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = (
        views.boxes(spark, sf_dir)
        .select(*FRAME_KEY, (F.col("frame_idx") * views.BOXES_PER_FRAME + F.col("det_idx")).alias("id"))
        .groupBy(*FRAME_KEY)
        .agg(F.collect_list("id").alias("ids"))
    )
    persons = det.parse_detections(detect_with(frames, _detect))
    first = F.col("track_id") % views.BOXES_PER_FRAME
    return persons.select(
        *FRAME_KEY, first.cast("int").alias("det_idx"), "track_id", "conf", *corners()
    )


def _knees(name: str, ordinal: int, settings: Mapping) -> Machine:
    """A counter on the mean of both knee angles, where both legs are seen."""
    gates = [pose.side_gate(side, LEG, settings["min_confidence"]) for side in pose.SIDES]
    limits = (float(settings[key]) for key in ("down_threshold", "up_threshold"))
    mean = (F.col("left_angle") + F.col("right_angle")) / 2
    return Machine(name, ordinal, *limits, angle=F.when(gates[0] & gates[1], mean))


def _both_knee_angles(persons: DataFrame) -> DataFrame:
    return pose.with_angles(
        persons,
        {
            side: [f"get(keypoints.coords, {pose.joint_index(f'{side}_{joint}')})" for joint in LEG]
            for side in pose.SIDES
        },
    )


def _hands(persons: DataFrame, settings: Mapping) -> DataFrame:
    """Up while both wrists are above the shoulders; counts nothing."""
    above = [
        pose.joint_xy(f"{side}_wrist")["y"] < pose.joint_xy(f"{side}_shoulder")["y"] for side in pose.SIDES
    ]
    raised = F.coalesce(above[0] & above[1], F.lit(False))
    return persons.select(
        *PERSON_KEY,
        "track_id",
        F.lit(0).alias("rep_count"),
        F.when(raised, F.lit("up")).otherwise(F.lit("down")).alias("phase"),
        F.lit(0.0).alias("angle"),
        F.lit("").alias("feedback"),
    )


def _own_exercises() -> tuple[Mapping, Registry]:
    own = Registry().register("knees", builder=_knees).register("hands", transform=_hands)
    config = {
        "knees": {"enabled": True, "down_threshold": 90, "up_threshold": 160, "min_confidence": 0.5},
        "hands": {"enabled": True},
    }
    return config, own


@query
def exercise_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = _both_knee_angles(views.persons(spark, sf_dir))
    return rounded(ex.exercise_states(persons, *_own_exercises()))


@query
def stream_exercise_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter and a transform of one's own on a stream."""
    out, checkpoint = shared_folder(spark, "states"), shared_folder(spark, "checkpoint")
    for path in _land(spark, sf_dir, 2):
        persons = _both_knee_angles(io.stream_detections(spark, path, schema=PERSON))
        _finish(io.stream_states(stream_exercise_states(persons, *_own_exercises()), out, checkpoint))
    return rounded(spark.read.schema(EXERCISE_STATE).parquet(out))


@query
def multi_exercise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ex.exercise_states(views.persons(spark, sf_dir), CONFIG, registry()))


@query
def frame_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything the frame loop does between reading and drawing."""
    states = frame_states(views.detections(spark, sf_dir), CONFIG, registry(), keep=())
    return rounded(ex.state_rows(states).select(*PERSON_KEY, "track_id", "exercise", *STATE))


def _untracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without ids, every slot of a frame in a place of its own, so tracks are known."""

    def lane(box: Column, slot: Column) -> Column:
        left, top = slot * 1000.0 + box["x1"] % 10, box["y1"] % 10
        return F.struct(left.alias("x1"), top.alias("y1"), (left + 100).alias("x2"), (top + 100).alias("y2"))

    frames = views.detections(spark, sf_dir)
    ids = DETECTIONS["track_ids"].dataType
    return frames.withColumns({"boxes": F.transform("boxes", lane), "track_ids": F.lit(None).cast(ids)})


@query
def frame_loop_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole loop on frames whose detections have no ids yet: filter, suppress, track, count."""
    states = frame_states(
        _untracked(spark, sf_dir), CONFIG, registry(), confidence=0.35, keep=(), tracker=TrackerConfig()
    )
    return rounded(ex.state_rows(states).select(*PERSON_KEY, "track_id", "exercise", *STATE))


@query
def frame_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawing lists of such frames."""
    return loop.frame_overlay(
        _untracked(spark, sf_dir), CONFIG, registry(), confidence=0.35, tracker=TrackerConfig()
    )


@query
def exercise_hook_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform between two counters has its label in the order of the config."""
    config = {"squat": CONFIG["squat"], "hands": {"enabled": True}, "elbow": CONFIG["elbow"]}
    own = registry().register("hands", transform=_hands)
    return loop.frame_overlay(views.detections(spark, sf_dir), config, own)
