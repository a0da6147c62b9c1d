"""Whole plans: frames without ids, custom exercises in their place, and no exercise at all."""

import pytest
from helpers import NAN, angle_machine
from test_detections import BOXES, frame, keys

from jointflow.config import DEFAULT_CONFIG, Registry
from jointflow.operators import detections as det
from jointflow.operators import exercise as ex
from jointflow.operators.hooks import detect_with
from jointflow.operators.overlay import overlay
from jointflow.operators.tracking import TrackerConfig
from jointflow.plans.frame_loop import frame_overlay, frame_states, track_persons
from jointflow.schema import DETECTIONS, PERSON_KEY
from jointflow.streaming.exercise import stream_exercise_states
from pyspark.sql import functions as F

OFF = {"squat": {**DEFAULT_CONFIG["squat"], "enabled": False}}


def frames(spark, n=6, ids=None, conf=None):
    return spark.createDataFrame([frame(i, 3, ids=ids, conf=conf) for i in range(n)], DETECTIONS)


def one_row(persons, settings):
    return persons.select(
        *PERSON_KEY,
        F.col("track_id").alias("rep_count"),
        F.lit("up").alias("phase"),
        F.lit(settings.get("angle", 1.0)).alias("angle"),
        F.lit("").alias("feedback"),
    )


def test_frames_without_ids_are_tracked(spark):
    got = track_persons(frames(spark), confidence=0.2).collect()
    assert {(r.frame_idx, r.det_idx): r.track_id for r in got} == {(f, d): d + 1 for f in range(6) for d in range(3)}
    assert all(len(r.keypoints.scores) == 17 for r in got)


def test_frames_without_confidences_keep_their_boxes(spark):
    df = frames(spark).withColumn("box_conf", F.lit(None).cast(DETECTIONS["box_conf"].dataType))
    assert all(len(r.boxes) == 3 for r in det.filter_frames(df, 0.9).collect())
    got = track_persons(df).collect()
    assert len(got) == 18 and {r.track_id for r in got} == {1, 2, 3} and {r.conf for r in got} == {None}


def test_custom_exercises_stand_in_the_order_of_the_config(spark):
    own = Registry().register("before", transform=one_row).register("after", transform=one_row)
    config = {
        "before": {"enabled": True, "angle": 11.0},
        "squat": DEFAULT_CONFIG["squat"],
        "off": {"enabled": True},
        "after": {"enabled": True, "angle": 22.0},
    }
    config["squat"] = {**config["squat"], "enabled": True}
    states = frame_states(frames(spark, 2, ids=[7, 8, 9]), config, own, confidence=0.2)
    for r in states.collect():
        assert [(s.ordinal, s.exercise) for s in r.states] == [(0, "before"), (1, "squat"), (2, "after")]
        assert r.states[0].rep_count == r.track_id and r.states[2].angle == 22.0
    mapped = ex.exercise_map(states).first()
    assert mapped.exercise_names == ["before", "squat", "after"]
    texts = [r for r in overlay(states).collect() if r.kind == "exercise"]
    assert len(texts) == 3 * 6 and {r.text.split(":")[0] for r in texts} == {"before", "squat", "after"}


def test_a_transform_may_leave_persons_out(spark):
    def some(persons, settings):
        return one_row(persons.where("track_id = 8"), settings)

    own = Registry().register("some", transform=some)
    states = frame_states(frames(spark, 1, ids=[7, 8, 9]), {"some": {"enabled": True}}, own, confidence=0.2)
    assert sorted((r.track_id, len(r.states)) for r in states.collect()) == [(7, 0), (8, 1), (9, 0)]


@pytest.mark.parametrize("tracker", [None, TrackerConfig()])
def test_no_active_exercise(spark, tracker):
    df = frames(spark, 2, ids=[7, 8, 9])
    states = frame_states(df, OFF, confidence=0.2, tracker=tracker)
    assert [len(r.states) for r in states.collect()] == [0] * 6
    mapped = ex.exercise_map(states).collect()
    assert len(mapped) == 6 and all(r.exercises == {} and r.exercise_names == [] for r in mapped)
    kinds = [r.kind for r in frame_overlay(df, OFF, confidence=0.2, tracker=tracker).collect()]
    assert kinds.count("id") == 6 and "exercise" not in kinds and "dot" in kinds
    persons = det.parse_detections(df)
    assert ex.person_exercises(persons, []).count() == 0
    assert ex.final_states(persons, []).count() == 0 and ex.exercise_states(persons, OFF).count() == 0
    assert stream_exercise_states(persons, OFF).count() == 0


def test_a_stream_names_the_transform_it_cannot_run(spark):
    own = Registry().register("mine", transform=one_row)
    with pytest.raises(ValueError, match="mine"):
        stream_exercise_states(det.parse_detections(frames(spark)), {"mine": {"enabled": True}}, own)


def test_the_detector_sees_each_frame_once_when_frames_are_tracked(spark, tmp_path):
    log = str(tmp_path)

    def model(batch):
        import uuid

        open(f"{log}/{uuid.uuid4().hex}-{len(batch)}", "w").close()
        out = batch.assign(ts=None, boxes=[[(0.0, 0.0, 9.0, 9.0)]] * len(batch), box_conf=[[0.9]] * len(batch))
        return out.assign(track_ids=None, kpt_xy=None, kpt_conf=None)[DETECTIONS.fieldNames()]

    shown = spark.range(20).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_idx"))
    states = frame_states(detect_with(shown, model), DEFAULT_CONFIG, tracker=TrackerConfig())
    assert states.count() == 20
    assert sum(int(p.name.split("-")[1]) for p in tmp_path.iterdir()) == 20


ODD_BOXES = [
    ("v", 0, 0, 0.9, (0.0, 0.0, 10.0, 10.0)),
    ("v", 0, 1, 0.8, (1.0, 0.0, 11.0, 10.0)),
    ("v", 0, 2, 0.7, (0.0, 0.0, float("inf"), 10.0)),
    ("v", 0, 3, 0.6, (0.0, NAN, 10.0, 10.0)),
    ("v", 0, 4, 0.5, (30.0, 0.0, 40.0, 10.0)),
    ("v", 0, 5, 0.4, (5.0, 5.0, 5.0, 5.0)),
    ("v", 0, None, 0.9, (0.0, 0.0, 10.0, 10.0)),
    (None, 0, 7, 0.9, (0.0, 0.0, 10.0, 10.0)),
]


@pytest.mark.parametrize("iou", [0.0, 0.45, 1.0])
def test_crowded_frames_follow_the_same_rules(spark, iou):
    df = spark.createDataFrame(ODD_BOXES, BOXES)
    small = keys(det.suppress_duplicates(df, iou, crowd=None))
    assert small == keys(det.suppress_duplicates(df, iou, crowd=3)) == keys(det.suppress_duplicates(df, iou))
    assert len(small) == (6 if iou == 1.0 else 5)


@pytest.mark.parametrize("iou", [-0.1, 1.1])
def test_limits_out_of_range(spark, iou):
    with pytest.raises(ValueError):
        det.suppress_duplicates(spark.createDataFrame(ODD_BOXES, BOXES), iou, crowd=None)


def test_repeated_det_idx_in_a_crowd_ends(spark):
    rows = [("v", 0, 0, 0.9, (0.0, 0.0, 10.0, 10.0)), ("v", 0, 0, 0.9, (20.0, 0.0, 60.0, 40.0))] * 3
    try:
        det.suppress_duplicates(spark.createDataFrame(rows, BOXES), 0.5, crowd=2).count()
    except RuntimeError as e:
        assert "det_idx" in str(e)
