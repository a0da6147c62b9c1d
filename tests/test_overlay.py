from helpers import leg, person
from jointflow.config import DEFAULT_CONFIG, Registry
from jointflow.operators import overlay as draw
from jointflow.operators.exercise import track_states
from jointflow.schema import BOX
from pyspark.sql import functions as F


def test_scores_must_exceed_the_limit(spark):
    points = {11: (1.9, -1.9, 0.41), 12: (5.0, 5.0, 0.4), 13: (7.0, 8.0, 0.9)}
    df = person(spark, [{"points": points}, {"frame_idx": 1, "points": None}])
    lines = draw.skeleton_segments(df).collect()
    assert [(r.idx, r.x1, r.y1, r.x2, r.y2, r.thickness) for r in lines] == [(8, 1, -1, 7, 8, 2)]
    dots = draw.keypoint_dots(df).orderBy("idx").collect()
    assert [(r.idx, r.x1, r.y1, r.size, r.thickness) for r in dots] == [
        (11, 1, -1, 4.0, -1), (13, 7, 8, 4.0, -1)
    ]


def test_broken_coordinate_does_not_fail(spark):
    df = person(spark, [{"points": {0: (float("nan"), 1e30, 0.9)}}])
    (dot,) = draw.keypoint_dots(df).collect()
    assert dot.x1 is None and dot.y1 is None


def test_id_text_and_place(spark):
    df = person(spark, [{"bbox": (-3.7, 4.2, 9.0, 9.0), "track_id": -7, "points": None}])
    (r,) = draw.id_labels(df).collect()
    assert (r.text, r.x1, r.y1, r.size, r.thickness, r.color_idx) == ("ID:-7", -3, -6, 0.6, 2, 93)


def test_exercise_texts_stack_upwards(spark):
    config = {"squat": DEFAULT_CONFIG["squat"], "lunge": DEFAULT_CONFIG["squat"]}
    df = person(spark, [{"points": leg("left", 85), "bbox": (5.0, 100.0, 9.0, 9.0)}])
    states = track_states(df, Registry().register("lunge").machines(config), keep=("bbox",))
    rows = draw.exercise_labels(states).orderBy("idx").collect()
    assert [(r.text, r.x1, r.y1) for r in rows] == [
        ("squat: 0 reps | 85°", 5, 72), ("lunge: 0 reps | 85°", 5, 54)
    ]


def test_drawing_order(spark):
    people = [
        {"det_idx": 1, "track_id": 2, "points": leg("left", 90)},
        {"det_idx": 0, "track_id": 1, "points": None},
        {"frame_idx": 1, "track_id": 1, "points": leg("right", 90)},
    ]
    machines = Registry().machines(DEFAULT_CONFIG)
    states = track_states(person(spark, people), machines, keep=("bbox", "keypoints"))
    rows = draw.overlay(states).orderBy("frame_idx", "z").collect()
    per_frame = {f: [(r.det_idx, r.z, r.kind) for r in rows if r.frame_idx == f] for f in (0, 1)}
    body = ["segment"] * 2 + ["dot"] * 3 + ["id", "exercise"]
    expected = [(0, 1, "id"), (0, 2, "exercise")]
    expected += [(1, z, kind) for z, kind in enumerate(body, 3)]
    assert per_frame[0] == expected
    assert per_frame[1] == [(0, z, kind) for z, kind in enumerate(body, 1)]
    texts = {r.text for r in rows if r.kind == "exercise"}
    assert texts == {"squat: 0 reps | 0°", "squat: 0 reps | 90°"}


def test_pixels_truncate_toward_zero(spark):
    from jointflow.functions.boxes import pixel_box

    df = spark.createDataFrame([((-1.9, -0.1, 0.9, 1.9),)], "bbox struct<x1:double,y1:double,x2:double,y2:double>")
    assert tuple(df.select(pixel_box(F.col("bbox")).alias("b")).first().b) == (-1, 0, 0, 1)
    assert BOX.fieldNames() == ["x1", "y1", "x2", "y2"]
