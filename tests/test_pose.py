import math

import pytest
from helpers import NAN, leg, person
from jointflow.functions import pose
from jointflow.functions.labels import color_slot, whole_degrees
from pyspark.sql import functions as F

LEG = ("hip", "knee", "ankle")


def angles(spark, people, gate=0.5):
    df = person(spark, [{"frame_idx": i, "points": p} for i, p in enumerate(people)])
    rows = pose.with_side_angles(df, {"knee": (LEG, gate)}).orderBy("frame_idx").collect()
    assert len(rows) == len(people)
    return [(r.knee_side, r.knee_angle) for r in rows]


def test_angle_of_known_legs(spark):
    got = angles(spark, [leg("left", a) for a in (0, 30, 90, 135, 180)])
    assert [s for s, _ in got] == ["left"] * 5
    for (_, angle), wanted in zip(got, (0, 30, 90, 135, 180)):
        assert angle == pytest.approx(wanted, abs=0.01)


def test_left_goes_before_a_better_right_side(spark):
    both = {**leg("left", 40, 0.5), **leg("right", 170, 0.99)}
    weak_left = {**leg("left", 40, 0.499), **leg("right", 170, 0.99)}
    (first, second, none) = angles(spark, [both, weak_left, leg("right", 170, 0.4)])
    assert first[0] == "left" and first[1] == pytest.approx(40, abs=0.01)
    assert second[0] == "right" and second[1] == pytest.approx(170, abs=0.01)
    assert none == (None, None)


def test_gate_needs_every_score(spark):
    one_low = leg("left", 90)
    one_low[13] = (0.0, 0.0, 0.49)
    one_nan = leg("left", 90)
    one_nan[15] = (*one_nan[15][:2], NAN)
    one_null = leg("left", 90)
    one_null[11] = (*one_null[11][:2], None)
    assert angles(spark, [one_low, one_nan, one_null, None]) == [(None, None)] * 4


def test_zero_limb_is_a_right_angle_and_nan_stays(spark):
    zero = leg("left", 90)
    zero[11] = zero[13]
    broken = leg("left", 90)
    broken[15] = (NAN, 0.0, 0.9)
    far = {11: (1e9, 1e9, 0.9), 13: (0.0, 0.0, 0.9), 15: (3e9, 3e9, 0.9)}
    (_, right), (side, nan), (_, straight) = angles(spark, [zero, broken, far])
    assert right == 90.0
    assert side == "left" and math.isnan(nan)
    assert straight == pytest.approx(0.0, abs=1e-4)


def test_angles_do_not_depend_on_place_or_size(spark):
    people = [leg("left", a) for a in (20, 75, 91, 133)]
    moved = [{k: (3 * x + 50, 3 * y - 70, s) for k, (x, y, s) in p.items()} for p in people]
    for (_, a), (_, b) in zip(angles(spark, people), angles(spark, moved)):
        assert a == pytest.approx(b, abs=1e-4)


def test_short_keypoint_array(spark):
    df = person(spark, [{"points": leg("left", 90)}]).withColumn(
        "keypoints",
        F.struct(
            F.slice("keypoints.coords", 1, 12).alias("coords"),
            F.slice("keypoints.scores", 1, 12).alias("scores"),
        ),
    )
    row = pose.with_side_angles(df, {"knee": (LEG, 0.5)}).first()
    assert row.knee_side is None and row.knee_angle is None


def test_unknown_joint():
    with pytest.raises(KeyError):
        pose.joint_index("left_tail")


def test_label_degrees_and_colors(spark):
    values = [(0.5,), (1.5,), (90.5,), (91.5,), (179.9996,), (NAN,)]
    df = spark.createDataFrame(values, "a double").select("a", whole_degrees(F.col("a")).alias("t"))
    assert [r.t for r in df.collect()] == ["0", "2", "90", "92", "180", "nan"]
    ids = spark.createDataFrame([(-1,), (0,), (99,), (100,), (-100,), (12345,)], "t long")
    slots = [r.c for r in ids.select(color_slot(F.col("t")).alias("c")).collect()]
    assert slots == [v % 100 for v in (-1, 0, 99, 100, -100, 12345)]
