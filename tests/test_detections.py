import random

import pytest
from helpers import NAN
from jointflow.operators import detections as det
from jointflow.operators.crowded import suppress_in_crowds
from jointflow.schema import BOX, DETECTIONS
from pyspark.sql import types as T

BOXES = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("det_idx", T.IntegerType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("bbox", BOX),
    ]
)


def area(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def too_close(a, b, iou):
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return inter > iou * (area(a) + area(b) - inter)


def brute(rows, iou):
    kept = {}
    for video, frame, det_idx, conf, box in sorted(rows, key=lambda r: (-r[3], r[2])):
        group = kept.setdefault((video, frame), [])
        if not any(too_close(k[1], box, iou) for k in group):
            group.append((det_idx, box))
    return {(v, f, d) for (v, f), group in kept.items() for d, _ in group}


def random_boxes(seed, frames=12, most=40):
    rng = random.Random(seed)
    rows = []
    for f in range(frames):
        for d in range(rng.randrange(1, most)):
            x, y = rng.uniform(-50, 200), rng.uniform(-50, 200)
            size = 2 ** rng.uniform(-1, 8)
            box = (x, y, x + size * rng.uniform(0.3, 1), y + size * rng.uniform(0.3, 1))
            if rows and rng.random() < 0.2:
                box = rows[-1][4]
            if rng.random() < 0.05:
                box = (x, y, x, y + 5)
            rows.append((f"v{f % 2}", f, d, rng.choice([0.3, 0.5, 0.9, rng.random()]), box))
    rng.shuffle(rows)
    return rows


def keys(df):
    return {(r.video_id, r.frame_idx, r.det_idx) for r in df.collect()}


@pytest.mark.parametrize("iou", [0.2, 0.45, 0.8])
def test_suppression_three_ways(spark, iou):
    rows = random_boxes(int(iou * 100))
    df = spark.createDataFrame(rows, BOXES)
    wanted = brute(rows, iou)
    gathered = det.suppress_duplicates(df, iou, crowd=None)
    assert keys(gathered) == wanted
    mixed = det.suppress_duplicates(df, iou, crowd=20)
    assert keys(mixed) == wanted and mixed.columns == gathered.columns
    assert keys(suppress_in_crowds(df, iou)) == wanted
    # What is kept does not suppress itself.
    assert keys(det.suppress_duplicates(gathered, iou, crowd=None)) == wanted


def test_one_crowded_frame_of_near_copies(spark):
    """Most rows are near-copies in one frame: they fall to one box a round, without any pairs."""
    rng = random.Random(3)
    rows = []
    for d in range(1500):
        x = rng.choice([0, 500]) + rng.uniform(0, 2)
        rows.append(("v", 0, d, round(rng.random(), 2), (x, 0.0, x + 100, 100.0)))
    rows += [("v", f, 0, 0.9, (0.0, 0.0, 5.0, 5.0)) for f in range(1, 5)]
    df = spark.createDataFrame(rows, BOXES)
    got = det.suppress_duplicates(df, 0.45, crowd=100)
    assert keys(got) == brute(rows, 0.45)
    assert got.count() == 6


def test_ties_go_to_the_earlier_box(spark):
    rows = [("v", 0, d, 0.5, (0.0, 0.0, 10.0, 10.0)) for d in range(4)]
    df = spark.createDataFrame(rows, BOXES)
    assert keys(det.suppress_duplicates(df)) == {("v", 0, 0)}
    assert keys(suppress_in_crowds(df, 0.45)) == {("v", 0, 0)}


def test_confidence_limit_is_included(spark):
    rows = [("v", 0, d, c, (0.0, 0.0, 1.0, 1.0)) for d, c in enumerate([0.45, 0.4499, NAN, None, 0.9])]
    df = spark.createDataFrame(rows, BOXES)
    assert keys(det.filter_confidence(df, 0.45)) == {("v", 0, 0), ("v", 0, 4)}


def frame(idx, n, ids="same", points=17, conf=None):
    boxes = [(10.0 * i, 0.0, 10.0 * i + 5, 5.0) for i in range(n)]
    xy = [[(float(i), float(k)) for k in range(points)] for i in range(n)]
    scores = [[0.9] * points for _ in range(n)]
    track_ids = list(range(100, 100 + n)) if ids == "same" else ids
    return ("v", idx, None, boxes, conf or [0.5] * n, track_ids, xy, scores)


def parsed(spark, *frames):
    df = spark.createDataFrame(list(frames), DETECTIONS)
    return [tuple(r) for r in det.parse_detections(df).orderBy("frame_idx", "det_idx").collect()]


def test_parse_keeps_order_and_stops_at_the_shorter_list(spark):
    rows = parsed(
        spark, frame(0, 3), frame(1, 3, ids=[7, 8]), frame(2, 2, ids=[1, 2, 3]), frame(3, 2, ids=None), frame(4, 0)
    )
    assert [(r[1], r[3], r[4]) for r in rows] == [
        (0, 0, 100), (0, 1, 101), (0, 2, 102), (1, 0, 7), (1, 1, 8), (2, 0, 1), (2, 1, 2)
    ]


def test_parse_without_boxes_keypoints_or_confidences(spark):
    bare = ("v", 0, None, [(0.0, 0.0, 1.0, 1.0)], None, [5], None, None)
    boxless = ("v", 1, None, None, None, [5], None, None)
    short = ("v", 2, None, [(0.0, 0.0, 1.0, 1.0)] * 2, [0.5, 0.6], [5, 6], [[(1.0, 2.0)]], [[0.7]])
    rows = parsed(spark, bare, boxless, short)
    assert [(r[1], r[4], r[5], r[7] is None) for r in rows] == [
        (0, 5, None, True), (2, 5, 0.5, False), (2, 6, 0.6, True)
    ]


def test_tracked_only(spark):
    df = spark.createDataFrame([frame(0, 1), frame(1, 1, ids=None)], DETECTIONS)
    assert [r.frame_idx for r in det.tracked_only(df).collect()] == [0]


def test_frame_rows_agree_with_flat_rows(spark):
    rows = random_boxes(8, frames=6, most=15)
    by_frame = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_frame.setdefault((r[0], r[1]), []).append(r)
    frames = [
        (v, f, None, [r[4] for r in g], [r[3] for r in g], [r[2] for r in g], None, None)
        for (v, f), g in by_frame.items()
    ]
    df = spark.createDataFrame(frames, DETECTIONS)
    kept = det.suppress_frames(det.filter_frames(df, 0.45), 0.3)
    got = {(r.video_id, r.frame_idx, i) for r in kept.collect() for i in r.track_ids}
    assert got == brute([r for r in rows if r[3] >= 0.45], 0.3)
    assert all(r.kpt_xy is None for r in kept.collect())


def test_frames_need_no_shuffle(spark, tmp_path):
    spark.createDataFrame([frame(0, 3)], DETECTIONS).write.parquet(str(tmp_path / "d"))
    df = spark.read.schema(DETECTIONS).parquet(str(tmp_path / "d"))
    plan = det.parse_detections(det.suppress_frames(det.filter_frames(df)))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
