import random

import numpy as np
import pandas as pd
import pytest
from helpers import NAN
from jointflow.operators import tracking
from jointflow.operators.tracking import TrackerConfig, assign_tracks, track_with, two_stage_tracker
from test_detections import BOXES


def walkers(seed, frames, people, video="v", start=0):
    """People far apart who drift a little; detections come in a new order in every frame."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for f in range(start, start + frames):
        order = list(range(people))
        rng.shuffle(order)
        for d, p in enumerate(order):
            x, y = 1000.0 * p + 3 * f + rng.uniform(0, 3), rng.uniform(0, 3)
            rows.append((video, f, d, rng.uniform(0.55, 1), (x, y, x + 80, y + 160)))
            truth[video, f, d] = p
    return rows, truth


def ids(df):
    return {(r.video_id, r.frame_idx, r.det_idx): r.track_id for r in df.collect()}


def partition(assigned, truth):
    """True when ids and persons correspond one to one."""
    pairs = {(k[0], assigned[k], truth[k]) for k in truth}
    return len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs})


@pytest.mark.parametrize("segment", [None, 40, 300])
def test_people_keep_their_ids(spark, segment):
    rows, truth = walkers(1, 200, 4)
    more, more_truth = walkers(2, 90, 3, "w", start=-30)
    df = spark.createDataFrame(rows + more, BOXES).repartition(5)
    got = ids(assign_tracks(df, segment_frames=segment))
    assert partition(got, {**truth, **more_truth})
    # Ids count from 1 per video in order of appearance.
    first = {d: got["v", 0, d] for d in range(4)}
    assert first == {0: 1, 1: 2, 2: 3, 3: 4}
    assert {v for k, v in got.items() if k[0] == "w"} == {1, 2, 3}


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [
        ("v", f, d, rng.random(), (x := rng.uniform(0, 200), y := rng.uniform(0, 200), x + 60, y + 60))
        for f in range(120)
        for d in range(5)
    ]
    a = ids(assign_tracks(spark.createDataFrame(rows, BOXES).repartition(1), segment_frames=50))
    b = ids(assign_tracks(spark.createDataFrame(rows[::-1], BOXES).repartition(7), segment_frames=50))
    assert a == b and len(a) == len(rows)
    for f in range(120):
        given = [a["v", f, d] for d in range(5) if a["v", f, d] is not None]
        assert len(given) == len(set(given))
    # Only detections that may start a track or continue one carry an id.
    assert all(a[r[:3]] is None for r in rows if r[3] < 0.1)
    assert all(a[r[:3]] is not None for r in rows if r[3] >= 0.5)


def local(rows, **config):
    pdf = pd.DataFrame(
        [(f, d, c, *b) for _, f, d, c, b in rows],
        columns=["frame_idx", "det_idx", "conf", "x1", "y1", "x2", "y2"],
    )
    return [None if pd.isna(i) else int(i) for i in two_stage_tracker(TrackerConfig(**config))(pdf)]


HERE = (0.0, 0.0, 100.0, 100.0)


def test_weak_detections_continue_but_do_not_start():
    rows = [("v", f, 0, c, HERE) for f, c in enumerate([0.3, 0.9, 0.3, 0.05, 0.5, NAN])]
    assert local(rows) == [None, 1, 1, None, 1, None]


def test_lost_tracks_come_back_until_too_late():
    at = [0, 1, 31, 62]
    rows = [("v", f, 0, 0.9, HERE) for f in at]
    assert local(rows) == [1, 1, 1, 2]


def test_constant_velocity_follows_a_fast_box():
    # Each step is wider than half the box; only the predicted place overlaps enough.
    steps = [0, 50, 100, 150, 200, 300]
    rows = [("v", f, 0, 0.9, (float(x), 0.0, x + 100.0, 100.0)) for f, x in zip([0, 1, 2, 3, 4, 6], steps)]
    assert local(rows, match_iou=0.3) == [1] * 6


def test_long_chain_of_segments(spark):
    rows, truth = walkers(7, 500, 2)
    got = ids(assign_tracks(spark.createDataFrame(rows, BOXES), segment_frames=10))
    assert partition(got, truth)


def test_own_tracker(spark):
    rows, truth = walkers(3, 60, 3)

    def by_place(segment):
        return (segment["x1"] // 1000).astype(int) + 5

    got = ids(track_with(spark.createDataFrame(rows, BOXES), by_place, 20, 20))
    assert partition(got, truth)
    assert set(got.values()) == {1, 2, 3}
    with pytest.raises(ValueError):
        track_with(spark.createDataFrame(rows, BOXES), by_place, 20, 21)


def nearest():
    class Nearest:
        """Goes on with the id whose last place is nearest, within 30; checks that frames come whole and in order."""

        def resume(self, rows, state):
            places, frame, made = state or ({}, None, 0)
            places, found = dict(places), []
            for f, own in rows.groupby("frame_idx", sort=False):
                assert frame is None or f > frame
                frame = f
                for x in own["x1"]:
                    near = min(places, key=lambda i: abs(places[i] - x), default=None)
                    if near is None or abs(places[near] - x) > 30:
                        made += 1
                        near = made
                    places[near] = x
                    found.append(near)
            return found, (places, frame, made)

    return Nearest()  # a class of a function travels to the workers by value


def test_tracker_with_a_state_gets_pieces_of_videos(spark):
    rows, truth = [], {}
    for n, video in enumerate(("v", "w", "x")):
        more, own = walkers(60 + n, 60, 3, video, start=5 * n)
        rows, truth = rows + more, truth | own
    df = spark.createDataFrame(rows, BOXES)
    walker = nearest()
    whole = ids(track_with(df, lambda pdf: pd.Series(walker.resume(pdf, None)[0], index=pdf.index)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ids(track_with(df, walker))
        twice = track_with(df.unionByName(df).unionByName(df.limit(1).withColumn("frame_idx", df["frame_idx"] + None)), walker)
        assert twice.count() == 2 * len(rows) + 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == whole and partition(got, truth)
    with pytest.raises(ValueError):
        track_with(df, walker, segment_frames=100)


def restless(seed, frames=220, people=5):
    """Weak stretches, gaps, crossings and repeated boxes, so that tracks live over every border in every way."""
    rng = random.Random(seed)
    rows = []
    for f in range(frames):
        d = 0
        for p in range(people):
            if rng.random() < 0.25 or (f // 23 + p) % 5 == 0:
                continue
            conf = rng.choice([0.05, 0.3, 0.3, 0.9]) if (f // 17 + p) % 3 else 0.9
            x = round(40.0 * p + (f * (-1) ** p) % 60 + rng.choice([0, 1, 2]), 1)
            rows.append(("v", f, d, conf, (x, 0.0, x + 50, 90.0)))
            d += 1
    return rows


@pytest.mark.parametrize("segment", [7, 40, 9_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_segments_do_not_change_ids(spark, segment, seed):
    df = spark.createDataFrame(restless(seed), BOXES)
    assert ids(assign_tracks(df, segment_frames=segment)) == ids(assign_tracks(df, segment_frames=None))


def test_weak_stretch_over_a_border(spark):
    rows = [("v", f, 0, 0.9 if f <= 8_935 else 0.3, HERE) for f in range(8_900, 9_100)]
    got = ids(assign_tracks(spark.createDataFrame(rows, BOXES)))
    assert set(got.values()) == {1} and len(got) == 200


def test_track_without_rows_in_a_segment(spark):
    rows = [("v", f, 0, 0.9, HERE) for f in (0, 1, 28, 29)] + [("v", f, 0, 0.9, (500.0, 0.0, 600.0, 100.0)) for f in (12, 14)]
    got = ids(assign_tracks(spark.createDataFrame(rows, BOXES), segment_frames=5))
    assert [got["v", f, 0] for f in (0, 1, 12, 14, 28, 29)] == [1, 1, 2, 2, 1, 1]


def test_ids_of_all_rows_are_never_broadcast(spark):
    """Files of ids are small for their rows; a join planned by their size would hold all of them in every task."""

    def broadcasts(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "frame_idx" in line]

    rows = spark.range(400).selectExpr(
        "'v' AS video_id", "id DIV 4 AS frame_idx", "int(id % 4) AS det_idx", "0.9D AS conf",
        "named_struct('x1', 1000D * (id % 4), 'y1', 0D, 'x2', 1000D * (id % 4) + 100D, 'y2', 100D) AS bbox",
    )
    local = tracking.written(rows.selectExpr("video_id", "frame_idx DIV 10 AS segment", "frame_idx", "det_idx", "det_idx > 0 AS own", "bigint(det_idx) AS local_id"), "ids")
    assert not broadcasts(tracking._links(local))
    made = tracking.track_with(rows, tracking.two_stage_tracker())
    assert not broadcasts(made)
    assert {(r.det_idx, r.track_id) for r in made.collect()} == {(d, d + 1) for d in range(4)}


def test_matches_of_plain_numbers_are_those_of_arrays():
    """Frames of few boxes are matched without arrays, with the same scores and the same order of ties."""
    rng = random.Random(5)
    met = 0
    for step in (1, 20):  # places on a coarse grid make many ties
        for _ in range(300):
            places = [[(rng.randrange(0, 120, step), rng.randrange(0, 120, step)) for _ in range(rng.randrange(9))] for _ in range(2)]
            tracks, boxes = ([(float(x), float(y), x + 60.0, y + rng.choice([40.0, 60.0])) for x, y in p] for p in places)
            pairs = tracking._match_few(tracks, boxes, 0.2)
            assert pairs == tracking._match(np.array(tracks).reshape(-1, 4), np.array(boxes).reshape(-1, 4), 0.2)
            met += len(pairs)
    assert met > 500
