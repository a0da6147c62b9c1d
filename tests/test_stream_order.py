"""Streams whose rows come out of order, against the batch operators."""

import random

import pandas as pd
import pytest
from jointflow.config import Registry
from jointflow.operators.exercise import exercise_states
from jointflow.operators.tracking import TrackerConfig, assign_tracks
from jointflow.schema import EXERCISE_STATE, PERSON
from jointflow.sources.detections import stream_detections, stream_states
from jointflow.streaming.exercise import stream_exercise_states
from jointflow.streaming.order import END, InOrder
from jointflow.streaming.tracking import stream_tracks
from helpers import leg, person

BOXES = "video_id string, frame_idx long, det_idx int, conf double, bbox struct<x1: double, y1: double, x2: double, y2: double>"
SQUAT = {"squat": {"enabled": True, "down_threshold": 90, "up_threshold": 160, "min_confidence": 0.5}}


class _Cell:
    """A state variable held in memory."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class _Handle:
    def getListState(self, *_):
        return _Cell()

    getValueState = getListState


@pytest.mark.parametrize("seed", range(5))
def test_rows_go_on_in_order(seed):
    rng = random.Random(seed)
    order = InOrder([("frame_idx", "LONG"), ("det_idx", "INT"), ("a", "DOUBLE"), ("seen", "BOOLEAN")], 7)
    order.init(_Handle())
    rows = [(f, d, float("nan") if rng.random() < 0.2 else f / 3, rng.random() < 0.5) for f in range(200) for d in range(rng.randrange(3))]
    coming = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 6.9))
    out, most = [], 0
    while coming:
        n = rng.randrange(1, 30)
        got = order(pd.DataFrame(coming[:n], columns=["frame_idx", "det_idx", "a", "seen"]))
        coming = coming[n:]
        out += sorted(got["frame_idx"].tolist())
        most = max(most, len(order.waiting.get() or []))
    end = order(pd.DataFrame([(END, None, None, None)], columns=["frame_idx", "det_idx", "a", "seen"]))
    out += sorted(end["frame_idx"].tolist())
    assert out == sorted(r[0] for r in rows) and most <= 60
    assert not order.waiting.exists()


def boxes(seed, videos=3, frames=120):
    rng = random.Random(seed)
    rows = []
    for v in range(videos):
        places = [(200.0 * k, 0.0) for k in range(4)]
        for f in range(frames):
            if rng.random() < 0.1:
                continue
            places = [(x + rng.uniform(-6, 6), y + rng.uniform(-6, 6)) for x, y in places]
            shown = [p for p in places if rng.random() < 0.8]
            for d, (x, y) in enumerate(shown):
                rows.append((f"v{v}", f * (1 + v), d, rng.choice([0.2, 0.6, 0.9, None]), (x, y, x + 90.0, y + 90.0)))
    return rows


def batches(rows, seed, disorder, n):
    """Rows in n portions; each comes less than ``disorder`` frames after its turn."""
    rng = random.Random(seed)
    coming = sorted(rows, key=lambda r: r[1] + rng.uniform(0, disorder - 0.1))
    return [coming[i * len(coming) // n : (i + 1) * len(coming) // n] for i in range(n)]


def run(spark, folder, portions, schema, query):
    path, out = f"{folder}/in", f"{folder}/out"
    for portion in portions:
        spark.createDataFrame(portion, schema).coalesce(1).write.mode("append").parquet(path)
        made = query(stream_detections(spark, path, schema=spark.createDataFrame([], schema).schema))
        assert stream_states(made, out, f"{folder}/checkpoint").awaitTermination(300)
    return spark.read.schema(made.schema).parquet(out)


@pytest.mark.parametrize("disorder,n", [(1, 1), (25, 4)])
def test_stream_tracks_equal_batch(spark, tmp_path, disorder, n):
    rows = boxes(disorder)
    config = TrackerConfig(max_lost=10)
    marks = [(f"v{v}", END, None, None, None) for v in range(3)]
    portions = [*batches(rows, 3, disorder, n), marks]
    got = run(spark, str(tmp_path), portions, BOXES, lambda df: stream_tracks(df, config, disorder))
    want = assign_tracks(spark.createDataFrame(rows, BOXES), config, segment_frames=40)
    key = ["video_id", "frame_idx", "det_idx", "track_id"]
    assert sorted(map(tuple, got.select(*key).collect()), key=repr) == sorted(map(tuple, want.select(*key).collect()), key=repr)


def test_frames_walked_already_are_late(spark, tmp_path):
    row = lambda f, d: ("v", f, d, 0.9, (0.0, 0.0, 90.0, 90.0))
    portions = [[row(1, 0), row(2, 0), row(9, 0)], [row(3, 0), row(10, 0)], [("v", END, None, None, None)]]
    got = run(spark, str(tmp_path), portions, BOXES, lambda df: stream_tracks(df, disorder=5, with_late=True))
    assert {(r.frame_idx, r.track_id, r.late) for r in got.collect()} == {(f, 1, False) for f in (1, 2, 3, 9, 10)}
    portions = [[row(20, 0), row(1, 0)], [row(2, 0)], [("v", END, None, None, None)]]
    got = run(spark, f"{tmp_path}/b", portions, BOXES, lambda df: stream_tracks(df, disorder=5, with_late=True))
    late = [r for r in got.collect() if r.late]
    assert not late  # frame 2 is newer than frame 1, the last one walked
    portions = [[row(20, 0), row(10, 0)], [row(2, 0)], [("v", END, None, None, None)]]
    got = run(spark, f"{tmp_path}/c", portions, BOXES, lambda df: stream_tracks(df, disorder=5, with_late=True))
    assert [(r.frame_idx, r.track_id) for r in got.collect() if r.late] == [(2, None)]


def test_counts_do_not_depend_on_the_order_of_files(spark, tmp_path):
    rng = random.Random(5)
    people = []
    for track in (1, 2):
        for f in range(120):
            points = leg("left", rng.choice([30, 100, 170])) if rng.random() < 0.8 else None
            people.append({"frame_idx": f, "track_id": track, "points": points, "det_idx": track})
    table = person(spark, people)
    rows = [tuple(r) for r in table.collect()]
    portions = batches(rows, 8, 30, 3)
    ends = [tuple(END if c == "frame_idx" else t if c == "track_id" else "v" if c == "video_id" else None for c in PERSON.fieldNames()) for t in (1, 2)]
    got = run(spark, str(tmp_path), [*portions, ends], PERSON, lambda df: stream_exercise_states(df, SQUAT, disorder=30))
    want = exercise_states(table, SQUAT, Registry())
    names = EXERCISE_STATE.fieldNames()
    assert sorted(map(repr, got.select(*names).collect())) == sorted(map(repr, want.select(*names).collect()))


def test_repeated_detections_keep_their_rows(spark):
    rows = [("v", f, 0, 0.9, (0.0, 0.0, 90.0, 90.0)) for f in (1, 2, 3)] + [("v", 2, 0, 0.9, (0.0, 0.0, 90.0, 90.0))] * 2
    for frames in (None, 2, 9_000):
        got = assign_tracks(spark.createDataFrame(rows, BOXES), segment_frames=frames).collect()
        assert sorted((r.frame_idx, r.track_id) for r in got) == [(1, 1), (2, 1), (2, 1), (2, 1), (3, 1)]
