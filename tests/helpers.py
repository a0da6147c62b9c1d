"""Small inputs and a row-by-row counter to compare with."""

from __future__ import annotations

import math
import random

from jointflow.config import Machine
from jointflow.schema import PERSON
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")

ANGLES = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("det_idx", T.IntegerType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("a", T.DoubleType()),
    ]
)


def angle_machine(down, up, name="squat", ordinal=0):
    return Machine(name, ordinal, down, up, angle=F.col("a"))


def count_rows(rows, down, up):
    """The counter walked row by row: ``{(video, frame, det): (reps, phase, angle, feedback)}``."""
    tracks, result = {}, {}
    for video, frame, det, track, angle in sorted(rows, key=lambda r: (r[1], r[2])):
        reps, phase, held, text = tracks.get((video, track), (0, "up", 0.0, ""))
        if angle is not None:
            held = angle
            if angle < down and phase == "up":
                phase = "down"
            elif angle > up and phase == "down":
                phase, reps = "up", reps + 1
                text = f"✅ Rep {reps}"
        tracks[video, track] = result[video, frame, det] = (reps, phase, held, text)
    return result


def random_rows(seed, tracks=25, longest=120, values=None):
    rng = random.Random(seed)
    values = values or [None, None, NAN, 0.0, 60.0, 89.999, 90.0, 90.001, 120.0, 160.0, 160.001, 180.0]
    rows = []
    for track in range(tracks):
        frame = rng.randrange(-20, 50)
        for _ in range(rng.randrange(1, longest)):
            frame += rng.choice([1, 1, 1, 2, 40])
            angle = rng.choice(values) if rng.random() < 0.7 else rng.uniform(0, 180)
            rows.append((f"v{track % 3}", frame, track, track, angle))
    rng.shuffle(rows)
    return rows


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def person(spark, rows):
    """Person rows from dicts; what is not given has a default."""
    full = []
    for r in rows:
        points = r.get("points", {})
        keypoints = None
        if points is not None:
            coords = [points.get(k, (0.0, 0.0, 0.0))[:2] for k in range(17)]
            scores = [points.get(k, (0.0, 0.0, 0.0))[2] for k in range(17)]
            keypoints = (coords, scores)
        full.append(
            (
                r.get("video_id", "v"),
                r.get("frame_idx", 0),
                None,
                r.get("det_idx", 0),
                r.get("track_id", 1),
                r.get("conf", 0.9),
                r.get("bbox", (0.0, 0.0, 10.0, 10.0)),
                keypoints,
            )
        )
    return spark.createDataFrame(full, PERSON)


def leg(side, angle, score=0.9):
    """Hip, knee and ankle of one side bent by ``angle`` degrees."""
    hip = 11 if side == "left" else 12
    turn = math.radians(angle)
    return {
        hip: (100.0, 0.0, score),
        hip + 2: (0.0, 0.0, score),
        hip + 4: (100.0 * math.cos(turn), 100.0 * math.sin(turn), score),
    }
