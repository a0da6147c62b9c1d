"""Pose tables derived from ``events`` by integer arithmetic only (see FIXTURES.md).

The same formulas exist as SQL text in :mod:`checks.oracle`; both engines get identical values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jointflow.functions.pose import KEYPOINT_COUNT
from jointflow.schema import FRAME_KEY

# Primes of the formulas, and which events stand for what.
PRIME_X, PRIME_Y, PRIME_SCORE = 10007, 10009, 10037
PRIME_W, PRIME_H = 10037, 10039
VIDEOS = 4
BOXES_PER_FRAME = 8

CONFIG = {
    "squat": {
        "enabled": True,
        "keypoints": ["hip", "knee", "ankle"],
        "down_threshold": 90,
        "up_threshold": 160,
        "min_confidence": 0.5,
    },
    "elbow": {
        "enabled": True,
        "keypoints": ["shoulder", "elbow", "wrist"],
        "down_threshold": 70,
        "up_threshold": 150,
        "min_confidence": 0.5,
    },
    "off": {
        "enabled": False,
        "down_threshold": 90,
        "up_threshold": 160,
        "min_confidence": 0.5,
    },
    "unknown_name": {
        "enabled": True,
        "down_threshold": 90,
        "up_threshold": 160,
        "min_confidence": 0.5,
    },
}
SQUAT = {"squat": CONFIG["squat"]}


def _terms(e: str = "event_id") -> list[str]:
    """The formula ``(e*e*(37k+11) + e*(101k+7) + (7919k+13)) % p`` is ``(base + k*step) % p``.

    Base and step per prime are columns of their own, used by all 17 points. ``e`` is reduced
    modulo the prime first, so no event id overflows.
    """
    terms = []
    for p in sorted({PRIME_X, PRIME_Y, PRIME_SCORE, PRIME_W, PRIME_H}):
        r = f"({e} % {p})"
        terms.append(f"({r} * {r} * 11 + {r} * 7 + 13) % {p} AS base{p}")
        terms.append(f"({r} * {r} * 37 + {r} * 101 + 7919) % {p} AS step{p}")
    return terms


def mixed(k: int, prime: int) -> str:
    return f"((base{prime} + step{prime} * {k}) % {prime})"


def _xy(k: int) -> str:
    x, y = f"{mixed(k, PRIME_X)} % 640", f"{mixed(k + 40, PRIME_Y)} % 480"
    return f"named_struct('x', double({x}), 'y', double({y}))"


def _score(k: int) -> str:
    return f"double({mixed(k + 80, PRIME_SCORE)} % 700 + 300) / 1000D"


def _keypoints() -> str:
    """17 points, NULL on error events."""
    coords = ", ".join(_xy(k) for k in range(KEYPOINT_COUNT))
    scores = ", ".join(_score(k) for k in range(KEYPOINT_COUNT))
    return (
        f"CASE WHEN event_type <> 'error' THEN "
        f"named_struct('coords', array({coords}), 'scores', array({scores})) END AS keypoints"
    )


def _box() -> str:
    x1, y1 = f"{mixed(1, PRIME_X)} % 120", f"{mixed(2, PRIME_Y)} % 90"
    x2 = f"{x1} + 60 + {mixed(5, PRIME_W)} % 100"
    y2 = f"{y1} + 80 + {mixed(6, PRIME_H)} % 120"
    corners = (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))
    return f"named_struct({', '.join(f'{n!r}, double({v})' for n, v in corners)}) AS bbox"


_BODY = ("user_id AS track_id", f"{_score(3)} AS conf", _box(), _keypoints())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _with_terms(events_df: DataFrame) -> DataFrame:
    return events_df.selectExpr("event_id", "ts", "user_id", "event_type", *_terms())


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tracked person per event."""
    return _with_terms(events(spark, sf_dir)).selectExpr(
        f"concat('v', string(user_id % {VIDEOS})) AS video_id",
        "event_id AS frame_idx",
        "ts",
        "0 AS det_idx",
        *_BODY,
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat, untracked detections: 8 per frame."""
    frame = f"bigint(floor(event_id / {BOXES_PER_FRAME}))"
    return _with_terms(events(spark, sf_dir)).selectExpr(
        f"concat('v', string({frame} % {VIDEOS})) AS video_id",
        f"{frame} AS frame_idx",
        "ts",
        f"int(event_id % {BOXES_PER_FRAME}) AS det_idx",
        *_BODY,
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array form, one row per frame of at most 8 detections; every 10th frame is untracked."""
    found = F.array_sort(
        F.collect_list(F.struct("det_idx", "ts", "track_id", "conf", "bbox", "keypoints"))
    )
    tracked = F.col("frame_idx") % 10 != 0
    return (
        boxes(spark, sf_dir)
        .groupBy(*FRAME_KEY)
        .agg(found.alias("found"))
        .select(
            *FRAME_KEY,
            F.col("found")[0]["ts"].alias("ts"),
            F.transform("found", lambda d: d["bbox"]).alias("boxes"),
            F.transform("found", lambda d: d["conf"]).alias("box_conf"),
            F.when(tracked, F.transform("found", lambda d: d["track_id"])).alias("track_ids"),
            F.transform("found", lambda d: d["keypoints"]["coords"]).alias("kpt_xy"),
            F.transform("found", lambda d: d["keypoints"]["scores"]).alias("kpt_conf"),
        )
    )
