"""Fixed table schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])

KEYPOINTS = T.StructType(
    [
        T.StructField("coords", T.ArrayType(POINT)),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
    ]
)

#: One row per frame, detections as parallel arrays. ``track_ids`` is NULL when
#: nothing was tracked in the frame.
DETECTIONS = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("boxes", T.ArrayType(BOX)),
        T.StructField("box_conf", T.ArrayType(T.DoubleType())),
        T.StructField("track_ids", T.ArrayType(T.LongType())),
        T.StructField("kpt_xy", T.ArrayType(T.ArrayType(POINT))),
        T.StructField("kpt_conf", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)

#: One row per person per frame. ``det_idx`` is the position in the frame.
PERSON = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("det_idx", T.IntegerType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("bbox", BOX),
        T.StructField("keypoints", KEYPOINTS),
    ]
)

EXERCISE_CONFIG = T.StructType(
    [
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("enabled", T.BooleanType(), False),
        T.StructField("joint_a", T.StringType()),
        T.StructField("joint_b", T.StringType()),
        T.StructField("joint_c", T.StringType()),
        T.StructField("down_threshold", T.DoubleType()),
        T.StructField("up_threshold", T.DoubleType()),
        T.StructField("min_confidence", T.DoubleType()),
    ]
)

EXERCISE_STATE = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("det_idx", T.IntegerType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("exercise", T.StringType()),
        T.StructField("rep_count", T.LongType()),
        T.StructField("phase", T.StringType()),
        T.StructField("angle", T.DoubleType()),
        T.StructField("feedback", T.StringType()),
    ]
)

#: Identity of a person row, and the order of a track's rows.
PERSON_KEY = ("video_id", "frame_idx", "det_idx")
FRAME_KEY = ("video_id", "frame_idx")
TRACK_KEY = ("video_id", "track_id")
TRACK_ORDER = ("frame_idx", "det_idx")
