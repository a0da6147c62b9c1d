"""Joint lookup, confidence gate, side choice and joint angle as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The COCO keypoint order.
COCO_JOINTS = {
    "nose": 0,
    "left_eye": 1,
    "right_eye": 2,
    "left_ear": 3,
    "right_ear": 4,
    "left_shoulder": 5,
    "right_shoulder": 6,
    "left_elbow": 7,
    "right_elbow": 8,
    "left_wrist": 9,
    "right_wrist": 10,
    "left_hip": 11,
    "right_hip": 12,
    "left_knee": 13,
    "right_knee": 14,
    "left_ankle": 15,
    "right_ankle": 16,
}
KEYPOINT_COUNT = 17

# Sides in order of preference, and the guard against a zero division.
SIDES = ("left", "right")
LIMB_EPSILON = 1e-6


def joint_index(name: str) -> int:
    """Position of a named joint; an unknown name is an error when the plan is built."""
    if name not in COCO_JOINTS:
        raise KeyError(f"unknown joint {name!r}; known joints: {', '.join(COCO_JOINTS)}")
    return COCO_JOINTS[name]


def joint_xy(name: str, keypoints: str = "keypoints") -> Column:
    """``STRUCT<x, y>`` of a joint, NULL when the person has no such keypoint."""
    return F.expr(f"get({keypoints}.coords, {joint_index(name)})")


def joint_score(name: str, keypoints: str = "keypoints") -> Column:
    return F.expr(f"get({keypoints}.scores, {joint_index(name)})")


def side_gate(side: str, joints: Sequence[str], min_confidence: float, keypoints: str = "keypoints") -> Column:
    """True when the lowest score of the side's joints reaches ``min_confidence`` (equal passes).

    A NULL or NaN score never passes. Each score is compared on its own because
    ``least`` skips NULLs and NaN sorts above every number.
    """
    return F.expr(_gate(side, joints, min_confidence, keypoints))


def _gate(side: str, joints: Sequence[str], min_confidence: float, keypoints: str) -> str:
    scores = [f"get({keypoints}.scores, {joint_index(f'{side}_{joint}')})" for joint in joints]
    passes = [
        f"coalesce({score} >= double('{float(min_confidence)}') AND NOT isnan({score}), false)"
        for score in scores
    ]
    return f"({' AND '.join(passes)})"


def chosen_side(joints: Sequence[str], min_confidence: float, keypoints: str = "keypoints") -> Column:
    """Name of the first side that passes the gate, left before right, else NULL."""
    cases = [f"WHEN {_gate(side, joints, min_confidence, keypoints)} THEN '{side}'" for side in SIDES]
    return F.expr(f"CASE {' '.join(cases)} END")


def cosine(u: tuple[str, str], v: tuple[str, str]) -> Column:
    """Cosine between two limbs given by their columns; a limb of length zero gives 0, hence 90
    degrees."""
    (ux, uy), (vx, vy) = u, v
    lengths = f"sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy})"
    return F.expr(f"({ux} * {vx} + {uy} * {vy}) / ({lengths} + double('{LIMB_EPSILON}'))")


def degrees_of(cos: str) -> Column:
    """Angle of a cosine column, clipped. NULL stays NULL and NaN stays NaN.

    The NaN branch is explicit because ``least(1, NaN)`` is 1 in Spark, the NULL one because
    ``least`` skips NULLs.
    """
    return F.expr(
        f"CASE WHEN isnan({cos}) THEN double('NaN') "
        f"WHEN {cos} IS NOT NULL THEN degrees(acos(least(1D, greatest(-1D, {cos})))) END"
    )


def _sided(tag: str, joint: str, keypoints: str) -> str:
    """A joint's point on the side named by the column ``<tag>_side``."""
    cases = " ".join(f"WHEN '{side}' THEN {joint_index(f'{side}_{joint}')}" for side in SIDES)
    return f"get({keypoints}.coords, CASE {tag}_side {cases} END)"


def with_side_angles(
    df: DataFrame, wanted: Mapping[str, tuple[Sequence[str], float]], keypoints: str = "keypoints"
) -> DataFrame:
    """Add ``<tag>_side`` and ``<tag>_angle`` per wanted ``tag: (three joints, min_confidence)``: the
    angle on the first side that passes the gate. No row is dropped."""
    original = df.columns
    df = df.withColumns(
        {f"{t}_side": chosen_side(joints, gate, keypoints) for t, (joints, gate) in wanted.items()}
    )
    points = {t: [_sided(t, joint, keypoints) for joint in joints] for t, (joints, _) in wanted.items()}
    df = with_angles(df, points)
    return df.select(*original, *[f"{t}_{n}" for t in wanted for n in ("side", "angle")])


def with_angles(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``<tag>_angle``, the angle at the second of three points given as SQL expressions.

    Built in steps (limbs, cosine, angle), each used several times by the next, so that every
    value is computed once per row and the generated methods stay small enough to be compiled.
    """
    original = df.columns
    limbs = {}
    for t, (a, b, c) in wanted.items():
        for axis in ("x", "y"):
            limbs[f"{t}_u{axis}"] = F.expr(f"{a}.{axis} - {b}.{axis}")
            limbs[f"{t}_v{axis}"] = F.expr(f"{c}.{axis} - {b}.{axis}")
    df = df.withColumns(limbs)
    df = df.withColumns(
        {
            f"{t}_cos": cosine((f"{t}_ux", f"{t}_uy"), (f"{t}_vx", f"{t}_vy"))
            for t in wanted
        }
    )
    df = df.withColumns({f"{t}_angle": degrees_of(f"{t}_cos") for t in wanted})
    return df.select(*original, *[f"{t}_angle" for t in wanted])
