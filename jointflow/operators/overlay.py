"""What to draw on a frame, as rows: skeleton lines, keypoint dots, id and exercise texts.

A person's items form one array, so a person is read once and all kinds of items come out of one
projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointflow.functions.labels import color_slot, exercise_text
from jointflow.schema import FRAME_KEY, PERSON_KEY

# The skeleton as pairs of keypoint indices, and the drawing style.
SKELETON = (
    (5, 6),
    (5, 7),
    (7, 9),
    (6, 8),
    (8, 10),
    (5, 11),
    (6, 12),
    (11, 12),
    (11, 13),
    (13, 15),
    (12, 14),
    (14, 16),
)
DRAW_SCORE = 0.4
LINE_THICKNESS = 2
DOT_RADIUS = 4
FILLED = -1
ID_OFFSET, ID_SCALE, ID_THICKNESS = 10, 0.6, 2
TEXT_OFFSET, TEXT_STEP, TEXT_SCALE, TEXT_THICKNESS = 28, 18, 0.5, 1

_ITEM = {
    "kind": "STRING",
    "idx": "INT",
    "x1": "INT",
    "y1": "INT",
    "x2": "INT",
    "y2": "INT",
    "size": "DOUBLE",
    "thickness": "INT",
    "text": "STRING",
}
_NONE = f"CAST(array() AS ARRAY<STRUCT<{', '.join(f'{n}: {t}' for n, t in _ITEM.items())}>>)"


def _item(**values: object) -> str:
    """SQL of one item; fields not given are NULL."""
    fields = [f"'{n}', CAST({values.get(n, 'NULL')} AS {t})" for n, t in _ITEM.items()]
    return f"named_struct({', '.join(fields)})"


def _pixel(value: str) -> str:
    """Truncated toward zero; NaN or out-of-range becomes NULL instead of failing the job."""
    return f"TRY_CAST({value} AS INT)"


def _shown(score: str) -> str:
    """Strictly above the drawing score; NULL and NaN are not."""
    return f"coalesce({score} > double('{DRAW_SCORE}') AND NOT isnan({score}), false)"


def _line_shown(a: str, b: str) -> str:
    return f"{_shown(f'get(keypoints.scores, {a})')} AND {_shown(f'get(keypoints.scores, {b})')}"


def segment_items() -> Column:
    """Lines of the skeleton whose two ends are both shown."""
    edges = ", ".join(
        f"named_struct('idx', {i}, 'a', {a}, 'b', {b})" for i, (a, b) in enumerate(SKELETON)
    )
    ends = {
        f"{axis}{n}": _pixel(f"get(keypoints.coords, e.{end}).{axis}")
        for n, end in ((1, "a"), (2, "b"))
        for axis in ("x", "y")
    }
    line = _item(kind="'segment'", idx="e.idx", thickness=LINE_THICKNESS, **ends)
    drawn = f"filter(array({edges}), e -> {_line_shown('e.a', 'e.b')})"
    return F.expr(
        f"CASE WHEN keypoints IS NOT NULL THEN transform({drawn}, e -> {line}) ELSE {_NONE} END"
    )


def dot_items() -> Column:
    """Filled dots of the keypoints that are shown."""
    dot = _item(
        kind="'dot'",
        idx="i",
        x1=_pixel("get(keypoints.coords, i).x"),
        y1=_pixel("get(keypoints.coords, i).y"),
        size=DOT_RADIUS,
        thickness=FILLED,
    )
    drawn = (
        f"filter(sequence(0, size(keypoints.scores) - 1), i -> {_shown('get(keypoints.scores, i)')})"
    )
    return F.expr(
        f"CASE WHEN size(keypoints.scores) > 0 THEN transform({drawn}, i -> {dot}) ELSE {_NONE} END"
    )


def id_items() -> Column:
    """The track id above the box; also for a person without keypoints."""
    label = _item(
        kind="'id'",
        idx=0,
        x1=_pixel("bbox.x1"),
        y1=f"{_pixel('bbox.y1')} - {ID_OFFSET}",
        size=ID_SCALE,
        thickness=ID_THICKNESS,
        text="concat('ID:', string(track_id))",
    )
    return F.expr(f"array({label})")


def exercise_items() -> Column:
    """One text per active exercise, stacked upwards in exercise order. Needs ``_texts``."""
    label = _item(
        kind="'exercise'",
        idx="s.ordinal",
        x1=_pixel("bbox.x1"),
        y1=f"{_pixel('bbox.y1')} - {TEXT_OFFSET} - s.ordinal * {TEXT_STEP}",
        size=TEXT_SCALE,
        thickness=TEXT_THICKNESS,
        text="s.text",
    )
    return F.expr(f"transform(_texts, s -> {label})")


def _texts() -> Column:
    return F.transform(
        "states",
        lambda s: F.struct(
            s["ordinal"].alias("ordinal"),
            exercise_text(s["exercise"], s["rep_count"], s["angle"]).alias("text"),
        ),
    ).alias("_texts")


def _rows(persons: DataFrame, items: Column) -> DataFrame:
    color = color_slot(F.col("track_id")).alias("color_idx")
    return persons.select(*PERSON_KEY, "track_id", color, F.inline(items))


def skeleton_segments(persons: DataFrame) -> DataFrame:
    return _rows(persons, segment_items())


def keypoint_dots(persons: DataFrame) -> DataFrame:
    return _rows(persons, dot_items())


def id_labels(persons: DataFrame) -> DataFrame:
    return _rows(persons, id_items())


def exercise_labels(persons_with_states: DataFrame) -> DataFrame:
    return _rows(persons_with_states.select("*", _texts()), exercise_items())


def overlay(persons_with_states: DataFrame) -> DataFrame:
    """The drawing list of every frame; ``z`` counts from 1 in drawing order.

    Persons in detection order; per person lines, dots, id, exercises. Only person rows cross the
    shuffle by frame: the items before a person are a running sum of item counts over the few
    persons of the frame, and the items themselves are made after it.
    """
    lines = " + ".join(f"int({_line_shown(str(a), str(b))})" for a, b in SKELETON)
    dots = f"coalesce(size(filter(keypoints.scores, s -> {_shown('s')})), 0)"
    count = F.expr(f"{lines} + greatest(0, {dots}) + 1 + size(states)")
    earlier = (
        Window.partitionBy(*FRAME_KEY)
        .orderBy("det_idx")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    items = F.concat(segment_items(), dot_items(), id_items(), exercise_items())
    return (
        persons_with_states.select(
            *PERSON_KEY, "track_id", "bbox", "keypoints", _texts(), count.alias("_count")
        )
        .withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
        .select(
            *PERSON_KEY,
            color_slot(F.col("track_id")).alias("color_idx"),
            "_before",
            F.posexplode(items).alias("_pos", "_item"),
        )
        .select(
            *PERSON_KEY,
            F.expr("int(_before + _pos + 1)").alias("z"),
            "color_idx",
            "_item.*",
        )
        .drop("idx")
    )
