"""Filter, de-duplicate and unnest detections.

Each operator exists for frame rows (arrays, no shuffle at all) and for flat rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointflow.config import DEFAULT_CONFIDENCE, DEFAULT_IOU
from jointflow.operators.crowded import suppress_in_crowds
from jointflow.schema import DETECTIONS, FRAME_KEY, PERSON_KEY
from jointflow.session import written

#: Frames with more boxes than this are not gathered into one row but handled across tasks.
CROWD = 4_096

_PER_DETECTION = ("boxes", "box_conf", "track_ids", "kpt_xy", "kpt_conf")


def filter_confidence(rows: DataFrame, threshold: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """Flat detections with at least this confidence."""
    return rows.filter((F.col("conf") >= F.lit(float(threshold))) & ~F.isnan("conf"))


def _take(frames: DataFrame, kept: Column) -> DataFrame:
    """Frame rows reduced to the detections at the positions in the array ``kept``."""

    def taken(array: Column) -> Column:
        return F.when(array.isNotNull(), F.transform("_kept", lambda i: F.get(array, i)))

    return (
        frames.withColumn("_kept", kept)
        .withColumns({name: taken(F.col(name)) for name in _PER_DETECTION})
        .drop("_kept")
    )


def _positions() -> Column:
    # An empty frame needs its own branch: sequence(0, -1) would count down.
    return F.expr(
        "CASE WHEN size(boxes) > 0 THEN sequence(0, size(boxes) - 1) ELSE CAST(array() AS ARRAY<INT>) END"
    )


def filter_frames(frames: DataFrame, threshold: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """Frame rows without their detections below the confidence; a frame may become empty.

    Frames without ``box_conf`` say nothing about confidence and keep their detections.
    """

    def enough(i: Column) -> Column:
        conf = F.get(F.col("box_conf"), i)
        return F.col("box_conf").isNull() | ((conf >= F.lit(float(threshold))) & ~F.isnan(conf))

    return _take(frames, F.filter(_positions(), enough))


def _checked(iou: float) -> None:
    if not 0.0 <= iou <= 1.0:
        raise ValueError(f"iou must lie between 0 and 1, got {iou}")


def _greedy(candidates: str, iou: float) -> Column:
    """Greedy suppression inside one array of ``STRUCT<rank, det_idx, box, area>``, best rank first.

    Written as SQL text: the comparison is evaluated per pair of boxes, so it stops at the first side
    on which two boxes do not meet.
    """
    width = "least(k.box.x2, b.box.x2) - greatest(k.box.x1, b.box.x1)"
    height = "least(k.box.y2, b.box.y2) - greatest(k.box.y1, b.box.y1)"
    inter = f"({width}) * ({height})"
    overlap = (
        f"{width} > 0 AND {height} > 0 "
        f"AND {inter} > double('{float(iou)}') * (k.area + b.area - {inter})"
    )
    return F.expr(
        f"aggregate(array_sort({candidates}), filter({candidates}, c -> false), "
        f"(kept, b) -> CASE WHEN exists(kept, k -> {overlap}) THEN kept ELSE array_append(kept, b) END, "
        "kept -> array_sort(transform(kept, k -> k.det_idx)))"
    )


def _candidate(det_idx: str, conf: str, box: str) -> str:
    area = f"greatest(0D, {box}.x2 - {box}.x1) * greatest(0D, {box}.y2 - {box}.y1)"
    return (
        f"named_struct('rank', -{conf}, 'det_idx', {det_idx}, 'box', {box}, 'area', {area})"
    )


def suppress_frames(frames: DataFrame, iou: float = DEFAULT_IOU) -> DataFrame:
    """Frame rows without boxes that overlap a better box of the frame; order is kept."""
    one = _candidate("i", "get(box_conf, i)", "get(boxes, i)")
    frames = frames.withColumn("_at", _positions()).withColumn(
        "_candidates", F.expr(f"transform(_at, i -> {one})")
    )
    return _take(frames, _greedy("_candidates", iou)).drop("_at", "_candidates")


def suppress_duplicates(
    rows: DataFrame, iou: float = DEFAULT_IOU, crowd: int | None = CROWD
) -> DataFrame:
    """Flat detections without those overlapping a better one of the same frame.

    Better means higher ``conf``, then lower ``det_idx``. Exact greedy suppression. A frame is
    gathered into one row, so frame sizes are counted first (one job over the two key columns,
    combined before its shuffle); frames beyond ``crowd`` boxes take :func:`suppress_in_crowds`,
    which gives the same result without gathering. ``crowd=None`` skips the count where frames
    are known to be small. Rows need a frame and a ``det_idx`` of their own in it; rows without are left out.
    """
    _checked(iou)
    rows = rows.dropna(subset=list(PERSON_KEY))
    if crowd is None:
        return _suppress_gathered(rows, iou)
    sizes = rows.groupBy(*FRAME_KEY).count()
    crowded = written(sizes.filter(F.col("count") > crowd).select(*FRAME_KEY), "crowded")
    if crowded.isEmpty():
        return _suppress_gathered(rows, iou)
    if not 0.0 < iou < 1.0:
        # At 1 no box goes. At 0 any contact counts, and the pyramid of grids would have no end.
        return rows if iou == 1.0 else _suppress_gathered(rows, iou)
    few = _suppress_gathered(rows.join(crowded, list(FRAME_KEY), "left_anti"), iou)
    many = rows.join(crowded, list(FRAME_KEY), "left_semi")
    kept = suppress_in_crowds(many, iou)
    return few.unionByName(many.join(kept, list(PERSON_KEY), "left_semi").select(*few.columns))


def _suppress_gathered(rows: DataFrame, iou: float) -> DataFrame:
    payload = [c for c in rows.columns if c not in FRAME_KEY]
    one = _candidate("d.det_idx", "d.conf", "d.bbox")
    gathered = rows.groupBy(*FRAME_KEY).agg(
        F.collect_list(F.struct(*payload)).alias("_found")
    )
    candidates = F.expr(f"transform(_found, d -> {one})")
    # Named twice, _kept is computed once per frame: a column used only once would be moved
    # into the lambda. And as inline gets an expression and not a column, no filter on its size is
    # derived, which would be pushed below and compute everything again.
    kept = F.expr(
        "CASE WHEN size(_kept) = size(_found) THEN _found "
        "ELSE filter(_found, d -> array_contains(_kept, d.det_idx)) END"
    )
    return (
        gathered.withColumn("_candidates", candidates)
        .withColumn("_kept", _greedy("_candidates", iou))
        .select(*FRAME_KEY, F.inline(kept))
        .select(*rows.columns)
    )


def tracked_only(frames: DataFrame) -> DataFrame:
    """Frame rows that have boxes and track ids at all."""
    return frames.filter(F.col("boxes").isNotNull() & F.col("track_ids").isNotNull())


def _unnested(frames: DataFrame, when: Column) -> DataFrame:
    """One row per position of the detection arrays of frames for which ``when`` holds."""
    # arrays_zip is NULL as soon as one array is, so absent optional arrays count as empty.
    types = {f.name: f.dataType for f in DETECTIONS.fields}
    zipped = F.arrays_zip(
        *[
            F.coalesce(F.col(name), F.array().cast(types[name])).alias(name)
            for name in _PER_DETECTION
        ]
    )
    # Not a filter: it would be pushed below the steps that made the arrays and compute them again.
    found = F.col("found")
    return frames.select(
        *FRAME_KEY, "ts", F.posexplode(F.when(when, zipped)).alias("det_idx", "found")
    ).filter(found["boxes"].isNotNull())


def _detection_columns() -> list[Column]:
    found = F.col("found")
    return [
        found["box_conf"].alias("conf"),
        found["boxes"].alias("bbox"),
        F.when(
            found["kpt_xy"].isNotNull() & found["kpt_conf"].isNotNull(),
            F.struct(found["kpt_xy"].alias("coords"), found["kpt_conf"].alias("scores")),
        ).alias("keypoints"),
    ]


def parse_detections(frames: DataFrame) -> DataFrame:
    """One person row per box that has a track id, in detection order; no shuffle.

    Boxes beyond the ids, and ids beyond the boxes, are left out. A person
    without keypoints gets NULL keypoints.
    """
    tracked = F.col("boxes").isNotNull() & F.col("track_ids").isNotNull()
    track_id = F.col("found")["track_ids"]
    return (
        _unnested(frames, tracked)
        .filter(track_id.isNotNull())
        .select(*FRAME_KEY, "ts", "det_idx", track_id.cast("bigint").alias("track_id"), *_detection_columns())
    )


def flat_detections(frames: DataFrame) -> DataFrame:
    """One row per box, whether or not it has a track id, for a tracker to give it one; no shuffle."""
    return _unnested(frames, F.col("boxes").isNotNull()).select(*FRAME_KEY, "ts", "det_idx", *_detection_columns())
