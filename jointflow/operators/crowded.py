"""Exact greedy box suppression for frames too crowded to be gathered into one row.

Rounds over a pyramid of grids. A box has the level whose cell size is its longer side
rounded down to a power of two. Two boxes with IoU above ``t`` differ in area by less than a
factor ``1/t`` and in each side as well, so their levels differ by at most ``log2(1/t)``, rounded up.
A box is registered in all cells it touches on its own level and on that many levels above;
any two boxes that may overlap enough thus share a cell. In each round a box that ranks first in
all its cells can have no better overlapping rival and is kept, and boxes overlapping a kept
one go. A cell has at most one kept box per round, so no pairs inside a cell are ever formed, and the
first-in-cell test is a plain aggregation, combined before its shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointflow.functions.boxes import overlaps
from jointflow.schema import FRAME_KEY, PERSON_KEY
from jointflow.session import written

_CELL = (*FRAME_KEY, "level", "gx", "gy")


def _cells(boxes: DataFrame, spread: int) -> DataFrame:
    """One row per box and cell it touches; ``cells`` counts them."""

    def touched(level):
        size = F.pow(F.lit(2.0), level)

        def span(axis):
            return F.sequence(
                F.floor(F.col(f"bbox.{axis}1") / size).cast("bigint"),
                F.floor(F.col(f"bbox.{axis}2") / size).cast("bigint"),
            )

        return F.flatten(
            F.transform(
                span("x"),
                lambda gx: F.transform(
                    span("y"),
                    lambda gy: F.struct(level.alias("level"), gx.alias("gx"), gy.alias("gy")),
                ),
            )
        )

    longer = F.greatest(F.col("bbox.x2") - F.col("bbox.x1"), F.col("bbox.y2") - F.col("bbox.y1"))
    levels = F.sequence(F.col("_level"), F.col("_level") + spread)
    cells = F.flatten(F.transform(levels, touched))
    return (
        boxes.withColumn("_level", F.floor(F.log2(longer)).cast("int"))
        .withColumn("_cells", cells)
        .withColumn("cells", F.size("_cells"))
        .select(*PERSON_KEY, "rank", "bbox", "cells", F.inline("_cells"))
    )


def suppress_in_crowds(rows: DataFrame, iou: float) -> DataFrame:
    """Keys of the boxes greedy suppression keeps. Each round's remainder is written out, so a lost
    executor costs at most one round."""
    if not 0.0 < iou < 1.0:
        raise ValueError(f"iou must lie between 0 and 1, got {iou}")
    spread = math.ceil(math.log2(1.0 / iou))
    b = F.col("bbox")
    real = (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])
    for corner in ("x1", "y1", "x2", "y2"):
        real = real & ~F.isnan(b[corner]) & (F.abs(b[corner]) < float("inf"))
    ranked = rows.select(
        *PERSON_KEY,
        F.struct((-F.col("conf")).alias("worse"), F.col("det_idx").alias("det_idx")).alias("rank"),
        "bbox",
        F.coalesce(real, F.lit(False)).alias("_real"),
    )
    # A box without area overlaps nothing, nor does one without end: its overlap with any other is no number or none.
    kept = [ranked.filter(~F.col("_real")).select(*PERSON_KEY)]
    alive = written(ranked.filter("_real").drop("_real"), "crowd")
    while not alive.isEmpty():
        registered = _cells(alive, spread)
        firsts = registered.groupBy(*_CELL).agg(
            F.min_by(F.struct("det_idx", "bbox", "cells"), "rank").alias("first")
        )
        winners = written(
            firsts.groupBy(*FRAME_KEY, F.col("first.det_idx").alias("det_idx"))
            .agg(F.count("*").alias("won"), F.first("first").alias("first"))
            .filter(F.col("won") == F.col("first.cells"))
            .select(*PERSON_KEY, F.col("first.bbox").alias("bbox")),
            "crowd",
        )
        if winners.isEmpty():
            raise RuntimeError("no box is first in all its cells: detections repeat a det_idx in one frame")
        kept.append(winners.select(*PERSON_KEY))
        marks = (
            _cells(winners.withColumn("rank", F.lit(None)), spread)
            .select(*_CELL, F.col("bbox").alias("best"))
        )
        beaten = (
            registered.join(marks, list(_CELL))
            .filter(overlaps(F.col("best"), F.col("bbox"), iou))
            .select(*PERSON_KEY)
            .distinct()
        )
        # A kept box overlaps itself, so it is among the beaten ones too.
        alive = written(alive.join(beaten, list(PERSON_KEY), "left_anti"), "crowd")
    result = kept[0]
    for part in kept[1:]:
        result = result.unionByName(part)
    return result
