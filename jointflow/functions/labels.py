"""Texts shown next to a person."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message and label formats, palette size.
REP_MESSAGE = "✅ Rep "
PALETTE_SIZE = 100


def rep_feedback(rep_count: Column) -> Column:
    """The last repetition message, empty before the first repetition."""
    return F.when(rep_count > 0, F.concat(F.lit(REP_MESSAGE), rep_count.cast("string"))).otherwise(
        F.lit("")
    )


def whole_degrees(angle: Column) -> Column:
    """Angle as text without decimals, halves to even; NaN prints ``nan``."""
    return F.when(F.isnan(angle), F.lit("nan")).otherwise(
        F.bround(angle, 0).try_cast("bigint").cast("string")
    )


def exercise_text(name: Column, rep_count: Column, angle: Column) -> Column:
    return F.concat(
        name, F.lit(": "), rep_count.cast("string"), F.lit(" reps | "), whole_degrees(angle), F.lit("°")
    )


def color_slot(track_id: Column) -> Column:
    """Palette slot of a track; never negative."""
    return F.pmod(track_id, F.lit(PALETTE_SIZE)).cast("int")
