"""The frame loop as one plan: frames to persons to exercise states and drawing lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from jointflow.config import DEFAULT_CONFIDENCE, DEFAULT_IOU, Registry
from jointflow.operators.detections import filter_frames, flat_detections, parse_detections, suppress_frames
from jointflow.operators.exercise import Cut, track_states, with_custom_states
from jointflow.operators.overlay import overlay
from jointflow.operators.tracking import TrackerConfig, assign_tracks
from jointflow.session import written


def persons_of(
    frames: DataFrame, confidence: float = DEFAULT_CONFIDENCE, iou: float = DEFAULT_IOU
) -> DataFrame:
    """Person rows of tracked frames: weak and duplicate boxes removed. No shuffle."""
    return parse_detections(suppress_frames(filter_frames(frames, confidence), iou))


def track_persons(
    frames: DataFrame,
    confidence: float = DEFAULT_CONFIDENCE,
    iou: float = DEFAULT_IOU,
    tracker: TrackerConfig = TrackerConfig(),
) -> DataFrame:
    """Person rows of frames without ids: as :func:`persons_of`, with tracks assigned here.

    The detections are written once, as tracking reads them more than once and a detector is costly. Detections that
    belong to no track are left out.
    """
    found = written(flat_detections(suppress_frames(filter_frames(frames, confidence), iou)), "detections")
    return assign_tracks(found, tracker).filter("track_id IS NOT NULL")


def _states(persons: DataFrame, config, registry, cut: Cut, keep: tuple[str, ...], sized_by: DataFrame | None):
    registry = registry or Registry()
    if registry.custom(config):  # these read the persons once more each
        persons, sized_by = written(persons, "persons"), None
    states = track_states(persons, registry.machines(config), cut, keep, sized_by)
    return with_custom_states(states, persons, config, registry)


def frame_states(
    frames: DataFrame,
    config: Mapping[str, Mapping],
    registry: Registry | None = None,
    confidence: float = DEFAULT_CONFIDENCE,
    iou: float = DEFAULT_IOU,
    cut: Cut = "auto",
    keep: tuple[str, ...] = ("bbox", "keypoints"),
    tracker: TrackerConfig | None = None,
) -> DataFrame:
    """Person rows with the states of all active exercises, in the order of the config.

    With ``tracker`` the frames' own ids, if any, give way to assigned ones. Long tracks are told by
    the detections before suppression, which are never fewer and need no work to count.
    """
    if tracker is not None:
        persons = written(track_persons(frames, confidence, iou, tracker), "persons")
        return _states(persons, config, registry, cut, keep, None)
    return _states(persons_of(frames, confidence, iou), config, registry, cut, keep, parse_detections(frames))


def frame_overlay(
    frames: DataFrame, config: Mapping[str, Mapping], registry: Registry | None = None, **options
) -> DataFrame:
    """Drawing list of every frame."""
    return overlay(frame_states(frames, config, registry, **options))
