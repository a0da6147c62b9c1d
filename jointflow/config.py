"""Exercise settings: a small driver-side dict, turned into specs and a table.

The dict has one entry per exercise in drawing order, for example::

    {"squat": {"enabled": True, "keypoints": ["hip", "knee", "ankle"],
               "down_threshold": 90, "up_threshold": 160, "min_confidence": 0.5}}
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointflow.functions.pose import joint_index
from jointflow.schema import EXERCISE_CONFIG

# The settings and joints an exercise has when none are given.
DEFAULT_JOINTS = ("hip", "knee", "ankle")
DEFAULT_CONFIG = {
    "squat": {
        "enabled": True,
        "keypoints": ["hip", "knee", "ankle"],
        "down_threshold": 90,
        "up_threshold": 160,
        "min_confidence": 0.5,
    }
}
DEFAULT_CONFIDENCE = 0.45
DEFAULT_IOU = 0.45

REQUIRED = ("down_threshold", "up_threshold", "min_confidence")


@dataclass(frozen=True)
class Machine:
    """One up/down counter over an angle: below ``down`` goes down, above ``up`` comes up.

    The angle is that of three ``joints`` gated by ``min_confidence``, or any ``angle`` column over
    person rows that is NULL on rows which must leave the counter untouched. ``ordinal`` is
    the position among the active exercises.
    """

    name: str
    ordinal: int
    down: float
    up: float
    joints: tuple[str, str, str] | None = None
    min_confidence: float = 0.0
    angle: Column | None = None


#: Builds the counter of a configured exercise.
MachineBuilder = Callable[[str, int, Mapping], Machine]
#: Computes exercise_state rows from person rows, given the exercise's settings.
StateTransform = Callable[[DataFrame, Mapping], DataFrame]


def three_joint_machine(name: str, ordinal: int, settings: Mapping) -> Machine:
    """Counter on the angle of three joints, e.g. hip, knee, ankle."""
    missing = [key for key in REQUIRED if settings.get(key) is None]
    if missing:
        raise KeyError(f"exercise {name!r} lacks {', '.join(missing)}")
    joints = tuple(settings.get("keypoints") or DEFAULT_JOINTS)
    if len(joints) != 3:
        raise ValueError(f"exercise {name!r} needs three joints, got {list(joints)}")
    return Machine(
        name=name,
        ordinal=ordinal,
        down=float(settings["down_threshold"]),
        up=float(settings["up_threshold"]),
        joints=joints,
        min_confidence=float(settings["min_confidence"]),
    )


@dataclass
class Registry:
    """Known exercises by name. Only registered and enabled ones run; others are ignored.

    An exercise is either a counter (``builder``), all of which share one pass over
    the data, or a DataFrame ``transform`` of its own.
    """

    builders: dict[str, MachineBuilder] = field(
        default_factory=lambda: {"squat": three_joint_machine}
    )
    transforms: dict[str, StateTransform] = field(default_factory=dict)

    def register(
        self,
        name: str,
        builder: MachineBuilder | None = None,
        transform: StateTransform | None = None,
    ) -> "Registry":
        """Add an exercise or replace the one of that name; by default a three-joint counter."""
        if builder is not None and transform is not None:
            raise ValueError("give a builder or a transform, not both")
        self.builders.pop(name, None)
        self.transforms.pop(name, None)
        if transform is not None:
            self.transforms[name] = transform
        else:
            self.builders[name] = builder or three_joint_machine
        return self

    @property
    def names(self) -> list[str]:
        return [*self.builders, *self.transforms]

    def active(self, config: Mapping[str, Mapping]) -> list[tuple[int, str, Mapping]]:
        """``(ordinal, name, settings)`` of the exercises to run, in the order of ``config``."""
        known = set(self.names)
        chosen = [(n, s) for n, s in config.items() if s.get("enabled") and n in known]
        return [(i, n, s) for i, (n, s) in enumerate(chosen)]

    def machines(self, config: Mapping[str, Mapping]) -> list[Machine]:
        return [
            self.builders[name](name, i, settings)
            for i, name, settings in self.active(config)
            if name in self.builders
        ]

    def custom(self, config: Mapping[str, Mapping]) -> list[tuple[int, str, Mapping, StateTransform]]:
        return [
            (i, name, settings, self.transforms[name])
            for i, name, settings in self.active(config)
            if name in self.transforms
        ]


def config_df(spark: SparkSession, config: Mapping[str, Mapping]) -> DataFrame:
    """The settings as a table with their order kept in ``ord``.

    A missing ``enabled`` is false; an enabled exercise without a threshold is an error.
    """
    rows = []
    for ord_, (name, settings) in enumerate(config.items()):
        missing = [key for key in REQUIRED if settings.get(key) is None]
        if settings.get("enabled") and missing:
            raise KeyError(f"exercise {name!r} lacks {', '.join(missing)}")
        joints = tuple(settings.get("keypoints") or DEFAULT_JOINTS)
        for joint in joints:
            joint_index(f"left_{joint}")
        limits = [None if settings.get(k) is None else float(settings[k]) for k in REQUIRED]
        rows.append((ord_, name, bool(settings.get("enabled")), *joints, *limits))
    return spark.createDataFrame(rows, EXERCISE_CONFIG)


def registry_df(spark: SparkSession, registry: Registry) -> DataFrame:
    schema = T.StructType([T.StructField("name", T.StringType(), False)])
    return spark.createDataFrame([(n,) for n in registry.names], schema)


def active_exercises(config: DataFrame, registered: DataFrame) -> DataFrame:
    """Enabled exercises that are registered, with their ordinal among the active ones.

    Both tables hold one row per exercise name known to the driver, so the
    broadcast side and the unpartitioned ordinal window are bounded by the config.
    """
    from pyspark.sql import Window

    ordinal = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord")) - 1
    return (
        config.filter("enabled")
        .join(F.broadcast(registered), "name")
        .withColumn("ordinal", ordinal)
    )
