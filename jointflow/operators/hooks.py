"""Places for the user's own model or tracker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jointflow.schema import DETECTIONS


def detect_with(
    frames: DataFrame,
    detect: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType = DETECTIONS,
    setup: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]] | None = None,
) -> DataFrame:
    """Run a detector over frames (rows of a ``binaryFile`` source or any frame table).

    ``detect`` maps a batch of frame rows to rows of ``schema``. A model that is slow to load comes as
    ``setup``, which is called once per task and returns the function to use. Batches follow
    ``spark.sql.execution.arrow.maxRecordsPerBatch``; nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = setup() if setup is not None else detect
        for batch in batches:
            yield found(batch)

    return frames.mapInPandas(run, schema)
