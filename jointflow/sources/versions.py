"""A table of one newest row per key, kept by the micro-batches of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions from one whole table to the next: a key is written on average once more in so many micro-batches than it changes.
EVERY = 16


class Versions:
    """Rows by ``keys`` under ``path/version=<n>``; of a key the row highest by ``order`` counts.

    A version holds only the keys its micro-batch changed, and every ``EVERY``-th one all of them, so a reader needs those since
    the last whole one. A micro-batch that is run again overwrites its own version and reads those before, which are there until
    the whole version after them is followed by another.
    """

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str], schema: T.StructType) -> None:
        self.path, self.keys, self.order, self.schema = path, list(keys), list(order), schema

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = [n for n in self.schema.fieldNames() if n not in self.keys]
        last = F.max_by(F.struct(*names), F.struct(*self.order)).alias("last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "last.*").select(*self.schema.fieldNames())

    def read(self, spark: SparkSession, version: int, only: DataFrame | None = None) -> DataFrame:
        """The table as of ``version`` (below 0: empty); with ``only``, the keys it lists."""
        if version < 0:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/version={n}" for n in range(version // EVERY * EVERY, version + 1)]
        rows = spark.read.schema(self.schema).parquet(*paths)
        if only is not None:
            rows = rows.join(only, self.keys, "left_semi")
        return self._newest(rows)

    def write(self, changed: DataFrame, version: int) -> None:
        """``changed`` has one row for each key that changed. Versions that nothing needs any longer go."""
        spark = changed.sparkSession
        changed = changed.select(*self.schema.fieldNames())
        if version and version % EVERY == 0:
            changed = self._newest(self.read(spark, version - 1).unionByName(changed))
        changed.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        if version % EVERY == 1:
            for old in range(max(0, version - 1 - EVERY), version - 1):
                self._delete(spark, old)

    def _delete(self, spark: SparkSession, version: int) -> None:
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={version}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def read_newest(self, spark: SparkSession) -> DataFrame:
        """The table as of its newest version; only the numbers of the versions are looked at to find it."""
        found = spark.read.option("basePath", self.path).schema(self.schema).parquet(self.path)
        return self.read(spark, found.agg(F.max("version")).first()[0])
