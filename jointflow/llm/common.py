"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(col, UPPER, LOWER)


def whole_text(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, mod ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker process, for caches over tasks.

    A worker serves one operator after the other; asking for one's cache drops those of the others.
    """
    module = sys.modules.setdefault("_jointflow_worker_state", types.ModuleType("_jointflow_worker_state"))
    kept = module.__dict__.setdefault("state", {})
    if name not in kept:
        kept.clear()
        kept[name] = {}
    return kept[name]


def give_back() -> None:
    """At the end of a task: what it has freed goes back to the system, as its worker lives on beside stages that need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def drop_caches() -> None:
    """For tasks without a cache of their own: what operators before have left in this worker goes."""
    worker_state("none")
    give_back()


def unused_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in range(len(taken) + 1) if (n := f"_{name}{k or ''}") not in taken) for name in wanted]


def append_columns(
    df: DataFrame,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.Table], list[pa.Array]]],
    rows: int = 512,
    caches: bool = False,
) -> DataFrame:
    """``df`` with new columns made from Arrow batches of ``rows`` rows at most.

    ``make()`` is called once for each task and gives the function of a batch. A new column takes the
    place of one of the same name. Unless it ``caches``, what other operators left in a worker is dropped.
    """
    new = [f.name for f in fields]
    kept = [c for c in df.columns if c not in new]
    df = df.select(*[F.col(f"`{c}`") for c in kept]) if len(kept) < len(df.columns) else df
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not caches:
            drop_caches()
        of_batch = make()
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                arrays = [*batch.columns, *of_batch(pa.Table.from_batches([batch]))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *new])
        whole = batch = arrays = of_batch = None
        give_back()

    return df.mapInArrow(run, schema)


def texts(table: pa.Table, column: str) -> list[str]:
    return [t or "" for t in table.column(column).to_pylist()]
