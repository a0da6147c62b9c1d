"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table whose size is a prime; the shards take turns, each claiming
the next free slot of its own permutation, until the table is full. So all shards own nearly the same number of
slots (in proportion to their weights), and when a shard comes or goes few slots change hands. A row's slot
is its key's hash modulo the table size, its shard is that slot's owner. The table has one small row per slot, a
number fixed by ``SLOTS`` and not by the data, and is broadcast: a row is placed in constant time without a shuffle.

A null key has a slot like any other key, rows with equal keys share a shard, an empty table gives an empty table, and
columns named ``slot`` or ``shard`` are replaced. Keys are hashed as text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, some hundred times the number of shards: shares differ by less than one in a hundred.
SLOTS = 65_537


def _number(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{text}".encode()).digest()[:8], "little")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], weights: list[int] | None = None, slots: int = SLOTS) -> np.ndarray:
    """The owner (index of its name) of every slot. A shard of weight w claims w slots at each of its turns.

    Turns are taken in the order of the names, so the table does not depend on the order in which shards are listed.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, no smaller than the number of shards")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("weights are whole numbers from 1, one for each shard")
    turns = sorted(range(len(shards)), key=shards.__getitem__)
    offset = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % max(1, slots - 1) + 1 for s in shards]
    step = [0] * len(shards)
    owner = np.full(slots, -1, np.int32)
    free = slots
    while free:
        for s in turns:
            for _ in range(weights[s]):
                if not free:
                    break
                while owner[at := (offset[s] + step[s] * skip[s]) % slots] >= 0:
                    step[s] += 1
                owner[at] = s
                step[s] += 1
                free -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 60 bits of the key's MD5 as text, modulo the number of slots; null as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: list[str], weights: list[int] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``."""
    owner = fill(shards, weights, slots)
    spark = df.sparkSession
    names = np.array(shards, dtype=object)[owner]
    table = spark.createDataFrame(pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": names}), "slot int, shard string")
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot")


def write_shards(df: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write placed rows as one folder per shard. The hash of whole rows spreads a shard, and a hot key, over several writers."""
    part = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map" not in kind]), F.lit(files_per_shard))
    df.repartition("shard", part).write.partitionBy("shard").parquet(path)
