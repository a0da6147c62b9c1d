import hashlib

import numpy as np
import pytest
from jointflow.llm import sharding
from tables import documents, frame

SHARDS = [f"s{i}" for i in range(12)]


def test_shares_are_even_and_follow_weights():
    counts = np.bincount(sharding.fill(SHARDS, slots=10_007))
    assert counts.max() - counts.min() <= 1
    counts = np.bincount(sharding.fill(SHARDS, [1] * 11 + [3], slots=10_007))
    assert abs(counts[11] / counts[:11].mean() - 3) < 0.02


def test_few_slots_move():
    before = np.array(SHARDS)[sharding.fill(SHARDS, slots=10_007)]
    fewer = [s for s in SHARDS if s != "s5"]
    after = np.array(fewer)[sharding.fill(fewer, slots=10_007)]
    moved = (before != after) & (before != "s5")
    assert moved.mean() < 0.15
    # The order of the list doesn't matter.
    assert (np.array(SHARDS[::-1])[sharding.fill(SHARDS[::-1], slots=10_007)] == before).all()


def test_fill_takes_turns():
    """Against turns played out slot by slot."""
    names, slots = ["b", "a", "c"], 11
    order = sorted(names)
    preference = {
        n: [(sharding._number(n, "offset") % slots + j * (sharding._number(n, "skip") % (slots - 1) + 1)) % slots for j in range(slots)]
        for n in names
    }
    assert all(sorted(p) == list(range(slots)) for p in preference.values())
    owner = {}
    while len(owner) < slots:
        for n in order:
            free = next((s for s in preference[n] if s not in owner), None)
            if free is not None:
                owner[free] = n
    assert [names[i] for i in sharding.fill(names, slots=slots)] == [owner[s] for s in range(slots)]


@pytest.mark.parametrize("shards,slots", [([], 11), (["a", "a"], 11), (["a"], 12), (["a", "b", "c"], 2)])
def test_wrong_settings(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots=slots)


def test_place(spark, tmp_path):
    rows = documents(200)
    df = frame(spark, rows).selectExpr("*", "1 AS slot", "'x' AS shard")
    placed = sharding.place(df, "doc_id", SHARDS, slots=10_007)
    owner = sharding.fill(SHARDS, slots=10_007)
    got = placed.collect()
    assert len(got) == len(rows)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 10_007
        assert (r.slot, r.shard) == (slot, SHARDS[owner[slot]])
    sharding.write_shards(placed, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows)
    assert {p.name for p in tmp_path.glob("out/shard=*")} == {f"shard={r.shard}" for r in got}
    assert sharding.place(df.limit(0), "doc_id", SHARDS).count() == 0
