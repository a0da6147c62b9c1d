import pytest
from helpers import ANGLES, angle_machine, count_rows, random_rows, same
from jointflow.config import Registry
from jointflow.operators.exercise import tracked_angles
from jointflow.schema import EXERCISE_STATE
from jointflow.sources import detections as io
from jointflow.sources import versions
from jointflow.streaming.chunked import advance_tracks, count_stream, state_schema

LIMITS = {"squat": (90, 160), "flips": (160, 90)}
CONFIG = {name: {"enabled": True, "down": d, "up": u} for name, (d, u) in LIMITS.items()}


def registry():
    result = Registry()
    for name in CONFIG:
        result.register(name, builder=lambda n, i, s: angle_machine(s["down"], s["up"], n, i))
    return result


def check(got, rows):
    assert len(got) == len(rows) * len(CONFIG)
    for name, limits in LIMITS.items():
        wanted = count_rows(rows, *limits)
        for r in got:
            if r.exercise == name:
                want = wanted[r.video_id, r.frame_idx, r.det_idx]
                assert all(map(same, (r.rep_count, r.phase, r.angle, r.feedback), want)), (name, r, want)


def feed(spark, df, folder, out, checkpoint, bounds, cut):
    for low, high in bounds:
        df.filter(f"frame_idx >= {low} AND frame_idx < {high}").repartition(3).write.mode("append").parquet(folder)
        source = io.stream_detections(spark, folder, schema=ANGLES)
        query = count_stream(source, CONFIG, out, checkpoint, registry(), cut)
        assert query.awaitTermination(300) and query.exception() is None


@pytest.mark.parametrize("cut", [11, "auto"])
def test_chunks_of_micro_batches_equal_the_walk(spark, tmp_path, cut, monkeypatch):
    if cut == "auto":
        monkeypatch.setattr("jointflow.operators.exercise.CHUNK_ROWS", 10)
    monkeypatch.setattr(versions, "EVERY", 2)
    rows = random_rows(31, tracks=6, longest=80)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    bounds = [(-1000, 30), (30, 60), (60, 100), (100, 10**6)]
    df = spark.createDataFrame(rows, ANGLES)
    feed(spark, df, folder, out, checkpoint, bounds, cut)
    check(spark.read.schema(EXERCISE_STATE).parquet(f"{out}/states").collect(), rows)
    # Versions before the last whole one are gone, and the newest has every track.
    kept = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out/tracks").iterdir())
    assert kept == [2, 3]
    table = versions.Versions(f"{out}/tracks", ("video_id", "track_id"), ("last_frame", "last_det"), state_schema(registry().machines(CONFIG)))
    last = {(r.video_id, r.track_id): (r.last_frame, r.last_det) for r in table.read_newest(spark).collect()}
    assert last == {(v, t): max((r[1], r[2]) for r in rows if (r[0], r[3]) == (v, t)) for v, t in {(r[0], r[3]) for r in rows}}


def test_late_and_repeated_rows_and_rows_without_a_key(spark, tmp_path):
    rows = random_rows(32, tracks=4, longest=60)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    df = spark.createDataFrame(rows, ANGLES)
    odd = [("v0", None, 0, 0, 10.0), ("v0", 1, None, 0, 10.0), (None, 1, 1, 0, 10.0), ("v0", 1, 1, None, 10.0)]
    both = df.unionByName(df.filter("frame_idx < 20")).unionByName(spark.createDataFrame(odd, ANGLES))
    both.write.parquet(folder)
    query = count_stream(io.stream_detections(spark, folder, schema=ANGLES), CONFIG, out, checkpoint, registry(), 7)
    assert query.awaitTermination(300) and query.exception() is None
    df.filter("frame_idx < 40").write.mode("append").parquet(folder)
    query = count_stream(io.stream_detections(spark, folder, schema=ANGLES), CONFIG, out, checkpoint, registry(), 7)
    assert query.awaitTermination(300) and query.exception() is None
    check(spark.read.schema(EXERCISE_STATE).parquet(f"{out}/states").collect(), rows)
    late = spark.read.parquet(f"{out}/late").count()
    assert late == sum(r[1] < 20 for r in rows) + sum(r[1] < 40 for r in rows)


def test_one_track_spreads_and_needs_no_python(spark, tmp_path):
    rows = [("v", f, 0, 1, float(f * 37 % 180)) for f in range(5000)]
    machines = registry().machines(CONFIG)
    narrow = tracked_angles(spark.createDataFrame(rows, ANGLES), machines, ())
    narrow.write.parquet(str(tmp_path / "rows"))
    narrow = spark.read.parquet(str(tmp_path / "rows"))
    none = spark.createDataFrame([], state_schema(machines))
    states, late, after, chunks = advance_tracks(narrow, none, machines, 250)
    check(states.collect(), rows)
    assert late.isEmpty() and after.count() == 1 and chunks.count() == 20
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "_chunk" in plan


def test_what_cannot_be_counted_is_refused(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], ANGLES).write.parquet(folder)
    source = io.stream_detections(spark, folder, schema=ANGLES)
    with pytest.raises(ValueError, match="no active"):
        count_stream(source, {}, folder, folder)
    own = Registry().register("hands", transform=lambda df, s: df)
    with pytest.raises(ValueError, match="hands"):
        count_stream(source, {"hands": {"enabled": True}}, folder, folder, own)
