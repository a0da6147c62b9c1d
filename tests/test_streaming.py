import numpy as np
import pandas as pd
import pytest
from helpers import ANGLES, angle_machine, count_rows, leg, person, random_rows, same
from jointflow.config import DEFAULT_CONFIG, Registry
from jointflow.operators import exercise as ex
from jointflow.schema import EXERCISE_STATE, PERSON
from jointflow.sources import detections as io
from jointflow.streaming.exercise import _RepCounter, advance, stream_exercise_states

LIMITS = [(90, 160), (90, 90), (160, 90), (120, 60)]


@pytest.mark.parametrize("down,up", LIMITS)
def test_advance_in_pieces_matches_the_walk(down, up):
    rows = sorted(random_rows(int(down), tracks=1, longest=400), key=lambda r: r[1])
    wanted = count_rows(rows, down, up)
    state = (False, 0, 0.0)
    for at in range(0, len(rows), 13):
        piece = rows[at : at + 13]
        seen = np.array([r[4] is not None for r in piece])
        angle = np.array([np.nan if r[4] is None else r[4] for r in piece])
        on, reps, held = advance(angle, seen, down, up, *state)
        for r, d, n, a in zip(piece, on, reps, held):
            want = wanted[r[:3]]
            assert (n, "down" if d else "up") == want[:2] and same(float(a), want[2])
        state = (bool(on[-1]), int(reps[-1]), float(held[-1]))


@pytest.mark.parametrize("down,up", LIMITS)
def test_advance_over_tracks_at_once(down, up):
    rows = sorted(random_rows(int(down), tracks=6, longest=60), key=lambda r: (r[0], r[2], r[1]))
    wanted = count_rows(rows, down, up)
    seen = np.array([r[4] is not None for r in rows])
    angle = np.array([np.nan if r[4] is None else r[4] for r in rows])
    tracks = [(r[0], r[2]) for r in rows]
    starts = np.array([tracks.index(t) for t in tracks])
    on, reps, held = advance(angle, seen, down, up, np.zeros(len(rows), bool), np.zeros(len(rows), int), np.zeros(len(rows)), starts)
    for r, d, n, a in zip(rows, on, reps, held):
        want = wanted[r[:3]]
        assert (n, "down" if d else "up") == want[:2] and same(float(a), want[2])


class _Map(dict):
    """A state map that lives in the test."""

    getValue, updateValue = dict.get, dict.__setitem__


@pytest.mark.parametrize("disorder", [0, 3])
def test_one_call_counts_all_tracks_of_a_group(disorder):
    class Handle:
        def getMapState(self, *_):
            return _Map()

    def calls(rows):
        return pd.concat(counter.handleInputRows((0,), iter([pd.DataFrame(rows, columns=names)]), None), ignore_index=True)

    names = ["video_id", "frame_idx", "det_idx", "track_id", "angle0", "seen0"]
    counter = _RepCounter([(0, 90.0, 160.0)], None, disorder)
    counter.init(Handle())
    made = calls([("v", f, 0, t, 40.0 if f % 2 else 170.0, True) for t in range(300) for f in range(10)])
    made = pd.concat([made, calls([("v", f, 0, t, 40.0 if f % 2 else 170.0, True) for t in range(300) for f in range(9, 14)])])
    counted = made[~made["late"]]
    due = 14 - disorder
    assert len(counted) == 300 * due and made["late"].sum() == 300
    assert (counted["rep_count"] == counted["frame_idx"] // 2).all() and len(counter.state) == 300


class _Pages:
    """A state map that counts how often it is read or written."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value


def _group(counter, rows, now=0):
    class Timer:
        def getCurrentProcessingTimeInMs(self):
            return now

    names = ["video_id", "frame_idx", "det_idx", "track_id", "angle0", "seen0"]
    return pd.concat(counter.handleInputRows((0,), iter([pd.DataFrame(rows, columns=names)]), Timer()), ignore_index=True)


@pytest.mark.parametrize("disorder", [0, 3])
def test_state_is_read_by_pages_and_not_by_tracks(disorder):
    maps = []

    class Handle:
        def getMapState(self, *_):
            maps.append(_Pages())
            return maps[-1]

    counter = _RepCounter([(0, 90.0, 160.0)], None, disorder)
    counter.init(Handle())
    for begin in (0, 10):
        _group(counter, [("v", f, 0, t, 40.0 if f % 2 else 170.0, True) for t in range(500) for f in range(begin, begin + 10)])
    assert sum(m.calls for m in maps) <= 40


def test_tracks_of_a_page_expire_apart():
    class Handle:
        def getMapState(self, *_):
            return _Pages()

    counter = _RepCounter([(0, 90.0, 160.0)], 1000, 0)
    counter.init(Handle())
    _group(counter, [("v", 0, 0, 4, 40.0, True), ("v", 0, 0, 8, 40.0, True)], now=0)
    _group(counter, [("v", 1, 0, 8, 40.0, True)], now=900)
    made = _group(counter, [("v", 2, 0, 4, 170.0, True), ("v", 2, 0, 8, 170.0, True)], now=1500)
    assert made.set_index("track_id")["rep_count"].to_dict() == {4: 0, 8: 1}


def test_a_stateful_step_has_a_task_for_each_core(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame(random_rows(3, tracks=3, longest=9), ANGLES).write.parquet(folder)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        source = io.stream_detections(spark, folder, schema=ANGLES)
        query = io.stream_states(stream_exercise_states(source, CONFIG, registry()), str(tmp_path / "out"), str(tmp_path / "c"))
        assert query.awaitTermination(300) and spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {p["stateOperators"][0]["numShufflePartitions"] for p in query.recentProgress if p["stateOperators"]} == {8}


def own(name, ordinal, settings):
    return angle_machine(settings["down"], settings["up"], name, ordinal)


CONFIG = {f"e{i}": {"enabled": True, "down": d, "up": u} for i, (d, u) in enumerate(LIMITS[::2])}


def registry():
    result = Registry()
    for name in CONFIG:
        result.register(name, builder=own)
    return result


def run(spark, folder, out, checkpoint, sink=io.stream_states):
    source = io.stream_detections(spark, folder, max_files=100, schema=ANGLES)
    query = sink(stream_exercise_states(source, CONFIG, registry()), out, checkpoint)
    query.awaitTermination(300)
    assert query.exception() is None


def test_stream_equals_batch_and_skips_what_came_too_late(spark, tmp_path):
    rows = random_rows(21, tracks=8, longest=60)
    folder, out, latest = (str(tmp_path / n) for n in ("in", "out", "latest"))
    df = spark.createDataFrame(rows, ANGLES)
    for low, high in ((-1000, 40), (40, 90), (90, 10**6)):
        df.filter(f"frame_idx >= {low} AND frame_idx < {high}").repartition(3).write.mode("append").parquet(folder)
        if low == 90:
            # Rows that were there before, and one older than its track's state.
            df.filter("frame_idx < 40").write.mode("append").parquet(folder)
        run(spark, folder, out, str(tmp_path / "c1"))
    run(spark, folder, latest, str(tmp_path / "c2"), io.stream_latest)
    got = spark.read.schema(EXERCISE_STATE).parquet(out).collect()
    assert len(got) == len(rows) * len(CONFIG)
    for name, settings in CONFIG.items():
        wanted = count_rows(rows, settings["down"], settings["up"])
        for r in got:
            if r.exercise == name:
                want = wanted[r.video_id, r.frame_idx, r.det_idx]
                assert all(map(same, (r.rep_count, r.phase, r.angle, r.feedback), want)), (r, want)
    machines = registry().machines(CONFIG)
    final = ex.final_states(df, machines)
    newest = io.read_latest(spark, latest).select(*final.columns)
    assert newest.exceptAll(final).isEmpty() and final.exceptAll(newest).isEmpty()


def test_state_with_a_time_to_live(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    people = [{"frame_idx": f, "points": leg("left", a)} for f, a in enumerate((30, 170, 30, 175))]
    person(spark, people).write.parquet(folder)
    source = io.stream_detections(spark, folder, schema=PERSON)
    states = stream_exercise_states(source, DEFAULT_CONFIG, ttl_ms=3_600_000)
    query = (
        states.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(once=True)
        .start()
    )
    assert query.awaitTermination(120)
    rows = spark.read.parquet(out).orderBy("frame_idx").collect()
    assert [r.rep_count for r in rows] == [0, 1, 1, 2]


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    rows = random_rows(5, tracks=6, longest=60)
    folder, out, late, checkpoint = (str(tmp_path / n) for n in ("in", "out", "late", "c"))
    df = spark.createDataFrame(rows, ANGLES)
    counted = 0
    for part in ("frame_idx % 2 = 0", "frame_idx % 2 <> 0"):  # the wrong order
        df.filter(part).coalesce(1).write.mode("append").parquet(folder)
        source = io.stream_detections(spark, folder, max_files=1, schema=ANGLES)
        states = stream_exercise_states(source, CONFIG, registry(), with_late=True)
        query = io.stream_states(states, out, checkpoint, late_path=late)
        assert query.awaitTermination(300)
        counted += sum(p["observedMetrics"]["late_rows"]["n"] for p in query.recentProgress if p["observedMetrics"])
    key = ["video_id", "frame_idx", "det_idx", "track_id"]
    kept = spark.read.parquet(out).select(*key).distinct()
    rest = spark.read.parquet(late).select(*key)
    assert rest.count() == counted > 0 and kept.count() + counted == len(rows)
    assert kept.unionByName(rest).exceptAll(df.select(*key)).isEmpty()
    # What was counted is as a batch over those rows alone.
    wanted = {tuple(r) for r in kept.collect()}
    own_rows = [r for r in rows if (r[0], r[1], r[2], r[3]) in wanted]
    for name, settings in CONFIG.items():
        walked = count_rows(own_rows, settings["down"], settings["up"])
        for r in spark.read.parquet(out).where(f"exercise = '{name}'").collect():
            assert (r.rep_count, r.phase) == walked[r.video_id, r.frame_idx, r.det_idx][:2]


def test_a_state_expires_and_the_track_starts_over(spark, tmp_path):
    import time

    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    for start, angles in ((0, (30, 170, 30)), (10, (175, 30, 170))):
        people = [{"frame_idx": start + f, "points": leg("left", a)} for f, a in enumerate(angles)]
        person(spark, people).write.mode("append").parquet(folder)
        states = stream_exercise_states(io.stream_detections(spark, folder, schema=PERSON), DEFAULT_CONFIG, ttl_ms=1_000)
        writer = states.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        assert writer.trigger(once=True).start().awaitTermination(120)
        time.sleep(3)
    rows = spark.read.parquet(out).orderBy("frame_idx").collect()
    # With the state kept, frame 10 would end a repetition that began at frame 2.
    assert [(r.frame_idx, r.rep_count) for r in rows] == [(0, 0), (1, 1), (2, 1), (10, 0), (11, 0), (12, 1)]


def hands(df, settings):
    up = "IF(a > 100, 'up', 'down')"
    return df.selectExpr("video_id", "frame_idx", "det_idx", "track_id", "0 AS rep_count", f"{up} AS phase", "0D AS angle", "'' AS feedback")


def test_custom_transforms_run_in_a_stream(spark, tmp_path):
    rows = random_rows(9, tracks=5, longest=40)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, ANGLES)
    df.write.parquet(folder)
    for config in (CONFIG | {"hands": {"enabled": True}}, {"hands": {"enabled": True}}):
        known = registry().register("hands", transform=hands)
        states = stream_exercise_states(io.stream_detections(spark, folder, schema=ANGLES), config, known, with_late=True)
        place = f"{out}{len(config)}"
        assert io.stream_states(states, place, f"{place}-c", late_path=f"{place}-late").awaitTermination(300)
        got = io.read_table(spark, place, EXERCISE_STATE)
        wanted = ex.exercise_states(df, config, known)
        assert got.count() == len(rows) * len(config)
        assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


def test_a_transform_over_rows_is_refused_on_a_stream(spark, tmp_path):
    from pyspark.errors import AnalysisException
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    folder = str(tmp_path / "in")
    spark.createDataFrame([], ANGLES).write.parquet(folder)
    over = Window.partitionBy("track_id").orderBy("frame_idx")
    known = Registry().register("hands", transform=lambda df, s: hands(df, s).withColumn("rep_count", F.row_number().over(over)))
    states = stream_exercise_states(io.stream_detections(spark, folder, schema=ANGLES), {"hands": {"enabled": True}}, known)
    with pytest.raises(AnalysisException):
        io.stream_states(states, str(tmp_path / "out"), str(tmp_path / "c"))
