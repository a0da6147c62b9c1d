import pytest
from helpers import ANGLES, NAN, angle_machine, count_rows, leg, person, random_rows, same
from jointflow.config import DEFAULT_CONFIG, Registry, active_exercises, config_df, registry_df
from jointflow.operators import exercise as ex
from jointflow.schema import EXERCISE_STATE
from pyspark.sql import functions as F

LIMITS = [(90, 160), (90, 90), (160, 90), (120, 60), (0, 180)]


def check(states, rows, down, up, exercise="squat"):
    wanted = count_rows(rows, down, up)
    got = ex.state_rows(states).filter(F.col("exercise") == exercise).collect()
    assert len(got) == len(rows)
    for r in got:
        want = wanted[r.video_id, r.frame_idx, r.det_idx]
        have = (r.rep_count, r.phase, r.angle, r.feedback)
        assert all(map(same, have, want)), (r, want)


@pytest.mark.parametrize("chunk", [None, 7, 100, "auto"])
def test_states_match_the_walk(spark, chunk, monkeypatch):
    monkeypatch.setattr(ex, "CHUNK_ROWS", 20)
    rows = random_rows(chunk or 1)
    df = spark.createDataFrame(rows, ANGLES)
    machines = [angle_machine(d, u, f"e{i}", i) for i, (d, u) in enumerate(LIMITS)]
    states = ex.track_states(df, machines, chunk).cache()
    for i, (down, up) in enumerate(LIMITS):
        check(states, rows, down, up, f"e{i}")
    states.unpersist()


def test_only_flips(spark):
    """Thresholds the wrong way round, every angle satisfying both tests."""
    rows = [("v", f, 0, 1, 100.0) for f in range(50)]
    states = ex.track_states(spark.createDataFrame(rows, ANGLES), [angle_machine(160, 90)], 7)
    check(states, rows, 160, 90)


def test_exact_limits_change_nothing_and_first_row_may_go_down(spark):
    rows = [("v", f, 0, 1, a) for f, a in enumerate([90.0, 160.0, 89.0, 160.0, 160.5, NAN, None, 10.0])]
    states = ex.track_states(spark.createDataFrame(rows, ANGLES), [angle_machine(90, 160)], 3)
    check(states, rows, 90, 160)
    got = {r.frame_idx: r for r in ex.state_rows(states).collect()}
    assert [got[f].phase for f in range(8)] == ["up", "up", "down", "down", "up", "up", "up", "down"]
    assert [got[f].rep_count for f in range(8)] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert got[4].feedback == got[7].feedback == "✅ Rep 1"


def test_rows_without_keypoints_keep_the_start_state(spark):
    df = person(spark, [{"points": None}, {"frame_idx": 1, "points": leg("right", 30)}])
    rows = ex.exercise_states(df, DEFAULT_CONFIG).orderBy("frame_idx").collect()
    assert rows[0][5:] == (0, "up", 0.0, "")
    assert rows[1].phase == "down" and rows[1].angle == pytest.approx(30, abs=0.01)


@pytest.mark.parametrize("broadcast", [0, 100])
def test_one_track_with_most_rows(spark, monkeypatch, broadcast):
    """A long track is cut into chunks that spread over tasks, short ones are not; nothing is lost."""
    monkeypatch.setattr(ex, "CHUNK_ROWS", 500)
    monkeypatch.setattr(ex, "BROADCAST_TRACKS", broadcast)
    long = [("v", f, 0, 7, (f * 37 % 181) * 1.0) for f in range(6000)]
    rows = long + [("v", f, t, t, (f * 53 % 181) * 1.0) for t in range(10, 20) for f in range(50)]
    df = spark.createDataFrame(rows, ANGLES).repartition(4)
    machines = [angle_machine(90, 160)]
    check(ex.track_states(df, machines), rows, 90, 160)
    cut = ex._cutter(df, "auto")(df).groupBy("track_id", "_chunk").count().collect()
    assert len(cut) == 12 + 10 and max(r["count"] for r in cut) == 500
    last = {r[3]: count_rows(rows, 90, 160)[r[:3]] for r in sorted(rows, key=lambda r: r[1])}
    for r in ex.final_states(df, machines).collect():
        assert (r.rep_count, r.phase, r.angle, r.feedback) == last[r.track_id]


def test_untracked_rows_have_no_state(spark):
    rows = [("v", 0, 0, None, 10.0), ("v", 1, 0, 1, 10.0)]
    df = spark.createDataFrame(rows, ANGLES)
    for chunk in (None, 10, "auto"):
        assert ex.track_states(df, [angle_machine(90, 160)], chunk).count() == 1


@pytest.mark.parametrize("cut", [None, 20, "auto"])
def test_final_states_are_the_last_rows(spark, cut, monkeypatch):
    monkeypatch.setattr(ex, "CHUNK_ROWS", 30)
    rows = random_rows(5)
    df = spark.createDataFrame(rows, ANGLES)
    machines = [angle_machine(d, u, f"e{i}", i) for i, (d, u) in enumerate(LIMITS)]
    final = ex.final_states(df, machines, cut).cache()
    states = ex.state_rows(ex.track_states(df, machines, None)).select(*EXERCISE_STATE.fieldNames())
    last = ex.latest_states(states).select(*final.columns)
    assert final.exceptAll(last).isEmpty() and last.exceptAll(final).isEmpty()
    assert final.count() == len({(r[0], r[3]) for r in rows}) * len(LIMITS)


def test_partitioning_does_not_matter(spark):
    rows = random_rows(9)
    df = spark.createDataFrame(rows, ANGLES)
    machines = [angle_machine(90, 160)]
    one = ex.state_rows(ex.track_states(df.repartition(1), machines, 30))
    many = ex.state_rows(ex.track_states(df.repartition(13), machines, 30))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_kept_columns_come_along(spark):
    df = person(spark, [{"frame_idx": f, "points": leg("left", a)} for f, a in enumerate((30, 170, 30))])
    states = ex.track_states(df, Registry().machines(DEFAULT_CONFIG), keep=("bbox", "conf"))
    rows = states.orderBy("frame_idx").collect()
    assert [r.states[0].rep_count for r in rows] == [0, 1, 1]
    assert [r.states[0].completed for r in rows] == [False, True, False]
    assert all(r.bbox.x2 == 10.0 and r.conf == 0.9 for r in rows)


def test_attach_gives_the_start_state_where_none_is(spark):
    df = person(spark, [{"frame_idx": f} for f in range(3)])
    states = ex.exercise_states(df.filter("frame_idx = 1"), DEFAULT_CONFIG)
    states = states.withColumn("rep_count", F.lit(4).cast("long"))
    rows = ex.attach_states(df, states, "squat").orderBy("frame_idx").collect()
    assert [r.rep_count for r in rows] == [0, 4, 0]
    assert [(r.phase, r.angle, r.feedback) for r in rows] == [("up", 0.0, "")] * 3


CONFIG = {
    "lunge": {"enabled": True, "down_threshold": 80, "up_threshold": 150, "min_confidence": 0.4},
    "squat": DEFAULT_CONFIG["squat"],
    "off": {"enabled": False},
    "plain": {"down_threshold": 1, "up_threshold": 2, "min_confidence": 0.1},
    "nobody": {**DEFAULT_CONFIG["squat"]},
}


def test_active_exercises(spark):
    registry = Registry().register("lunge").register("off").register("plain")
    assert [(i, n) for i, n, _ in registry.active(CONFIG)] == [(0, "lunge"), (1, "squat")]
    table = active_exercises(config_df(spark, CONFIG), registry_df(spark, registry))
    assert [(r.ordinal, r.name) for r in table.orderBy("ordinal").collect()] == [(0, "lunge"), (1, "squat")]
    assert [r.enabled for r in config_df(spark, CONFIG).orderBy("ord").collect()] == [True, True, False, False, True]


def test_missing_threshold_is_an_error_only_when_active(spark):
    broken = {"squat": {"enabled": True, "up_threshold": 160, "min_confidence": 0.5}}
    with pytest.raises(KeyError):
        Registry().machines(broken)
    with pytest.raises(KeyError):
        config_df(spark, broken)
    assert Registry().machines({"squat": {"enabled": False}}) == []


def test_registering_again_replaces(spark):
    def constant(persons, settings):
        return persons.select(
            "video_id", "frame_idx", "det_idx", "track_id",
            F.lit(settings["count"]).alias("rep_count"), F.lit("up").alias("phase"),
            F.lit(1).alias("angle"), F.lit("hi").alias("feedback"),
        )

    df = person(spark, [{"points": leg("left", 30)}])
    config = {"squat": {**DEFAULT_CONFIG["squat"], "count": 3}}
    own = Registry().register("squat", transform=constant)
    row = ex.exercise_states(df, config, own).first()
    assert (row.exercise, row.rep_count, row.angle, row.feedback) == ("squat", 3, 1.0, "hi")
    again = own.register("squat")
    assert ex.exercise_states(df, config, again).first().phase == "down"
    assert ex.exercise_states(df, {}, own).count() == 0


def test_map_and_person_exercises(spark):
    registry = Registry().register("lunge")
    df = person(spark, [{"points": leg("left", 85)}])
    machines = registry.machines(CONFIG)
    row = ex.exercise_map(ex.track_states(df, machines)).first()
    assert row.exercise_names == ["lunge", "squat"]
    assert (row.exercises["lunge"].phase, row.exercises["squat"].phase) == ("up", "down")
    pairs = ex.person_exercises(df, machines).select("ordinal", "exercise").collect()
    assert sorted(map(tuple, pairs)) == [(0, "lunge"), (1, "squat")]


def test_plan_shuffles_rows_once(spark, tmp_path):
    """Both passes of a cut scan read one shuffle; a whole scan has one, also for last states."""
    df = person(spark, [{"frame_idx": f, "points": leg("left", f)} for f in range(50)])
    df.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    states = ex.state_rows(ex.track_states(stored, Registry().machines(DEFAULT_CONFIG), 10))
    states.collect()
    plan = states._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1
    assert plan.count("ReusedExchange") == 1
    assert "bbox" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    whole = ex.state_rows(ex.track_states(stored, Registry().machines(DEFAULT_CONFIG)))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    final = ex.final_states(stored, Registry().machines(DEFAULT_CONFIG))
    plan = final._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_a_gap_in_the_frame_numbers_leaves_chunks_even(spark, monkeypatch):
    monkeypatch.setattr(ex, "CHUNK_ROWS", 100)
    rows = [("v", f if f < 999 else 10**9, 0, 7, (f * 37 % 181) * 1.0) for f in range(1000)]
    df = spark.createDataFrame(rows, ANGLES).repartition(3)
    sizes = [r["count"] for r in ex._cutter(df, "auto")(df).groupBy("_chunk").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 120
    check(ex.track_states(df, [angle_machine(90, 160)]), rows, 90, 160)
