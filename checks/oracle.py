"""SQL each query is compared to: the views of FIXTURES.md and step-by-step state machines.

The state SQL walks each track row by row with a recursive CTE; it shares nothing with the window
formulation under test.
"""

from __future__ import annotations

POINTS = range(17)

# Fixed values, written out here so that a slip in the package shows: joints by number, and skeleton lines.
COCO_JOINTS = {
    name: i
    for i, name in enumerate(
        "nose left_eye right_eye left_ear right_ear left_shoulder right_shoulder left_elbow right_elbow "
        "left_wrist right_wrist left_hip right_hip left_knee right_knee left_ankle right_ankle".split()
    )
}
SKELETON = ((5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16))


def h(k: int, prime: int) -> str:
    r = f"(event_id % {prime})"
    return f"(({r}*{r}*{37 * k + 11} + {r}*{101 * k + 7} + {7919 * k + 13}) % {prime})"


BOX = {
    "x1": f"cast({h(1, 10007)} % 120 as double)",
    "y1": f"cast({h(2, 10009)} % 90 as double)",
    "x2": f"cast({h(1, 10007)} % 120 + 60 + {h(5, 10037)} % 100 as double)",
    "y2": f"cast({h(2, 10009)} % 90 + 80 + {h(6, 10039)} % 120 as double)",
}


def _score(k: int) -> str:
    return f"cast(300 + {h(k + 80, 10037)} % 700 as double) / cast(1000 as double)"


def _points() -> str:
    parts = []
    for k in POINTS:
        for name, sql in (
            ("px", f"cast({h(k, 10007)} % 640 as double)"),
            ("py", f"cast({h(k + 40, 10009)} % 480 as double)"),
            ("ps", _score(k)),
        ):
            parts.append(f"CASE WHEN event_type <> 'error' THEN {sql} END AS {name}{k}")
    return ", ".join(parts)


_BODY = (
    f"ts, user_id AS track_id, event_id, event_type <> 'error' AS has_points, {_score(3)} AS conf, "
    + ", ".join(f"{sql} AS {c}" for c, sql in BOX.items())
    + ", "
    + _points()
)

#: One tracked person per event.
PERSON = (
    "person AS (SELECT 'v' || cast(user_id % 4 as varchar) AS video_id, event_id AS frame_idx, "
    f"cast(0 as integer) AS det_idx, {_BODY} FROM events)"
)

_FRAME = "cast(floor(event_id / 8.0) as bigint)"

#: Eight detections per frame.
BOXES = (
    f"boxes AS (SELECT 'v' || cast({_FRAME} % 4 as varchar) AS video_id, {_FRAME} AS frame_idx, "
    f"cast(event_id % 8 as integer) AS det_idx, {_BODY} FROM events)"
)

#: Person rows of the array-form table: position among the frame's detections, untracked frames left out.
PARSED = (
    "parsed AS (SELECT * REPLACE (cast(row_number() OVER "
    "(PARTITION BY video_id, frame_idx ORDER BY det_idx) - 1 as integer) AS det_idx) "
    "FROM boxes WHERE frame_idx % 10 <> 0)"
)


def index(side: str, joint: str) -> int:
    return COCO_JOINTS[f"{side}_{joint}"]


def gate(side: str, joints, least: float = 0.5) -> str:
    return "(" + " AND ".join(f"coalesce(ps{index(side, j)} >= {least}, false)" for j in joints) + ")"


def side_angle(side: str, joints) -> str:
    a, b, c = (index(side, j) for j in joints)
    ux, uy, vx, vy = f"(px{a}-px{b})", f"(py{a}-py{b})", f"(px{c}-px{b})", f"(py{c}-py{b})"
    cos = (
        f"({ux}*{vx}+{uy}*{vy})/(sqrt({ux}*{ux}+{uy}*{uy})*sqrt({vx}*{vx}+{vy}*{vy})+1e-6)"
    )
    return f"degrees(acos(least(1.0, greatest(-1.0, {cos}))))"


LEG = ("hip", "knee", "ankle")
ARM = ("shoulder", "elbow", "wrist")


def angle(joints) -> str:
    return (
        f"CASE WHEN {gate('left', joints)} THEN {side_angle('left', joints)} "
        f"WHEN {gate('right', joints)} THEN {side_angle('right', joints)} END"
    )


def both_knees() -> str:
    return (
        f"CASE WHEN {gate('left', LEG)} AND {gate('right', LEG)} "
        f"THEN ({side_angle('left', LEG)} + {side_angle('right', LEG)}) / 2.0 END"
    )


def machine(name: str, source: str, angle_sql: str, down: float, up: float) -> str:
    """CTEs ``<name>_seq`` and ``<name>``: the counter's state on every row of ``source``."""
    key = "video_id, track_id, frame_idx, det_idx, rn"
    rep = f"coalesce(q.a > {up} AND s.phase = 'down', false)"
    down_now = f"coalesce(q.a < {down} AND s.phase = 'up', false)"
    return f"""
{name}_seq AS MATERIALIZED (SELECT video_id, track_id, frame_idx, det_idx, {angle_sql} AS a,
  row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, det_idx) AS rn FROM {source}),
{name}_run AS (
  SELECT video_id, track_id, cast(-1 as bigint) AS frame_idx, cast(-1 as integer) AS det_idx,
    cast(0 as bigint) AS rn, cast(0 as bigint) AS rep_count, 'up' AS phase,
    cast(0.0 as double) AS angle, '' AS feedback, false AS completed
  FROM {name}_seq WHERE rn = 1
  UNION ALL
  SELECT q.video_id, q.track_id, q.frame_idx, q.det_idx, q.rn,
    s.rep_count + CASE WHEN {rep} THEN 1 ELSE 0 END,
    CASE WHEN {down_now} THEN 'down' WHEN {rep} THEN 'up' ELSE s.phase END,
    coalesce(q.a, s.angle),
    CASE WHEN {rep} THEN '✅ Rep ' || cast(s.rep_count + 1 as varchar) ELSE s.feedback END,
    {rep}
  FROM {name}_run s JOIN {name}_seq q
    ON q.video_id = s.video_id AND q.track_id = s.track_id AND q.rn = s.rn + 1),
{name} AS (SELECT {key}, rep_count, phase, round(angle, 4) AS angle, angle AS exact, feedback, completed
  FROM {name}_run WHERE rn > 0)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


SQUAT = machine("squat", "person", angle(LEG), 90, 160)
ELBOW = machine("elbow", "person", angle(ARM), 70, 150)
STATE = "rep_count, phase, angle, feedback"
KEY = "video_id, frame_idx, det_idx"


def last_of(name: str) -> str:
    return (
        f"SELECT video_id, track_id, '{name}' AS exercise, {STATE} FROM {name} "
        f"QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY rn DESC) = 1"
    )


def rows_of(name: str) -> str:
    return f"SELECT {KEY}, track_id, '{name}' AS exercise, {STATE} FROM {name}"


#: Greedy suppression: per box a bit mask of the better boxes it overlaps, then ranks in order.
def suppression(source: str) -> str:
    inter = (
        "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * "
        "greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
    )
    areas = "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)"
    return f"""
ranked AS MATERIALIZED (SELECT *, row_number() OVER
  (PARTITION BY video_id, frame_idx ORDER BY conf DESC, det_idx) AS rk FROM {source}),
masks AS MATERIALIZED (SELECT a.video_id, a.frame_idx, a.rk,
  cast(coalesce(sum(CASE WHEN {inter} > 0.45 * ({areas} - {inter}) THEN pow(2, b.rk - 1) END), 0)
    as bigint) AS m
  FROM ranked a LEFT JOIN ranked b
    ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND b.rk < a.rk
  GROUP BY a.video_id, a.frame_idx, a.rk),
walk AS (
  SELECT DISTINCT video_id, frame_idx, cast(0 as bigint) AS rk, cast(0 as bigint) AS kept FROM ranked
  UNION ALL
  SELECT w.video_id, w.frame_idx, x.rk,
    CASE WHEN (w.kept & x.m) = 0 THEN w.kept | cast(pow(2, x.rk - 1) as bigint) ELSE w.kept END
  FROM walk w JOIN masks x
    ON x.video_id = w.video_id AND x.frame_idx = w.frame_idx AND x.rk = w.rk + 1),
survivors AS (SELECT r.* FROM ranked r JOIN walk w
  ON w.video_id = r.video_id AND w.frame_idx = r.frame_idx AND w.rk = r.rk
  WHERE (w.kept & cast(pow(2, r.rk - 1) as bigint)) <> 0)"""


#: Numbers of the tracker, written out: a track is found again over at most 30 frames and from an overlap of 0.2, and begins with a box of 0.5.
MAX_LOST, MATCH_IOU, HIGH = 30, 0.2, 0.5


def lane_walk(source: str) -> str:
    """CTEs ``lane_walk`` and ``lane_tracks``: the tracker on every lane, row by row, and the numbers of its tracks.

    Lanes are too far apart to touch, so a box meets the live tracks of its own lane only. Each is expected where its last step leads;
    the greatest overlap wins, then the track that is first by place. A track is named by the frame it began in.
    """
    corners = ("x1", "y1", "x2", "y2")
    ahead = ", ".join(f"'p_{k}': t.{k} + t.s_{k} * (frame_idx - t.last)" for k in corners)
    inter = (
        "greatest(0.0, least(t.p_x2, x2) - greatest(t.p_x1, x1)) * greatest(0.0, least(t.p_y2, y2) - greatest(t.p_y1, y1))"
    )
    areas = "greatest(0.0, t.p_x2 - t.p_x1) * greatest(0.0, t.p_y2 - t.p_y1) + (x2 - x1) * (y2 - y1)"
    state = ", ".join([f"'{k}': t.{k}" for k in corners] + [f"'s_{k}': t.s_{k}" for k in corners])
    track = ", ".join([f"{k} double" for k in corners] + [f"s_{k} double" for k in corners])
    here = ", ".join(f"'{k}': {k}" for k in corners)
    moved = ", ".join(f"'s_{k}': ({k} - best.{k}) / cast(frame_idx - best.last as double)" for k in corners)
    still = ", ".join(f"'s_{k}': cast(0 as double)" for k in corners)
    return f"""
lane_seq AS MATERIALIZED (SELECT video_id, slot, frame_idx, conf, x1, y1, x2, y2,
  row_number() OVER (PARTITION BY video_id, slot ORDER BY frame_idx) AS n FROM {source}),
lane_walk AS (
  SELECT video_id, slot, cast(0 as bigint) AS n, cast(-1 as bigint) AS frame_idx, cast(null as bigint) AS born,
    cast([] as struct({track}, last bigint, born bigint)[]) AS live
  FROM lane_seq WHERE n = 1
  UNION ALL
  SELECT video_id, slot, n, frame_idx, CASE WHEN best IS NOT NULL THEN best.born WHEN conf >= {HIGH} THEN frame_idx END,
    CASE WHEN best IS NOT NULL THEN list_filter(live, lambda t: t.born <> best.born)
        || [{{{here}, {moved}, 'last': frame_idx, 'born': best.born}}]
      WHEN conf >= {HIGH} THEN live || [{{{here}, {still}, 'last': frame_idx, 'born': frame_idx}}]
      ELSE live END
  FROM (SELECT *, list_sort(list_filter(list_transform(expected, lambda t:
        {{'rest': -(({inter}) / ({areas} - {inter})), {state}, 'last': t.last, 'born': t.born}}),
        lambda t: t.rest <= -{MATCH_IOU}))[1] AS best
    FROM (SELECT *, list_transform(live, lambda t: {{{state}, 'last': t.last, 'born': t.born, {ahead}}}) AS expected
      FROM (SELECT q.*, list_filter(w.live, lambda t: q.frame_idx - t.last <= {MAX_LOST}) AS live
        FROM lane_walk w JOIN lane_seq q ON q.video_id = w.video_id AND q.slot = w.slot AND q.n = w.n + 1)))),
lane_tracks AS (SELECT video_id, slot, born, row_number() OVER (PARTITION BY video_id ORDER BY born, slot) AS id
  FROM (SELECT DISTINCT video_id, slot, born FROM lane_walk WHERE born IS NOT NULL))"""


def segments(source: str) -> str:
    """One SELECT per skeleton edge."""
    parts = [
        f"SELECT {KEY}, track_id, {i} AS idx, cast(trunc(px{a}) as integer) AS x1, "
        f"cast(trunc(py{a}) as integer) AS y1, cast(trunc(px{b}) as integer) AS x2, "
        f"cast(trunc(py{b}) as integer) AS y2 FROM {source} WHERE ps{a} > 0.4 AND ps{b} > 0.4"
        for i, (a, b) in enumerate(SKELETON)
    ]
    return " UNION ALL ".join(parts)


def dots(source: str) -> str:
    parts = [
        f"SELECT {KEY}, track_id, {k} AS idx, cast(trunc(px{k}) as integer) AS x1, "
        f"cast(trunc(py{k}) as integer) AS y1 FROM {source} WHERE ps{k} > 0.4"
        for k in POINTS
    ]
    return " UNION ALL ".join(parts)


def label(name: str) -> str:
    return (
        f"'{name}: ' || cast(rep_count as varchar) || ' reps | ' || printf('%.0f', exact) || '°'"
    )


def labels(source: str, names) -> str:
    return " UNION ALL ".join(
        f"SELECT p.video_id, p.frame_idx, p.det_idx, p.track_id, {i} AS idx, "
        f"cast(trunc(p.x1) as integer) AS x1, cast(trunc(p.y1) as integer) - 28 - 18 * {i} AS y1, "
        f"{label(e)} AS text FROM {source} p JOIN {e} e USING ({KEY}, track_id)"
        for i, e in enumerate(names)
    )


def drawing(source: str, names) -> str:
    none = "cast(null as integer)"
    return f"""
items AS (
  SELECT {KEY}, track_id, 0 AS layer, idx, 'segment' AS kind, x1, y1, x2, y2, cast(null as double) AS size,
    2 AS thickness, cast(null as varchar) AS text FROM ({segments(source)})
  UNION ALL SELECT {KEY}, track_id, 1, idx, 'dot', x1, y1, {none}, {none}, 4.0, -1, null FROM ({dots(source)})
  UNION ALL SELECT {KEY}, track_id, 2, 0, 'id', cast(trunc(x1) as integer), cast(trunc(y1) as integer) - 10,
    {none}, {none}, 0.6, 2, 'ID:' || cast(track_id as varchar) FROM {source}
  UNION ALL SELECT {KEY}, track_id, 3, idx, 'exercise', x1, y1, {none}, {none}, 0.5, 1, text
    FROM ({labels(source, names)})),
drawn AS (SELECT {KEY}, cast(row_number() OVER
    (PARTITION BY video_id, frame_idx ORDER BY det_idx, layer, idx) as integer) AS z,
  cast(((track_id % 100) + 100) % 100 as integer) AS color_idx, kind, x1, y1, x2, y2, size, thickness, text
  FROM items)"""


def oracles() -> dict[str, str]:
    person = with_(PERSON)
    squat = with_(PERSON, SQUAT)
    both = with_(PERSON, SQUAT, ELBOW)
    parsed = with_(BOXES, PARSED)
    left, right = gate("left", LEG), gate("right", LEG)
    squat_parsed = machine("squat", "parsed", angle(LEG), 90, 160)
    elbow_parsed = machine("elbow", "parsed", angle(ARM), 70, 150)
    loop_persons = (
        "loop_persons AS (SELECT * REPLACE (cast(row_number() OVER "
        "(PARTITION BY video_id, frame_idx ORDER BY det_idx) - 1 as integer) AS det_idx) "
        "FROM survivors WHERE frame_idx % 10 <> 0)"
    )
    loop = with_(
        BOXES,
        suppression("(SELECT * FROM boxes WHERE conf >= 0.45)"),
        loop_persons,
        machine("squat", "loop_persons", angle(LEG), 90, 160),
        machine("elbow", "loop_persons", angle(ARM), 70, 150),
    )
    # Frames without ids: a box's place in its frame is its lane, weak boxes go, positions close up.
    lanes = (
        "lanes AS (SELECT * REPLACE (cast(row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY slot) - 1 as integer) "
        "AS det_idx, slot * 1000.0 + x1 % 10 AS x1, y1 % 10 AS y1, slot * 1000.0 + x1 % 10 + 100 AS x2, y1 % 10 + 100 AS y2) "
        "FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_idx) - 1 AS slot FROM boxes) WHERE conf >= 0.35)"
    )
    walked = lane_walk("lanes")
    tracked = (
        "tracked AS (SELECT l.* REPLACE (id AS track_id) FROM lanes l JOIN lane_walk w USING (video_id, slot, frame_idx) "
        "JOIN lane_tracks t ON t.video_id = w.video_id AND t.slot = w.slot AND t.born = w.born)"
    )
    lane_loop = [
        BOXES,
        lanes,
        walked,
        tracked,
        machine("squat", "tracked", angle(LEG), 90, 160),
        machine("elbow", "tracked", angle(ARM), 70, 150),
    ]
    hands = (
        "hands AS (SELECT video_id, frame_idx, det_idx, track_id, cast(0 as bigint) AS rep_count, "
        "cast(0.0 as double) AS exact FROM loop_persons)"
    )
    hook_loop = with_(
        BOXES,
        suppression("(SELECT * FROM boxes WHERE conf >= 0.45)"),
        loop_persons,
        machine("squat", "loop_persons", angle(LEG), 90, 160),
        machine("elbow", "loop_persons", angle(ARM), 70, 150),
        hands,
        drawing("loop_persons", ["squat", "hands", "elbow"]),
    )
    box_row = f"{KEY}, conf, x1, y1, x2, y2"
    parsed_row = f"{KEY}, track_id, {box_row.removeprefix(KEY + ', ')}, has_points, px13 AS x13, ps13 AS s13"
    counts = (
        "counts AS (SELECT 'squat' AS name, count(*) AS n_rows, count(a) AS n_angle, "
        "count(CASE WHEN a < 90 THEN 1 END) AS n_down, count(CASE WHEN a > 160 THEN 1 END) AS n_up FROM squat_a "
        "UNION ALL SELECT 'elbow', count(*), count(a), count(CASE WHEN a < 70 THEN 1 END), "
        "count(CASE WHEN a > 150 THEN 1 END) FROM elbow_a)"
    )
    angles = (
        f"squat_a AS (SELECT {angle(LEG)} AS a FROM person), elbow_a AS (SELECT {angle(ARM)} AS a FROM person)"
    )
    settings = (
        "settings(ord, name, enabled, joint_a, joint_b, joint_c, down_threshold, up_threshold, min_confidence) AS "
        "(VALUES (0, 'squat', true, 'hip', 'knee', 'ankle', 90.0, 160.0, 0.5), "
        "(1, 'elbow', true, 'shoulder', 'elbow', 'wrist', 70.0, 150.0, 0.5), "
        "(2, 'off', false, 'hip', 'knee', 'ankle', 90.0, 160.0, 0.5), "
        "(3, 'unknown_name', true, 'hip', 'knee', 'ankle', 90.0, 160.0, 0.5))"
    )
    states = f"{squat} {rows_of('squat')}"
    slots = (
        "slots AS (SELECT video_id, det_idx, row_number() OVER (PARTITION BY video_id ORDER BY first, det_idx) "
        "AS id, first FROM (SELECT video_id, det_idx, min(frame_idx) AS first FROM boxes {where} "
        "GROUP BY video_id, det_idx))"
    )
    sql = {
        "scan_persons": with_(BOXES)
        + "SELECT video_id, frame_idx, count(*) AS n_boxes, frame_idx % 10 <> 0 AS tracked, "
        "cast(sum(CASE WHEN has_points THEN 17 ELSE 0 END) as bigint) AS n_points, round(sum(conf), 4) AS conf "
        "FROM boxes GROUP BY video_id, frame_idx",
        "stream_persons": person
        + f"SELECT {KEY}, track_id, conf, x1, has_points, py13 AS y13, ps16 AS s16 FROM person",
        "exercise_config": with_(PERSON, angles, counts, settings)
        + "SELECT ord, s.name, enabled, joint_a, joint_b, joint_c, cast(down_threshold as double) AS down_threshold, "
        "cast(up_threshold as double) AS up_threshold, cast(min_confidence as double) AS min_confidence, "
        "coalesce(n_rows, 0) AS n_rows, coalesce(n_angle, 0) AS n_angle, coalesce(n_down, 0) AS n_down, "
        "coalesce(n_up, 0) AS n_up FROM settings s LEFT JOIN counts c ON s.name = c.name",
        "sink_states": states,
        "conf_filter": with_(BOXES) + f"SELECT {box_row} FROM boxes WHERE conf >= 0.45",
        "conf_filter_frames": parsed
        + f"SELECT {box_row.replace('det_idx', 'cast(row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_idx) - 1 as integer) AS det_idx')} "
        "FROM parsed WHERE conf >= 0.45",
        "nms": with_(BOXES, suppression("boxes")) + f"SELECT {box_row} FROM survivors",
        "nms_frames": with_(BOXES, suppression("boxes"))
        + "SELECT video_id, frame_idx, count(*) AS n_kept, sum(x1) AS x1, sum(y2) AS y2, "
        "sum(CASE WHEN has_points THEN px13 ELSE 0 END) AS knees FROM survivors GROUP BY video_id, frame_idx",
        "parse_detections": parsed + f"SELECT {parsed_row} FROM parsed",
        "tracked_only": with_(BOXES)
        + "SELECT video_id, frame_idx, count(*) AS n_boxes FROM boxes WHERE frame_idx % 10 <> 0 "
        "GROUP BY video_id, frame_idx",
        "track_assign": with_(BOXES, slots.format(where="WHERE conf >= 0.5"))
        + f"SELECT b.video_id, b.frame_idx, b.det_idx, CASE WHEN b.frame_idx >= s.first THEN id END AS track_id "
        "FROM boxes b LEFT JOIN slots s ON s.video_id = b.video_id AND s.det_idx = b.det_idx",
        "tracker_hook": with_(BOXES, slots.format(where=""))
        + "SELECT b.video_id, b.frame_idx, b.det_idx, id AS track_id "
        "FROM boxes b JOIN slots s ON s.video_id = b.video_id AND s.det_idx = b.det_idx",
        "joint_lookup": person
        + f"SELECT {KEY}, track_id, px13 AS knee_x, py13 AS knee_y, ps13 AS knee_score, px10 AS wrist_x, "
        "py10 AS wrist_y, ps10 AS wrist_score FROM person",
        "confidence_gate": person
        + f"SELECT {KEY}, track_id, {left} AS left_ok, {right} AS right_ok FROM person",
        "side_select": person
        + f"SELECT {KEY}, track_id, CASE WHEN {left} THEN 'left' WHEN {right} THEN 'right' END AS side FROM person",
        "joint_angle": person
        + f"SELECT {KEY}, track_id, round({angle(LEG)}, 4) AS knee_angle, round({angle(ARM)}, 4) AS elbow_angle "
        "FROM person",
        "bbox_geometry": person
        + f"SELECT {KEY}, "
        + ", ".join(f"cast(trunc({c} - 60.75) as integer) AS {c}" for c in BOX)
        + " FROM person",
        "active_exercises": with_(PERSON)
        + "SELECT ordinal, name, side, count(*) AS n_persons FROM ("
        f"SELECT 0 AS ordinal, 'squat' AS name, CASE WHEN {left} THEN 'left' WHEN {right} THEN 'right' END AS side "
        "FROM person UNION ALL SELECT 1, 'elbow', "
        f"CASE WHEN {gate('left', ARM)} THEN 'left' WHEN {gate('right', ARM)} THEN 'right' END FROM person) "
        "GROUP BY ordinal, name, side",
        "person_exercises": person
        + f"SELECT {KEY}, track_id, ordinal, exercise FROM person, "
        "(VALUES (0, 'squat'), (1, 'elbow')) AS e(ordinal, exercise)",
        "state_attach": squat
        + f"SELECT p.video_id, p.frame_idx, p.det_idx, p.track_id, 'squat' AS exercise, {STATE}, p.x1 "
        f"FROM person p JOIN squat USING ({KEY}, track_id)",
        "latest_state": f"{both} {last_of('squat')} UNION ALL {last_of('elbow')}",
        "stream_latest_state": f"{both} SELECT * FROM ({last_of('squat')}) UNION ALL SELECT * FROM ({last_of('elbow')})",
        "exercise_map": both
        + f"SELECT s.video_id, s.frame_idx, s.det_idx, s.track_id, 'squat,elbow' AS names, "
        "s.rep_count AS squat_reps, s.phase AS squat_phase, s.angle AS squat_angle, s.feedback AS squat_feedback, "
        "e.rep_count AS elbow_reps, e.phase AS elbow_phase, e.angle AS elbow_angle, e.feedback AS elbow_feedback "
        f"FROM squat s JOIN elbow e USING ({KEY}, track_id)",
        "phase": f"{squat} SELECT {KEY}, track_id, phase FROM squat",
        "rep_count": f"{squat} SELECT {KEY}, track_id, rep_count, phase FROM squat",
        "rep_count_chunked": f"{squat} SELECT {KEY}, track_id, rep_count, phase, angle FROM squat",
        "angle_carry": f"{squat} SELECT {KEY}, track_id, angle FROM squat",
        "feedback_carry": f"{squat} SELECT {KEY}, track_id, feedback FROM squat",
        "rep_events": f"{squat} SELECT {KEY}, track_id, rep_count, angle, feedback FROM squat WHERE completed",
        "rep_count_inverted": with_(PERSON, machine("squat", "person", angle(LEG), 120, 60))
        + f"SELECT {KEY}, track_id, rep_count, phase, feedback FROM squat",
        "skeleton_segments": person
        + f"SELECT {KEY}, track_id, idx, x1, y1, x2, y2, 2 AS thickness FROM ({segments('person')})",
        "keypoint_dots": person
        + f"SELECT {KEY}, track_id, idx, x1, y1, cast(4.0 as double) AS size, -1 AS thickness FROM ({dots('person')})",
        "id_labels": person
        + f"SELECT {KEY}, track_id, cast(trunc(x1) as integer) AS x1, cast(trunc(y1) as integer) - 10 AS y1, "
        "cast(0.6 as double) AS size, 2 AS thickness, 'ID:' || cast(track_id as varchar) AS text FROM person",
        "exercise_labels": both
        + f"SELECT {KEY}, track_id, idx, x1, y1, cast(0.5 as double) AS size, 1 AS thickness, text "
        f"FROM ({labels('person', ['squat', 'elbow'])})",
        "track_color": person
        + f"SELECT {KEY}, track_id, cast(track_id % 100 as integer) AS color_idx, "
        f"cast(((-track_id % 100) + 100) % 100 as integer) AS negative_idx FROM person",
        "overlay": with_(BOXES, PARSED, squat_parsed, elbow_parsed, drawing("parsed", ["squat", "elbow"]))
        + "SELECT * FROM drawn",
        "stream_rep_count": f"{both} {rows_of('squat')} UNION ALL {rows_of('elbow')}",
        "state_ttl": states,
        "detector_hook": with_(BOXES)
        + f"SELECT {KEY}, event_id AS track_id, conf, x1, y1, x2, y2 FROM boxes",
        "exercise_hook": with_(PERSON, machine("knees", "person", both_knees(), 90, 160))
        + f"{rows_of('knees')} UNION ALL SELECT {KEY}, track_id, 'hands', cast(0 as bigint), "
        "CASE WHEN py9 < py5 AND py10 < py6 THEN 'up' ELSE 'down' END, cast(0.0 as double), '' FROM person",
        "multi_exercise": f"{both} {rows_of('squat')} UNION ALL {rows_of('elbow')}",
        "frame_loop_tracked": f"{with_(*lane_loop)} {rows_of('squat')} UNION ALL {rows_of('elbow')}",
        "frame_overlay": with_(*lane_loop, drawing("tracked", ["squat", "elbow"])) + "SELECT * FROM drawn",
        "exercise_hook_overlay": hook_loop + "SELECT * FROM drawn",
        "frame_loop": f"{loop} {rows_of('squat')} UNION ALL {rows_of('elbow')}",
    }
    sql["stream_track_assign"] = sql["track_assign"]
    sql["stream_rep_count_apart"] = sql["stream_rep_count_chunked"] = sql["stream_rep_count"]
    sql["stream_exercise_hook"] = sql["exercise_hook"]
    return sql
