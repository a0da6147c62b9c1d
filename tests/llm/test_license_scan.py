import re

from jointflow.llm import license_scan as scan
from tables import documents, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GRANT = next(t for t, label in scan.TEXTS if label == "mit")
ROWS = [
    (0, "Released under the MIT License. MIT license; mit-LICENSE mit  license"),
    (1, "licensed under the GNU General Public License and the gnu lesser general public license"),
    (2, "the general public a license mit apache"),
    (3, GRANT.upper()),
    (4, "intro " + GRANT.replace("copy modify", "copy and then also modify").replace("free of charge ", "") + " outro"),
    (5, " ".join(GRANT.split()[:12])),
    (6, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."),
    (7, ("mit license " * 2_000).strip()),
    (8, GRANT + " middle " + GRANT),
    (9, "éMIT license mit licenseé"),
]


def places(text):
    w = WORD.findall((text or "").translate(str.maketrans(scan.UPPER, scan.LOWER)))
    found = []
    for phrase, label in scan.BASE_PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), found


def test_against_brute_force(spark):
    rows = ROWS + [(d + 100 if d in range(12) else d, t) for d, t in documents(12)]
    df = frame(spark, rows).selectExpr("*", "1 AS row", "2 AS words", "3 AS hash", "4 AS template", "5 AS at")
    got = scan.summary(scan.scan(df)).collect()
    assert len(got) == len(rows)
    expected = []
    for d, t in rows:
        n, found = places(t)
        starts = [i for i, _ in found]
        expected.append((d, n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
    mine = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(mine, key=repr) == sorted(expected, key=repr)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 10}
    assert by[1].labels == "gpl,lgpl" and by[2].labels == "" and by[2].score == 0
    assert by[3].labels == by[4].labels == by[8].labels == "mit" and by[3].score == 1 and 0.6 <= by[4].score < 1
    assert by[5].labels == "" and by[6].labels == "apache,cc-by-nc"
    assert by[7].n_base == 2_000 and by[9].n_base == 0


def test_spans(spark):
    found = {r.doc_id: r.spans for r in scan.scan(frame(spark, ROWS)).collect()}
    n = len(GRANT.split())
    assert [(s.start, s.end) for s in found[3] if not s.phrase] == [(0, n)]
    assert [(s.start, s.end) for s in found[8] if not s.phrase] == [(0, n), (n + 1, 2 * n + 1)]
    assert [(s.start, s.end) for s in found[4] if not s.phrase] == [(1, n + 1)]


def test_repeated_rows_keep_their_number(spark):
    rows = [(None, None)] * 3 + [(1, "the mit license")] * 2 + [(1, "mit")]
    got = [tuple(r) for r in scan.summary(scan.scan(frame(spark, rows))).select("doc_id", "n_words", "n_base").collect()]
    assert sorted(got, key=repr) == sorted([(None, 0, 0)] * 3 + [(1, 3, 1)] * 2 + [(1, 1, 0)], key=repr)


def test_empty_table(spark):
    assert scan.summary(scan.scan(frame(spark, []))).count() == 0
