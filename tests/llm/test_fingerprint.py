"""Fingerprints against plain sums, and edits against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from jointflow.llm import fingerprint as fp
from tables import documents, frame


def equal(a, b):
    return bool((a[0] == b[0]).all() and (a[1] == b[1]).all())


def plain_cells(lines):
    """The counts lane by lane, one shingle at a time."""
    total = np.zeros(fp.CELLS, np.int64)
    for line in lines:
        words = line.replace("\t", " ").split(" ")
        words = [w for w in words if w]
        shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words]
        for s in shingles:
            one = fp.sums([[" ".join(s)]])[1][0].astype(np.int16).astype(np.int64)
            assert np.abs(one).sum() == 1
            total += one
    return total


def test_cells_are_sums_over_shingles():
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["a", "bb", "ß", "漢字", "d\te"]) for _ in range(rng.randrange(0, 12))) for _ in range(40)] + ["", "  ", "x"]
    assert (fp.sums([lines])[1][0].astype(np.int16) == plain_cells(lines)).all()


def test_order_insertion_and_deletion(monkeypatch):
    lines = ["one two three four", "", "five", "five", "six seven eight"]
    whole = fp.sums([lines])
    assert equal(whole, fp.sums([lines[::-1]]))
    assert not equal(whole, fp.sums([lines[1:]])) and not equal(whole, fp.sums([[*lines, ""]]))
    assert equal(whole, fp.add(fp.sums([lines[1:]]), fp.sums([lines[:1]])))
    assert equal(fp.remove(whole, fp.sums([lines[:1]])), fp.sums([lines[1:]]))
    monkeypatch.setattr(fp, "CHUNK", 3)  # many chunks
    assert equal(whole, fp.sums([lines]))


def test_likeness():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    text = lambda n: [" ".join(rng.choices(words, k=20)) for _ in range(n)]
    a, b, c = text(40), text(40), text(40)
    x, same, half, other, nothing = (fp.sums([t]) for t in (a, a[::-1], a[:20] + b[:20], c, []))
    assert fp.likeness(x, same)[0] == 1.0
    assert 0.15 < fp.likeness(x, half)[0] < 0.55  # a third in truth
    assert fp.likeness(x, other)[0] < 0.15
    assert fp.likeness(x, nothing)[0] == 0.0 and fp.likeness(nothing, nothing)[0] == 1.0


@pytest.mark.parametrize("rows", [documents(40), [(1, None)], []])
def test_edits(spark, rows):
    df = frame(spark, rows).selectExpr("doc_id", "text", "'own' AS fingerprint", "1 AS part")
    got = df.repartition(3).transform(fp.edit_likeness).collect()
    assert len(got) == len(rows)
    # Rows with equal ids may follow each other in any order: those without such neighbours have one answer.
    ids = [d for d, _ in rows]
    texts = {d: t or "" for d, t in rows}
    order = sorted((d for d in texts if d is not None), reverse=True)
    for r in got:
        if r.doc_id is None or ids.count(r.doc_id) > 1:
            continue
        text = texts[r.doc_id]
        assert r.n_chars == len(text)
        nxt = order[order.index(r.doc_id) + 1] if r.doc_id != order[-1] else None
        if nxt is None or ids.count(nxt) > 1:
            continue
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[nxt][:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (fp.sums([t.split("\n")]) for t in (text, edited, texts[nxt]))
        assert fp.packed(a)[0] == __import__("base64").b64decode(r.fingerprint)
        assert fp.packed(b)[0] == __import__("base64").b64decode(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(fp.likeness(a, b)[0]) and r.near_next == pytest.approx(fp.likeness(a, c)[0])
    by_text = {}
    for r in got:
        if r.doc_id is not None and ids.count(r.doc_id) == 1:
            by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_last_document_is_followed_by_the_first(spark):
    rows = [(1, "abcd"), (2, "wxyz"), (3, "mnop")]
    got = {r.doc_id: r.edited_sha256 for r in fp.edit_likeness(frame(spark, rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {3: sha("mnwx"), 2: sha("wxab"), 1: sha("abmn")}


def test_fingerprint_column(spark):
    df = frame(spark, documents(12)).selectExpr("*", "'old' AS fingerprint")
    rows = fp.fingerprints(df).collect()
    assert len(rows) == len(documents(12))
    for r in rows:
        assert bytes(r.fingerprint) == fp.packed(fp.sums([(r.text or "").split("\n")]))[0]
    back = fp.unpacked([bytes(r.fingerprint) for r in rows])
    assert fp.packed(back) == [bytes(r.fingerprint) for r in rows]
