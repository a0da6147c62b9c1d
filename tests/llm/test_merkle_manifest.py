"""Witnesses against plain trees."""

import hashlib
import zlib

import pytest
from jointflow.llm import merkle_manifest as mm
from tables import DOCS, documents, frame


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(leaves):
    """The root and the siblings of every leaf, level by level."""
    nodes, owner, way = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for leaf, at in enumerate(owner):
            run, k = runs[at // 3], at % 3
            way[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes, owner = [H("".join(r)) for r in runs], [at // 3 for at in owner]
    return nodes[0], way


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 26, 27, 28, 82, 100])
def test_appender(n):
    leaves = [H(str(k)) for k in range(n)]
    tree = mm.Appender()
    for leaf in leaves:
        tree.append(leaf)
    assert (tree.finish(mm.height_of(n)), tree.witness) == plain(leaves)


def test_partial_witnesses_are_extended():
    tree, seen = mm.Appender(), []
    for k in range(27):
        tree.append(H(str(k)))
        for before, now in zip(seen, tree.witness):
            assert now[: len(before)] == before
        seen = [list(w) for w in tree.witness]
    assert all(len(w) == 3 for w in tree.witness)


def leaf_of(row, text):
    shown = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return H("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in shown))


def expected(rows):
    if not rows:
        return []
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    parts = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        root, ways = plain([leaf_of(r, r.text) for r in own])
        parts.append((own, root, ways))
    top, upper = plain([root for _, root, _ in parts])
    out = []
    for (own, root, ways), more in zip(parts, upper):
        for r, way in zip(own, ways):
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf_of(r, text)
            for before, after in way + more:
                node = H(before + node + after)
            proof = H("".join(b + a for b, a in way + more))
            out.append((r.doc_id, leaf_of(r, r.text), root, top, proof, node, node == top))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_audit(spark, height, monkeypatch):
    monkeypatch.setattr(mm.manifest, "__defaults__", (height,))
    rows = [(d, t if i % 5 else (t or "") + "\nline", ["en", None][i % 2], ["a", "b", None, "é", ""][min(i % 9, 4)], i) for i, (d, t) in enumerate(documents(70))]
    df = spark.createDataFrame([*rows, (9, "only", "en", "alone", 4)], DOCS)
    got = [tuple(r) for r in mm.audit(df.repartition(4)).collect()]
    want = expected(df.collect())
    assert sorted(got, key=repr) == want
    assert 0 < sum(r[-1] for r in want) < len(want)


@pytest.mark.parametrize("rows", [[], [(1, "x")], [(None, None)] * 4])
def test_small_tables(spark, rows):
    df = frame(spark, rows)
    assert sorted((tuple(r) for r in mm.audit(df).collect()), key=repr) == expected(df.collect())


def test_columns_of_the_caller(spark):
    df = frame(spark, documents(10)).selectExpr("*", "sha2(string(doc_id), 256) AS leaf", "1 AS _i", "2 AS _own", "3 AS root", "4 AS `a.b`")
    out = mm.manifest(df, "source", ["doc_id"], "leaf")
    assert {"_i", "_own", "a.b", "witness", "subroot", "root"} <= set(out.columns)
    row = out.where("doc_id = 3").first()
    assert row["_i"] == 1 and row["_own"] == 2 and len(row["root"]) == 64
