import collections
import math
import random

import numpy as np
import pytest
from jointflow.llm import toxicity
from tables import documents, frame

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    calm = [f"{a}{b}" for a in ("ba", "to", "mi", "re") for b in ("lun", "pas", "tor", "nel", "gis")]
    harsh = ["grozzl", "vexar", "snarkt"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = [rng.choice(calm) for _ in range(rng.randrange(20, 80))]
        if toxic:
            for _ in range(max(2, len(w) // 10)):
                w[rng.randrange(len(w))] = rng.choice(harsh) + rng.choice(["", "a", "en"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = frame(spark, rows)
    scored = toxicity.add_toxicity(docs, docs, spark.createDataFrame(labels, LABELS)).collect()
    import zlib

    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_labels_of_held_out_rows_teach_nothing(spark):
    import zlib

    rows, labels = corpus(200)
    docs = frame(spark, rows)
    held = {d for d, *_ in labels if zlib.crc32(str(d).encode()) % 5 == 0}
    turned = [(d, q, 1 - t if d in held else t) for d, q, t in labels]
    a, b = (
        {r.doc_id: r.score for r in toxicity.add_toxicity(docs, docs, spark.createDataFrame(x, LABELS)).collect()}
        for x in (labels, turned)
    )
    assert a == b


def test_against_the_definition(spark):
    """Counts, shared backoff and log ratios from plain dictionaries."""
    rows = [("the cat sat", 0), ("the dog sat on the cat", 0), ("bad cat bad", 1), ("the bad dog", 1)]
    depth, d = 2, 0.75
    table = spark.createDataFrame([(t, c, False) for t, c in rows], "text string, toxic int, fit boolean")
    counts = toxicity.count_grams(table, depth)
    ratios = {r.key: r.ratio for r in toxicity.log_ratios(counts, depth, d).collect()}

    grams = [collections.Counter(), collections.Counter()]
    for text, c in rows:
        data = bytes(depth) + text.encode() + b"\xff"
        grams[c].update(data[i - depth : i + 1] for i in range(depth, len(data)))
    kinds = {depth: set(grams[0]) | set(grams[1])}
    for order in range(depth - 1, -1, -1):
        kinds[order] = {g[1:] for g in kinds[order + 1]}
    left = {o: collections.Counter(g[1:] for g in kinds[o + 1]) for o in range(depth)}

    def shared(gram):
        if not gram:
            return 1 / 257
        n = left[len(gram) - 1]
        of = {g: c for g, c in n.items() if g[:-1] == gram[:-1]}
        return (max(n[gram] - d, 0) + sum(min(c, d) for c in of.values()) * shared(gram[1:])) / sum(of.values())

    def p(c, gram):
        of = {g: n for g, n in grams[c].items() if g[:-1] == gram[:-1]}
        if not of:
            return shared(gram[1:])
        return (max(grams[c][gram] - d, 0) + sum(min(n, d) for n in of.values()) * shared(gram[1:])) / sum(of.values())

    number = lambda b: int.from_bytes(b, "big")
    assert set(ratios) == {number(g) for g in kinds[depth]} | {number(g[:-1]) + (1 << 8 * (depth + 1)) for g in kinds[depth]}
    for g in kinds[depth]:
        assert math.isclose(ratios[number(g)], math.log(p(1, g) / p(0, g)), abs_tol=1e-9)
    # A byte never seen after a context is worth the same for all such bytes.
    unseen = b"at\x01"
    assert math.isclose(ratios[number(b"at") + (1 << 24)], math.log(p(1, unseen) / p(0, unseen)), abs_tol=1e-9)


@pytest.mark.parametrize("slice_rows", [10**6, 300, 50])
def test_slices_add_up(spark, slice_rows):
    rows, labels = corpus(60)
    table = spark.createDataFrame([(t, labels[d][2], False) for d, t in rows], "text string, toxic int, fit boolean")
    ratios = toxicity.log_ratios(toxicity.count_grams(table))
    docs = frame(spark, rows[:20] + documents(12))
    a = toxicity.add_ratio(docs, ratios).select("text", "log_ratio").collect()
    b = toxicity.add_ratio(docs, ratios, slice_rows=slice_rows).select("text", "log_ratio").collect()
    assert np.allclose([r.log_ratio for r in a], [r.log_ratio for r in b], atol=1e-6)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 1)], [(1, 1, None), (None, 1, 1)], [(1, 0, 0), (1, 0, 1), (3, 1, 0)]])
def test_few_labels_and_odd_rows(spark, labels):
    rows = documents(30)
    docs = frame(spark, rows).selectExpr("*", "7 AS score", "8 AS predicted", "9 AS log_ratio")
    got = toxicity.add_toxicity(docs, docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    if not labels:
        assert {r.score for r in got} == {0.5}
    assert toxicity.add_toxicity(docs.limit(0), docs, spark.createDataFrame(labels, LABELS)).count() == 0


def test_documents_kept_for_the_curve_are_counted(spark):
    """A toxic expression that stands only in documents the curve is fitted on is known to the scores."""
    rows, labels = corpus(300)
    toxic = spark.createDataFrame(labels, LABELS).where("toxic = 1 and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    kept = [r.doc_id for r in toxic.orderBy(toxicity.F.xxhash64("doc_id")).limit(toxic.count() // toxicity.FIT_SHARE).collect()]
    assert len(kept) > 4
    plain = frame(spark, [*rows, (5000, "balun topas qwyxj qwyxj qwyxj mitor")])
    added = frame(spark, [(d, t + " qwyxj" * 30 if d in kept and labels[d][2] else t) for d, t in rows] + [(5000, "balun topas qwyxj qwyxj qwyxj mitor")])
    table = spark.createDataFrame(labels, LABELS)
    before, after = (
        toxicity.add_toxicity(x.where("doc_id = 5000"), x, table).first().score for x in (plain, added)
    )
    assert after > 0.9 > before


def test_curve_on_a_table_ordered_by_label(spark, monkeypatch):
    """Few documents for the curve, and all ordinary ones come first: it sees both classes, in their true shares."""
    import zlib

    monkeypatch.setattr(toxicity, "FIT_ROWS", 20)
    rows, labels = corpus()
    docs = frame(spark, sorted(rows, key=lambda r: labels[r[0]][2]))
    scored = toxicity.add_toxicity(docs, docs, spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    for c in (0, 1):
        assert np.mean([r.predicted == c for r in held if labels[r.doc_id][2] == c]) > 0.9
