"""The audit against a plain replay of every order."""

from collections import Counter
from itertools import permutations

import pytest
from jointflow.llm import filter_audit as fa
from pyspark.sql import functions as F
from tables import documents


def fails(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    bits = 1 * (len(words) < 200)
    bits |= 2 * (100 * len(set(words)) < 50 * len(words))
    bits |= 4 * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
    return bits | 8 * any(c in "#$%&*|" for c in text)


def expected(rows, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    docs = []
    for d, t, lang in rows:
        t = t or ""
        repeated = d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in rows)
        docs.append((lang or "", fails(t) | 16 * repeated, d in good, d in toxic))
    out, share = [], Counter()
    for part in {p for p, *_ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        for order in permutations("ABCDE"):
            before = 0
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                removed = [x for x in own if not x[0] & before and x[0] & bit]
                kept = sum(not x[0] & (before | bit) for x in own)
                redundant = sum(bool(x[0] & before and x[0] & bit) for x in own)
                share[part, f] += len(removed)
                out.append((part, "".join(order), step, kept, len(removed), redundant, sum(x[0] == bit for x in own), sum(x[1] for x in removed), sum(x[2] for x in removed)))
                before |= bit
    return sorted((*r, share[r[0], r[1][r[2] - 1]]) for r in out)


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, lang, 1, 2) for d, t, lang in rows], "doc_id long, text string, lang string, hash int, failed int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("share", [1_000, 10])
def test_audit(spark, share, monkeypatch):
    monkeypatch.setattr(fa, "HOT_SHARE", share)  # 10: texts of several rows are dealt by salt
    monkeypatch.setattr(fa, "SALTS", 3)
    rows = [(d, t, ["en", "de", None, ""][i % 4]) for i, (d, t) in enumerate(documents(40))]
    rows += [(3000 + k, "copied text, MANY times", "en") for k in range(40)] + [(3000, "copied text, MANY times", "fr"), (None, "copied text, MANY times", "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 3050, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    labels = [(d, q, int(t) if t is not None else None) for d, q, t in labels]
    got = fa.audit(*tables(spark, rows, labels)).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, got.collect())) == expected(rows, labels)


def test_hot_texts_are_dealt_over_salts(spark):
    texts = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.xxhash64(F.lit("x")).alias("hash"))
    hot = texts.select("hash").distinct()
    found = {r.doc_id for r in fa.repeated_ids(texts, hot).collect()}
    assert found == set(range(1, 500))


def test_clashing_hashes_do_not_make_copies(spark):
    texts = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "a", 7), (4, "c", 8)], "doc_id long, text string, hash long")
    for hot in ("7", "-1"):
        found = fa.repeated_ids(texts, spark.sql(f"SELECT {hot}L AS hash" if hot == "7" else "SELECT -1L AS hash"))
        assert {r.doc_id for r in found.collect()} == {3}


def test_empty(spark):
    assert fa.audit(*tables(spark, [], [])).count() == 0
