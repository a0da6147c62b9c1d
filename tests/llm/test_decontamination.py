import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from jointflow.llm import decontamination as d
from tables import documents, frame


def nearest(item, text):
    """Least word edit distance of the item to any passage, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=90), st.lists(st.sampled_from("abcde"), max_size=120))
def test_myers_distance(item, text):
    distance, end = d.Pattern(item).best(text)
    assert distance == min(nearest(item, text), len(item))
    if distance < len(item):
        assert nearest(item[::-1], text[:end][::-1]) <= distance


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_all_passages_within_the_budget_are_found(seed):
    rng = random.Random(seed)
    items = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(5, 40))] for _ in range(4)]
    text = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 60))]
    passage = list(rng.choice(items))
    for _ in range(rng.randrange(0, 1 + int(len(passage) * d.BUDGET))):
        at, kind = rng.randrange(len(passage)), rng.randrange(3)
        passage[at : at + (kind > 0)] = ["new"] * (kind < 2)
        if not passage:
            return
    text[(cut := rng.randrange(len(text) + 1)) : cut] = passage
    found = {i: distance for i, distance, _ in d.Searcher(items).find(f" {' '.join(text)} ")}
    expected = {i: n for i, x in enumerate(items) if (n := nearest(x, text)) <= int(len(x) * d.BUDGET)}
    assert set(found) == set(expected)
    assert all(found[i] >= n and found[i] <= int(len(items[i]) * d.BUDGET) for i, n in expected.items())


ITEMS = "item_id long, text string"


@pytest.mark.parametrize("slice_chars", [10**6, 120])
def test_tables(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(d, "SLICE_CHARS", slice_chars)
    rows = documents(30)
    text = next(t for _, t in rows if t and len(t.split()) > 60).split(" ")
    items = [
        (1, " ".join(text[10:40]).upper()),
        (2, " ".join([*text[20:30], "changed", *text[31:45]])),
        (2, " ".join(text[20:30])),
        (3, "one two three four five six seven"),
        (4, "one two"),
        (5, None),
        (6, ""),
        (7, "word word word word word word"),
        (None, "One, two; three... four five six -- seven!"),
    ]
    rows += [(77, "so ONE two three-four\nfive six seven."), (77, "so ONE two three-four\nfive six seven.")]
    docs, table = frame(spark, rows).selectExpr("*", "3 AS item_id", "4 AS distance"), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, table).collect()}
    expected = set()
    for doc, t in rows:
        for item, x in items:
            w = d.fold(x or "").split()
            if len(w) >= d.LEAST_WORDS and nearest(w, d.fold(t or "").split()) <= int(len(w) * d.BUDGET):
                expected.add((doc, item))
    assert got == expected and (77, 3) in got and (77, None) in got and (1005, 7) in got
    marked = d.mark_leaks(docs.selectExpr("*", "1 AS leaked"), table).collect()
    assert len(marked) == len(rows)
    assert {r.doc_id for r in marked if r.leaked} == {doc for doc, _ in expected}


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], ITEMS), frame(spark, documents(5))
    assert d.leaks(docs, none).count() == 0
    assert d.mark_leaks(docs, none).where("leaked").count() == 0
    assert d.leaks(frame(spark, []), spark.createDataFrame([(1, "a b c d e f")], ITEMS)).count() == 0


def test_short_items_are_found_word_for_word(spark):
    docs = spark.createDataFrame([(1, "well, what is two plus two"), (2, "what is one plus"), (3, "は 短い です")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "what is two plus"), (8, "短い"), (9, ""), (10, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()} == {(1, 7), (3, 8)}
    assert {r.doc_id for r in d.mark_leaks(docs, items).where("leaked").collect()} == {1, 3}
