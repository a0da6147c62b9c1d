import collections

import pytest
from jointflow.llm import components, ngram_join
from tables import documents, frame


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(rows):
    """Least doc_id over links, for each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(
        ((d, len(s), min(least[root(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def mine(spark, rows):
    got = ngram_join.near_duplicates(frame(spark, rows).selectExpr("*", "1 AS key", "2 AS n", "3 AS row"))
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)


def test_documents(spark):
    rows = documents(90)
    assert mine(spark, rows) == brute_force(rows)


def test_borderline_families(spark):
    """Chains whose links are just similar enough, around hubs that are not."""
    rows, n = [], 0
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(40)]
        for v in range(9):
            w = list(base)
            for k in range(v % 4):
                w[(7 * v + 13 * k) % 40] = f"v{v}x{k}"
            rows.append((n, " ".join(w[v % 3 :])))
            n += 1
    got = mine(spark, rows)
    assert got == brute_force(rows)
    assert 6 < len({c for *_, c in got}) < len(rows)


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 11, 12, 13, 20, 44])
def test_the_limit_itself(spark, n):
    """Texts of n shingles against texts with some more or fewer: links at exactly three quarters."""
    rows = [(i, " ".join(f"w{k}" for k in range(n + 4 - i))) for i in range(min(n, 14))]
    assert mine(spark, rows) == brute_force(rows)


def test_keep_one(spark):
    rows = documents(90)
    df = frame(spark, rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    groups = collections.Counter(c for d, n, c in brute_force(rows) if n and c is not None)
    with_words = [(d, t) for d, t in got if shingles(t)]
    assert {d for d, _ in with_words if d is not None} == set(groups)
    # No two of them are near copies.
    assert all(c == d for d, _, c in brute_force([(i, t) for i, (_, t) in enumerate(with_words)]))
    # Rows without words all stay, but for repeats of one row.
    assert {(d, t) for d, t in got if not shingles(t)} == {(d, t) for d, t in rows if not shingles(t)}
    assert (None, "a row without an id") in got


def test_empty_table(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0
    assert ngram_join.keep_one(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 5), (50, 51), (52, 50), (60, 60), (7, 8), (8, 7)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in [*range(1, 31), 100]} | {50: 50, 51: 50, 52: 50}


def test_first_filter_drops_no_partner():
    """All sizes (a, b, shared) of similar sets, and all ways in which unshared shingles may stand before shared ones."""
    tight = set()
    for a in range(1, 400):
        low = ngram_join.lowest(a)
        for b in range(1, 540):
            part = ngram_join.lowest(b)
            for shared in range(-(-3 * (a + b) // 7), min(a, b) + 1):
                # u of a's own and v of b's own stand first: a's part holds low - u shared ones, b's part - v of the same.
                u, v = min(a - shared, low), min(b - shared, part)
                alone = max(u, low - (part - v))
                assert alone <= ngram_join.spare(a) < max(a, 2), (a, b, shared)
                if alone > a // 4:
                    tight.add((a, b))
    assert tight == {(7, 9), (10, 13), (27, 36)}


def test_worst_order_by_plain_enumeration():
    """The worst case for small sets from all orders of shared shingles and those of one set alone."""
    import itertools

    for a in range(1, 8):
        for b in range(a, 10):
            for shared in range(-(-3 * (a + b) // 7), a + 1):
                total = a + b - shared
                for mine in itertools.combinations(range(total), a - shared):
                    rest = [x for x in range(total) if x not in mine]
                    for other in itertools.combinations(rest, b - shared):
                        A = [x for x in range(total) if x not in other]
                        B = [x for x in range(total) if x not in mine]
                        A, B = set(A[: ngram_join.lowest(a)]), set(B[: ngram_join.lowest(b)])
                        assert len(A - B) <= ngram_join.spare(a) and len(B - A) <= ngram_join.spare(b)


@pytest.mark.parametrize("n,m", [(7, 9), (10, 13)])
def test_new_shingles_before_the_shared_ones(spark, n, m):
    """A text within a longer one, whose added shingles have hashes so low that shared ones fall out of its lowest part."""
    shingler = ngram_join.Shingler(5)
    for k in range(100_000):
        words = [f"s{k}w{i}" for i in range(m + 4)]
        a, b = (shingler.of(" ".join(words[: x + 4]))[1].tolist() for x in (n, m))
        alone = set(a[: ngram_join.lowest(n)]) - set(b[: ngram_join.lowest(m)])
        if len(alone) > n // 4:
            break
    else:
        raise AssertionError("no such text found")
    rows = [(1, " ".join(words[: n + 4])), (2, " ".join(words)), (3, "something else that links with none of them")]
    assert mine(spark, rows) == brute_force(rows) == [(1, n, 1), (2, m, 1), (3, 4, 3)]


def test_workers_keep_no_words_after_the_join(spark):
    import sys

    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(40)], "doc_id long, text string")
    ngram_join.near_duplicates(docs.repartition(4)).collect()

    def kept(batches):
        for _ in batches:
            module = sys.modules.get("_jointflow_worker_state")
            yield pa.RecordBatch.from_pydict({"n": [len(module.state.get("shinglers", ())) if module else 0]})

    import pyarrow as pa

    assert not spark.range(4, numPartitions=4).mapInArrow(kept, "n long").where("n > 0").count()
