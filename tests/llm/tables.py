"""Small document tables with every odd case in them."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "a row without an id"),
    (None, None),
    (1000, None),
    (1001, ""),
    (1002, " \t\n"),
    (1003, "same row"),
    (1003, "same row"),
    (1003, "same id, other text"),
    (1004, "x" * 30_000),
    (1005, "word " * 6_000),
    (1006, "Ünïcode ßtraße 漢字 \U0001f600 it's we'll <|endoftext|> a\x1cb   c"),
    (1007, "1 2 3 4 5 6 7 8 9 0 " * 500),
    (-5, "MIT License. mit license; Apache-License"),
]


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n)]


def documents(n=60, seed=7):
    """(doc_id, text) with copies, near copies and passages in common, and the odd rows."""
    rng = random.Random(seed)
    rows = []
    shared = " ".join(words(99, 60))
    for i in range(n):
        kind = i % 6
        if kind == 1 and rows:
            text = rng.choice(rows)[1]
        elif kind == 2 and rows:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["new", "other", "third"])
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(words(i, rng.randrange(10, 80))) + " " + shared
        else:
            text = " ".join(words(i, rng.randrange(1, 200)))
        rows.append((i, text))
    return rows + ODD


def frame(spark, rows):
    full = [(d, t, "en", "src", len(t) if t is not None else None) for d, t in rows]
    return spark.createDataFrame(full, DOCS)
