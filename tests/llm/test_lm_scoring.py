import collections
import math
import zlib

import numpy as np
from jointflow.llm import lm_scoring
from jointflow.llm.common import crc_mod
from pyspark.sql import functions as F
from tables import documents, frame


class Tree:
    """Context-tree weighting as it is written down: one tree of bytes for each decision of a byte."""

    def __init__(self, depth):
        self.depth, self.counts = depth, collections.defaultdict(lambda: [0, 0])

    def steps(self, text):
        data = bytes(self.depth) + text + b"\xff"
        for i in range(self.depth, len(data)):
            for k in range(8):
                yield k, data[i] >> (8 - k), data[i - self.depth : i], (data[i] >> (7 - k)) & 1

    def learn(self, text):
        for k, prefix, context, bit in self.steps(text):
            for d in range(self.depth + 1):
                self.counts[k, prefix, context[self.depth - d :]][bit] += 1

    def finish(self):
        self.children = collections.defaultdict(set)
        for k, prefix, context in list(self.counts):
            if context:
                self.children[k, prefix, context[1:]].add(context)
        self.memo = {}

    def weighted(self, k, prefix, context):
        node = k, prefix, context
        if node not in self.memo:
            a, b = self.counts[node] if node in self.counts else (0, 0)
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(context) == self.depth:
                self.memo[node] = own, own
            else:
                deeper = sum(self.weighted(k, prefix, c)[1] for c in self.children[node])
                self.memo[node] = own, math.log(0.5) + np.logaddexp(own, deeper)
        return self.memo[node]

    def log10(self, text):
        total = 0.0
        for k, prefix, context, bit in self.steps(text):
            mixed, rest = 0.0, 1.0
            for d in range(self.depth + 1):
                c = context[self.depth - d :]
                counts = self.counts[k, prefix, c] if (k, prefix, c) in self.counts else (0, 0)
                own, weighted = self.weighted(k, prefix, c)
                share = 1.0 if d == self.depth else math.exp(math.log(0.5) + own - weighted)
                mixed += rest * share * (counts[bit] + 0.5) / (sum(counts) + 1)
                rest *= 1 - share
            total += math.log10(mixed)
        return total


def test_against_the_definition(spark):
    rows = [(d, t if t is None or len(t) < 500 else t[:300]) for d, t in documents(40)]
    df = frame(spark, rows).withColumn("held_out", crc_mod("doc_id", 7) == 2).withColumn("block", F.lit(3))
    got = lm_scoring.score(df, block_bytes=2_000).collect()
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    tree, counts = Tree(lm_scoring.DEPTH), collections.Counter()
    for d, t in rows:
        if not held[d]:
            tree.learn((t or "").encode())
            counts.update([*(t or "").encode().lower().split(), None])
    tree.finish()
    tokens, distinct = sum(counts.values()), len(counts)
    expected = []
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[x] + 1) / (tokens + distinct + 1)) for x in w)
        expected.append((str(d), held[d], len(w), sum(counts[x] > 0 for x in w), tokens, round(base, 6), round(tree.log10((t or "").encode()), 6)))
    mine = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(mine) == sorted(expected)


def test_probabilities_of_a_byte_sum_to_one(spark):
    """After a known and an unknown context."""
    context = b"w1 w"
    grams = [int.from_bytes(c + bytes([b]), "big") for c in (context, b"zzzz") for b in range(256)]
    counts = {g: (i * 7) % 5 for i, g in enumerate(grams[:256])} | {g: 0 for g in grams[256:]}
    model = lm_scoring.gram_model(spark.createDataFrame(list(counts.items()), "gram long, n long"))
    p = {r.gram: 10**r.log10_p for r in model.collect()}
    for part in (grams[:256], grams[256:]):
        assert abs(sum(p[g] for g in part) - 1) < 1e-9


def test_empty_and_untrained(spark):
    empty = frame(spark, []).withColumn("held_out", F.lit(False))
    assert lm_scoring.score(empty).count() == 0
    only = frame(spark, [(1, "some text"), (2, None)]).withColumn("held_out", F.lit(True))
    got = {r.doc_id: r for r in lm_scoring.score(only).collect()}
    # Nothing was learnt: every decision is even.
    assert abs(got[1].score - 10 * 8 * math.log10(0.5)) < 1e-9 and got[2].n_tokens == 1 and got[1].train_tokens == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 2.0, 7.25, 100.5, 1e6])
    assert np.allclose(lm_scoring.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
