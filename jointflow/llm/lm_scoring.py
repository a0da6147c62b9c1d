"""Code length of texts by context-tree weighting over bytes, with a unigram baseline of words beside it.

A byte is eight binary decisions; each decision has a context tree of its own over the bytes before it. A node of
the tree holds how often its decision was 0 and 1 in the training texts and estimates by Krichevsky and Trofimov;
its weighted probability is the even mixture of that estimate and the product of its children's
(``DEPTH`` bytes of context at the leaves). Scoring follows the decisions of a text down the trees and
mixes the estimates of all depths by the weights that training left, so every text is scored by one and the
same model and the probabilities of all texts sum to one (0xFF ends a text).

All counts are of whole corpora: grams (context and byte) are counted once per block of documents and summed by
shuffle; all shallower counts are sums of those. Trees are built in groups by the last two context bytes (256^3 grams
each at most, by construction); the depths above them have 65,792 nodes at most and pass through the driver.
Documents are scored block by block, each beside the log-probabilities of the grams and the counts of the words
that the block holds, so no table that grows with the corpus is sent anywhere whole.

Null texts count as empty (one end), a null doc_id is never held out, repeated rows repeat their result
and count each time, an empty table gives an empty table, and extra columns are left out of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointflow.llm.common import crc_mod, whole_text
from jointflow.llm.grams import Lookup, byte_grams, chunks, sums
from jointflow.session import written

DEPTH = 4
ROOTS = 2  # depths above the groups
#: Bytes of text in a block, about.
BLOCK_BYTES = 16_000_000
TEXT_CHUNK = 2_000_000
#: Groups of trees for each of which one task call is made.
GROUPS = 512


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function of x >= 0.5, by Stirling's series at x + 8."""
    y = x + 8.0
    shift = x.copy()
    for k in range(1, 8):
        shift = shift * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of n0 zeros and n1 ones by the estimator of Krichevsky and Trofimov."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Trees:
    """The nodes of sorted distinct grams from the leaves up to ``top`` bytes of context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, top: int, depth: int) -> None:
        self.top, self.depth = top, depth
        self.level: dict[int, tuple] = {}
        self.rows = {depth: np.arange(len(grams))}  # of each gram: its row on a level
        below: list | None = None
        for d in range(depth, top - 1, -1):
            if d < depth:
                short, inverse = np.unique(grams & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
                counts = np.bincount(inverse, counts, len(short))
                self.rows[d] = inverse[self.rows[d + 1]]
                grams = short
            nodes = []
            for k in range(8):
                ids = grams >> (8 - k)
                first = np.flatnonzero(np.diff(ids, prepend=-1))
                node = np.cumsum(np.diff(ids, prepend=-1) != 0) - 1
                ones = np.add.reduceat(counts * ((grams >> (7 - k)) & 1), first)
                total = np.add.reduceat(counts, first)
                own = log_kt(total - ones, ones)
                if below is None:
                    weighted, share = own, np.ones(len(own))
                else:
                    child_ids, child_weighted = below[k]
                    parent = np.searchsorted(ids[first], child_ids & ((1 << 8 * d + k) - 1))
                    deeper = np.bincount(parent, child_weighted, len(first))
                    weighted = math.log(0.5) + np.logaddexp(own, deeper)
                    share = np.exp(math.log(0.5) + own - weighted)
                nodes.append((ids[first], weighted, node, (ones + 0.5) / (total + 1.0), share, total, ones))
            below = [(x[0], x[1]) for x in nodes]
            self.level[d] = (grams, nodes)

    def log2_probability(self, bytes_: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of each gram's last byte after its context. ``above``: per decision, mixture and rest from the roots."""
        result = np.zeros(len(bytes_))
        for k in range(8):
            bit = (bytes_ >> (7 - k)) & 1
            mixed, rest = above[k]
            mixed, rest = mixed.copy(), rest.copy()
            for d in range(self.top, self.depth + 1):
                _, _, node, one, share, _, _ = self.level[d][1][k]
                at = node[self.rows[d]]
                p = np.where(bit == 1, one[at], 1 - one[at])
                mixed += rest * share[at] * p
                rest *= 1 - share[at]
            result += np.log2(mixed)
        return result


def blocks_of(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` with ``block``, such that blocks hold about ``block_bytes`` of text each."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / block_bytes))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def occurrences(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(block, gram or word, n): everything a block holds, and how often its training documents have it."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        grams: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        words: dict[bytes, int] = {}
        for held in (True, False):
            part = table.filter(pa.compute.equal(table["held_out"], held)).column("text")
            for at in range(0, len(part), 512):
                texts = [t.encode() for t in part.slice(at, 512).to_pylist()]
                for chunk in chunks(texts, TEXT_CHUNK):
                    found, n = np.unique(byte_grams(chunk, depth)[0], return_counts=True)
                    grams.append(found)
                    counts.append(n * (not held))
                    for t in chunk:
                        for x in t.lower().split():
                            words[x] = words.get(x, 0) + (not held)
                if len(grams) > 16:
                    grams, counts = ([x] for x in _merged(grams, counts))
        all_grams, all_counts = _merged(grams, counts)
        schema = pa.schema([("block", pa.int32()), ("gram", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
        g, w = len(all_grams), len(words)
        columns = [
            pa.array(np.full(g + w, block, np.int32)),
            pa.concat_arrays([pa.array(all_grams, pa.int64()), pa.nulls(w, pa.int64())]),
            pa.concat_arrays([pa.nulls(g, pa.string()), pa.array([x.decode() for x in words], pa.string())]),
            pa.array(np.concatenate([all_counts, np.fromiter(words.values(), np.int64, w)]), pa.int64()),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return docs.select("block", "held_out", "text").groupBy("block").applyInArrow(run, "block int, gram long, word string, n long")


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)


def gram_model(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, log10_p) for all rows of ``counts`` (gram, n), each a distinct gram."""
    grouped = counts.withColumn("group", F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(GROUPS)))

    def up(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("gram")
        trees = Trees(frame["gram"].to_numpy(), frame["n"].to_numpy().astype(float), ROOTS, depth)
        out = []
        for k, (ids, weighted, _, _, _, total, ones) in enumerate(trees.level[ROOTS][1]):
            parent = ids & ((1 << 8 * (ROOTS - 1) + k) - 1)  # context of one byte, and the byte's first k bits
            out.append(pd.DataFrame({"k": k, "node": parent, "total": total, "ones": ones, "weighted": weighted}))
        return pd.concat(out).groupby(["k", "node"], as_index=False).sum()

    # At most 8 * 65,536 rows, whatever the corpus.
    tops = grouped.groupBy("group").applyInPandas(up, "k int, node long, total double, ones double, weighted double")
    tops = tops.groupBy("k", "node").agg(F.sum("total").alias("total"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted"))
    roots = root_tables(tops.toPandas())

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("gram")
        grams = frame["gram"].to_numpy()
        trees = Trees(grams, frame["n"].to_numpy().astype(float), ROOTS, depth)
        last = grams & 0xFF
        context = (grams >> 8) & 0xFF
        above = []
        for k in range(8):
            bit, prefix = (last >> (7 - k)) & 1, last >> (8 - k)
            (one0, share0), (one1, share1) = roots[k]
            p0 = np.where(bit == 1, one0[prefix], 1 - one0[prefix])
            at = (context << k) | prefix
            p1 = np.where(bit == 1, one1[at], 1 - one1[at])
            rest = 1 - share0[prefix]
            above.append((share0[prefix] * p0 + rest * share1[at] * p1, rest * (1 - share1[at])))
        log2 = trees.log2_probability(last, above)
        return pd.DataFrame({"gram": grams, "log10_p": log2 * math.log10(2)})

    return grouped.groupBy("group").applyInPandas(down, "gram long, log10_p double")


def root_tables(tops: pd.DataFrame) -> list[tuple]:
    """Per decision k: (probability of a one, share of the own estimate) of the nodes without context and with one byte."""
    tables = []
    for k in range(8):
        rows = tops[tops["k"] == k]
        one1, share1 = np.full(256 << k, 0.5), np.full(256 << k, 0.5)
        own = log_kt((rows["total"] - rows["ones"]).to_numpy(), rows["ones"].to_numpy())
        weighted = math.log(0.5) + np.logaddexp(own, rows["weighted"].to_numpy())
        node = rows["node"].to_numpy()
        one1[node] = (rows["ones"] + 0.5) / (rows["total"] + 1.0)
        share1[node] = np.exp(math.log(0.5) + own - weighted)
        size = 1 << k
        prefix = node & (size - 1)
        total = np.bincount(prefix, rows["total"], size)
        ones = np.bincount(prefix, rows["ones"], size)
        own0 = log_kt(total - ones, ones)
        weighted0 = math.log(0.5) + np.logaddexp(own0, np.bincount(prefix, weighted, size))
        tables.append((((ones + 0.5) / (total + 1.0), np.exp(math.log(0.5) + own0 - weighted0)), (one1, share1)))
    return tables


def score(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text, held_out), learning from the rows not held out."""
    docs = docs.select("doc_id", whole_text("text").alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    docs, n_blocks = blocks_of(docs, block_bytes)
    found = written(occurrences(docs, depth), "lm-occurrences")
    grams = found.where("gram is not null")
    words = found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
    words = written(words, "lm-words")
    ends = docs.where("not held_out").count()
    stats = words.where("n > 0").agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    tokens = (stats["tokens"] or 0) + ends
    distinct = stats["distinct"] + (ends > 0)
    model = gram_model(written(grams.groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams"), depth)
    known = grams.join(model, "gram").select("block", "gram", F.lit(None).cast("string").alias("word"), F.col("log10_p").alias("value"))
    seen = words.select(F.explode("blocks").alias("block"), F.lit(None).cast("long").alias("gram"), "word", F.col("n").cast("double").alias("value"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        has = pa.compute.is_valid(right["gram"])
        gram_rows, word_rows = right.filter(has), right.filter(pa.compute.invert(has))
        keys, values = gram_rows["gram"].to_numpy(), gram_rows["value"].to_numpy()
        order = np.argsort(keys)
        find, values = Lookup(keys[order]), values[order]
        index = {w.encode(): i for i, w in enumerate(word_rows["word"].to_pylist())}
        count = np.append(word_rows["value"].to_numpy(), ends).astype(np.int64)  # the end is a token too
        logs = np.log10((count + 1.0) / (tokens + distinct + 1.0))
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": [], "n_bytes": []}
        for at in range(0, left.num_rows, 512):
            texts = [t.encode() for t in left.column("text").slice(at, 512).to_pylist()]
            for chunk in chunks(texts, TEXT_CHUNK):
                codes, stops = byte_grams(chunk, depth)
                out["score"].extend(sums(values[find(codes)], stops).tolist())
                for t in chunk:
                    row = np.array([*map(index.__getitem__, t.lower().split()), len(index)], np.int64)
                    out["n_tokens"].append(len(row))
                    out["n_known"].append(int((count[row] > 0).sum()))
                    out["base_score"].append(float(logs[row].sum()))
                    out["n_bytes"].append(len(t))
        made = {
            "doc_id": left["doc_id"],
            "held_out": left["held_out"],
            "n_tokens": pa.array(out["n_tokens"], pa.int64()),
            "n_known": pa.array(out["n_known"], pa.int64()),
            "train_tokens": pa.array([tokens] * left.num_rows, pa.int64()),
            "base_score": pa.array(out["base_score"], pa.float64()),
            "score": pa.array(out["score"], pa.float64()),
            "bits_per_byte": pa.array([-s / math.log10(2) / (n + 1) for s, n in zip(out["score"], out["n_bytes"])], pa.float64()),
        }
        return pa.table(made)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return docs.groupBy("block").cogroup(known.unionByName(seen).groupBy("block")).applyInArrow(run, schema)
