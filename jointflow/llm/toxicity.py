"""Toxicity by two Kneser-Ney models of bytes, one of toxic and one of ordinary texts.

Texts are lower-cased (A-Z); a gram is ``DEPTH`` bytes of context and the next byte, zeros stand before a text and
0xFF ends it. Both classes discount their own counts and share the mass left over by one Kneser-Ney backoff
model of continuation counts, taken from the texts of both classes: what is rare in a class looks alike in
both and doesn't speak for either. The difference of the two log-likelihoods per byte becomes a score by a
logistic curve fitted on training documents kept out of the counts.

Counts cover all labelled training documents: those kept out for the curve are added once it is fitted. The log ratios of grams and contexts form a table that is cut by
hash of the context into slices of about ``SLICE_ROWS`` rows at most; each slice is sent to the executors in turn, and
as a gram and its context lie in one slice, partial sums add up to the same score for any number of slices.

Rows with a null doc_id or label teach nothing, a document with several labels counts once with the
largest, null texts count as empty, an empty text is scored by its end alone, repeated rows repeat their result, and
without both classes in training all scores are the share of toxic training documents (0.5 without any).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointflow.llm.common import append_columns, drop_caches, crc_mod, give_back, lower_ascii, whole_text
from jointflow.llm.grams import Lookup, byte_grams, chunks, sums
from jointflow.session import written

DEPTH = 4
DISCOUNT = 0.75
SLICE_ROWS = 4_000_000
#: Rows of labels up to which they are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Training documents the curve is fitted on, at most: half of them toxic, half ordinary, weighted by the true shares.
FIT_ROWS = 20_000
#: One of so many training documents of each class (one at least) is kept out of the counts until the curve is fitted.
FIT_SHARE = 8
#: Bytes of texts that are counted, and that are scored, at a time.
TEXT_CHUNK, SCORE_CHUNK = 4_000_000, 1_000_000


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (text, toxic, hash of the doc_id): labelled, and not held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.where(F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
    rows = rows.select("doc_id", lower_ascii(whole_text("text")).alias("text")).join(known, "doc_id")
    return rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("hash"))


def lowest_hashes(ids: DataFrame, sizes: dict[int, int]) -> Column:
    """Whether a row is of one of the ``sizes[c]`` documents of its class c that have the lowest hashes in the table."""
    found = F.lit(False)
    for c, n in sizes.items():
        last = ids.where(F.col("toxic") == c).select("hash").orderBy("hash").limit(n).agg(F.max("hash")).first()[0]
        found = found | ((F.col("toxic") == c) & (F.col("hash") <= last))
    return found


def count_grams(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Counts of each gram in ordinary (``n0``) and toxic (``n1``) texts: summed in each task, then by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for c in (0, 1):
                texts = table.filter(pa.compute.equal(table["toxic"], c)).column("text").to_pylist()
                for chunk in chunks([t.encode() for t in texts], TEXT_CHUNK):
                    grams, n = np.unique(byte_grams(chunk, depth)[0], return_counts=True)
                    zero = np.zeros(len(n), np.int64)
                    counts = (n, zero) if c == 0 else (zero, n)
                    yield pa.RecordBatch.from_pydict({"gram": grams.astype(np.int64), "n0": counts[0], "n1": counts[1]})
        batch = table = texts = chunk = grams = n = zero = counts = None
        give_back()

    made = rows.select("text", "toxic").mapInArrow(run, "gram long, n0 long, n1 long")
    return made.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shared_backoff(counts: DataFrame, depth: int = DEPTH, discount: float = DISCOUNT) -> DataFrame:
    """(gram, p): the shared Kneser-Ney probability of the last byte after ``depth - 1`` bytes of context.

    A gram's count on a lower order is the number of different bytes seen before it, in either class.
    """
    grams = {depth: counts.select("gram")}
    levels = {}
    for order in range(depth - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        levels[order] = grams[order + 1].groupBy(shorter.alias("gram")).agg(F.count("*").alias("n"))
        levels[order] = grams[order] = written(levels[order], f"toxic-order{order}")
    below = None
    for order in range(depth):
        level = levels[order].withColumn("context", F.shiftright("gram", 8))
        totals = level.groupBy("context").agg(
            F.sum("n").alias("total"), F.sum(F.least(F.col("n"), F.lit(discount))).alias("left")
        )
        level = level.join(totals, "context")
        if below is None:
            lower, level = F.lit(1 / 257), level
        else:
            level = level.withColumn("key", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)))
            level = level.join(below.select(F.col("gram").alias("key"), F.col("p").alias("q")), "key")
            lower = F.col("q")
        p = (F.greatest(F.col("n") - discount, F.lit(0.0)) + F.col("left") * lower) / F.col("total")
        below = written(level.select("gram", p.alias("p")), f"toxic-shared{order}")
    return below


def log_ratios(counts: DataFrame, depth: int = DEPTH, discount: float = DISCOUNT) -> DataFrame:
    """(key, ratio): log toxic over ordinary probability of seen grams, and of unseen bytes after seen contexts.

    Keys of contexts have their own bit above those of grams.
    """
    shared = shared_backoff(counts, depth, discount)
    rows = counts.withColumn("context", F.shiftright("gram", 8))
    rows = rows.withColumn("key", F.col("gram").bitwiseAND(F.lit((1 << 8 * depth) - 1)))
    sums = [F.sum(f"n{c}").alias(f"total{c}") for c in (0, 1)]
    sums += [F.sum(F.least(F.col(f"n{c}"), F.lit(discount))).alias(f"left{c}") for c in (0, 1)]
    totals = rows.groupBy("context").agg(*sums)
    rest = [F.when(F.col(f"total{c}") > 0, F.col(f"left{c}") / F.col(f"total{c}")).otherwise(1.0) for c in (0, 1)]
    totals = written(totals.withColumns({"rest0": rest[0], "rest1": rest[1]}), "toxic-contexts")
    rows = rows.join(totals, "context").join(shared.select(F.col("gram").alias("key"), "p"), "key")
    own = [
        F.when(F.col(f"total{c}") > 0, F.greatest(F.col(f"n{c}") - discount, F.lit(0.0)) / F.col(f"total{c}")).otherwise(0.0)
        + F.col(f"rest{c}") * F.col("p")
        for c in (0, 1)
    ]
    grams = rows.select("context", F.col("gram").alias("key"), F.log(own[1] / own[0]).alias("ratio"))
    key = F.col("context") + F.lit(1 << 8 * (depth + 1))
    contexts = totals.select("context", key.alias("key"), F.log(F.col("rest1") / F.col("rest0")).alias("ratio"))
    return written(grams.unionByName(contexts), "toxic-ratios")


def _slices(ratios: DataFrame, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their ratios, a bounded slice at a time; a gram and its context share a slice."""
    n = max(1, math.ceil(ratios.count() / rows))
    for i in range(n):
        part = ratios if n == 1 else ratios.where(F.pmod(F.xxhash64("context"), F.lit(n)) == i)
        table = part.select("key", "ratio").toArrow()
        keys, values = table.column("key").to_numpy(), table.column("ratio").to_numpy()
        order = np.argsort(keys)
        yield keys[order], values[order].astype(np.float32)


def add_ratio(
    df: DataFrame, ratios: DataFrame, depth: int = DEPTH, slice_rows: int = SLICE_ROWS, sent: list | None = None
) -> DataFrame:
    """``df`` with ``log_ratio``: toxic minus ordinary log-likelihood per byte (end included) of each whole text.

    ``sent`` gets the broadcast slices, for the caller to destroy once the result has been used.
    """
    made = df.withColumn("log_ratio", F.lit(0.0))
    for keys, values in _slices(ratios, slice_rows):
        model = df.sparkSession.sparkContext.broadcast((keys, values))
        if sent is not None:
            sent.append(model)
        made = _add_slice(made, model, depth)
    return made


def _add_slice(df: DataFrame, model, depth: int) -> DataFrame:
    def make():
        keys, values = model.value
        find = Lookup(keys)

        def of_batch(table: pa.Table) -> list[pa.Array]:
            texts = [(t or "").encode().lower() for t in table.column("text").to_pylist()]
            means = [np.zeros(0)]
            for chunk in chunks(texts, SCORE_CHUNK):
                grams, ends = byte_grams(chunk, depth)
                at = find(grams)
                value = np.where(at >= 0, values[at], 0.0)
                missing = np.flatnonzero(at < 0)
                at = find((grams[missing] >> 8) + (1 << 8 * (depth + 1)))
                value[missing] = np.where(at >= 0, values[at], 0.0)
                means.append(sums(value, ends) / np.diff(ends, prepend=0))
            return [pa.array(np.concatenate(means), pa.float64())]

        return of_batch

    added = append_columns(df, [T.StructField("_part", T.DoubleType())], make)
    return added.withColumn("log_ratio", F.col("log_ratio") + F.col("_part")).drop("_part")


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x, rows weighted, by Newton steps: intercept and slope per unit of x.

    The slope per standard deviation has a normal prior of variance one, so a few documents alone make no steep curve.
    """
    pull = np.array([1e-3, 1.0])
    scale = float(np.std(x)) or 1.0
    features = np.stack([np.ones(len(x)), x / scale], 1)
    weights = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (weight * (y - p)) - pull * weights
        bend = (features * (weight * p * (1 - p))[:, None]).T @ features + np.diag(pull)
        weights = weights + np.clip(np.linalg.solve(bend, slope), -5, 5)
    return float(weights[0]), float(weights[1] / scale)


def add_toxicity(df: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``df`` (with a column ``text``) with ``score`` (0 to 1) and ``predicted`` (0 or 1), learnt from ``docs`` and ``labels``.

    Columns named ``log_ratio``, ``score`` or ``predicted`` are replaced.
    """
    rows = labelled(docs, labels)
    ids = written(rows.groupBy("hash", "toxic").agg(F.count("*").alias("n")), "toxic-training")
    sizes = {r["toxic"]: r for r in ids.groupBy("toxic").agg(F.count("*").alias("docs"), F.sum("n").alias("rows")).collect()}
    if len(sizes) < 2:
        df = df.withColumn("score", F.lit(float(*sizes) if sizes else 0.5))
    else:
        half = max(1, FIT_ROWS // 2)
        whole = any(r["docs"] < 2 for r in sizes.values())  # a class of one document is counted and fits the curve
        take = {c: min(half, r["docs"] if whole else max(1, r["docs"] // FIT_SHARE)) for c, r in sizes.items()}
        rows = rows.withColumn("fit", lowest_hashes(ids, take))
        counts = written(count_grams(rows if whole else rows.where("not fit")), "toxic-counts")
        ratios = log_ratios(counts)
        once = rows.where("fit").groupBy("hash", "toxic").agg(F.min("text").alias("text"))
        sent: list = []
        seen = add_ratio(once, ratios, sent=sent).select("log_ratio", "toxic").toArrow()
        for model in sent:
            model.destroy()
        x, y = (seen.column(c).to_numpy() for c in ("log_ratio", "toxic"))
        share = sizes[1]["rows"] / (sizes[0]["rows"] + sizes[1]["rows"])
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        base, slope = fit_curve(x, y, weight)
        if not whole:  # the scores take what was kept out for the curve into the counts
            every = counts.unionByName(count_grams(rows.where("fit"))).groupBy("gram")
            ratios = log_ratios(written(every.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-counts"))
        z = F.lit(base) + F.lit(slope) * F.col("log_ratio")
        df = add_ratio(df, ratios).withColumn("score", 1 / (1 + F.exp(-z))).drop("log_ratio")
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
