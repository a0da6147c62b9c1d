"""Near-duplicate documents: an exact Jaccard join of five-word shingle sets by vertical partitioning.

Shingles are hashed to 64 bits; the hash is their global order. Texts with the same lower-cased words form one
class and take part once. The steps:

1. Of each class, the lowest three tenths (and one) of its shingles. Of these a class with a partner has at most ``spare``
   that turn up in no other class's: those the partner lacks, or those that shingles of the partner alone push out of
   its part. A class with more has no partner and drops out. That needs one count per shingle, summed before it is shuffled.
2. The sets of the remaining classes, cut along the global order into ``FRAGMENTS`` fragments.
3. Candidates share one of the first quarter of their shingles, rarest first (prefix filter), and from where they meet first
   enough shingles must be left for the similarity (positional filter): near copies that have changed too much leave
   the common buckets of their group. First each class is held only against the most central class of each
   bucket, so a group of n near copies costs about n pairs. A pair's overlap is counted fragment by
   fragment and summed.
4. Components of the links found. Then every pair of classes in different components that passes both filters is
   counted the same way, so no link between components is lost. Buckets in which all that could still meet are of one
   component make no pairs.

Null and empty texts and texts without words have no shingles and link with nothing; texts of fewer than five words have
one; a row with a null doc_id takes part as a document of its own, but its group is named after another row's
doc_id where there is one; rows that repeat a doc_id are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jointflow.llm.common import drop_caches, give_back, unused_names, whole_text
from jointflow.llm.components import components
from jointflow.session import discard, written

WIDTH = 5
#: Similarity as a fraction: shared shingles over all shingles of the two.
LEAST = (75, 100)
FRAGMENTS = 4
#: Shingles from which a quarter of them is a safe bound in the first step; below, the worst case is worked out.
TIGHT = 100
#: Remaining classes up to which their keys are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_CLASSES = 2_000_000
#: Remembered words of a task, in each of two generations.
CACHE_WORDS = 100_000

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes and the class key of texts."""

    def __init__(self, width: int) -> None:
        import xxhash

        self.width, self.hash = width, xxhash.xxh64_intdigest
        self.new: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        new, old = self.new, self.old
        if len(new) > CACHE_WORDS:
            self.old, self.new = new, {}
            new, old = self.new, self.old
        try:
            return np.array([new[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in new:
                    new[w] = old.get(w) or self.hash(w)
            return np.array([new[w] for w in words], np.uint64)

    def of(self, text: str) -> tuple[int, np.ndarray]:
        words = text.encode().lower().split()
        key = self.hash(b" ".join(words)) - (1 << 63)
        if not words:
            return key, np.zeros(0, np.int64)
        h, w = self.words(words), self.width
        with np.errstate(over="ignore"):
            n = max(1, len(h) - w + 1)
            acc = np.full(n, min(len(h), w), np.uint64)
            for k in range(min(len(h), w)):
                acc = _mix(acc * _P1 + h[k : k + n])
        return key, np.unique(acc.view(np.int64))


def lowest(n: int) -> int:
    """How many of n shingles stand for a class in the first step."""
    return min(n, n * 3 // 10 + 1 + (n >= 10))


def spare(n: int) -> int:
    """How many of the lowest shingles of a class of n that has a partner may be in no other class's, at most.

    With s shared, either up to n - s shingles the partner of size m lacks, or up to m - s of its own stand before the
    shared ones, which leaves lowest(m) - (m - s) of those in its part. From ``TIGHT`` on the second is
    0.2334 n + 0.9 at most, which is less than a quarter of n, rounded down.
    """
    least, most = LEAST
    if n >= TIGHT:
        return n // 4
    worst = 0
    for m in range(-(-n * least // most), n * most // least + 1):
        shared = -(-(n + m) * least // (least + most))
        own, pushed = min(n - shared, lowest(n)), min(m - shared, lowest(m))
        worst = max(worst, own, lowest(n) - lowest(m) + pushed)
    return worst


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """A row (doc_id, row, key, n) for each document, and rows (key, shingle) of its lowest shingles."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"), F.xxhash64("doc_id", "text").alias("row")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        shingler = Shingler(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys, sizes, low = [], [], {}
                for text in batch.column("text").to_pylist():
                    key, found = shingler.of(text)
                    keys.append(key)
                    sizes.append(len(found))
                    if len(found):
                        low[key] = found[: lowest(len(found))]
                flat = np.concatenate([np.zeros(0, np.int64), *low.values()])
                of = np.repeat(np.array(list(low), np.int64), [len(x) for x in low.values()])
                n, m = len(keys), len(flat)
                columns = [
                    pa.concat_arrays([batch.column("doc_id"), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([batch.column("row"), pa.nulls(m, pa.int64())]),
                    pa.array(np.concatenate([np.array(keys, np.int64), of])),
                    pa.concat_arrays([pa.array(sizes, pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(flat)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "key", "n", "shingle"])
        whole = batch = columns = low = flat = of = shingler = None
        give_back()

    return rows.mapInArrow(run, "doc_id long, row long, key long, n long, shingle long")


def _sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(key, n, fragment, shingles): the sets of ``classes`` (doc_id, row, key) in order, cut by hash range."""
    rows = docs.select(whole_text("text").alias("text"), F.xxhash64("doc_id", "text").alias("row"))
    few = classes.count() <= BROADCAST_CLASSES
    rows = rows.join(F.broadcast(classes.select("row")) if few else classes.select("row"), "row", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        shingler = Shingler(width)
        inner = [int((f << 64) // FRAGMENTS - (1 << 63)) for f in range(1, FRAGMENTS)]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out: dict[str, list] = {"key": [], "n": [], "fragment": [], "shingles": []}
                for text in whole.slice(at, 256).column("text").to_pylist():
                    key, found = shingler.of(text)
                    for f, part in enumerate(np.split(found, np.searchsorted(found, inner))):
                        if len(part):
                            out["key"].append(key)
                            out["n"].append(len(found))
                            out["fragment"].append(f)
                            out["shingles"].append(part)
                yield pa.RecordBatch.from_pydict(
                    out, schema=pa.schema([("key", pa.int64()), ("n", pa.int64()), ("fragment", pa.int32()), ("shingles", pa.list_(pa.int64()))])
                )
        whole = out = found = part = shingler = None
        give_back()

    made = written(rows.select("text").mapInArrow(run, "key long, n long, fragment int, shingles array<long>"), "shingle-sets")
    twice = made.groupBy("key", "fragment").count().where("count > 1")  # of a row that comes twice
    if twice.isEmpty():
        return made
    once = written(made.dropDuplicates(["key", "fragment"]), "shingle-sets")
    discard(made)
    return once


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: partial overlaps by fragment, summed."""
    a = sets.select(F.col("key").alias("a"), "fragment", F.col("shingles").alias("sa"))
    b = sets.select(F.col("key").alias("b"), "fragment", F.col("shingles").alias("sb"))
    partial = pairs.join(a, "a").join(b, ["b", "fragment"])
    partial = partial.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("shared"))
    shared = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    union = F.col("na") + F.col("nb") - F.col("shared")
    return shared.where(LEAST[1] * F.col("shared") >= LEAST[0] * union).select("a", "b")


def _may_link(ra, na, rb, nb):
    """Whether two sets that meet first where they have ``ra`` and ``rb`` shingles left can be similar enough."""
    return (LEAST[0] + LEAST[1]) * F.least(ra, rb) >= LEAST[0] * (F.col(na) + F.col(nb))


def _prefixes(sets: DataFrame) -> DataFrame:
    """(shingle, key, n, left, own): each set's first shingles, rarest first, that other sets have too.

    ``left`` counts the set's shingles from this one on, ``own`` those of the set alone. Of n shingles every similar set has
    one of the first n - ceil(3/4 n) + 1.
    """
    every = sets.select("key", F.explode("shingles").alias("shingle"))
    counts = every.groupBy("shingle").agg(F.count("*").alias("classes"))
    order = Window.partitionBy("key").orderBy("classes", "shingle")
    sizes = sets.groupBy("key").agg(F.first("n").alias("n"))
    ranked = every.join(counts, "shingle").withColumn("place", F.row_number().over(order) - 1)
    alone = F.sum((F.col("classes") == 1).cast("int")).over(Window.partitionBy("key"))
    ranked = ranked.withColumn("own", alone).where("classes > 1").join(sizes, "key")
    front = F.col("place") <= F.col("n") - F.ceil(F.col("n") * LEAST[0] / LEAST[1])
    return ranked.where(front).select("shingle", "key", "n", (F.col("n") - F.col("place")).alias("left"), "own")


def _star_pairs(members: DataFrame) -> DataFrame:
    """(a, b, na, nb): every class against the class with the smallest share of its own shingles in each bucket."""
    central = F.struct((F.col("own") / F.col("n")).alias("share"), "key", "n", "left")
    tops = members.groupBy("shingle").agg(F.min(central).alias("top"))
    pairs = members.join(tops, "shingle").where("key <> top.key")
    pairs = pairs.select(
        F.col("top.key").alias("a"), F.col("key").alias("b"), F.col("top.n").alias("na"), F.col("n").alias("nb"),
        F.col("top.left").alias("ra"), F.col("left").alias("rb"),
    )
    return pairs.where(_may_link("ra", "na", "rb", "nb")).select("a", "b", "na", "nb").distinct()


def _pairs_over_components(members: DataFrame) -> DataFrame:
    """(a, b, na, nb): all pairs of classes in different components that may be similar."""
    # A class stays in a bucket while it may link to the smallest class there, and the one with most left to it.
    reach = (LEAST[0] + LEAST[1]) * F.col("left") - LEAST[0] * F.col("n")
    members = members.withColumn("reach", reach)
    bounds = members.groupBy("shingle").agg(F.min("n").alias("smallest"), F.max("reach").alias("furthest"))
    members = members.join(bounds, "shingle").where((F.col("reach") >= LEAST[0] * F.col("smallest")) & (F.col("furthest") >= LEAST[0] * F.col("n")))
    members = written(members.select("shingle", "key", "n", "left", "component"), "shingle-reach")
    mixed = members.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rest = members.join(mixed.select("shingle"), "shingle", "left_semi")
    side = lambda x: rest.select("shingle", *[F.col(c).alias(n + x) for c, n in (("key", ""), ("n", "n"), ("left", "r"), ("component", "c"))])
    pairs = side("a").join(side("b"), "shingle").where("a < b and ca <> cb").where(_may_link("ra", "na", "rb", "nb"))
    return pairs.select("a", "b", "na", "nb").distinct()


def similar_classes(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (doc_id, row, key, n) and (node, component) of the class keys that have a partner."""
    found = written(_signatures(docs, width), "shingle-signatures")
    rows = written(found.where("n is not null").select("doc_id", "row", "key", "n"), "shingle-rows")
    classes = rows.where("n > 0").groupBy("key").agg(F.min(F.struct("row", "n")).alias("one"))
    classes = classes.select("key", "one.row", "one.n")
    # Shingles of one class only: the least and the greatest class agree, which needs partial minima only.
    alone = found.where("shingle is not null").groupBy("shingle").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    alone = alone.where("key = last").groupBy("key").agg(F.count("*").alias("alone"))
    kept = classes.join(alone, "key", "left").fillna(0, ["alone"])
    small = F.element_at(F.array(*[F.lit(spare(n)) for n in range(1, TIGHT)]), F.col("n").cast("int"))
    bound = F.when(F.col("n") < TIGHT, small).otherwise(F.floor(F.col("n") / 4))
    kept = written(kept.where(F.col("alone") <= bound).where("alone < n"), "shingle-classes")
    discard(found)
    sets = _sets(docs, kept, width)
    members = written(_prefixes(sets), "shingle-prefixes")
    links = written(_linked(_star_pairs(members), sets), "shingle-links")
    joined = written(components(links), "shingle-components").withColumnRenamed("node", "key")
    named = members.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    more = written(_linked(_pairs_over_components(named), sets), "shingle-more")
    discard(sets, members)
    return rows, components(links.unionByName(more))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) of every row: the least doc_id reachable over links, itself included.

    ``row`` is xxhash64 of doc_id and text.
    """
    rows, joined = similar_classes(docs, width)
    rows = rows.join(joined.withColumnRenamed("node", "key"), "key", "left")
    # Rows of a class share its set; texts without words stand alone.
    rows = rows.withColumn("class", F.when(F.col("n") > 0, F.coalesce("component", "key")))
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "class", "left")
    return rows.select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of each group of near-duplicates, the least by doc_id (nulls last), with all columns of ``docs``.

    Rows whose text is null or has no words link with nothing: they all stay, repeated ones as well.
    """
    rows, joined = similar_classes(docs, width)
    rows = rows.join(joined.withColumnRenamed("node", "key"), "key", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row"))
    row, copy = unused_names(docs, "row", "copy")
    stay = rows.where("n > 0").groupBy(F.coalesce("component", "key").alias("group")).agg(first.alias("one"))
    stay = written(stay.select(F.col("one.row").alias(row)), "kept-rows")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.where(worded).withColumn(row, F.xxhash64("doc_id", "text")).join(stay, row)
    number = F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0)))
    kept = kept.withColumn(copy, number).where(F.col(copy) == 1).drop(row, copy)
    return kept.unionByName(docs.where(~worded))
