"""How filters of a document corpus overlap: what each one removes, alone, in every order, and at which cost.

Each document fails some of a few filters; the failures are bits of one number. Filters A to D look at a text alone. E fails
a text that some document with a smaller doc_id also has, removed or not: an existential self-join, that is, a left semi
join on the text's hash, the text itself and the smaller doc_id, which asks whether such a document exists and makes no pairs.
Its right side is aggregated to the least doc_id of every text first. Its ids are united with the ids that fail the others,
bits are combined for each id, and documents are counted by part, combination and labels. All orders of filters
are replayed on these few counts alone.

A text of very many copies would meet in one task. Hashes that hold more than one row in ``1 / HOT_SHARE`` are dealt over ``SALTS``
tasks: within a salt the join runs as usual, and the least rows of the salts (one for each hot text and salt) run it once more
among themselves. At most ``HOT_SHARE`` hashes can be hot, so their list is broadcast whatever the size of the table.

A null text counts as empty. A null doc_id is no number: such rows neither fail E nor make others fail it, and have no labels.
Rows with one doc_id and one text count as many documents as there are rows; equal doc_ids are not smaller. A document with several
label rows has a label that any of them has. A null part is the empty string. An empty table gives an empty table. Columns other than
those asked for are not looked at. Ids are told apart by doc_id and a 64-bit hash of the text, so a hash matters only between texts
under one doc_id; E itself compares whole texts.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointflow.llm.common import whole_text
from jointflow.session import written

FILTERS = "ABCDE"
HOT_SHARE = 1_000
SALTS = 64

_SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a whole text fails A (few words), B (repeated words), C (capitals), D (symbols)."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def repeated_ids(texts: DataFrame, hot: DataFrame) -> DataFrame:
    """``(doc_id, hash)`` of rows of ``texts`` (doc_id, hash, text) whose text a smaller doc_id has; no id comes back
    for another reason, some may come twice. ``hot``: hashes of very many rows, ``HOT_SHARE`` at most."""
    known = texts.where("doc_id is not null").join(F.broadcast(hot.withColumn("hot", F.lit(True))), "hash", "left")
    # Never null, so no filter is put below one side alone.
    salt = F.coalesce(F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), F.lit(-1))
    salted = known.select("hash", salt.alias("salt"), "text", "doc_id")
    dealt = salted.repartition("hash", "salt", "text")
    least = dealt.groupBy("hash", "salt", "text").agg(F.min("doc_id").alias("least"))
    # Both sides read one shuffle of the texts: the planner would move a semi join below the shuffle of its left side,
    # but not past a column of running numbers.
    a, b = dealt.withColumn("row", F.monotonically_increasing_id()).alias("a"), least.alias("b")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.text") == F.col("b.text"))
    within = a.join(b, same & (F.col("b.least") < F.col("a.doc_id")) & (F.col("a.row") >= 0), "left_semi").select("doc_id", "hash")
    # The least rows of the salts of a hot text, against the least of them all; each task sends few of them.
    ends = salted.where("salt >= 0").groupBy("hash", "salt", "text").agg(F.min("doc_id").alias("least"))
    first = ends.groupBy("hash", "text").agg(F.min("least").alias("least"))
    a, b = ends.alias("a"), first.alias("b")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.text") == F.col("b.text"))
    across = a.join(b, same & (F.col("b.least") < F.col("a.least")), "left_semi")
    return within.unionByName(across.select(F.col("least").alias("doc_id"), "hash"))


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``(doc_id, hash, part, failed)`` for every row of ``docs``; ``failed`` has bit 0 for A to bit 4 for E."""
    text = whole_text("text")
    hashed = docs.select(
        F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("hash")
    )
    bits = [F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in text_failures(F.col("text")).items()]
    rows = written(hashed.select("doc_id", "hash", "part", sum(bits[1:], bits[0]).alias("failed")), "filter-failures")
    total = rows.count()
    hot = rows.groupBy("hash").count().where(F.col("count") * HOT_SHARE > total).select("hash")
    repeated = repeated_ids(hashed.select("doc_id", "hash", "text"), hot)
    ids = (
        rows.where("doc_id is not null")
        .select("doc_id", "hash", "failed")
        .unionByName(repeated.withColumn("failed", F.lit(1 << FILTERS.index("E"))))
        .groupBy("doc_id", "hash")
        .agg(F.bit_or("failed").alias("failed"))
    )
    known = rows.where("doc_id is not null").drop("failed").join(ids, ["doc_id", "hash"])
    return known.select("doc_id", "hash", "part", "failed").unionByName(rows.where("doc_id is null"))


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, failed, good, toxic, n)``: documents by part, combination of failures and labels."""
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows without an id meet no label; a second key spreads them.
    spread = F.when(F.col("doc_id").isNull(), F.col("hash")).otherwise(F.lit(0))
    joined = failed.withColumn("spread", spread).join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return joined.select("part", "failed", *marks).groupBy("part", "failed", "good", "toxic").agg(F.count("*").alias("n"))


def replay(counts: DataFrame) -> DataFrame:
    """Every order of the filters on the counts of :func:`combinations`: one row per part, order and step."""
    steps = [
        {
            "filter_order": "".join(order),
            "step": k + 1,
            "before": sum(1 << FILTERS.index(f) for f in order[:k]),
            "own": 1 << FILTERS.index(order[k]),
        }
        for order in permutations(FILTERS)
        for k in range(len(order))
    ]
    # One literal; an array of columns takes the planner far longer.
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, own: int>>")
    combo = F.col("failed")
    gone, fails = combo.bitwiseAND(F.col("before")) != 0, combo.bitwiseAND(F.col("own")) != 0
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")
    replayed = (
        counts.select("*", F.inline(listed))
        .groupBy("part", "filter_order", "step", "own")
        .agg(
            total(~gone & ~fails).alias("kept"),
            total(~gone & fails).alias("removed"),
            total(gone & fails).alias("redundant"),
            total(combo == F.col("own")).alias("unique_fails"),
            total(~gone & fails & F.col("good")).alias("good_lost"),
            total(~gone & fails & F.col("toxic")).alias("toxic_lost"),
        )
    )
    share = F.sum("removed").over(Window.partitionBy("part", "own"))
    return replayed.withColumn("shapley", share).drop("own")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """What every filter removes at every step of every order, for each part of ``docs``."""
    return replay(combinations(failures(docs, part), labels))


def oracle() -> str:
    return r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
failed AS (
    SELECT part, doc_id,
        len(w) < 200 AS a,
        100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > (SELECT min(t.doc_id) FROM texts t WHERE t.text = words.text), false) AS e,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND l.quality = 1) AS good,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND l.toxic = 1) AS toxic
    FROM words),
counts AS (
    SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, good, toxic, count(*) AS n
    FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT p.f || q.f || r.f || s.f || t.f AS filter_order
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
steps AS (
    SELECT filter_order, k AS step, substr(filter_order, k, 1) AS own,
        1 << (ascii(substr(filter_order, k, 1)) - 65) AS bit,
        coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::INT AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS k)),
replayed AS (
    SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM replayed
"""
