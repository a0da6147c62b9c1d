"""License texts and phrases in documents by diagonal voting, with DataFrame functions only.

Texts are cut into words (lower-cased A-Z). Every rolling pair of words is hashed and joined to the pairs of the
templates; a hit at word i of a text and word t of a template votes for the diagonal i - t. A phrase stands where
all its pairs vote for one diagonal. Of longer templates neighbouring diagonals (words put in or left out) are merged
and the span is verified: at least ``LEAST_SHARE`` of the template's pairs, in their order along the text.
Hits count only if the words themselves are equal, so no clash of hashes survives.

The templates are a fixed list, so their pairs are broadcast and no text is shuffled; only hits and one row per document
are. Null and empty texts have no words and no labels; a null doc_id is kept; rows that repeat both doc_id and text
are scanned as one and repeat their result; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jointflow.llm.common import LOWER, UPPER, lower_ascii, whole_text

LEAST_SHARE = 0.6
#: Diagonals of one template at most this far apart belong to one span.
NEIGHBOURS = 4
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases (all words in a row) and texts (a share of their word pairs), with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
PHRASES = (
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("creative commons attribution", "cc-by"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc by 4", "cc-by"),
    ("cc by 3", "cc-by"),
    ("cc0 1 0", "cc0"),
    ("all rights reserved", "proprietary"),
)
TEXTS = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied",
        "apache",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "bsd",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        "gpl",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
)


def templates() -> list[tuple[int, str, str, bool, bool]]:
    """(number, words, label, is a phrase, is a base phrase)."""
    rows = [(p, label, True, True) for p, label in BASE_PHRASES]
    rows += [(p, label, True, False) for p, label in PHRASES]
    rows += [(p, label, False, False) for p, label in TEXTS]
    return [(n, *r) for n, r in enumerate(rows)]


def _template_pairs(spark) -> DataFrame:
    rows = []
    for number, text, label, phrase, base in templates():
        words = text.split()
        rows += [(number, label, phrase, base, len(words) - 1, t, f"{a} {b}") for t, (a, b) in enumerate(zip(words, words[1:]))]
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, base boolean, pairs int, place int, pair string")
    # Hashed as the pair of its words, like the pairs of texts.
    words = F.split("pair", " ")
    return table.withColumn("hash", F.xxhash64(words[0], words[1]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans): spans are structs of label, start and end word (end exclusive), share, phrase and base."""
    words = F.array_remove(F.split(lower_ascii(whole_text(text)), NOT_WORD, -1), "")
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row"), words.alias("words"))
    n = F.size("words")
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("hash"), F.concat(a, F.lit(" "), b).alias("pair"))
    pairs = F.zip_with(F.slice("words", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))), pair)
    # A first element without a hash keeps a row for every document.
    none = F.array(F.struct(F.lit(None).cast("long").alias("hash"), F.lit(None).cast("string").alias("pair")))
    rolled = rows.select("doc_id", "row", n.alias("n_words"), F.posexplode(F.concat(none, pairs)).alias("at", "found"))
    rolled = rolled.select("doc_id", "row", "n_words", "at", "found.hash", "found.pair")
    hits = rolled.join(F.broadcast(_template_pairs(docs.sparkSession)), ["hash", "pair"], "left")
    hits = hits.where("template is not null or at = 0").repartition("row")
    hits = hits.withColumn("word", F.col("at") - 1).withColumn("diagonal", F.col("word") - F.col("place"))
    voted = hits.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "base", "pairs", "diagonal").agg(
        F.collect_set("place").alias("places"),
        F.min("word").alias("start"),
        F.max("word").alias("last"),
        F.count(F.when(F.col("at") == 0, 1)).alias("copies"),
    )
    # Phrases and the documents' own rows stand alone; neighbouring diagonals of other templates share a span.
    order = Window.partitionBy("row", "doc_id", "template").orderBy("diagonal")
    apart = F.col("phrase") | F.col("template").isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS)
    voted = voted.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    voted = voted.withColumn("span", F.sum("new").over(order))
    spans = voted.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "base", "pairs", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"),
        F.min("start").alias("start"),
        (F.max("last") + 2).alias("end"),
        F.sum("copies").alias("copies"),
    )
    share = F.col("votes") / F.col("pairs")
    good = F.when(F.col("phrase"), F.col("votes") == F.col("pairs")).otherwise(
        (share >= LEAST_SHARE) & (F.col("end") - F.col("start") <= 2 * (F.col("pairs") + 1))
    )
    kept = F.struct("label", "start", "end", share.alias("share"), "phrase", "base")
    found = spans.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_list(F.when(good, kept))).alias("spans"), F.sum("copies").alias("copies")
    )
    # Every row of documents has one first element without a hash: their number is that of the repeated rows.
    return found.select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def summary(found: DataFrame) -> DataFrame:
    """One row per document: counts and places of base phrases, labels, and the greatest share as score."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same result as SQL over ``documents``."""
    rows = ",\n".join(
        f"({number}, '{label}', {phrase}, {base}, {len(words) - 1}, {t}, '{a} {b}')"
        for number, text, label, phrase, base in templates()
        for words in [text.split()]
        for t, (a, b) in enumerate(zip(words, words[1:]))
    )
    return f"""
WITH template_pairs(template, label, phrase, base, pairs, place, pair) AS (VALUES {rows}),
every AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
docs AS (SELECT DISTINCT * FROM every),
rolled AS (
  SELECT doc_id, words, unnest(range(0, len(words) - 1)) AS word FROM docs),
hits AS (
  SELECT r.doc_id, r.words, r.word, t.*, r.word - t.place AS diagonal
  FROM rolled r JOIN template_pairs t ON r.words[r.word + 1] || ' ' || r.words[r.word + 2] = t.pair),
voted AS (
  SELECT doc_id, words, template, label, phrase, base, pairs, diagonal, list(DISTINCT place) AS places, min(word) AS start, max(word) AS last
  FROM hits GROUP BY ALL),
lagged AS (
  SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER w > {NEIGHBOURS}, TRUE) THEN 1 ELSE 0 END AS fresh
  FROM voted WINDOW w AS (PARTITION BY doc_id, words, template ORDER BY diagonal)),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, words, template ORDER BY diagonal) AS span FROM lagged),
spans AS (
  SELECT doc_id, words, template, label, phrase, base, pairs, span,
         len(list_distinct(flatten(list(places)))) AS votes, min(start) AS start, max(last) + 2 AS stop
  FROM numbered GROUP BY ALL),
good AS (
  SELECT *, votes / pairs AS share FROM spans
  WHERE CASE WHEN phrase THEN votes = pairs ELSE votes / pairs >= {LEAST_SHARE} AND stop - start <= 2 * (pairs + 1) END),
summed AS (
  SELECT doc_id, words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM good GROUP BY doc_id, words)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(s.n_base, 0)::BIGINT AS n_base, s.first_word::BIGINT AS first_word,
       s.last_word::BIGINT AS last_word, coalesce(s.base_labels, '') AS base_labels, coalesce(s.labels, '') AS labels,
       coalesce(s.score, 0.0)::DOUBLE AS score
FROM every d LEFT JOIN summed s ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.words = d.words"""
