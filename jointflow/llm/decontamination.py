"""Benchmark items inside documents, up to a share of changed words, by pigeonhole pieces and Myers' distance.

Texts and items are folded first: lower-cased, and all ASCII characters but letters and digits separate words. An item of
m words may differ from its passage by k = floor(m * ``BUDGET``) edits of words (changed, left out or put in). Cut into k + 1
pieces, it has one piece that stands unchanged, so every passage within the budget has an exact hit of a piece
(an automaton of all pieces reads each text once). Around each hit Myers' bit-parallel distance of the item to
the best-fitting passage decides.

Items are searched in slices by hash of about ``SLICE_CHARS`` characters at most; each slice is sent to the executors, so what is
broadcast is bounded, and more items take more passes over the texts. Items of fewer than five words
have a budget of no edits and are found word for word; items without words (null ones too) say nothing about a document and are
left out; items that fold to the same words are all reported.

Null texts count as empty and match nothing, a null doc_id stays null, repeated rows repeat their result, empty tables give an
empty result, and extra columns are left out of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointflow.llm.common import append_columns, drop_caches, texts

BUDGET = 0.2
LEAST_WORDS = 1
SLICE_CHARS = 8_000_000

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
_TABLE = bytes(b if b >= 128 or b in _KEPT else 32 for b in range(256))


def fold(text: str) -> str:
    """Lower-cased words with one space between them and one on either side."""
    words = text.lower().encode().translate(_TABLE).split()
    return f" {b' '.join(words).decode()} "


def pieces(words: list[str]) -> list[tuple[int, str]]:
    """Start and text of each of the budget + 1 pieces of an item, as equal as can be."""
    n, k = len(words), int(len(words) * BUDGET) + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, f" {' '.join(words[a:b])} ") for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit vectors of one item's words."""

    def __init__(self, words: list[str]) -> None:
        self.m = len(words)
        self.budget = int(self.m * BUDGET)
        self.masks: dict[str, int] = {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.full, self.top = (1 << self.m) - 1, 1 << (self.m - 1)

    def best(self, window: list[str]) -> tuple[int, int]:
        """Least distance of the item to a passage of ``window``, and the first place where such a passage ends."""
        plus, minus, score = self.full, 0, self.m
        best, end = self.m, 0
        full, top, masks = self.full, self.top, self.masks
        for j, w in enumerate(window, 1):
            eq = masks.get(w, 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (full & ~(across | plus)), plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            if score < best:
                best, end = score, j
            up, down = up << 1 & full, down << 1 & full  # a passage may begin anywhere: no 1 is shifted in
            plus, minus = down | (full & ~(vertical | up)), up & vertical
        return best, end


class Searcher:
    """All items of a slice."""

    def __init__(self, items: list[list[str]]) -> None:
        import ahocorasick

        self.patterns = [Pattern(x) for x in items]
        self.automaton = ahocorasick.Automaton()
        hits: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for start, piece in pieces(item):
                hits.setdefault(piece, []).append((i, start))
        for piece, places in hits.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, word at which the passage ends) of the items in a folded text, each at its nearest passage."""
        found: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        words: list[str] = []
        for last, (length, places) in self.automaton.iter(text):
            words = words or text.split()
            at = text.count(" ", 0, last + 2 - length) - 1  # words before the piece
            for i, start in places:
                if (i, at - start) in tried:
                    continue
                tried.add((i, at - start))
                p = self.patterns[i]
                begin = max(0, at - start - p.budget)
                distance, stop = p.best(words[begin : at - start + p.m + p.budget])
                if distance <= p.budget:
                    found[i] = min(found.get(i, (p.m, 0)), (distance, begin + stop))
        return [(i, *x) for i, x in sorted(found.items())]


def leaks(docs: DataFrame, items: DataFrame, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(id columns, item_id, distance, n_edits, end_word) for each document and item whose words it holds within the budget.

    ``n_edits`` is the item's budget, ``end_word`` the number of words before the passage's end.
    """
    rows = docs.select(*id_columns, "text")
    schema = rows.drop("text").schema.add("item_id", "long").add("distance", "long").add("n_edits", "long").add("end_word", "long")
    made = None
    for known in _slices(items):
        found = rows.mapInArrow(_search(known, id_columns), schema)
        made = found if made is None else made.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if made is None else made


def _slices(items: DataFrame) -> Iterator:
    """Broadcast lists of (words, item_ids), of a bounded size each."""
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    slices = max(1, math.ceil(total / SLICE_CHARS))
    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    for s in range(slices):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == s).toArrow()
        by_words: dict[tuple[str, ...], set] = {}
        for item_id, text in zip(part["item_id"].to_pylist(), part["text"].to_pylist()):
            by_words.setdefault(tuple(fold(text).split()), set()).add(item_id)
        known = sorted((list(w), sorted(ids, key=lambda x: (x is None, x))) for w, ids in by_words.items() if len(w) >= LEAST_WORDS)
        if known:
            yield items.sparkSession.sparkContext.broadcast(known)


def _search(known, id_columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        searcher = Searcher([words for words, _ in known.value])
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                row, item, distance, budget, end = [], [], [], [], []
                for n, text in enumerate(batch.column("text").to_pylist()):
                    for i, d, stop in searcher.find(fold(text or "")):
                        for item_id in known.value[i][1]:
                            row.append(n)
                            item.append(item_id)
                            distance.append(d)
                            budget.append(searcher.patterns[i].budget)
                            end.append(stop)
                ids = batch.select(list(id_columns)).take(pa.array(row, pa.int64()))
                columns = [*ids.columns, *(pa.array(x, pa.int64()) for x in (item, distance, budget, end))]
                yield pa.RecordBatch.from_arrays(columns, names=[*id_columns, "item_id", "distance", "n_edits", "end_word"])

    return run


def mark_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with ``leaked``: whether the row's text holds an item. A column of that name is replaced."""
    made = docs.withColumn("leaked", F.lit(False))
    for known in _slices(items):

        def make(known=known):
            searcher = Searcher([words for words, _ in known.value])
            return lambda table: [pa.array([bool(searcher.find(fold(t))) for t in texts(table, "text")], pa.bool_())]

        made = append_columns(made, [T.StructField("_leaked", T.BooleanType())], make)
        made = made.withColumn("leaked", F.col("leaked") | F.col("_leaked")).drop("_leaked")
    return made
