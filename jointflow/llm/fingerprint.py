"""Fingerprints of documents that add up: a homomorphic multiset hash of paragraphs.

A paragraph is a line (what stands between line breaks, also if empty). Each has a wide vector of numbers, and a document's fingerprint is the sum of its paragraphs'
vectors, every lane modulo a power of two. So the order of paragraphs does not matter, and putting one in or taking one out
(:func:`add`, :func:`remove`) changes a fingerprint without the rest of the text. The lanes of a paragraph are

* ``WORDS`` lanes modulo 2^64: BLAKE2b of the paragraph, cut up. Sums of two multisets that differ agree by chance only.
* one lane modulo 2^64: 1, so the lane counts paragraphs.
* ``CELLS`` lanes modulo 2^16: for each shingle of three words in the paragraph (all its words, if fewer) plus or minus one at one of the
  lanes, both by hash. The inner product of two fingerprints in these lanes estimates that of the documents' shingle counts, with a
  relative spread of about ``CELLS ** -0.5``; :func:`likeness` is their Tanimoto ratio.

Equal texts have equal fingerprints, and so have texts with the same lines in another order; no others do, but by chance. Null
counts as the empty text, which has one empty paragraph. A line repeated more than 2^15 times may wrap its lanes round, which touches
likeness but not equality. Words are what spaces and tabs part. Texts are hashed whole, in batches of bounded bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jointflow.llm.common import whole_text
from jointflow.session import shared_folder

WORDS = 4
CELLS = 128
SHINGLE = 3
#: Bytes of paragraphs that are hashed side by side.
CHUNK = 1 << 20

#: A fingerprint: the lanes modulo 2^64 and those modulo 2^16.
Lanes = tuple[np.ndarray, np.ndarray]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


_UP, _DOWN = _powers(_BASE, 2 * CHUNK), _powers(_INVERSE, 2 * CHUNK)


def _tables(n: int) -> Lanes:
    global _UP, _DOWN
    if n >= len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
    return _UP, _DOWN


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _cells(data: np.ndarray, owner: np.ndarray, line_of: np.ndarray, n: int) -> np.ndarray:
    """Signed counts of the shingles of all lines, by their owner (0 to ``n`` - 1).

    ``data``: the lines' bytes, each followed by a line break; ``line_of``: the line of every byte; ``owner``: of every line.
    """
    up, down = _tables(len(data) + 1)
    gap = (data == 32) | (data == 9) | (data == 10)
    before = np.concatenate([[True], gap[:-1]])
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(gap & ~before)  # one for each start: data end with a line break
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    word = _mixed((sums[ends] - sums[starts]) * down[starts])
    line = line_of[starts]
    # Words of a line stand together; a shingle starts at each word that has two more behind it.
    whole = np.flatnonzero(line[: -(SHINGLE - 1)] == line[SHINGLE - 1 :]) if len(line) >= SHINGLE else np.empty(0, np.int64)
    shingle = word[whole]
    for k in range(1, SHINGLE):
        shingle = _mixed(shingle + _BASE) + word[whole + k]
    # Lines of fewer words, none included, are one shingle.
    count = np.bincount(line, minlength=len(owner))
    short = np.flatnonzero(count < SHINGLE)
    first = np.concatenate([[0], np.cumsum(count)])[short]
    rest = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        has = count[short] > k
        rest[has] = _mixed(rest[has] + _BASE) + word[first[has] + k]
    hashes = _mixed(np.concatenate([shingle, rest]))
    at = np.concatenate([owner[line[whole]], owner[short]]) * CELLS + (hashes % np.uint64(CELLS)).astype(np.int64)
    sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
    return np.bincount(at, weights=sign, minlength=n * CELLS).astype(np.int64).reshape(n, CELLS)


def sums(parts: Sequence[Sequence[str]]) -> Lanes:
    """The fingerprint of each list of paragraphs; zeros for an empty list."""
    n = len(parts)
    wide, cells = np.zeros((n, WORDS + 1), np.uint64), np.zeros((n, CELLS), np.int64)
    held, owner, size = [], [], 0

    def flush() -> None:
        lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
        data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        owners = np.array(owner)
        low = owners.min()
        found = _cells(data, owners - low, np.repeat(np.arange(len(held)), lengths), int(owners.max() - low) + 1)
        cells[low : low + len(found)] += found

    for i, lines in enumerate(parts):
        for line in lines:
            raw = line.encode("utf-8", "surrogatepass")
            wide[i, :WORDS] += np.frombuffer(hashlib.blake2b(raw, digest_size=8 * WORDS).digest(), "<u8")
            held.append(raw)
            owner.append(i)
            size += len(raw) + 1
            if size >= CHUNK:
                flush()
                held, owner, size = [], [], 0
        wide[i, WORDS] = len(lines)
    if held:
        flush()
    return wide, (cells % (1 << 16)).astype(np.uint16)


def add(a: Lanes, b: Lanes) -> Lanes:
    """The fingerprints of documents with the paragraphs of both."""
    return a[0] + b[0], a[1] + b[1]


def remove(a: Lanes, b: Lanes) -> Lanes:
    """The fingerprints of ``a`` without the paragraphs of ``b``."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a: Lanes, b: Lanes) -> np.ndarray:
    """From 0 to 1, row by row: the Tanimoto ratio of the shingle counts as the cells tell it; 1 for equal fingerprints."""
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    x, y = (cells.astype(np.int16).astype(np.float64) for cells in (a[1], b[1]))
    inner = (x * y).sum(axis=1)
    union = (x * x).sum(axis=1) + (y * y).sum(axis=1) - inner
    ratio = np.divide(inner, union, out=np.zeros_like(inner), where=union > 0)
    return np.where(same, 1.0, ratio.clip(0, 1))


def packed(lanes: Lanes) -> list[bytes]:
    wide, cells = (x.astype(x.dtype.newbyteorder("<")) for x in lanes)
    return [w.tobytes() + c.tobytes() for w, c in zip(wide, cells)]


def unpacked(rows: Sequence[bytes]) -> Lanes:
    data = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 8 * (WORDS + 1) + 2 * CELLS)
    wide, cells = data[:, : 8 * (WORDS + 1)], data[:, 8 * (WORDS + 1) :]
    return np.ascontiguousarray(wide).view("<u8"), np.ascontiguousarray(cells).view("<u2")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with a binary column ``name``; one of that name is replaced."""
    kept = [c for c in docs.columns if c != name]
    given = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    schema = given.withColumn(name, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [(t or "").split("\n") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed(sums(lines)), pa.binary())], names=[*kept, name])

    return given.mapInArrow(run, schema)


# Texts whose second half gives way to the start of the next document.

_EDGE = "doc_id {id}, n_chars long, fingerprint binary, edited_sha256 string, edited binary, near_edited double, near_next double, part int, edge string, text string"
_FIELDS = [x.split()[0] for x in _EDGE.split(", ")]


def _edits(texts: list[str], following: list[str], own: Lanes | None = None) -> tuple[list[str], Lanes, Lanes]:
    """sha256 and fingerprints of the edited texts, and the fingerprints of the texts.

    Paragraphs before the cut are in both sums and are hashed once; what the cut takes away and puts in is added to them.
    """
    digests, common, before, after = [], [], [], []
    for text, nxt in zip(texts, following):
        half = len(text) // 2
        cut = len(text) - half
        start = text.rfind("\n", 0, cut) + 1  # of the paragraph that is cut
        put = text[start:cut] + nxt[:half]
        common.append(text[: start - 1].split("\n") if start else [])
        before.append(text[start:].split("\n"))
        after.append(put.split("\n"))
        digests.append(hashlib.sha256((text[:start] + put).encode("utf-8", "surrogatepass")).hexdigest())
    n = len(texts)
    wide, cells = sums([*common, *before, *after])
    kept, old, new = ((wide[k * n : (k + 1) * n], cells[k * n : (k + 1) * n]) for k in range(3))
    return digests, add(kept, new), add(kept, old)


def _whole(texts: list[str]) -> Lanes:
    return sums([t.split("\n") for t in texts])


def _row_ends(part: int, ids, texts, lanes, edge) -> dict:
    none = [None] * len(texts)
    return {"doc_id": ids, "n_chars": list(map(len, texts)), "fingerprint": packed(lanes), "edited_sha256": none, "edited": none, "near_edited": none, "near_next": none, "part": [part] * len(texts), "edge": edge, "text": texts}


def edit_likeness(docs: DataFrame) -> DataFrame:
    """For every document (``doc_id``, ``text``) its fingerprint, and that of its text with the last half of its characters replaced by the first as
    many (or all) of the next document, by descending doc_id; after the last comes the first.

    Rows with equal ids follow each other by a hash of their texts, rows without an id come last. Documents are sorted into
    ranges, each walked as a stream that holds one batch; where a range ends, its last text and the next range's first one are kept aside and meet in a join
    of one row for each range.
    """
    given = docs.select("doc_id", whole_text("text").alias("text"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    keys = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("tie")]
    ranged = given.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = _EDGE.format(id=id_type)

    def table(columns: dict, ids_type: pa.DataType) -> pa.RecordBatch:
        kinds = [ids_type, pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(columns[f], k) for f, k in zip(_FIELDS, kinds)], names=_FIELDS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_id, open_text, first, kind = None, None, None, None
        for whole in batches:
            kind = whole.schema.field(0).type
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                if open_text is None:
                    first = texts[0]
                else:
                    ids, texts = [open_id, *ids], [open_text, *texts]
                open_id, open_text = ids[-1], texts[-1]
                if len(texts) < 2:
                    continue
                digests, edited, own = _edits(texts[:-1], texts[1:])
                nxt = tuple(np.concatenate([x[1:], y]) for x, y in zip(own, _whole(texts[-1:])))
                edge = [None] * len(digests)
                kept = [None] * len(digests)
                if first is not None:
                    edge[0], kept[0], first = "first", first, None
                yield table(
                    {
                        "doc_id": ids[:-1], "n_chars": list(map(len, texts[:-1])), "fingerprint": packed(own), "edited_sha256": digests,
                        "edited": packed(edited), "near_edited": likeness(own, edited), "near_next": likeness(own, nxt),
                        "part": [part] * len(digests), "edge": edge, "text": kept,
                    },
                    kind,
                )
        if open_text is not None:
            yield table(_row_ends(part, [open_id], [open_text], _whole([open_text]), ["last" if first is None else "both"]), kind)

    spark = docs.sparkSession
    path = shared_folder(spark, "edited")
    ranged.mapInArrow(walk, schema).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(schema).parquet(path)

    ends = rows.where("edge in ('last', 'both')").select("doc_id", "n_chars", "fingerprint", "part", "text")
    starts = rows.where("edge in ('first', 'both')").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    # One row for each range: its successor, the first one for the last.
    parts = starts.select("next_part")
    order = Window.orderBy("next_part")
    successors = parts.select(
        F.col("next_part").alias("part"),
        F.coalesce(F.lead("next_part").over(order), F.min("next_part").over(order)).alias("next_part"),
    )
    open_rows = ends.join(successors, "part").join(starts, "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts, following = (batch.column(k) for k in range(3))
            digests, edited, own = _edits(texts.to_pylist(), following.to_pylist())
            columns = _row_ends(-1, ids.to_pylist(), texts.to_pylist(), own, [None] * len(digests))
            columns |= {
                "edited_sha256": digests, "edited": packed(edited), "near_edited": likeness(own, edited),
                "near_next": likeness(own, _whole(following.to_pylist())), "text": [None] * len(digests),
            }
            yield table(columns, ids.type)

    closed = open_rows.select("doc_id", "text", "next_text").mapInArrow(close, schema)
    text_of = lambda c: F.translate(F.base64(c), "\r\n", "")
    done = rows.where("edge is null or edge = 'first'").unionByName(closed)
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of("fingerprint").alias("fingerprint"),
        text_of("edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
