"""Token ids written to files of Simple-8b words, and read back.

A 64-bit word holds a selector (4 bits) and as many ids of one width as fit (60 bits): 240 or 120 zeros, or
60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30 or 60 bits. The
widest id, all ones in 60 bits, is an escape: the id itself stands in a list of its own. Blocks of ids begin
at a word of their own, and each file lists the first word of every block.

File, little-endian: ``HEAD`` (magic, documents, ids, words, blocks, escapes, ids in a block), then doc_id
(int64), doc_id present (uint8), ids before each document (int64, one more than documents), first word of
each block (int64), escaped ids (uint64), words (uint64).

Null texts count as empty, an empty text has its end id only, null doc_ids come first and stay null, rows
that repeat a doc_id are all kept (in order of their text's hash), and an empty table writes no file.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointflow.llm.common import whole_text, worker_state
from jointflow.session import shared_folder

#: Fixed values of the code: ids in a word and their bits, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 60) - 1
BLOCK = 1024
HEAD = "<8s6q"
MAGIC = b"S8BTOK01"
#: Values below this have their widths in a table.
SMALL = 1 << 18
#: Ids after which a writer begins a new file.
FILE_IDS = 2_000_000
#: Documents whose words are looked up together.
BATCH = 2_048
#: Words whose ids a worker remembers before it goes back to those of the batch at hand, and their greatest length in bytes.
CACHE_WORDS, CACHE_LENGTH = 500_000, 40


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, and escaped values. Every word takes as many values as it can."""
    values = np.ascontiguousarray(values, np.uint64)
    escaped = values >= ESCAPE
    escapes = values[escaped]
    if escaped.any():
        values = np.where(escaped, np.uint64(ESCAPE), values)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), escapes
    steps = np.array([1 << int(b) for b in np.unique(BITS)[:-1]], np.uint64)  # values at which a word needs wider places
    width = np.zeros(n + 240, np.int8)
    top = int(values.max()) + 1
    if top <= SMALL:
        width[:n] = np.searchsorted(steps, np.arange(top, dtype=np.uint64), "right").astype(np.int8)[values]
    else:
        width[:n] = np.searchsorted(steps, values, "right")
    needed = np.searchsorted(np.unique(BITS), BITS)  # of a selector: the most that fit
    blocks = -(-n // BLOCK)
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    starts, chosen, live = [], [], np.arange(blocks)
    while len(live):
        p, stop = at[live], end[live]
        pick = np.full(len(p), 15)
        open_, most = np.arange(len(p)), width[p].astype(np.int64)
        done = 1
        for selector in range(14, -1, -1):
            count = COUNTS[selector]
            q = p[open_]
            for extra in range(done, count) if count - done <= 5 else ():
                most = np.maximum(most, width[q + extra])
            if count - done > 5:
                most = np.maximum(most, width[q[:, None] + np.arange(done, count)].max(1))
            ok = (q + count <= stop[open_]) & (most <= needed[selector])
            open_, most = open_[ok], most[ok]
            if not len(open_):
                break
            pick[open_] = selector
            done = count
        row = np.full(blocks, -1)
        row[live] = p
        sel = np.zeros(blocks, np.int8)
        sel[live] = pick
        starts.append(row)
        chosen.append(sel)
        at[live] += COUNTS[pick]
        live = live[at[live] < end[live]]
    grid = np.stack(starts, 1)
    used = grid >= 0
    first = np.concatenate([[0], np.cumsum(used.sum(1))[:-1]])
    start, selector = grid[used], np.stack(chosen, 1)[used].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        if BITS[s]:
            rows = np.flatnonzero(selector == s)
            word = words[rows]
            for k in range(COUNTS[s]):
                word |= values[start[rows] + k] << np.uint64(int(BITS[s]) * k)
            words[rows] = word
    return words, first, escapes


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values, decoded for all words of a selector at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        if BITS[s]:
            rows = np.flatnonzero(selector == s)
            start, word, mask = ends[rows] - counts[rows], words[rows], np.uint64((1 << int(BITS[s])) - 1)
            for k in range(COUNTS[s]):
                out[start + k] = word >> np.uint64(int(BITS[s]) * k) & mask
    if len(escapes):
        out[out == ESCAPE] = escapes
    return out


def _stem(word: bytes) -> bytes:
    """The word without the marks after its last letter or digit, which are tokens of their own; else the whole word."""
    stem = word.rstrip(b".,;:!?#$%&*")
    if len(stem) == len(word) or stem[-1:].isalnum():
        return stem
    # A letter beyond ASCII, unless its normal form ends in an accent, which goes with the marks.
    last = unicodedata.normalize("NFC", stem.decode()[-1:]).lower()
    return stem if last[-1:].isalpha() else word


class WordEncoder:
    """Ids of texts by the library. Words between ASCII white space are encoded once and remembered.

    The tokenizer drops white space and no token reaches over it, so a text's ids are those of its words.
    """

    def __init__(self, tokenizer: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def library(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words as little-endian unsigned 32-bit integers; letters-only words go 200 to a call."""
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        ids: list[bytes | None] = [None] * len(words)
        encode = self.tokenizer.encode_batch_fast
        for group, x in zip(groups, encode([" ".join(texts[i] for i in g) for g in groups], add_special_tokens=False)):
            flat = np.array(x.ids, "<u4")
            cuts = np.flatnonzero(self.ends[flat]) + 1
            if len(cuts) == len(group):  # each word of letters ends in one token that ends a word
                raw, stops = flat.tobytes(), (cuts * 4).tolist()
                for i, a, b in zip(group, [0, *stops], stops):
                    ids[i] = raw[a:b]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, encode([texts[i] for i in rest], add_special_tokens=False)):
            ids[i] = np.array(x.ids, "<u4").tobytes()
        return dict(zip(words, ids))

    def learn(self, words: set[bytes]) -> list[bytes]:
        """Remember words that are not known yet; returns those too long to be kept."""
        known = self.known
        parts = [(w, stem := _stem(w), w[len(stem) :]) for w in words]
        fresh = {x for _, *pair in parts for x in pair}.difference(known)
        fresh.discard(b"")
        known[b""] = b""
        known.update(self.library(list(fresh)))
        for w, stem, marks in parts:
            if marks:
                known[w] = known[stem] + known[marks]
        return [x for x in fresh | words if len(x) > CACHE_LENGTH]

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts. The tokenizer takes A-Z as a-z."""
        cuts = [t.lower().split() for t in batch]
        words = set().union(*cuts)
        if len(self.known) > CACHE_WORDS:
            self.known = {w: self.known[w] for w in words.intersection(self.known)}
        new = words.difference(self.known)
        long = self.learn(new) if new else []
        ids = [b"".join(map(self.known.__getitem__, cut)) for cut in cuts]
        for x in long:
            self.known.pop(x, None)
        return ids


def encode_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One file's bytes, from little-endian unsigned 32-bit ids of each document."""
    counts = np.array([len(x) // 4 for x in ids], np.int64)
    words, first, escapes = pack(np.frombuffer(b"".join(ids), "<u4"))
    head = struct.pack(HEAD, MAGIC, len(ids), int(counts.sum()), len(words), len(first), len(escapes), BLOCK)
    arrays = (
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.array([d is not None for d in doc_ids], np.uint8),
        np.concatenate([[0], np.cumsum(counts)]).astype("<i8"),
        first.astype("<i8"),
        escapes.astype("<u8"),
        words.astype("<u8"),
    )
    return head + b"".join(a.tobytes() for a in arrays)


def decode_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids before each document, and all ids of a file."""
    magic, docs, ids, words, blocks, escapes, _ = struct.unpack_from(HEAD, content)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    at, arrays = struct.calcsize(HEAD), []
    for kind, n in (("<i8", docs), ("u1", docs), ("<i8", docs + 1), ("<i8", blocks), ("<u8", escapes), ("<u8", words)):
        arrays.append(np.frombuffer(content, kind, n, at))
        at += arrays[-1].nbytes
    doc_ids, present, offsets, _, escaped, packed = arrays
    values = unpack(packed, escaped)
    if len(values) != ids:
        raise ValueError("a file of token ids is cut short")
    return [int(d) if p else None for d, p in zip(doc_ids, present)], offsets, values


def write_tokens(df: DataFrame, tokenizer_path: str, path: str, end_id: int, text: str = "text") -> DataFrame:
    """Encode each whole text, append ``end_id``, write files below ``path`` in ascending ``doc_id`` order.

    ``path`` is a folder that all executors reach. Returns the files in order, with the ids before each. A task
    that runs again writes the same files again; a file appears under its name only when it is whole.
    """
    from pyarrow import fs

    with open(tokenizer_path, "rb") as file:
        tokenizer = file.read()
    end = np.array([end_id], "<u4").tobytes()
    fs.FileSystem.from_uri(path)[0].create_dir(fs.FileSystem.from_uri(path)[1], recursive=True)
    key = f"words {zlib.crc32(tokenizer)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        state = worker_state("word encoders")
        encoder = state.get(key) or state.setdefault(key, WordEncoder(tokenizer))
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(path)
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        pending = files = 0

        def flush() -> pa.RecordBatch:
            nonlocal pending, files, doc_ids, ids
            name = f"part-{part:06d}-{files:06d}.s8b"
            hidden = f"{root}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write(encode_file(doc_ids, ids))
            store.move(hidden, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "docs": [len(ids)], "ids": [pending]}, schema=manifest)
            doc_ids, ids, pending, files = [], [], 0, files + 1
            return row

        manifest = pa.schema([("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                new = encoder.encode([t.encode() for t in batch.column("text").to_pylist()])
                for d, x in zip(batch.column("doc_id").to_pylist(), new):
                    doc_ids.append(d)
                    ids.append(x + end)
                    pending += len(x) // 4 + 1
                    if pending >= FILE_IDS:
                        yield flush()
        if ids:
            yield flush()

    order = ["doc_id", "tie"]
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    made = rows.select("doc_id", "text").mapInArrow(run, "file string, docs long, ids long")
    listed = shared_folder(df.sparkSession, "token-files")
    made.write.parquet(listed)
    made = df.sparkSession.read.schema(made.schema).parquet(listed)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, path: str, files: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, and ``ids`` if asked for."""
    schema = "file string, doc_id long, local long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                doc_ids, offsets, values = decode_file(content)
                small = values.astype("<u4")
                parts = [small[a:b] for a, b in zip(offsets, offsets[1:])]
                columns = [
                    pa.array([name.rpartition("/")[2]] * len(doc_ids), pa.string()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(offsets[:-1], pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                names = ["file", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    stored = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    stored = stored.load(path).where(F.col("path").endswith(".s8b")).select("path", "content")
    rows = stored.mapInArrow(run, schema + (", ids array<long>" if with_ids else ""))
    rows = rows.join(files.select("file", F.col("start").alias("base")), "file")
    return rows.withColumn("start", F.col("base") + F.col("local")).drop("file", "base", "local")
