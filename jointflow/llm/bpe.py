"""Byte-level BPE encoding and decoding with a rank queue under a hierarchical bitmap.

Each match of the split pattern is a pre-token of its own. The pre-tokens of a batch that are not known
yet stand side by side in one linked list without links between them. A bucket for each merge rank holds
the list positions whose pair has that rank; three levels of 64-bit words mark the filled buckets, so the
next rank is three find-first-set steps away however long a pre-token is. Positions whose pair has changed
since are stale and skipped when they come up. A pre-token of n bytes takes O(n log n) steps.

Nulls count as empty texts, empty texts have no ids, repeated rows repeat their results, an empty table gives
an empty table, and columns named like the new ones are replaced by them.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jointflow.llm.common import append_columns, texts, worker_state
from jointflow.llm.grams import Lookup, chunks

#: Most pre-tokens that a worker remembers in each of two generations, and their greatest length.
CACHE_ENTRIES, CACHE_LENGTH = 220_000, 48
#: Characters of a batch whose new pre-tokens are merged together.
CHUNK_CHARS = 2_000_000
#: Rows of a batch.
ROWS = 1024
#: Positions of one rank from which they are merged side by side as arrays.
WIDE = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens by rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class RankQueue:
    """List positions in a bucket for each rank; the lowest filled rank is found by three find-first-set steps."""

    def __init__(self, ranks: int) -> None:
        self.levels = [[0] * (-(-ranks // 64**k)) for k in (1, 2, 3)]
        if len(self.levels[2]) > 64:
            raise ValueError("more ranks than three levels can mark")
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.fill(rank, [position])
        else:
            bucket.append(position)

    def fill(self, rank: int, positions: list[int]) -> None:
        """Positions for a rank whose bucket is empty."""
        self.buckets[rank] = positions
        for level in self.levels:
            at, bit = rank >> 6, 1 << (rank & 63)
            level[at] |= bit
            rank = at

    def first(self) -> int:
        """The lowest filled rank, or -1."""
        for at, word in enumerate(self.levels[2]):
            if word:
                break
        else:
            return -1
        for level in (self.levels[2], self.levels[1], self.levels[0]):
            word = level[at]
            at = at << 6 | ((word & -word).bit_length() - 1)
        return at

    def take(self, rank: int) -> list[int]:
        """Empty a rank's bucket: its positions from left to right."""
        positions = self.buckets.pop(rank)
        positions.sort()
        for level in self.levels:
            at, bit = rank >> 6, 1 << (rank & 63)
            level[at] &= ~bit
            if level[at]:
                break
            rank = at
        return positions


class Merger:
    """Merges of one rank table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        self.byte_pairs = np.full(1 << 16, -1)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0] << 8 | token[1]] = rank
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        keys = np.array(sorted(self.pairs), np.int64)
        self.pair_places = Lookup(keys)
        self.pair_ranks = np.array([*map(self.pairs.__getitem__, keys.tolist()), -1])
        self.queue = RankQueue(max(ranks.values()) + 1)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 for none and for ids below zero."""
        found = self.pair_ranks[self.pair_places(left << 20 | np.maximum(right, 0))]
        found[(left < 0) | (right < 0)] = -1
        return found

    def fill(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Positions into the buckets of their ranks, where they have one."""
        found = np.flatnonzero(ranks >= 0)
        found = found[np.argsort(ranks[found], kind="stable")]
        if not len(found):
            return
        ranks, positions = ranks[found], positions[found].tolist()
        starts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        buckets, fill = self.queue.buckets, self.queue.fill
        for rank, start, end in zip(ranks[starts].tolist(), starts, [*starts[1:], len(positions)]):
            if (bucket := buckets.get(rank)) is None:
                fill(rank, positions[start:end])
            else:
                bucket.extend(positions[start:end])

    def merge(self, pretokens: list[bytes]) -> list[bytes]:
        """Ids of each pre-token (none of them empty), as little-endian unsigned 32-bit integers."""
        if not pretokens:
            return []
        data = np.frombuffer(b"".join(pretokens), np.uint8).astype(np.int64)
        n = len(data)
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(pretokens)), sizes)
        linked, back = np.arange(1, n + 1), np.arange(-1, n - 1)
        linked[ends - 1] = -1
        back[ends[:-1]] = -1
        first = np.append(self.byte_pairs[data[:-1] << 8 | data[1:]], -1)
        first[ends - 1] = -1
        # The same memory as numbers for single steps and as arrays for wide ones.
        ids, after, before = (array("q", x.tobytes()) for x in (self.byte_ids[data], linked, back))
        wide_ids, wide_after, wide_before = (np.frombuffer(x, np.int64) for x in (ids, after, before))

        pairs, queue = self.pairs, self.queue
        push = queue.push
        self.fill(first, np.arange(n))
        while (rank := queue.first()) >= 0:
            bucket = queue.take(rank)
            if len(bucket) >= WIDE:
                # All pre-tokens that have the pair at once, in each the leftmost one; what is left waits its turn.
                at = np.array(bucket)
                right = wide_after[at]
                good = (right >= 0) & (self.ranks_of(wide_ids[at], wide_ids[right]) == rank)
                at, right = at[good], right[good]
                leftmost = np.diff(owner[at], prepend=-1) > 0
                if not leftmost.all():
                    queue.fill(rank, at[~leftmost].tolist())
                    at, right = at[leftmost], right[leftmost]
                last, prev = wide_after[right], wide_before[at]
                wide_ids[at], wide_ids[right], wide_after[at] = rank, -1, last
                more, less = last >= 0, prev >= 0
                wide_before[last[more]] = at[more]
                merged = np.full(len(at), rank)
                new = np.concatenate([self.ranks_of(merged[more], wide_ids[last[more]]), self.ranks_of(wide_ids[prev[less]], merged[less])])
                self.fill(new, np.concatenate([at[more], prev[less]]))
                continue
            for at, i in enumerate(bucket):
                j = after[i]
                left = ids[i]
                if j < 0 or left < 0 or pairs.get(left << 20 | ids[j]) != rank:
                    continue  # stale
                k, h = after[j], before[i]
                ids[i], ids[j], after[i] = rank, -1, k
                # New pairs stand for longer strings, so none of them has this rank.
                lowest = rank
                if k >= 0:
                    before[k] = i
                    new = pairs.get(rank << 20 | ids[k])
                    if new is not None:
                        push(new, i)
                        if new < lowest:
                            lowest = new
                if h >= 0:
                    new = pairs.get(ids[h] << 20 | rank)
                    if new is not None:
                        push(new, h)
                        if new < lowest:
                            lowest = new
                if lowest < rank:  # comes before the rest of this bucket
                    if at + 1 < len(bucket):
                        queue.fill(rank, bucket[at + 1 :])
                    break
        real = wide_ids >= 0
        flat = wide_ids[real].astype("<u4").tobytes()
        stops = (np.cumsum(real)[ends - 1] * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]


class Encoder:
    """Texts to ids, with pre-tokens and segments seen lately remembered.

    Segments begin where a space follows something that is no white space: no pre-token reaches over such a place.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import re

        import regex

        # White space as in Unicode; some regex engines add U+001C to U+001F.
        space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        for old, new in ((r"[^\s", f"[^{space}"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
            pattern = pattern.replace(old, new)
        self.split = regex.compile(pattern).findall
        self.segments = re.compile(r"(?<=\S)(?= )").split
        self.odd = re.compile(r"\s ").search
        self.merger = Merger(ranks)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        if self.odd(text):
            return self.segments(text)
        if "\0" in text:
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]]
        return text.replace(" ", "\0 ").split("\0")

    def pretokens(self, segments: list[str]) -> list[list[str]]:
        """The matches of the pattern in each segment.

        Segments that begin with a space and end with no white space are matched in one go, one behind the other, as if they
        stood in one text.
        """
        plain = [s[:1] == " " and not s[-1:].isspace() for s in segments]
        joined = "".join([s for s, x in zip(segments, plain) if x])
        found = self.split(joined)
        if sum(map(len, found)) != len(joined):  # a pattern that leaves characters out
            return [self.split(s) for s in segments]
        tokens, out = iter(found), []
        for s, together in zip(segments, plain):
            if not together:
                out.append(self.split(s))
                continue
            own = [token := next(tokens)]
            left = len(s) - len(token)
            while left:
                own.append(token := next(tokens))
                left -= len(token)
            out.append(own)
        return out

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """The ids of every given segment, as little-endian unsigned 32-bit integers."""
        if len(self.new) > CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        known = dict(zip(segments, map(new.get, segments)))
        unknown = []
        for s in [s for s, ids in known.items() if ids is None]:
            ids = old.get(s)
            if ids is None:
                unknown.append(s)
            else:
                known[s] = new[s] = ids
        ranks = self.merger.ranks
        parts: dict[str, bytes | None] = {}
        cut = self.pretokens(unknown)
        for tokens in cut:
            for x in tokens:
                if x not in parts:
                    ids = new.get(x) or old.get(x)
                    if ids is None:
                        whole = ranks.get(x.encode())
                        ids = None if whole is None else whole.to_bytes(4, "little")
                    parts[x] = ids
        merge = [x for x, ids in parts.items() if ids is None]
        for x, ids in zip(merge, self.merger.merge([x.encode() for x in merge])):
            parts[x] = ids
            if len(x) <= CACHE_LENGTH:
                new[x] = ids
        for s, tokens in zip(unknown, cut):
            known[s] = ids = parts[s] if len(tokens) == 1 else b"".join([parts[x] for x in tokens])
            if len(s) <= CACHE_LENGTH:
                new[s] = ids
        return known

    def encode(self, batch: list[str]) -> list[bytes]:
        # Lists of words come and go by the hundred thousand, in no cycles; the collector would walk them over and over.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(batch)
        finally:
            if collects:
                gc.enable()

    def _encode(self, batch: list[str]) -> list[bytes]:
        out: list[bytes] = []
        start = 0
        while start < len(batch):
            end, size, wanted, cuts = start, 0, set(), []
            while end < len(batch) and (size == 0 or size < CHUNK_CHARS):
                cuts.append(self.cut(batch[end]))
                wanted.update(cuts[-1])
                size += len(batch[end])
                end += 1
            known = self.learn(wanted)
            out.extend(b"".join(map(known.__getitem__, segments)) for segments in cuts)
            start = end
        return out


class Decoder:
    """Ids to bytes: all tokens stand in one run of bytes, and the pieces of a whole batch are gathered from it at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.sizes = np.full(max(ranks.values()) + 1, -1)
        tokens = sorted(ranks, key=ranks.__getitem__)
        at = [ranks[t] for t in tokens]
        self.sizes[at] = [len(t) for t in tokens]
        self.starts = np.zeros(len(self.sizes), np.int64)
        self.starts[at] = np.cumsum([0, *map(len, tokens)])[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, batch: list[bytes]) -> Iterator[bytes]:
        """The bytes of each list of little-endian unsigned 32-bit ids."""
        for part in chunks(batch, CHUNK_CHARS):
            ids = np.frombuffer(b"".join(part), "<u4")
            if len(ids) and (ids.max() >= len(self.sizes) or (self.sizes[ids] < 0).any()):
                raise ValueError("an id has no token")
            sizes = self.sizes[ids]
            ends = np.cumsum(sizes)
            # Where each byte stands among the tokens: one further than the byte before, but for jumps between tokens.
            place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)
            flat = self.data[place].tobytes()
            stops = np.concatenate([[0], ends])[np.cumsum([len(x) // 4 for x in part])].tolist()
            for a, b in zip([0, *stops], stops):
                yield flat[a:b]


def _coder(kind: str, ranks: dict[bytes, int], pattern: str, make):
    """The worker's own encoder or decoder for these ranks."""
    state = worker_state("byte-level BPE")
    key = f"{kind} {len(ranks)} {hash(pattern)} {hash(tuple(sorted(ranks.items())))}"
    return state.get(key) or state.setdefault(key, make())


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens`` of each whole text.

    With ``decoded`` the ids are decoded again in the same pass, into a binary column of that name.
    """

    def make():
        encoder = _coder("encode", ranks, pattern, lambda: Encoder(ranks, pattern))
        decoder = _coder("decode", ranks, "", lambda: Decoder(ranks)) if decoded else None

        def of_batch(table: pa.Table) -> list[pa.Array]:
            ids = encoder.encode(texts(table, text))
            columns = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            return columns + ([pa.array(decoder.decode(ids), pa.binary())] if decoder else [])

        return of_batch

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(decoded, T.BinaryType())] if decoded else []
    return append_columns(df, fields, make, rows=ROWS, caches=True)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for; null ids decode to no bytes, unknown ids are an error."""

    def make():
        decoder = _coder("decode", ranks, "", lambda: Decoder(ranks))

        def of_batch(table: pa.Table) -> list[pa.Array]:
            return [pa.array(decoder.decode([x or b"" for x in table.column(ids).to_pylist()]), pa.binary())]

        return of_batch

    return append_columns(df, [T.StructField(out, T.BinaryType())], make, caches=True)
