import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from jointflow.llm import bpe
from tables import documents, frame

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def ids(text):
    return np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aab '\n\t\r\x1c\x85\xa0 éß1,.!s")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_are_the_librarys(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "the" * 5_000, " " * 3_000, "\n " * 2_000, "é" * 4_000, "aaab" * 4_000])
def test_very_long_pretokens(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_merges_of_lower_rank_come_first_even_when_they_appear_late():
    ranks = {bytes([b]): b for b in range(256)} | {b"bcd": 256, b"bc": 300, b"cd": 301, b"ab": 400}
    library = tiktoken.Encoding("x", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks, r".+")
    for text in ("bcbcd", "abcd", "bcdbcd", "cdbcbcd"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_rank_queue():
    queue = bpe.RankQueue(200_000)
    for rank in (199_999, 64, 4_096, 5, 63, 64):
        queue.push(rank, rank)
    seen = []
    while (rank := queue.first()) >= 0:
        seen.append(rank)
        assert queue.take(rank)
    assert seen == [5, 63, 64, 4_096, 199_999]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in ("one two three four", "two five six", "one seven eight two", "one"):
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_tables(spark):
    rows = documents()
    df = frame(spark, rows).selectExpr("*", "1 AS ids", "'x' AS decoded")
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    got = out.select("doc_id", "text", "n_tokens", "ids", "decoded", "lang").collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == LIBRARY.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r.n_tokens == len(r.ids) // 4 and r.lang == "en"
    assert bpe.decode(bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


@pytest.mark.parametrize("wide", [1, 3, 10**9])
def test_wide_steps_are_single_steps(wide, monkeypatch):
    import random

    monkeypatch.setattr(bpe, "WIDE", wide)
    rng = random.Random(wide)
    words = ["".join(rng.choices("aabéth ", k=rng.randrange(1, 60))) for _ in range(300)] + ["a" * 500]
    library = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=RANKS, special_tokens={})
    got = bpe.Merger(RANKS).merge([w.encode() for w in words])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(w) for w in words]


def test_decoder():
    ids = [np.array(x, "<u4").tobytes() for x in ([], [5, 5, 300], [40000])]
    by_rank = {r: t for t, r in RANKS.items()}
    assert list(bpe.Decoder(RANKS).decode(ids)) == [b"", by_rank[5] * 2 + by_rank[300], by_rank[40000]]
    with pytest.raises(ValueError):
        list(bpe.Decoder(RANKS).decode([np.array([10**6], "<u4").tobytes()]))


def test_no_garbage_is_looked_for_while_texts_are_encoded():
    import gc

    runs = []
    note = lambda phase, info: runs.append(phase)
    gc.callbacks.append(note)
    try:
        made = bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode([" ".join(f"word{i}x{i * 7}" for i in range(20_000))])
    finally:
        gc.callbacks.remove(note)
    assert len(made) == 1 and not runs and gc.isenabled()


def test_two_hundred_thousand_words_are_merged_once():
    from itertools import islice, product

    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    words = ["".join(x) for x in islice(product("qxzjvkwybmfp", repeat=6), 0, 800_000, 4)]
    batches = [[" ".join(words[at : at + 20_000])] for at in range(0, len(words), 20_000)]
    first = [encoder.encode(b) for b in batches]
    merged, merge = [], encoder.merger.merge
    encoder.merger.merge = lambda new: merged.extend(new) or merge(new)
    assert [encoder.encode(b) for b in batches] == first
    assert len(merged) <= len(batches)
