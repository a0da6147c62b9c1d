import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from jointflow.llm import token_output
from tables import documents, frame
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=3_000))
def test_round_trip(values):
    values = np.array(values, np.uint64)
    words, first, escapes = token_output.pack(values)
    assert (token_output.unpack(words, escapes) == values).all()
    # A block can be read by itself from its first word.
    if len(first) > 1 and not len(escapes):
        part = token_output.unpack(words[first[1] :], escapes)
        assert (part == values[token_output.BLOCK :]).all()


@pytest.mark.parametrize("count,bits", list(zip(token_output.COUNTS, token_output.BITS)))
def test_a_word_takes_as_many_as_fit(count, bits):
    top = min((1 << int(bits)) - 1, token_output.ESCAPE - 1)
    values = np.full(count, top, np.uint64)
    assert len(token_output.pack(values)[0]) == 1
    if 1 < count < 240 and bits:
        assert len(token_output.pack(np.append(values, values[:1]))[0]) == 2


def test_words_are_encoded_like_whole_texts():
    encoder = token_output.WordEncoder(open(PATH, "rb").read())
    texts = [t or "" for _, t in documents()] + ["don't foo,bar. X.,; a.b,c 12,3 É! é, ≮ İstanbul ΑΣ, ΑΣ", "#$%&* word#$%&*"]
    texts += ["é. \u0958, ñ!! x²; ١, e\u0301, İ. ., " + "long" * 30 + ",", "É. é. Long, long"]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_IDS", 2_000)
    rows = documents()
    df = frame(spark, rows).selectExpr("*", "1 AS start", "'x' AS file", "2 AS tie")
    path = f"{tmp_path}/tokens"
    files = token_output.write_tokens(df, PATH, path, end_id=2)
    assert len(glob.glob(f"{path}/*.s8b")) == files.count() > 3
    got = token_output.read_tokens(spark, path, files).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    expected = sorted(
        (-1 if d is None else 0, d or 0, [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows
    )
    mine = sorted((-1 if r.doc_id is None else 0, r.doc_id or 0, list(r.ids)) for r in got)
    assert mine == expected
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens


def test_no_rows(spark, tmp_path):
    path = f"{tmp_path}/none"
    files = token_output.write_tokens(frame(spark, []), PATH, path, end_id=2)
    assert files.count() == 0 and token_output.read_tokens(spark, path, files).count() == 0


def test_a_cut_file_is_an_error():
    content = token_output.encode_file([1, None], [b"\1\0\0\0", b""])
    assert token_output.decode_file(content)[0] == [1, None]
    with pytest.raises(ValueError):
        token_output.decode_file(b"other" + content[5:])
    with pytest.raises(ValueError):
        token_output.decode_file(content[:-8])
