"""The registered queries against their SQL, and the pipeline's stages against brute force."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import TESTDATA, connect, difference
from jointflow.llm import bpe, decontamination, pii
from jointflow.llm.queries import ORACLES, QUERIES
from tables import documents, frame
from test_decontamination import nearest
from test_ngram_join import brute_force, shingles
from test_pii import TEXTS

SF = TESTDATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    table = QUERIES[name](spark, str(SF)).toArrow()
    assert table.num_rows > 0
    assert difference(table, connect("sf0.001").execute(ORACLES[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_on_odd_rows(spark, name, tmp_path):
    import duckdb

    docs = frame(spark, documents(30) + [(2000 + i, t) for i, t in enumerate(["a@b.c.d 10.1.2.3", "mit license", "+1 (017) 555-7713", *[t for t in TEXTS if len(t) < 500]])])
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [float(i % 7) - 3, 0.5, None if i == 9 else 0.1], 0) for i in range(120)] + [(50, None, 0), (None, [1.0], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 2003, 3)] + [(3, 1, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    table = QUERIES[name](spark, str(tmp_path)).toArrow()
    assert difference(table, con.execute(ORACLES[name]).to_arrow_table()) is None


def test_stages(spark, tmp_path):
    """Each stage on what its predecessor kept."""
    sf = str(SF)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.select(*docs.columns)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], sf)
        out.write.parquet(f"{tmp_path}/{len(kept)}")
        kept.append(spark.read.parquet(f"{tmp_path}/{len(kept)}"))
    rows = [{r.doc_id: r for r in df.collect()} for df in kept]
    assert all(df.columns == docs.columns for df in kept[:-1])
    assert len(rows[0]) >= len(rows[1]) >= len(rows[2]) >= len(rows[3]) == len(rows[4]) == len(rows[5])
    assert len(rows[1]) > 0.9 * len(rows[0])

    texts = [(d, r.text) for d, r in rows[1].items()]
    groups = {d: c for d, _, c in brute_force(texts)}
    assert set(rows[2]) == {d for d, c in groups.items() if d == c}

    items = [decontamination.fold(r.text).split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = set()
    for d, r in rows[2].items():
        w = decontamination.fold(r.text).split()
        if len(w) > 3_000:  # the plain table takes long; such texts are taken from the stage
            clean |= {d} & set(rows[3])
        elif not any(nearest(x, w) <= int(len(x) * decontamination.BUDGET) for x in items if set(x) & set(w)):
            clean.add(d)
    assert set(rows[3]) == clean

    spans = {r.doc_id: r.spans for r in pii.find_spans(kept[3]).collect()}
    for d, r in rows[4].items():
        assert (r.text != rows[3][d].text) == bool(spans[d])
        assert r.n_chars == (len(r.text) if spans[d] else rows[3][d].n_chars)
    library = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        special_tokens={},
    )
    for d, r in rows[5].items():
        assert r.decodes and np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(rows[4][d].text)


def test_run(spark):
    out = corpus_pipeline.run(spark, str(SF))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decodes"] and out.count() > 100


def test_odd_documents_pass_all_stages(spark):
    rows = documents(40)
    df = frame(spark, rows).selectExpr("*", "1 AS leaked", "2 AS spans", "3 AS score", "4 AS _row2")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(SF))
        assert "spans" in df.columns and "leaked" in df.columns
    last = corpus_pipeline.STAGES[-1][1](spark, df, str(SF)).collect()
    assert all(r.decodes for r in last)
    assert {t for _, t in rows if not shingles(t)} == {None, "", " \t\n"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), str(SF)).count() == 0


def test_columns_of_the_caller_keep_their_values(spark):
    own = {"score": 7.5, "log_ratio": 1.0, "predicted": 1.0, "leaked": 3.0, "spans": 4.0, "_row": 5.0, "_copy": 6.0, "own": 8.0}
    df = frame(spark, documents(40)).selectExpr("*", *[f"double({v}) AS {n}" for n, v in own.items()])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = df.columns
        df = stage(spark, df, str(SF))
        assert df.columns == columns
    assert {tuple(r) for r in df.select(*own).collect()} == {tuple(own.values())}


def test_rows_without_words_all_stay(spark):
    rows = [(1, None), (1, None), (None, None), (2, ""), (3, " \t\n"), (4, "some words"), (4, "some words"), (5, "some words")]
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(SF))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(rows[:6], key=repr)
