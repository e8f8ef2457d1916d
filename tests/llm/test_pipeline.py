"""The pipeline: its stages' decisions take effect, and clean documents stay."""

import hashlib

import pytest

from glyphsift.llm import bpe
from glyphsift.llm.queries import oracle_sql, queries, tokenizer_path
from tests.llm.test_operators import ITEM, clashing, prose


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    toxic = range(200, 230)
    texts = {k: prose(60, k) for k in range(100)} | {k: prose(60, k) + " idiot" for k in toxic}
    texts |= {500: "123 456", 501: texts[7], 502: texts[8] + " " + ITEM, 503: ITEM, 504: None}
    docs = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint", "documents")
    write([(k, int(k in toxic)) for k in texts if k < 500], "doc_id bigint, toxic int", "labels")
    write([(1, ITEM)], "item_id bigint, text string", "benchmark")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(100))
    own = bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))
    ids = own.encode(texts[3])
    assert got[3].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


ROWS = [(1, prose(60, 1)), (1, prose(60, 2)), (2, prose(60, 1)), (2, prose(60, 1)), (3, prose(60, 3) + " idiot"), (3, prose(60, 4)), (4, ITEM), (4, prose(60, 5)), (5, None), (6, ""), (7, "12 !"), (None, prose(60, 6)), (None, None), (8, prose(9000, 7))]


def write_tables(spark, folder, rows):
    """Tables whose labels and languages are learnt from documents of their own."""
    docs = [(k, t, "en", "s", len(t or "")) for k, t in rows]
    docs += [(k, prose(40, k) + (" idiot" if k % 3 == 0 else ""), "en", "s", 9) for k in range(1000, 1150) if rows]
    write = lambda rows, schema, name: clashing(spark.createDataFrame(rows, schema)).write.parquet(f"{folder}/{name}.parquet")
    write(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint", "documents")
    write([(k, int(k % 3 == 0)) for k in range(1000, 1150)], "doc_id bigint, toxic int", "labels")
    write([(1, ITEM)], "item_id bigint, text string", "benchmark")


@pytest.mark.parametrize(("stage", "gone"), [("language", [(5, None), (6, ""), (7, "12 !"), (None, None)]), ("toxicity", [ROWS[4]]), ("near_duplicates", [ROWS[2], ROWS[3], (6, "")]), ("decontamination", [ROWS[6]])])
def test_stages_decide_by_row(spark, tmp_path, stage, gone):
    import corpus_pipeline

    write_tables(spark, tmp_path, ROWS)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect() if r.doc_id is None or r.doc_id < 1000), key=repr)
    assert kept == sorted((r for r in ROWS if r not in gone), key=repr)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    write_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
    assert {*queries(), "pipeline"} <= set(__spark_entry__.queries())
