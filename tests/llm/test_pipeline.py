"""The registered queries of the corpus operators, and the pipeline against a direct version."""

from __future__ import annotations

import re

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from test_pairs import direct_components, shingles

from demandspark.llm import bpe, language_id, queries
from demandspark.llm.common import text_bytes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())


def test_pipeline_matches_direct_version(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    model = language_id.fit(documents)
    order = sorted(i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t))
    usual = model.judge([texts[i].encode() for i in order])[1]
    texts = {i: texts[i] for i, kept in zip(order, usual.tolist(), strict=True) if kept}
    texts = {i: t for i, t in texts.items() if i == max(j for j, u in texts.items() if u == t)}
    label = direct_components(texts, 5, 80)
    texts = {i: t for i, t in texts.items() if label[i] == i}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    own = [shingles(i, 5) for i in items]
    held = {d: shingles(plain(t), 5) for d, t in texts.items()}
    texts = {d: t for d, t in texts.items() if not any(100 * len(o & held[d]) >= 80 * len(o) for o in own)}
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == set(texts)
    codec = bpe.codec(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for i, r in rows.items():
        assert (r["text"], r["ids"], r["n_tokens"]) == (texts[i], np.frombuffer(codec.encode([texts[i]])[0], np.uint32).tolist(), len(r["ids"]))


def test_stages_keep_the_columns(spark, docs):
    frame = docs(None, "", "1", "a b c d e f g", "a b c d e f g", (None, "a b c d e f g"), (9, "x y z"), (9, "x y z"), extra="keep_id")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        assert out.filter("doc_id = 9").count() == 2, name  # repeated rows stay or go together
    assert corpus_pipeline.STAGES[0][1](spark, frame, SF).columns == frame.columns
    empty = frame.limit(0)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_null_texts_count_as_empty():
    import pyarrow as pa

    assert text_bytes(pa.array(["a", None, "é"])) == [b"a", b"", "é".encode()]
