"""Arrow batches are worked on in pieces of bounded size, with the same answers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import pieces as pc
from tidewatch.operators import postings, retrieval as rt


def test_pieces_hold_every_row_once():
    lists = [["a"] * n for n in (0, 3, 9, 0, 1, 1, 25, 2)] + [None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "tokens": pa.array(lists, pa.list_(pa.string()))})
    out = list(pc.pieces([batch, batch.slice(2, 3), batch.slice(9)], "tokens", 10))
    assert [i for p in out for i in p.column("id").to_pylist()] == [*range(9), 2, 3, 4]
    sizes = [(p.num_rows, len(p.column("tokens").flatten())) for p in out]
    assert all(n <= 10 or rows == 1 for rows, n in sizes)


@pytest.fixture
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "", " ".join(f"w{w}" for w in rng.zipf(1.4, rng.integers(0, 60)) if w < 500)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string").coalesce(1)
    claims = docs.filter("doc_id < 12").select((F.col("doc_id") + 1000).alias("claim_id"), F.left("text", F.lit(80)).alias("text"))
    return docs, claims


def seen(monkeypatch, module, limit):
    """Tokens come in pieces of ``limit``; the work gets no more at a time."""
    monkeypatch.setattr(module, "pieces", lambda batches, column, size=0: pc.pieces(batches, column, limit))


@pytest.mark.parametrize("search", [rt.bm25, rt.bm25_postings])
def test_searches_do_not_depend_on_pieces(spark, corpus, monkeypatch, search):
    docs, claims = corpus
    want = sorted(map(tuple, search(claims, docs, 5).collect()))
    seen(monkeypatch, rt, 100)
    seen(monkeypatch, postings, 100)
    assert sorted(map(tuple, search(claims, docs, 5).collect())) == want and len(want) == 60


def test_vectors_do_not_depend_on_pieces(spark, corpus, monkeypatch):
    docs, _ = corpus
    want = rt.embed_docs(docs).orderBy("doc_id").collect()
    seen(monkeypatch, rt, 100)
    assert rt.embed_docs(docs).orderBy("doc_id").collect() == want and len(want) == 200


def test_few_queries_do_not_widen_the_vectors_at_work(monkeypatch):
    """Wide documents are made dense a few at a time, also when there is one query."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(50, 20))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "vector": vectors.tolist()})
    dense, sizes = rt._dense, []
    monkeypatch.setattr(rt, "CELLS", 100)
    monkeypatch.setattr(rt, "_dense", lambda column, dim: sizes.append(len(column)) or dense(column, dim))

    class Shared:
        value = (np.array([7]), vectors[:1] / np.linalg.norm(vectors[0]))

    run = rt._score_vectors(Shared, 3, None, [pa.int64(), pa.int64()])
    found = pa.Table.from_batches(list(run(iter([batch])))).to_pydict()
    assert max(sizes) == 5 and sum(sizes) == 50
    assert found["doc_id"][0] == 0 and found["vector_score"][0] == 1.0 and len(found["doc_id"]) == 3
