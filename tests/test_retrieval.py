"""Search against brute force, and the measures of its quality."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from corpusspark.operators import encoding, evaluation, retrieval
from tests.conftest import rows

REQ = "request_id bigint, subject string, query string, k int, received_at timestamp"
CHUNK = "subject string, chunk_id string, doc_id string, source_path string, section_path string, last_updated string, text string"


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(11)
    words = [f"word{i}" for i in range(30)]
    chunks = [(s, f"{s}{i}", f"d{i}", None, None, None, r.choice([None, "", " ".join(r.choices(words, k=r.randrange(1, 25)))]) if i % 7 == 0 else " ".join(r.choices(words, k=8))) for s, n in (("a", 80), ("b", 9), ("c", 0)) for i in range(n)]
    asked = [(1, "a", "word1 word2 word2", 3, None), (2, " ALL ", "word3 word4", None, None), (3, "nobody", "word1", 1, None), (4, "a", "  ", 1, None), (5, None, "word1", 1, None), (6, "b", "zzz", 2, None), (7, "c", "word1", 2, None), (8, "a", "word1", -1, None), (1, "a", "word1 word2 word2", 3, None)]
    subjects = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    requests = spark.createDataFrame(asked, REQ)
    stored = encoding.encoded(spark.createDataFrame(chunks, CHUNK), unit=False).cache()
    return stored, retrieval.with_vectors(retrieval.resolved(requests, subjects), unit=False), retrieval.unresolved(requests, subjects), chunks


def _brute(chunks, pools, query, k, rerank, prefetch=50, one=30, many=60):
    tok = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    model = encoding.HashingEncoder()
    q, qd = Counter(tok(query)), model.counts([query])[0]
    lists = []
    for pool in pools:
        own = [(c[1], c[6]) for c in chunks if c[0] == pool]
        cos = lambda v: float(qd @ v) / max(math.sqrt(qd @ qd) * math.sqrt(v @ v), 1e-300)
        dense = sorted(((-round(cos(model.counts([t])[0]), 9), c) for c, t in own))[:prefetch]
        sparse = sorted((-s, c) for c, t in own if (s := sum(q[w] * n for w, n in Counter(tok(t)).items())) > 0)[:prefetch]
        score = Counter()
        for channel in (dense, sparse):
            for rank, (_, c) in enumerate(channel, 1):
                score[c] += 1 / (60 + rank)
        lists.append(sorted((-round(s, 9), c) for c, s in score.items())[: many if len(pools) > 1 else one])
    mixed = [lst[i] for i in range(max(map(len, lists), default=0)) for lst in lists if i < len(lst)][: many if len(pools) > 1 else one]
    text = {c[1]: c[6] for c in chunks}
    value = lambda x: round(len(set(q) & set(tok(text[x[1]]))) / max(len(q), 1) - 0.5, 9) if rerank else -x[0]
    return [(value(x), x[1]) for x in sorted(mixed, key=lambda x: -value(x))[:k]]


@pytest.mark.parametrize("rerank", ["overlap", None])
def test_search_equals_brute_force(world, rerank):
    chunks, resolved, _, data = world
    found = {}
    for r in retrieval.search(resolved, chunks, rerank).orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append((r.score, r.chunk_id))
    assert found[1] == _brute(data, ["a"], "word1 word2 word2", 3, rerank)
    assert found[2] == _brute(data, ["a", "b", "c"], "word3 word4", 6, rerank)
    assert found[6] == _brute(data, ["b"], "zzz", 2, rerank)
    assert set(found) == {1, 2, 6}  # a pool without chunks gives nothing


def test_unresolved(world):
    assert rows(world[2]) == [(3, "unknown subject"), (4, "blank query"), (5, "unknown subject"), (8, "bad k")]


def test_fusion_does_not_hang_on_the_order_of_channels(world):
    chunks, resolved, _, _ = world
    a, b = retrieval.dense_topn(resolved, chunks, 10), retrieval.sparse_topn(resolved, chunks, 10)
    assert rows(retrieval.rrf([a, b])) == rows(retrieval.rrf([b, a]))
    assert all(0 <= r.dbsf <= 2 for r in retrieval.dbsf([a, b]).collect())


def test_interleaving_is_fair_and_capped(spark):
    data = [(1, "a", 0, 2, f"a{i}", i) for i in range(1, 5)] + [(1, "b", 1, 2, f"b{i}", i) for i in range(1, 3)] + [(2, "a", 0, 1, f"a{i}", i) for i in range(1, 4)]
    df = spark.createDataFrame(data, "query_id int, subject string, pool_no int, n_pools int, chunk_id string, pool_rank int")
    found = [(r.query_id, r.chunk_id) for r in retrieval.interleaved(df, 2, 5).orderBy("query_id", "pos").collect()]
    assert found == [(1, "a1"), (1, "b1"), (1, "a2"), (1, "b2"), (1, "a3"), (2, "a1"), (2, "a2")]


def test_ties_keep_the_candidates_order(spark):
    df = spark.createDataFrame([(1, "x", 2, "b", "x y", 0.5, 2), (1, "x", 2, "a", "y x", 0.1, 3), (1, "x", 2, "c", "x", None, 1)], "query_id int, query string, k int, chunk_id string, text string, rrf double, pos int")
    assert [r.chunk_id for r in retrieval.reranked(df).orderBy("place").collect()] == ["c", "b"]
    assert [r.chunk_id for r in retrieval.reranked(df, None).orderBy("place").collect()] == ["b", "a"]


def test_vectors_nearest(spark):
    r = np.random.default_rng(1)
    v = [(i, [float(x) for x in r.integers(-3, 4, 6)]) for i in range(40)] + [(99, None), (98, [0.0] * 6)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<double>")
    found = {}
    for x in retrieval.vector_topn(df.where("vec_id < 3"), df, 4).orderBy("probe_id", "rank").collect():
        found.setdefault(x.probe_id, []).append(x.vec_id)
    unit = lambda a: np.array(a) / (np.linalg.norm(a) or 1)
    for p in range(3):
        want = sorted((-round(float(unit(v[p][1]) @ unit(e)), 9), i) for i, e in v if e is not None and i != p)
        assert found[p] == [i for _, i in want[:4]]
    assert retrieval.vector_topn(df.limit(0), df, 2).count() == 0


def test_encoders(spark):
    dense, sparse = encoding.HashingEncoder().encode(["a a b", ""])
    assert abs(np.linalg.norm(dense[0]) - 1) < 1e-12 and not dense[1].any() and sorted(sparse[0].values()) == [1.0, 2.0] and sparse[1] == {}
    df = spark.createDataFrame([(1, "a a b"), (2, None)], "id int, text string")
    got = encoding.encoded(df).orderBy("id").collect()
    assert np.allclose(got[0].dense, dense[0]) and got[0].sparse == sparse[0] and got[1].sparse == {}
    with pytest.raises(ValueError):
        encoding.encoder("none")
    with pytest.raises(FileNotFoundError):
        encoding.encoder("onnx", folder="/nowhere")
    hidden = np.array([[[3.0, 4.0], [1.0, 0.0], [2.0, 0.0], [9.0, 9.0]]])
    d, s = encoding.heads(hidden, np.array([[0, 5, 5, 7]]), np.array([[1, 1, 1, 0]]), np.array([1.0, 0.0]), -0.5, frozenset({0}))
    assert d.tolist() == [[0.6, 0.8]] and s == [{5: 1.5}]


def test_another_encoder_changes_what_is_found(spark):
    data = [("a", "1", "d", None, None, None, "alpha beta"), ("a", "2", "d", None, None, None, "ant bee"), ("a", "3", "d", None, None, None, "xray yoke")]
    asked = spark.createDataFrame([(1, "a", 0, 1, "apple ball", 3)], "query_id bigint, subject string, pool_no int, n_pools bigint, query string, k int")
    found = {}
    for backend in ("hashing", "tests.plugins:FirstLetters"):
        chunks = encoding.encoded(spark.createDataFrame(data, CHUNK), backend)
        q = retrieval.with_vectors(asked, backend)
        found[backend] = [(r.chunk_id, r.score) for r in retrieval.dense_topn(q, chunks, 2).orderBy("rank").collect()], sorted(r.chunk_id for r in retrieval.sparse_topn(q, chunks, 9).collect())
    assert found["tests.plugins:FirstLetters"] == ([("1", 1.0), ("2", 1.0)], ["1", "2"]) and found["hashing"][1] == []
    with pytest.raises(Exception, match="26 dimensions"):
        retrieval.dense_topn(retrieval.with_vectors(asked, "tests.plugins:FirstLetters"), encoding.encoded(spark.createDataFrame(data, CHUNK)), 2).collect()


def test_a_reranker_of_ones_own(spark):
    df = spark.createDataFrame([(1, "x", 2, "b", "long text", 0.5, 1), (1, "x", 2, "a", "t", 0.1, 2), (1, "x", 2, "c", None, None, 3), (2, "y", 1, "d", "text", 0.2, 1)], "query_id int, query string, k int, chunk_id string, text string, rrf double, pos int")
    found = retrieval.reranked(df, "tests.plugins:Shortest", bonus=2.0).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in found] == [(1, "c", 2.0), (1, "a", 1.0), (2, "d", -2.0)]
    with pytest.raises(ValueError, match="unknown reranker"):
        retrieval.reranked(df, "none")


def test_few_rows_leave_a_task(spark):
    q = spark.createDataFrame([(i, "s", [1.0, float(i)], {1: 1.0}) for i in range(3)], "query_id bigint, subject string, dense array<float>, sparse map<bigint,double>")
    c = spark.range(5000).selectExpr("'s' as subject", "cast(id as string) as chunk_id", "array(cast(1 as float), cast(id % 7 as float)) as dense", "map(id % 3, cast(id % 11 as double)) as sparse").repartition(3)
    rows_ = c.select("subject", "chunk_id", "dense")
    assert retrieval._best_of_tasks(q.select("query_id", "subject", "dense"), rows_, 5, retrieval._Cosine).count() <= 3 * 3 * 5
    want = sorted((-float(i % 11), str(i)) for i in range(5000) if i % 3 == 1)[:5]
    assert [(-r.score, r.chunk_id) for r in retrieval.sparse_topn(q.where("query_id = 1"), c, 5).orderBy("rank").collect()] == want


def test_model_folders_must_be_whole(tmp_path):
    pytest.importorskip("onnxruntime")
    names = ["model.int8.onnx", "tokenizer.json", "sparse_linear.npz"]
    for n in names:
        with pytest.raises(FileNotFoundError, match=n.replace(".", r"\.")):
            encoding.encoder("onnx", folder=str(tmp_path))
        (tmp_path / n).write_text("{}")
    with pytest.raises(FileNotFoundError):
        encoding.reranker("onnx")(folder=str(tmp_path), int8=False)


def test_measures(spark):
    lat = spark.createDataFrame([("a", float(x)) for x in range(1, 21)] + [("b", 5.0), ("b", None)], "stage string, ms double")
    assert rows(evaluation.latency(lat, "stage", "ms")) == [("a", 20, 1.0, 10.5, 10.5, 19.0, 20.0), ("b", 1, 5.0, 5.0, 5.0, 5.0, 5.0)]
    sets = spark.createDataFrame([([1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>")
    assert rows(evaluation.set_parity(sets)) == [(2, round((1 / 3 + 1) / 2, 6))]
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id int, chunk_id string")
    ch = spark.createDataFrame([(1, "a", 4), (2, "c", 12)], "query_id int, chunk_id string, rank int")
    assert rows(evaluation.gold_ranks(gold, ch, 20)) == [(1, "a", 4), (1, "b", 21), (2, "c", 12)]
    from pyspark.sql import functions as F

    assert rows(evaluation.channel_diagnosis(evaluation.gold_ranks(gold, ch, 20).withColumn("channel", F.lit("x")), 20)) == [("x", 3, 12, 12, 1, 1)]
    pools = spark.createDataFrame([("p", 1, "a"), ("p", 1, "b"), ("q", 2, "c")], "strategy string, query_id int, chunk_id string")
    assert rows(evaluation.coverage(pools, gold, ["p", "q", "none"])) == [("none", 0, 3, 0, 0.0), ("p", 1, 1, 2, 0.54), ("q", 1, 2, 1, 0.27)]


def test_out_of_vocabulary_query_has_no_sparse_hit(spark, world):
    chunks, resolved, _, _ = world
    assert retrieval.sparse_topn(resolved.where("query_id = 6"), chunks).count() == 0
