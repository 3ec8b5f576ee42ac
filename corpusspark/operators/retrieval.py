"""Hybrid search for many queries at once: two channels, rank fusion, fair interleaving, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.functions.scalars import is_blank, snippet, tokens
from corpusspark.operators.encoding import encoded, reranker

#: Candidates of a channel, of one pool, of all pools together, and results; the constant of rank fusion.
PREFETCH, TOP_N, MULTI_TOP_N, DEFAULT_K, RRF = 50, 30, 60, 6, 60
#: Queries of one block: what a worker holds of them is bounded; more queries are searched block by block.
BLOCK = 4096
#: Scores a worker holds at once.
SCORES = 4_000_000
POOL = ["query_id", "subject"]


def resolved(requests: DataFrame, subjects: DataFrame, default_k: int = DEFAULT_K) -> DataFrame:
    """(query_id, subject, pool_no, n_pools, query, k): each request once for each subject it names.

    requests: request_id, subject (a name, or `all` in any case and spacing), query, k, received_at. Of
    repeated rows the one received last counts. Names are compared without outer space and case.
    Requests with a blank query, or a null or unknown subject, have no rows: see unresolved(). k null or
    0 is the default; a negative k is refused like an unknown subject. pool_no is the subject's place in
    the order of names.
    """
    one = requests.groupBy("request_id").agg(F.max(F.struct("received_at", "subject", "query", "k")).alias("r")).select("request_id", "r.*")
    catalogue = sorted(r[0] for r in subjects.select("name").where("name is not null").distinct().collect())  # the configured subjects
    names = subjects.sparkSession.createDataFrame([(n, i) for i, n in enumerate(catalogue)], "name string, pool_no int")
    asked = F.lower(F.trim("subject"))
    pools = one.select(F.col("request_id").alias("query_id"), asked.alias("asked"), "query", F.when(F.coalesce("k", F.lit(0)) == 0, default_k).otherwise(F.col("k")).alias("k"))
    pools = pools.where(~is_blank(F.col("query")) & (F.col("k") > 0))
    every = F.array(*[F.struct(F.lit(i).alias("pool_no"), F.lit(n).alias("name")) for i, n in enumerate(catalogue)]) if catalogue else F.array().cast("array<struct<pool_no:int,name:string>>")
    named = pools.where("asked <> 'all'").join(names, F.col("asked") == F.lower(F.trim("name"))).select("query_id", F.col("name").alias("subject"), "pool_no", "query", "k")
    spread = pools.where("asked = 'all'").select("query_id", "query", "k", F.explode(every).alias("n")).select("query_id", F.col("n.name").alias("subject"), "n.pool_no", "query", "k")
    both = named.unionByName(spread)
    return both.withColumn("n_pools", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).select("query_id", "subject", "pool_no", "n_pools", "query", "k")


def unresolved(requests: DataFrame, subjects: DataFrame) -> DataFrame:
    """(request_id, reason) of requests that cannot be searched: `blank query`, `unknown subject` or `bad k`."""
    one = requests.groupBy("request_id").agg(F.max(F.struct("received_at", "subject", "query", "k")).alias("r")).select("request_id", "r.*")
    names = subjects.select(F.lower(F.trim("name")).alias("known")).distinct()
    asked = F.lower(F.trim("subject"))
    found = one.join(names, asked == F.col("known"), "left")
    reason = F.when(is_blank(F.col("query")), "blank query").when(F.col("k") < 0, "bad k").when(F.col("known").isNull() & ~(F.coalesce(asked, F.lit("")) == "all"), "unknown subject")
    return found.select("request_id", reason.alias("reason")).where("reason is not null")


def with_vectors(requests: DataFrame, backend: str = "hashing", **options) -> DataFrame:
    """requests with dense and sparse of their query, by the encoder that has encoded the chunks."""
    queries = encoded(requests.select(F.col("query").alias("text")).distinct(), backend, **options).withColumnRenamed("text", "query")
    return requests.join(queries, "query").select(*requests.columns, "dense", "sparse")


def _ranked(scored: DataFrame, n: int, by: str = "score") -> DataFrame:
    """The n best of each query and pool with their rank; equal scores are in the order of chunk_id."""
    w = Window.partitionBy(*POOL).orderBy(F.col(by).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


class _Best:
    """The n best of each query that a task has seen, by score, then id."""

    def __init__(self, queries: int, n: int) -> None:
        self.n, self.least, self.held = n, np.full(queries, -np.inf), [[] for _ in range(queries)]

    def add(self, q: int, score: np.ndarray, ids: list) -> None:
        at = np.flatnonzero(score >= self.least[q])
        if len(at) > self.n:
            at = at[score[at] >= np.partition(score[at], -self.n)[-self.n]]
        if len(at):
            both = sorted([*self.held[q], *((-float(score[j]), ids[j]) for j in at)])[: self.n]
            self.held[q] = both
            if len(both) == self.n:
                self.least[q] = -both[-1][0]


def _blocks(queries: DataFrame) -> Iterator[list]:
    """The queries' rows, block by block, in the order of their ids."""
    blocks = max(1, -(-queries.select("query_id").distinct().count() // BLOCK))
    for b in range(blocks):
        yield sorted(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect(), key=lambda r: (r["query_id"], r["subject"]))


def _best_of_tasks(queries: DataFrame, rows: DataFrame, n: int, made: Callable[[list], object]) -> DataFrame:
    """(query_id, subject, chunk_id, score): of each task's rows the n best for each query and pool.

    rows: subject, chunk_id, and the columns to be scored. made(queries of one pool) gives a function from
    a batch of these columns to a matrix of scores, a row for each query; scores that are not finite do not
    count. At most n rows a query and pool leave a task, however many it reads, and no row is shuffled before.
    """
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema} | {f"own_{f.name}": f.dataType.simpleString() for f in rows.schema}
    found, rows = None, rows.where("chunk_id is not null")
    for block in _blocks(queries):
        pools: dict[str, list[int]] = {}
        for i, r in enumerate(block):
            pools.setdefault(r["subject"], []).append(i)
        scorers = {s: made([block[i] for i in own]) for s, own in pools.items()}
        shared = rows.sparkSession.sparkContext.broadcast((pools, scorers, [(r["query_id"], r["subject"]) for r in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pools, scorers, names = shared.value
            best = _Best(len(names), n)
            most = max(1, SCORES // max([1, *(len(p) for p in pools.values())]))
            for whole in batches:
                for i in range(0, whole.num_rows, most):
                    batch = whole.slice(i, most)
                    subject = np.array(batch.column(0).to_pylist(), object)
                    for s in set(subject.tolist()) & pools.keys():
                        part = batch.take(pa.array(np.flatnonzero(subject == s)))
                        ids = part.column(1).to_pylist()
                        for q, score in zip(pools[s], scorers[s](ids, *part.columns[2:]), strict=True):
                            best.add(q, np.where(np.isfinite(score), score, -np.inf) if score.size else score, ids)
            out = [(*names[q], c, -x) for q, held in enumerate(best.held) for x, c in held if x < np.inf]
            if out:
                yield pa.RecordBatch.from_pydict({k: [x[i] for x in out] for i, k in enumerate(("query_id", "subject", "chunk_id", "score"))})

        one = rows.mapInArrow(run, f"query_id {kinds['query_id']}, subject string, chunk_id {kinds['own_chunk_id']}, score double")
        found = one if found is None else found.unionByName(one)
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class _Cosine:
    """Cosines of one pool's queries with a batch of vectors; a vector of zeros has 0. alone: a vector with a query's own id has none."""

    def __init__(self, queries: list, alone: bool = False) -> None:
        q = np.array([r["dense"] for r in queries], np.float64)
        self.unit, self.ids = _unit(q), [r["query_id"] for r in queries] if alone else None

    def __call__(self, ids: list, dense: pa.Array) -> np.ndarray:
        own = _matrix(dense)
        if own.shape[1] != self.unit.shape[1]:
            raise ValueError(f"the queries' vectors have {self.unit.shape[1]} dimensions, the stored ones {own.shape[1]}")
        score = np.round(self.unit @ _unit(own).T, 9)
        if self.ids is not None:
            score[np.array(self.ids)[:, None] == np.array(ids)[None, :]] = -np.inf
        return score


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(size == 0, 1, size)


class _Dot:
    """Dot products of one pool's sparse queries with a batch of sparse vectors; those that share no term do not count."""

    def __init__(self, queries: list) -> None:
        terms = sorted((t, i, w) for i, r in enumerate(queries) for t, w in (r["sparse"] or {}).items())
        tokens = np.array([t for t, _, _ in terms], np.int64)
        self.n = len(queries)
        self.query, self.weight = np.array([i for _, i, _ in terms], np.int64), np.array([w for _, _, w in terms], np.float64)
        self.vocabulary, self.starts = np.unique(tokens, return_index=True)
        self.counts = np.diff(np.append(self.starts, len(tokens)))

    def __call__(self, ids: list, tokens: pa.Array, weights: pa.Array) -> np.ndarray:
        lens = np.diff(tokens.offsets.to_numpy())
        row = np.repeat(np.arange(len(ids)), lens)
        token, weight = tokens.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
        out = np.full((self.n, len(ids)), -np.inf)
        if not len(self.vocabulary) or not len(token):
            return out
        at = np.minimum(np.searchsorted(self.vocabulary, token), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == token
        at, row, weight = at[hit], row[hit], weight[hit]
        n = self.counts[at]
        spread = np.repeat(np.arange(len(at)), n)
        post = self.starts[at][spread] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = self.query[post] * len(ids) + row[spread]
        score = np.bincount(place, self.weight[post] * weight[spread], self.n * len(ids)).reshape(self.n, -1)
        met = np.bincount(place, minlength=self.n * len(ids)).reshape(self.n, -1) > 0
        out[met] = score[met]
        return out


def dense_topn(queries: DataFrame, chunks: DataFrame, n: int = PREFETCH) -> DataFrame:
    """(query_id, subject, chunk_id, score, rank): the chunks nearest by the cosine of the stored vectors, exactly.

    queries: query_id, subject, dense (see with_vectors()); chunks: subject, chunk_id, dense. Queries, a
    stated set that is small beside the chunks, go to the workers in blocks of BLOCK; a worker scores a batch of
    chunks against a block with one matrix product. Chunks without a vector are left out; vectors of zeros
    score 0; vectors of another size than the queries' are an error.
    """
    return _ranked(_best_of_tasks(queries.select("query_id", "subject", "dense"), chunks.where("dense is not null").select("subject", "chunk_id", "dense"), n, _Cosine), n)


def sparse_topn(queries: DataFrame, chunks: DataFrame, n: int = PREFETCH) -> DataFrame:
    """(query_id, subject, chunk_id, score, rank): the chunks with the greatest dot product of the stored sparse vectors, exactly.

    queries: query_id, subject, sparse; chunks: subject, chunk_id, sparse. Chunks that share no term with a
    query have no score. Scores are summed where the chunks are: no term, however common, is shuffled.
    """
    rows = chunks.where("sparse is not null").select("subject", "chunk_id", F.map_keys("sparse").alias("tokens"), F.map_values("sparse").alias("weights"))
    return _ranked(_best_of_tasks(queries.select("query_id", "subject", "sparse"), rows, n, _Dot), n)


def _alone(queries: list) -> _Cosine:
    return _Cosine(queries, alone=True)


def vector_topn(probes: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """(probe_id, vec_id, score, rank): the n nearest vectors of each probe by cosine, itself left out.

    probes and vectors: vec_id, embedding. Probes are a stated set and go to the workers in blocks of BLOCK;
    zero vectors score 0; a null vector is left out.
    """
    asked = probes.where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.lit("").alias("subject"), F.col("embedding").alias("dense"))
    rows = vectors.where("embedding is not null").select(F.lit("").alias("subject"), F.col("vec_id").alias("chunk_id"), "embedding")
    found = _ranked(_best_of_tasks(asked, rows, n, _alone), n)
    return found.select(F.col("query_id").alias("probe_id"), F.col("chunk_id").alias("vec_id"), "score", "rank")


def rrf(channels: list[DataFrame], limit: int | None = None, constant: int = RRF) -> DataFrame:
    """(query_id, subject, chunk_id, rrf, pool_rank): reciprocal ranks of all channels, summed, the best `limit` of each pool."""
    every = channels[0].select(*POOL, "chunk_id", "rank")
    for c in channels[1:]:
        every = every.unionByName(c.select(*POOL, "chunk_id", "rank"))
    fused = every.groupBy(*POOL, "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("rrf"))
    w = Window.partitionBy(*POOL).orderBy(F.col("rrf").desc(), "chunk_id")
    found = fused.withColumn("pool_rank", F.row_number().over(w))
    return found if limit is None else found.where(F.col("pool_rank") <= limit)


def dbsf(channels: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Like rrf(), by scores: each channel's are brought to [0, 1] between three deviations of its mean, and summed.

    A channel whose scores are all equal, or that has one, counts one half.
    """
    w = Window.partitionBy(*POOL)
    every = None
    for c in channels:
        m, s = F.avg("score").over(w), F.stddev_pop("score").over(w)
        x = F.when(s > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") - (m - 3 * s)) / (6 * s)))).otherwise(0.5)
        one = c.select(*POOL, "chunk_id", x.alias("x"))
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy(*POOL, "chunk_id").agg(F.round(F.sum("x"), 6).alias("dbsf"))
    found = fused.withColumn("pool_rank", F.row_number().over(w.orderBy(F.col("dbsf").desc(), "chunk_id")))
    return found if limit is None else found.where(F.col("pool_rank") <= limit)


def union_pool(channels: list[DataFrame]) -> DataFrame:
    """(query_id, subject, chunk_id) that any channel has."""
    every = channels[0].select(*POOL, "chunk_id")
    for c in channels[1:]:
        every = every.union(c.select(*POOL, "chunk_id"))
    return every.distinct()


def interleaved(pools: DataFrame, budget_one: int = TOP_N, budget_many: int = MULTI_TOP_N) -> DataFrame:
    """pools with pos: the first of each pool, then the second of each, and so on, cut at the budget.

    pools: query_id, pool_no, n_pools, pool_rank. The budget goes by the pools asked for, whether they
    have candidates or not.
    """
    w = Window.partitionBy("query_id").orderBy("pool_rank", "pool_no")
    budget = F.when(F.col("n_pools") > 1, budget_many).otherwise(budget_one)
    return pools.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= budget)


def overlap_score(query, text):
    """The stand-in for a cross-encoder: the share of the query's different words that the text has, less a half.

    Its sign tells relevant from not, as a logit's does; it has not a model's quality.
    """
    q = F.array_distinct(tokens(query))
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)) - 0.5, 9)


def scored(candidates: DataFrame, backend: str | None = "overlap", **options) -> DataFrame:
    """candidates with score: the reranker's of each query and text, or the fusion's if backend is None.

    candidates: query_id, query, text, rrf. `overlap` is scored without leaving the JVM; other rerankers
    get the texts of one query together, as they come in a batch; a null text is an empty one.
    """
    if backend is None:
        return candidates.withColumn("score", F.coalesce("rrf", F.lit(0.0)))
    if backend == "overlap":
        return candidates.withColumn("score", overlap_score(F.col("query"), F.col("text")))
    reranker(backend)  # an unknown one is an error here, not in a worker
    names = [c for c in candidates.columns if c != "score"]
    q, t = names.index("query"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = reranker(backend)(**options)
        for batch in batches:
            queries, texts = (batch.column(i).to_pylist() for i in (q, t))
            score = np.zeros(len(queries))
            for x in dict.fromkeys(queries):
                own = [i for i, y in enumerate(queries) if y == x]
                score[own] = model.score(x or "", [texts[i] or "" for i in own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*names, "score"])

    fields = ", ".join(f"`{c}` {candidates.schema[c].dataType.simpleString()}" for c in names)
    return candidates.select(*names).mapInArrow(run, f"{fields}, score double")


def reranked(candidates: DataFrame, backend: str | None = "overlap", **options) -> DataFrame:
    """The k best candidates of each query by the reranker, or by fusion if it is None; equal scores keep their order.

    candidates: query_id, query, k, chunk_id, text, rrf, pos.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pos")
    return scored(candidates, backend, **options).withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("k"))


def retrieved(requests: DataFrame, chunks: DataFrame, prefetch: int = PREFETCH, one: int = TOP_N, many: int = MULTI_TOP_N, channels: list[DataFrame] | None = None) -> DataFrame:
    """Fused, interleaved and capped candidates of resolved requests: ids and scores only, texts join later.

    channels: ranked lists that reach to prefetch or deeper, if they are there already; a shallower
    retrieval is a prefix of a deeper one.
    """
    limit = max(one, many)
    found = [dense_topn(requests, chunks, prefetch), sparse_topn(requests, chunks, prefetch)] if channels is None else [c.where(F.col("rank") <= prefetch) for c in channels]
    fused = rrf(found, limit)
    pools = fused.join(requests.select(*POOL, "pool_no", "n_pools", "query", "k"), POOL)
    return interleaved(pools.where(F.col("pool_rank") <= F.when(F.col("n_pools") > 1, many).otherwise(one)), one, many)


def search(requests: DataFrame, chunks: DataFrame, rerank: str | None = "overlap", rerank_options: dict | None = None, **depths: int) -> DataFrame:
    """(query_id, place, score, subject, source_path, section, last_updated, doc_id, chunk_id, snippet, text) of the k best.

    requests: of resolved(), with_vectors(). chunks: one row a chunk_id with subject, doc_id, text, dense, sparse and
    what is cited. A subject without chunks gives nothing; a query without candidates has no rows.
    """
    payload = chunks.select("subject", "chunk_id", "doc_id", "source_path", F.col("section_path").alias("section"), "last_updated", "text")
    found = reranked(retrieved(requests, chunks, **depths).join(payload, ["subject", "chunk_id"]), rerank, **(rerank_options or {}))
    return found.select("query_id", "place", "score", "subject", "source_path", "section", "last_updated", "doc_id", "chunk_id", snippet(F.col("text")).alias("snippet"), "text")
