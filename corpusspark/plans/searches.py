"""Queries of search and its evaluation: every request whose id is divisible by 50, against all chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.functions.scalars import quantized, rank_display
from corpusspark.operators import encoding, evaluation, retrieval, sync
from corpusspark.tables import file_states, shared_dir, table, written

#: Depth of the evaluation's retrieval, and how many answers are gold.
DEPTH, GOLD = 60, 10
SIZES = [8, 16, 24, 32]
#: The encoder's plain counts, which SQL can follow to the last digit.
ENCODER = {"backend": "hashing", "unit": False}
_kept: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, name: str, tables: list[DataFrame], made: Callable[[], DataFrame]) -> DataFrame:
    """A written table that is made once in a session for the files that the tables have."""
    files = sorted({p for t in tables for p in t.inputFiles()})
    key = (name, spark.sparkContext.applicationId, shared_dir(spark), *file_states(spark, files))
    if key not in _kept:
        _kept[key] = written(made(), name, keep=True)
    return _kept[key]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The store that is searched: one row a chunk with its vectors, encoded once."""
    staged = table(spark, d, "staged_chunks")
    return _once(spark, "chunks", [staged], lambda: encoding.encoded(sync.latest_staged(staged), **ENCODER))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """The resolved requests with their vectors."""
    requests, subjects = table(spark, d, "search_requests"), table(spark, d, "subjects")
    return _once(spark, "requests", [requests, subjects], lambda: retrieval.with_vectors(retrieval.resolved(requests.where("request_id % 50 = 0"), subjects), **ENCODER))


def _channels(spark: SparkSession, d: str, n: int = retrieval.PREFETCH) -> tuple[DataFrame, DataFrame]:
    r, c = _requests(spark, d), _chunks(spark, d)
    return retrieval.dense_topn(r, c, n), retrieval.sparse_topn(r, c, n)


def resolved_requests(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.resolved(table(spark, d, "search_requests"), table(spark, d, "subjects"))
    return found.select("query_id", "subject", F.col("pool_no").cast("bigint").alias("pool_no"), "n_pools", F.col("k").cast("bigint").alias("k"))


def unresolved_requests(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.unresolved(table(spark, d, "search_requests"), table(spark, d, "subjects"))


def _ranks(df: DataFrame) -> DataFrame:
    return df.select("query_id", "subject", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def dense_topn(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(_channels(spark, d)[0])


def sparse_topn(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(_channels(spark, d)[1])


def rrf_fused(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rrf(list(_channels(spark, d)), retrieval.TOP_N).withColumn("pool_rank", F.col("pool_rank").cast("bigint"))


def dbsf_fused(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dbsf(list(_channels(spark, d)), retrieval.TOP_N).withColumn("pool_rank", F.col("pool_rank").cast("bigint"))


def interleaved(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.retrieved(_requests(spark, d), _chunks(spark, d))
    return found.select("query_id", "chunk_id", "subject", "rrf", F.col("pos").cast("bigint").alias("pos"))


def _search(spark: SparkSession, d: str, rerank: bool) -> DataFrame:
    return retrieval.search(_requests(spark, d), _chunks(spark, d), "overlap" if rerank else None).withColumn("place", F.col("place").cast("bigint"))


def search_results(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of each request with all that is needed to cite them."""
    return _search(spark, d, True)


def fusion_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The same without reranker: the order is the fusion's."""
    return _search(spark, d, False).select("query_id", "place", "score", "chunk_id")


def _deep(spark: SparkSession, d: str, channels: list[DataFrame] | None = None) -> DataFrame:
    """One deep retrieval with the reranker's scores; other depths are its prefixes."""
    r, c = _requests(spark, d), _chunks(spark, d)
    found = retrieval.retrieved(r, c, one=DEPTH, many=DEPTH, channels=channels).join(c.select("subject", "chunk_id", "text"), ["subject", "chunk_id"])
    return found.select("query_id", "chunk_id", "pos", retrieval.overlap_score(F.col("query"), F.col("text")).alias("score"))


def recall_topn(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.recall_by_depth(written(_deep(spark, d), "deep"), SIZES, retrieval.DEFAULT_K)


def deepest_rank(spark: SparkSession, d: str) -> DataFrame:
    """How deep the retrieval must go for each request's answer."""
    best = retrieval.reranked(_deep(spark, d).select("query_id", "chunk_id", "pos", F.col("score").alias("rrf"), F.lit(retrieval.DEFAULT_K).alias("k")), None)
    return best.groupBy("query_id").agg(F.max("pos").cast("bigint").alias("deepest"))


def _gold(deep: DataFrame) -> DataFrame:
    best = retrieval.reranked(deep.where("score > 0").select("query_id", "chunk_id", "pos", F.col("score").alias("rrf"), F.lit(GOLD).alias("k")), None)
    return best.select("query_id", "chunk_id")


def _lists(dense: DataFrame, sparse: DataFrame) -> dict[str, DataFrame]:
    """Each channel's and each fusion's list of a request over all its pools, by score."""
    one = {"dense": dense.withColumnRenamed("score", "s"), "sparse": sparse.withColumnRenamed("score", "s"), "rrf": retrieval.rrf([dense, sparse]).withColumnRenamed("rrf", "s"), "dbsf": retrieval.dbsf([dense, sparse]).withColumnRenamed("dbsf", "s")}
    w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "chunk_id")
    return {k: v.select("query_id", "chunk_id", "s").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= DEPTH) for k, v in one.items()}


def channel_diag(spark: SparkSession, d: str) -> DataFrame:
    channels = [written(x, "channel") for x in _channels(spark, d, DEPTH)]
    gold, ranks = written(_gold(_deep(spark, d, channels)), "gold"), None
    for name, ranked in _lists(*channels).items():
        one = evaluation.gold_ranks(gold, ranked, DEPTH).withColumn("channel", F.lit(name))
        ranks = one if ranks is None else ranks.unionByName(one)
    return evaluation.channel_diagnosis(ranks, DEPTH).withColumn("shown", rank_display(F.col("worst_hit"), DEPTH))


def union_coverage(spark: SparkSession, d: str) -> DataFrame:
    channels = [written(x, "channel") for x in _channels(spark, d, DEPTH)]
    gold, lists = written(_gold(_deep(spark, d, channels)), "gold"), _lists(*channels)
    pools, names = None, []
    for name, parts in [(f"rrf {n}", [("rrf", n)]) for n in (16, 30, 60)] + [(f"union {n}", [("dense", n), ("sparse", n)]) for n in (8, 16, 30)]:
        one = retrieval.union_pool([lists[c].where(F.col("rank") <= n).withColumn("subject", F.lit("")) for c, n in parts]).select(F.lit(name).alias("strategy"), "query_id", "chunk_id")
        pools, names = one if pools is None else pools.unionByName(one), [*names, name]
    return evaluation.coverage(pools, gold, names)


def _probes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return v.where("vec_id % 50 = 0"), v


def vector_topn(spark: SparkSession, d: str) -> DataFrame:
    p, v = _probes(spark, d)
    return retrieval.vector_topn(p, v, 10).select("probe_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _codes(v: DataFrame) -> DataFrame:
    return v.select("vec_id", F.transform(quantized(F.col("embedding")), lambda x: x.cast("float")).alias("embedding"))


def overlap_at_k(spark: SparkSession, d: str) -> DataFrame:
    """How far eight-bit codes find the same neighbours as the vectors."""
    p, v = _probes(spark, d)
    return evaluation.overlap_at(retrieval.vector_topn(p, v, 10), retrieval.vector_topn(_codes(p), _codes(v), 10), "probe_id", "vec_id", 10)


def vector_parity(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("embedding").alias("a"), F.transform(quantized(F.col("embedding")), lambda x: x.cast("float")).alias("b"))
    return evaluation.vector_parity(v)


def self_match(spark: SparkSession, d: str) -> DataFrame:
    """Probes, as codes, that find their own vector first."""
    p, v = _probes(spark, d)
    shifted = _codes(p).select((-F.col("vec_id") - 1).alias("vec_id"), "embedding")  # another id, so that the vector itself is not left out
    found = retrieval.vector_topn(shifted, v, 1).select((-F.col("probe_id") - 1).alias("probe_id"), "vec_id", "rank")
    return evaluation.self_matches(found, "probe_id", "vec_id")


_FUNCTIONS = (
    resolved_requests, unresolved_requests, dense_topn, sparse_topn, rrf_fused, dbsf_fused, interleaved, search_results, fusion_fallback, recall_topn, deepest_rank, channel_diag, union_coverage, vector_topn,
    overlap_at_k, vector_parity, self_match,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_BLANK = r"not regexp_matches(query, '[^\s\p{Z}\x1c-\x1f\x85]')"
_ONE = """
asked as (select request_id, subject, query, k from (select *, row_number() over (partition by request_id order by received_at desc nulls last, subject desc nulls last, query desc nulls last, k desc nulls last) as rn from search_requests) where rn = 1),
names as (select name, row_number() over (order by name) - 1 as pool_no from (select distinct name from subjects where name is not null))"""
_RESOLVED = f"""{_ONE},
pools as (
  select a.request_id as query_id, n.name as subject, n.pool_no, a.query, coalesce(nullif(a.k, 0), 6) as k
  from asked a join names n on lower(trim(a.subject)) = 'all' or lower(trim(a.subject)) = lower(trim(n.name))
  where a.query is not null and not ({_BLANK}) and coalesce(nullif(a.k, 0), 6) > 0),
resolved as (select *, count(*) over (partition by query_id) as n_pools from pools),
req as (select * from resolved where query_id % 50 = 0),
staged as (
  select * exclude (rn) from (select *, row_number() over (partition by chunk_id order by staged_at desc nulls last, text desc nulls last, section_path desc nulls last) as rn from staged_chunks) where rn = 1)"""
_CHANNELS = f"""{_RESOLVED},
qt as (select query_id, subject, unnest({_TOKENS.format("query")}) as token from req),
ct as (select subject, chunk_id, unnest({_TOKENS.format("text")}) as token from staged where text is not null),
qn as (select query_id, subject, token, count(*)::double as w from qt group by all),
cn as (select subject, chunk_id, token, count(*)::double as w from ct group by all),
qb as (select query_id, subject, ('0x' || substr(md5(token), 1, 8))::ubigint % 256 as b, sum(w) as w from qn group by all),
cb as (select subject, chunk_id, ('0x' || substr(md5(token), 1, 8))::ubigint % 256 as b, sum(w) as w from cn group by all),
qt1 as (select query_id, subject, ('0x' || substr(md5(token), 1, 8))::ubigint % 1048576 as b, max(w) as w from qn group by all),
ct1 as (select subject, chunk_id, ('0x' || substr(md5(token), 1, 8))::ubigint % 1048576 as b, max(w) as w from cn group by all),
qs as (select query_id, subject, sqrt(sum(w * w)) as s from qb group by all),
cs as (select chunk_id, sqrt(sum(w * w)) as s from cb group by all),
dots as (select q.query_id, q.subject, c.chunk_id, sum(q.w * c.w) as dot from qb q join cb c on q.subject = c.subject and q.b = c.b group by all),
dense as (
  select * from (
    select r.query_id, r.subject, c.chunk_id, round(coalesce(d.dot / (qs.s * cs.s), 0.0), 9) as score,
      row_number() over (partition by r.query_id, r.subject order by round(coalesce(d.dot / (qs.s * cs.s), 0.0), 9) desc, c.chunk_id) as rank
    from req r join staged c on r.subject = c.subject left join dots d on d.query_id = r.query_id and d.subject = r.subject and d.chunk_id = c.chunk_id
    left join qs on qs.query_id = r.query_id and qs.subject = r.subject left join cs on cs.chunk_id = c.chunk_id)
  where rank <= PREFETCH),
sparse as (
  select * from (
    select query_id, subject, chunk_id, score, row_number() over (partition by query_id, subject order by score desc, chunk_id) as rank
    from (select q.query_id, q.subject, c.chunk_id, sum(q.w * c.w) as score from qt1 q join ct1 c on q.subject = c.subject and q.b = c.b group by all))
  where rank <= PREFETCH)""".replace("PREFETCH", "{prefetch}")
_FUSED = """
both_channels as (select query_id, subject, chunk_id, rank from dense union all select query_id, subject, chunk_id, rank from sparse),
fused as (
  select *, row_number() over (partition by query_id, subject order by rrf desc, chunk_id) as pool_rank
  from (select query_id, subject, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as rrf from both_channels group by all))"""
_DBSF = """
scored as (select query_id, subject, chunk_id, score, avg(score) over w as m, stddev_pop(score) over w as s from dense window w as (partition by query_id, subject)
  union all select query_id, subject, chunk_id, score, avg(score) over w as m, stddev_pop(score) over w as s from sparse window w as (partition by query_id, subject)),
summed as (select query_id, subject, chunk_id, round(sum(case when s > 1e-12 then least(1.0, greatest(0.0, (score - (m - 3 * s)) / (6 * s))) else 0.5 end), 6) as dbsf from scored group by all),
dbsf as (select *, row_number() over (partition by query_id, subject order by dbsf desc, chunk_id) as pool_rank from summed)"""


def _mixed(one: int, many: int, prefetch: int = 50) -> str:
    return f"""{_CHANNELS.replace("{prefetch}", str(prefetch))}, {_FUSED},
mixed as (
  select * from (
    select f.*, r.pool_no, r.n_pools, r.query, r.k, row_number() over (partition by f.query_id order by f.pool_rank, r.pool_no) as pos
    from fused f join req r on f.query_id = r.query_id and f.subject = r.subject
    where f.pool_rank <= case when r.n_pools > 1 then {many} else {one} end)
  where pos <= case when n_pools > 1 then {many} else {one} end),
judged as (
  select m.*, s.source_path, s.section_path, s.last_updated, s.doc_id, s.text,
    round(len(list_intersect(list_distinct({_TOKENS.format("query")}), coalesce({_TOKENS.format("text")}, []))) / greatest(len(list_distinct({_TOKENS.format("query")})), 1) - 0.5, 9) as overlap
  from mixed m join staged s on m.subject = s.subject and m.chunk_id = s.chunk_id)"""


_DEEP = f"""{_mixed(60, 60)}, deep as (select query_id, chunk_id, pos, overlap as score from judged)"""
_GOLD = f"""{_DEEP}, gold as (select query_id, chunk_id from (select *, row_number() over (partition by query_id order by score desc, pos) as r from deep where score > 0) where r <= 10)"""
_WIDE = f"""{_CHANNELS.replace("{prefetch}", str(60))}, {_FUSED}, {_DBSF},
lists as (
  select * from (
    select channel, query_id, chunk_id, row_number() over (partition by channel, query_id order by s desc, chunk_id) as rank from (
      select 'dense' as channel, query_id, chunk_id, score as s from dense union all select 'sparse', query_id, chunk_id, score from sparse
      union all select 'rrf', query_id, chunk_id, rrf from fused union all select 'dbsf', query_id, chunk_id, dbsf from dbsf))
  where rank <= 60)"""
_CODES = """e as (select vec_id, embedding::double[] as v, list_max([abs(x::double) for x in embedding]) as top from embeddings where embedding is not null),
q as (select vec_id, v, [round(x * 127 / case when top = 0 then 1 else top end) for x in v] as c from e),
n as (select *, sqrt(list_inner_product(v, v)) as nv, sqrt(list_inner_product(c, c)) as nc from q),
near as (
  select kind, probe_id, vec_id, row_number() over (partition by kind, probe_id order by score desc, vec_id) as rank from (
    select 'v' as kind, p.vec_id as probe_id, n.vec_id, round(list_inner_product(p.v, n.v) / (p.nv * n.nv), 9) as score from n p join n on p.vec_id <> n.vec_id where p.vec_id % 50 = 0
    union all select 'c', p.vec_id, n.vec_id, round(list_inner_product(p.c, n.c) / (p.nc * n.nc), 9) from n p join n on p.vec_id <> n.vec_id where p.vec_id % 50 = 0
    union all select 's', p.vec_id, n.vec_id, round(list_inner_product(p.c, n.v) / (p.nc * n.nv), 9) from n p cross join n where p.vec_id % 50 = 0))"""
_UNIT = "sqrt(list_inner_product(embedding::double[], embedding::double[]))"

ORACLE = {
    "resolved_requests": f"with {_RESOLVED} select query_id, subject, pool_no, n_pools, cast(k as bigint) as k from resolved",
    "unresolved_requests": f"""with {_ONE}, r as (
  select request_id, case when query is null or {_BLANK} then 'blank query' when k < 0 then 'bad k' when not exists (select 1 from names where lower(trim(name)) = lower(trim(subject))) and coalesce(lower(trim(subject)), '') <> 'all' then 'unknown subject' end as reason from asked)
select * from r where reason is not null""",
    "dense_topn": f"with {_CHANNELS.replace("{prefetch}", str(50))} select query_id, subject, chunk_id, score, rank from dense",
    "sparse_topn": f"with {_CHANNELS.replace("{prefetch}", str(50))} select query_id, subject, chunk_id, round(score, 9) as score, rank from sparse",
    "rrf_fused": f"with {_CHANNELS.replace("{prefetch}", str(50))}, {_FUSED} select * from fused where pool_rank <= 30",
    "dbsf_fused": f"with {_CHANNELS.replace("{prefetch}", str(50))}, {_DBSF} select * from dbsf where pool_rank <= 30",
    "interleaved": f"with {_mixed(30, 60)} select query_id, chunk_id, subject, rrf, pos from mixed",
    "search_results": f"""with {_mixed(30, 60)}, best as (select *, row_number() over (partition by query_id order by overlap desc, pos) as place from judged)
select query_id, place, overlap as score, subject, source_path, section_path as section, last_updated, doc_id, chunk_id, substr(text, 1, 320) as snippet, text from best where place <= k""",
    "fusion_fallback": f"""with {_mixed(30, 60)}, best as (select *, row_number() over (partition by query_id order by rrf desc, pos) as place from judged)
select query_id, place, rrf as score, chunk_id from best where place <= k""",
    "recall_topn": f"""with {_DEEP}, sizes as (select unnest([8, 16, 24, 32]) as top_n),
best as (select * from (select s.top_n, d.*, row_number() over (partition by s.top_n, d.query_id order by d.score desc, d.pos) as r from deep d join sizes s on d.pos <= s.top_n) where r <= 6),
ids as (select top_n, query_id, list(chunk_id order by r) as ids, coalesce(list(chunk_id order by r) filter (score > 0), []) as positive from best group by all),
both_ids as (select i.top_n, i.ids, b.ids as base, b.positive from ids i join ids b on b.top_n = 32 and b.query_id = i.query_id),
m as (select top_n, ids[1:3] = base[1:3] as same, len(list_intersect(ids, base)) as common, len(list_distinct(list_concat(ids, base))) as every, len(base) as n, len(positive) - len(list_intersect(positive, ids)) as lost from both_ids)
select top_n::bigint as top_n, count(*) as queries, count(*) filter (same) as same_top, round(min(common / every), 6) as min_jaccard, round(avg(common / every), 6) as mean_jaccard, count(*) filter (common = n) as lossless,
  sum(lost)::bigint as lost_positives, count(*) filter (lost > 0) as queries_with_loss from m group by top_n""",
    "deepest_rank": f"with {_DEEP} select query_id, max(pos) as deepest from (select *, row_number() over (partition by query_id order by score desc, pos) as r from deep) where r <= 6 group by query_id",
    "vector_topn": f"""with e as (select vec_id, embedding::double[] as v, {_UNIT} as n from embeddings where embedding is not null),
s as (select p.vec_id as probe_id, e.vec_id, round(list_inner_product(p.v, e.v) / (p.n * e.n), 9) as score from e p join e on p.vec_id <> e.vec_id where p.vec_id % 50 = 0)
select * from (select *, row_number() over (partition by probe_id order by score desc, vec_id) as rank from s) where rank <= 10""",
    "overlap_at_k": f"""with {_CODES}, o as (select v.probe_id, count(c.vec_id) / 10 as o from near v left join near c on c.kind = 'c' and c.rank <= 10 and c.probe_id = v.probe_id and c.vec_id = v.vec_id where v.kind = 'v' and v.rank <= 10 group by v.probe_id)
select count(*) as probes, round(avg(o), 6) as mean_overlap, case when round(avg(o), 6) >= 0.7 then 'PASS' else 'WARN' end as verdict from o""",
    "vector_parity": f"""with {_CODES}, c as (select round(list_inner_product(v, c) / (nv * nc), 9) as c from n)
select count(*) as n, round(min(c), 6) as min_cosine, round(avg(c), 6) as mean_cosine, round(quantile_cont(c, 0.05), 6) as p5_cosine from c""",
    "self_match": f"with {_CODES} select count(*) as probes, count(*) filter (probe_id = vec_id) as hits from near where kind = 's' and rank = 1",
    "channel_diag": f"""with gold as (select * from (with {_GOLD} select * from gold)), lists as (select * from (with {_WIDE} select * from lists)),
r as (select c.channel, g.query_id, g.chunk_id, coalesce(l.rank, 61) as rank from gold g cross join (select unnest(['dense', 'sparse', 'rrf', 'dbsf']) as channel) c left join lists l on l.channel = c.channel and l.query_id = g.query_id and l.chunk_id = g.chunk_id),
i as (select *, row_number() over (partition by channel order by rank) - 1 as i, count(*) over (partition by channel) as n from r),
d as (select channel, count(*) as gold, max(rank) filter (i = n // 2) as upper_median, coalesce(max(rank) filter (rank <= 60), 0) as worst_hit, count(*) filter (rank <= 10) as within_10, count(*) filter (rank > 60) as misses from i group by channel)
select *, worst_hit::varchar as shown from d""",
    "union_coverage": f"""with gold as (select * from (with {_GOLD} select * from gold)), lists as (select * from (with {_WIDE} select * from lists)),
grid(strategy, channel, n) as (values ('rrf 16', 'rrf', 16), ('rrf 30', 'rrf', 30), ('rrf 60', 'rrf', 60), ('union 8', 'dense', 8), ('union 8', 'sparse', 8), ('union 16', 'dense', 16), ('union 16', 'sparse', 16), ('union 30', 'dense', 30), ('union 30', 'sparse', 30)),
pools as (select distinct g.strategy, l.query_id, l.chunk_id from grid g join lists l on l.channel = g.channel and l.rank <= g.n),
h as (select s.strategy, g.query_id, count(*) - count(p.chunk_id) as missed from gold g cross join (select distinct strategy from grid) s left join pools p on p.strategy = s.strategy and p.query_id = g.query_id and p.chunk_id = g.chunk_id group by all),
z as (select strategy, max(n) as max_pool from (select strategy, query_id, count(*) as n from pools group by all) group by all)
select h.strategy, count(*) filter (missed = 0) as full_cover, sum(missed)::bigint as missed, any_value(max_pool) as max_pool, round(any_value(max_pool) * 0.27::double, 6) as seconds from h join z on h.strategy = z.strategy group by h.strategy""",
}
