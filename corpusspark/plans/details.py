"""Queries of functions and small operators, each over a whole table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.functions import scalars as S
from corpusspark.operators import converters, encoding, evaluation, reconcile, store, sync
from corpusspark.operators.order import placed
from corpusspark.plans.corpus import _last_two, _tags, sync_classify
from corpusspark.tables import new_path, table, written


def chunk_names(spark: SparkSession, d: str) -> DataFrame:
    """Readable ids of chunks and the sections they stand under."""
    rows = table(spark, d, "staged_chunks").select("doc_id", "chunk_index", "section_path").distinct()
    return rows.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "section_path", S.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("readable"), S.section_path(F.array("doc_id", F.coalesce("section_path", F.lit("")))).alias("trail"))


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    """Ids of documents from their paths below the subject's folder."""
    rows = table(spark, d, "docs").where("source_path is not null").select("subject", "source_path").distinct()
    return rows.select("subject", "source_path", S.relative(F.col("source_path"), F.concat(F.lit("/data/docs/"), "subject")).alias("relative"))


def stats_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line of text that reports a subject's run."""
    stats = sync.stats(sync_classify(spark, d)).withColumn("chunks", F.lit(0).cast("bigint"))
    return stats.select(S.stats_line(*[F.col(c) for c in ("subject", "new", "changed", "deleted", "unchanged", "chunks")]).alias("line"))


def run_noop(spark: SparkSession, d: str) -> DataFrame:
    """Whether a whole run has nothing to do."""
    found = sync.all_noop(sync.stats(sync_classify(spark, d)))
    return found.select(F.col("all_noop").cast("string").alias("all_noop"))


def set_parity(spark: SparkSession, d: str) -> DataFrame:
    """How far the words of a text's first half are those of the whole."""
    t = table(spark, d, "documents").select(S.tokens(F.col("text")).alias("b"))
    return evaluation.set_parity(t.select(F.array_distinct(F.slice("b", 1, F.ceil(F.size("b") / 2).cast("int"))).alias("a"), F.array_distinct("b").alias("b")))


def vector_codes(spark: SparkSession, d: str) -> DataFrame:
    """Eight-bit codes of vectors, their length, and the weight that a linear head gives."""
    v = table(spark, d, "embeddings").where("embedding is not null")
    codes = F.array_join(F.transform(S.quantized(F.col("embedding")), lambda x: x.cast("string")), ",")
    head = F.transform("embedding", lambda x, i: F.when(i % 2 == 0, 1.0).otherwise(-1.0))
    return v.select("vec_id", codes.alias("codes"), F.round(S.norm(F.col("embedding")), 6).alias("norm"), F.round(S.norm(S.unit(F.col("embedding"))), 6).alias("unit_norm"), F.round(S.sparse_weight(F.col("embedding"), head, -0.25), 6).alias("weight"))


def tag_usage(spark: SparkSession, d: str) -> DataFrame:
    tags, mapping = _tags(spark, d)
    return reconcile.tag_counts(tags, mapping)


def tag_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Objects of one tag, which is looked up by its name."""
    tags, mapping = _tags(spark, d)
    return mapping.where(F.col("systemtagid") == reconcile.tag_id(tags, "3-MEDIUM")).select("objectid").distinct()


def orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many paths of all snapshots the last one's documents keep."""
    docs = table(spark, d, "docs")
    last, _ = _last_two(docs)
    path = F.concat_ws("/", "subject", "doc_id").alias("path")
    return reconcile.orphan_counts(docs.select(path), last.select(path))


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of one subject, from a store to which snapshots were committed one after the other."""
    docs = table(spark, d, "docs")
    disk, before = _last_two(docs)
    s = store.Store(spark, new_path(spark, "store"))
    rows = lambda df: df.select(*sync.KEY, F.lit(None).cast("string").alias("source_path"), "content_hash", F.lit(None).cast("string").alias("last_updated"), F.lit(0).cast("bigint").alias("chunk_count"), F.lit(None).cast("string").alias("error"))
    none = spark.createDataFrame([], store.POINT).drop("version")
    s.commit(none, rows(before), before.limit(0))
    found = written(sync.classified(disk, before), "found")
    changed = disk.join(found.where("status in ('new', 'changed')").select(*sync.KEY), sync.KEY, "left_semi")
    s.commit(none, rows(changed), found.where("status = 'deleted'"))
    return s.manifest().select("subject", "doc_id", "content_hash", "version")


def stored_points(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a store after half of the documents were replaced by their even chunks: no old chunk is left."""
    chunks = sync.latest_staged(table(spark, d, "staged_chunks")).where("subject is not null and doc_id is not null")
    kept = ["subject", "doc_id", "chunk_id", "content_hash", "last_updated", "source_path", "section_path"]
    points = chunks.select(*kept, F.col("chunk_index").cast("bigint").alias("chunk_index"), F.lit(None).cast("string").alias("text"), S.point_id(F.col("chunk_id")).alias("point_id"), F.lit(None).cast("array<float>").alias("dense"), F.lit(None).cast("map<bigint,double>").alias("sparse"))
    docs = lambda df: df.groupBy("subject", "doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), *[F.max(c).alias(c) for c in ("source_path", "content_hash", "last_updated")]).withColumn("error", F.lit(None).cast("string"))
    s = store.Store(spark, new_path(spark, "store"))
    s.commit(points, docs(points), points.limit(0))
    half = points.where("length(doc_id) % 2 = 0")
    s.commit(half.where("chunk_index % 2 = 0"), docs(half), points.limit(0))
    return s.points().select("subject", "doc_id", "chunk_id", "point_id", "version")


def doxygen_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths whose names would be those of a code browser's pages with content."""
    p = F.concat(F.when(F.col("doc_id") % 3 == 0, "class_").when(F.col("doc_id") % 3 == 1, "functions_").otherwise("group__"), F.regexp_replace(F.coalesce("doc_path", F.lit("x")), r"[/.]", "_"), F.when(F.col("doc_id") % 5 == 0, "-members.html").otherwise(".html"))
    found = table(spark, d, "documents").select(p.alias("path"))
    return found.where(converters.is_doxygen_page(F.col("path"))).select("path").distinct()


def local_names(spark: SparkSession, d: str) -> DataFrame:
    """Local parts of names with a prefix, and how occurrence is shown."""
    e = table(spark, d, "events").select("event_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("q"), (F.col("event_id") % 3).cast("string").alias("low"), F.when(F.col("event_id") % 2 == 0, "unbounded").otherwise("1").alias("high"))
    return e.select("event_id", S.local_name(F.col("q")).alias("local"), S.occurs(F.col("low"), F.col("high")).alias("occurs"))


def run_progress(spark: SparkSession, d: str) -> DataFrame:
    """Time taken, rate, and time left of runs, as if a snapshot's number were the rows done of twenty."""
    r = table(spark, d, "sync_runs").where("finished_at is not null and started_at is not null").select("run_id", "subject", F.col("snap_no").cast("bigint").alias("done"), F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at")).cast("double").alias("seconds")).distinct()
    rate, eta = S.rate_and_eta(F.col("done"), F.lit(20), F.col("seconds"))
    return r.select("run_id", "subject", "done", S.elapsed(F.col("seconds")).alias("elapsed"), rate.alias("rate"), eta.alias("eta"))


def ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Places of chunks within their subject, and the last place."""
    staged = sync.latest_staged(table(spark, d, "staged_chunks"))
    return placed(staged, ["subject"], ["doc_id", "chunk_index", "chunk_id"]).select("subject", "chunk_id", F.col("place").cast("bigint").alias("place"), F.col("_n").cast("bigint").alias("of"))


def token_weights(spark: SparkSession, d: str) -> DataFrame:
    """How often each text has each word."""
    return encoding.postings(table(spark, d, "documents"), ["doc_id"])


def united_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Every subject's own patterns together with those of all."""
    both = F.array_union(F.array(F.lit("*.md"), F.lit("*.html")), F.coalesce("include", F.array().cast("array<string>")))
    return table(spark, d, "subjects").select("name", F.array_join(F.array_sort(F.filter(both, lambda x: x.isNotNull())), " ").alias("patterns"))


def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    """Seconds that eight attempts wait, doubling up to a minute."""
    waits: list[float] = []

    def fails() -> None:
        raise OSError

    try:
        store.retried(fails, sleep=waits.append)
    except OSError:
        pass
    return spark.createDataFrame([(i, w) for i, w in enumerate(waits)], "attempt bigint, seconds double")


_FUNCTIONS = (
    chunk_names, relative_paths, stats_lines, run_noop, set_parity, vector_codes, tag_usage, tag_lookup, orphan_counts, manifest_rows, stored_points, doxygen_paths, local_names, run_progress, ordinals,
    token_weights, united_patterns, retry_waits,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _oracles() -> dict[str, str]:
    from corpusspark.plans.corpus import _STAGED, _TOKENS, _TWO

    return {
        "chunk_names": "select distinct doc_id, cast(chunk_index as bigint) as chunk_index, section_path, doc_id || ':' || chunk_index as readable, doc_id || ' > ' || coalesce(section_path, '') as trail from staged_chunks",
        "relative_paths": "select distinct subject, source_path, case when starts_with(source_path, '/data/docs/' || subject || '/') then substr(source_path, length('/data/docs/' || subject) + 2) else source_path end as relative from docs where source_path is not null",
        "stats_lines": f"""with {_TWO} select format('[{{}}] new={{}} changed={{}} deleted={{}} unchanged={{}} chunks_embedded=0', coalesce(subject, 'null'), count(*) filter (status = 'new'), count(*) filter (status = 'changed'), count(*) filter (status = 'deleted'), count(*) filter (status = 'unchanged')) as line
from found group by subject""",
        "run_noop": f"with {_TWO} select case when count(*) filter (status <> 'unchanged') = 0 then 'true' else 'false' end as all_noop from found",
        "set_parity": f"""with t as (select coalesce({_TOKENS}, []) as b from documents),
s as (select list_distinct(b[1:cast(ceil(len(b) / 2) as int)]) as a, list_distinct(b) as b from t)
select count(*) as n, round(avg(case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end), 6) as mean_jaccard from s""",
        "vector_codes": """with e as (select vec_id, embedding::double[] as v, list_max([abs(x::double) for x in embedding]) as top from embeddings where embedding is not null)
select vec_id, array_to_string([round(x * 127 / case when top = 0 then 1 else top end)::tinyint for x in v], ',') as codes, round(sqrt(list_inner_product(v, v)), 6) as norm,
  case when top = 0 then 0.0 else 1.0 end::double as unit_norm, round(greatest(0.0, list_sum([case when i % 2 = 0 then 1.0 else -1.0 end * v[i + 1] for i in range(len(v))]) - 0.25), 6) as weight from e""",
        "tag_usage": "select o_orderpriority as name, count(distinct o_custkey) as objects from orders group by o_orderpriority",
        "tag_lookup": "select distinct cast(o_custkey as varchar) as objectid from orders where o_orderpriority = '3-MEDIUM'",
        "orphan_counts": f"""with {_TWO}, p as (select distinct subject || '/' || doc_id as path from docs), k as (select distinct subject || '/' || doc_id as path from disk)
select count(*) as paths, count(*) filter (exists (select 1 from k where k.path = p.path)) as kept, count(*) filter (not exists (select 1 from k where k.path = p.path)) as orphans from p""",
        "manifest_rows": f"with {_TWO} select subject, doc_id, new_hash as content_hash, cast(case when status = 'unchanged' then 1 else 2 end as bigint) as version from found where status <> 'deleted'",
        "stored_points": f"""with {_STAGED}, h as (select *, sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode(chunk_id)) as h from staged where subject is not null and doc_id is not null)
select subject, doc_id, chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id,
  cast(case when length(doc_id) % 2 = 0 then 2 else 1 end as bigint) as version from h where length(doc_id) % 2 = 1 or chunk_index % 2 = 0""",
        "doxygen_paths": "select distinct case when doc_id % 3 = 0 then 'class_' else 'group__' end || regexp_replace(coalesce(doc_path, 'x'), '[/.]', '_', 'g') || '.html' as path from documents where doc_id % 3 <> 1 and doc_id % 5 <> 0",
        "local_names": """select event_id, cast(user_id as varchar) as local, case when low = '1' and high = '1' then '' else ' [' || low || '..' || high || ']' end as occurs
from (select *, cast(event_id % 3 as varchar) as low, case when event_id % 2 = 0 then 'unbounded' else '1' end as high from events)""",
        "run_progress": """with r as (select distinct run_id, subject, cast(snap_no as bigint) as done, cast((epoch_us(finished_at) - epoch_us(started_at)) // 1000000 as double) as seconds from sync_runs where finished_at is not null and started_at is not null),
q as (select *, case when done > 0 and seconds > 0 then round(done / seconds, 6) end as rate from r)
select run_id, subject, done, format('{}m{:02d}s', cast(floor(seconds / 60) as bigint), cast(seconds as bigint) % 60) as elapsed, rate, round(greatest(20 - done, 0) / rate, 6) as eta from q""",
        "ordinals": f'with {_STAGED} select subject, chunk_id, row_number() over (partition by subject order by doc_id nulls first, chunk_index nulls first, chunk_id nulls first) - 1 as place, count(*) over (partition by subject) as "of" from staged',
        "token_weights": f"with t as (select doc_id, unnest({_TOKENS}) as token from documents where text is not null) select doc_id, token, count(*)::double as weight from t group by all",
        "united_patterns": "select name, array_to_string(list_sort(list_distinct(list_concat(['*.md', '*.html'], coalesce(include, [])))), ' ') as patterns from subjects",
        "retry_waits": "select cast(i as bigint) as attempt, least(60, 2 * 2 ** i)::double as seconds from range(7) t(i)",
    }


ORACLE = _oracles()
