"""Queries of the sync, chunking, graph and reconciliation operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.functions import scalars as S
from corpusspark.operators import chunking, encoding, evaluation, graph, reconcile, snapshots, sync
from corpusspark.tables import table


def _last_two(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the last snapshot and of the one before it, one row a key."""
    numbers = snapshots.snapshot_numbers(docs)
    rows = snapshots.latest(docs).withColumnRenamed("hash", "content_hash")
    at = lambda i: rows.where(F.col("snap_no") == (numbers[i] if len(numbers) >= -i else -1)).drop("snap_no")
    return at(-1), at(-2)


def sync_classify(spark: SparkSession, d: str) -> DataFrame:
    return sync.classified(*_last_two(table(spark, d, "docs")))


def sync_stats(spark: SparkSession, d: str) -> DataFrame:
    return sync.stats(sync_classify(spark, d)).withColumn("is_noop", F.col("is_noop").cast("string"))


def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    """The manifest before the last snapshot, with what is new or changed put in and what is gone taken out."""
    disk, manifest = _last_two(table(spark, d, "docs"))
    found = sync.classified(disk, manifest)
    rows = disk.join(found.where("status in ('new', 'changed')").select(*sync.KEY), sync.KEY, "left_semi")
    return sync.upserted(sync.without(manifest, found.where("status = 'deleted'"), sync.KEY), rows, sync.KEY)


def doc_replace_points(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store after the documents the last snapshot changed got all their chunks anew, and the removed ones none."""
    chunks = sync.latest_staged(table(spark, d, "staged_chunks")).select("subject", "doc_id", "chunk_id", "chunk_index")
    found = sync_classify(spark, d)
    fresh = chunks.join(found.where("status = 'changed'").select(*sync.KEY), sync.KEY, "left_semi")
    return sync.replaced(chunks, fresh, found.where("status in ('changed', 'deleted')")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("sha"))


def point_uuids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "staged_chunks").select("chunk_id").distinct().select("chunk_id", S.point_id(F.col("chunk_id")).alias("point_id"))


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents that their subject's patterns let through."""
    docs = table(spark, d, "docs").select("subject", "doc_id").distinct()
    subjects = table(spark, d, "subjects").select(F.col("name").alias("subject"), "include", "exclude")
    return docs.join(subjects, "subject").where(S.included(F.col("doc_id"), F.col("include"), F.col("exclude"))).select("subject", "doc_id")


def suffix_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("subject", "doc_id").distinct().groupBy(S.suffix(F.col("doc_id")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("doc_id")
    return table(spark, d, "docs").select("doc_id").distinct().select("doc_id", S.basename(p).alias("base"), S.with_suffix(p, ".md").alias("md"), S.without_version(F.regexp_replace(S.basename(p), r"\.[^.]*$", "")).alias("bare"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", S.snippet(t).alias("snippet"), F.sha2(S.collapse(t), 256).alias("collapsed"), S.is_blank(t).cast("string").alias("blank"), S.iso_utc(F.col("fetched_at").cast("timestamp")).alias("fetched"))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_packs(table(spark, d, "documents"), "doc_id", "text").withColumn("n_tokens", F.col("n_tokens").cast("bigint"))


def chunked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents with their heading trails; checked against brute force in the tests."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("subject"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return chunking.chunked(docs)


def staged_batches(spark: SparkSession, d: str) -> DataFrame:
    return sync.batches(sync.latest_staged(table(spark, d, "staged_chunks")), 64).select("subject", "chunk_id", "batch_no")


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return sync.chunk_counts(sync.latest_staged(table(spark, d, "staged_chunks")))


def list_subjects(spark: SparkSession, d: str) -> DataFrame:
    found = sync.listed(table(spark, d, "subjects"), sync.latest_staged(table(spark, d, "staged_chunks")))
    return found.withColumn("populated", F.col("populated").cast("string"))


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of the catalogue, with those that documents name besides."""
    names = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("name"))
    return sync.inserted(table(spark, d, "subjects").select("name"), names, ["name"])


def sparse_maxpool(spark: SparkSession, d: str) -> DataFrame:
    return encoding.pooled_postings(table(spark, d, "documents"), ["doc_id"], 1 << 12)


def weight_parity(spark: SparkSession, d: str) -> DataFrame:
    """How well damped weights keep the plain ones' proportions."""
    plain = encoding.postings(table(spark, d, "documents"), ["doc_id"])
    return evaluation.weight_parity(plain, plain.withColumn("weight", F.sqrt("weight")), "doc_id")


def title_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of documents with one first line the first by path."""
    docs = table(spark, d, "documents").where(~S.is_blank(F.col("text"))).select("doc_id", F.struct("doc_path", "doc_id").alias("place"), F.split("text", "\n")[0].alias("title"))
    return graph.first_of(docs, "title", "place").select("title", "doc_id")


def _jars(spark: SparkSession, d: str) -> DataFrame:
    """Library tables in the documents: rows of a jar and the names it requires, one bundle a jar."""
    rows = table(spark, d, "documents").where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\| ([^|\n]+\.jar \| [^|\n]+) \|$"), F.lit(1))).alias("row"))
    one = rows.select(F.trim(F.split_part("row", F.lit("|"), F.lit(1))).alias("file"), S.required_bundles(F.split_part("row", F.lit("|"), F.lit(2))).alias("names"))
    return one.select("file", F.explode("names").alias("r")).groupBy("file").agg(F.array_sort(F.collect_set("r")).alias("req")).withColumn("sym", S.without_version(F.regexp_replace("file", r"\.jar$", "")))


def bundle_edges(spark: SparkSession, d: str) -> DataFrame:
    """What each library needs, resolved to a library or to nothing."""
    return graph.edges(_jars(spark, d))


def bundle_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(bundle_edges(spark, d).select("src", "dst"))


def _halves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


def closure_of_halves(spark: SparkSession, d: str) -> DataFrame:
    """Everything each part leads to in the graph where a number leads to its half."""
    return graph.closure(_halves(spark, d))


def closure_common(spark: SparkSession, d: str) -> DataFrame:
    e = _halves(spark, d)
    return graph.common(graph.closure(e), e)


def closure_extra(spark: SparkSession, d: str) -> DataFrame:
    e = _halves(spark, d)
    every = graph.closure(e)
    return graph.extra(every, graph.common(every, e)).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("top"))


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The document that last, by path, is the one of its kind and source."""
    docs = table(spark, d, "documents").where("doc_kind is not null and doc_path is not null").select(F.concat_ws("/", "doc_kind", "source").alias("key"), "doc_id", F.struct("doc_path", "doc_id").alias("place"))
    return graph.last_of(docs, "key", "doc_id", "place")


def _tags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order priorities as tags, and orders as what maps customers to them."""
    tag = F.substring("o_orderpriority", 1, 1).cast("int")
    orders = table(spark, d, "orders")
    return orders.select(tag.alias("id"), F.col("o_orderpriority").alias("name")).distinct(), orders.select(F.col("o_custkey").cast("string").alias("objectid"), F.lit("files").alias("objecttype"), tag.alias("systemtagid"))


def tag_select(spark: SparkSession, d: str) -> DataFrame:
    tags, mapping = _tags(spark, d)
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("fileid"), F.concat_ws("/", "c_mktsegment", "c_name").alias("path"), F.col("c_nationkey").alias("mimetype"))
    mimes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("mimetype"))
    return reconcile.tagged(tags, mapping, files, mimes, ["1-URGENT", "2-HIGH"])


def tag_flip(spark: SparkSession, d: str) -> DataFrame:
    _, mapping = _tags(spark, d)
    return reconcile.flipped(mapping.distinct(), 1, 2).withColumn("systemtagid", F.col("systemtagid").cast("bigint"))


def prune_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Paths of any snapshot that lie under no folder of the last one's documents, and are none of them."""
    docs = table(spark, d, "docs").where("source_path is not null")
    last, _ = _last_two(docs)
    folders = last.select(F.concat(F.lit("/data/docs/"), "subject", F.lit("/"), F.regexp_replace("doc_id", "/[^/]*$", "")).alias("path"))
    return reconcile.orphans(docs.select(F.col("source_path").alias("path")), folders)


def mirror_actions(spark: SparkSession, d: str) -> DataFrame:
    new, old = (x.select(F.concat_ws("/", "subject", "doc_id").alias("path"), "content_hash") for x in _last_two(table(spark, d, "docs")))
    return reconcile.mirror(new, old, delete=True)


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency(table(spark, d, "events"), "event_type", "value")


_FUNCTIONS = (
    sync_classify, sync_stats, manifest_merge, doc_replace_points, content_hashes, point_uuids, glob_filter, suffix_counts, path_functions, text_functions, chunk_pack, chunked_documents, staged_batches,
    chunk_counts, list_subjects, insert_if_absent, sparse_maxpool, weight_parity, title_dedup, bundle_edges, bundle_closure, closure_of_halves, closure_common, closure_extra, last_wins, tag_select, tag_flip,
    prune_orphans, mirror_actions, latency_percentiles,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_TWO = r"""
latest as (
  select snap_no, subject, doc_id, content_hash from (
    select snap_no, subject, doc_id, lower(regexp_replace(content_hash, '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g')) as content_hash,
           row_number() over (partition by snap_no, subject, doc_id order by loaded_at desc nulls last, content_hash desc nulls last) as rn
    from docs where snap_no is not null) where rn = 1),
ends as (select max(snap_no) as s1, (select max(snap_no) from docs where snap_no < (select max(snap_no) from docs)) as s0 from docs),
disk as (select subject, doc_id, content_hash from latest, ends where snap_no = s1),
manifest as (select subject, doc_id, content_hash from latest, ends where snap_no = s0),
found as (
  select coalesce(d.subject, m.subject) as subject, coalesce(d.doc_id, m.doc_id) as doc_id, m.content_hash as old_hash, d.content_hash as new_hash,
    case when m.doc_id is null then 'new' when d.doc_id is null then 'deleted' when d.content_hash is distinct from m.content_hash then 'changed' else 'unchanged' end as status
  from disk d full join manifest m on d.subject = m.subject and d.doc_id = m.doc_id)"""
_STAGED = """
staged as (
  select * exclude (rn) from (select *, row_number() over (partition by chunk_id order by staged_at desc nulls last, text desc nulls last, section_path desc nulls last) as rn from staged_chunks) where rn = 1)"""
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_JARS = r"""
jar_rows as (select unnest(regexp_extract_all(text, '(?m)^\| ([^|\n]+\.jar \| [^|\n]+) \|$', 1)) as row from documents where text is not null),
needs as (select distinct trim(split_part(row, '|', 1)) as src, trim(unnest(string_split(split_part(row, '|', 2), ','))) as symbol from jar_rows),
symbols as (select regexp_replace(regexp_replace(src, '\.jar$', ''), '[-_]\d[\d.]*$', '') as symbol, max(src) as dst from needs where symbol <> '' group by 1),
edges as (select n.src, n.symbol, s.dst from needs n left join symbols s on n.symbol = s.symbol where n.symbol <> '')"""
_CLOSURE = "closure as (select src, dst from graph union select c.src, g.dst from closure c join graph g on c.dst = g.src)"
_HALVES = f"with recursive graph as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey > 1), {_CLOSURE}"

ORACLE = {
    "sync_classify": f"with {_TWO} select * from found",
    "sync_stats": f"""with {_TWO} select subject, {', '.join(f"count(*) filter (status = '{s}') as {s}" for s in ("new", "changed", "deleted", "unchanged"))},
      case when count(*) filter (status <> 'unchanged') = 0 then 'true' else 'false' end as is_noop from found group by subject""",
    "manifest_merge": f"with {_TWO} select * from disk",
    "doc_replace_points": f"""with {_TWO}, {_STAGED}
select subject, doc_id, chunk_id, cast(chunk_index as bigint) as chunk_index from staged s
where not exists (select 1 from found f where f.subject = s.subject and f.doc_id = s.doc_id and f.status = 'deleted')
""",
    "content_hashes": "select doc_id, sha256(text) as sha from documents",
    "point_uuids": """with h as (select distinct chunk_id, sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode(chunk_id)) as h from staged_chunks)
select chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id from h""",
    "glob_filter": """select distinct d.subject, d.doc_id from docs d join subjects s on d.subject = s.name
where (coalesce(len(s.include), 0) = 0 or exists (select 1 from (select unnest(s.include) as p) where d.doc_id glob p)) and not exists (select 1 from (select unnest(s.exclude) as p) where d.doc_id glob p)""",
    "suffix_counts": r"select lower(regexp_extract(doc_id, '[^/.][^/]*?(\.[^./]+)$', 1)) as suffix, count(*) as n from (select distinct subject, doc_id from docs) group by 1",
    "path_functions": r"""select distinct doc_id, regexp_replace(doc_id, '^.*/', '') as base, regexp_replace(doc_id, '\.[^./]*$', '') || '.md' as md,
  regexp_replace(regexp_replace(regexp_replace(doc_id, '^.*/', ''), '\.[^.]*$', ''), '[-_]\d[\d.]*$', '') as bare from docs""",
    "text_functions": r"""select doc_id, substr(text, 1, 320) as snippet, sha256(trim(regexp_replace(text, '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g'))) as collapsed,
  case when text is null or not regexp_matches(text, '[^\s\p{Z}\x1c-\x1f\x85]') then 'true' else 'false' end as blank,
  strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || case when microsecond(fetched_at) % 1000000 = 0 then '' else '.' || lpad((microsecond(fetched_at) % 1000000)::varchar, 6, '0') end || '+00:00' as fetched from documents""",
    "chunk_pack": rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as line_no from documents where text is not null),
n as (select doc_id, line_no, len({_TOKENS}) as n from l),
p as (select doc_id, n, (sum(n) over (partition by doc_id order by line_no rows unbounded preceding) - n) // 400 as pack from n)
select doc_id, cast(pack as bigint) as pack, count(*) as n_lines, cast(sum(n) as bigint) as n_tokens from p group by doc_id, pack""",
    "staged_batches": f"with {_STAGED} select subject, chunk_id, (row_number() over (partition by subject order by doc_id nulls first, chunk_index nulls first, chunk_id nulls first) - 1) // 64 as batch_no from staged",
    "chunk_counts": f"with {_STAGED} select subject, doc_id, count(*) as chunk_count from staged group by subject, doc_id",
    "list_subjects": f"""with {_STAGED} select s.name, coalesce(s.description, '') as description, s.collection, count(c.chunk_id) as points, case when count(c.chunk_id) > 0 then 'true' else 'false' end as populated
from subjects s left join staged c on c.subject = s.name group by all""",
    "insert_if_absent": "select name from subjects union select source from documents where source is not null",
    "sparse_maxpool": f"""with t as (select doc_id, unnest({_TOKENS}) as token from documents where text is not null), c as (select doc_id, token, count(*) as n from t group by all)
select doc_id, cast(('0x' || substr(md5(token), 1, 8))::ubigint % 4096 as bigint) as token_id, cast(max(n) as double) as weight from c group by 1, 2""",
    "weight_parity": f"""with t as (select doc_id, unnest({_TOKENS}) as token from documents where text is not null), c as (select doc_id, token, count(*)::double as w from t group by all),
r as (select doc_id, corr(w, sqrt(w)) as r from c group by doc_id having count(*) >= 2 and stddev_pop(w) > 1e-12)
select count(*) as n, round(avg(r), 6) as mean_pearson from r""",
    "title_dedup": r"""select title, doc_id from (select string_split(text, chr(10))[1] as title, doc_id, row_number() over (partition by string_split(text, chr(10))[1] order by doc_path nulls first, doc_id) as rn
from documents where regexp_matches(text, '[^\s\p{Z}\x1c-\x1f\x85]')) where rn = 1""",
    "bundle_edges": f"with {_JARS} select * from edges",
    "bundle_closure": f"with recursive {_JARS}, graph as (select distinct src, dst from edges where dst is not null), {_CLOSURE} select * from closure",
    "closure_of_halves": f"{_HALVES} select * from closure",
    "closure_common": f"{_HALVES} select dst from closure group by dst having count(distinct src) = (select count(distinct src) from graph)",
    "closure_extra": f"""{_HALVES}, shared as (select dst from closure group by dst having count(distinct src) = (select count(distinct src) from graph))
select src, count(*) as n, max(dst) as top from closure where dst not in (select dst from shared) and src <> dst group by src""",
    "last_wins": "select key, doc_id from (select concat_ws('/', doc_kind, source) as key, doc_id, row_number() over (partition by concat_ws('/', doc_kind, source) order by doc_path desc, doc_id desc) as rn from documents where doc_kind is not null and doc_path is not null) where rn = 1",
    "tag_select": "select distinct c_mktsegment || '/' || c_name as path, n_name as mimetype from customer join nation on c_nationkey = n_nationkey where c_custkey in (select o_custkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH'))",
    "tag_flip": "select distinct cast(o_custkey as varchar) as objectid, 'files' as objecttype, cast(case when o_orderpriority like '1%' then 2 else substr(o_orderpriority, 1, 1)::int end as bigint) as systemtagid from orders",
    "prune_orphans": f"""with {_TWO.replace("from docs where snap_no is not null)", "from docs where snap_no is not null and source_path is not null)").replace("from docs)", "from docs where source_path is not null)")},
f as (select distinct '/data/docs/' || subject || '/' || regexp_replace(doc_id, '/[^/]*$', '') as up from disk)
select distinct source_path as path from docs where source_path is not null and not exists (select 1 from f where source_path = up or starts_with(source_path, up || '/'))""",
    "mirror_actions": f"with {_TWO} select subject || '/' || doc_id as path, case status when 'deleted' then 'delete' else 'copy' end as action from found where status <> 'unchanged'",
    "latency_percentiles": """with r as (select event_type, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, n, round(min(value), 6) as min, round((max(value) filter (i = (n + 1) // 2) + max(value) filter (i = n // 2 + 1)) / 2, 6) as median, round(avg(value), 6) as mean, round(max(value) filter (i = ceil(n * 0.95)), 6) as p95, round(max(value), 6) as max from r group by event_type, n""",
}
