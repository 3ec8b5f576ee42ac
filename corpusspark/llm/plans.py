"""Queries of the operators for training text, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm import leakage, near_duplicates, repeated_lines, splitting, stuffing, tokenizing
from corpusspark.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines.repeated_lines(table(spark, sf_dir, "staged_chunks"))
    return found.select("chunk_id", F.col("line_no").cast("bigint").alias("line_no"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "staged_chunks")
    return repeated_lines.without_repeated_lines(chunks).select("chunk_id", "text").distinct()


def p1_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frequent sequences and occurrences there are of each length."""
    found = repeated_lines.frequent_sequences(table(spark, sf_dir, "staged_chunks"))
    by_one = found.groupBy("length", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("n_docs").alias("n_docs"))
    return by_one.groupBy(F.col("length").cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("occurrences"), F.max("n_docs").alias("most_docs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "staged_chunks"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a near-duplicate in another document, with their class."""
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "staged_chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the stitched boundary tables cut in two or more pieces."""
    items, tables = splitting.oversized_tables(table(spark, sf_dir, "staged_chunks"))
    cut = splitting.stitched(tables).groupBy("item").agg(F.max(F.col("piece_0") + F.col("n")).alias("pieces"))
    return items.select("item", "chunk_id").join(cut.where("pieces > 1"), "item").select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf_dir, "staged_chunks"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encoded(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.verbatim_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.paraphrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages are extreme in what, by language, and how many of them are lists."""
    far = stuffing.measured_pages(table(spark, sf_dir, "documents"))
    n = lambda c: F.count_if(c).alias(c)
    every = far.groupBy("language").agg(F.count(F.lit(1)).alias("pages"), n("far_slope"), n("far_residual"), n("far_divergence"))
    return every.join(stuffing.lists(far).groupBy("language").agg(F.count(F.lit(1)).alias("lists")), "language", "left").fillna(0, ["lists"])


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p1_sequences, p2_found, p2_groups, p4_found, p4_pieces, p6_ids, p7_found, p7_paraphrases, p8_found, p8_curves)}

_LINES = r"""
lines as (
  select chunk_id, doc_id, subject, text, unnest(range(len(string_split(text, chr(10))))) as line_no from (select distinct chunk_id, doc_id, subject, text from staged_chunks where text is not null)),
bare as (
  select chunk_id, doc_id, subject, text, line_no, trim(regexp_replace(lower(string_split(text, chr(10))[line_no + 1]), '[^\p{L}]+', ' ', 'g')) as s from lines),
keyed as (
  select chunk_id, doc_id, subject, text, line_no, replace(s, ' ', '') as k from bare where length(s) - length(replace(s, ' ', '')) >= 2),
often as (
  select subject, k from keyed group by subject, k having count(distinct doc_id) >= 6)"""
ORACLE = {
    "p1_found": f"with {_LINES} select distinct chunk_id, line_no from keyed join often on keyed.k = often.k and keyed.subject is not distinct from often.subject",
    "p1_clean": f"""with {_LINES}, gone as (select distinct chunk_id, line_no from keyed join often on keyed.k = often.k and keyed.subject is not distinct from often.subject)
select chunk_id, string_agg(line, chr(10) order by line_no) as text from (
  select chunk_id, line_no, string_split(text, chr(10))[line_no + 1] as line from lines anti join gone using (chunk_id, line_no)) group by chunk_id
union all select distinct chunk_id, '' from lines l where not exists (select 1 from lines m anti join gone using (chunk_id, line_no) where m.chunk_id = l.chunk_id)
union all select distinct chunk_id, null from staged_chunks where text is null""",
    "p2_found": r"""
with t as (
  select chunk_id, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from (select distinct chunk_id, doc_id, text from staged_chunks where text is not null)),
s as (
  select chunk_id, doc_id, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as s from t where len(w) >= 20),
o as (select chunk_id, doc_id, len(s) as n, unnest(s) as x from s)
select a.chunk_id as chunk_id_a, b.chunk_id as chunk_id_b
from o a join o b on a.x = b.x and a.chunk_id < b.chunk_id and a.doc_id <> b.doc_id
group by a.chunk_id, b.chunk_id, a.n, b.n
having count(*) >= 0.6 * (a.n + b.n - count(*))""",
    "p1_sequences": f"""with {_LINES}, texts as (
  select chunk_id, doc_id, subject, text, list(k order by line_no) as ks from (select l.chunk_id, l.doc_id, l.subject, l.text, l.line_no, k.k from lines l join keyed k
    on k.chunk_id is not distinct from l.chunk_id and k.doc_id is not distinct from l.doc_id and k.subject is not distinct from l.subject and k.line_no = l.line_no and k.text = l.text) group by all),
places as (select chunk_id, doc_id, subject, ks, length, unnest(range(1, len(ks) - length + 2)) as p from (select *, unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) as length from texts) where length <= len(ks)),
slices as (select doc_id, subject, length, ks[p:p + length - 1] as q from places),
often_q as (select subject, length, q, count(*) as n, count(distinct doc_id) as n_docs from slices group by all having count(distinct doc_id) >= 6)
select cast(length as bigint) as length, count(*) as sequences, cast(sum(n) as bigint) as occurrences, max(n_docs) as most_docs from often_q group by length""",
    "p2_groups": r"""
with recursive t as (
  select chunk_id, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from (select distinct chunk_id, doc_id, text from staged_chunks where text is not null)),
s as (
  select chunk_id, doc_id, list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) as s from t where len(w) >= 20),
m as (select distinct chunk_id, doc_id, md5(array_to_string(s, '|')) as k, s from s),
sets as (select k, any_value(s) as s, min(doc_id) as low, max(doc_id) as high, count(*) as n from m group by k),
o as (select k, low, high, len(s) as n, unnest(s) as x from sets),
across as (
  select a.k as a, b.k as b from o a join o b on a.x = b.x and a.k < b.k group by a.k, b.k, a.n, b.n, a.low, a.high, b.low, b.high
  having count(*) >= 0.6 * (a.n + b.n - count(*)) and not (a.low = a.high and b.low = b.high and a.low = b.low)),
e as (select a, b from across union all select b, a from across),
reach as (select a as k, b as j from e union select r.k, e.b from reach r join e on r.j = e.a),
grouped as (select k, j from reach union select k, k from sets where low <> high or k in (select a from e)),
names as (select g.k, min(m.chunk_id) as class_id from grouped g join m on m.k = g.j group by g.k),
degree as (select a as k, count(*) as n_links from e group by a)
select m.chunk_id, m.doc_id, names.class_id, coalesce(degree.n_links, 0) as n_links, sets.n - 1 as n_copies from m join names on names.k = m.k join sets on sets.k = m.k left join degree on degree.k = m.k""",
    "p7_found": r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as w from eval_items where passage is not null),
dg as (select doc_id, unnest([array_to_string(w[k:k + 9], ' ') for k in range(1, len(w) - 8)]) as g from d),
ig as (select distinct item_id, unnest([array_to_string(w[k:k + 9], ' ') for k in range(1, len(w) - 8)]) as g from i)
select distinct doc_id, item_id from dg join ig using (g)""",
    "p4_found": "select distinct chunk_id from staged_chunks where length(text) > 2000",
}
