"""Queries of the general maintenance problems: changes between snapshots, incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.operators.snapshots import snapshot_changes
from corpusspark.operators.versions import run_changes
from corpusspark.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "docs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_changes(table(spark, sf_dir, "docs"), table(spark, sf_dir, "sync_runs"))
    return found.where("change_kind <> 'removed'").select("run_id", "doc_id")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each kind, by snapshot and subject."""
    return p3_found(spark, sf_dir).groupBy("snap_no", "subject", "change_kind").agg(F.count(F.lit(1)).alias("n"))


_LATEST = r"""
latest as (
  select snap_no, subject, doc_id, hash, dense_rank() over (order by snap_no) - 1 as pos from (
    select snap_no, subject, doc_id, lower(regexp_replace(content_hash, '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g')) as hash,
           row_number() over (partition by snap_no, subject, doc_id order by loaded_at desc nulls last, content_hash desc nulls last) as rn
    from docs where snap_no is not null)
  where rn = 1)"""

_P3 = f"""
with {_LATEST}, snaps as (select distinct pos, snap_no from latest)
select cast(s.snap_no as bigint) as snap_no, d.subject, d.doc_id, d.change_kind from (
  select coalesce(c.pos, p.pos + 1) as pos, coalesce(c.subject, p.subject) as subject, coalesce(c.doc_id, p.doc_id) as doc_id,
    case when p.pos is null then 'added' when c.pos is null then 'removed' when c.hash is distinct from p.hash then 'changed' end as change_kind
  from latest c full join latest p on c.pos = p.pos + 1 and c.subject = p.subject and c.doc_id = p.doc_id) d
join snaps s on s.pos = d.pos
where d.change_kind is not null and d.pos > 0"""

ORACLE = {
    "p3_found": _P3,
    "p3_counts": f"select snap_no, subject, change_kind, count(*) as n from ({_P3}) group by all",
    "p5_found": f"""
with {_LATEST}, ok as (
  select run_id, subject, min_by(snap_no, started_at) as snap_no, min(started_at) as started_at
  from sync_runs where status = 'ok' and snap_no is not null group by run_id, subject),
spans as (
  select *, lag(snap_no) over (partition by subject order by started_at, run_id) as was,
         lag(run_id) over (partition by subject order by started_at, run_id) as before from ok)
select distinct s.run_id, c.doc_id
from spans s join latest c on c.snap_no = s.snap_no and c.subject = s.subject
left join latest p on p.snap_no = s.was and p.subject = s.subject and p.doc_id = c.doc_id
where s.before is not null and (p.doc_id is null or p.hash is distinct from c.hash)""",
}
QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p5_found": p5_found}
