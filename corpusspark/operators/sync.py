"""Synchronising a manifest with what is on disk: classification, merges, replacement, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusspark.operators.order import placed

KEY = ["subject", "doc_id"]


def _on(a: str, b: str, cols: list[str]):
    on = F.lit(True)
    for c in cols:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def classified(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """(subject, doc_id, old_hash, new_hash, status): one full outer join tells new, changed, deleted and unchanged.

    disk and manifest: subject, doc_id, content_hash, one row a key. Null hashes are equal to each
    other only; null keys match null keys; other columns are not read.
    """
    pick = lambda df: df.select(*KEY, "content_hash", F.lit(1).alias("there"))
    d, m = pick(disk).alias("d"), pick(manifest).alias("m")
    status = (
        F.when(F.col("m.there").isNull(), "new")
        .when(F.col("d.there").isNull(), "deleted")
        .when(~F.col("d.content_hash").eqNullSafe(F.col("m.content_hash")), "changed")
        .otherwise("unchanged")
    )
    key = [F.when(F.col("d.there").isNotNull(), F.col(f"d.{c}")).otherwise(F.col(f"m.{c}")).alias(c) for c in KEY]
    return d.join(m, _on("d", "m", KEY), "full_outer").select(*key, F.col("m.content_hash").alias("old_hash"), F.col("d.content_hash").alias("new_hash"), status.alias("status"))


def stats(found: DataFrame) -> DataFrame:
    """(subject, new, changed, deleted, unchanged, is_noop) of classified rows."""
    n = lambda s: F.count_if(F.col("status") == s)
    return found.groupBy("subject").agg(*[n(s).alias(s) for s in ("new", "changed", "deleted", "unchanged")], (F.count_if(F.col("status") != "unchanged") == 0).alias("is_noop"))


def all_noop(found: DataFrame) -> DataFrame:
    """(all_noop) of stats() rows: one row, whether no subject has anything to do; true for none."""
    return found.agg(F.coalesce(F.bool_and("is_noop"), F.lit(True)).alias("all_noop"))


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows put in: a row whose key is in the table replaces it. rows has one row a key."""
    kept = table.alias("t").join(rows.alias("r"), _on("t", "r", key), "left_anti")
    return kept.unionByName(rows.select(*table.columns))


def without(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """table without the rows whose key is in keys."""
    return table.alias("t").join(keys.alias("k"), _on("t", "k", key), "left_anti")


def inserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with those rows put in whose key it has not; of several new rows with one key one stays."""
    return table.unionByName(without(rows, table, key).dropDuplicates(key).select(*table.columns))


def replaced(chunks: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks where every document of fresh has just its fresh chunks, and documents of gone have none.

    A document that shrank leaves no old chunk behind. gone: subject, doc_id.
    """
    touched = fresh.select(*KEY).union(gone.select(*KEY)).distinct()
    return without(chunks, touched, KEY).unionByName(fresh.select(*chunks.columns))


def latest_staged(staged: DataFrame) -> DataFrame:
    """One row for each chunk_id: the one staged last; ties go to the greatest text, then section.

    Null chunk_ids count as one key. Only the ids and places are aggregated with the row's columns, in
    one shuffle with a partial step before it.
    """
    cols = [c for c in staged.columns if c not in ("staged_at", "text", "section_path", "chunk_id")]
    row = F.struct("staged_at", "text", "section_path", *cols)
    return staged.groupBy("chunk_id").agg(F.max(row).alias("r")).select("chunk_id", "r.*").select(*staged.columns)


def batches(staged: DataFrame, size: int) -> DataFrame:
    """staged with batch_no: rows of a subject in the order of doc_id and chunk_index, `size` to a batch."""
    return placed(staged, ["subject"], ["doc_id", "chunk_index", "chunk_id"]).withColumn("batch_no", F.floor(F.col("place") / size)).drop("place", "_n")


def chunk_counts(staged: DataFrame) -> DataFrame:
    """(subject, doc_id, chunk_count) of staged chunks."""
    return staged.groupBy(*KEY).agg(F.count(F.lit(1)).alias("chunk_count"))


def listed(subjects: DataFrame, points: DataFrame) -> DataFrame:
    """(name, description, collection, points, populated) of every subject, those without points too."""
    n = points.groupBy(F.col("subject").alias("name")).agg(F.count(F.lit(1)).alias("points"))
    at = F.coalesce("points", F.lit(0).cast("bigint"))
    return subjects.join(n, "name", "left").select("name", F.coalesce("description", F.lit("")).alias("description"), "collection", at.alias("points"), (at > 0).alias("populated"))
