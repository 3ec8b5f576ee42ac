"""Incremental runs as Structured Streaming micro-batches that commit exactly once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusspark.operators.store import Store
from corpusspark.operators.sync import KEY
from corpusspark.tables import get_file, put_file, scratch, written

_VERSION = ["last_updated", "source_path", "content_hash"]


def stream_id(store: Store, checkpoint: str) -> str:
    """The stream's name in the store's commits: it is made with the checkpoint and lives as long."""
    at = f"{checkpoint}/corpus-stream-id"
    put_file(store.spark, at, uuid.uuid4().hex)
    return get_file(store.spark, at) or ""


def _committed(store: Store, made: DataFrame, stream: str, batch: int) -> None:
    """One micro-batch of a stream as one version. A batch that a commit of the same stream already names is skipped: a replay changes nothing.

    Of several versions of a document in a batch the latest counts (by last_updated, then source_path and
    content_hash), of several rows of a chunk one. If the store has the document with the same content_hash,
    the chunks of both make it up, as a document may come in several batches; with another hash it is replaced.
    """
    if batch <= store.head()["batches"].get(stream, -1):
        return
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    made = written(made, "batch")
    chosen = made.groupBy(*KEY).agg(F.max(F.struct(*_VERSION)).alias("r")).select(*KEY, *[f"r.{c}" for c in _VERSION])
    fresh = made.alias("m").join(chosen.alias("c"), same("m", "c", [*KEY, "content_hash"]), "left_semi").dropDuplicates([*KEY, "chunk_index"])
    known = store.manifest().alias("k").join(chosen.alias("c"), same("k", "c", [*KEY, "content_hash"]), "left_semi").select(*KEY)
    old = store.points().alias("p").join(known.alias("k"), same("p", "k", KEY), "left_semi")
    old = old.alias("p").join(fresh.alias("f"), same("p", "f", [*KEY, "chunk_index"]), "left_anti").select(*fresh.columns)
    points = written(fresh.unionByName(old), "batch-points")
    counts = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("chunk_count"))
    documents = chosen.alias("c").join(counts.alias("n"), same("c", "n", KEY)).select(*[f"c.{x}" for x in KEY], "source_path", "content_hash", "last_updated", "chunk_count", F.lit(None).cast("string").alias("error"))
    store.commit(points, documents, documents.limit(0), batch=(stream, batch))


def stream_points(rows: DataFrame, store: Store, checkpoint: str, transform=lambda df: df, every: str | None = None):
    """Starts a query that commits each micro-batch of a stream of points to the store.

    rows: a streaming DataFrame; transform makes points of a batch (see store.POINT, without version). every: looks for
    more at this interval, such as `5 minutes`; without it the query ends when the source is read. Several
    streams, and streams whose checkpoint was removed, may write to one store: batches are numbered within a stream.
    """
    stream = stream_id(store, checkpoint)

    def batch(df: DataFrame, n: int) -> None:
        with scratch(store.spark):
            _committed(store, transform(df), stream, n)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_latest(rows: DataFrame, delay: str = "1 hour"):
    """Streaming deduplication of records by key within a watermark: repeated deliveries pass once.

    rows: subject, doc_id, content_hash, loaded_at (without zone or with). Records later than delay
    behind the newest may pass again; the store's commit makes that harmless.
    """
    timed = rows.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", delay)
    return timed.dropDuplicatesWithinWatermark(["subject", "doc_id", "content_hash"]).drop("at")
