"""The store of chunks and manifest: immutable segments under versions; of several writers one commits a version."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.functions.scalars import quantized
from corpusspark.operators.sync import KEY
from corpusspark.tables import get_file, names_in, put_file, remove

POINT = "subject string, doc_id string, chunk_index bigint, chunk_id string, point_id string, source_path string, section_path string, content_hash string, last_updated string, text string, dense array<float>, sparse map<bigint,double>, version bigint"
MANIFEST = "subject string, doc_id string, source_path string, content_hash string, last_updated string, chunk_count bigint, version bigint, error string"
#: Manifest tables that a version may name; a commit beyond that writes them as one.
DELTAS = 16
_ROW = ["source_path", "content_hash", "last_updated", "chunk_count", "version", "error", "gone"]


class Conflict(RuntimeError):
    """Another writer has committed the version in the meantime."""


class Store:
    """Points live in segments that are never changed; a manifest row names the version that wrote its document's points.

    A commit writes the touched documents' points as a new segment, and their manifest rows, gone ones
    included, as a new manifest table; then versions/<n>.json, which only one writer can put there. Of a
    document's manifest rows the one of the latest version holds. Points whose document has another version by
    then, or is gone, are no longer seen: a document that shrank or was deleted leaves nothing behind, and a
    commit costs what changed. Every DELTAS commits the manifest tables are written as one. A writer that dies
    before its version is there has changed nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def create(self, dim: int | None = None, quantization: str = "none") -> bool:
        """Fixes the size of dense vectors, and whether they are kept as codes of eight bits (`scalar`); False if that is settled already.

        A store works without: any size is taken then. Other settings than those there are an error.
        """
        if quantization not in ("none", "scalar"):
            raise ValueError(f"unknown quantization {quantization!r}; known: none, scalar")
        wanted = {"dim": dim, "quantization": quantization}
        if put_file(self.spark, f"{self.path}/settings.json", json.dumps(wanted)):
            return True
        if self.settings() != wanted:
            raise ValueError(f"the store has {self.settings()}")
        return False

    def settings(self) -> dict:
        return json.loads(get_file(self.spark, f"{self.path}/settings.json") or '{"dim": null, "quantization": "none"}')

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/versions") if n.endswith(".json"))

    def head(self) -> dict:
        v = self.versions()
        empty = {"version": 0, "segments": [], "manifests": [], "batches": {}}
        return json.loads(get_file(self.spark, f"{self.path}/versions/{v[-1]:010d}.json")) if v else empty

    def _rows(self, head: dict) -> DataFrame:
        """The manifest with gone documents."""
        tables = head["manifests"]
        rows = self.spark.read.schema(f"{MANIFEST}, gone boolean").parquet(*tables) if tables else self.spark.createDataFrame([], f"{MANIFEST}, gone boolean")
        if len(tables) < 2:
            return rows
        return rows.groupBy(*KEY).agg(F.max_by(F.struct(*_ROW), "version").alias("r")).select(*KEY, *[f"r.{c}" for c in _ROW])

    def manifest(self) -> DataFrame:
        return self._rows(self.head()).where("not gone").drop("gone")

    def points(self, subjects: list[str] | None = None) -> DataFrame:
        """Live points; only the partitions of the subjects asked for are read, of all segments in one scan."""
        head = self.head()
        if not head["segments"]:
            return self.spark.createDataFrame([], POINT)
        every = self.spark.read.schema(f"{POINT}, segment string").option("basePath", f"{self.path}/segments").parquet(*head["segments"]).drop("segment")
        own = self._rows(head).where("not gone").select(*KEY, "version")
        if subjects is not None:
            every, own = every.where(F.col("subject").isin(subjects)), own.where(F.col("subject").isin(subjects))
        return every.join(own, [*KEY, "version"], "left_semi").select(*self.spark.createDataFrame([], POINT).columns)

    def sample(self, n: int) -> DataFrame:
        """The first n points by chunk_id, for comparisons that take some."""
        return self.points().orderBy("chunk_id", "subject").limit(n)

    def _segment(self, points: DataFrame, n: int) -> str:
        made = self.settings()
        if made["dim"]:
            fits = F.col("dense").isNull() | (F.size("dense") == made["dim"])
            points = points.withColumn("dense", F.when(F.coalesce(fits, F.lit(False)), F.col("dense")).otherwise(F.raise_error(F.lit(f"a dense vector has not {made['dim']} dimensions")).cast("array<float>")))
        if made["quantization"] == "scalar":  # cosines do not hang on the scale, so codes serve as vectors
            points = points.withColumn("dense", F.transform(quantized(F.col("dense")), lambda x: x.cast("float")))
        path = f"{self.path}/segments/segment={n:010d}-{uuid.uuid4().hex}"
        points.repartition("subject", "doc_id").sortWithinPartitions("subject", "doc_id", "chunk_index").write.partitionBy("subject").parquet(path)
        return path

    def commit(self, points: DataFrame, documents: DataFrame, gone: DataFrame, parent: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Makes a version in which documents (manifest rows without version) have just these points, and gone has none.

        batch: (stream, number) that the version contains; head()["batches"] has the last number of each stream.
        """
        head = self.head()
        if parent is not None and parent != head["version"]:
            raise Conflict(f"version {head['version']} is there, {parent} was expected")
        n = head["version"] + 1
        segment = self._segment(points.withColumn("version", F.lit(n).cast("bigint")), n)
        cols = self.spark.createDataFrame([], f"{MANIFEST}, gone boolean").columns
        none = {c: F.lit(None).cast("string").alias(c) for c in ("source_path", "content_hash", "last_updated", "error")}
        fresh = documents.select(*KEY, *_ROW[:4], F.lit(n).cast("bigint").alias("version"), "error", F.lit(False).alias("gone"))
        left = gone.select(*KEY).distinct().select(*KEY, *[none.get(c, F.lit(0).cast("bigint").alias(c) if c == "chunk_count" else F.lit(n).cast("bigint").alias(c) if c == "version" else F.lit(True).alias(c)) for c in _ROW])
        left = left.alias("l").join(fresh.alias("f"), [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in KEY], "left_anti")
        delta = fresh.unionByName(left).select(*cols)
        if len(head["manifests"]) >= DELTAS:
            known = self._rows(head).where("not gone").alias("k").join(delta.alias("d"), [F.col(f"k.{c}").eqNullSafe(F.col(f"d.{c}")) for c in KEY], "left_anti")
            delta, before = known.select(*cols).unionByName(delta.where("not gone")), []
        else:
            before = head["manifests"]
        table = f"{self.path}/manifests/{n:010d}-{uuid.uuid4().hex}"
        delta.write.parquet(table)
        batches = head["batches"] if batch is None else head["batches"] | {batch[0]: batch[1]}
        body = {"version": n, "segments": [*head["segments"], segment], "manifests": [*before, table], "batches": batches}
        if not put_file(self.spark, f"{self.path}/versions/{n:010d}.json", json.dumps(body)):
            remove(self.spark, segment)
            remove(self.spark, table)
            raise Conflict(f"version {n} is there")
        return n

    def compact(self) -> int:
        """Writes the live points as one segment, so that readers open fewer files; old versions stay readable."""
        head = self.head()
        n = head["version"] + 1
        segment = self._segment(self.points(), n)
        if not put_file(self.spark, f"{self.path}/versions/{n:010d}.json", json.dumps(head | {"version": n, "segments": [segment]})):
            remove(self.spark, segment)
            raise Conflict(f"version {n} is there")
        return n

    def vacuum(self, keep: int = 1) -> int:
        """Removes versions but the last `keep`, and every segment and manifest table that none of those names; returns how many. No writer or reader of an older version may be at work."""
        versions = self.versions()
        if not versions:
            return 0
        heads = [json.loads(get_file(self.spark, f"{self.path}/versions/{v:010d}.json")) for v in versions[-keep:]]
        named = {p.rpartition("/")[2] for h in heads for p in (*h["segments"], *h["manifests"])}
        for v in versions[:-keep]:
            remove(self.spark, f"{self.path}/versions/{v:010d}.json")
        old = [f"{self.path}/{k}/{n}" for k in ("segments", "manifests") for n in names_in(self.spark, f"{self.path}/{k}") if n not in named]
        for path in old:
            remove(self.spark, path)
        return len(old)

    # --- documents that are decoded and not yet encoded

    def stage(self, documents: DataFrame, gone: DataFrame) -> str:
        """Keeps a run's decoded documents, and the keys of those that are gone, until they are committed; returns their name."""
        name = uuid.uuid4().hex
        documents.write.parquet(f"{self.path}/staged/{name}/documents")
        gone.select(*KEY).distinct().write.parquet(f"{self.path}/staged/{name}/gone")
        put_file(self.spark, f"{self.path}/staged/{name}/ready.json", json.dumps({"parent": self.head()["version"]}))
        return name

    def staged(self) -> list[str]:
        """Names of what is staged whole, in no order: each was staged on the version that its ready.json names."""
        at = f"{self.path}/staged"
        return [n for n in names_in(self.spark, at) if get_file(self.spark, f"{at}/{n}/ready.json")]

    def staged_rows(self, name: str) -> tuple[DataFrame, DataFrame, int]:
        """(documents, gone, version) of what is staged under a name."""
        at = f"{self.path}/staged/{name}"
        return self.spark.read.parquet(f"{at}/documents"), self.spark.read.parquet(f"{at}/gone"), json.loads(get_file(self.spark, f"{at}/ready.json"))["parent"]

    def unstage(self, name: str) -> None:
        remove(self.spark, f"{self.path}/staged/{name}")


def reencoded(points: DataFrame, backend: str, **options) -> DataFrame:
    """points with new vectors from another encoder, ids and payload as they are."""
    from corpusspark.operators.encoding import encoded

    return encoded(points.drop("dense", "sparse"), backend, **options)


def reencode(source: Store, target: Store, backend: str, fresh: bool = False, limit: int | None = None, **options) -> int:
    """Fills target with source's points under another encoder; returns the version.

    fresh: target's own documents are gone afterwards, else they stay unless source has them. limit: only so many points, the first by
    chunk_id, for a trial.
    """
    points = source.points() if limit is None else source.sample(limit)
    docs = source.manifest().join(points.select(*KEY).distinct(), KEY, "left_semi")
    counts = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("chunk_count"))
    documents = docs.drop("chunk_count", "version").join(counts, KEY)
    gone = target.manifest().select(*KEY) if fresh else target.manifest().select(*KEY).limit(0)
    return target.commit(reencoded(points.drop("version"), backend, **options), documents, gone)


def retried(call: Callable, attempts: int = 8, first: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep, but: tuple[type[Exception], ...] = (Conflict,)):
    """call(), again after failures, waiting twice as long each time up to `most` seconds; the last failure, and those in `but`, are raised."""
    delay = first
    for n in range(attempts):
        try:
            return call()
        except but:
            raise
        except Exception:
            if n == attempts - 1:
                raise
            sleep(delay)
            delay = min(most, delay * 2)
    return None
