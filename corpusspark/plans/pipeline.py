"""The whole way of a document: scan, classify, decode, cut, encode, commit; and search over what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.config import Config
from corpusspark.functions.scalars import point_id
from corpusspark.operators import chunking, encoding, retrieval, sync
from corpusspark.operators.store import Store, retried
from corpusspark.sources.files import decoded, scanned
from corpusspark.tables import scratch, written


def made_points(docs: DataFrame, cfg: Config) -> DataFrame:
    """Points of decoded documents: chunks with ids, payload and vectors."""
    chunks = chunking.chunked(docs.where("text is not null"), cfg.chunk.max_tokens).drop("n_tokens")
    payload = docs.select("subject", "doc_id", "source_path", "content_hash", "last_updated")
    rows = chunks.join(payload, ["subject", "doc_id"]).withColumn("point_id", point_id(F.concat("subject", F.lit("/"), "chunk_id"))).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))
    return encoding.encoded(rows, cfg.encoder, **cfg.encoder_options)


def _committed(spark: SparkSession, store: Store, cfg: Config, name: str) -> DataFrame:
    """Encodes and commits what is staged under a name; returns (subject, chunk_count) of its documents. Failed writes are tried again."""
    fresh, gone, parent = store.staged_rows(name)
    points = written(made_points(fresh, cfg), "points")
    per_doc = points.groupBy("subject", "doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    documents = fresh.drop("text").join(per_doc, ["subject", "doc_id"], "left").fillna(0, ["chunk_count"])
    retried(lambda: store.commit(points, documents, gone, parent))
    counts = written(per_doc.groupBy("subject").agg(F.sum("chunk_count").alias("chunks_embedded")), "counts")
    store.unstage(name)
    return counts


def drained(spark: SparkSession, cfg: Config) -> int:
    """Commits what runs that died after decoding have left, without decoding again; returns how many runs that were.

    What was staged on a version that is no longer the last is dropped: its documents are classified anew.
    """
    store, done = Store(spark, cfg.store), 0
    for name in store.staged():
        with scratch(spark):
            if store.staged_rows(name)[2] == store.head()["version"]:
                _committed(spark, store, cfg, name)
                done += 1
            else:
                store.unstage(name)
    return done


def synced(spark: SparkSession, cfg: Config, names: list[str] | None = None, missing: str = "fail") -> DataFrame:
    """Brings the store in step with the folders; returns one row of statistics a subject.

    One plan serves all subjects. Documents are read only if new or changed; if nothing is, nothing is
    written. What is decoded is staged in the store before it is encoded, so a run that dies then is taken
    up by the next one (drained()). A document that cannot be decoded gets a manifest row with its error
    and no points, and is tried again when it changes. See Store for what happens if a run dies.
    """
    chosen = [cfg.subject(n) for n in names or [s.name for s in cfg.subjects]]
    drained(spark, cfg)
    store = Store(spark, cfg.store)
    if cfg.quantization != "none":
        store.create(cfg.dim, cfg.quantization)
    manifest = store.manifest().where(F.col("subject").isin([s.name for s in chosen]))
    with scratch(spark):
        disk = scanned(spark, [vars(s) for s in chosen], list(cfg.suffixes), list(cfg.include), list(cfg.exclude), missing)
        found = written(sync.classified(disk, manifest), "sync")
        stats = sync.stats(found)
        counted = spark.createDataFrame([(s.name,) for s in chosen], "subject string").join(stats, "subject", "left").fillna(0).fillna(True)
        if found.where("status <> 'unchanged'").isEmpty():
            return _held(counted.withColumn("chunks_embedded", F.lit(0).cast("bigint")))
        fresh = decoded(disk.join(found.where("status in ('new', 'changed')").select("subject", "doc_id"), ["subject", "doc_id"], "left_semi"))
        name = store.stage(fresh, found.where("status = 'deleted'"))  # the first pass; models are loaded only in the second
        done = _committed(spark, store, cfg, name)
        return _held(counted.join(done, "subject", "left").fillna(0, ["chunks_embedded"]))


def _held(stats: DataFrame) -> DataFrame:
    """One row a subject, held by the driver, as the tables it comes from are removed."""
    return stats.sparkSession.createDataFrame(stats.collect(), stats.schema)


def subject_frame(spark: SparkSession, cfg: Config) -> DataFrame:
    return spark.createDataFrame([(s.name, s.description, s.collection) for s in cfg.subjects], "name string, description string, collection string")


class Searcher:
    """list_subjects() and search() over a store."""

    def __init__(self, spark: SparkSession, cfg: Config) -> None:
        self.spark, self.cfg, self.store = spark, cfg, Store(spark, cfg.store)

    def list_subjects(self) -> list[dict]:
        with scratch(self.spark):
            rows = sync.listed(subject_frame(self.spark, self.cfg), self.store.points().select("subject")).collect()
        order = {s.name: i for i, s in enumerate(self.cfg.subjects)}
        return sorted((r.asDict() for r in rows), key=lambda r: order[r["name"]])

    def search(self, subject: str | list[str], query: str, k: int | None = None) -> list[dict]:
        """The k best chunks with what is needed to cite them. An unknown subject is a KeyError, a negative k a ValueError."""
        k = k or self.cfg.search.default_k
        if k < 0:
            raise ValueError("k must not be negative")
        pools = self.cfg.resolve(subject)
        if not pools or not query.strip():
            return []
        rows = [(0, s.name, i, len(pools), query, k) for i, s in enumerate(pools)]
        asked = self.spark.createDataFrame(rows, "query_id bigint, subject string, pool_no int, n_pools bigint, query string, k int")
        c = self.cfg.search
        with scratch(self.spark):
            asked = retrieval.with_vectors(asked, self.cfg.encoder, **self.cfg.encoder_options)
            found = retrieval.search(asked, self.store.points([s.name for s in pools]), c.reranker if c.rerank else None, c.reranker_options, prefetch=c.prefetch, one=c.top_n, many=c.multi_top_n)
            return [{x: r[x] for x in r.asDict() if x not in ("query_id", "place")} for r in found.orderBy("place").collect()]

    def instructions(self) -> str:
        """The configured instructions with the catalogue of subjects."""
        lines = [f"- {s.name}: {s.description}" if s.description else f"- {s.name}" for s in self.cfg.subjects]
        return "\n\n".join(x for x in (self.cfg.server.instructions.strip(), "Subjects:\n" + "\n".join(lines)) if x)
