"""Immutable table versions: data files, deletion vectors, manifests, and runs over what changed.

A row is written once, to a data file of the version that first has it. A version in which it is
gone, or has another hash, adds its row number to a deletion vector of that file. A version's manifest
names the files it added and the files whose vectors it added to; what lies between two versions is
therefore known from the manifests between them, and no other file is opened.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.operators.snapshots import _exact, latest, position, snapshot_sizes
from corpusspark.tables import get_file, names_in, new_path, put_file, remove, written

#: Rows that one data file should hold.
FILE_ROWS = 50_000
KEY = ["subject", "doc_id"]
#: What names a data file: the version that added it, and the part of its keys' hashes it holds.
FILE = ["add_version", "bucket"]
_DATA = "subject string, doc_id string, hash string, row_no int, add_version int, bucket int"
_VECTORS = "deleted array<int>, add_version int, bucket int, del_version int"
_CHANGES = "span bigint, subject string, doc_id string, change_kind string"
_POSITIONS = "subject string, version int"


class Conflict(RuntimeError):
    """Another writer has committed in the meantime; nothing of this one is seen."""


def intervals(docs: DataFrame, numbers: list[int]) -> DataFrame:
    """(subject, doc_id, hash, add_version, del_version) of each stretch of versions that has a row as it is.

    Versions are places in the order of delivery. del_version is the first version without the row,
    null if the last one still has it.
    """
    w = Window.partitionBy(*KEY).orderBy("pos")
    last = len(numbers) - 1
    rows = latest(docs).withColumn("pos", position(numbers, F.col("snap_no")))
    starts = F.lag("pos").over(w).isNull() | (F.lag("pos").over(w) != F.col("pos") - 1) | ~F.lag("hash").over(w).eqNullSafe(F.col("hash"))
    return (
        rows.withColumn("first", starts.cast("int"))
        .withColumn("stretch", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*KEY, "stretch")
        .agg(F.max("hash").alias("hash"), F.min("pos").alias("add_version"), (F.max("pos") + 1).alias("end"))
        .select(*KEY, "hash", "add_version", F.when(F.col("end") <= last, F.col("end")).alias("del_version"))
    )


def _same(a: str, b: str, cols: list[str]):
    on = F.lit(True)
    for c in cols:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


class History:
    """All versions of a table, written as data files, deletion vectors and manifests under one path.

    data/add_version=a/bucket=b are the data files, vectors/del_version=d the vectors that version d
    added, versions/<n>.json the manifest of version n. Manifests are put in place last, by writers that find
    the name free, and hold file names alone; nothing that one names is changed afterwards.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._manifests: dict[str, dict] = {}

    @staticmethod
    def load(docs: DataFrame, path: str | None = None, file_rows: int = FILE_ROWS) -> History:
        """Writes every snapshot of docs as a version, all in one pass: each row once, each deletion once."""
        sizes = snapshot_sizes(docs)
        numbers = sorted(sizes)
        h = History(docs.sparkSession, path or new_path(docs.sparkSession, "history"))
        if h.manifests():
            raise Conflict(f"{h.path} has versions")
        buckets = max(1, math.ceil(max(sizes.values(), default=0) / file_rows))
        h._write(intervals(docs, numbers), buckets)
        h._commit({i: {"snap_no": n} for i, n in enumerate(numbers)}, buckets)
        return h

    def _write(self, rows: DataFrame, buckets: int) -> None:
        """Adds rows (subject, doc_id, hash, add_version, del_version) as data files, and the vectors of those that end."""
        key = F.xxhash64(*_exact(F.col("subject"), F.col("doc_id")))
        place = Window.partitionBy(*FILE).orderBy(*KEY)
        placed = rows.withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int")).withColumn("row_no", F.row_number().over(place) - 1)
        placed = written(placed, "placed")  # a file and bucket holds file_rows rows or so, whatever share of them one subject has
        placed.drop("del_version").write.mode("append").partitionBy(*FILE).parquet(f"{self.path}/data")
        self._mark(placed.where("del_version is not null").select(*FILE, "row_no", "del_version"))

    def _mark(self, gone: DataFrame) -> None:
        """Adds vectors of rows (add_version, bucket, row_no, del_version)."""
        vectors = gone.groupBy(*FILE, "del_version").agg(F.array_sort(F.collect_list("row_no")).alias("deleted"))
        vectors.write.mode("append").partitionBy("del_version").parquet(f"{self.path}/vectors")

    def _commit(self, versions: dict[int, dict], buckets: int) -> None:
        """Puts the manifests of versions in place: the files they added, and those they added vectors to."""
        files = self._names()
        marked = {v: [] for v in versions}
        for r in self.vectors().where(F.col("del_version").isin(list(versions))).select("del_version", *FILE).distinct().collect():  # file names alone
            marked[r["del_version"]].append([r["add_version"], r["bucket"]])
        for v, body in versions.items():
            added = sorted([a, b] for a, b in files if a == v)
            if not put_file(self.spark, f"{self.path}/versions/{v:010d}.json", json.dumps(body | {"version": v, "buckets": buckets, "added": added, "marked": sorted(marked[v])})):
                raise Conflict(f"version {v} is there")

    def _names(self) -> list[tuple[int, int]]:
        """(add_version, bucket) of the data files there are, from the names of their folders."""
        number, at = lambda n: int(n.partition("=")[2]), f"{self.path}/data"
        return [(number(a), number(b)) for a in names_in(self.spark, at) if "=" in a for b in names_in(self.spark, f"{at}/{a}") if "=" in b]

    def append(self, snapshot: DataFrame, snap_no: int) -> int:
        """Adds one snapshot as the next version: what is new or has another hash as files, what is gone as vectors.

        snapshot: subject, doc_id, content_hash, loaded_at; all its rows are of the snapshot. Committed
        versions stay as they are, whatever arrives late for them. A version's files are
        in a folder of their own; of two writers that add the same version one gets a Conflict, and its folder is
        removed.
        """
        before = self.manifests()
        v, buckets = len(before), before[-1]["buckets"] if before else max(1, math.ceil(snapshot.count() / FILE_ROWS))
        new = latest(snapshot.withColumn("snap_no", F.lit(snap_no))).drop("snap_no").withColumn("there", F.lit(1))
        old = self.live(v - 1).withColumn("there", F.lit(1))
        joined = new.alias("n").join(old.alias("o"), _same("n", "o", [*KEY, "hash"]), "full_outer")
        is_new, is_old = F.col("n.there").isNotNull(), F.col("o.there").isNotNull()
        fresh = joined.where(is_new & ~is_old).select(*[F.col(f"n.{c}") for c in (*KEY, "hash")], F.lit(v).alias("add_version"), F.lit(None).cast("int").alias("del_version"))
        gone = joined.where(is_old & ~is_new).select(*[F.col(f"o.{c}") for c in (*FILE, "row_no")], F.lit(v).alias("del_version"))
        draft = History(self.spark, f"{self.path}/appended/{uuid.uuid4().hex}")
        gone = written(gone, "gone")
        draft._write(fresh, buckets)
        draft._mark(gone)
        added = sorted([a, b] for a, b in draft._names())
        marked = sorted([r[0], r[1]] for r in gone.select(*FILE).distinct().collect())
        body = {"snap_no": snap_no, "version": v, "buckets": buckets, "added": added, "marked": marked, "folder": draft.path.removeprefix(f"{self.path}/")}
        if not put_file(self.spark, f"{self.path}/versions/{v:010d}.json", json.dumps(body)):
            remove(self.spark, draft.path)
            raise Conflict(f"version {v} is there")
        return v

    def manifests(self) -> list[dict]:
        """The versions' manifests, in order."""
        at = f"{self.path}/versions"
        names = [n for n in names_in(self.spark, at) if n.endswith(".json")]
        for n in names:  # they never change
            if n not in self._manifests:
                self._manifests[n] = json.loads(get_file(self.spark, f"{at}/{n}") or "{}")
        return [self._manifests[n] for n in names]

    def numbers(self) -> list[int]:
        """Snapshot numbers of the versions, in order."""
        return [m["snap_no"] for m in self.manifests()]

    def files(self) -> DataFrame:
        """(add_version, bucket) of all data files."""
        return self.spark.createDataFrame([tuple(f) for m in self.manifests() for f in m["added"]], "add_version int, bucket int")

    def data(self, files: set[tuple[int, int]] | None = None) -> DataFrame:
        """The rows of these data files, or of all; no other is opened."""
        found = None
        for base, own in self._bases():
            paths = [f"{base}/data/add_version={a}/bucket={b}" for a, b in sorted(own if files is None else own & files)]
            if paths:
                one = self.spark.read.schema(_DATA).option("basePath", f"{base}/data").parquet(*paths)
                found = one if found is None else found.unionByName(one)
        return self.spark.createDataFrame([], _DATA) if found is None else found

    def vectors(self, upto: int | None = None) -> DataFrame:
        """(add_version, bucket, del_version, deleted) of all versions, or of those up to one."""
        found = self.spark.createDataFrame([], _VECTORS)
        for base, _ in self._bases():
            if any("=" in n for n in names_in(self.spark, f"{base}/vectors")):
                found = found.unionByName(self.spark.read.schema(_VECTORS).parquet(f"{base}/vectors"))
        return found if upto is None else found.where(F.col("del_version") <= upto)

    def _bases(self) -> list[tuple[str, set[tuple[int, int]]]]:
        """(folder, data files in it): the history's own, and those of appended versions."""
        own: dict[str, set] = {self.path: set()}
        for m in self.manifests():
            base = f"{self.path}/{m['folder']}" if m.get("folder") else self.path
            own.setdefault(base, set()).update((a, b) for a, b in m["added"])
        return list(own.items())

    def _marked_rows(self, data: DataFrame, upto: int) -> DataFrame:
        """data with del_version, as far as a version up to `upto` has deleted the row."""
        gone = self.vectors(upto).select(*FILE, "del_version", F.explode("deleted").alias("row_no"))
        return data.alias("d").join(gone.hint("merge").alias("v"), [F.col(f"d.{c}") == F.col(f"v.{c}") for c in (*FILE, "row_no")], "left").select("d.*", "v.del_version")

    def live(self, version: int) -> DataFrame:
        """(subject, doc_id, hash, add_version, bucket, row_no): the rows of a version."""
        files = {(a, b) for m in self.manifests()[: version + 1] for a, b in m["added"]}
        return self._marked_rows(self.data(files), version).where("del_version is null").drop("del_version")

    def touched(self, low: int, high: int) -> set[tuple[int, int]]:
        """The data files that can hold a difference of two versions: those added, or marked, by a version after low, up to high."""
        between = [m for m in self.manifests() if low < m["version"] <= high]
        return {(a, b) for m in between for a, b in [*m["added"], *m["marked"]]}

    def changes(self, spans: DataFrame) -> DataFrame:
        """(span, subject, doc_id, change_kind) between the two versions of each span.

        spans: span, subject, version_from, version_to; one row a span. change_kind is `added`, `changed`
        or `removed`, as version_to is seen from version_from, which may also be the later one. A row that
        left and came back as it was has not changed. Only files that the manifests between the versions name,
        and their vectors, are read.
        """
        ranges = [(r[0], r[1]) for r in spans.select("version_from", "version_to").distinct().collect()]  # pairs of versions
        by_range = {x: self.touched(min(x), max(x)) for x in ranges}
        wanted = self.spark.createDataFrame([(*x, a, b) for x, files in by_range.items() for a, b in sorted(files)], "version_from int, version_to int, add_version int, bucket int")
        every = set().union(*by_range.values())
        if not every:
            return self.spark.createDataFrame([], _CHANGES)
        rows = self._marked_rows(self.data(every), max(max(x) for x in ranges))
        s = spans.select("span", F.col("subject").alias("of"), "version_from", "version_to").join(wanted, ["version_from", "version_to"])
        live = lambda v: (F.col("r.add_version") <= F.col(v)) & (F.col("del_version").isNull() | (F.col(v) < F.col("del_version")))
        seen = (
            rows.alias("r")
            .join(s.alias("s"), F.col("r.subject").eqNullSafe(F.col("s.of")) & (F.col("r.add_version") == F.col("s.add_version")) & (F.col("r.bucket") == F.col("s.bucket")))
            .select("span", "subject", "doc_id", "hash", live("version_from").alias("before"), live("version_to").alias("after"))
            .where("before <> after")
        )
        side = lambda x: F.max(F.when(F.col(x), F.col("hash"))).alias(f"hash_{x}")
        kind = (
            F.when(F.col("is_after") & ~F.col("is_before"), "added")
            .when(F.col("is_before") & ~F.col("is_after"), "removed")
            .when(~F.col("hash_before").eqNullSafe(F.col("hash_after")), "changed")
        )
        return (
            seen.groupBy("span", "subject", "doc_id")
            .agg(F.max("before").alias("is_before"), F.max("after").alias("is_after"), side("before"), side("after"))
            .select(F.col("span").cast("bigint").alias("span"), "subject", "doc_id", kind.alias("change_kind"))
            .where("change_kind is not null")
        )


class IncrementalRun:
    """Processes what changed since each source's last successful run, once, whatever fails.

    A step's output is written to a folder of its own; then commits/<n>.json names it together with the
    position (the processed version of each source) that holds from then on. Output without a commit is not
    seen, and its step starts again from the last position; of two runners that commit the same n one gets a
    Conflict, and its output is removed. So no record is skipped or repeated.
    """

    def __init__(self, history: History, out: str) -> None:
        self.history, self.out, self.spark = history, out, history.spark

    def commits(self) -> list[dict]:
        at = f"{self.out}/commits"
        return [json.loads(get_file(self.spark, f"{at}/{n}") or "{}") for n in names_in(self.spark, at) if n.endswith(".json")]

    def positions(self) -> DataFrame:
        """(subject, version): the last processed version of each source that has had a run."""
        c = self.commits()
        return self.spark.read.schema(_POSITIONS).parquet(f"{self.out}/{c[-1]['positions']}") if c else self.spark.createDataFrame([], _POSITIONS)

    def advance(self, wanted: DataFrame, step=lambda df: df, first: str = "all") -> int:
        """Brings sources to versions, through one or several runs each; returns the number of the commit.

        wanted: span (which is in the output's rows), subject, version_to, turn. A source's runs follow each other
        by turn, each from the version of the one before it, the first from the source's position. step makes
        the output of the changes (span, subject, doc_id, change_kind). The first run of a source without a position
        has all its rows added, or with first="skip" none. All runs of a step are committed together or not at all.
        """
        n, name = len(self.commits()), uuid.uuid4().hex
        known = self.positions()
        w = wanted.alias("w").join(known.alias("p"), F.col("w.subject").eqNullSafe(F.col("p.subject")), "left").select("w.*", F.col("p.version").alias("at"))
        order = Window.partitionBy("subject").orderBy("turn")
        start = F.coalesce(F.lag("version_to").over(order), "at", F.lit(-1) if first == "all" else F.lit(None).cast("int")).cast("int")
        last = F.row_number().over(Window.partitionBy("subject").orderBy(F.col("turn").desc())) == 1
        spans = written(w.select("span", "subject", start.alias("version_from"), F.col("version_to").cast("int").alias("version_to"), last.alias("last")), "spans")
        step(self.history.changes(spans.where("version_from is not null and version_from <> version_to"))).write.parquet(f"{self.out}/batches/{name}")
        kept = known.alias("p").join(spans.alias("s"), F.col("p.subject").eqNullSafe(F.col("s.subject")), "left_anti")
        kept.unionByName(spans.where("last").select("subject", F.col("version_to").alias("version"))).coalesce(1).write.parquet(f"{self.out}/positions/{name}")
        if not put_file(self.spark, f"{self.out}/commits/{n:010d}.json", json.dumps({"batch": f"batches/{name}", "positions": f"positions/{name}"})):
            for x in ("batches", "positions"):
                remove(self.spark, f"{self.out}/{x}/{name}")
            raise Conflict(f"commit {n} is there")
        return n

    def run(self, step=lambda df: df, to: int | None = None) -> bool:
        """Brings all sources of the history to a version, the last by default; False if they are there."""
        to = len(self.history.manifests()) - 1 if to is None else to
        sources = self.history.data().select("subject").distinct()
        wanted = sources.alias("w").join(self.positions().alias("p"), F.col("w.subject").eqNullSafe(F.col("p.subject")), "left")
        wanted = wanted.where(F.coalesce("p.version", F.lit(-1)) < to).select(F.lit(to).cast("bigint").alias("span"), "w.subject", F.lit(to).alias("version_to"), F.lit(1).alias("turn"))
        if wanted.isEmpty():
            return False
        self.advance(wanted, step)
        return True

    def output(self) -> DataFrame:
        """The committed output."""
        return self.spark.read.parquet(*[f"{self.out}/{c['batch']}" for c in self.commits()])


def ok_runs(runs: DataFrame, numbers: list[int]) -> DataFrame:
    """(span, subject, version_to, turn): the successful runs of each subject, in turn from 1.

    A run counts if status is `ok`; others, null included, left no effect. Repeated rows count once. Runs are in
    the order of started_at, then run_id; a null started_at is the earliest. A run whose snapshot was never
    delivered saw the last one delivered before it, or nothing (version -1).
    """
    n = F.array(*[F.lit(x) for x in numbers]) if numbers else F.array().cast("array<int>")
    ok = (
        runs.where("status = 'ok' and snap_no is not null")
        .select("run_id", "subject", "snap_no", "started_at")
        .distinct()
        .groupBy("run_id", "subject")
        .agg(F.min(F.struct("started_at", "snap_no")).alias("r"))
        .select(F.col("run_id").cast("bigint").alias("span"), "subject", "r.started_at", (F.size(F.filter(n, lambda x: x <= F.col("r.snap_no"))) - 1).alias("version_to"))
    )
    return ok.select("span", "subject", "version_to", F.row_number().over(Window.partitionBy("subject").orderBy("started_at", "span")).alias("turn"))


def run_changes(docs: DataFrame, runs: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """(run_id, subject, doc_id, change_kind): the records each successful run has to process.

    docs: full snapshots (snap_no, subject, doc_id, content_hash, loaded_at). runs: run_id, subject,
    snap_no, started_at, status. Change is told by content_hash alone, never by last_updated. A
    subject's first successful run has no rows; neither has a run over the snapshot of the run before.
    Empty tables give no rows. The log is replayed through IncrementalRun, as one that catches up with all runs
    at once: what is read are the files that the manifests between the runs' versions name.
    """
    spark = docs.sparkSession
    h = History.load(docs, file_rows=file_rows)
    run = IncrementalRun(h, new_path(spark, "runs"))
    run.advance(ok_runs(runs, h.numbers()), first="skip")
    found = run.output()
    return found.select(F.col("span").alias("run_id"), "subject", "doc_id", "change_kind")
