"""What changed between full snapshots, found by Merkle trees over hash ranges of the keys."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.tables import get_file, names_in, new_path, put_file, strip

#: Bits of the key's hash that one level of the tree adds.
FAN_BITS = 4
#: Rows of one snapshot that a leaf should hold.
LEAF_ROWS = 16
_ROWS = "subject string, doc_id string, hash string, spot bigint, digest_a bigint, digest_b bigint"
_NODES = "node bigint, digest_a bigint, digest_b bigint"


def hash_of(c: Column) -> Column:
    """A content hash as it is compared: without case and outer white space; null stays null."""
    return F.lower(strip(c))


def _exact(*cols: Column) -> list[Column]:
    """Arguments for a hash function that tells null from any value."""
    return [x for c in cols for x in (c.isNull(), c)]


def latest(docs: DataFrame) -> DataFrame:
    """(snap_no, subject, doc_id, hash), one row for each key of each snapshot.

    Of several rows with one key in one snapshot the one with the latest loaded_at counts (a null
    loaded_at is the earliest; ties go to the greatest hash). Rows without snap_no belong to no
    snapshot and are left out; null subject and doc_id are values like others.
    Repeated rows are reduced before the shuffle, so a key that holds a third of all rows does no harm.
    """
    return (
        docs.where(F.col("snap_no").isNotNull())
        .select("snap_no", "subject", "doc_id", F.struct("loaded_at", hash_of(F.col("content_hash")).alias("hash")).alias("r"))
        .groupBy("snap_no", "subject", "doc_id")
        .agg(F.max("r").alias("r"))
        .select("snap_no", "subject", "doc_id", F.col("r.hash").alias("hash"))
    )


def snapshot_sizes(docs: DataFrame) -> dict[int, int]:
    """Rows of each snapshot as delivered, repeated ones included. One number for each delivery, so it is short."""
    return {r[0]: r[1] for r in docs.where("snap_no is not null").groupBy("snap_no").count().collect()}


def snapshot_numbers(docs: DataFrame) -> list[int]:
    """The snapshots in the order of delivery."""
    return sorted(snapshot_sizes(docs))


def position(numbers: list[int], c: Column) -> Column:
    """The place of snap_no among the deliveries, from 0; null for others."""
    if not numbers:
        return F.lit(None).cast("int")
    return F.element_at(F.create_map(*[F.lit(x) for p, n in enumerate(numbers) for x in (n, p)]), c)


def _mixed(seed: int, *c: Column) -> Column:
    return F.xxhash64(F.lit(seed), *c)


def _spotted(rows: DataFrame) -> DataFrame:
    """rows (subject, doc_id, hash, ...) with spot, the key's hash, whose first bits are the row's place in the tree, and two digests of the row."""
    digests = [_mixed(seed, *_exact(F.col("subject"), F.col("doc_id"), F.col("hash"))).alias(f"digest_{x}") for seed, x in ((11, "a"), (12, "b"))]
    return rows.select("*", F.xxhash64(*_exact(F.col("subject"), F.col("doc_id"))).alias("spot"), *digests)


def _node(depth: Column | int) -> Column:
    """The node at a depth, 1 at least, that a row is below: the first bits of its spot."""
    return F.call_function("shiftrightunsigned", F.col("spot"), F.lit(64) - FAN_BITS * (depth if isinstance(depth, Column) else F.lit(depth)))


def _depth(rows: int, leaf_rows: int) -> int:
    """Levels below the root at which a leaf has some leaf_rows of so many rows; it grows with them, up to all bits of a hash."""
    return min(64 // FAN_BITS - 1, max(1, math.ceil(math.log2(max(2, rows / leaf_rows)) / FAN_BITS)))


class Snapshots:
    """Snapshots of a table with their Merkle trees, written once each, under one path.

    A leaf's digest is the exclusive or of its rows' digests, with their number; an inner node's is made
    likewise of its children's; a node has 2 ** FAN_BITS children, by the next bits of the keys' hashes. A new snapshot costs
    its own tree. Trees are compared from the root down: below equal nodes nothing is looked at, and rows are read
    for differing leaves alone. Trees of unlike depth are compared down to the lesser one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def manifests(self) -> list[dict]:
        """(number, folder, pos, depth) of each snapshot, in the order of their numbers."""
        at = f"{self.path}/snapshots"
        found = [json.loads(get_file(self.spark, f"{at}/{n}") or "{}") for n in names_in(self.spark, at) if n.endswith(".json")]
        return sorted(found, key=lambda m: m["number"])

    def add(self, docs: DataFrame, leaf_rows: int = LEAF_ROWS) -> list[int]:
        """Writes the snapshots in docs, in one pass, with their trees; returns their numbers. One that is there already is an error and nothing is changed."""
        sizes = snapshot_sizes(docs)
        numbers, depth = sorted(sizes), _depth(max(sizes.values(), default=0), leaf_rows)
        taken = {m["number"] for m in self.manifests()} & set(numbers)
        if taken:
            raise ValueError(f"snapshots {sorted(taken)} are there")
        folder = f"{self.path}/trees/{uuid.uuid4().hex}"
        made = latest(docs).select(position(numbers, F.col("snap_no")).alias("pos"), "subject", "doc_id", "hash")
        _spotted(made).write.partitionBy("pos").parquet(f"{folder}/rows")
        rows = self.spark.read.schema(f"{_ROWS}, pos int").parquet(f"{folder}/rows") if numbers else self.spark.createDataFrame([], f"{_ROWS}, pos int")
        level = rows.groupBy("pos", _node(depth).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("digest_a").alias("a"), F.bit_xor("digest_b").alias("b"))
        level = level.select("pos", "node", _mixed(1, F.col("n"), F.col("a")).alias("digest_a"), _mixed(2, F.col("n"), F.col("b")).alias("digest_b"))
        every = level.withColumn("depth", F.lit(depth))
        for d in range(depth - 1, -1, -1):
            up = [F.bit_xor(_mixed(seed, F.col("node"), F.col(f"digest_{x}"))).alias(f"digest_{x}") for seed, x in ((1, "a"), (2, "b"))]
            level = level.groupBy("pos", F.shiftright("node", FAN_BITS).alias("parent")).agg(*up).withColumnRenamed("parent", "node")
            every = every.unionByName(level.withColumn("depth", F.lit(d)))
        every.write.partitionBy("pos", "depth").parquet(f"{folder}/nodes")
        for pos, n in enumerate(numbers):
            if not put_file(self.spark, f"{self.path}/snapshots/{n}.json", json.dumps({"number": n, "folder": folder, "pos": pos, "depth": depth})):
                raise ValueError(f"snapshot {n} is there")
        return numbers

    def _read(self, kind: str, schema: str, wanted: list[tuple[int, dict]], depth: int | None = None) -> DataFrame:
        """Rows or nodes of snapshots (place, manifest), with their place as pos."""
        found = None
        for folder in sorted({m["folder"] for _, m in wanted}):
            own = {m["pos"]: place for place, m in wanted if m["folder"] == folder}
            one = self.spark.read.schema(f"{schema}, pos int" + (", depth int" if kind == "nodes" else "")).parquet(f"{folder}/{kind}").where(F.col("pos").isin(list(own)))
            one = one.where(F.col("depth") == depth).drop("depth") if depth is not None else one
            if any(pos != place for pos, place in own.items()):
                one = one.withColumn("pos", F.element_at(F.create_map(*[F.lit(x) for k in own.items() for x in k]), F.col("pos")))
            found = one if found is None else found.unionByName(one)
        return self.spark.createDataFrame([], f"{schema}, pos int") if found is None else found

    def changes(self) -> DataFrame:
        """(snap_no, subject, doc_id, change_kind) for every two consecutive snapshots; see snapshot_changes()."""
        all_ = list(enumerate(self.manifests()))
        last, number = len(all_) - 1, [m["number"] for _, m in all_]
        deep = {i: min(all_[i - 1][1]["depth"], all_[i][1]["depth"]) for i in range(1, last + 1)}
        leaves, found = None, None
        for d in range(max(deep.values(), default=-1) + 1):
            level = _paired(self._read("nodes", _NODES, all_, d), last).where(F.col("pair").isin([i for i, x in deep.items() if x >= d]))
            if found is not None:
                level = level.withColumn("up", F.shiftright("node", FAN_BITS)).join(found.select("pair", F.col("node").alias("up")), ["pair", "up"], "left_semi")
            found = _opened(level)
            ends = [i for i, x in deep.items() if x == d]
            if ends:
                one = found.where(F.col("pair").isin(ends)).withColumn("depth", F.lit(d))
                leaves = one if leaves is None else leaves.unionByName(one)
        if leaves is None:
            return self.spark.createDataFrame([], "snap_no bigint, subject string, doc_id string, change_kind string")
        depth = F.element_at(F.create_map(*[F.lit(x) for k in deep.items() for x in k]), F.col("pair"))
        both = _paired(self._read("rows", _ROWS, all_).select("pos", "spot", "subject", "doc_id", "hash"), last).withColumn("node", _node(depth))
        cur = F.col("pos") == F.col("pair")
        kind = F.when(~F.col("was"), "added").when(~F.col("is"), "removed").when(~F.col("hash0").eqNullSafe(F.col("hash1")), "changed")
        return (
            both.join(leaves, ["pair", "node"], "left_semi")
            .groupBy("pair", "subject", "doc_id")
            .agg(F.max(cur).alias("is"), F.max(~cur).alias("was"), F.max(F.when(cur, F.col("hash"))).alias("hash1"), F.max(F.when(~cur, F.col("hash"))).alias("hash0"))
            .select(F.element_at(F.array(*[F.lit(n) for n in number]), F.col("pair") + 1).cast("bigint").alias("snap_no"), "subject", "doc_id", kind.alias("change_kind"))
            .where("change_kind is not null")
        )


def _paired(nodes: DataFrame, last: int) -> DataFrame:
    """Each node once for each of the two pairs of snapshots (pair - 1, pair) it takes part in."""
    return nodes.withColumn("pair", F.explode(F.array("pos", F.col("pos") + 1))).where(F.col("pair").between(1, last))


def _opened(children: DataFrame) -> DataFrame:
    """(pair, node) whose digests differ between the snapshots pair - 1 and pair; children: pair, pos, node and digests."""
    cur = F.col("pos") == F.col("pair")
    pick = lambda c, when: F.max(F.when(when, F.col(c)))
    return (
        children.groupBy("pair", "node")
        .agg(pick("digest_a", cur).alias("a1"), pick("digest_a", ~cur).alias("a0"), pick("digest_b", cur).alias("b1"), pick("digest_b", ~cur).alias("b0"))
        .where(~(F.col("a0").eqNullSafe(F.col("a1")) & F.col("b0").eqNullSafe(F.col("b1"))))
        .select("pair", "node")
    )


def snapshot_changes(docs: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(snap_no, subject, doc_id, change_kind) for every two consecutive snapshots.

    docs: snap_no, subject, doc_id, content_hash, loaded_at; other columns are not read. snap_no of
    the result is the later snapshot's; change_kind is `added`, `removed` or `changed`. A subject that
    is wholly missing from a snapshot is removed there. The first snapshot has no changes; an empty
    table, or one snapshot alone, gives no rows. See latest() for repeated, late and null values.

    The rows of both snapshots are compared only in hash ranges whose Merkle digests differ.
    leaf_rows: rows of a snapshot in one range; more ranges follow more rows. See Snapshots, which keeps the trees.
    """
    kept = Snapshots(docs.sparkSession, new_path(docs.sparkSession, "snapshots"))
    kept.add(docs, leaf_rows)
    return kept.changes()
