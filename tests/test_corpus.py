"""Sync, chunking, graphs, reconciliation."""

import random

import pytest
from pyspark.sql import functions as F

from corpusspark.operators import chunking, graph, reconcile, sync
from tests.conftest import rows

KEYED = "subject string, doc_id string, content_hash string"


def test_classified_with_nulls(spark):
    disk = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "n", None), (None, "x", "1"), ("t", "a", "1")], KEYED)
    manifest = spark.createDataFrame([("s", "a", "1"), ("s", "b", "3"), ("s", "n", None), (None, "x", "2"), ("s", "gone", "1")], KEYED)
    found = {(r.subject, r.doc_id): r.status for r in sync.classified(disk, manifest).collect()}
    assert found == {("s", "a"): "unchanged", ("s", "b"): "changed", ("s", "n"): "unchanged", (None, "x"): "changed", ("t", "a"): "new", ("s", "gone"): "deleted"}
    assert rows(sync.stats(sync.classified(disk, disk)), "subject", "is_noop") == [(None, True), ("s", True), ("t", True)]


def test_merge_equals_the_disk(spark):
    r = random.Random(7)
    make = lambda: spark.createDataFrame([("s", str(i), r.choice("xyz")) for i in range(40) if r.random() < 0.7], KEYED)
    disk, manifest = make(), make()
    found = sync.classified(disk, manifest)
    fresh = disk.join(found.where("status in ('new','changed')").select("subject", "doc_id"), ["subject", "doc_id"], "left_semi")
    assert rows(sync.upserted(sync.without(manifest, found.where("status='deleted'"), sync.KEY), fresh, sync.KEY)) == rows(disk)


def test_replaced_leaves_nothing_of_a_shrunk_document(spark):
    kind = "subject string, doc_id string, chunk_index int"
    old = spark.createDataFrame([("s", "a", i) for i in range(3)] + [("s", "b", 0), ("s", "c", 0)], kind)
    fresh, gone = spark.createDataFrame([("s", "a", 0)], kind), spark.createDataFrame([("s", "c")], "subject string, doc_id string")
    assert rows(sync.replaced(old, fresh, gone)) == [("s", "a", 0), ("s", "b", 0)]
    assert rows(sync.inserted(fresh, old, ["subject", "doc_id"]), "doc_id") == [("a",), ("b",), ("c",)]


def test_batches_and_latest(spark):
    kind = "chunk_id string, doc_id string, subject string, chunk_index int, section_path string, text string, staged_at timestamp"
    df = spark.createDataFrame([(f"d:{i}", "d", "s", i, None, "t", None) for i in range(5)] + [("d:0", "d", "s", 0, "new", "t", __import__("datetime").datetime(2024, 1, 1))], kind)
    found = sync.latest_staged(df)
    assert rows(found, "chunk_id", "section_path")[0] == ("d:0", "new") and found.count() == 5
    assert [r.batch_no for r in sync.batches(found, 2).orderBy("chunk_index").collect()] == [0, 0, 1, 1, 2]


MD = """intro words
# A
alpha
## B
beta
```
# not a heading
```
### C
# D
delta

"""


def test_heading_trails(spark):
    docs = spark.createDataFrame([("s", "d", MD), ("s", "none", None), ("s", "blank", " \n ")], "subject string, doc_id string, text string")
    found = {r.line: r.section for r in chunking.sections(docs).where("doc_id = 'd'").collect()}
    assert found["intro words"] == "" and found["alpha"] == "A" and found["beta"] == "A > B" and found["# not a heading"] == "A > B" and found["### C"] == "A > B > C" and found["delta"] == "D"
    chunks = chunking.chunked(docs).orderBy("chunk_index").collect()
    assert [(c.section_path, c.text.strip()) for c in chunks] == [("", "intro words"), ("A", "alpha"), ("A > B", "beta\n```\n# not a heading\n```"), ("D", "delta")]
    assert [c.chunk_id for c in chunks] == ["d:0", "d:1", "d:2", "d:3"]


def test_chunks_lose_no_word_and_keep_the_limit(spark):
    r = random.Random(5)
    text = "\n".join(" ".join(f"w{r.randrange(99)}" for _ in range(r.choice([0, 1, 5, 30, 90]))) for _ in range(60))
    docs = spark.createDataFrame([("s", "d", text)], "subject string, doc_id string, text string")
    found = chunking.chunked(docs, 20).orderBy("chunk_index").collect()
    assert " ".join(c.text for c in found).split() == text.split()
    assert max(c.n_tokens for c in found) < 40


def _closure(edges):
    found = set(edges)
    while more := {(a, d) for a, b in found for c, d in edges if b == c} - found:
        found |= more
    return sorted(found)


def test_closure_with_a_cycle(spark):
    r = random.Random(3)
    edges = list({(r.randrange(14), r.randrange(14)) for _ in range(20)}) + [(20, 21), (21, 20)]
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src int, dst int")
    assert sorted(map(tuple, graph.closure(df).collect())) == _closure(edges)
    assert graph.closure(df.limit(0)).count() == 0


def test_symbols_and_what_is_common(spark):
    kind = "file string, sym string, req array<string>"
    b = spark.createDataFrame([("a.jar", "core", []), ("b.jar", "core", []), ("http-1.2.jar", "", []), ("svc1.jar", "one", ["core", "http", "lost"]), ("svc2.jar", "two", ["core", "one"]), ("core-9.jar", None, [])], kind)
    assert dict(map(tuple, graph.symbols(b).collect())) == {"core": "b.jar", "http": "http-1.2.jar", "http-1.2": "http-1.2.jar", "one": "svc1.jar", "two": "svc2.jar", "core-9": "core-9.jar"}
    e = graph.edges(b)
    assert rows(e.where("dst is null")) == [("svc1.jar", "lost", None)]
    every = graph.closure(e)
    starts = spark.createDataFrame([("svc1.jar",), ("svc2.jar",)], "src string")
    shared = graph.common(every, starts)
    assert rows(shared) == [("b.jar",), ("http-1.2.jar",)]
    assert rows(graph.extra(every, shared)) == [("svc2.jar", "svc1.jar")]


def test_orphans_know_folders_from_prefixes(spark):
    path = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    assert rows(reconcile.orphans(path("api/x.md", "api2/x.md", "a/b/c", "top.md", "z"), path("api", "a/b", "top.md"))) == [("api2/x.md",), ("z",)]
    assert reconcile.orphans(path(), path("a")).count() == 0


def test_mirror_and_flip(spark):
    f = lambda x: spark.createDataFrame(x, "path string, content_hash string")
    s, t = f([("a", "1"), ("b", "2"), ("n", None)]), f([("a", "1"), ("b", "3"), ("old", "1"), ("n", None)])
    assert rows(reconcile.mirror(s, t)) == [("b", "copy")]
    assert rows(reconcile.mirror(s, t, delete=True)) == [("b", "copy"), ("old", "delete")]
    m = spark.createDataFrame([("1", "files", 1), ("1", "files", 2), ("2", "files", 1), ("3", "files", 9)], "objectid string, objecttype string, systemtagid int")
    assert rows(reconcile.flipped(m, 1, 2), "objectid", "systemtagid") == [("1", 2), ("2", 2), ("3", 9)]


def test_tagged(spark):
    tags = spark.createDataFrame([(1, "in"), (2, "out")], "id int, name string")
    mapping = spark.createDataFrame([("10", 1), ("x", 1), ("11", 2), ("12", 1), (None, 1)], "objectid string, systemtagid int")
    files = spark.createDataFrame([(10, "d", 0), (11, "e", 1), (12, "f.md", 1)], "fileid bigint, path string, mimetype int")
    mimes = spark.createDataFrame([(0, "httpd/unix-directory"), (1, "text/plain")], "id int, mimetype string")
    assert rows(reconcile.tagged(tags, mapping, files, mimes, ["in"]), "path") == [("d",), ("f.md",)]
    assert rows(reconcile.tagged(tags, mapping, files, mimes, ["in"], folders=True), "path") == [("d",)]
    assert rows(reconcile.tagged(tags, mapping, files, mimes, ["in", "out"], folders=False), "path") == [("e",), ("f.md",)]


@pytest.mark.parametrize("n", [0, 3])
def test_first_and_last_of(spark, n):
    df = spark.createDataFrame([("k", i, f"v{i}") for i in range(n)], "k string, o int, v string")
    assert rows(graph.first_of(df, "k", "o"), "v") == ([("v0",)] if n else [])
    assert rows(graph.last_of(df, "k", "v", "o"), "v") == ([("v2",)] if n else [])


def test_listed(spark):
    s = spark.createDataFrame([("a", None, "ca"), ("b", "B", "cb")], "name string, description string, collection string")
    p = spark.createDataFrame([("b",), ("b",), ("other",)], "subject string")
    assert rows(sync.listed(s, p)) == [("a", "", "ca", 0, False), ("b", "B", "cb", 2, True)]
    assert F is not None
