"""From folders to answers: sources, converters, store, interfaces, streams."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusspark import cli, config
from corpusspark.http import answer
from corpusspark.operators import converters
from corpusspark.operators.store import Conflict, Store, retried
from corpusspark.plans.pipeline import Searcher, synced
from corpusspark.sources import files
from corpusspark.streaming.incremental import stream_latest, stream_points
from tests.conftest import rows


def _zip(entries):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return b.getvalue()


DOCX = '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Office title</w:t></w:r></w:p><w:p><w:r><w:t>zebra </w:t></w:r><w:r><w:t>stripes</w:t></w:r></w:p></w:body></w:document>'


@pytest.fixture
def corpus(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for p, t in {"x y/one.md": "# One\napple tree\n## Sub\nbanana split", "two.HTML": "<h1>Two</h1><p>cherry &amp; plum</p><script>no</script>", "skip.txt": "no", "draft/three.md": "draft text", "four.pdf": "%PDF"}.items():
        (a / p).parent.mkdir(parents=True, exist_ok=True)
        (a / p).write_text(t)
    b.mkdir()
    (b / "two.docx").write_bytes(_zip({"word/document.xml": DOCX}))
    (b / "one.md").write_text("apple pie")
    raw = {"store": f"file://{tmp_path}/store", "subjects": [{"name": "a", "dir": f"{a}", "exclude": ["draft/*"], "description": "Fruit"}, {"name": "b", "dir": f"{b}"}]}
    return raw, a, b


def test_sync_and_search(spark, corpus, capsys, tmp_path):
    raw, a, b = corpus
    cfg = config.from_dict(raw)
    stats = lambda: {r.subject: (r.new, r.changed, r.deleted, r.unchanged, r.chunks_embedded) for r in synced(spark, cfg).collect()}
    assert stats() == {"a": (3, 0, 0, 0, 3), "b": (2, 0, 0, 0, 2)}
    store = Store(spark, cfg.store)
    assert rows(store.manifest(), "subject", "doc_id", "chunk_count", "error") == [("a", "four.pdf", 0, "no decoder for .pdf"), ("a", "two.HTML", 1, None), ("a", "x y/one.md", 2, None), ("b", "one.md", 1, None), ("b", "two.docx", 1, None)]
    assert stats() == {"a": (0, 0, 0, 3, 0), "b": (0, 0, 0, 2, 0)} and store.versions() == [1]
    (a / "x y/one.md").write_text("# One\napple only")
    (b / "one.md").unlink()
    assert stats() == {"a": (0, 1, 0, 2, 1), "b": (0, 0, 1, 1, 0)}
    assert rows(store.points(), "subject", "chunk_id", "section_path", "text") == [("a", "two.HTML:0", "Two", "cherry & plum"), ("a", "x y/one.md:0", "One", "apple only"), ("b", "two.docx:0", "Office title", "zebra stripes")]
    fresh = Store(spark, f"file://{tmp_path}/fresh")
    synced(spark, config.from_dict(raw | {"store": fresh.path})).collect()
    assert rows(fresh.points().drop("version", "dense", "sparse")) == rows(store.points().drop("version", "dense", "sparse"))  # as if built at once
    before = rows(store.points().drop("dense", "sparse"))
    store.compact()
    assert rows(store.points().drop("dense", "sparse")) == before and len(store.head()["segments"]) == 1

    s = Searcher(spark, cfg)
    assert [(x["name"], x["points"], x["populated"]) for x in s.list_subjects()] == [("a", 2, True), ("b", 1, True)]
    found = s.search("ALL", "zebra", 1)
    assert found[0]["chunk_id"] == "two.docx:0" and found[0]["section"] == "Office title" and found[0]["score"] == 0.5
    assert s.search(["a", "a"], "apple")[0]["doc_id"] == "x y/one.md" and s.search([], "x") == [] and "Fruit" in s.instructions()

    ask = lambda body, path="/v1/search", method="POST", token="t", given="Bearer t": answer(s, method, path, body, token, given)
    assert ask(b"", "/healthz", "GET", "", None) == (200, {"status": "ok"})
    assert ask(b"", "/v1/subjects", "GET", "t", None)[0] == 401 and ask(b"", "/v1/subjects", "GET", "", "Bearer ")[0] == 401
    assert ask(b"", "/v1/subjects", "GET")[0] == 200 and ask(b"{", )[0] == 400 and ask(b"[1]")[0] == 400 and ask(b'{"subject": "a"}')[0] == 400
    assert ask(b'{"subject": "z", "query": "q"}')[0] == 404 and ask(b'{"subject": "a", "query": "q", "k": -1}')[0] == 400
    assert ask(b'{"subject": "a", "query": "cherry", "k": 1}')[1]["results"][0]["doc_id"] == "two.HTML"

    (tmp_path / "c.yaml").write_text(json.dumps(raw))
    capsys.readouterr()
    assert cli.main(["--config", str(tmp_path / "c.yaml"), "sync", "--subject", "all"], spark) == 0
    assert "[a] new=0 changed=0 deleted=0 unchanged=3 chunks_embedded=0" in capsys.readouterr().out


def test_missing_folder_does_not_delete_the_corpus(spark, corpus):
    raw, a, _ = corpus
    cfg = config.from_dict(raw)
    synced(spark, cfg).collect()
    os.rename(a, f"{a}-away")
    with pytest.raises(files.MissingFolder):
        synced(spark, cfg)
    assert Store(spark, cfg.store).manifest().count() == 5
    assert {r.subject: r.deleted for r in synced(spark, cfg, missing="empty").collect()} == {"a": 3, "b": 0}


def test_a_writer_that_lost_the_race_changes_nothing(spark, corpus):
    raw, _, _ = corpus
    cfg = config.from_dict(raw)
    synced(spark, cfg).collect()
    store = Store(spark, cfg.store)
    with pytest.raises(Conflict):
        store.commit(store.points().limit(0), store.manifest().limit(0), store.manifest(), parent=0)
    assert store.manifest().count() == 5 and store.versions() == [1]


def test_config_errors():
    with pytest.raises(ValueError):
        config.from_dict({"store": "x"})
    with pytest.raises(TypeError):
        config.from_dict({"store": "x", "subjects": [{"name": "a", "dir": "d"}], "chunk": {"overlp": 1}})
    cfg = config.from_dict({"store": "x", "subjects": [{"name": "a", "dir": "d"}]})
    with pytest.raises(KeyError, match="known: a"):
        cfg.subject("b")
    assert [s.name for s in cfg.resolve(" All ")] == ["a"]


def test_retries_wait_longer_and_give_up():
    waits = []

    def fails():
        raise OSError

    with pytest.raises(OSError):
        retried(fails, attempts=8, sleep=waits.append)
    assert waits == [2, 4, 8, 16, 32, 60, 60]


def test_query_file_and_listing(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("# comment\n\na\tfirst question\n b \t second\nno tab\n")
    assert rows(files.query_file(spark, str(tmp_path / "q.tsv"))) == [(None, "no tab"), ("a", "first question"), ("b", "second")]
    assert rows(files.listing(spark, str(tmp_path))) == [("q.tsv",)]


MANIFEST = "Manifest-Version: 1.0\r\nBundle-SymbolicName: svc.one;singleton:=true\r\nRequire-Bundle: core;bundle-version=\"1\",ht\r\n tp,lost\r\nImplementation-Title: One\r\n"


def test_archives_and_their_index(spark):
    jars = [("k/one.jar", _zip({"META-INF/MANIFEST.MF": MANIFEST, "com/acme/services/strong/part/X.class": ""})), ("k/core.jar", _zip({"META-INF/MANIFEST.MF": "Bundle-SymbolicName: core\n"})), ("k/http-4.5.jar", _zip({"a": ""})), ("k/bad.jar", b"nope")]
    b = files.archives(spark.createDataFrame(jars, "path string, content binary"))
    one = next(r for r in b.collect() if r.file == "one.jar")
    assert (one.sym, one.req, one.spkgs, one.title) == ("svc.one", ["core", "http", "lost"], ["com.acme.services.strong.part"], "One")
    page = converters.convert_bundles(b).first().markdown
    assert "- `core.jar`\n- `http-4.5.jar`" in page and "### one.jar\n_One_\n- provides: `com.acme.services.strong.part`\n- extra jars: _none beyond baseline_\n- unresolved bundles: `lost`" in page
    assert "| `com.acme.services.strong.part` | `one.jar` |" in page and converters.convert_bundles(b.limit(0)).count() == 0


DOXY = """<html><body><div class="headertitle"><div class="title">Foo Class</div></div><div class="contents"><div class="textblock">Uses <a class="el" href="x">Bar</a>.</div>
<h2 class="memtitle"><span>◆ </span>run()</h2><div class="memitem"><div class="memproto">int run(int&nbsp;n)</div><div class="memdoc"><p>Runs it.</p>
<dl class="params"><dt>Parameters</dt><dd><table class="params"><tr><td>n</td><td>how often</td></tr></table></dd></dl><dl><dt>Returns</dt><dd>a code</dd></dl>
<div class="fragment"><div class="line"><span class="lineno"> 1</span>run(<a class="el">Bar</a>);</div></div></div></div>
<h2 class="memtitle">bare()</h2><div class="memitem"><div class="memproto">bare</div></div></div>"""
MODERN = """<body class="class-declaration-page"><div class="header"><div class="sub-title">Package <a>com.acme</a></div></div><main><h1 class="title">Class Svc</h1><section class="class-description"><div class="type-signature">public class Svc</div><div class="block">A <a>service</a>.</div></section>
<section class="detail"><h3>get</h3><div class="member-signature">int get()</div><div class="block">Gets.</div><dl class="notes"><dt>Parameters:</dt><dd><code>a</code> - first</dd><dd><code>b</code> - </dd><dt>Returns:</dt><dd>it</dd><dt>See Also:</dt><dd>x</dd><dt>Deprecated</dt><dd>soon</dd></dl></section></main></body>"""
LEGACY = """<body><div class="subTitle"><a>com.old</a></div><h2 class="title">Interface Old</h2><div class="description"><pre>public interface Old</pre><div class="block">Olden.</div></div><div class="details"><ul><li><h4>go</h4><pre>void go()</pre><div class="block">Goes.</div><dl><dt>Throws:</dt><dd>E - bad</dd></dl><h4>stop</h4><pre>void stop()</pre></li></ul></div>"""
PACKAGE = """<body class="package-declaration-page"><main><h1 class="title">Package com.acme</h1><div class="block">All.</div><div class="summary-table"><div class="col-first"><a>Svc</a></div><div class="col-last">Serves</div><div class="col-first"><a>Two</a></div></div></main></body>"""
OLD_PACKAGE = """<body><h1 class="title">Package com.old</h1><table class="typeSummary"><tr><th class="colFirst">x</th></tr><tr><td class="colFirst"><a>Old</a></td><td class="colLast"><div class="block">Olden</div></td></tr></table>"""


def test_doxygen():
    assert converters.doxygen(DOXY) == "# Foo Class\n\nUses `Bar`.\n\n## run()\n\n```\nint run(int n)\n```\n\nRuns it.\n\n**Parameters**\n- **n** — how often\n\n**Returns** a code\n\n```\nrun(Bar);\n```\n\n## bare()\n"
    assert converters.doxygen("<html><title>x</title>") is None


def test_javadoc():
    assert converters.javadoc(MODERN) == "# com.acme.Svc\n\n```java\npublic class Svc\n```\n\nA service .\n\n## get\n\n```java\nint get()\n```\n\nGets.\n\n**Parameters**\n- `a` — first\n- `b`\n\n**Returns** it\n\n**Deprecated** soon\n"
    assert converters.javadoc(LEGACY) == "# com.old.Old\n\n```java\npublic interface Old\n```\n\nOlden.\n\n## go\n\n```java\nvoid go()\n```\n\nGoes.\n\n**Throws**\n- `E` — bad\n\n## stop\n\n```java\nvoid stop()\n```\n"
    assert converters.javadoc(PACKAGE) == "# Package com.acme\n\nAll.\n\n**Contents**\n- `Svc` — Serves\n- `Two`\n"
    assert converters.javadoc(OLD_PACKAGE) == "# Package com.old\n\n**Contents**\n- `Old` — Olden\n"  # a class's words are not the package's
    described = OLD_PACKAGE.replace("<table", "<div class='contentContainer'><div class='block'>All old.</div></div><table", 1)
    assert converters.javadoc(described) == "# Package com.old\n\nAll old.\n\n**Contents**\n- `Old` — Olden\n"
    assert converters.javadoc("<body><h2 class='title'>Index</h2>") is None and converters.javadoc("") is None


def test_page_frames(spark):
    pages = spark.createDataFrame([("b/class_foo.html", DOXY.encode()), ("index.html", DOXY.encode()), ("class_foo-members.html", DOXY.encode()), ("class_empty.html", b"\xff")], "path string, content binary")
    assert rows(converters.convert_doxygen(pages), "path", "error") == [("b/class_foo.md", None)]
    java = spark.createDataFrame([("m2/Svc.html", MODERN.encode()), ("m1/Svc.html", MODERN.encode()), ("m1/nav.html", b"<body></body>")], "path string, content binary")
    assert rows(converters.convert_javadoc(java), "path") == [("m1/Svc.md",)]
    assert converters.convert_javadoc(java.limit(0)).count() == 0
    assert rows(converters.conversion_counts(converters.javadoc_pages(java))) == [(1, 1, 1, 0)] and rows(converters.conversion_counts(converters.doxygen_pages(pages))) == [(1, 3, 0, 0)]
    assert rows(converters.conversion_counts(converters.doxygen_pages(pages.limit(0)))) == [(0, 0, 0, 0)]


WSDL = """<definitions xmlns="http://schemas.xmlsoap.org/wsdl/" xmlns:soap="http://schemas.xmlsoap.org/wsdl/soap/" xmlns:t="urn:acme.com/t" targetNamespace="urn:acme.com/t">
<types><schema xmlns="http://www.w3.org/2001/XMLSchema"><import schemaLocation="types.xsd"/></schema></types>
<message name="In"><part name="p" element="t:Ask"/></message><message name="Out"><part name="p" element="t:Gone"/></message>
<portType name="P"><operation name="find"><input message="t:In"/><output message="t:Out"/><fault name="F" message="t:X"/></operation><operation name="ping"/></portType>
<binding name="B"><operation name="find"><soap:operation soapAction="urn:find"/></operation></binding><service><port><soap:address location="http://h/s"/></port></service></definitions>"""
XSD = """<schema xmlns="http://www.w3.org/2001/XMLSchema"><element name="Ask" type="t:AskType"/><complexType name="AskType"><sequence><element name="id" type="int"/><element name="tag" minOccurs="0" maxOccurs="unbounded"/></sequence></complexType></schema>"""


def test_service_descriptions(spark):
    docs = spark.createDataFrame([("s/FindService.wsdl", WSDL.encode()), ("s/types.xsd", XSD.encode()), ("s/bad.wsdl", b"<x"), ("s/note.md", b"")], "path string, content binary")
    found = converters.convert_wsdl(docs, "acme.com").collect()
    assert [r.path for r in found] == ["s/FindService.md"]
    md = found[0].markdown
    assert md.startswith("# FindService\n") and "Target namespace `urn:acme.com/t`. Endpoint `http://h/s`." in md and "- `t` = `urn:acme.com/t`" in md
    assert "## find\n\n- soapAction: `urn:find`\n- request: `t:Ask`\n    - `id`: `int`\n    - `tag`: `(inline)` [0..unbounded]\n- response: `t:Gone`\n- faults: `F`" in md
    assert "## ping\n\n- request: _none_\n- response: _none_" in md and md.endswith("## Types\n\n### AskType\n- `id`: `int`\n- `tag`: `(inline)` [0..unbounded]\n")
    parts = spark.createDataFrame([("s", p["part"], p["name"], p["a"], p["b"], p["pos"]) for p in converters.service_parts(WSDL)], "service string, part string, name string, a string, b string, pos int")
    fields = spark.createDataFrame([("s", *(f[c] for c in ("owner", "kind", "ref", "pos", "name", "type", "low", "high"))) for f in converters.schema_fields(XSD)], "service string, owner string, kind string, ref string, pos int, name string, type string, low string, high string")
    assert rows(converters.message_fields(parts, fields), "operation", "direction", "element", "field", "occurs") == [("find", "request", "t:Ask", "id", ""), ("find", "request", "t:Ask", "tag", " [0..unbounded]"), ("find", "response", "t:Gone", None, None), ("ping", "request", None, None, None), ("ping", "response", None, None, None)]


KIND = "subject string, doc_id string, chunk_index bigint, chunk_id string, point_id string, source_path string, section_path string, content_hash string, last_updated string, text string"


def _put(spark, folder, data):
    made = [(s, d, i, f"{d}:{i}", None, None, None, h, None, t) for s, d, i, h, t in data]
    spark.createDataFrame(made, KIND).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, store, folder, checkpoint):
    from corpusspark.operators.encoding import encoded

    stream_points(spark.readStream.schema(KIND).parquet(folder), store, checkpoint, encoded).awaitTermination()


def test_stream_commits_each_batch_once(spark, tmp_path):
    store, at = Store(spark, f"file://{tmp_path}/store"), f"{tmp_path}/in"
    _put(spark, at, [("s", "a", 0, "1", "x"), ("s", "a", 1, "1", "y"), ("s", "b", 0, "1", "z")])
    _run(spark, store, at, f"{tmp_path}/cp")
    _put(spark, at, [("s", "a", 0, "2", "new")])
    _run(spark, store, at, f"{tmp_path}/cp")
    _run(spark, store, at, f"{tmp_path}/cp")
    assert rows(store.points(), "chunk_id", "text") == [("a:0", "new"), ("b:0", "z")] and store.versions() == [1, 2]
    from corpusspark.streaming.incremental import _committed, stream_id

    _committed(store, store.points().drop("version"), stream_id(store, f"{tmp_path}/cp"), 1)  # a replay of a committed batch
    assert store.versions() == [1, 2]


def test_streams_and_checkpoints_have_their_own_numbers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    _put(spark, f"{tmp_path}/one", [("s", "a", 0, "1", "x"), ("s", "a", 0, "1", "x")])
    _run(spark, store, f"{tmp_path}/one", f"{tmp_path}/cp1")
    _put(spark, f"{tmp_path}/two", [("s", "b", 0, "1", "y")])
    _run(spark, store, f"{tmp_path}/two", f"{tmp_path}/cp2")  # a second stream starts at 0 too
    _put(spark, f"{tmp_path}/three", [("s", "c", 0, "1", "z")])
    _run(spark, store, f"{tmp_path}/three", f"{tmp_path}/new-cp1")  # so does one after its checkpoint is gone
    assert rows(store.points(), "chunk_id") == [("a:0",), ("b:0",), ("c:0",)] and len(store.head()["batches"]) == 3


def test_a_document_may_come_in_several_batches(spark, tmp_path):
    store, at = Store(spark, f"file://{tmp_path}/store"), f"{tmp_path}/in"
    for data in ([("s", "a", 0, "1", "x"), ("s", "a", 1, "1", "y")], [("s", "a", 2, "1", "z"), ("s", "a", 1, "1", "y2")]):
        _put(spark, at, data)
        _run(spark, store, at, f"{tmp_path}/cp")
    assert rows(store.points(), "chunk_id", "text") == [("a:0", "x"), ("a:1", "y2"), ("a:2", "z")] and rows(store.manifest(), "chunk_count") == [(3,)]
    _put(spark, at, [("s", "a", 0, "2", "other")])
    _run(spark, store, at, f"{tmp_path}/cp")
    assert rows(store.points(), "chunk_id", "text") == [("a:0", "other")]


def test_store_keeps_deltas_and_removes_what_is_old(spark, tmp_path, monkeypatch):
    from corpusspark.operators import store as module
    from corpusspark.operators.encoding import encoded

    monkeypatch.setattr(module, "DELTAS", 3)
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.create(256, "scalar") and not store.create(256, "scalar")
    with pytest.raises(ValueError):
        store.create(128)
    with pytest.raises(ValueError):
        store.create(1, "other")
    docs = "subject string, doc_id string, source_path string, content_hash string, last_updated string, chunk_count bigint, error string"
    none = spark.createDataFrame([], "subject string, doc_id string")
    for i in range(6):
        points = encoded(spark.createDataFrame([("s", f"d{i % 4}", 0, f"d{i % 4}:0", None, None, None, str(i), None, f"text {i}")], KIND))
        gone = none if i != 5 else spark.createDataFrame([("s", "d3"), ("s", "d3"), ("s", "never")], "subject string, doc_id string")
        store.commit(points, spark.createDataFrame([("s", f"d{i % 4}", None, str(i), None, 1, None)], docs), gone)
    assert rows(store.manifest(), "doc_id", "content_hash") == [("d0", "4"), ("d1", "5"), ("d2", "2")] and len(store.head()["manifests"]) == 3
    assert rows(store.points(), "doc_id", "text") == [("d0", "text 4"), ("d1", "text 5"), ("d2", "text 2")]
    assert all(x == int(x) and abs(x) <= 127 for r in store.points().collect() for x in r.dense) and rows(store.sample(1), "chunk_id") == [("d0:0",)]
    with pytest.raises(Exception, match="has not 256 dimensions"):
        store.commit(points.withColumn("dense", F.slice("dense", 1, 3)), spark.createDataFrame([], docs), none)
    store.compact()
    before = rows(store.points(), "doc_id", "text")
    assert store.vacuum() > 5 and rows(store.points(), "doc_id", "text") == before and store.vacuum() == 0
    other = Store(spark, f"file://{tmp_path}/other")
    module.reencode(store, other, "tests.plugins:FirstLetters")
    module.reencode(store, other, "tests.plugins:FirstLetters", fresh=True, limit=1)
    assert [(r.doc_id, len(r.dense)) for r in other.points().collect()] == [("d0", 26)]


def test_a_run_that_died_is_taken_up_without_decoding(spark, corpus, monkeypatch, capsys, tmp_path):
    from corpusspark.plans import pipeline

    raw, a, _ = corpus
    cfg = config.from_dict(raw)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(pipeline, "made_points", dies)
        with pytest.raises(RuntimeError):
            synced(spark, cfg)
    store = Store(spark, cfg.store)
    assert store.versions() == [] and len(store.staged()) == 1
    with monkeypatch.context() as m:
        m.setattr(pipeline, "decoded", dies)  # nothing is decoded again
        (tmp_path / "c.yaml").write_text(json.dumps(raw))
        assert cli.main(["--config", str(tmp_path / "c.yaml"), "drain"], spark) == 0 and "drained=1" in capsys.readouterr().out
        assert {r.subject: r.unchanged for r in synced(spark, cfg).collect()} == {"a": 3, "b": 2}
    assert store.staged() == [] and store.points().count() == 5
    (a / "two.HTML").unlink()
    with monkeypatch.context() as m:
        m.setattr(pipeline, "made_points", dies)
        with pytest.raises(RuntimeError):
            synced(spark, cfg)
    store.compact()  # another version: what was staged is classified anew
    assert {r.subject: r.deleted for r in synced(spark, cfg).collect()} == {"a": 1, "b": 0} and store.staged() == []
    waits = []

    def stop(seconds):
        waits.append(seconds)
        if len(waits) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        cli.main(["--config", str(tmp_path / "c.yaml"), "sync", "--subject", "a", "--every", "7"], spark, stop)
    assert waits == [7, 7]


def test_scratch_removes_its_tables(spark):
    from corpusspark.tables import new_path, scratch, written

    with scratch(spark):
        path = written(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
        with scratch(spark):
            inner = written(spark.range(3), "y").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and not os.path.exists(inner)
    assert not os.path.exists(path) and new_path(spark, "z")


def test_trees_are_written_copied_and_pruned(spark, tmp_path):
    from corpusspark.operators import reconcile
    from corpusspark.sources import trees

    pages = spark.createDataFrame([("a/b c.md", "# é"), ("x.md", None), ("../evil.md", "no"), ("d.md", "d")], "path string, markdown string")
    found = rows(trees.write_tree(pages, f"file://{tmp_path}/out"), "path", "done")
    assert found == [("../evil.md", False), ("a/b c.md", True), ("d.md", True)] and (tmp_path / "out" / "a" / "b c.md").read_text() == "# é"
    new, old = ({n: h for n, h in x} for x in ([("a/b c.md", "1"), ("d.md", "2")], [("d.md", "1"), ("old/e.md", "1")]))
    (tmp_path / "to" / "old").mkdir(parents=True)
    for n in old:
        (tmp_path / "to" / n).write_text("old")
    frame = lambda x: spark.createDataFrame(list(x.items()), "path string, content_hash string")
    actions = reconcile.mirror(frame(new), frame(old), delete=True)
    assert rows(trees.apply_mirror(actions, f"file://{tmp_path}/out", f"{tmp_path}/to"), "path", "done") == [("a/b c.md", True), ("d.md", True), ("old/e.md", True)]
    assert sorted(str(p.relative_to(tmp_path / "to")) for p in (tmp_path / "to").rglob("*") if p.is_file()) == ["a/b c.md", "d.md"] and (tmp_path / "to" / "d.md").read_text() == "d"
    gone = reconcile.orphans(frame(new), frame({"a": ""}).select("path"))
    assert rows(trees.prune(gone, f"{tmp_path}/to"), "path", "done") == [("d.md", False)] and (tmp_path / "to" / "d.md").exists()
    assert rows(trees.prune(gone, f"{tmp_path}/to", apply=True), "path", "done") == [("d.md", True)] and not (tmp_path / "to" / "d.md").exists()
    assert rows(reconcile.orphan_counts(frame(new).select("path"), frame({"a": ""}).select("path"))) == [(2, 1, 1)]


def test_tags_are_counted_and_found(spark):
    from corpusspark.operators import reconcile, sync

    tags = spark.createDataFrame([(3, "x"), (2, "x"), (5, "none"), (6, None)], "id int, name string")
    mapping = spark.createDataFrame([("1", "files", 2), ("1", "files", 2), ("2", "files", 3), ("3", "files", 9)], "objectid string, objecttype string, systemtagid int")
    assert rows(reconcile.tag_counts(tags, mapping)) == [(None, 0), ("none", 0), ("x", 2)]
    assert reconcile.tag_id(tags, "x") == 2 and reconcile.tag_id(tags, "y") is None
    stats = spark.createDataFrame([("a", True), ("b", False)], "subject string, is_noop boolean")
    assert [sync.all_noop(x).first()[0] for x in (stats, stats.where("is_noop"), stats.limit(0))] == [False, True, True]


def test_tables_of_office_files_and_of_tags(spark, tmp_path):
    from corpusspark.operators import reconcile

    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    xml = f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Before</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("b|c")}</w:tr><w:tr>{cell("1")}{cell("")}</w:tr></w:tbl><w:p/></w:body></w:document>'
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sld>'
    docs = spark.createDataFrame([("s", "x.docx", _zip({"word/document.xml": xml})), ("s", "y.pptx", _zip({f"ppt/slides/slide{i}.xml": slide(f"slide {i}") for i in (10, 2)})), ("s", "z.docx", b"no")], "subject string, doc_id string, content binary")
    found = {r.doc_id: (r.text, r.error) for r in files.decoded(docs).collect()}
    assert found["x.docx"][0] == "Before\n| a | b\\|c |\n| --- | --- |\n| 1 |  |" and found["y.pptx"][0] == "slide 2\nslide 10" and found["z.docx"][0] is None and "BadZipFile" in found["z.docx"][1]
    put = lambda name, data, kind: spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    put("oc_systemtag", [(1, "keep", "x"), (2, "drop", "x")], "id bigint, name string, other string")
    put("oc_systemtag_object_mapping", [("7", "files", 1), ("8", "files", 2), ("no", "files", 1)], "objectid string, objecttype string, systemtagid bigint")
    put("oc_filecache", [(7, "a.md", 1), (8, "b.md", 1)], "fileid bigint, path string, mimetype bigint")
    put("oc_mimetypes", [(1, "text/markdown")], "id bigint, mimetype string")
    assert rows(reconcile.tagged(**files.tag_tables(spark, str(tmp_path)), names=["keep"])) == [("a.md", "text/markdown")]


def test_model_context_protocol(spark, corpus):
    raw, _, _ = corpus
    cfg = config.from_dict(raw)
    synced(spark, cfg)
    s = Searcher(spark, cfg)
    ask = lambda m, **p: answer(s, "POST", "/mcp", json.dumps({"jsonrpc": "2.0", "id": 7, "method": m, "params": p}).encode(), "t", "Bearer t")
    assert answer(s, "POST", "/mcp", b"{}", "t", None)[0] == 401 and answer(s, "POST", "/mcp", b"{", "t", "Bearer t")[0] == 400
    hello = ask("initialize", protocolVersion="2025-03-26")[1]
    assert hello["id"] == 7 and hello["result"]["protocolVersion"] == "2025-03-26" and "Fruit" in hello["result"]["instructions"]
    assert [t["name"] for t in ask("tools/list")[1]["result"]["tools"]] == ["list_subjects", "search"] and ask("ping")[1]["result"] == {}
    found = ask("tools/call", name="search", arguments={"subject": "all", "query": "zebra", "k": 1})[1]["result"]
    assert json.loads(found["content"][0]["text"])[0]["chunk_id"] == "two.docx:0" and not found["isError"]
    assert len(json.loads(ask("tools/call", name="list_subjects")[1]["result"]["content"][0]["text"])) == 2
    assert ask("tools/call", name="search", arguments={"subject": "z", "query": "q"})[1]["result"]["isError"]
    assert ask("tools/call", name="search", arguments={})[1]["error"]["code"] == -32602 and ask("other")[1]["error"]["code"] == -32601
    assert answer(s, "POST", "/mcp", b'{"jsonrpc": "2.0", "method": "notifications/initialized"}', "t", "Bearer t") == (202, None)
    assert [r["id"] for r in answer(s, "POST", "/mcp", b'[{"id": 1, "method": "ping"}, {"id": 2, "method": "ping"}]', "t", "Bearer t")[1]] == [1, 2]


def test_files_of_deployments_are_taken():
    cfg = config.from_dict({
        "embedding_model": "m", "embedding_dim": 8, "onnx_model_dir": "/models/e", "embedding_int8": False, "chunk": {"target_tokens": 100, "overlap": 9}, "qdrant": {"host": "h", "quantization": "scalar"},
        "manifest_path": "/data/state/manifest.sqlite", "rerank": {"enabled": True, "model_dir": "/models/r", "top_n": 20}, "server": {"port": 1, "default_k": 4, "prefetch_limit": 9}, "subjects": [{"name": "a", "dir": "d", "collection": "c"}],
    })
    assert (cfg.store, cfg.encoder, cfg.encoder_options, cfg.dim, cfg.quantization) == ("/data/state/manifest", "onnx", {"folder": "/models/e", "int8": False}, 8, "scalar")
    assert (cfg.chunk.max_tokens, cfg.search.default_k, cfg.search.prefetch, cfg.search.top_n, cfg.search.reranker, cfg.search.reranker_options, cfg.server.port) == (100, 4, 9, 20, "onnx", {"folder": "/models/r"}, 1)


def test_stream_deduplicates(spark, tmp_path):
    kind = "subject string, doc_id string, content_hash string, loaded_at timestamp_ntz"
    spark.range(6).select(F.lit("s").alias("subject"), (F.col("id") % 3).cast("string").alias("doc_id"), F.lit("h").alias("content_hash"), F.lit("2024-01-01").cast("timestamp_ntz").alias("loaded_at")).write.parquet(f"{tmp_path}/in")
    q = stream_latest(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "doc_id") == [("0",), ("1",), ("2",)]
