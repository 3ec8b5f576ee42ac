"""Sources: document trees, page trees, archives, query files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.functions.scalars import content_hash, included, iso_utc, relative, required_bundles, suffix
from corpusspark.functions.trees import parsed, tidy

#: Fixed value: suffixes of documents that can be ingested.
SUFFIXES = [".docx", ".htm", ".html", ".md", ".pdf", ".pptx"]


class MissingFolder(ValueError):
    """A configured folder is not there; taking it as empty would delete its whole corpus."""


def _exists(spark: SparkSession, path: str) -> bool:
    from corpusspark.tables import _fs

    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def scanned(spark: SparkSession, subjects: list[dict], suffixes: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, missing: str = "fail", content: bool = True) -> DataFrame:
    """(subject, doc_id, source_path, content_hash, last_updated, content) of the documents below each subject's folder.

    subjects: name, dir, include, exclude. Suffixes are compared without case; patterns of both levels
    are united, exclusion wins. missing: `fail` refuses a folder that is not there, `empty` reads it as
    empty. Without content only paths are listed: the files are not read.
    """
    found = None
    for s in subjects:
        if not _exists(spark, s["dir"]):
            if missing == "fail":
                raise MissingFolder(s["dir"])
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(s["dir"])
        path = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^file:/*", "/")
        lit = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
        one = files.select(F.lit(s["name"]).alias("subject"), path.alias("source_path"), "modificationTime", *(["content"] if content else [])).withColumn("doc_id", relative(F.col("source_path"), F.lit(re.sub("^file:/*", "/", s["dir"]).rstrip("/"))))
        one = one.where(suffix(F.col("source_path")).isin([x.lower() for x in suffixes or SUFFIXES])).where(included(F.col("doc_id"), F.array_union(lit(include or []), lit(s.get("include") or [])), F.array_union(lit(exclude or []), lit(s.get("exclude") or []))))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "subject string, doc_id string, source_path string, content_hash string, last_updated string" + (", content binary" if content else ""))
    digest = [content_hash(F.col("content")).alias("content_hash")] if content else [F.lit(None).cast("string").alias("content_hash")]
    return found.select("subject", "doc_id", "source_path", *digest, iso_utc(F.col("modificationTime")).alias("last_updated"), *(["content"] if content else []))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of every file below a folder, relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("p"))
    return files.select(relative(F.col("p"), F.lit(re.sub("^file:/*", "/", folder).rstrip("/"))).alias("path"))


def pages(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(path, content) of the files below a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(relative(F.regexp_replace("path", "^file:/*", "/"), F.lit(re.sub("^file:/*", "/", folder).rstrip("/"))).alias("path"), "content")


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """(subject, query) of a file of tab-separated lines; blank lines and # comments are skipped; without a tab the subject is null."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parts = F.split("value", "\t", 2)
    return rows.select(F.when(F.size(parts) > 1, F.trim(parts[0])).alias("subject"), F.trim(F.when(F.size(parts) > 1, F.get(parts, 1)).otherwise(F.col("value"))).alias("query"))


def _manifest(text: str) -> dict[str, str]:
    """Headers of an archive's manifest; a line that starts with a space goes on with the one before."""
    whole = re.sub(r"\r\n?", "\n", text).replace("\n ", "")
    return {k.strip(): v.strip() for k, colon, v in (line.partition(":") for line in whole.split("\n")) if colon}


def archives(jars: DataFrame) -> DataFrame:
    """(file, sym, require, spkgs, title, req) of archives (path, content); what is no archive has empty fields.

    spkgs: service packages, from entries like `<root>/services/<strong or loose>/<domain>/...`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head: dict[str, str] = {}
                packages: set[str] = set()
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for n in z.namelist():
                            parts = PurePosixPath(n).parts
                            if "services" in parts[2:3] and len(parts) > 5 and parts[0] == "com" and parts[3] in ("strong", "loose"):
                                packages.add(".".join(parts[:5]))
                        if "META-INF/MANIFEST.MF" in z.namelist():
                            head = _manifest(z.read("META-INF/MANIFEST.MF").decode("utf-8", "replace"))
                except zipfile.BadZipFile:
                    pass
                rows.append((path.rpartition("/")[2], head.get("Bundle-SymbolicName", "").split(";")[0].strip(), head.get("Require-Bundle", ""), sorted(packages), head.get("Implementation-Title", "")))
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "sym", "require", "spkgs", "title"])

    return jars.select("path", "content").mapInArrow(run, "file string, sym string, require string, spkgs array<string>, title string").withColumn("req", required_bundles(F.col("require")))


def _html(b: bytes) -> str:
    """An HTML page as Markdown: headings, paragraphs and list items, one a line."""
    out = []
    for n in parsed(b.decode("utf-8", "replace")).walk():
        if n.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            out.append("\n" + "#" * int(n.name[1]) + " " + n.text() + "\n")
        elif n.name in ("p", "li", "pre", "td", "th", "dd", "dt", "blockquote"):
            inner = any(x.name in ("p", "li", "pre", "td", "dd") for x in n.walk())
            if not inner and (t := n.raw().strip("\n") if n.name == "pre" else n.text()):
                out.append(f"- {t}" if n.name == "li" else t)
    return "\n".join(out).strip()


def _office(b: bytes, parts: str) -> str:
    """Paragraphs, and tables as rows of cells, of an office document, from the XML in its archive."""
    from xml.etree import ElementTree

    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    said = lambda e: tidy("".join(x.text or "" for x in e.iter() if local(x) == "t"))
    out: list[str] = []

    def walk(e) -> None:
        kind = local(e)
        if kind == "tbl":
            rows = [[said(c).replace("|", "\\|") for c in r if local(c) == "tc"] for r in e if local(r) == "tr"]
            lines = [f"| {' | '.join(r)} |" for r in rows if any(r)]
            out.extend([*lines[:1], *(["|" + " --- |" * len(rows[0])] if lines else []), *lines[1:]])
        elif kind == "p":
            style = next((v for x in e.iter() for k, v in x.attrib.items() if local(x) == "pStyle" and k.rpartition("}")[2] == "val"), "")
            level = re.fullmatch(r"Heading([1-6])", style)
            if line := said(e):
                out.append("#" * int(level.group(1)) + " " + line if level else line)
        else:
            for x in e:
                walk(x)

    with zipfile.ZipFile(io.BytesIO(b)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(parts, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
        for name in names:
            walk(ElementTree.fromstring(z.read(name)))
    return "\n".join(out)


def _docx(b: bytes) -> str:
    return _office(b, r"word/document\.xml")


def _pptx(b: bytes) -> str:
    return _office(b, r"ppt/slides/slide\d+\.xml")


#: Decoders by suffix; a caller may add others, as for PDF, which has none here.
DECODERS = {".md": lambda b: b.decode("utf-8", "replace"), ".html": _html, ".htm": _html, ".docx": _docx, ".pptx": _pptx}


def decoded(docs: DataFrame, decoders: dict | None = None) -> DataFrame:
    """docs with text and error in place of content: no document is dropped in silence.

    docs: subject, doc_id, content. A suffix without decoder, and a document that its decoder rejects,
    give null text and the reason.
    """
    by = DECODERS | (decoders or {})
    cols = [c for c in docs.columns if c != "content"]
    at = {c: i for i, c in enumerate([*cols, "content"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for doc, content in zip(batch.column(at["doc_id"]).to_pylist(), batch.column(at["content"]).to_pylist(), strict=True):
                text = error = None
                kind = PurePosixPath(doc or "").suffix.lower()
                if kind not in by:
                    error = f"no decoder for {kind or 'files without suffix'}"
                else:
                    try:
                        text = by[kind](content or b"")
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*cols, "text", "error"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return docs.select(*cols, "content").mapInArrow(run, f"{fields}, text string, error string")


# Tables of a file server that say which objects have which tags, and the columns that are read.
TAG_TABLES = {"tags": ("oc_systemtag", ["id", "name"]), "mapping": ("oc_systemtag_object_mapping", ["objectid", "objecttype", "systemtagid"]), "files": ("oc_filecache", ["fileid", "path", "mimetype"]), "mimes": ("oc_mimetypes", ["id", "mimetype"])}


def tag_tables(spark: SparkSession, place: str, **options: str) -> dict[str, DataFrame]:
    """The frames tags, mapping, files and mimes that reconcile.tagged() takes: from a database, if place is a JDBC URL, else from Parquet in a folder.

    options: of the JDBC reader (user, password, driver, and a partitionColumn with its bounds for large
    tables). Only the columns needed are read.
    """
    if place.startswith("jdbc:"):
        read = lambda name: spark.read.format("jdbc").options(url=place, dbtable=name, **options).load()
    else:
        read = lambda name: spark.read.parquet(f"{place}/{name}.parquet")
    return {k: read(name).select(*columns) for k, (name, columns) in TAG_TABLES.items()}
