"""Splitting oversized items at natural boundaries, by byte ranges with halos.

Items are stretches of files. A worker reads one range of bytes with a halo at either side and finds
all the boundaries in it; no worker loads a whole item. At the start of every range but the first there
is a cut at the first of the strongest boundaries there; the worker of the range before sees the same
characters in its halo and so finds the same cut. Between two such cuts pieces are cut one after the
other. Boundary tables of the ranges are then stitched: prefix sums over their lengths give the pieces'
offsets and numbers, and workers read the ranges again to emit the pieces by offset. Texts that come in a table
are put into files first, many in one.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.sources.trees import file_system
from corpusspark.tables import new_path, written

LIMIT, OVERLAP = 2000, 200
#: Bytes in one range.
RANGE = 65_536
#: Bytes of texts in one file, if they come in a table.
FILE_BYTES = 1 << 28
#: Boundaries by strength: blank line, line end, sentence end, separator, white space. A match ends
#: at the boundary and depends on few characters around it, so a halo shows it as the whole text does.
BOUNDARIES = [
    re.compile(r"\n\r?\n(?![\r\n])"),
    re.compile(r"\n(?![\r\n])"),
    re.compile(r"[.!?…][)\"'”’\]]?\s{1,4}(?!\s)|[。！？]"),
    re.compile(r"[;,|](?!\s)"),
    re.compile(r"\s(?!\s)"),
]
CONTEXT = 16
#: A range: its item's place in a file, in bytes, and its number in the item.
_RANGE = "item string, path string, offset bigint, bytes bigint, range_no bigint"
_TABLE = f"{_RANGE}, size int, n int, starts array<int>, ends array<int>"


def _glued(t: str, p: int) -> bool:
    """Whether a cut at p would part what belongs together: CR LF, a mark from its letter, a joined emoji."""
    if not 0 < p < len(t):
        return False
    a, b = t[p - 1], t[p]
    return (a == "\r" and b == "\n") or a == "‍" or b == "‍" or "︀" <= b <= "️" or bool(unicodedata.combining(b))


def _hard(t: str, p: int, least: int) -> int:
    q = p
    while q > least and _glued(t, q):
        q -= 1
    return q if q > least else p


def _last(t: str, low: int, high: int) -> int | None:
    """The last of the strongest boundaries in (low, high]."""
    for kind in BOUNDARIES:
        found = None
        for m in kind.finditer(t, max(0, low - CONTEXT), min(len(t), high + CONTEXT)):
            if low < m.end() <= high:
                found = m.end()
        if found is not None:
            return found
    return None


def _first(t: str, low: int, high: int) -> int | None:
    """The first of the strongest boundaries in [low, high]."""
    for kind in BOUNDARIES:
        for m in kind.finditer(t, max(0, low - CONTEXT), min(len(t), high + CONTEXT)):
            if low <= m.end() <= high:
                return m.end()
    return None


def cut_range(t: str, at: int, size: int, more: bool, first: bool, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) in t of the pieces of the range t[at : at + size]; what surrounds it is halo.

    more: the item goes on after the range. A piece has at most `limit` characters, those it repeats
    included. It ends at the strongest boundary in the second half of what it may hold, the last of
    several; if there is none there, in the first half; only if there is none at all, at the limit,
    but not within a character with its marks. It starts at the first boundary in the last `overlap`
    characters of the piece before, or exactly `overlap` characters back if there is none.
    """
    half = limit // 2
    cut = lambda p: p if (q := _first(t, p, min(len(t), p + half))) is None else q
    start = at if first else cut(at)
    stop = cut(at + size) if more else at + size
    pieces: list[tuple[int, int]] = []
    end = start
    while end < stop:
        begin = end
        if pieces or not first:
            low = max(0, end - overlap)
            back = _first(t, low, end - 1) if overlap else None
            begin = back if back is not None else _hard(t, low, max(0, low - CONTEXT)) if overlap else end
            begin = begin if end - overlap <= begin <= end else low
        if stop - begin <= limit:
            nxt = stop
        else:
            top = begin + limit
            nxt = _last(t, max(end, begin + half), top) or _last(t, end, begin + half) or _hard(t, top, end)
        pieces.append((begin, nxt))
        end = nxt
    return pieces


def spooled(items: DataFrame) -> DataFrame:
    """items (item, text, ...) with path, offset and bytes in place of text, as a written table: texts in files, many in one.

    Every task attempt writes files of its own, and the table names those of the attempts that counted. The
    folder is on the file system that executors share, reached by its URI.
    """
    folder = new_path(items.sparkSession, "p4-texts")
    cols = [c for c in items.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                paths, offsets, sizes = [], [], []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = uuid.uuid4().hex, 0
                        out = fs.open_output_stream(f"{base}/{name}")
                    out.write(text or b"")
                    paths.append(f"{folder}/{name}")
                    offsets.append(at)
                    sizes.append(len(text or b""))
                    at += sizes[-1]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(paths, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=[*cols, "path", "offset", "bytes"])
        finally:
            if out is not None:
                out.close()

    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in cols)
    return written(items.select(*cols, "text").mapInArrow(run, f"{kinds}, path string, offset bigint, bytes bigint"), "p4-items")


def _reader(size: int, limit: int, overlap: int):
    """A function that reads a range (path, offset, bytes, range_no) with its halos: (text, at, size, more).

    The range is text[at : at + size]. It starts and ends at the first character that starts at or after
    its bytes; what is not UTF-8 is replaced. One file is open at a time.
    """
    left, right = 4 * (overlap + 2 * CONTEXT), 4 * (limit // 2 + 2 * CONTEXT)
    held: dict = {"path": None, "file": None}

    def starts(b: bytes, p: int) -> int:
        while p < len(b) and b[p] & 0xC0 == 0x80:
            p += 1
        return min(p, len(b))

    def read(path: str, offset: int, total: int, range_no: int) -> tuple[str, int, int, bool]:
        if held["path"] != path:
            if held["file"] is not None:
                held["file"].close()
            fs, at = file_system(path)
            held.update(path=path, file=fs.open_input_file(at))
        low, high = range_no * size, min(total, (range_no + 1) * size)
        seek, stop = max(0, low - left), min(total, high + right)
        b = held["file"].read_at(stop - seek, offset + seek)
        a, e = starts(b, low - seek), starts(b, high - seek)
        before, body = b[starts(b, 0) : a].decode(errors="replace"), b[a:e].decode(errors="replace")
        after = b[e:] if high < total else b""
        if stop < total:  # the last character may be cut off
            while after and after[-1] & 0xC0 == 0x80:
                after = after[:-1]
            after = after[:-1] if after and after[-1] & 0x80 else after
        return before + body + after.decode(errors="replace"), len(before), len(body), high < total

    return read


def item_ranges(items: DataFrame, size: int = RANGE) -> DataFrame:
    """(item, path, offset, bytes, range_no) of each range of the items (item, path, offset, bytes), spread over tasks by file and place."""
    spread = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / size).cast("bigint"))
    ranges = items.where("bytes > 0").select("item", "path", "offset", "bytes", F.explode(spread).alias("range_no"))
    return ranges.repartition("path", F.floor((F.col("offset") + F.col("range_no") * size) / (64 * size))).sortWithinPartitions("path", "offset", "range_no")


def boundary_tables(ranges: DataFrame, size: int = RANGE, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """ranges with size, n, starts and ends: each range's characters, and its pieces, placed in what its worker read."""
    schema = pa.schema([("item", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("range_no", pa.int64()), ("size", pa.int32()), ("n", pa.int32()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(size, limit, overlap)
        for batch in batches:
            cuts, sizes = [], []
            for r in batch.to_pylist():
                text, at, own, more = read(r["path"], r["offset"], r["bytes"], r["range_no"])
                cuts.append(cut_range(text, at, own, more, r["range_no"] == 0, limit, overlap))
                cuts[-1] = [(a - at, e - at) for a, e in cuts[-1]]
                sizes.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array([len(c) for c in cuts], pa.int32()), *(pa.array([[p[i] for p in c] for c in cuts], pa.list_(pa.int32())) for i in (0, 1))], schema=schema)

    return ranges.mapInArrow(find, _TABLE)


def stitched(tables: DataFrame) -> DataFrame:
    """The boundary tables with piece_0 and chars_0: pieces and characters of the item before each range."""
    before = Window.partitionBy("item").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    return tables.withColumn("piece_0", total("n")).withColumn("chars_0", total("size"))


def emitted(tables: DataFrame, size: int = RANGE, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item, piece_no, start, end, piece): every piece, with its place in the whole item, in characters from 0.

    Only offsets are shuffled; the ranges' bytes are read again where the pieces are made.
    """
    kinds = [("item", pa.string()), ("piece_no", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("piece", pa.string())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(size, limit, overlap)
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                out: list[tuple] = []
                for r in whole.slice(i, 64).to_pylist():
                    text, at, _, _ = read(r["path"], r["offset"], r["bytes"], r["range_no"])
                    out += [(r["item"], r["piece_0"] + k, r["chars_0"] + a, r["chars_0"] + e, text[at + a : at + e]) for k, (a, e) in enumerate(zip(r["starts"], r["ends"], strict=True))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

    return stitched(tables).where("n > 0").mapInArrow(cut, "item string, piece_no bigint, start bigint, end bigint, piece string")


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows with more than limit characters of text, one for each chunk_id, with its columns and `item`.

    A chunk staged again counts once: the row with the latest staged_at (null is earliest, ties go to
    the greatest text). Rows without chunk_id are told apart by all their other values.
    """
    cols = ["chunk_id", "doc_id", "subject", "section_path", "text"]
    item = F.coalesce(F.concat(F.lit("="), F.col("chunk_id")), F.sha2(F.to_json(F.struct(*cols)), 256))
    return (
        chunks.where(F.length("text") > limit)
        .select(item.alias("item"), F.struct("staged_at", "text", "chunk_id", "doc_id", "subject", "section_path").alias("r"))
        .groupBy("item")
        .agg(F.max("r").alias("r"))
        .select("item", *[F.col(f"r.{c}").alias(c) for c in cols])
    )


def oversized_tables(chunks: DataFrame, size: int = RANGE, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(items, tables): the oversized texts, put into files, and their boundary tables."""
    items = spooled(oversized(chunks, limit))
    return items, written(boundary_tables(item_ranges(items, size), size, limit, overlap), "p4-tables")


def split_chunks(chunks: DataFrame, size: int = RANGE, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, doc_id, subject, section_path, chunk_index, start, end, text): the pieces of oversized texts.

    chunk_index runs from 0 within a chunk_id; start and end are places in its text, in characters.
    Null, empty and short texts have no pieces; an empty table gives none. See oversized() for chunks
    staged again and cut_range() for where pieces end.
    """
    items, tables = oversized_tables(chunks, size, limit, overlap)
    pieces = emitted(tables, size, limit, overlap)
    return pieces.join(items.drop("path", "offset", "bytes"), "item").select("chunk_id", "doc_id", "subject", "section_path", F.col("piece_no").alias("chunk_index"), "start", "end", F.col("piece").alias("text"))


def split_files(spark: SparkSession, files: list[tuple[str, int]], size: int = RANGE, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item, piece_no, start, end, piece) of UTF-8 files (path or URI, bytes); item is the path. Empty files have no pieces."""
    items = spark.createDataFrame([(p, p, 0, n) for p, n in files], "item string, path string, offset bigint, bytes bigint")
    return emitted(written(boundary_tables(item_ranges(items, size), size, limit, overlap), "p4-files"), size, limit, overlap)
