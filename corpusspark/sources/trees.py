"""Writing and keeping folder trees: converted pages, copies, removals. Files are reached by path or URI from the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, local or remote, and the path on it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _inside(path: str | None) -> str:
    """A relative path that stays in its tree; others are an error."""
    parts = PurePosixPath(path or "").parts
    if not parts or parts[0] == "/" or ".." in parts:
        raise ValueError(f"no path in a tree: {path!r}")
    return "/".join(parts)


def _each(rows: DataFrame, columns: list[str], act: Callable[..., str | None]) -> DataFrame:
    """(path, done, error) of an action on every row: one that fails stops no other. Actions run when the frame is read; they may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    act(*row)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e is None for e in errors]), pa.array(errors, pa.string())], names=["path", "done", "error"])

    return rows.select(*columns).mapInArrow(run, "path string, done boolean, error string")


def _put(fs: pafs.FileSystem, path: str, body: bytes) -> None:
    """Writes beside the place and moves there, so that a reader sees the old file or the new one."""
    import uuid

    fs.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as out:
        out.write(body)
    fs.move(tmp, path)


def write_tree(pages: DataFrame, folder: str) -> DataFrame:
    """(path, done, error): writes markdown of pages (path, markdown) below folder, at the same relative paths; rows without markdown are left out."""

    def act(path: str, markdown: str) -> None:
        fs, base = file_system(folder)
        _put(fs, f"{base}/{_inside(path)}", markdown.encode())

    return _each(pages.where(F.col("markdown").isNotNull()), ["path", "markdown"], act)


def apply_mirror(actions: DataFrame, source: str, target: str) -> DataFrame:
    """(path, done, error): carries out mirror()'s actions (path, action): copies from source, deletes in target; a file that is gone already is deleted."""

    def act(path: str, action: str) -> None:
        fs, base = file_system(target)
        at = f"{base}/{_inside(path)}"
        if action == "delete":
            if fs.get_file_info(at).type != pafs.FileType.NotFound:
                fs.delete_file(at)
            return
        own, root = file_system(source)
        with own.open_input_stream(f"{root}/{_inside(path)}") as f:
            _put(fs, at, f.read())

    return _each(actions, ["path", "action"], act)


def prune(paths: DataFrame, target: str, apply: bool = False) -> DataFrame:
    """(path, done, error): the orphans that are (apply) or would be deleted below target; without apply nothing is touched and done is false."""
    if not apply:
        return paths.select("path", F.lit(False).alias("done"), F.lit(None).cast("string").alias("error"))
    return apply_mirror(paths.select("path", F.lit("delete").alias("action")), "", target)
