"""Files of a directory tree, or a single file, as a DataFrame.

Spark's own binary reader leaves out empty files and names that start with . or _, and follows linked directories, so the
tree is walked here: the driver lists the first levels, executors walk the folders below, and contents are read by the
executors too, in Arrow batches. Root must be on a file system that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decoding, scan
from ..functions.naming import base_name
from ..runtime import ship

FILES = "path string, name string, size long"
LARGEST = 0xFFFFFFFF  # larger files count, without lines
SHARED_OUT, MOST_TASKS = 256, 10_000  # folders that the walk is dealt out by, and its tasks
AT_ONCE = 64 << 20  # bytes of contents that are handed on together
SUCCESS, OPEN_FAILED, READ_FAILED = "SUCCESS", "FILE_OPEN_FAILED", "FILE_READ_FAILED"


class ScanError(Exception):
    """A root or directory that cannot be listed, or in failfast mode a file that cannot be read."""


def canonical(root: str) -> str:
    """The path without . and .. parts."""
    if not root:
        raise ScanError("PATH_NORMALIZATION: empty path")
    return os.path.normpath(root)


def children(folder: str, skip_unreadable: bool = False) -> tuple[list[tuple[str, str, int]], list[str]]:
    """(files, subdirectories) of a folder: every name counts, hidden ones too. A linked directory is neither; a linked
    file is a file."""
    files, folders = [], []
    try:
        with os.scandir(folder) as entries:
            for e in sorted(entries, key=lambda x: x.name):
                if e.is_dir(follow_symlinks=False):
                    folders.append(e.path)
                elif not e.is_dir():
                    try:
                        size = e.stat().st_size
                    except OSError:
                        size = -1
                    files.append((e.path, e.name, size))
    except OSError as error:
        if not skip_unreadable:
            raise ScanError(f"DIR_ENUM_FAILED: {folder}: {error}") from error
    return files, folders


def walk(folder: str, skip_unreadable: bool = False) -> Iterator[tuple[str, str, int]]:
    """All files below a folder, parents first; as deep as the folders go."""
    open_ = [folder]
    while open_:
        files, folders = children(open_.pop(), skip_unreadable)
        yield from files
        open_ += reversed(folders)


def spread(folders: list[str], skip_unreadable: bool, most: int) -> tuple[list[tuple[str, str, int]], list[str]]:
    """Go down level by level until there are `most` folders to share out: the files met on the way, and the folders."""
    files: list[tuple[str, str, int]] = []
    while folders and len(folders) < most:
        found = [children(f, skip_unreadable) for f in folders]
        files += [x for a, _ in found for x in a]
        folders = [x for _, b in found for x in b]
    return files, folders


def list_files(spark: SparkSession, root: str, recursive: bool = True, skip_unreadable: bool = False) -> DataFrame:
    """(path, name, size) of a file, or of the files of a directory, in no set order.

    A root that is itself a link to a directory is entered."""
    ship(spark)
    root = canonical(root)
    if os.path.isdir(root):
        files, folders = children(root, skip_unreadable)
    elif os.path.exists(root):
        files, folders = [(root, os.path.basename(root), os.path.getsize(root))], []
    else:
        raise ScanError(f"FILE_OPEN_FAILED: {root}")
    if recursive:
        # a tree with one top folder gives work to many tasks too; files met above are few, for the levels above are
        more, folders = spread(folders, skip_unreadable, SHARED_OUT)
        files += more
    out = spark.createDataFrame(files, FILES)
    if not recursive or not folders:
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["path"]:
                held = []
                for row in walk(folder, skip_unreadable):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=["path", "name", "size"])
                        held = []
                yield pd.DataFrame(held, columns=["path", "name", "size"]).astype({"path": object, "name": object, "size": "int64"})

    below = spark.createDataFrame([(f,) for f in folders], "path string").repartition(min(len(folders), MOST_TASKS))
    return out.unionByName(below.mapInPandas(run, FILES))


def from_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, name, size) for a DataFrame of paths."""
    return paths.select(F.col(path).alias("path"), base_name(path).alias("name"), F.lit(-1).cast("long").alias("size"))


def read_stats(resolved: DataFrame) -> DataFrame:
    """Reads files and counts their lines where they are read: (path, language, family, total, blank, comment, status).

    Names are resolved before this, so files without a language are never opened. A file that cannot be read, is not
    text or is over LARGEST bytes has no lines; only the first has a status other than SUCCESS. One file is held in
    memory at a time."""
    ship(resolved.sparkSession)
    schema = "path string, language string, family string, total long, blank long, comment long, status string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, language, family in zip(frame["path"], frame["language"], frame["family"]):
                counts, status = (0, 0, 0), OPEN_FAILED
                try:
                    with open(path, "rb") as f:
                        status = READ_FAILED
                        if os.fstat(f.fileno()).st_size <= LARGEST:
                            text = decoding.to_text(f.read())
                            if text:
                                counts = scan.count_lines(text, family)
                        status = SUCCESS
                except OSError:
                    pass
                out.append((path, language, family, *counts, status))
            yield pd.DataFrame(out, columns=["path", "language", "family", "total", "blank", "comment", "status"])

    return resolved.select("path", "language", "family").mapInPandas(run, schema)


def read_contents(files: DataFrame) -> DataFrame:
    """Adds content (binary, null if it cannot be read) and status, for uses that need the bytes; a column of the input with one
    of these names is replaced."""
    ship(files.sparkSession)
    kept = [c for c in files.columns if c.lower() not in ("content", "status")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            first, size, held = 0, 0, []
            for k, path in enumerate(frame["path"]):
                try:
                    with open(path, "rb") as f:
                        held.append((f.read(), SUCCESS))
                except OSError:
                    held.append((None, OPEN_FAILED))
                size += len(held[-1][0] or b"")
                if size >= AT_ONCE or k == len(frame) - 1:
                    yield frame.iloc[first : k + 1].assign(content=[h[0] for h in held], status=[h[1] for h in held])[[*kept, "content", "status"]]
                    first, size, held = k + 1, 0, []

    from pyspark.sql import types as T

    return files.mapInPandas(run, T.StructType([*(files.schema[c] for c in kept), T.StructField("content", T.BinaryType()), T.StructField("status", T.StringType())]))


def shared_tree(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir), deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "loomline-trees")
    base = re.sub("^file:/*", "/", base)
    if "://" in base:
        raise ScanError(f"FILE_OPEN_FAILED: {base} is no mounted folder, and files are read by their paths")
    root = os.path.join(base, f"tree-{uuid.uuid4().hex}")
    os.makedirs(root)
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def write_files(contents: DataFrame, root: str) -> None:
    """Write (path below root, content) as files. A task that runs again writes the same bytes again."""
    ship(contents.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(content)
                n += 1
        yield pd.DataFrame({"n": [n]})

    contents.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()
