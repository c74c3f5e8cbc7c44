"""Folders that driver and executors share, and files in them as pyarrow sees them."""

from __future__ import annotations

import fnmatch
import posixpath
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

TEMPORARY = "_temporary"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; on one machine where that is unset, in a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        found = tempfile.mkdtemp(prefix="lumaframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that pyarrow knows (local, hdfs, s3, gs, abfs), and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at a path: a file, a folder with all below it, or a pattern for the last part. Hidden and temporary files are left out; sorted by path."""
    system, place = opened(path)
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    pattern = posixpath.basename(place) if set(posixpath.basename(place)) & set("*?[") else None
    info = system.get_file_info(posixpath.dirname(place) if pattern else place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"There is nothing at {path}.")
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(info.path, recursive=pattern is None))
    top = posixpath.dirname(place) if pattern or info.type == fs.FileType.File else place
    visible = lambda p: not any(part.startswith(("_", ".")) for part in posixpath.relpath(p, top).split("/"))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and visible(f.path) and (pattern is None or fnmatch.fnmatch(f.base_name, pattern)))
