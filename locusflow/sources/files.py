"""Files that tasks read by byte ranges, through any file system that pyarrow knows."""

from __future__ import annotations

import fnmatch

from pyarrow import fs

#: Names that Spark uses for stores that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    scheme, sep, rest = path.partition("://")
    if not sep:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def opened(path: str):
    """The file for random access."""
    store, inner = filesystem(path)
    return store.open_input_file(inner)


def listed(pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of what a folder holds, or of what a pattern in the last part of the path matches; paths keep their scheme."""
    store, inner = filesystem(pattern)
    head = pattern[: len(pattern) - len(inner)] if "://" in pattern else ""
    folder, _, last = inner.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in store.get_file_info(fs.FileSelector(folder or ".")) if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = store.get_file_info(inner)
        found = store.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    if not files:
        raise FileNotFoundError(pattern)
    return [(head + p if head else p, n) for p, n in files]


def scratch(spark, label: str) -> str:
    """A path of its own in the folder that the session's executors share (spark.checkpoint.dir); a local one only where all run in one process."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
