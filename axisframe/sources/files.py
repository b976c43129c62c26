"""Files on any file system that Arrow knows: local paths, ``file:``, ``hdfs://``, ``s3://`` and so on."""

from __future__ import annotations

import fnmatch
import posixpath

import pyarrow as pa
from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), posixpath.abspath(path)


def open_file(path: str) -> pa.NativeFile:
    system, plain = place(path)
    return system.open_input_file(plain)


def open_stream(path: str) -> pa.NativeFile:
    """Bytes of a file, unpacked if it ends in .gz or .bz2."""
    system, plain = place(path)
    return system.open_input_stream(plain, compression="detect")


def expand(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files of a folder that end in ``suffix``, or of those that match a pattern."""
    system, plain = place(path)
    lead = path[: len(path) - len(plain)] if path.endswith(plain) else ""
    info = system.get_file_info(plain)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(plain))
        found = [i for i in found if i.base_name.endswith(suffix) and not i.base_name.startswith(("_", "."))]
    else:
        found = system.get_file_info(fs.FileSelector(posixpath.dirname(plain), allow_not_found=True))
        found = [i for i in found if fnmatch.fnmatchcase(i.base_name, posixpath.basename(plain))]
    files = sorted((lead + i.path, i.size) for i in found if i.type == fs.FileType.File)
    if not files:
        raise FileNotFoundError(path)
    return files
