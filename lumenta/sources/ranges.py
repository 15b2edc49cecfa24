"""Files read as ranges of bytes, from any file system that Arrow opens: local, hdfs, s3 and gs."""

from __future__ import annotations

import functools

from pyarrow import fs

#: Names that Spark's file systems have for those of Arrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


@functools.lru_cache
def _system(scheme: str, host: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and what to put before a path of it to name it again."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        return fs.LocalFileSystem(), path.removeprefix("file:"), ""
    scheme = _SCHEMES.get(scheme, scheme)
    if scheme == "file":
        return fs.LocalFileSystem(), rest, ""
    if scheme in ("s3", "gs"):
        return _system(scheme, rest.partition("/")[0]), rest, f"{scheme}://"
    host, _, inside = rest.partition("/")
    return _system(scheme, host), f"/{inside}", f"{scheme}://{host}"


def sizes(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the file at path, or of those in the folder at path, hidden ones left out."""
    system, inside, before = _opened(path)
    found = system.get_file_info(inside)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    every = system.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted((before + x.path, x.size) for x in every if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


def read(path: str, start: int, n: int) -> bytes:
    """n bytes from start, fewer at the end of the file."""
    system, inside, _ = _opened(path)
    with system.open_input_file(inside) as f:
        return f.read_at(n, start)
