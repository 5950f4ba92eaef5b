"""Files of any file system that Arrow opens: folders, listings, ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def listed(path: str, *endings: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files in a folder with one of the endings, by name."""
    system, own = opened(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(own, recursive=True, allow_not_found=True))
    base = path.rstrip("/")
    return sorted((base + f.path[len(own.rstrip("/")) :], f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings))


def ranges(path: str) -> Callable[[int, int], bytes]:
    """A function of (offset, size) that reads that part of a file."""
    system, own = opened(path)
    file = system.open_input_file(own)
    return lambda at, n: file.read_at(n, at)


def exists(path: str) -> bool:
    system, own = opened(path)
    return system.get_file_info(own).type == fs.FileType.File
