"""Files on storage that all machines reach, opened by their uri from tasks."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a uri, and the path in it; a bare path is a local one."""
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def listed(uri: str, *endings: str) -> list[str]:
    """Paths of the files under a folder, or the file itself, with one of these endings in any case; in order."""
    system, path = opened(uri)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings))
