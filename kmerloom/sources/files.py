"""Files of a path, folder or pattern on any file system that pyarrow can open: mounted folders, hdfs://, s3://, gs://.

A path without a scheme, or with file://, is a mounted file system that every executor sees under the same path.
"""

from __future__ import annotations

import fnmatch
import posixpath

from pyarrow import fs as pafs


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path, and the path within it."""
    if "://" not in path:
        path = path.removeprefix("file:")
        return pafs.LocalFileSystem(), path
    if path.startswith("file://"):
        return pafs.LocalFileSystem(), path.removeprefix("file://")
    return pafs.FileSystem.from_uri(path)


def _named(path: str, inner: str) -> str:
    """inner with the scheme of path, so that another process can open it."""
    if "://" not in path or path.startswith("file://"):
        return inner
    scheme, rest = path.split("://", 1)
    host = rest.split("/", 1)[0]
    inner = inner.lstrip("/")
    return f"{scheme}://{inner}" if inner.split("/", 1)[0] == host else f"{scheme}://{host}/{inner}"


def data_files(path: str) -> list[str]:
    """Files of a path, folder or pattern, hidden ones left out, in name order; none is an error."""
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        found = [inner]
    elif info.type == pafs.FileType.Directory:
        found = [x.path for x in system.get_file_info(pafs.FileSelector(inner)) if x.type == pafs.FileType.File and x.base_name[0] not in "._"]
    else:
        folder = posixpath.dirname(inner)
        listed = system.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True))
        found = [x.path for x in listed if x.type == pafs.FileType.File and fnmatch.fnmatchcase(x.base_name, posixpath.basename(inner))]
    if not found:
        raise FileNotFoundError(path)
    return sorted(_named(path, x) for x in found)


def size_of(path: str) -> int:
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def open_file(path: str):
    """A seekable file for reading."""
    system, inner = file_system(path)
    return system.open_input_file(inner)
