"""Files as tasks reach them: by Arrow's file systems, under the names that Spark lists them by."""

from __future__ import annotations

import re

from pyarrow import fs

_URI = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)$", re.DOTALL)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, given as a path or a URI."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a file whose name stands as it is, with ``%`` and ``#`` and blanks, behind scheme and host."""
    m = _URI.match(path)
    if m is None or m[1] == "file":
        return fs.LocalFileSystem(), m[3] if m else path
    scheme = "s3" if m[1] == "s3a" else m[1]
    system, root = fs.FileSystem.from_uri(f"{scheme}://{m[2] or ''}/")
    return system, f"{root.rstrip('/')}{m[3]}"
