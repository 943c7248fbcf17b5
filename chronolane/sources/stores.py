"""Files that Python tasks open themselves, by path or URI, with Arrow's file systems."""

from __future__ import annotations

import re


def opened(path: str):
    """(file system, path inside it); a plain path is local.

    A path is taken as Spark tells it: nothing in it is escaped.
    """
    from pyarrow import fs

    scheme, root, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest)
    store, base = fs.FileSystem.from_uri(f"{scheme}://{root or ''}/")
    return store, base.rstrip("/") + rest


def listed(path: str, suffix: str = "") -> dict[str, int]:
    """Sizes of the files under a folder whose names end in ``suffix``; names and folders that begin with ``_`` or ``.`` are not looked at. No folder: none."""
    from pyarrow import fs

    store, base = opened(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    inside = [(f, f.path[len(base) :].strip("/")) for f in found if f.type == fs.FileType.File]
    return {f.path: f.size for f, name in inside if name.endswith(suffix) and not re.search(r"(^|/)[._]", name)}
