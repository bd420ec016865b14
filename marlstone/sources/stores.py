"""Files that Python tasks read and write themselves: by Arrow's file systems, so a path may be local, shared or an address of a store."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs

PIECE = 4 * 1024 * 1024


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or an address; Spark writes local ones as file:/..."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def files_under(path: str) -> list[str]:
    """Paths of all files under a folder, sorted; none where it is missing."""
    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File)


def pieces(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """A file's bytes, a bounded piece at a time."""
    with store.open_input_stream(path) as f:
        while piece := f.read(PIECE):
            yield piece
