"""Files that tasks open themselves, by any address that pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address; what Spark names file:/... is local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a path with an ending, by name; hidden and marked ones are none."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    own = lambda p: [x for x in p.removeprefix(root).split("/") if x]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending) and not any(x[0] in "._" for x in own(f.path)))
