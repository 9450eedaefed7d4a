"""Small files on any store that Arrow reaches (file, s3, gs, hdfs): for sources and sinks that run in Python workers."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    found, inner = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path)
    return found, inner.rstrip("/")


def read_json(path: str):
    """The document of a file; None if there is no file. A broken one is a ValueError."""
    system, inner = at(path)
    try:
        with system.open_input_stream(inner) as f:
            raw = f.read()
    except FileNotFoundError:
        return None
    return json.loads(raw.decode("utf-8"))


def read_lines(path: str):
    """Documents of a file of lines, one after another."""
    system, inner = at(path)
    with system.open_input_stream(inner) as f:
        left = b""
        while chunk := f.read(1 << 20):
            *whole, left = (left + chunk).split(b"\n")
            yield from (json.loads(line) for line in whole if line)
        if left:
            yield json.loads(left)


def write(path: str, data: bytes) -> None:
    """A file that is there whole or not at all: written beside its place, then moved."""
    system, inner = at(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    aside = f"{inner}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(aside) as f:
        f.write(data)
    system.move(aside, inner)


def names(path: str, folders: bool = False) -> list[str]:
    """Names of the files (or folders) in a folder; none if it isn't there."""
    system, inner = at(path)
    kind = fs.FileType.Directory if folders else fs.FileType.File
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if x.type == kind)


def remove(path: str) -> None:
    """Deletes a file, or a folder with all in it; nothing if it isn't there."""
    system, inner = at(path)
    kind = system.get_file_info([inner])[0].type
    if kind == fs.FileType.Directory:
        system.delete_dir(inner)
    elif kind == fs.FileType.File:
        try:
            system.delete_file(inner)
        except FileNotFoundError:
            pass
