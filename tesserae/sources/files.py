"""Single files, written and read by tasks through the file system their path names."""

from __future__ import annotations

import re

import pyarrow.fs as fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    found = re.fullmatch(r"(?:file:(?://)?)?(/[^/].*)", path)
    return (fs.LocalFileSystem(), found[1]) if found else fs.FileSystem.from_uri(path)


def write(path: str, *parts: bytes) -> int:
    """Writes one file and its folder; returns its size."""
    system, name = opened(path)
    system.create_dir(name.rsplit("/", 1)[0])
    with system.open_output_stream(name) as out:
        for part in parts:
            out.write(part)
    return sum(len(part) for part in parts)
