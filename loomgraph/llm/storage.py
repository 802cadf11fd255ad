"""Files in storage that the whole cluster sees, by URI."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, parts: list[bytes]) -> None:
    """Write a file under a name of its own, then move it into place: a repeated task replaces it whole."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as f:
        for p in parts:
            f.write(p)
    fs.move(own, path)
