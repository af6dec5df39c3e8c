"""Files that tasks write to and read from shared storage (pyarrow file systems, by URI)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def create(folder: str, name: str):
    """A new file below ``folder``; the name is unique, so a repeated task never meets its own file."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    unique = f"{name}-{uuid.uuid4().hex}"
    return system.open_output_stream(f"{path}/{unique}", compression=None), f"{folder}/{unique}"


def open_file(uri: str):
    """Random access."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def open_stream(uri: str):
    """Sequential access, bytes as they are."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)
