"""Whole binary files in the shared folder, written by tasks and read by Spark."""

from __future__ import annotations

import os
import uuid


def write_file(directory: str, name: str, payload: bytes) -> None:
    """Write under another name, then rename: a retried task leaves whole files only, and
    writes the same name again."""
    from pyarrow import fs

    uri = directory if "://" in directory else directory.replace("file:", "file://", 1) if directory.startswith("file:/") else f"file://{os.path.abspath(directory)}"
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    # A leading underscore or dot hides the file from Spark's readers.
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(payload)
    store.move(part, f"{root}/{name}")
