"""Whole-file output and input in a shared folder, from tasks.

A task writes under a temporary name and renames at the end, and the name holds
nothing but what the content depends on: a task that runs again after the loss
of an executor replaces the file by an equal one.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager


def _store(uri: str):
    """(file system, path); local paths and file: URIs need no extra library."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str):
    """A binary output stream; the file appears under its name once complete."""
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, path)


def open_file(uri: str):
    """A seekable binary input."""
    store, path = _store(uri)
    return store.open_input_file(path)
