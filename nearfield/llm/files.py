"""Flat files in the shared folder, written and read inside tasks.

Every attempt of a task writes files of its own names and returns them in its rows, so files of
failed or repeated attempts are never read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs

_opened: dict[str, np.ndarray] = {}


def own_file(folder: str, stem: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}.{suffix}"


def _system(path: str):
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(path)


@contextmanager
def output(path: str) -> Iterator:
    system, name = _system(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    with system.open_output_stream(name) as stream:
        yield stream


def read_range(path: str, offset: int, size: int) -> bytes:
    system, name = _system(path)
    with system.open_input_file(name) as stream:
        return stream.read_at(size, offset)


def save(path: str, array: np.ndarray) -> str:
    with output(path) as stream:
        np.lib.format.write_array(stream, np.ascontiguousarray(array), allow_pickle=False)
    return path


def mapped(path: str) -> np.ndarray:
    """The array memory-mapped, once per worker; fetched first where the store is not mounted."""
    if path not in _opened:
        system, name = _system(path)
        if not isinstance(system, fs.LocalFileSystem):
            local = os.path.join(tempfile.mkdtemp(), os.path.basename(name))
            with system.open_input_stream(name) as source, open(local, "wb") as target:
                while part := source.read(1 << 24):
                    target.write(part)
            name = local
        _opened[path] = np.load(name, mmap_mode="r", allow_pickle=False)
    return _opened[path]
