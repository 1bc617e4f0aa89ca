"""Binary files in the folder all executors share: written once by a task, then mapped into memory."""

from __future__ import annotations

import os
from functools import lru_cache
from urllib.parse import unquote, urlparse
from uuid import uuid4

import numpy as np


def _local(path: str) -> str | None:
    url = urlparse(path)
    return unquote(url.path) if url.scheme in ("", "file") else None


def write(path: str, data: bytes) -> None:
    """Write under another name and rename, so that a task that runs twice leaves one whole file."""
    local = _local(path)
    part = f"{local or path}.{uuid4().hex}"
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, local)
        return
    from pyarrow.fs import FileSystem

    files, place = FileSystem.from_uri(part)
    files.create_dir(os.path.dirname(place), recursive=True)
    with files.open_output_stream(place) as out:
        out.write(data)
    files.move(place, FileSystem.from_uri(path)[1])


@lru_cache(maxsize=4096)
def mapped(path: str) -> np.ndarray:
    """The file's 64-bit words; mapped where the shared folder is mounted, else read once by the process."""
    local = _local(path)
    if local:
        return np.memmap(local, np.uint64, "r") if os.path.getsize(local) else np.empty(0, np.uint64)
    from pyarrow.fs import FileSystem

    files, place = FileSystem.from_uri(path)
    with files.open_input_file(place) as source:
        return np.frombuffer(source.read_buffer(), np.uint64)
