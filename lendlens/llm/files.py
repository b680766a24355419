"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import os
import uuid

import numpy as np
import zstandard
from pyarrow import fs
from pyspark.sql import SparkSession

from lendlens.llm.common import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a result, as a URI."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, *parts: bytes) -> None:
    """Write a file and give it its name at the end, so that a task that runs twice or is lost leaves no broken one."""
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, path)


def open_input(uri: str):
    store, path = _store(uri)
    return store.open_input_file(path)


def open_draft(uri: str):
    """A stream to a draft of the file, and a call that gives it its name."""
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    return store.open_output_stream(draft), lambda: store.move(draft, path)


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file, memory-mapped where the folder is mounted, else read."""
    store, path = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), np.uint8)


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, compressed: the first, sorted, by its differences, each by planes of bytes."""
    planes = []
    for i, x in enumerate(arrays):
        x = x.astype(np.uint64)
        if not i and len(x):
            x = np.concatenate([x[:1], np.diff(x)])
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_numbers(data: bytes, count: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    found = []
    for i, planes in enumerate(np.split(raw, count)):
        x = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
        with np.errstate(over="ignore"):
            found.append(np.cumsum(x, dtype=np.uint64) if not i else x)
    return found
