"""Files in the shared folder, opened by URI from any task: local disks, HDFS or object stores that pyarrow reaches."""

from __future__ import annotations

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def create(uri: str):
    """A new file for writing, with the folders above it."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def read(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def open_random(uri: str):
    system, path = filesystem(uri)
    return system.open_input_file(path)
