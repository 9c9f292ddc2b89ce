"""Files in the shared folder, written and range-read by tasks through Arrow's file systems (local, HDFS, S3 and others by URI)."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a folder's URI or absolute path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def make_folder(uri: str) -> str:
    store, path = open_folder(uri)
    store.create_dir(path, recursive=True)
    return uri


@contextmanager
def new_file(uri: str, name: str):
    """A file that gets its name only when it is whole, so a lost task leaves no half file under it."""
    store, path = open_folder(uri)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, f"{path}/{name}")


class RangeReader:
    """Range reads of the files of a folder; the last file stays open."""

    def __init__(self, uri: str):
        self.store, self.path = open_folder(uri)
        self.name, self.file = None, None

    def __call__(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.file, self.name = self.store.open_input_file(f"{self.path}/{name}"), name
        return self.file.read_at(length, offset)

    def size(self, name: str) -> int:
        return self.store.get_file_info(f"{self.path}/{name}").size

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.name = self.file = None
