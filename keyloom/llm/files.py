"""Files that executors write to, and read from, the shared folder: local, HDFS or an object store."""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Output:
    """A file that appears under its name only when it is complete, so a lost or repeated task does no harm."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = store(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex[:8]}.part"
        self.file = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.part, self.path)

    def discard(self) -> None:
        self.file.close()
        self.fs.delete_file(self.part)
