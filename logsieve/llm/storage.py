"""Files in the shared folder, opened by URI on the driver or an executor."""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


class Store:
    """One folder of a file system that its URI names (local, HDFS, an object store)."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.fs, self.path = fs.FileSystem.from_uri(self.uri)

    def make(self) -> None:
        self.fs.create_dir(self.path, recursive=True)

    def create(self, name: str):
        return self.fs.open_output_stream(f"{self.path}/{name}")

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")

    def names(self) -> list[str]:
        return sorted(x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.path)) if x.is_file)


def attempt_name(kind: str) -> str:
    """A file name of this task attempt alone: rows of another attempt never point to it."""
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.stageId()}-{task.taskAttemptId()}"
