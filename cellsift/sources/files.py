"""Files by byte range, on any file system that pyarrow reaches from a task.

Paths without a scheme are local or on a shared mount; others (``s3://``, ``hdfs://``,
``gs://``) go to their file system.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")


def entries(folder: str) -> list[tuple[str, str, bool]]:
    """Name, path and whether it is a folder, of what a folder holds; nothing if there is none."""
    system, at = located(folder)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return [(x.base_name, f"{folder.rstrip('/')}/{x.base_name}", x.type == fs.FileType.Directory) for x in found]


class RangeFile:
    """A file that is read by ranges; it counts the bytes that it reads."""

    def __init__(self, path: str):
        system, at = located(path)
        self.path, self.file, self.bytes_read = path, system.open_input_file(at), 0
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        out = self.file.read_at(length, offset)
        if len(out) != length:
            raise ValueError(f"{self.path}: ends at {offset + len(out)} where {offset + length} bytes are needed")
        self.bytes_read += length
        return out

    def close(self) -> None:
        self.file.close()


def merged_runs(starts: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """First and last of neighbouring runs (rising starts, one length) that are read
    as one: those with gaps no longer than a run, so that at most twice the bytes
    of the runs are read."""
    ends = np.flatnonzero(np.diff(starts) > 2 * length)
    return zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(starts) - 1])


def read_runs(file: RangeFile, starts: np.ndarray, length: int) -> np.ndarray:
    """The bytes of the runs, a row for each."""
    out = np.empty((len(starts), length), np.uint8)
    for first, last in merged_runs(starts, length):
        begin = int(starts[first])
        data = np.frombuffer(file.read(begin, int(starts[last]) + length - begin), np.uint8)
        gap = int(starts[first + 1]) - begin if last > first else length
        if (np.diff(starts[first : last + 1]) == gap).all():  # evenly spaced
            out[first : last + 1] = np.lib.stride_tricks.as_strided(data, (last - first + 1, length), (gap, 1))
        else:
            for i in range(first, last + 1):
                at = int(starts[i]) - begin
                out[i] = data[at : at + length]
    return out
