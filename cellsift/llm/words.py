"""Text helpers that run inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
BLANKS = "\x20\t\n\x0b\x0c\r"


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column; ``bytes.split()`` cuts them into words."""
    return batch.column(name).cast(pa.binary()).to_pylist()


class Memo(dict):
    """Values of keys seen so far. After ``trim`` it holds at most ``most`` new
    keys and as many old ones, so a task's memory stays bounded whatever the
    vocabulary, and keys in use are not lost."""

    def __init__(self, make: Callable, most: int = 400_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def hidden(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``keep`` under the names x0, x1, ..., so that
    none clashes with a name used on the way; and the columns that undo it."""
    names = {c: c if c in keep else f"x{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(v).alias(c) for c, v in names.items()]


def portions(batch: pa.RecordBatch, rows: int, size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of up to ``rows`` rows and about ``size`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
        end = max(at + 1, min(end, at + rows))
        yield batch.slice(at, end - at)
        at = end


def released() -> None:
    """Give free memory back to the system. A worker lives on after its task, and
    what it holds is missing to those of later stages."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def mapped(step: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of one batch as the function of batches that mapInArrow takes."""

    def run(batches):
        for batch in batches:
            yield step(batch)
        released()

    return run
