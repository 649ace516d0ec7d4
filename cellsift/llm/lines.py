"""Line dedup by overlapping windows of three lines.

Blank lines don't count. Three consecutive lines make a window; windows that
occur more than once anywhere are found by a 128-bit hash. The first occurrence,
by doc_id and position, stays. The lines that the others cover are removed;
overlapping windows merge. A single line that many documents share stays unless
its neighbours are shared as well. A task holds the lines of about a megabyte of
texts, or of one longer text, at once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.llm.words import hidden, portions, released, texts
from cellsift.session import written

LINES = 3
#: A task takes texts of about so many bytes at once, one text at least, and sends
#: their windows on this many at a time: a window takes far more memory than a short line.
BYTES = 1 << 20
WINDOWS = 50_000


def _lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the places of those that aren't blank."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x and not x.isspace()]


def _window_rows(part: pa.RecordBatch, row: array, digests: bytearray, place: array) -> pa.RecordBatch:
    both, taken = np.frombuffer(digests, np.int64).reshape(-1, 2), pa.array(np.array(row))
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), part.column("_id").take(taken), part.column("_text").take(taken), pa.array(np.array(place))], ["h1", "h2", "_id", "_text", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions(batch, batch.num_rows, BYTES):
            row, digests, place = array("q"), bytearray(), array("i")
            for r, text in enumerate(texts(part)):
                lines, at = _lines(text or b"")
                full = [lines[i] for i in at]
                for p in range(len(full) - LINES + 1):
                    digests += xxhash.xxh3_128_digest(b"\n".join(full[p : p + LINES]))
                    row.append(r)
                    place.append(p)
                    if len(row) == WINDOWS:
                        yield _window_rows(part, row, digests, place)
                        row, digests, place = array("q"), bytearray(), array("i")
            yield _window_rows(part, row, digests, place)
    released()


def _cut(text: bytes, removed: list[int]) -> tuple[bytes, int]:
    """The text without the lines that the windows at ``removed`` cover."""
    lines, at = _lines(text)
    gone = {at[p + k] for p in removed for k in range(LINES)}
    left = [x for i, x in enumerate(lines) if i not in gone]
    return (b"\n".join(left) if len(gone) < len(at) else b""), len(gone)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text cut, and ``removed_lines``.

    Every row stays; a text of which nothing but blank lines is left becomes
    empty, and a null text stays null. Texts of fewer than three lines are not
    changed. Rows that are equal in doc_id and text count as one document and
    are treated alike; a null doc_id comes after all others.
    """
    kept, back = hidden(docs.drop("removed_lines"), ("doc_id", "text"))
    keyed = kept.withColumns({"_id": F.col("doc_id"), "_text": F.xxhash64("text")})
    kind = docs.schema["doc_id"].dataType.simpleString()
    windows = written(keyed.select("text", "_id", "_text").mapInArrow(_windows, f"h1 long, h2 long, _id {kind}, _text long, place int"), "line-windows")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_text", "place")
    # Written down, so that both sides of the join are dealt out by it and a hot window can be split.
    firsts = written(windows.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first != last").drop("last"), "line-firsts")
    later = windows.join(firsts, ["h1", "h2"]).filter(order != F.col("first"))
    removed = later.groupBy("_id", "_text").agg(F.collect_set("place").alias("_removed"))
    removed = removed.withColumnsRenamed({"_id": "_of", "_text": "_of_text"})
    joined = keyed.join(removed, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_of_text")), "left").select(*kept.columns, "_removed")

    names = kept.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, batch.num_rows, BYTES):
                out, n = [], []
                for text, removed in zip(texts(part), part.column("_removed").to_pylist()):
                    text, k = _cut(text, removed) if removed else (text, 0)
                    out.append(text)
                    n.append(k)
                columns = [pa.array(out, pa.binary()).cast(pa.string()) if f == "text" else part.column(f) for f in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], [*names, "removed_lines"])
        released()

    return joined.mapInArrow(step, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "removed_lines long"])).select(*back, "removed_lines")
