"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint is mapped to the bit counts of its sixteen 4-bit segments.
The Manhattan distance of two such points is never more than the Hamming
distance of their fingerprints, so links at two differing bits lie within
Manhattan distance two. On an integer grid such points have a cell within
distance one of both: each distinct fingerprint goes to the (at most 33) cells
around its own, and the fingerprints that meet in a cell are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.llm.components import components
from cellsift.llm.words import hidden, mapped, texts
from cellsift.session import written

#: Links at this many differing bits; the grid of cells is made for it.
BITS = 2
#: In a cell of up to SMALL fingerprints, links go out one by one (at most
#: SMALL - 1 for each); a larger one is reduced to a spanning forest in its
#: task; beyond LARGE its fingerprints go to ``probed_links``, where no task
#: gathers them.
SMALL, LARGE = 32, 4096


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each of the text's word shingles.

    A-Z become lower case; a text of fewer words is one shingle; a text without
    words, or none at all, has none.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    last = ends[words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip((ends - lengths).tolist(), last)], np.uint64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Majority of the bits over the text's word shingles; zero for a text without words."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none."""
    if not len(hashes):
        return 0
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 255 * 64):  # sums of 255 rows fit into a byte
        bits = np.unpackbits(hashes[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) and ``fp``, the fingerprint as a long."""
    kept = docs.drop("fp")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(v) for v in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], [*batch.schema.names, "fp"])

    return kept.mapInArrow(mapped(step), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "fp long"]))


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the sixteen 4-bit segments, each in its segment's place."""
    pairs = fps - ((fps >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))


def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows ``cell, fp``: the own cell, and those one step away along one axis."""
    fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
    own = segment_counts(fps)
    cell, owner = [own], [fps]
    for i in range(16):
        one = np.uint64(1) << np.uint64(4 * i)
        count = (own >> np.uint64(4 * i)) & np.uint64(15)
        for fits, at in ((count < 4, own + one), (count > 0, own - one)):
            cell.append(at[fits])
            owner.append(fps[fits])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (cell, owner)], ["cell", "fp"])


def forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what is linked among ``fps``, without cycles."""
    left, a, b = fps, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= BITS
            if near.any():
                found = left[near]
                a += [x] * len(found)
                b += found.tolist()
                front += list(found)
                left = left[~near]
    return a, b


def cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links ``a, b`` among the rows of each cell. Rows are sorted by
    cell. Those of a cell with more than LARGE rows come out with b null."""
    kept_cell, kept_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    over = None  # the cell whose rows are being handed on

    def out(a, b):
        a, b = (np.array(x, np.uint64).view(np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def hot(fps):
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64())], ["a", "b"])

    def links(cell, fp):
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        size = np.repeat(sizes, sizes)
        few = np.flatnonzero((size > 1) & (size <= SMALL))
        c, f = cell[few], fp[few]
        for lag in range(1, SMALL):
            same = c[lag:] == c[:-lag]
            if not same.any():
                break
            x, y = f[:-lag][same], f[lag:][same]
            near = np.bitwise_count(x ^ y) <= BITS
            yield out(x[near], y[near])
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            yield hot(fp[s : s + n]) if n > LARGE else out(*forest(fp[s : s + n]))

    for batch in batches:
        cell = np.r_[kept_cell, batch.column("cell").to_numpy(zero_copy_only=False)]
        fp = np.r_[kept_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
        if over is not None:
            more = int(np.searchsorted(cell != over, True))
            yield hot(fp[:more])
            cell, fp = cell[more:], fp[more:]
        if not len(cell):
            kept_cell, kept_fp = cell, fp
            continue
        over = None
        last = len(cell) - int(np.searchsorted((cell != cell[-1])[::-1], True))  # the last cell may go on
        if last:
            yield from links(cell[:last], fp[:last])
        kept_cell, kept_fp = cell[last:], fp[last:]
        if len(kept_cell) > LARGE:
            yield hot(kept_fp)
            over, kept_cell, kept_fp = kept_cell[0], kept_cell[:0], kept_fp[:0]
    if len(kept_cell):
        yield from links(kept_cell, kept_fp)


def probed_links(fps: DataFrame) -> DataFrame:
    """All links among distinct fingerprints by looking up each fingerprint with
    one or two bits changed: exact for any number of them in a cell, at a fixed
    number of look-ups for each."""
    ones = [1 << i for i in range(64)]
    masks = [a ^ b for i, a in enumerate(ones) for b in ones[i + 1 :]] + ones
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    probes = fps.select(F.col("fp").alias("a"), F.explode(signed).alias("mask")).select("a", F.col("a").bitwiseXOR(F.col("mask")).alias("b"))
    return probes.filter("b > a").join(fps.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")


def links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all of ``fp`` (distinct) linked at BITS bits."""
    around = fps.select("fp").mapInArrow(mapped(cells), "cell long, fp long")
    met = written(around.repartition("cell").sortWithinPartitions("cell").mapInArrow(cell_links, "a long, b long").distinct(), "links")
    hot = met.filter("b IS NULL").select(F.col("a").alias("fp"))
    found = met.filter("b IS NOT NULL")
    return found if hot.isEmpty() else found.union(probed_links(hot))


def component_ids(fps: DataFrame) -> DataFrame:
    """``fp, component_id`` of each distinct fp of ``fps`` (doc_id, fp);
    component_id is the smallest doc_id reachable by links."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(links(distinct)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Null and wordless texts have fingerprint zero and are linked like others.
    Repeated rows come out as often as they go in. component_id ignores null
    doc_ids; it is null where a component has no other.
    """
    fps = written(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "simhash")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(component_ids(fps), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest
    doc_id (nulls last), of rows equal in it any one."""
    plain, back = hidden(docs, ("doc_id", "text"))
    rows = written(with_fingerprints(plain).withColumn("_row", F.monotonically_increasing_id()), "simhash")
    narrow = rows.select("doc_id", "fp", "_row")
    distinct = narrow.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    distinct = written(distinct, "fingerprints")
    roots = components(links(distinct)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(stay, "_row", "left_semi").select(*back)
