"""Removal of repeated byte strings with sparse suffix arrays.

Every ``SIZE``-byte window of a text has an anchor: its leftmost k-gram with the
smallest hash. It depends on the window's bytes alone, so equal windows have
their anchors at the same place, and only suffixes that begin at anchors need
sorting. Neighbouring windows with one anchor make a segment; equal segments are
found by a 128-bit hash. Distinct segments whose anchors have the same k-gram
are compared in suffix arrays of what follows the anchors and, reversed, of what
precedes them. These are sorted deep-shallow: multikey quicksort to a shallow
depth, then blind tries for groups with a longer common prefix.

Only what repeats is shuffled: bitmaps of fixed size hold back segments whose
k-gram occurs once, and texts that no join needs. They may let more through, which
costs room and changes no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsift.llm.decontaminate import _filter, _passes
from cellsift.llm.words import hidden, mapped, texts
from cellsift.session import written

SIZE = 400
GRAM = 64
#: Positions of a window at which its anchor can lie.
PLACES = SIZE - GRAM + 1
#: Multikey quicksort goes this deep beyond the common prefix of a group.
SHALLOW = 16
#: A task compares this many segments of a group at once. A larger group is
#: split by more of the bytes that its windows have in common, over again.
TOGETHER = 20_000
#: Windows of a huge text are taken in stretches, where a place fits 24 bits.
STRETCH = 1 << 23

# Odd multipliers of the rolling hash, one for each doubling of its length.
_MIX = (np.random.default_rng(64).integers(0, 1 << 63, 7, np.uint64) << np.uint64(1)) | np.uint64(1)
_BYTE = np.random.default_rng(65).integers(0, 1 << 63, 256, np.uint64)
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    h = _BYTE[data]
    for i in range(GRAM.bit_length() - 1):
        h = h[: -(1 << i)] * _MIX[i] + h[1 << i :]
    h ^= h >> np.uint64(29)
    h *= _MIX[-1]
    return h ^ (h >> np.uint64(32))


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor's k-gram, first window, number of windows, and place of
    the anchor in the first window, for each segment of a text."""
    if len(text) < SIZE:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    data, parts = np.frombuffer(text, np.uint8), []
    for begin in range(0, len(text) - SIZE + 1, STRETCH):
        grams = gram_hashes(data[begin : begin + STRETCH + SIZE - 1])
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while 2 * reach <= PLACES:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if PLACES > reach:
            least = np.minimum(least[: reach - PLACES], least[PLACES - reach :])
        anchor = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        parts.append((grams[anchor[first]], begin + first, np.diff(np.r_[first, len(anchor)]), anchor[first] - first))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _segment_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    row, parts, digests = [], [], []
    for r, text in enumerate(texts(batch)):
        found = segments(text or b"")
        parts.append(found)
        row.append(np.full(len(found[0]), r))
        digests += [xxhash.xxh3_128_digest(text[s:e]) for s, e in zip(found[1].tolist(), (found[1] + found[2] + SIZE - 1).tolist())]
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    gram, first, count, anchor = (np.concatenate(p) for p in zip(*parts)) if parts else (np.empty(0, np.int64),) * 4
    taken = pa.array(np.concatenate(row) if row else np.empty(0, np.int64))
    ints = [pa.array(x.astype(np.int32)) for x in (first, count, anchor)]
    return pa.RecordBatch.from_arrays([batch.column("_id").take(taken), batch.column("_text").take(taken), pa.array(gram.astype(np.uint64).view(np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *ints], ["_id", "_text", "gram", "c1", "c2", "first", "count", "anchor"])


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie_sort(items: list[bytes], which: list[int]) -> tuple[list[int], list[int]]:
    """``which`` sorted by their strings, and the common prefix of each with the
    one before. A trie of branching bytes only: a descent that looks at no other
    bytes ends at a leaf, and one comparison with it tells where to branch."""
    # A node is [depth, {byte: node}], a leaf [length, None, members]; -1 ends a string.
    at = lambda s, d: s[d] if d < len(s) else -1
    root = [len(items[which[0]]), None, [which[0]]]
    for i in which[1:]:
        s, node = items[i], root
        while node[1] is not None:
            node = node[1].get(at(s, node[0])) or next(iter(node[1].values()))
        other = items[node[2][0]]
        depth = lcp(s, other)
        if depth == len(s) == len(other):
            node[2].append(i)
            continue
        above, node = None, root
        while node[1] is not None and node[0] < depth:
            above, node = (node, at(s, node[0])), node[1][at(s, node[0])]
        leaf = [len(s), None, [i]]
        if node[1] is not None and node[0] == depth:
            node[1][at(s, depth)] = leaf
            continue
        branch = [depth, {at(other, depth): node, at(s, depth): leaf}]
        if above is None:
            root = branch
        else:
            above[0][1][above[1]] = branch
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, before = stack.pop()
        if node[1] is None:
            order += node[2]
            common += [before] + [node[0]] * (len(node[2]) - 1)
        else:
            keys = sorted(node[1], reverse=True)
            stack += [(node[1][k], node[0] if k != keys[-1] else before) for k in keys]
    return order, common


def deep_shallow_sort(items: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of ``items``, and the common prefix of each with the one before
    (of the first: 0)."""
    start = lcp(min(items), max(items))
    order: list[int] = []
    common: list[int] = []
    stack = [(list(range(len(items))), start, 0)]  # strings, depth they share, common prefix with what precedes
    while stack:
        which, depth, before = stack.pop()
        if len(which) == 1:
            order += which
            common.append(before)
        elif depth >= start + SHALLOW:
            o, c = blind_trie_sort(items, which)
            order += o
            common += [before, *c[1:]]
        else:
            keys = [items[i][depth] if depth < len(items[i]) else -1 for i in which]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            below, same, above = ([i for i, k in zip(which, keys) if (k > pivot) - (k < pivot) == side] for side in (-1, 0, 1))
            for part, deeper in ((above, depth), (same, depth + 1), (below, depth)):
                if not part:
                    continue
                led = bool(below) if part is same else bool(below or same) if part is above else False
                if part is same and pivot == -1:  # ended strings, all equal
                    stack += [([i], depth, depth) for i in part[1:]] + [([part[0]], depth, depth if led else before)]
                else:
                    stack.append((part, deeper, depth if led else before))
    return order, common


def shared_windows(group: list[tuple[bytes, int]], low: int, high: int) -> list[list[tuple[int, int]]]:
    """For each segment (bytes, place of the anchor) of a group: ranges of how far
    before the anchor a window begins that another segment has as well, between
    ``low`` and ``high``. The segments are distinct."""
    marks: list[list[tuple[int, int]]] = [[] for _ in group]
    after = [u[o:] for u, o in group]
    before = [u[:o][::-1] for u, o in group]
    if len(group) == 2:
        a, b = max(low, SIZE - lcp(*after)), min(high, lcp(*before))
        if a <= b:
            marks[0].append((a, b))
            marks[1].append((a, b))
        return marks

    def classes(items: list[bytes]):
        order, common = deep_shallow_sort(items)
        rank = np.empty(len(items), np.int64)
        rank[order] = np.arange(len(items))
        common, known = np.array(common), {}

        def at(depth: int) -> np.ndarray:
            """Equal numbers for items that share ``depth`` bytes."""
            if depth not in known:
                known[depth] = np.cumsum(common < depth)[rank] if depth > 0 else np.zeros(len(items), np.int64)
            return known[depth]

        return at

    right, left = classes(after), classes(before)
    n = len(group)
    stack = [(low, high, np.arange(n))]
    while stack:
        a, b, members = stack.pop()
        key = right(SIZE - b)[members] * (n + 1) + left(a)[members]
        inner = right(SIZE - a)[members] * (n + 1) + left(b)[members]
        order = np.argsort(key, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(some) < 2:
                continue
            if a == b or (inner[some] == inner[some[0]]).all():
                for i in members[some]:
                    marks[i].append((a, b))
            else:
                mid = (a + b) // 2
                stack += [(a, mid, members[some]), (mid + 1, b, members[some])]
    return marks


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same numbers in as few ranges as they take."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that distinct segments share, for rows sorted by key.

    Out come ``c1, c2, x0, x1`` (windows of the segment, counted from its first)
    and, for groups of more than TOGETHER rows, rows of the same form as the
    input with narrower ranges and new keys.
    """
    names = ["key", "low", "high", "c1", "c2", "anchor", "bytes", "x0", "x1"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    out: list[tuple] = []

    def drained(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal out
        if len(out) >= least:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
            out = []

    def found(row: tuple, a: int, b: int) -> None:
        c1, c2, anchor, data = row[3:7]
        x0, x1 = max(0, anchor - b), min(len(data) - SIZE, anchor - a)
        if x0 <= x1:
            out.append((None, None, None, c1, c2, None, None, x0, x1))

    def close(group: list[tuple]) -> None:
        if len(group) > 1:
            for row, ranges in zip(group, shared_windows([(r[6], r[5]) for r in group], group[0][1], group[0][2])):
                for a, b in joined(ranges):
                    found(row, a, b)

    def split(row: tuple, first: tuple) -> None:
        _, low, high, c1, c2, o, data = row
        if low == high:  # the key covers the whole window
            if data[o - low : o - low + SIZE] == first[6][first[5] - low : first[5] - low + SIZE]:
                found(row, low, low)
            return
        mid = (low + high) // 2
        for a, b in ((low, mid), (mid + 1, high)):
            if o >= a and len(data) - o >= SIZE - b:
                key = xxhash.xxh3_64_intdigest(data[o - a : o + SIZE - b], seed=a * SIZE + b)
                out.append((key - (1 << 64) if key >> 63 else key, a, b, c1, c2, o, data, None, None))

    held: list[tuple] = []
    first: tuple | None = None  # of a group that is being split
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if first is not None and row[0] == first[0]:
                split(row, first)
            elif held and row[0] == held[0][0]:
                held.append(row)
                if len(held) > TOGETHER:
                    first = held[0]
                    for r in held:
                        split(r, first)
                    held = []
            else:
                close(held)
                held, first = [row], None
            yield from drained(4096)
    close(held)
    yield from drained(1)


def _among(keys: DataFrame, *columns: str) -> Callable[..., Column]:
    """A condition on columns: false only if no row of ``keys`` has their values.
    (Anchors are least hashes, so keys are hashed again to be spread evenly.)"""
    held = keys.sparkSession.sparkContext.broadcast(_filter(keys.select(F.xxhash64(*columns).alias("h"))))

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        return pd.Series(_passes(held.value, h.to_numpy().view(np.uint64)))

    return lambda *own: passes(F.xxhash64(*own))


def repeated_windows(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """``c1, c2, x0, x1``: windows of segments that occur anywhere else. ``segs``
    may lack segments whose k-gram occurs once."""
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_text", "first", "count", "anchor")
    distinct = written(segs.groupBy("c1", "c2").agg(F.min("gram").alias("gram"), F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "segments-distinct")
    # Written down, as ``found`` is, so that both sides of the join are dealt out by it and a hot key can be split.
    met = written(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("gram"), "segments-met")
    open_ = distinct.join(met, "gram").select("gram", "c1", "c2", "at.*")
    wanted = written(open_.groupBy(F.col("_id").alias("_of"), F.col("_text").alias("_of_text")).agg(F.collect_list(F.struct("gram", "c1", "c2", "first", "count", "anchor")).alias("wanted")), "segments-wanted")
    once = docs.select("text", "_id", "_text").filter(_among(wanted, "_of", "_of_text")("_id", "_text"))

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, wanted in zip(texts(batch), batch.column("wanted").to_pylist()):
            for w in wanted:
                rows.append((w["gram"], 0, PLACES - 1, w["c1"], w["c2"], w["anchor"], text[w["first"] : w["first"] + w["count"] + SIZE - 1]))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], form)

    form = ["key", "low", "high", "c1", "c2", "anchor", "bytes"]
    fetched = once.join(wanted, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_of_text"))).select("text", "wanted")
    rows = fetched.mapInArrow(mapped(fetch), "key long, low int, high int, c1 long, c2 long, anchor int, bytes binary")
    found = distinct.filter("n > 1").select("c1", "c2", F.lit(0).alias("x0"), (F.col("at.count") - 1).alias("x1"))
    while True:
        whole = rows.repartition("key").sortWithinPartitions("key")
        made = written(whole.mapInArrow(_compared, "key long, low int, high int, c1 long, c2 long, anchor int, bytes binary, x0 int, x1 int"), "compared")
        found = found.union(made.filter("x0 IS NOT NULL").select("c1", "c2", "x0", "x1"))
        rows = made.filter("x0 IS NULL").select(*form)
        if rows.isEmpty():
            return found


def _joined(ranges: Column) -> Column:
    """``joined`` for an array of structs x0, x1."""

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["x0"].alias("x0"), F.greatest(last["x1"], x["x1"]).alias("x1"))
        return F.when(x["x0"] <= last["x1"] + 1, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<x0:int,x1:int>>"), step)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans`` (array of begin and end, in bytes, of what repeats),
    n_bytes, n_removed, n_spans, ``kept_text`` (what is left, as bytes) and
    kept_sha256.

    A byte goes if a SIZE-byte string that covers it also starts anywhere else
    in any text, the same included. Null texts are empty ones. Repeated rows are
    repeated texts; each of them loses its bytes.
    """
    made = ["spans", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"]
    plain, back = hidden(docs.drop(*made), ("doc_id", "text"))
    keyed = plain.withColumns({"_id": F.col("doc_id"), "_text": F.xxhash64("text")})
    kind = docs.schema["doc_id"].dataType.simpleString()
    segs = written(keyed.select("text", "_id", "_text").mapInArrow(mapped(_segment_rows), f"_id {kind}, _text long, gram long, c1 long, c2 long, first int, count int, anchor int"), "segments")
    grams = segs.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    segs = segs.filter(_among(grams, "gram")("gram"))
    found = written(repeated_windows(keyed, segs).groupBy("c1", "c2").agg(_joined(F.collect_set(F.struct("x0", "x1"))).alias("xs")), "repeated")
    # Begin and end of a span in one number, as arrays of structs take four times the room.
    ends = F.transform("xs", lambda x: F.shiftleft((F.col("first") + x["x0"]).cast("long"), 32) + F.col("first") + x["x1"] + SIZE)
    spans = segs.join(found, ["c1", "c2"]).select(F.col("_id").alias("_of"), F.col("_text").alias("_of_text"), F.explode(ends).alias("span"))
    spans = written(spans.groupBy("_of", "_of_text").agg(F.collect_set("span").alias("_spans")), "spans")
    some = _among(spans, "_of", "_of_text")("_id", "_text")
    joined = keyed.filter(some).join(spans, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_of_text")), "left").select(*plain.columns, "_spans")
    joined = joined.union(keyed.filter(~some).select(*plain.columns, F.lit(None).cast("array<long>")))

    names = plain.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, pairs in zip(texts(batch), batch.column("_spans").to_pylist()):
            text, merged = text or b"", []
            for a, b in ((p >> 32, p & 0xFFFFFFFF) for p in sorted(pairs or ())):
                if merged and a <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], b)
                else:
                    merged.append({"begin": a, "end": b})
            ends = [0, *(x for m in merged for x in m.values()), len(text)]
            left = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
            rows.append((merged, len(text), len(text) - len(left), len(merged), left, hashlib.sha256(left).hexdigest()))
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        kinds = [span, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [*names, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields), "spans array<struct<begin:bigint,end:bigint>>, n_bytes long, n_removed long, n_spans long, kept_text binary, kept_sha256 string"])
    return joined.mapInArrow(mapped(cut), schema).select(*back, *made)
