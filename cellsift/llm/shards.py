"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised into 2**bits steps of near-equal counts, the rows
are sorted by their index on the curve, and the sorted rows are cut into runs.
Rows of one shard lie close together in every dimension, so the shards' ranges
let a reader skip most of them for a filter on any of the dimensions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cellsift.llm.words import hidden
from cellsift.operators.rank import global_rank
from cellsift.session import written


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with ``bits`` bits per axis
    (Skilling, "Programming the Hilbert curve", 2004)."""
    x = [np.array(a, np.int64) for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x = [a ^ turn for a in x]
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = (index << 1) | ((a >> b) & 1)
    return index


def _number(name: str, low: str | None, high: str | None) -> Column:
    """A text column as a number in the same order: the seven bytes after the
    prefix that its smallest and largest value, and so all, have in common."""
    raw_low, raw_high = (low or "").encode(), (high or "").encode()
    same = next((i for i, (a, b) in enumerate(zip(raw_low, raw_high)) if a != b), min(len(raw_low), len(raw_high)))
    tail = F.substring(F.encode(F.col(name), "UTF-8"), same + 1, 7)
    return F.conv(F.rpad(F.hex(tail), 14, "0"), 16, 10).cast("long")


def hilbert_shards(rows: DataFrame, key: list[str], dims: list[str], shards: int = 40, bits: int = 5, accuracy: int = 2000) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1; counts at most one apart),
    ``slot`` (gapless from 0 in the shard) and the curve index ``hilbert``.

    ``rows`` should be narrow: it is written down and sorted. The order is the
    curve index, then ``key``; rows equal in both can change places without a
    difference in the result. Null values of a dimension lie before all others.
    The steps of a dimension are quantiles of all rows, from mergeable sketches.
    """
    rows = written(rows, "hilbert")
    text = [d for d in dims if isinstance(rows.schema[d].dataType, StringType)]
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *(f(d).alias(f"{p}_{d}") for d in text for f, p in ((F.min, "low"), (F.max, "high")))).first()
    total = ends["n"]
    value = {d: _number(d, ends[f"low_{d}"], ends[f"high_{d}"]) if d in text else F.col(d).cast("double") for d in dims}
    marks = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = rows.agg(*(F.percentile_approx(v, marks, accuracy).alias(d) for d, v in value.items())).first()
    step = {d: reduce(lambda a, b: a + b, [F.when(value[d] > F.lit(m), 1).otherwise(0) for m in sorted(set(found[d] or []))], F.lit(0)) for d in dims}

    @F.pandas_udf("long")
    def index(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([frame[c].to_numpy() for c in frame.columns], bits))

    placed = rows.withColumn("hilbert", index(F.struct(*(F.coalesce(step[d], F.lit(0)).cast("long").alias(f"d{i}") for i, d in enumerate(dims)))))
    ranked = global_rank(placed, ["hilbert", *key], out="_rank")
    n = F.lit(max(total, 1)).cast("decimal(20,0)")
    shard = F.floor(F.col("_rank").cast("decimal(20,0)") * shards / n).cast("int")
    first = F.ceil(F.col("shard").cast("decimal(20,0)") * n / shards).cast("long")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).drop("_rank")


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Law ``rows``: the shards' row counts are at most one apart. The dimensions
    are size, source, lang and doc_id. Null texts have 16 bytes, as empty ones.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = hilbert_shards(rows, ["doc_id", "text_crc32", "size", "source", "lang"], ["size", "source", "lang", "doc_id"], shards)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert", "source", "lang")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Documents as one Parquet folder for each shard, in slot order.

    ``placed`` comes from ``document_shards`` over the same rows and is joined
    by (doc_id, size, crc32); of rows equal in all three, copies are written
    once for each of their places.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = {"_id": F.col("doc_id"), "_size": (F.octet_length(text) + 16).cast("long"), "_crc": F.crc32(text)}
    plain, back = hidden(docs.drop("shard", "slot"), ("doc_id", "text"))
    once = plain.withColumns(keys).dropDuplicates(["_id", "_size", "_crc"])
    to = placed.select(F.col("doc_id").alias("_i"), F.col("size").alias("_s"), F.col("text_crc32").alias("_c"), "shard", "slot")
    joined = once.join(to, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_size") == F.col("_s")) & (F.col("_crc") == F.col("_c")))
    joined.select(*back, "shard", "slot").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
