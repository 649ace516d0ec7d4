"""Audit of how far the sources of a language lie apart, by chi-square terms.

Identical texts of a language are collapsed first: a distinct text travels and is
cut into terms once, with the number of its copies in each source, and adds weighted counts
and document frequencies. A language keeps the terms of MIN_DOCS documents or
more. Each source has add-one frequencies over them, in parts of SCALE.

Pairs are evaluated sparsely. With p0 the frequency of a term that a source
lacks, the sum over all kept terms of f(p, q) = (p - q)**2 div q is

    V f(p0, q0)  +  terms of A: f(p, q0) - f(p0, q0)  +  terms of B: f(p0, q) - f(p0, q0)
    +  terms of both: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The second and third sum need only how many terms a source has of each count, so
that nothing but terms of both meets pair by pair. All is in integers. Sums stay
within a long while a language keeps less than a billion terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsift.llm.words import texts
from cellsift.session import settle, small_side, written

SCALE = 1_000_000_000
#: A language keeps terms that so many of its documents hold.
MIN_DOCS = 3
#: Terms of a group that are reported.
TOP = 200
#: A task sends its counts on when it holds this many.
HELD = 400_000

#: Letters stay, A-Z in lower case, bytes of other characters stay; the rest of ASCII parts terms.
TERMS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Copies are counted above a term's documents in one number.
_HIGH = 1 << 48


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def collapsed(docs: DataFrame) -> DataFrame:
    """``lang, text, copies`` of each distinct text of a language: how often each
    source has it. Copies meet as one row of each task, so a text that
    fills a third of the table is no hot key."""
    key = ["lang", "h1", "h2"]  # 128 bits
    rows = docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(SCALE), "text")}).filter("text != ''")
    once = rows.groupBy(*key).agg(F.first("text").alias("text"))
    counts = rows.groupBy(*key, "source").agg(F.count(F.lit(1)).alias("n"))
    copies = counts.groupBy(*key).agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    return once.join(copies, key).select("lang", "text", "copies")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, count, docs`` of collapsed texts, summed within the task."""
    held: dict[tuple, dict[bytes, int]] = defaultdict(dict)
    size = 0

    def drained() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in held.items():
            both = list(found.values())
            columns = [pa.array(list(found), pa.binary()).cast(pa.string()), pa.array([x // _HIGH for x in both], pa.int64()), pa.array([x % _HIGH for x in both], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(both), pa.string()) for v in (lang, source)), *columns], ["lang", "source", "term", "count", "docs"])
        held.clear()

    for batch in batches:
        for lang, copies, text in zip(batch.column("lang").to_pylist(), batch.column("copies").to_pylist(), texts(batch)):
            found = [(t, c * _HIGH + 1) for t, c in Counter(terms(text)).items()]
            for of in copies:
                table, n = held[lang, of["source"]], of["n"]
                size -= len(table)
                for t, c in found:
                    table[t] = table.get(t, 0) + c * n
                size += len(table)
                if size > HELD:
                    yield from drained()
                    size = 0
    yield from drained()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, lang_count, first`` of the kept terms that a
    source has; ``first`` marks one row of each term. ``docs`` has no nulls."""
    found = collapsed(docs).mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    summed = found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row for each source
    kept = summed.withColumns({"lang_docs": F.sum("docs").over(term), "lang_count": F.sum("count").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return kept.filter(F.col("lang_docs") >= MIN_DOCS).drop("docs", "lang_docs")


def frequency(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """The add-one frequency in parts of SCALE, plus one. Decimals keep large counts exact."""
    count, total, kept = (F.col(x) if isinstance(x, str) else x for x in (count, total, kept))
    up = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", up, F.greatest(total + kept, F.lit(1)).cast("decimal(19,0)"))


def excess(p: Column | str, q: Column | str) -> Column:
    """(p - q)**2 div q."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def pair_values(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each ordered pair of a language's sources.

    ``groups``: lang, source, kept, p0. ``rows``: lang, source, term, p, p0.
    """
    of_a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "kept")
    of_b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = settle(of_a.join(of_b, "lang").filter("a != b").withColumn("none", excess("a0", "b0")))  # as many as are asked for
    kinds = settle(rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")))
    own = kinds.withColumnRenamed("source", "a").join(pairs, ["lang", "a"]).select("lang", "a", "b", (F.col("k") * (excess("p", "b0") - F.col("none"))).alias("value"))
    other = kinds.withColumnRenamed("source", "b").join(pairs, ["lang", "b"]).select("lang", "a", "b", (F.col("k") * (excess("a0", "p") - F.col("none"))).alias("value"))
    left = rows.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("ap"), F.col("p0").alias("a0"))
    right = rows.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("bp"), F.col("p0").alias("b0"))
    change = excess("ap", "bp") - excess("ap", "b0") - excess("a0", "bp") + excess("a0", "b0")
    both = left.join(right, ["lang", "term"]).filter("a != b").groupBy("lang", "a", "b").agg(F.sum(change).alias("value"))
    base = pairs.select("lang", "a", "b", (F.col("kept") * F.col("none")).alias("value"))
    sums = base.union(own).union(other).union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def source_divergence(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` of all groups of lang and source.

    Part ``pair`` has each other source of the lang, part ``term`` the up to TOP
    terms that a source has more often than its lang. Null text, lang and source
    are empty ones. A repeated row counts as often as it occurs. A
    group without terms has no row in ``term``; where a lang keeps no term its pairs
    have value 0; an empty table gives no rows. Equal values go by item, in bytes.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    rows = written(term_counts(docs), "term-counts")
    sizes = rows.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = rows.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.count(F.when(F.col("first"), 1)).alias("kept"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "kept"])
    groups = small_side(groups.withColumn("p0", frequency(F.lit(0), "total", "kept")))
    scored = rows.join(groups, ["lang", "source"]).withColumn("p", frequency("count", "total", "kept"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    q = frequency("lang_count", "lang_total", "kept")
    more = scored.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess("p", "q").alias("value"))
    top = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    pairs = pair_values(groups, scored.select("lang", "source", "term", "p", "p0"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return ranked.union(top)
