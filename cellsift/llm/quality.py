"""Quality rules with limits that adapt to language and source.

Measures of a text become integers; mergeable quantile sketches of them are kept
for each language and source. A sketch is a table of counts by value, where
values from 64 on keep their six leading bits (a relative error below 1/32), so
merging two sketches is adding counts, in any order and with the same result.
A text fails if a measure lies beyond the far fence of its group, the upper
quartile plus three times the quartile distance. The spread that a measure has
at least keeps groups of very even texts from rejecting ordinary ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsift.llm.words import BLANKS, hidden, mapped, texts
from cellsift.session import small_side, written

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Least quartile distances: symbols a word and repeated lines in 1/10,000,
#: characters a word in 1/100.
LEAST_SPREAD = {"symbols": 300, "dup_lines": 1200, "word_length": 100}
#: A group of fewer texts takes the limits of its whole language.
LEAST_TEXTS = 50


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a three-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) < 2_000_000:
        keys = (ids[:-2] * len(known) + ids[1:-1]) * len(known) + ids[2:]
    else:
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


def measures(raw: bytes | None) -> tuple[int, ...]:
    raw = raw or b""
    text, words = raw.decode(), raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    chars = len(text) - sum(map(text.count, BLANKS)) if words else 0
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the MEASURES of its text."""
    kept = docs.drop(*MEASURES)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([measures(v) for v in texts(batch)], np.int64).reshape(-1, len(MEASURES))
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in made.T)], [*batch.schema.names, *MEASURES])

    return kept.mapInArrow(mapped(step), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *(f"{m} long" for m in MEASURES)]))


# SQL of the scores: 1/10,000 symbols a word and repeated among all lines, 1/100 characters a word.
SCORES = {
    "symbols": "10000 * n_symbols div greatest(n_words, 1)",
    "dup_lines": "10000 * n_dup_lines div greatest(n_lines, 1)",
    "word_length": "100 * word_chars div greatest(n_words, 1)",
}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _group(name: str) -> Column:
    """A text column with its nulls as a value of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def limits(rows: DataFrame) -> DataFrame:
    """``_lang, _source`` and a limit for each score, from all of ``rows``."""
    shift = F.greatest(F.length(F.bin("value")) - 6, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(value, s), s)")
    entries = rows.select("_lang", "_source", F.explode(F.array(*(F.struct(F.lit(k).alias("score"), F.expr(v).alias("value")) for k, v in SCORES.items()))).alias("x"))
    sketch = (
        entries.select("_lang", "_source", "x.*").withColumn("s", shift).withColumn("bucket", bucket)
        .groupBy("_lang", "_source", "score", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )
    sketch = written(sketch, "sketches")

    def fences(table: DataFrame, keys: list[str]) -> DataFrame:
        group = [*keys, "score"]
        upto = table.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("bucket")))
        of = table.groupBy(*group).agg(F.sum("n").alias("of"))
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("of") * q, F.col("bucket")))
        found = upto.join(of, group).groupBy(*group).agg(at(1).alias("q1"), at(3).alias("q3"), F.max("of").alias("of"))
        spread = F.create_map(*(F.lit(x) for item in LEAST_SPREAD.items() for x in item))[F.col("score")]
        return found.select(*group, "of", (F.col("q3") + 3 * F.greatest(F.col("q3") - F.col("q1"), spread)).alias("limit"))

    merged = sketch.groupBy("_lang", "score", "bucket").agg(F.sum("n").alias("n"))
    wide = fences(merged, ["_lang"]).select("_lang", "score", F.col("limit").alias("wide"))
    own = fences(sketch, ["_lang", "_source"]).join(wide, ["_lang", "score"])
    chosen = F.when(F.col("of") >= LEAST_TEXTS, F.col("limit")).otherwise(F.col("wide"))
    return own.groupBy("_lang", "_source").agg(*(F.max(F.when(F.col("score") == k, chosen)).alias(f"_{k}") for k in SCORES))


def judged(docs: DataFrame, text: bool = True) -> DataFrame:
    """``docs``, with its text or without, and MEASURES, base_failed and kept; written down once on the way.

    Null texts count as empty ones, and null languages and sources as a group
    of their own. Every row comes out once.
    """
    rows = docs.drop("base_failed", "kept").withColumns({"_lang": _group("lang"), "_source": _group("source")})
    rows = written(measured(rows) if text else measured(rows).drop("text"), "measured")
    fits = F.expr(" AND ".join(f"({v}) <= _{k}" for k, v in SCORES.items()))
    scored = rows.join(small_side(limits(rows.select("_lang", "_source", *MEASURES))), ["_lang", "_source"])
    return scored.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & fits}).drop("_lang", "_source", *(f"_{k}" for k in SCORES))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    rows = judged(docs.select("doc_id", "text", "lang", "source"), text=False)
    return rows.select("doc_id", *MEASURES, "base_failed", "kept")


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    plain, back = hidden(docs, ("text", "lang", "source"))
    return judged(plain).filter("kept").select(*back)
