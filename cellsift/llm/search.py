"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time.

Documents are indexed in blocks, which hold posting lists of the queries'
terms. In a block, a query's short lists are summed into accumulators first. These
then count as one more list, whose bound is its greatest sum, beside the long
lists with theirs. Documents are taken in order, some hundred at a time:
lists whose bounds together stay below the worst score that is still wanted
yield no candidates; they are only looked up, by search, for candidates of the
other lists, and those that can't reach that score any more are skipped on the way.
The wanted score carries over from block to block of a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsift.llm.words import texts
from cellsift.session import written

TOP = 20
#: Documents of a block, and how many of a list's candidates are scored together.
BLOCK, STEP = 8192, 512
#: Lists of at most this many postings in a block are summed beforehand.
SHORT = 128
#: Queries are answered in passes over so many bytes of their texts: their terms
#: are sent to all tasks, so this is what bounds the broadcast.
QUERY_BYTES = 8 << 20
#: Factors of the score, fixed by its definition.
SCALE, TF, LENGTH, B = 1_000_000_000, 1000, 12, 25

#: ASCII letters and digits stay, A-Z in lower case, bytes of other characters stay; the rest parts terms.
TERMS = bytes(b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERMS).split()


def index_blocks(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Blocks of documents with the posting lists of ``vocabulary``: places of the
    terms in it (``terms``), where each list ends (``ends``), the documents of the lists
    (``at``, rising in a list) with ``tf``, and by document ``ids`` and ``n``.
    """
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary, 1)})
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["ids", "n", "terms", "ends", "at", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value.get
        for whole in batches:
            for batch in (whole.slice(at, BLOCK) for at in range(0, whole.num_rows, BLOCK)):
                sizes, keep, found, held = [], [], [], []
                for r, text in enumerate(texts(batch)):
                    words = terms(text)
                    if words:
                        some = list(filter(None, map(place, words)))
                        keep.append(r)
                        sizes.append(len(words))
                        held.append(len(some))
                        found += some
                if not keep:
                    continue
                keys, tf = np.unique(np.array(found, np.int64) * BLOCK + np.repeat(np.arange(len(keep)), held), return_counts=True)
                of, ends = np.unique(keys // BLOCK, return_index=True)
                arrays = [np.array(sizes, np.int64), (of - 1).astype(np.int32), np.r_[ends[1:], len(keys)][: len(of)].astype(np.int32), (keys % BLOCK).astype(np.int16), tf.astype(np.int32)]
                ids = batch.column("doc_id").take(pa.array(keep, pa.int64()))
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([listed, *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"{x} binary" for x in names[1:]))


def _statistics(blocks: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the document frequencies of a
    vocabulary of ``size`` terms; each task adds up its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        df = np.zeros(size, np.int64)
        for batch in batches:
            for sizes, of, ends in zip(*(batch.column(c).to_pylist() for c in ("n", "terms", "ends"))):
                sizes = np.frombuffer(sizes, np.int64)
                n, total = n + len(sizes), total + int(sizes.sum())
                df[np.frombuffer(of, np.int32)] += np.diff(np.frombuffer(ends, np.int32), prepend=0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, some]), pa.array(np.r_[n, total, df[some]])], ["term", "n"])

    df, held = np.zeros(size, np.int64), {-2: 0, -1: 0}
    for r in blocks.select("n", "terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the queries
        if r["term"] < 0:
            held[r["term"]] = r["n"]
        else:
            df[r["term"]] = r["n"]
    return held[-2], held[-1], df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def length_norms(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """The m of each document, where the product may exceed 64 bits."""
    if len(sizes) and int(sizes.max()) * B * n >= 1 << 63:
        return np.array([100 - B + (B * x * n) // total for x in sizes.tolist()], np.int64)
    return 100 - B + (B * n * sizes) // total


class Best:
    """The best documents of a query so far. ``least`` is the score that a further
    one needs to reach; an equal score may win by its doc_id."""

    def __init__(self):
        self.rows: list[tuple] = []  # (-score, whether doc_id is null, doc_id)
        self.least = 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows += [(-s, d is None, 0 if d is None else d) for s, d in zip(scores.tolist(), ids)]
        self.rows.sort()
        del self.rows[TOP:]
        if len(self.rows) == TOP:
            self.least = max(1, -self.rows[-1][0])


def search_block(lists: list[tuple[np.ndarray, np.ndarray, int]], best: Best, ids: list) -> None:
    """Adds a block's best documents for one query. ``lists``: documents (rising),
    what the term adds to each, and the greatest of these."""
    if sum(bound for *_, bound in lists) < best.least:
        return
    short = [x for x in lists if len(x[0]) <= SHORT]
    lists = [x for x in lists if len(x[0]) > SHORT]
    if short:  # term at a time
        docs, back = np.unique(np.concatenate([d for d, *_ in short]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, back, np.concatenate([s for _, s, _ in short]))
        lists.append((docs, sums, int(sums.max())))
    lists.sort(key=lambda x: x[2])
    upto = np.cumsum([bound for *_, bound in lists])
    begin, last = 0, max(int(d[-1]) for d, *_ in lists) + 1
    while begin < last:  # document at a time, in steps
        first = int(np.searchsorted(upto, best.least))  # lists before it can't reach the score by themselves
        if first == len(lists):
            return
        leading = lists[first:]
        spans = [int(np.searchsorted(d, begin)) for d, *_ in leading]
        # As far as no leading list has more than STEP documents, so that candidates stay few.
        end = min((int(d[at + STEP]) for at, (d, *_) in zip(spans, leading) if at + STEP < len(d)), default=last)
        stops = [int(np.searchsorted(d, end)) for d, *_ in leading]
        sums = np.zeros(end - begin, np.int64)
        hit = np.zeros(end - begin, bool)
        for a, b, (d, s, _) in zip(spans, stops, leading):
            at = d[a:b] - begin
            sums[at] += s[a:b]  # a list holds a document once
            hit[at] = True
        docs = np.flatnonzero(hit)
        scores, docs = sums[docs], docs + begin
        for k in range(first - 1, -1, -1):
            open_ = scores + upto[k] >= best.least
            docs, scores = docs[open_], scores[open_]
            if not len(docs):
                break
            d, s, _ = lists[k]
            at = np.minimum(np.searchsorted(d, docs), len(d) - 1)
            scores = scores + np.where(d[at] == docs, s[at], 0)
        keep = scores >= best.least
        if keep.any():
            best.add(scores[keep], [ids[i] for i in docs[keep].tolist()])
        begin = end


def ranked(blocks: DataFrame, queries: list[tuple[list[int], list[int]]], weight: np.ndarray, n: int, total: int) -> DataFrame:
    """``query, doc_id, score``: of each task, the best documents for each query,
    which is places in the vocabulary and how often the query has each."""
    sent = blocks.sparkSession.sparkContext.broadcast((queries, weight))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = sent.value
        best = [Best() for _ in queries]
        place = np.full(len(weight), -1)
        ids_kind = None
        for batch in batches:
            ids_kind = batch.schema.field("ids").type.value_type
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].as_py()
                sizes, of, ends, at, tf = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("n", np.int64), ("terms", np.int32), ("ends", np.int32), ("at", np.int16), ("tf", np.int32)))
                if not len(of):
                    continue
                begins, docs, tf = np.r_[0, ends[:-1]], at.astype(np.int64), tf.astype(np.int64)
                adds = SCALE * tf // (TF * tf + LENGTH * length_norms(sizes, n, total)[docs]) * np.repeat(weight[of], ends - begins)
                most = np.maximum.reduceat(adds, begins)
                place[of] = np.arange(len(of))
                for (places, often), found in zip(queries, best):
                    lists = []
                    for t, k in zip(places, often):
                        p = place[t]
                        if p >= 0 and most[p]:
                            a, b, m = begins[p], ends[p], int(most[p])
                            lists.append((docs[a:b], adds[a:b], m) if k == 1 else (docs[a:b], adds[a:b] * k, m * k))
                    if lists:
                        search_block(lists, found, ids)
                place[of] = -1
        rows = [(q, None if none else d, -s) for q, found in enumerate(best) for s, none, d in found.rows]
        if rows:
            query, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, ids_kind), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    return blocks.mapInArrow(run, f"query long, doc_id {kind}, score long")


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the TOP documents of each item with a
    score above 0, best first, equal scores by doc_id (null last).

    Null texts have no terms. Every row of ``docs`` is a document of its
    own. Items equal in item_id and text are one; those equal in item_id
    alone are ranked each for itself. Without documents or items there are no rows.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // QUERY_BYTES)
    for k in range(passes):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        counted = [Counter(terms(r["text"].encode())) for r in some]
        vocabulary = sorted({t for c in counted for t in c})
        if not vocabulary:
            continue
        place = {t: i for i, t in enumerate(vocabulary)}
        blocks = written(index_blocks(docs, vocabulary), "postings")
        n, total, df = _statistics(blocks, len(vocabulary))
        if not n:
            continue
        queries = [([place[t] for t in c], list(c.values())) for c in counted]
        found = ranked(blocks, queries, weights(n, df), n, total)
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP)
        names = docs.sparkSession.createDataFrame([(q, r["item_id"]) for q, r in enumerate(some)], f"query long, item_id {kind}")
        out = out.union(top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))  # as bounded as a pass
    return out
