"""Packing into sequences with a fixed mixture of sources.

Deficit round-robin over one queue of tokens for each source: a window grants
each queue its share, whole tokens are taken, and what is left of the share (the
deficit) is carried into the next window. Served in order of the deficits, the
k-th of a queue's n tokens is due at (k + 1/2) / n of the way, so the state at a
window's start follows from its number alone: tasks work on any stretch of the
queues, and deficits carry across windows and partitions without messages.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsift.llm.words import BLANKS, portions, released
from cellsift.session import small_side, written


#: Texts whose words are looked up together, and bytes of them.
TEXTS, TEXT_BYTES = 6000, 2 << 20
#: Forms of words that a worker remembers; beyond, it keeps those of the current batch.
FORMS = 1_000_000
#: What a token ends in where a word ends, in vocabularies that mark it.
WORD_END = "</w>"
#: Words of many kinds, on which it is tried whether a tokenizer takes texts word by word.
PROBE = "The quick BROWN fox's x1 don't A.B end. End, 3.14 (a) naïve Ünïcode ÉTÉ co-op a.b. ... e.g., #tag $5 été. 漢字 😀 <|a|> l'eau _x_ I".split()


class WordEncoder:
    """Ids of a tokenizer whose tokens never span white space. Each word of a
    batch is looked up once, and few forms of words need encoding.

    A form has the ids of all words that stand for it: case doesn't matter, and a
    full stop or comma after a letter is a token of its own. Words with ``<|`` stay
    as they are, as special tokens are told apart by case. Where a tokenizer doesn't
    do so for all words of PROBE, it encodes whole texts.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        #: The forms, without a Python object for each, and by place their ids.
        self.known = pa.array([], pa.string())
        self.ids, self.first, self.size = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.by_words = self._by_words()

    def _by_words(self) -> bool:
        """Whether forms of words give the ids of texts, on the probe."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        small = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
        forms = [[w] if "<|" in w else [small(w)[:-1], w[-1]] if re.search("[A-Za-z][.,]$", w) else [small(w)] for w in PROBE]
        want = [i for form in forms for part in form for i in ids(part)]
        if any(ids(blank + (2 * blank).join(PROBE) + blank) != want for blank in BLANKS):
            return False
        plain = [ids(w.lower()) for w in PROBE if w.isascii() and w.isalpha()]
        return not self.ends.any() or all(self.ends[w].sum() == 1 and self.ends[w[-1]] for w in plain)

    def _keep(self, forms: pa.Array) -> None:
        """Forget all forms but these."""
        place = np.flatnonzero(pc.is_in(self.known, value_set=forms).to_numpy(zero_copy_only=False))
        self.ids, _ = _gathered(self.ids, self.first, self.size, place)
        self.size, self.known = self.size[place], self.known.take(pa.array(place))
        self.first = np.cumsum(self.size) - self.size

    def _encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The ids of some words, and how many each has."""
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [x.ids for x in found]
        return [i for some in ids for i in some], list(map(len, ids))

    def _encode_plain(self, words: list[str], line: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of ASCII letters, each of which ends at a token with
        ``WORD_END``, so that many are encoded as one text."""
        ids = np.array(self._encode([" ".join(words[i : i + line]) for i in range(0, len(words), line)])[0], self.kind)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def places(self, forms: pa.Array) -> np.ndarray:
        """Where the forms stand among those known (else: -1). Only the forms are
        hashed: a table of all that is known would take several times its size."""
        form = pc.index_in(self.known, value_set=forms)
        known = np.flatnonzero(form.is_valid().to_numpy(zero_copy_only=False))
        found = np.full(len(forms), -1, np.int64)
        found[form.drop_null().to_numpy()] = known
        return found[pc.index_in(forms, value_set=forms).to_numpy()]  # of equal forms the first is found

    def learn(self, forms: pa.Array, block: int = 10_000) -> None:
        """Encode the forms that are not known yet."""
        lacking = forms.filter(pa.array(self.places(forms) < 0)).unique()
        if not len(lacking):
            return
        plain = pc.and_(pc.match_substring_regex(lacking, "^[A-Za-z]+$"), bool(self.ends.any()))
        known, ids, size = [self.known], [self.ids], [self.size]
        for words, encode in ((lacking.filter(plain), self._encode_plain), (lacking.filter(pc.invert(plain)), self._encode)):
            known.append(words)
            for i in range(0, len(words), block):
                some, n = encode(words.slice(i, block).to_pylist())
                ids.append(np.array(some, self.kind))
                size.append(np.array(n, np.int64))
        self.known, self.ids, self.size = pa.concat_arrays(known), np.concatenate(ids), np.concatenate(size)
        self.first = np.cumsum(self.size) - self.size

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one after the other, and how many each has."""
        special = pc.match_substring(words, "<|")
        low = pc.if_else(special, words, pc.ascii_lower(words))
        marked = pc.and_not(pc.match_substring_regex(low, "[a-z][.,]$"), special)
        form = pc.if_else(marked, pc.utf8_slice_codeunits(low, 0, -1), low).dictionary_encode()
        forms = pa.concat_arrays([form.dictionary.cast(pa.string()), pa.array([".", ","])])
        if len(self.known) + len(forms) > FORMS:
            self._keep(forms)
        self.learn(forms)
        places = self.places(forms)
        place, (stop, comma) = places[form.indices.to_numpy()], places[-2:]
        mark = np.where(pc.ends_with(low, ".").to_numpy(zero_copy_only=False), stop, comma)
        parts = 1 + marked.to_numpy(zero_copy_only=False).astype(np.int64)
        both, last = np.repeat(place, parts), np.cumsum(parts) - 1
        both[last[parts == 2]] = mark[parts == 2]
        ids, upto = _gathered(self.ids, self.first, self.size, both)
        return ids, np.diff(upto[last + 1], prepend=0)

    def encode(self, column: pa.Array, end: int, block: int = 1000) -> Iterator[bytes]:
        """The ids of each text (null: empty) of a string column, and ``end``."""
        if not self.by_words:
            for at in range(0, len(column), 64):
                some = pc.fill_null(column.slice(at, 64), "").to_pylist()
                for found in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                    yield np.array([*found.ids, end], self.kind).tobytes()
            return
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        table, size = self._words(coded.dictionary)
        first = np.cumsum(size) - size
        last = np.array([end], self.kind).tobytes()
        for at in range(0, len(column), block):
            bounds = offsets[at : at + block + 1]
            ids, upto = _gathered(table, first, size, index[bounds[0] : bounds[-1]])
            raw, cut = memoryview(ids.tobytes()), upto[bounds - bounds[0]] * self.kind.itemsize
            for a, b in zip(cut[:-1], cut[1:]):
                yield bytes(raw[a:b]) + last


def _gathered(ids: np.ndarray, first: np.ndarray, size: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids at some places one after the other, and where each place's begin."""
    n = size[places]
    upto = np.r_[0, np.cumsum(n)]
    return ids[np.repeat(first[places] - upto[:-1], n) + np.arange(upto[-1])], upto


@functools.cache
def encoder(file: str) -> WordEncoder:
    """The encoder of this worker; what it knows serves all tasks that it runs."""
    return WordEncoder(file)


def encoded(docs: DataFrame, file: str, end: int, name: str) -> DataFrame:
    """``doc_id, source, part, before, n, ids``: the ids of each text, and how
    many tokens of its source come before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, used = encoder(file), TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in portions(whole, TEXTS, TEXT_BYTES):
                ids, before, n = list(coder.encode(batch.column("text"), end)), [], []
                for found, source in zip(ids, batch.column("source").to_pylist()):
                    n.append(len(found) // coder.kind.itemsize)
                    before.append(used.get(source, 0))
                    used[source] = before[-1] + n[-1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "part", "before", "n", "ids"])
                del ids
                released()

    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", F.col("text").cast("string").alias("text"), source).mapInArrow(run, f"doc_id {kind}, source string, part int, before long, n long, ids binary"), name)


class Mixture:
    """The order in which the tokens of several queues are served.

    ``totals``: tokens of each queue; ``weights``: shares while a queue lasts
    (default: the totals, so that all end together). A phase lasts until a queue
    with a share runs out.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        left = np.array(totals, np.int64)
        share = np.array(totals if weights is None else weights, float)
        self.phases, at, done = [], 0, np.zeros(len(left), np.int64)
        while left.any():
            on = (left > 0) & (share > 0)
            if not on.any():  # queues without a share come last
                share, on = np.where(left > 0, 1.0, 0.0), left > 0
            turns = np.min(left[on] / share[on])
            take = np.where(on, np.minimum(left, np.floor(turns * share).astype(np.int64)), 0)
            out = on & (left / np.where(share > 0, share, 1) <= turns)
            take[out] = left[out]
            self.phases.append((at, take, done.copy()))
            at, done, left = at + int(take.sum()), done + take, left - take
        self.total, self.queues = at, len(done)

    def served(self, places: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first ``places`` tokens: a row for each place."""
        places = np.minimum(places, self.total)
        out = np.zeros((len(places), self.queues), np.int64)
        for at, take, done in self.phases:
            here = (places >= at) & (places <= at + take.sum())
            if here.any():
                use = np.flatnonzero(take)
                rows = np.tile(done, (int(here.sum()), 1))
                rows[:, use] += self._rank(places[here] - at, take[use])
                out[here] = rows
        return out

    @staticmethod
    def _rank(r: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the r tokens that are due first, how many each queue gives."""
        c = np.clip(np.rint(r[:, None] * (n / n.sum())).astype(np.int64), 0, n)
        rows = np.arange(len(r))
        while True:
            following = np.where(c < n, (c + 0.5) / n, np.inf)
            latest = np.where(c > 0, (c - 0.5) / n, -np.inf)
            first = following.argmin(axis=1)  # ties: the earlier queue
            last = len(n) - 1 - latest[:, ::-1].argmax(axis=1)  # ties: the later queue
            gap = r - c.sum(axis=1)
            near, far = following[rows, first], latest[rows, last]
            swap = (gap == 0) & ((near < far) | (near == far) & (first < last))
            add, drop = (gap > 0) | swap, (gap < 0) | swap
            if not (add.any() or drop.any()):
                return c
            c[rows[add], first[add]] += 1
            c[rows[drop], last[drop]] -= 1


def pack(docs: DataFrame, file: str, length: int = 2048, end: int = 1, weights: dict[str | None, float] | None = None, queues: int = 256, ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source, and with ``ids`` the token ids.

    A document is the ids of its text (null: empty) and the id ``end``. Every
    sequence but the last is filled to ``length``; pieces of a sequence lie
    without gaps, queue by queue. Sources that ``weights`` names and the ``queues`` - 1 with
    most tokens have a queue of their own. All others share one, which has their documents in the
    order in which their own queues would serve them, so each source is spread
    evenly there too; a source without a weight is served after those with one.
    Repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    table = encoded(docs, file, end, "encoded")
    blocks = written(table.groupBy("source", "part").agg(F.sum("n").alias("tokens")), "blocks")
    sums = blocks.groupBy("source").agg(F.sum("tokens").alias("total"))
    named = {"" if k is None else f"={k}": v for k, v in (weights or {}).items()}
    own = {r["source"]: r["total"] for r in sums.orderBy(F.desc("total"), "source").limit(queues - 1).collect()}
    if named:
        own |= {r["source"]: r["total"] for r in sums.filter(F.col("source").isin(list(named))).collect()}
    names = sorted(own)
    rest = (blocks.agg(F.sum("tokens")).first()[0] or 0) - sum(own.values())
    mixture = Mixture([*(own[x] for x in names), rest], None if weights is None else [named.get(x, 0.0) for x in names] + [0.0])
    place = F.array_position(F.array(*(F.lit(x) for x in names)).cast("array<string>"), F.col("source")) - 1
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = blocks.withColumns({"queue": place.cast("int"), "base": F.coalesce(F.sum("tokens").over(earlier), F.lit(0))}).drop("tokens")
    columns = ["doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids"]
    rows = table.join(small_side(based.filter("queue >= 0")), ["source", "part"]).select(*columns)
    if rest:
        rows = rows.union(_interleaved(table, based.filter("queue < 0").join(sums, "source"), len(names)).select(*columns))
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _pieces(batch, mixture, length, ids)
        released()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string{extra}"
    return rows.mapInArrow(run, schema)


def _interleaved(table: DataFrame, based: DataFrame, queue: int) -> DataFrame:
    """The documents of all sources of ``based`` as one queue, a document where its
    middle token is due: a Spark sort, and running sums of its partitions."""
    due = (F.col("base") + F.col("before") + F.col("n") / 2) / F.col("total")
    order = ["due", "source", "part", "before"]
    sorted_ = table.join(small_side(based.drop("queue")), ["source", "part"]).withColumn("due", due).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            before = used + np.cumsum(n) - n
            used += int(n.sum())
            columns = [*(batch.column(c) for c in ("doc_id", "source", "n", "ids")), pa.array(np.full(len(n), part, np.int32)), pa.array(before)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n", "ids", "part", "before"])

    kind = table.schema["doc_id"].dataType.simpleString()
    ranged = written(sorted_.mapInArrow(run, f"doc_id {kind}, source string, n long, ids binary, part int, before long"), "interleaved")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("tokens"))  # a row for each range
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    return ranged.join(small_side(base), "part").withColumn("queue", F.lit(queue))


def _pieces(batch: pa.RecordBatch, mixture: Mixture, length: int, with_ids: bool, block: int = 4096) -> Iterator[pa.RecordBatch]:
    queue, at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("queue", "at", "n"))
    raw = batch.column("ids").to_pylist()
    windows = -(-mixture.total // length)
    for q in np.unique(queue):
        mine = np.flatnonzero(queue == q)
        mine = mine[np.argsort(at[mine])]
        first = i = 0
        while i < len(mine):
            first = max(first, _window_of(mixture, int(q), int(at[mine[i]]), length, windows))
            bounds = mixture.served(np.arange(first, min(first + block, windows) + 1) * length)
            own, lead = bounds[:, q].tolist(), np.diff(bounds, axis=0)[:, :q].sum(axis=1).tolist()
            out, cut = [], []
            while i < len(mine) and at[mine[i]] < own[-1]:
                r = int(mine[i])
                begin, tokens = int(at[r]), int(n[r])
                a, b = max(begin, own[0]), min(begin + tokens, own[-1])
                data = np.frombuffer(raw[r], f"<u{len(raw[r]) // tokens}").astype("<u4")
                view = memoryview(data.tobytes())
                w = bisect_right(own, a) - 1
                while a < b:
                    stop = min(b, own[w + 1])
                    if stop > a:
                        s, e = a - begin, stop - begin
                        out.append((r, s, e - s, zlib.crc32(view[4 * s : 4 * e]), first + w, lead[w] + a - own[w]))
                        if with_ids:
                            cut.append(data[s:e])
                    a, w = stop, w + 1
                if begin + tokens > own[-1]:
                    break
                i += 1
            table = np.array(out, np.int64).reshape(-1, 6)
            rows = table[:, 0]
            start, size, crc, sequence, offset = (pa.array(table[:, c].copy()) for c in range(1, 6))
            source = pa.array([None if not x else x[1:] for x in batch.column("source").take(pa.array(rows.copy())).to_pylist()], pa.string())
            columns = [batch.column("doc_id").take(pa.array(rows.copy())), start, size, crc, pa.array(n[rows]), sequence, offset, source]
            more = [pa.array(cut, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*columns, *more], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", *(["ids"] if with_ids else [])])
            first += block


def _window_of(mixture: Mixture, q: int, token: int, length: int, windows: int) -> int:
    """The window that a queue's token falls into."""
    low, high = 0, windows
    while high - low > 1:
        mid = (low + high) // 2
        if mixture.served(np.array([mid * length]))[0, q] <= token:
            low = mid
        else:
            high = mid
    return low


def assemble(pieces: DataFrame) -> DataFrame:
    """``sequence_id, tokens, doc_ids``: whole sequences from pieces with ids.
    A sequence has a fixed length, so its group is small."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", F.flatten("p.ids").alias("tokens"), F.col("p.doc_id").alias("doc_ids"))
