"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, so a question with other
parameters keeps its template. Windows of a template are hashed and joined with
those of the benchmark; what joins is lined up by item and offset, and over the
longest stretch the slots must fit: a value always stands for the same value of
the item, and the other way round.

Items that templates can't hold against any copy (short ones, ones mostly of
numbers or names, texts without blanks) are looked for whole: all their pieces,
in order, as they are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.llm.words import Memo, hidden, portions, released, texts
from cellsift.session import small_side, written

WINDOW = 8
#: So many of a window's words must be literal ones.
SEED = 3
#: So many words of a stretch must be literal ones, of STRETCH tokens and of fewer.
LITERAL, FEW_LITERAL = 7, 5
#: Tokens of a matching stretch from which on a text counts as contaminated;
#: for an item with fewer tokens, all of them.
STRETCH = 13
#: Bits of the filter that texts' windows pass before they are joined: 8 MB,
#: however large the benchmark is.
FILTER_BITS = 26
#: Texts are read together up to so many bytes.
BLOCK_BYTES = 1 << 20
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Readings of a text: names as slots; names as words, for copies in another case;
#: capitalised words at sentence starts as slots too, for sentences that open with a name.
READINGS = NAMED, WORDS, STARTS = 1, 2, 4

# Units of measure, lower case.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb oz ml cl l gal s sec min h hr hrs day days week weeks month months year years % $ € £ usd eur gbp mph kmh km/h m/s °c °f k w kw kwh v a hz khz mhz ghz b kb mb gb tb dollars euros cents meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres hours minutes seconds percent".split())
_NUMBER = re.compile(r"[-+]?\d[\d.,:/]*")
_GLUED = re.compile(r"([-+]?\d[\d.,:/]*)(\D+)")
_EDGE = re.compile(r"^[^\w%$€£°+-]+|[^\w%$€£°]+$")
_MIX = (np.random.default_rng(8).integers(0, 1 << 63, 8, np.uint64) << np.uint64(1)) | np.uint64(1)
#: Scripts that are written without blanks: each of their characters is a piece.
_NO_BLANKS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_NO_BLANKS}]")
#: Pieces: such characters, words, and signs that are no punctuation.
_PIECE = re.compile(f"[{_NO_BLANKS}]|[^\\W{_NO_BLANKS}]+|[^\\w\\s.,;:!?'\"()\\[\\]\u2018-\u201f\u2026\u3000-\u3003\u3008-\u3011\uff01\uff08\uff09\uff0c\uff0e\uff1a\uff1b\uff1f]")
#: Letters below this one have one letter as their lower case, and blanks between words.
SINGLE = "\u0130"
#: Factor of a span's hash, and its inverse modulo 2**64.
_BASE = _MIX[2] | np.uint64(1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: What stands for a slot of each kind in a template.
_SLOT = np.random.default_rng(9).integers(1, 1 << 63, 4, np.uint64)


def _word(text: str) -> tuple[int, int, bool, bool, bool]:
    """Hash of the bare lower-case word, kind by itself, whether it may be a name
    or a unit, and whether a sentence ends with it. Hash 0: no word at all."""
    bare = _EDGE.sub("", text)
    low = bare.lower()
    ends = text[-1] in ".!?:;" or text[-1] in "\"')]" and text[-2:-1] in (".", "!", "?")
    if not low:
        return 0, PLAIN, False, False, ends
    number = _NUMBER.fullmatch(low) is not None
    glued = _GLUED.fullmatch(low)
    number = number or bool(glued) and glued[2] in UNITS
    name = len(bare) > 1 and bare[0].isupper() and bare[1:].islower()
    return xxhash.xxh3_64_intdigest(low.encode()) or 1, NUMBER if number else PLAIN, name, low in UNITS, ends


def _piece_hash(piece: str) -> int:
    return xxhash.xxh3_64_intdigest(piece.encode())


class Block:
    """Tokens of several texts, one after the other, and where each text's begin."""

    def __init__(self, kind, value, opens, text, texts: int):
        self.kind, self.value, self.opens, self.text = kind, value, opens, text
        self.sizes = np.bincount(text, minlength=texts)
        self.first = np.cumsum(self.sizes) - self.sizes


class Canonical:
    """Templates and pieces of texts, from a memo of the words seen."""

    def __init__(self, most: int = 600_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        # Rows and pieces wait in lists until ``_tables`` moves them into arrays.
        self.rows: list[tuple] = []
        self.pieces: list[int] = []
        self.memo = Memo(self._add, self.most)
        self.store, self.flat, self.done, self.flat_done = None, np.empty(1 << 16, np.uint64), 0, 0

    def _add(self, raw: bytes) -> int:
        text, begin = raw.decode(), self.flat_done + len(self.pieces)
        bare = text if text.isalpha() else text[:-1]
        if bare.isalpha() and (bare is text or text[-1] in ".,;:!?") and max(bare) < SINGLE:
            # Letters and at most one stop, as most words are: the bare word is its only piece.
            low = bare.lower()
            h = _piece_hash(low)
            name = len(bare) > 1 and bare[0].isupper() and bare[1:].islower()
            self.rows.append((h or 1, PLAIN, name, low in UNITS, text[-1] in ".!?:;", begin, 1))
            self.pieces.append(h)
        else:
            found = [_piece_hash(p) for p in _PIECE.findall(text.lower())]
            self.rows.append((*_word(text), begin, len(found)))
            self.pieces += found
        return self.done + len(self.rows) - 1

    def _tables(self) -> list[np.ndarray]:
        """The memo's rows as arrays that grow by doubling."""
        if self.rows:
            kinds = (np.uint64, np.int64, bool, bool, bool, np.int64, np.int64)
            upto, flat_upto = self.done + len(self.rows), self.flat_done + len(self.pieces)
            if self.store is None or upto > len(self.store[0]):
                grown = [np.empty(max(1 << 16, 2 * upto), t) for t in kinds]
                for g, old in zip(grown, self.store or ()):
                    g[: self.done] = old[: self.done]
                self.store = grown
            for g, c in zip(self.store, zip(*self.rows)):
                g[self.done : upto] = np.array(c, g.dtype)
            if flat_upto > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.flat_done], np.empty(2 * flat_upto - self.flat_done, np.uint64)])
            self.flat[self.flat_done : flat_upto] = np.array(self.pieces, np.uint64)
            self.done, self.flat_done, self.rows, self.pieces = upto, flat_upto, [], []
        return self.store

    def read(self, texts: list[bytes]) -> tuple[Block, np.ndarray, np.ndarray]:
        """The tokens of some texts; and their pieces, with the text of each."""
        if len(self.memo) > self.memo.most:
            self.clear()
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(self.memo.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        if not len(ids):
            return Block(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool), text, len(texts)), np.empty(0, np.uint64), text
        value, kind, name, unit, ends, begin, count = (c[ids] for c in self._tables())
        start = np.r_[True, ends[:-1] | (text[1:] != text[:-1])]
        name &= kind == PLAIN
        kind[name & ~start] = NAME
        real = value != 0
        value, kind, unit, opens, of = value[real], kind[real], unit[real], (name & start)[real], text[real]
        if len(kind):
            after = np.r_[False, (kind[:-1] == NUMBER) & (of[1:] == of[:-1])]
            kind[unit & after & (kind == PLAIN)] = UNIT
        upto = np.cumsum(count)
        at = np.repeat(begin - (upto - count), count) + np.arange(upto[-1])
        return Block(kind, value, opens & (kind == PLAIN), of, len(texts)), self.flat[at], np.repeat(text, count)

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind and hash of each token of a text, and whether it is a capitalised
        word at a sentence's start."""
        block = self.read([text])[0]
        return block.kind, block.value, block.opens


def windows(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hashes of a template's windows, before they are mixed."""
    template = np.where(kind == PLAIN, value, _SLOT[kind])
    n = len(kind) - WINDOW + 1
    h = template[:n] * _MIX[0]
    for i in range(1, WINDOW):
        h += template[i : i + n] * _MIX[i]
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h *= _MIX[0]
    return h ^ h >> np.uint64(29)


def readings(block: Block, bits: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of windows with the bits of the readings that have them, their places in the block, and the
    slots' values (zero for literal words) of all its tokens. With ``bits`` only windows whose bit is set.

    One reading is hashed in full; the others differ from it in the windows of a slot alone.
    """
    n = len(block.kind) - WINDOW + 1
    if n < 1:
        return
    words = np.where(block.kind == NAME, PLAIN, block.kind)
    whole = block.text[WINDOW - 1 :] == block.text[:n]
    raw = windows(words, block.value)
    names, opens = block.kind == NAME, block.opens
    named, opened = (np.convolve(x, np.ones(WINDOW, np.int8), "valid") > 0 for x in (names, opens))
    for k, (extra, own) in enumerate(((None, whole), (names, whole & named), (names | opens, whole & opened))):
        if not own.any():
            continue
        kind, h = words, raw
        if extra is not None:
            kind, h = np.where(extra, NAME, words), raw.copy()
            at = np.flatnonzero(extra)
            change = _SLOT[NAME] - block.value[at]
            for i in range(WINDOW):
                to = at - i
                some = (to >= 0) & (to < n)
                h[to[some]] += change[some] * _MIX[i]
        literal = np.cumsum(np.r_[0, kind == PLAIN])
        place = np.flatnonzero(own & (literal[WINDOW:] - literal[:-WINDOW] >= SEED))
        h = _mixed(h[place])
        if bits is not None:
            some = _passes(bits, h)
            h, place = h[some], place[some]
        read = np.full(len(h), (WORDS, NAMED, STARTS)[k])
        if k < 2:
            read |= np.where(opened[place], 0, STARTS) if k else np.where(named[place], 0, NAMED) | np.where(named[place] | opened[place], 0, STARTS)
        yield read, h, place, np.where(kind == PLAIN, np.uint64(0), block.value)


def _hit_rows(keys: list[str], bits: np.ndarray | None, sizes: np.ndarray, filters: tuple | None):
    """mapInArrow: ``keys``, n_tokens and hash, place, readings and slots of each window;
    with ``bits``, of those windows alone whose bit is set. And, with place -1, the hashes of spans as
    long as one of ``sizes`` that pass the ``filters`` of whole items. Texts are read
    once for both, many at a time."""
    made = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "c" not in made:
            made["c"] = Canonical()
        for batch in batches:
            for part in portions(batch, 10_000, BLOCK_BYTES):
                yield one(part)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, found, of = made["c"].read([t or b"" for t in texts(batch)])
        rows, tokens, hashes, places, read, slots = ([] for _ in range(6))
        for bit, h, place, held in readings(block, bits):
            row = block.text[place]
            rows.append(row)
            tokens.append(block.sizes[row])
            hashes.append(h)
            places.append(place - block.first[row])
            read.append(bit)
            slots.append(held[place[:, None] + np.arange(WINDOW)].ravel())
        n = sum(map(len, rows))
        if len(sizes):
            for row, h in span_hits(found, of, sizes, filters):
                rows.append(row)
                hashes.append(h)
        whole = sum(map(len, rows)) - n
        join = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)]).astype(kind)
        longs = [np.concatenate([join(c, np.int64), np.full(whole, fill)]) for c, fill in ((tokens, 0), (places, -1), (read, 0))]
        ends = np.concatenate([np.arange(n + 1) * WINDOW, np.full(whole, n * WINDOW)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(join(slots, np.uint64).view(np.int64)))
        taken = pa.array(join(rows, np.int64))
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in keys), pa.array(longs[0]), pa.array(join(hashes, np.uint64).view(np.int64)), pa.array(longs[1]), pa.array(longs[2]), lists], [*keys, "n_tokens", "h", "place", "readings", "slots"])

    return run


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _filter(windows: DataFrame, column: str = "h") -> np.ndarray:
    """The filter's bits: a bitmap of fixed size from all windows of the benchmark."""
    at = F.shiftrightunsigned(column, 64 - FILTER_BITS) + 1  # bit 0 of bucket 1 stands for 1
    parts = windows.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for r in parts.collect():  # at most 2**FILTER_BITS / 2**15 rows of 4 KB
        bits[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``_id, _text, item_id, span, same_values`` for each text and item whose
    templates match over a stretch of ``span`` tokens with slots that fit, or that
    holds all ``span`` pieces of an item of ``whole_items``, in order.

    ``docs`` has _id, _text and text. Items without a piece (null, blanks,
    punctuation alone) match nothing.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = "n_tokens long, h long, place long, readings long, slots array<long>"
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_hit_rows(["item_id"], None, np.empty(0, np.int64), None), f"item_id {kind}, {rows}")
    items = written(items.select("item_id", "h", F.col("place").alias("item_place"), F.col("readings").alias("item_readings"), F.col("slots").alias("item_slots"), F.col("n_tokens").alias("item_tokens")).distinct(), "benchmark-windows")
    whole = written(whole_items(benchmark), "whole-items")
    sizes = np.array(sorted(r["size"] for r in whole.select("size").distinct().collect()), np.int64)  # a row for each length of an item
    held = spark.sparkContext.broadcast((_filter(items), (_filter(whole, "anchor"), _filter(whole)) if len(sizes) else None))
    keys = ["_id", "_text"]
    own = docs.schema["_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _hit_rows(keys, held.value[0], sizes, held.value[1])(batches)
        released()

    hit = written(docs.select("text", *keys).mapInArrow(found, f"_id {own}, _text long, {rows}"), "benchmark-hits")
    held_whole = hit.filter("place < 0").select(*keys, "h").distinct().join(small_side(whole), "h")
    held_whole = held_whole.select(*keys, "item_id", F.col("size").alias("span"), F.lit(True).alias("same_values"))
    hits = hit.filter("place >= 0").join(small_side(items), "h")
    lined = hits.groupBy(*keys, "item_id", (F.col("place") - F.col("item_place")).alias("offset")).agg(
        F.max("item_tokens").alias("item_tokens"), F.collect_set(F.struct("item_place", "slots", "item_slots", F.col("readings").bitwiseAND(F.col("item_readings")).alias("readings"))).alias("w")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, spans, same = [], [], []
            for r, (tokens, windows) in enumerate(zip(batch.column("item_tokens").to_pylist(), batch.column("w").to_pylist())):
                # By each reading alone, and by all: names of one may not fit where another's do.
                ways = [windows, *([w for w in windows if w["readings"] & r] for r in READINGS)]
                span, equal = max(best_stretch(w, LITERAL, FEW_LITERAL) for w in ways)
                if span >= min(STRETCH, tokens):
                    keep.append(r)
                    spans.append(span)
                    same.append(equal)
            taken = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in (*keys, "item_id")), pa.array(spans, pa.int64()), pa.array(same, pa.bool_())], [*keys, "item_id", "span", "same_values"])

    return lined.mapInArrow(judge, f"_id {own}, _text long, item_id {kind}, span long, same_values boolean").union(held_whole)


def best_stretch(windows: list[dict], literal: int = 0, few: int = 0) -> tuple[int, bool]:
    """Tokens of the longest stretch that windows cover without a hole, whose slots fit, and
    whether all its slots hold the same values. A stretch ends at a hole
    or where a value would have to stand for two. Stretches with fewer than ``literal``
    words outside of slots (``few`` if shorter than STRETCH) don't count."""
    best, equal = 0, True
    start, last, there, back, same, words = 0, None, {}, {}, True, set()
    for w in sorted(windows, key=lambda w: w["item_place"]):
        pairs = [(a, b) for a, b in zip(w["slots"], w["item_slots"]) if a or b]
        fits = all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs)
        if last is None or w["item_place"] > last + WINDOW or not fits:
            start, there, back, same, words = w["item_place"], {}, {}, True, set()
        fresh = {}
        if any(fresh.setdefault(a, b) != b for a, b in pairs) or len(set(fresh.values())) < len(fresh):
            last = None  # it doesn't fit even by itself
            continue
        there |= fresh
        back |= {b: a for a, b in fresh.items()}
        same &= all(a == b for a, b in pairs)
        last = w["item_place"]
        words |= {last + i for i, b in enumerate(w["item_slots"]) if not b}
        span = last - start + WINDOW
        if span > best and len(words) >= (literal if span >= STRETCH else few):
            best, equal = span, same
    return best, equal


def _spans(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers from which ``_span_hash`` takes any span's hash."""
    powers = np.full(len(found), _BASE)
    powers[:1] = 1
    sums = np.r_[np.uint64(0), np.cumsum(found * np.cumprod(powers))]
    back = np.full(len(found) + 1, _BACK)
    back[0] = 1
    return sums, np.cumprod(back)


def _span_hash(sums: np.ndarray, back: np.ndarray, place: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    h = (sums[place + size] - sums[place]) * back[place] + np.asarray(size, np.uint64) * _MIX[1]
    h ^= h >> np.uint64(31)
    h *= _MIX[0]
    return h ^ h >> np.uint64(29)


def span_hits(found: np.ndarray, of: np.ndarray, sizes: np.ndarray, filters: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts and hashes of the spans, as long as one of ``sizes``, that may be whole
    items: places where the first pieces of an item may stand are tried with each length."""
    anchors, bits = filters
    spans = _spans(found)
    end = np.searchsorted(of, of, side="right")  # where the text of each piece ends
    at = np.arange(len(found))
    for first in np.unique(np.minimum(sizes, WINDOW)).tolist():
        place = at[at + first <= end]
        place = place[_passes(anchors, _span_hash(*spans, place, first))]
        for size in sizes[np.minimum(sizes, WINDOW) == first].tolist() if len(place) else ():
            some = place[place + size <= end[place]]
            h = _span_hash(*spans, some, size)
            hit = _passes(bits, h)
            yield of[some[hit]], h[hit]


def _held_by_templates(canonical: Canonical, text: bytes) -> bool:
    """Whether templates find each copy of an item, also one whose first word is
    read in another way for what stands before it."""
    kind = canonical.tokens(text)[0]
    kind = np.where(kind == NAME, PLAIN, kind)
    literal = np.cumsum(np.r_[0, kind == PLAIN])
    place = np.flatnonzero(literal[WINDOW:] - literal[:-WINDOW] >= SEED) if len(kind) >= WINDOW else np.empty(0, np.int64)
    if not len(place):
        return False
    runs = np.split(place, np.flatnonzero(np.diff(place) > WINDOW) + 1)
    return any(r[-1] + WINDOW - r[0] > STRETCH and np.count_nonzero(kind[r[0] + 1 : r[-1] + WINDOW] == PLAIN) >= LITERAL for r in runs)


def whole_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, size, anchor, h`` of the items that templates may miss: how many
    pieces, the hash of the first ones and of all."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        for batch in batches:
            out = []
            for r, text in enumerate(texts(batch)):
                if not text or (_held_by_templates(canonical, text) and not _UNSPACED.search(text.decode())):
                    continue
                found = canonical.read([text])[1]
                if len(found):
                    spans, start = _spans(found), np.zeros(1, np.int64)
                    first, all_of = (_span_hash(*spans, start, n).view(np.int64)[0] for n in (min(len(found), WINDOW), len(found)))
                    out.append((r, len(found), first, all_of))
            table = np.array(out, np.int64).reshape(-1, 4)
            rows, *columns = (pa.array(table[:, c].copy()) for c in range(4))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(rows), *columns], ["item_id", "size", "anchor", "h"])

    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(step, f"item_id {kind}, size long, anchor long, h long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_id": F.col("doc_id"), "_text": F.xxhash64("text")})


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, n_items, max_span and reparameterised
    (some item matches with other values) of every document.

    Null and empty texts are clean. Rows equal in doc_id and text get the same
    result, one row for each.
    """
    rows = _keyed(docs.select("doc_id", "text"))
    found = matches(rows, benchmark).groupBy(F.col("_id").alias("_of"), F.col("_text").alias("_of_text")).agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("span").alias("max_span"), F.max(~F.col("same_values")).alias("reparameterised")
    )
    joined = rows.drop("text").join(small_side(found), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_of_text")), "left")
    none = F.array().cast(found.schema["item_ids"].dataType)
    return joined.select(
        "doc_id", F.col("max_span").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"),
        F.coalesce("max_span", F.lit(0)).cast("long").alias("max_span"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, unchanged."""
    plain, back = hidden(docs, ("doc_id", "text"))
    rows = _keyed(plain)
    found = matches(rows, benchmark).select(F.col("_id").alias("_of"), F.col("_text").alias("_of_text")).distinct()
    clean = rows.join(small_side(found), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_of_text")), "left_anti")
    return clean.select(*back)
