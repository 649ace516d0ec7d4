"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter keeps its maximum over the window, and a softmax over the learned
languages follows. A text's prediction is the mean over all its windows, so
every byte of every text takes part. Training runs in numpy on a sample of
bounded, documented size; the network then is a few kilobytes of weights.

Applying it needs no multiplications: a filter of width w is a sum of w table
rows, and tables over byte pairs halve the number of rows to add.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsift.llm.words import hidden, mapped, texts
from cellsift.session import small_side

WINDOW = 256
WIDTHS = (2, 3, 4)
#: Windows follow each other at this stride, so that no four bytes fall between two.
STRIDE = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"


@dataclass
class ByteNet:
    labels: list[str]
    embed: np.ndarray  # 256 x d
    filters: dict[int, np.ndarray]  # width -> width x d x filters
    bias: np.ndarray
    out: np.ndarray  # (widths * filters) x labels
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of filter rows by byte pair: of bytes 0 and 1 for all widths, of
        bytes 2 and 3 for widths 3 and 4."""
        rows = {w: np.matmul(self.embed, f) for w, f in self.filters.items()}  # w x 256 x filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        none = np.zeros_like(rows[3][2])
        first = np.hstack([pair(rows[w][0], rows[w][1]) for w in WIDTHS])
        second = np.hstack([pair(rows[3][2], none), pair(rows[4][2], rows[4][3])])
        return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(second, np.float32)


def windows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts that lie in ``data``: where each begins, and the
    index of its text. A text has one window at least."""
    count = np.maximum(1, -(-(ends - starts) // STRIDE))
    owner = np.repeat(np.arange(len(starts)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return starts[owner] + number * STRIDE, owner


def cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows as rows of bytes; zeros stand beyond a text's end."""
    at = begin[:, None] + np.arange(WINDOW)
    rows = data[np.minimum(at, len(data) - 1)]
    rows[at >= end[:, None]] = 0
    return rows


class Predictor:
    """Window probabilities by table look-up, a few windows at a time."""

    def __init__(self, net: ByteNet, block: int = 64):
        self.net, self.block = net, block
        self.first, self.second = net.tables()

    def windows(self, rows: np.ndarray) -> np.ndarray:
        wide = rows.astype(np.int64)
        pairs = wide[:, :-1] * 256 + wide[:, 1:]
        hidden = self.first[pairs[:, :STRIDE]]
        hidden[:, :, self.first.shape[1] - self.second.shape[1] :] += self.second[pairs[:, 2 : 2 + STRIDE]]
        top = np.maximum(hidden.max(axis=1) + self.net.bias, 0)
        logits = top @ self.net.out + self.net.out_bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def texts(self, values: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text."""
        data = np.frombuffer(b"".join(values) + b"\0", np.uint8)
        ends = np.cumsum([len(v) for v in values])
        starts = ends - [len(v) for v in values]
        begin, owner = windows_of(data, starts, ends)
        total = np.zeros((len(values), len(self.net.labels)))
        for i in range(0, len(begin), self.block):
            some = owner[i : i + self.block]
            odds = self.windows(cut(data, begin[i : i + self.block], ends[some]))
            np.add.at(total, some, odds)
        return total / np.bincount(owner, minlength=len(values))[:, None]


def train(rows: np.ndarray, target: np.ndarray, labels: list[str], dim: int = 8, filters: int = 12, steps: int = 1200, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy of single windows. ``rows``: windows as bytes."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, dim)), "out": rng.normal(0, 0.2, (len(WIDTHS) * filters, len(labels)))}
    p |= {f"f{w}": rng.normal(0, (w * dim) ** -0.5, (w, dim, filters)) for w in WIDTHS}
    p |= {"bias": np.zeros(len(WIDTHS) * filters), "out_bias": np.zeros(len(labels))}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    each = np.arange(batch)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(rows), batch)
        x, y = rows[pick], target[pick]
        e = p["embed"][x]
        best, value = {}, []
        for w in WIDTHS:
            z = sum(e[:, j : j + STRIDE] @ p[f"f{w}"][j] for j in range(w))
            best[w] = z.argmax(axis=1)
            value.append(np.take_along_axis(z, best[w][:, None], 1)[:, 0])
        raw = np.hstack(value) + p["bias"]
        top = np.maximum(raw, 0)
        logits = top @ p["out"] + p["out_bias"]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        odds[each, y] -= 1
        odds /= batch
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["out_bias"] = top.T @ odds, odds.sum(axis=0)
        back = (odds @ p["out"].T) * (raw > 0)
        g["bias"] = back.sum(axis=0)
        for i, w in enumerate(WIDTHS):
            own = back[:, i * filters : (i + 1) * filters]
            for j in range(w):
                seen = x[each[:, None], best[w] + j]
                g[f"f{w}"][j] = np.einsum("bf,bfd->df", own, p["embed"][seen])
                np.add.at(g["embed"], seen, own[:, :, None] * p[f"f{w}"][j].T)
        now = rate * (1 - 0.9 * step / steps)
        for k in p:
            m, v = moments[k]
            m += 0.1 * (g[k] - m)
            v += 0.001 * (g[k] ** 2 - v)
            p[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ByteNet(labels, p["embed"], {w: p[f"f{w}"] for w in WIDTHS}, p["bias"], p["out"], p["out_bias"])


def sample_windows(docs: DataFrame, per_language: int = 600, windows: int = 4, languages: int = 256) -> DataFrame:
    """``lang, window`` of a bounded sample: of each of the ``languages`` most
    frequent languages, ``per_language`` texts with the smallest hash of
    doc_id, and up to ``windows`` evenly spaced windows of each.

    ``docs`` has doc_id, text and lang. A hash bound from the language's count
    thins the rows before they are ranked, so a frequent language doesn't meet
    in one task.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    chance = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    near = usable.withColumn("u", chance).join(small_side(counts), "lang").filter(F.col("u") < F.lit(4.0 * per_language) / F.col("n"))

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for lang, u, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "u", "doc_id")), texts(batch)):
            data = np.frombuffer(text + b"\0", np.uint8)
            begin, _ = windows_of(data, np.array([0]), np.array([len(text)]))
            some = begin[np.unique(np.linspace(0, len(begin) - 1, windows).astype(int))]
            rows.append((lang, u, doc_id, cut(data, some, np.full(len(some), len(text))).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.binary()))], ["lang", "u", "doc_id", "window"])

    cut_up = near.select("lang", "u", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mapped(pick), "lang string, u double, doc_id long, window binary")
    first = Window.partitionBy("lang").orderBy("u", "doc_id", "window")
    return cut_up.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_language)


def learn(docs: DataFrame, **sample) -> ByteNet | None:
    """The network for the labelled rows of ``docs``; None if there are none."""
    rows = sample_windows(docs, **sample).select("lang", "place", "window").collect()
    rows.sort(key=lambda r: (r["lang"], r["place"]))
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    known = {v: i for i, v in enumerate(labels)}
    data = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    target = np.repeat([known[r["lang"]] for r in rows], [len(r["window"]) // WINDOW for r in rows])
    return train(data, target, labels)


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of the text.

    Only the text is looked at. Null texts, texts without a letter, and all
    texts where nothing could be learned are ``und`` with score 0.
    """
    kept, back = hidden(docs.drop("lang_pred", "score"), ("text",))
    back = [c for c, name in zip(back, kept.columns) if name != "text"]
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rest = [f for f in kept.schema.fields if f.name != "text"]
    made = {}

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "p" not in made and net is not None:
            made["p"] = Predictor(net)
        values = texts(batch)
        use = [i for i, yes in enumerate(batch.column("_lettered").to_pylist()) if yes and net is not None]
        label, score = [UNKNOWN] * len(values), [0.0] * len(values)
        if use:
            odds = made["p"].texts([values[i] for i in use])
            for i, k, s in zip(use, odds.argmax(axis=1), odds.max(axis=1)):
                label[i], score[i] = net.labels[k], min(1.0, float(s))
        columns = [batch.column(f.name) for f in rest] + [pa.array(label, pa.string()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, [*(f.name for f in rest), "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "lang_pred string, score double"])
    return kept.withColumn("_lettered", lettered).mapInArrow(mapped(step), schema).select(*back, "lang_pred", "score")


def predicted_languages(docs: DataFrame, **sample) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from rows whose crc32 of doc_id (as text) modulo 4 is not 2 and
    whose lang is known; the others are held out. A null doc_id counts as the
    empty text: not held out, but not learned from either.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    rows = docs.select("doc_id", "text", "lang", (fold == 2).alias("held_out"))
    net = learn(rows.filter(~F.col("held_out")).select("doc_id", "text", "lang"), **sample)
    return identify(rows.select("doc_id", "held_out", "text"), net)
