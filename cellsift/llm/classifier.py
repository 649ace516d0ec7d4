"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Its table of additions is learned by
cyclic boosting: round after round, every feature in turn gets a shallow tree
over its bins, fitted to the gradient of the logistic loss, of which a small part is
added to the table. Then the pairs of features whose grids explain most of what is
left are boosted in the same way, a tree being two cuts. So the score is a
sum of looked-up numbers, added for whole batches at once, and every table can be read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.llm.words import hidden, mapped, texts
from cellsift.session import written

#: Rows with a label that are learned from, at most: those with the smallest hash of doc_id.
SAMPLE = 50_000
BINS, PAIR_BINS, PAIRS = 32, 12, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAST, RIDGE = 200, 100, 0.1, 1.0, 1.0
#: A text counts as good from this score on.
GOOD = 0.7

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "bang": b"!?", "stop": b".", "comma": b",;:", "line": b"\n", "mark": b"\"'()[]{}@/\\_=+~^`-", "wide": range(128, 256)}
_OF_BYTE = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_bytes), _i] = 1
FEATURES = (
    "words", "bytes_a_word", *(f"{c}_share" for c in _CLASSES), "byte_entropy", "distinct_words", "top_word", "word_entropy", "repeated_next",
    "distinct_threes", "short_words", "long_words", "longest_word", "capitalised", "ends_plain", "lines", "repeated_lines", "bytes_a_stop",
)


def _entropy(counts: np.ndarray) -> float:
    p = counts / counts.sum()
    return float(-(p * np.log(p)).sum())


def features(text: bytes | None) -> list[float]:
    """The FEATURES of a whole text; of one without words, zeros but for its length."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, float(len(text)), *[0.0] * (len(FEATURES) - 2)]
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = seen @ _OF_BYTE
    black = max(1, len(text) - int(seen[[9, 10, 11, 12, 13, 32]].sum()))
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    each = np.fromiter(counts.values(), np.int64, len(counts))
    threes = len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return [
        np.log1p(n), black / n, *(classes / len(text)).tolist(), _entropy(seen[seen > 0]), len(counts) / n, int(each.max()) / n, _entropy(each) / np.log(n + 1),
        sum(map(bytes.__eq__, words, words[1:])) / n, threes / max(1, n - 2), float((sizes <= 2).mean()), float((sizes >= 12).mean()), float(np.log1p(sizes.max())),
        sum(map(bytes.istitle, words)) / n, sum(map(bytes.isalpha, words)) / n, n / len(lines), 1 - len(set(lines)) / len(lines), black / (1 + classes[5]),
    ]


def featured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``features`` in place of ``text``."""
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([features(v) for v in texts(batch)], float).reshape(-1, len(FEATURES))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * len(FEATURES), pa.int32()), pa.array(made.ravel()))
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), lists], [*(f.name for f in rest), "features"])

    return docs.mapInArrow(mapped(step), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "features array<double>"]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AdditiveModel:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)  # by feature: bounds of its bins
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # by feature: its bin among PAIR_BINS, by fine bin
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value: rows by feature."""
        return np.array([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], np.int64).reshape(len(self.cuts), len(x))

    def margins(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(bins.shape[1], self.base)
        for table, b in zip(self.tables, bins):
            total += table[b]
        for i, j, grid in self.pairs:
            total += grid[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margins(self.bins(x)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= LEAST, g * g / (h + RIDGE), -np.inf)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    left = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(*left) + _gain(g.sum() - left[0], h.sum() - left[1]) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 0 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A step for each bin: a tree of depth two on sums of gradients and of curvatures."""
    _, cut = _best_cut(g, h)
    if not cut:
        return np.zeros(len(g))
    out, ends = np.empty(len(g)), {0, cut, len(g)}
    ends |= {a + c for a, b in ((0, cut), (cut, len(g))) if (c := _best_cut(g[a:b], h[a:b])[1])}
    ends = sorted(ends)
    for a, b in zip(ends[:-1], ends[1:]):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the two cuts, one along each side of a grid, that fit best."""
    sums = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h)]
    n, m = g.shape
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    parts = []
    for s in sums:
        a = s[i, j]
        parts.append((a, s[i, m] - a, s[n, j] - a, s[n, m] - s[i, m] - s[n, j] + a))
    gain = sum(_gain(*p) for p in zip(*parts))
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    if not np.isfinite(gain[at]):
        return 0.0, np.zeros((n, m))
    steps = [-p[at] / (q[at] + RIDGE) for p, q in zip(*parts)]
    out = np.empty((n, m))
    r, c = at[0] + 1, at[1] + 1
    out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:] = steps
    return float(gain[at] - g.sum() ** 2 / (h.sum() + RIDGE)), out


def train(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Main effects, then pairs. Without rows, or with one label alone, scores
    are the share of label 1, drawn towards one half."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    for column in x.T:
        cuts = np.unique(np.quantile(column, np.arange(1, BINS) / BINS))
        model.cuts.append(cuts[cuts > column.min()])
    bins = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    model.coarse = [np.arange(s) * min(s, PAIR_BINS) // s for s in sizes]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for table, b in zip(model.tables, bins):
            odds = _sigmoid(total)
            step = RATE * tree(np.bincount(b, odds - y, len(table)), np.bincount(b, odds * (1 - odds), len(table)))
            table += step
            total += step[b]
    odds = _sigmoid(total)
    wide = [c[b] for c, b in zip(model.coarse, bins)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (model.coarse[i][-1] + 1, model.coarse[j][-1] + 1)
        cell = wide[i] * shape[1] + wide[j]
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (odds - y, odds * (1 - odds)))

    gains = []
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes)):
            if min(model.coarse[i][-1], model.coarse[j][-1]) > 0:
                gains.append((-pair_tree(*grid(i, j)[1:])[0], i, j))
    model.pairs = [(i, j, np.zeros((model.coarse[i][-1] + 1, model.coarse[j][-1] + 1))) for gain, i, j in sorted(gains)[:PAIRS] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            odds = _sigmoid(total)
            cell, g, h = grid(i, j)
            step = RATE * pair_tree(g, h)[1]
            table += step
            total += step.ravel()[cell]
    return model


def learn(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """The model of the labelled rows (doc_id, features) whose fold isn't held out.

    A hash bound from their count thins the rows to about twice the sample before they are
    ordered, so that no task sends a whole sample of its own to the driver.
    """
    known = labels.filter("quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).cast("int").alias("y"))
    n = rows.filter("NOT held_out").select("doc_id").join(known, "doc_id").count()
    near = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53)) <= F.lit(2.0 * sample / max(n, 1))
    thin = rows.filter("NOT held_out").filter(near).join(known.filter(near), "doc_id").select("doc_id", "features", "y").distinct()
    picked = thin.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "features").limit(sample).select("features", "y").collect()
    x = np.array([r["features"] for r in picked], float).reshape(-1, len(FEATURES))
    return train(x, np.array([r["y"] for r in picked], float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the text, with held_out, score and predicted (1 from GOOD on).

    Learns from at most ``sample`` rows with a label, of which crc32 of doc_id (as
    text) modulo 4 is not 2; the label is all that it takes from them beside the
    text. A null doc_id counts as the empty text: not held out, and without a label.
    Null texts are empty ones. Rows repeated in either table are learned from once;
    equal texts have equal scores. Every row comes out once.
    """
    rest, back = hidden(docs.drop("held_out", "score", "predicted"), ("doc_id", "text"))
    back = [c for c, name in zip(back, rest.columns) if name != "text"]
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    rows = written(featured(rest.withColumn("text", F.col("text").cast("string")).withColumn("held_out", fold)), "features")
    model = learn(rows.select("doc_id", "held_out", "features"), labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "features"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        score = sent.value.scores(x) if sent.value.cuts else np.full(len(x), _sigmoid(sent.value.base))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score), pa.array((score >= GOOD).astype(np.int32))], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "features")
    return rows.mapInArrow(mapped(step), f"{kinds}, score double, predicted int").select(*back, "held_out", "score", "predicted")
