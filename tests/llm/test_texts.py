"""Language, token counts, quality rules, lines, templates."""

import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellsift.llm import decontaminate, language, lines, quality, tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(edge_docs, no_docs):
    got = language.predicted_languages(edge_docs, per_language=20).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in edge_docs.rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert {by[i]["lang_pred"] for i in (0, 1, 2)} == {"und"}
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "und"}
    assert language.predicted_languages(no_docs).count() == 0
    assert {r["lang_pred"] for r in language.predicted_languages(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_tables_equal_convolution():
    rng = np.random.default_rng(1)
    net = language.train(rng.integers(0, 256, (40, language.WINDOW)).astype(np.uint8), rng.integers(0, 3, 40), ["a", "b", "c"], steps=3)
    rows = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    top = []
    for w, f in net.filters.items():
        e = net.embed[rows]
        top.append(sum(e[:, j : j + language.STRIDE] @ f[j] for j in range(w)).max(axis=1))
    logits = np.maximum(np.hstack(top) + net.bias, 0) @ net.out + net.out_bias
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(language.Predictor(net).windows(rows), want, atol=1e-4)


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (200, 1), (1000, 32)])
def test_piece_counts(edge_docs, documents, chunk, overlap):
    counter = tokens.PieceCounter(PIECES, chunk, overlap)
    texts = [r[1] or "" for r in edge_docs.rows + documents.rows] + ["▁ ▁▁" * 300, "日本語" * 400, "<s> </s> <unk> " * 60, " " * 900, "=" * 3000, "a\x00b" * 300]
    assert counter.as_is
    assert counter.counts([t.encode() for t in texts]) == [len(counter.model.encode(t)) for t in texts]
    assert counter.widened or overlap > 4


def test_piece_count_rows(edge_docs, no_docs):
    got = tokens.token_counts(edge_docs, PIECES, limit=100, chunk=500, overlap=16).collect()
    model = tokens.PieceCounter(PIECES).model
    want = []
    for doc_id, text, *_ in edge_docs.rows:
        n = len(model.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 100))
    assert Counter(map(tuple, got)) == Counter(want)
    assert tokens.token_counts(no_docs, PIECES).count() == 0


def brute_measures(text):
    words, text = (text or "").encode().split(), text or ""
    found = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if found[w] > 1 for k in range(3)}
    seen, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if line.encode().split():
            n_lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(again), n_lines


def test_quality_measures(edge_docs, documents, no_docs):
    got = quality.quality_verdicts(edge_docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r[0], *brute_measures(r[1])) for r in edge_docs.rows)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert all(r["base_failed"] == (r["n_words"] < 50 or r["n_repeat_words"] * 100 > 50 * r["n_words"]) for r in got)
    assert quality.quality_verdicts(no_docs).count() == 0
    assert quality.drop_low_quality(edge_docs).columns == edge_docs.columns
    for r in documents.rows:
        assert quality.measures(None if r[1] is None else r[1].encode()) == brute_measures(r[1])


def test_quality_limits_adapt(spark):
    """A source where symbols are usual keeps them; another does not."""
    word = " ".join(f"w{i}" for i in range(100))
    rows = [(i, word + " #" * 40, "en", "code") for i in range(100)] + [(i, word + f" v{i}", "en", "news") for i in range(100, 200)] + [(200, word + " #" * 40, "en", "news")]
    kept = {r["doc_id"] for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("NOT base_failed AND kept").collect()}
    assert kept == set(range(200))


def brute_lines(rows):
    full = {}
    for doc_id, text, *_ in rows:
        if text is not None:
            full[doc_id, text] = [(i, x) for i, x in enumerate(text.split("\n")) if x.encode().split()]
    first, gone = {}, defaultdict(set)
    for key in sorted(full, key=lambda k: (k[0] is None, k[0] or 0)):
        at = full[key]
        for p in range(len(at) - 2):
            window = tuple(x for _, x in at[p : p + 3])
            if first.setdefault(window, (key, p)) != (key, p):
                gone[key] |= {at[p + k][0] for k in range(3)}
    out = []
    for doc_id, text, *_ in rows:
        cut = gone.get((doc_id, text), set()) if text is not None else set()
        if cut:
            left = [x for i, x in enumerate(text.split("\n")) if i not in cut]
            text = "\n".join(left) if len(cut) < len(full[doc_id, text]) else ""
        out.append((doc_id, text, len(cut)))
    return Counter(out)


def test_lines(edge_docs, documents, no_docs):
    # Two texts with a null doc_id have no order that this brute force knows.
    rows = [r for r in edge_docs.rows if r[0] is not None]
    for df, some in ((edge_docs.filter("doc_id IS NOT NULL"), rows), (documents, documents.rows)):
        got = lines.dedup_lines(df).select("doc_id", "text", "removed_lines")
        assert Counter(map(tuple, got.collect())) == brute_lines(some)
    assert lines.dedup_lines(edge_docs).count() == len(edge_docs.rows)
    assert lines.dedup_lines(no_docs).count() == 0


def test_lines_of_large_batches(spark, monkeypatch):
    texts = ["\n".join(f"{i} {k % 700}" for k in range(4000)) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "_id": list(range(40)), "_text": list(range(40))})
    tracemalloc.start()
    rows = list(zip(*(sum((b.column(c).to_pylist() for b in lines._windows(iter([batch, batch.slice(0, 0)]))), []) for c in ("_id", "place"))))
    tracemalloc.reset_peak()
    held, _ = tracemalloc.get_traced_memory()
    assert sum(b.num_rows for b in lines._windows(iter([batch]))) == 40 * 3998
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows == [(i, p) for i in range(40) for p in range(3998)]
    # A window as Python objects takes over 150 bytes, so all of them over 24 MB.
    assert peak - held < 12 << 20
    docs = [(i, t) for i, t in enumerate(texts[:3] + texts[:2] + [None, "", "a\nb\nc", "x\na\nb\nc"])]
    monkeypatch.setattr(lines, "WINDOWS", 1000)
    monkeypatch.setattr(lines, "BYTES", 50_000)
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).select("doc_id", "text", "removed_lines")
    assert Counter(map(tuple, got.collect())) == brute_lines(docs)


QUESTION = "A train leaves Berlin at 9:30 and runs 120 km towards Munich at a speed of 80 km/h while another train leaves Munich one hour later. When do they meet?"


def templates(spark, *texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string")
    items = spark.createDataFrame([(7, QUESTION), (8, "too short"), (9, None)], "item_id long, text string")
    return {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}, decontaminate.drop_contaminated(docs, items)


def test_templates(spark, edge_docs, no_docs):
    other = QUESTION.replace("Berlin", "Hamburg").replace("Munich", "Stuttgart").replace("120", "300").replace("80", "95")
    broken = QUESTION.replace("towards Munich", "towards Bremen")  # one slot for two values
    got, clean = templates(spark, "So: " + QUESTION.lower(), "Solve this. " + other + " Thanks.", "He said " + broken[: len(broken) // 2], "nothing here at all", None, "", "A train leaves Berlin at 9:30")
    assert [got[i]["contaminated"] for i in range(7)] == [True, True, True, False, False, False, False]
    assert got[1]["reparameterised"] and got[1]["item_ids"] == [7]
    assert {r["doc_id"] for r in clean.collect()} == {3, 4, 5, 6}
    items = spark.createDataFrame([(7, QUESTION)], "item_id long, text string")
    assert decontaminate.contamination(edge_docs, items).filter("contaminated").count() == 0
    assert decontaminate.drop_contaminated(edge_docs, items).count() == len(edge_docs.rows)
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert decontaminate.contamination(edge_docs, items.limit(0)).filter("contaminated").count() == 0


def test_slots_must_fit():
    window = lambda p, a, b: {"item_place": p, "slots": a, "item_slots": b}
    assert decontaminate.best_stretch([window(i, [5, 0], [9, 0]) for i in range(6)]) == (13, False)
    assert decontaminate.best_stretch([window(i, [5, 0], [5, 0]) for i in range(3)]) == (10, True)
    assert decontaminate.best_stretch([window(i, [5, 0], [9 + i, 0]) for i in range(6)])[0] == 8
    assert decontaminate.best_stretch([window(0, [5, 6], [9, 9])])[0] == 0


def test_leaks_of_the_tables(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = [(r["item_id"], r["text"]) for r in items.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(t in (r["text"] or "") for _, t in whole)}
    got = {r["doc_id"] for r in decontaminate.contamination(docs, items).filter("contaminated").collect()}
    assert want and got == want
