"""Source divergence, ranked search and the quality classifier against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellsift.llm import classifier, divergence, search
from cellsift.llm.queries import ORACLE, QUERIES
from cellsift.plans.check import compare

SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_lexical_search"])
def test_sql(spark, sf, name):
    ok, note = compare(spark, sf, QUERIES[name], ORACLE[name])
    assert ok, note


def brute_divergence(rows):
    """Rows (text, lang, source): every kept term of every pair is looked at."""
    cut = lambda t: [w.encode().translate(SMALL).decode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = Counter(cut(text or ""))
        sources[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = []
    for lang, own in sources.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        p = {}
        for s in (None, *own):
            of = counts[lang, s] if s is not None else sum((counts[lang, x] for x in own), Counter())
            total = sum(of[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (of[t] + 1) // (total + len(kept)) for t in kept}
        for s in own:
            f = lambda t, q: (p[s][t] - p[q][t]) ** 2 // p[q][t]
            pairs = [(x, sum(f(t, x) for t in kept)) for x in own if x != s]
            more = [(t, f(t, None)) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", more, 200)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_edges(spark, edge_docs, no_docs):
    got = divergence.source_divergence(edge_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence([r[1:4] for r in edge_docs.rows])
    assert divergence.source_divergence(no_docs).count() == 0


def test_divergence_copies(spark):
    """A hot text in all sources, a language without terms, capitals beyond ASCII."""
    rng = random.Random(2)
    rows = [("Hot TEXT of all", "en", f"s{i % 7}") for i in range(400)]
    rows += [(" ".join(rng.choice("aa bb Cc ÉÉ éé dd-ee 12 zz").strip() * rng.randint(1, 3) for _ in range(rng.randint(0, 9))), rng.choice(["en", "fr"]), f"s{rng.randrange(9)}") for _ in range(300)]
    rows += [(" ".join(rng.choice(["aa", "Bb", "ÉÉ", "éé", "dd-ee", "12", "x1y"]) for _ in range(rng.randint(0, 9))), rng.choice(["en", "fr"]), f"s{rng.randrange(9)}") for _ in range(300)]
    rows += [("123", "none", s) for s in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert sorted(map(tuple, divergence.source_divergence(df).collect())) == brute_divergence(rows)
    assert divergence.collapsed(df.fillna("")).count() == len({(t, g) for t, g, _ in rows if t})


def brute_search(docs, items, top=20):
    cut = lambda t: [w.encode().translate(SMALL).decode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(d, Counter(w), len(w)) for d, w in ((d, cut(t)) for d, t in docs) if w]
    n, total = len(held), sum(k for *_, k in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        asked, found = Counter(cut(text)), []
        for d, c, size in held:
            m = 75 + 25 * size * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def test_search_edges(spark, edge_docs, no_docs):
    rng = random.Random(4)
    words = " ".join(r[1] or "" for r in edge_docs.rows if r[1] and len(r[1]) < 2000).split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "?!"), (103, "nowhereatall"), items[3], (None, items[4][1]), (104, "Ze ZE ze " + items[5][1])]
    benchmark = spark.createDataFrame(items, "item_id int, text string").withColumnRenamed("item_id", "item_id")
    got = search.search(edge_docs, benchmark)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search([r[:2] for r in edge_docs.rows], [i for i in items if i[1] is not None])
    assert search.search(no_docs, benchmark).count() == 0
    assert search.search(edge_docs, benchmark.limit(0)).count() == 0


def test_search_in_passes(spark, edge_docs, monkeypatch):
    """Queries beyond one broadcast are answered in several passes."""
    rng = random.Random(6)
    words = " ".join(r[1] or "" for r in edge_docs.rows if r[1] and len(r[1]) < 900).split()
    items = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(12)]
    monkeypatch.setattr(search, "QUERY_BYTES", 300)
    got = search.search(edge_docs, spark.createDataFrame(items, "item_id int, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_search([r[:2] for r in edge_docs.rows], items)


@pytest.mark.parametrize("short", [0, 40, 10**6])
def test_search_block(short, monkeypatch):
    """Accumulators alone, lists alone and both give the best documents, over
    blocks that share what is wanted."""
    monkeypatch.setattr(search, "SHORT", short)
    monkeypatch.setattr(search, "STEP", 16)
    rng = np.random.default_rng(short % 97)
    best, everything = search.Best(), defaultdict(int)
    for block in range(6):
        ids = rng.permutation(900)[:600] + 1000 * block
        lists = []
        for _ in range(rng.integers(1, 9)):
            docs = np.sort(rng.choice(600, rng.integers(1, 500), replace=False))
            adds = rng.integers(1, rng.choice([3, 50, 1000]), len(docs))
            lists.append((docs, adds, int(adds.max())))
            for d, a in zip(docs, adds):
                everything[int(ids[d])] += int(a)
        search.search_block(lists, best, ids.tolist())
    assert [(-s, d) for s, _, d in best.rows] == sorted(((s, d) for d, s in everything.items()), key=lambda x: (-x[0], x[1]))[:20]


def test_length_norms_beyond_a_long():
    sizes = np.array([3, 10**9])
    n, total = 10**11, 10**14
    assert search.length_norms(sizes, n, total).tolist() == [75 + 25 * int(x) * n // total for x in sizes]


def test_classifier_learns_interactions():
    """A label that only two features together tell, by pair tables."""
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(classifier.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = classifier.train(x[:3000], y[:3000])
    assert {(i, j) for i, j, _ in model.pairs[:1]} == {(2, 5)}
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.93
    bins = model.bins(x)
    by_hand = [model.base + sum(t[b[r]] for t, b in zip(model.tables, bins)) + sum(g[model.coarse[i][bins[i][r]], model.coarse[j][bins[j][r]]] for i, j, g in model.pairs) for r in range(5)]
    assert np.allclose(model.margins(bins)[:5], by_hand)


def test_classifier_held_out(spark, documents):
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = classifier.scored(full.select("doc_id", "text"), labels)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == full.count()
    kept = rows.join(labels, "doc_id").toPandas()
    assert (kept.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in kept.doc_id]).all()
    assert ((kept.predicted == 1) == (kept.score >= 0.7)).all()
    held = kept[kept.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95


def test_classifier_uses_no_held_out_label(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    fold = "crc32(cast(doc_id AS string)) % 4 = 2"
    turned = labels.selectExpr("doc_id", f"CASE WHEN {fold} THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted(map(tuple, classifier.scored(documents.select("doc_id", "text"), x).collect())) for x in (labels, turned))
    assert a == b


def test_classifier_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(60)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    rows = classifier.scored(edge_docs, labels)
    assert rows.columns == [c for c in edge_docs.columns if c != "text"] + ["held_out", "score", "predicted"]
    got = rows.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in edge_docs.rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    none = classifier.scored(edge_docs, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 0)}
    assert classifier.scored(no_docs, labels).count() == 0
    assert len(classifier.features(None)) == len(classifier.features("a É\n\nb, c".encode())) == len(classifier.FEATURES)
