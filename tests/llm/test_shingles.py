"""Near-duplicates by five-word shingles."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cellsift.llm import shingles


def brute_kept(rows):
    """doc_ids that stay: the smallest of each component of similar texts."""
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        key = (d is None, d or 0)
        least[find(i)] = min(key, least.get(find(i), key))
    return Counter(None if none else d for none, d in least.values())


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(words)), changes):
        out[at] = "changed%d" % rng.randrange(10**9)
    return out


def test_edited_copies(spark):
    """Of each text and its copies with up to 4 of 200 words changed, what similarity
    0.8 links is linked, and nothing else; three in a million may be missed."""
    rng = random.Random(3)
    texts = []
    for size, changes in ((200, 1), (200, 4), (500, 5), (1000, 20), (200, 12)):
        for _ in range(40):
            words = ["w%d" % rng.randrange(50_000) for _ in range(size)]
            texts += [" ".join(words), " ".join(edited(rng, words, changes))]
    hub = ["h%d" % rng.randrange(50_000) for _ in range(100)]
    texts += [" ".join(edited(rng, hub, rng.randint(0, 4))) for _ in range(200)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    kept = shingles.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == brute_kept(rows)


def test_shingle_edges(edge_docs, documents, no_docs):
    for df in (edge_docs, documents):
        kept = shingles.drop_near_duplicates(df)
        assert kept.columns == df.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == brute_kept(df.rows)
    assert shingles.drop_near_duplicates(no_docs).count() == 0


def test_a_shared_passage_costs_pairs_in_proportion(spark, monkeypatch):
    """Texts of 75 shared words and 25 of their own aren't similar: none goes, and
    twice the texts don't make four times the pairs."""
    rng = random.Random(7)
    passage = " ".join("p%d" % rng.randrange(10**6) for _ in range(75))
    counts, write = [], shingles.written

    def counting(df, label):
        out = write(df, label)
        if label == "pairs":
            counts[-1] += out.count()
        return out

    monkeypatch.setattr(shingles, "written", counting)
    for n in (400, 1600):
        counts.append(0)
        rows = [(i, " ".join("w%d" % rng.randrange(10**9) for _ in range(25)) + " " + passage) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert shingles.drop_near_duplicates(docs).count() == n
    assert counts[1] <= 5 * counts[0] and counts[1] <= 30 * 1600


def test_first_shingles_meet():
    """Two sets at 0.8 share one of the first ninth of the smaller and the first fifth of the larger."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 256, 1 << 23, np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.8, 0.9, 1.0])], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 5))).astype(np.uint64)]))
        if len(b) and shingles.similar(a, b):
            small, large = sorted((a, b), key=len)
            lead, k = shingles.prefixes(small, common)
            assert np.intersect1d(lead[:k], shingles.prefixes(large, common)[0]).size


def test_parities_lose_no_similar_pair(spark):
    """No pair at 0.8 is held apart, down to the least similarity; texts with a common passage mostly are."""
    rng = np.random.default_rng(4)
    rows, alike = [], []
    for size in (1, 2, 5, 9, 45, 90, 450, 900, 4500):
        for shared in (size, -(-size * 8 // 9), -(-size * 8 // 9) - 1, size * 3 // 4):
            a, b = (rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) for _ in range(2))
            b[:shared] = a[:shared]
            a, b = np.unique(a), np.unique(b)
            x, y = shingles.parities(a), shingles.parities(b)
            assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))
            rows.append((len(rows), len(a), len(b), *x.tolist(), *y.tolist()))
            alike.append(shingles.similar(a, b))
    names = [f"{s}{p}" for s in "xy" for p in shingles.PARITIES]
    table = spark.createDataFrame(rows, "i long, m long, n long, " + ", ".join(f"{c} long" for c in names))
    x, y = ([F.col(c) for c in names[k : k + 4]] for k in (0, 4))
    got = {r["i"]: r["fits"] for r in table.select("i", shingles.may_fit(x, y, F.col("m"), F.col("n")).alias("fits")).collect()}
    assert all(got[i] for i, same in enumerate(alike) if same)
    assert not got[19] and not got[23]  # 45 and 90 shingles, three quarters of them shared


def test_fingerprints_link_candidates(spark, monkeypatch):
    """SimHash brings sets together: of one fingerprint, and at one or two differing bits, not at three."""
    rows = [(5, 9, 0b1111 << 40), (3, 9, 0b1111 << 40), (8, 9, 0b0011 << 40), (2, 9, 0b1110000 << 40 | 1), (7, 0, 0), (9, 9, -1), (1, 9, (1 << 62) - 1)]
    sets = spark.createDataFrame(rows, "set_id long, set_size long, fp long")
    assert sorted(tuple(r) for r in shingles.fingerprint_pairs(sets).collect()) == [(5, 3), (8, 3), (9, 1)]

    met, pairs = [], shingles.fingerprint_pairs
    monkeypatch.setattr(shingles, "fingerprint_pairs", lambda sets: met.append(pairs(sets)) or met[-1])
    words = ["w%d" % i for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, words[0]])), (3, "another text of some words"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingles.drop_near_duplicates(docs).collect()) == [1, 3, 4]
    assert len(met) == 1
