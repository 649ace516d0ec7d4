"""What repeated strings take on disk, and what packing leaves in a worker."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from cellsift.llm import packing, suffixes


def test_only_what_repeats_is_shuffled(spark, monkeypatch):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    shared = [say(120) for _ in range(4)]
    texts = [say(300) for _ in range(200)] + [say(20) + s[: 500 + 40 * i] + say(20) for s in shared for i in range(5)] + [shared[0], shared[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, write = {}, suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, label: kept.setdefault(label, write(df, label)))
    rows = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    assert all((rows[i]["n_removed"] > 0) == (i >= 200) for i in range(len(texts)))
    # Segments and texts without a repeated k-gram stay out of the joins.
    assert kept["segments"].count() > 2_000 > 500 > kept["segments-distinct"].count()
    assert kept["spans"].count() == len(texts) - 200
    # Each segment has its windows in as few ranges as they take.
    for r in kept["repeated"].collect():
        assert all(a["x1"] + 1 < b["x0"] for a, b in zip(r["xs"], r["xs"][1:]))


def test_ranges_are_joined():
    rng = random.Random(8)
    for _ in range(200):
        ranges = [(a, a + rng.randint(0, 6)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 12)))]
        got = suffixes.joined(ranges)
        assert {x for a, b in got for x in range(a, b + 1)} == {x for a, b in ranges for x in range(a, b + 1)}
        assert all(a[1] + 1 < b[0] for a, b in zip(got, got[1:]))


def test_known_words_are_not_hashed_again():
    """A look-up of a few words takes less than what is known, and finds all."""
    coder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    known = [f"w{i}" for i in range(300_000)]
    coder.known, coder.ids = pa.array(known), np.zeros(len(known), coder.kind)
    coder.first, coder.size = np.arange(len(known)), np.ones(len(known), np.int64)
    plain, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        coder.learn(pa.array(["w7", "w299999", "w7"]))
    finally:
        pa.set_memory_pool(plain)
    assert len(coder.known) == len(known) and pool.max_memory() < coder.known.nbytes
    assert coder.places(pa.array(["w9", "none", "w9", "w0"])).tolist() == [9, -1, 9, 0]
