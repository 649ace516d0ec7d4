"""Packing of many sources, and with tokenizers of other kinds."""

import tracemalloc
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cellsift.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def many_sources(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(12 + i % 5)), f"site{i % 300}") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)


def test_every_source_is_spread_evenly(spark):
    """300 equal sources, 255 queues: each has about half of its tokens in the first half."""
    pieces = packing.pack(many_sources(spark), WORDS, length=256).collect()
    last = max(p["sequence_id"] for p in pieces)
    half, whole = defaultdict(int), defaultdict(int)
    for p in pieces:
        whole[p["source"]] += p["length"]
        half[p["source"]] += p["length"] * (p["sequence_id"] <= last / 2)
    assert len(whole) == 300 and all(0.4 <= half[s] / whole[s] <= 0.6 for s in whole)
    assert sum(0.45 <= half[s] / whole[s] <= 0.55 for s in whole) >= 290
    filled = defaultdict(int)
    for p in pieces:
        filled[p["sequence_id"]] += p["length"]
    assert all(n == 256 for s, n in filled.items() if s != last) and sorted(filled) == list(range(last + 1))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
    for parts in by_doc.values():
        parts.sort()
        assert [a for a, *_ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))] and sum(n for _, n, _ in parts) == parts[0][2]


def test_a_named_source_has_a_queue(spark):
    """The source of most weight is served first, though it is not among the largest."""
    weights = {"site1": 1.0, "site2": 1.0, "site299": 50.0}
    pieces = packing.pack(many_sources(spark).filter("doc_id % 300 IN (1, 2, 7, 8, 9, 10, 11, 299)"), WORDS, length=64, weights=weights, queues=4).collect()
    ends = {s: max(p["sequence_id"] for p in pieces if p["source"] == s) for s in {p["source"] for p in pieces}}
    assert len(ends) == 8
    first = min(p["sequence_id"] for p in pieces if p["source"] in ("site7", "site8", "site9", "site10", "site11"))
    assert ends["site299"] < ends["site1"] and max(ends["site1"], ends["site2"]) <= first


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(edge_docs, name):
    """Whatever the tokenizer makes of blanks and capitals."""
    file = public_tokenizers.path(name)
    library = Tokenizer.from_file(file)
    got = defaultdict(list)
    for p in packing.pack(edge_docs.filter("doc_id IS NOT NULL"), file, ids=True).collect():
        got[p["doc_id"]].append((p["start"], list(p["ids"])))
    for d, text, *_ in edge_docs.rows:
        if d is not None:
            want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
            ids = [i for _, part in sorted(got[d]) for i in part]
            assert ids == want * (len(ids) // len(want)) or sorted(ids) == sorted(want * (len(ids) // len(want)))
    assert packing.encoder(file).by_words == (name == "word_bpe_49k.json")


def test_known_words_take_little_memory():
    """100,000 different words that a worker remembers have no Python object each."""
    coder = packing.WordEncoder(WORDS)
    text = " ".join(f"w{i:x}" for i in range(100_000))
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    tracemalloc.start()
    for _ in range(2):
        (got,) = coder.encode(pa.array([text]), 1)
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert memoryview(got).cast("H").tolist() == [*want, 1]
    assert left < 5_000_000 and len(coder.known) == 100_002
