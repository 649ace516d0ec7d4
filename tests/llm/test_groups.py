"""Shards, SimHash, packing, archives, repeated strings, the pipeline."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cellsift.llm import components, packing, shards, simhash, suffixes, warc
from cellsift.session import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_hilbert_is_a_walk():
    """Each step along the curve changes one coordinate by one."""
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        axes = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1)
        index = shards.hilbert_index(list(axes), bits)
        assert sorted(index) == list(range(1 << n * bits))
        walk = axes[:, np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def check_shards(rows, docs, n):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(docs)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards(spark, edge_docs, documents, no_docs):
    check_shards(shards.document_shards(edge_docs).collect(), edge_docs.rows, 40)
    check_shards(shards.document_shards(documents, 7).collect(), documents.rows, 7)
    assert shards.document_shards(no_docs).count() == 0


def test_shards_are_compact(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = shards.document_shards(docs, 16)
    shards.write_shards(docs, placed, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(map(tuple, docs.select("doc_id", "text").collect()))
    spans = back.groupBy("shard").agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("b")).collect()
    middle = docs.approxQuantile("n_chars", [0.5], 0)[0]
    assert sum(r["a"] <= middle <= r["b"] for r in spans) < len(spans)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """doc_id, fingerprint -> smallest doc_id reachable."""
    nodes = sorted({f for _, f in fps})
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return Counter((d, f"{f:016x}", least.get(find(f))) for d, f in fps)


def test_simhash(edge_docs, documents, no_docs):
    for df in (edge_docs, documents):
        got = simhash.near_duplicate_components(df).collect()
        assert Counter(map(tuple, got)) == brute_components([(r[0], brute_fingerprint(r[1])) for r in df.rows])
    assert simhash.near_duplicate_components(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(edge_docs)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == edge_docs.columns and set(ids.values()) == {1}
    assert set(ids) == {c for _, _, c in brute_components([(r[0], brute_fingerprint(r[1])) for r in edge_docs.rows])}
    assert simhash.drop_near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("small,large", [(32, 4096), (3, 4096), (2, 4)])
def test_simhash_links(spark, monkeypatch, small, large):
    """Chains, dense balls and random fingerprints, by every way through a cell."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)]
    chain = rng.getrandbits(64)
    for i in range(0, 40, 2):
        chain ^= 3 << i
        fps.append(chain)
    fps += [fps[0] ^ (1 << i) for i in range(64)] + [0, 1, (1 << 64) - 1]
    rows = list(enumerate(fps))
    table = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long").repartition(3)
    run = lambda s, big: simhash.cell_links
    if (small, large) != (32, 4096):  # workers have modules of their own: run the cells here
        distinct = np.unique(np.array([f for _, f in rows], np.uint64))
        met = simhash.cells(pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64))], ["fp"])).to_pandas().sort_values("cell")
        batches = [pa.RecordBatch.from_pandas(met.iloc[i : i + 7], preserve_index=False) for i in range(0, len(met), 7)]
        links = [(a, b) for x in simhash.cell_links(iter(batches)) for a, b in zip(*(c.to_pylist() for c in x.columns))]
        edges = spark.createDataFrame([x for x in links if x[1] is not None] or [(0, 0)], "a long, b long")
        hot = sorted({a for a, b in links if b is None})
        assert (len(hot) > 0) == (large == 4)
        if hot:
            edges = edges.union(simhash.probed_links(spark.createDataFrame([(x,) for x in hot], "fp long")))
    else:
        edges = simhash.links(table)
    root = {r["node"]: r["root"] for r in components.components(edges).collect()}
    signed = {d: (f - (1 << 64) if f >> 63 else f) for d, f in rows}
    groups = defaultdict(list)
    for d, f in rows:
        groups[root.get(signed[d], signed[d])].append(d)
    want = Counter((d, c) for (d, _, c), n in brute_components(rows).items() for _ in range(n))
    assert Counter((d, min(g)) for g in groups.values() for d in g) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(70)] + [(5000, 5000 + i) for i in range(300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k in touched}


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("length", [64, 2048])
def test_packing(edge_docs, documents, length):
    for df in (edge_docs, documents):
        pieces = [r.asDict() for r in packing.pack(df, WORDS, length=length, ids=True).collect()]
        total = sum(len(p["ids"]) for p in pieces)
        by_doc = defaultdict(list)
        for p in pieces:
            assert p["length"] == len(p["ids"]) > 0
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            by_doc[p["doc_id"]].append(p)
        want = defaultdict(list)
        for d, text, *_ in df.rows:
            want[d].append(ids_of(text))
        for d, texts in want.items():
            if len(texts) == 1:
                mine = sorted(by_doc[d], key=lambda p: p["start"])
                assert sum((p["ids"] for p in mine), []) == texts[0]
                assert all(p["doc_tokens"] == len(texts[0]) for p in mine)
            assert sum(p["length"] for p in by_doc[d]) == sum(map(len, texts))
        windows = defaultdict(list)
        for p in pieces:
            windows[p["sequence_id"]].append(p)
        assert sorted(windows) == list(range(-(-total // length)))
        seen, totals = Counter(), Counter()
        for p in pieces:
            totals[p["source"]] += p["length"]
        for w in sorted(windows):
            at = 0
            for p in sorted(windows[w], key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
                seen[p["source"]] += p["length"]
            assert at == length or w == max(windows)
            share = min(1, (w + 1) * length / total)
            assert all(abs(seen[s] - totals[s] * share) <= len(totals) for s in totals)
        sequences = packing.assemble(packing.pack(df, WORDS, length=length, ids=True)).collect()
        assert sorted(len(s["tokens"]) for s in sequences)[1:] == [length] * (len(sequences) - 1)


@pytest.mark.parametrize("forms", [50, packing.FORMS])
def test_packing_words_like_the_tokenizer(edge_docs, documents, monkeypatch, forms):
    monkeypatch.setattr(packing, "FORMS", forms)
    coder = packing.WordEncoder(WORDS)
    odd = ["It's. I'LL, A., x.. .a. <|ENDOFTEXT|> b<|endoftext|>. é. É, <|endoftext|>x <|startoftext|>", "a b  c", "é ́ x́", "ΣΑΣ Σ", "日本 １２３ ½", "\x85 a\x1cb", "..,, !? --"]
    texts = [r[1] for r in edge_docs.rows + documents.rows] + odd + [" ", "  x ", "x\x0b\x0cy \n"]
    column = pa.array(["dropped", *texts]).slice(1)
    for _ in range(2):
        assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(column, 1, block=7)] == [ids_of(t) for t in texts]


def test_packing_few_queues_and_weights(edge_docs, no_docs):
    for more in ({"queues": 2}, {"weights": {"s1": 3.0, None: 1.0}}):
        pieces = packing.pack(edge_docs, WORDS, length=128, **more).collect()
        assert sum(p["length"] for p in pieces) == sum(len(ids_of(r[1])) for r in edge_docs.rows)
    first = Counter()
    for p in pieces:
        if p["sequence_id"] == 0:
            first[p["source"]] += p["length"]
    assert first == {"s1": 96, None: 32}
    assert packing.pack(no_docs, WORDS).count() == 0


def test_mixture_is_round_robin():
    mixture = packing.Mixture([7, 0, 3, 1])
    served = mixture.served(np.arange(12))
    due = sorted(((k + 0.5) / n, q) for q, n in enumerate([7, 0, 3, 1]) for k in range(n))
    for r in range(12):
        assert served[r].tolist() == [sum(q == s for _, q in due[:r]) for s in range(4)]


def test_archives(spark):
    html = ["<p>" + "word %d " % (i % 7) * 300 for i in range(40)] + ["short", "short", None, "", "é" * 499, "é" * 500, "é" * 500, "a\r\n\r\nb" * 200]
    rows = [(i, f"http://x/{i}\n" if i % 3 else None, h, "z") for i, h in enumerate(html)] + [(40, "u", "short", "z"), (None, "n", html[0], "z"), (39, "again", html[39], "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    for more in ({}, {"archive_bytes": 5000, "dictionary_bytes": 1024}):
        path = scratch_path(spark, "warc")
        index = warc.write_archives(pages, path, **more)
        got = warc.read_archives(spark, path, index).collect()
        held = {}
        for i, _, h, _ in rows:
            if h is not None and len(h.encode()) >= 1000:
                held[h] = max(held.get(h, -1), -1 if i is None else i)
        want = []
        for i, _, h, _ in rows:
            raw = (h or "").encode()
            best = held.get(h, i)
            kind = "response" if best == i else "revisit"
            want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), kind, best if kind == "revisit" else None, raw if kind == "response" else None))
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == Counter(want)
        assert {r["url"] for r in got} == {None if r[1] is None else r[1].replace("\n", "%0A") for r in rows}
        # One record by its place in the index.
        import zstandard

        one = index.filter("page_id = 33").first()
        content = open(f"{path.removeprefix('file://')}/{one['file']}", "rb").read()
        size = int.from_bytes(content[4:8], "little")
        record = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size])).decompress(content[one["start"] : one["end"]])
        assert b"urn:page:33>" in record and html[33].encode() in record
    path = scratch_path(spark, "warc")
    assert warc.read_archives(spark, path, warc.write_archives(pages.limit(0), path)).count() == 0


def brute_repeats(rows, size=400):
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    starts = Counter(t[i : i + size] for _, t in data for i in range(len(t) - size + 1))
    out = []
    for d, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - size + 1):
            if starts[t[i : i + size]] > 1:
                gone[i : i + size] = True
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(t) else 0, hashlib.sha256(left).hexdigest()))
    return Counter(out)


def repeat_rows():
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    core = [say(n) for n in (330, 380, 399, 405, 700, 1500)]
    texts = [say(rng.randint(0, 900)) + c + say(rng.randint(0, 900)) for c in core for _ in range(12)]
    texts += [c[:k] + "#" + c[k:] for c in core[-2:] for k in range(50, 650, 40)]
    texts += ["ab" * 600, "x" * 900, core[5] + core[5], core[4][:450] + core[5][:410] + core[4][200:]]
    return [(i, t) for i, t in enumerate(texts)]


def test_repeats(spark, edge_docs, no_docs):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for rows, df in ((edge_docs.rows, edge_docs), (repeat_rows(), spark.createDataFrame(repeat_rows(), "doc_id long, text string").repartition(4))):
        short = [r for r in rows if r[1] is None or len(r[1]) < 5000]
        got = suffixes.remove_repeats(df.filter("text IS NULL OR length(text) < 5000")).select(*names).collect()
        assert Counter(map(tuple, got)) == brute_repeats(short)
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_large_groups_split(monkeypatch):
    """The same windows come out if no more than two segments are compared at once."""
    rows = {}
    for _, text in repeat_rows():
        raw = text.encode()
        for g, f, n, o in zip(*suffixes.segments(raw)):
            u = raw[f : f + n + suffixes.SIZE - 1]
            rows[u, int(o)] = (int(g) >> 1, 0, suffixes.PLACES - 1, xxhash.xxh3_64_intdigest(u) >> 1, 0, int(o), u)

    def run(rows):
        found, todo = defaultdict(set), list(rows.values())
        while todo:
            todo.sort(key=lambda r: r[0])
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*todo)], ["key", "low", "high", "c1", "c2", "anchor", "bytes"])
            todo = []
            for out in suffixes._compared(iter([batch.slice(i, 5) for i in range(0, batch.num_rows, 5)])):
                for r in zip(*(c.to_pylist() for c in out.columns)):
                    if r[7] is None:
                        todo.append(r[:7])
                    else:
                        found[r[3]] |= set(range(r[7], r[8] + 1))
        return found

    whole = run(rows)
    monkeypatch.setattr(suffixes, "TOGETHER", 2)
    assert whole and run(rows) == whole


def test_deep_shallow_sort():
    rng = random.Random(4)
    for trial in range(200):
        stem = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60)))
        items = [stem[: rng.randint(0, 60)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(2, 40))]
        items += [items[0]] * (trial % 3)
        order, common = suffixes.deep_shallow_sort(items)
        got = [items[i] for i in order]
        assert sorted(order) == list(range(len(items))) and got == sorted(items)
        assert common == [0 if trial < 0 else common[0], *(suffixes.lcp(a, b) for a, b in zip(got, got[1:]))]


def test_pipeline(spark, sf, edge_docs, no_docs):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns
        rows = after.collect()
        assert 0 < len(rows) <= before.count()
        assert len({r["doc_id"] for r in rows}) == len(rows)
        before = spark.createDataFrame(rows, docs.schema)
    want = {r["doc_id"]: len(ids_of(r["text"])) for r in before.collect()}
    got = Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want
    for some in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, some, sf).count() >= 0
