"""Near-duplicates by the shingles of their texts: five words, Jaccard similarity 0.8 or more.

Sets whose SimHash fingerprints (of the same shingles) ``simhash.links`` links are
candidates. Two bits of 64 link few pairs near 0.8, so others are looked for too:
these share one of BANDS keys, each made of DEPTH minimum hashes: a pair at
similarity s shares none with probability (1 - s**4)**24, three in a million at
0.8. Each candidate is checked by its whole sets of shingles. In a key's group all
members first meet one of them, and links make components, so a group of copies costs as
many pairs as it has members. Only members of different components meet again.

Members of different components that still share a key may be many and not similar, as
texts with one passage in common are. They don't meet by that key but by the
rarest of their shingles. In any common order of shingles, two sets at 0.8 share one among the
first fifth of the larger and the first ninth of the smaller one, so this loses
no pair. Shingles that a sixteenth of these sets has more than once come last in
the order: what many texts share then brings nobody together, and pairs stay in
proportion to texts. A bitmap of fixed size tells these shingles apart, and what it
mistakes changes the order alone. By each shingle, too, all meet one first.

Sets that meet by a shingle carry the parities of their shingles in 256 buckets. Each
shingle that only one of two sets has turns one parity, so sets whose parities
differ in more buckets than 0.8 allows different shingles are not similar, and
their texts are not sent (Sandes et al., "Bitmap filter", 2020). This loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsift.llm import simhash
from cellsift.llm.components import components
from cellsift.llm.decontaminate import _filter, _passes
from cellsift.llm.simhash import majority, shingle_hashes
from cellsift.llm.words import hidden, mapped, portions, texts
from cellsift.session import written

WORDS = 5
#: Least similarity, as shared shingles per shingles of both.
SHARED, OF = 4, 5
BANDS, DEPTH = 24, 4
#: One of so many sets is looked at for shingles that are common.
SAMPLED = 16
_FACTORS, _OFFSETS = (np.random.default_rng(s).integers(0, 1 << 63, BANDS * DEPTH, np.uint64) << np.uint64(1) | np.uint64(1) for s in (11, 12))
_MIX = np.random.default_rng(13).integers(0, 1 << 63, (BANDS, DEPTH), np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles."""
    return np.unique(shingle_hashes(text, WORDS))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set; none for an empty one."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    mixed = (found ^ found >> np.uint64(31)) * _FACTORS[0]
    for at in range(0, len(found), 512):
        rows = (mixed[at : at + 512, None] ^ _OFFSETS) * _FACTORS
        np.minimum(least, rows.min(axis=0), out=least)
    least ^= least >> np.uint64(29)
    keys = (least.reshape(BANDS, DEPTH) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _FACTORS[1]
    return (keys ^ keys >> np.uint64(32)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) have the least similarity."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * SHARED:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common * OF >= (len(both) - common) * SHARED


def signed(docs: DataFrame) -> DataFrame:
    """``_id, _text, set_id`` (a hash of the set of shingles), ``set_size, bands, fp`` (its SimHash) and PARITIES of each row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, bands, fps, odd = [], [], [], [], []
        for v in texts(batch):  # sets of a whole batch would take more than its texts
            found = shingle_set(v)
            ids.append(xxhash.xxh64_intdigest(found.tobytes(), 42))
            sizes.append(len(found))
            bands.append(band_keys(found))
            fps.append(majority(found))
            odd.append(parities(found))
        odd = np.array(odd, np.int64).reshape(-1, 4)
        columns = [batch.column("_id"), batch.column("_text"), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64)), *(pa.array(odd[:, k].copy()) for k in range(4))]
        return pa.RecordBatch.from_arrays(columns, ["_id", "_text", "set_id", "set_size", "bands", "fp", *PARITIES])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_text", "text").mapInArrow(mapped(step), f"_id {kind}, _text long, set_id long, set_size long, bands array<long>, fp long, {', '.join(f'{p} long' for p in PARITIES)}")


_SAME_KEY = lambda: F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_of_text"))


def marked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` (with _id and _text) and ``_hit``: false for no row whose _of and _of_text are
    in ``keys``, and true for few others. So only rows that may meet ``keys``
    need a shuffle, and texts stay where they are."""
    own = F.xxhash64(F.coalesce(F.col("_of").cast("string"), F.lit("")), "_of_text")
    sent = docs.sparkSession.sparkContext.broadcast(_filter(keys.select(own.alias("h"))))
    rows = docs.withColumn("_h", F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = batch.column("_h").to_numpy().view(np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(_passes(sent.value, h))], [*batch.schema.names, "_hit"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(mapped(step), f"{kinds}, _hit boolean").drop("_h")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b whose texts are similar. Pairs with one b follow each other mostly."""
    held: tuple = (None, None)
    for batch in batches:
        keep = []
        for b, of_a, of_b in zip(batch.column("b").to_pylist(), batch.column("of_a"), batch.column("of_b")):
            if b != held[0]:
                held = b, shingle_set(of_b.as_buffer().to_pybytes())
            keep.append(similar(shingle_set(of_a.as_buffer().to_pybytes()), held[1]))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])


def _shingle_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [shingle_set(v) for v in texts(batch)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], ["h"])


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles falls into each of 256 buckets, in four longs."""
    odd = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


PARITIES = ["p0", "p1", "p2", "p3"]


def may_fit(a: list[Column], b: list[Column], size_a: Column, size_b: Column) -> Column:
    """Whether two sets may be similar by their parities: at 0.8, the shingles of one alone are a ninth of both sizes at most."""
    turned = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))
    return turned * (SHARED + OF) <= (size_a + size_b) * (OF - SHARED)


def prefixes(found: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the common order, by which it may meet others; and
    by how many of these it may meet larger ones."""
    n = len(found)
    if not n:
        return found, 0
    late = _passes(common, found)
    order = np.concatenate([found[~late], found[late]])  # a set is sorted
    return order[: n - -(-n * SHARED // OF) + 1], n - -(-n * 2 * SHARED // (SHARED + OF)) + 1


def rare_shingles(sets: DataFrame) -> DataFrame:
    """``token, set_id, set_size, at, lead, root`` and PARITIES of the first shingles of ``sets``
    (set_id, text, set_size, root); ``lead`` marks those of the first ninth."""
    some = sets.filter(F.pmod(F.xxhash64("set_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(mapped(_shingle_rows), "h long")
    common = written(some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "common-shingles")
    sent = sets.sparkSession.sparkContext.broadcast(_filter(common))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2000, 4 << 20):
                found, odd = [], []
                for v in texts(part):  # whole sets are held one at a time
                    one = shingle_set(v)
                    found.append(prefixes(one, sent.value))
                    odd.append(parities(one))
                sizes = np.array([len(t) for t, _ in found], np.int64)
                row = np.repeat(np.arange(len(found)), sizes)
                at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                lead = at < np.array([n for _, n in found], np.int64)[row]
                tokens = np.concatenate([*(t for t, _ in found), np.empty(0, np.uint64)]).view(np.int64)
                taken = pa.array(row)
                held = np.array(odd)[row]
                columns = [pa.array(tokens), *(part.column(c).take(taken) for c in ("set_id", "set_size", "root")), pa.array(at), pa.array(lead), *(pa.array(held[:, k].copy()) for k in range(4))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "set_id", "set_size", "root", "at", "lead", *PARITIES])

    return sets.select("set_id", "set_size", "root", "text").mapInArrow(step, f"token long, set_id long, set_size long, root long, at long, lead boolean, {', '.join(f'{p} long' for p in PARITIES)}")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``a > b`` of ``sets`` (set_id, set_size, fp) by SimHash: each set with the least one
    of its fingerprint, and the least ones of linked fingerprints. Sets without shingles stay out."""
    filled = sets.filter("set_size > 0").select("set_id", "fp")
    prints = written(filled.groupBy("fp").agg(F.min("set_id").alias("least")), "fingerprints")
    same = filled.join(prints, "fp").filter("set_id > least").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    linked = simhash.links(prints).withColumnsRenamed({"a": "_a", "b": "_b"})
    for c in ("a", "b"):
        linked = linked.join(prints.select(F.col("fp").alias(f"_{c}"), F.col("least").alias(c)), f"_{c}")
    return same.union(linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all of ``sets`` (set_id distinct, set_size, bands, fp, first, PARITIES)
    that are similar and share a key or have linked fingerprints. ``rows`` has the texts."""
    fits = lambda a, b: F.least(a, b) * OF >= F.greatest(a, b) * SHARED
    # Sizes of the members that meet differ by a fifth at most, whichever they meet.
    own = [F.col(p) for p in PARITIES]
    other = [F.col(f"{p}_b") for p in PARITIES]
    sizes = sets.select(F.col("set_id").alias("b"), F.col("set_size").alias("size"), *(F.col(p).alias(f"{p}_b") for p in PARITIES))
    near = fingerprint_pairs(sets).join(sizes, "b").join(sets.select(F.col("set_id").alias("a"), "set_size", *PARITIES), "a")
    near = written(near.filter(fits(F.col("set_size"), F.col("size")) & may_fit(own, other, F.col("set_size"), F.col("size"))).select("a", "b"), "fingerprint-pairs")

    bands = sets.select("set_id", "set_size", F.explode("bands").alias("key"))
    groups = written(bands.groupBy("key").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).filter("least < most").drop("most"), "band-groups")
    held = written(bands.join(groups, "key"), "band-members")
    members = held.select("set_id").union(near.select("a")).union(near.select("b")).distinct()
    wanted = sets.join(members, "set_id", "left_semi").select("set_id", F.col("first._id").alias("_of"), F.col("first._text").alias("_of_text"))
    found = marked(rows.select("_id", "_text", "text"), wanted).filter("_hit").join(wanted, _SAME_KEY())
    of = written(found.groupBy("set_id").agg(F.first("text").alias("text")), "candidate-texts")

    def checked(pairs: DataFrame) -> DataFrame:
        of_a, of_b = (of.select(F.col("set_id").alias(c), F.col("text").cast("binary").alias(f"of_{c}")) for c in ("a", "b"))
        return written(pairs.join(of_a, "a").join(of_b, "b").mapInArrow(_checked, "a long, b long"), "links")

    def rooted(table: DataFrame, met: DataFrame) -> DataFrame:
        roots = components(met).select(F.col("node").alias("set_id"), F.col("root").alias("_root"))
        return table.drop("root").join(roots, "set_id", "left").withColumn("root", F.coalesce("_root", "set_id")).drop("_root")

    def apart(pairs: DataFrame, met: DataFrame) -> DataFrame:
        """Those of ``pairs`` that lie in different components."""
        roots = written(components(met).select("node", "root"), "roots")
        for c in ("a", "b"):
            pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left")
        return pairs.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")

    def mixed(table: DataFrame, key: str) -> DataFrame:
        """Rows of the groups that hold different components."""
        some = table.groupBy(key).agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select(key)
        return table.join(written(some, "mixed-groups"), key, "left_semi")

    stars = held.filter("set_id > least").select(F.col("set_id").alias("a"), F.col("least").alias("b"), "set_size").distinct()
    stars = stars.join(sizes, "b").filter(fits(F.col("set_size"), F.col("size"))).join(sets.select(F.col("set_id").alias("a"), *PARITIES), "a")
    stars = written(stars.filter(may_fit(own, other, F.col("set_size"), F.col("size"))).select("a", "b"), "stars")
    # A set of many copies has another least one by each key: it meets the least of all, then those still apart.
    met = checked(written(stars.groupBy("a").agg(F.min("b").alias("b")).union(near).distinct(), "pairs"))
    met = written(met.union(checked(written(apart(stars, met), "pairs"))), "links")
    left = mixed(written(rooted(held.select("key", "set_id", "set_size"), met), "labelled"), "key").select("set_id", "set_size", "root").distinct()
    tokens = written(rare_shingles(left.join(of, "set_id")), "rare-shingles")

    # Again all members of a group meet one of them first.
    hubs = written(tokens.groupBy("token").agg(F.min(F.struct(F.xxhash64("set_id", "token"), "set_id", "set_size", "root", *PARITIES)).alias("hub"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("token", "hub"), "hubs")
    stars = tokens.join(hubs, "token").filter((F.col("root") != F.col("hub.root")) & fits(F.col("set_size"), F.col("hub.set_size")) & may_fit(own, [F.col(f"hub.{p}") for p in PARITIES], F.col("set_size"), F.col("hub.set_size")))
    first = checked(written(stars.select(F.greatest("set_id", "hub.set_id").alias("a"), F.least("set_id", "hub.set_id").alias("b")).distinct(), "pairs"))
    met = written(met.union(first), "links")

    rest = written(mixed(written(rooted(tokens, met), "labelled"), "token"), "rare-shingles")
    larger = rest.select("token", F.col("set_id").alias("b"), F.col("set_size").alias("size"), F.col("at").alias("place"), F.col("root").alias("other"), *(F.col(p).alias(f"{p}_b") for p in PARITIES))
    order = (F.col("set_size") < F.col("size")) | (F.col("set_size") == F.col("size")) & (F.col("set_id") < F.col("b"))
    # What two sets share after their first common shingle, at most; the least that 0.8 asks for.
    reach = F.least(F.col("set_size") - F.col("at"), F.col("size") - F.col("place")) * (SHARED + OF) >= (F.col("set_size") + F.col("size")) * SHARED
    pairs = rest.filter("lead").join(larger, "token").filter(order & (F.col("root") != F.col("other")) & fits(F.col("set_size"), F.col("size")) & reach & may_fit(own, other, F.col("set_size"), F.col("size")))
    more = checked(written(pairs.select(F.greatest("set_id", "b").alias("a"), F.least("set_id", "b").alias("b")).distinct(), "pairs"))
    return met.union(more)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of similar texts: that with the
    smallest doc_id (nulls last), of rows equal in it any one.

    Words are told apart as by SimHash; a text of fewer than WORDS words is one
    shingle, null and wordless texts are one component. Very long texts are compared
    whole. Only documents that go, and rows that repeat, are looked up by a
    shuffle; a document that is neither stays where it is.
    """
    plain, back = hidden(docs, ("doc_id", "text"))
    rows = plain.withColumns({"_id": F.col("doc_id"), "_text": F.xxhash64("text")})
    keys = written(signed(rows), "shingle-keys")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_text")
    sets = written(keys.groupBy("set_id").agg(F.min(order).alias("first"), F.first("set_size").alias("set_size"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), *(F.first(p).alias(p) for p in PARITIES)), "shingle-sets")
    roots = components(links(rows, sets)).select(F.col("node").alias("set_id"), "root")
    rooted = sets.select("set_id", "first").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._id").alias("_of"), F.col("first._text").alias("_of_text"), F.lit(True).alias("_stays"))
    counted = keys.groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("_n"))
    judged = counted.join(stay, _SAME_KEY(), "left").select(F.col("_id").alias("_of"), F.col("_text").alias("_of_text"), F.coalesce("_stays", F.lit(False)).alias("_stays"), "_n")
    special = written(judged.filter("NOT _stays OR _n > 1").drop("_n"), "shingle-drops")

    seen = marked(rows, special)
    looked_up = seen.filter("_hit").join(special, _SAME_KEY(), "left").filter("_stays IS NULL OR _stays")
    repeated = looked_up.filter("_stays").dropDuplicates(["_id", "_text"])
    return seen.filter("NOT _hit").select(*back).union(looked_up.filter("_stays IS NULL").select(*back)).union(repeated.select(*back))
