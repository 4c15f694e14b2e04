"""Near-duplicates by MinHash: a multi-index Hamming join over b-bit signatures, exact confirmation, components.

1. Each text's set of word shingles is hashed; texts of equal sets form classes, and only classes go on.
2. A class has a signature of SLOTS MinHash values of 16 bits.  It is split into CHUNKS chunks of WIDTH slots.  By the
   pigeonhole principle two signatures that differ in fewer than 2 * CHUNKS slots differ in at most one slot of some
   chunk, so each chunk is indexed WIDTH times, once for every slot that may be wrong: all pairs under that distance
   meet under some key.  At similarity 0.8 the distance is binomial with mean 12.8 of 64; 32 or more has probability
   8e-8.
3. Pairs that meet are pruned by the sizes of their sets, the distance of 2-bit signatures (at most that of the full ones,
   so MAX_SKETCH_DISTANCE drops no pair under the distance of 2) and odd sketches (after Mitzenmacher, Pagh and Pham,
   2014; used as a bound, which drops no link), and confirmed on full sets.
4. No group's pairs are all emitted.  First each id is paired with one other, the smallest of its buckets' smallest ids
   that the prunes allow; most copies get linked by that.  Components follow.  Then, bucket by bucket, members outside
   the largest component are paired with all members of other components; pairs within a component are never needed.
   Components are taken again.

Links, components and sets stay distributed; intermediate tables go to the shared folder.  A text with fewer words than
a shingle has its whole sequence as its one shingle; one without words (or null) has none and is linked with nothing.
Rows that share a doc_id but not a text are judged each by its own text; classes with the same smallest id are one
node.  Null ids are linked with nothing, have no component and are kept.  Ids are whole numbers; other types raise a
TypeError.  Repeated rows each get a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import binary_texts, long_id, materialize, prepare, shuffle_partitions, tidied

SLOTS, WIDTH = 64, 4
CHUNKS = SLOTS // WIDTH
MAX_SKETCH_DISTANCE = 2 * CHUNKS - 1
#: Bits of an odd sketch: each shingle flips one, so two sketches differ where an odd number of differing shingles fall.
ODD_BITS = 1024
ODD_LONGS = ODD_BITS // 64

_SEEDED = np.random.Generator(np.random.PCG64(9))
_XOR = _SEEDED.integers(0, 2**64, SLOTS, np.uint64)
_ODD = _SEEDED.integers(0, 2**64, SLOTS, np.uint64) | np.uint64(1)
_KEY = _SEEDED.integers(0, 2**64, (SLOTS, WIDTH), np.uint64) | np.uint64(1)
_FIRST, _SECOND, _THIRD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Distinct words whose hashes a worker keeps.
_KEPT_WORDS = 200_000
#: Shingles worked on at once, so that the arrays stay in the processor's cache.
_AT_ONCE = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _SECOND
    x = (x ^ (x >> np.uint64(27))) * _THIRD
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingle_sets(items: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, letters A to Z lower-cased."""
    if len(_words) > _KEPT_WORDS:
        _words.clear()
    split = [x.lower().split() for x in items]
    counts = [len(x) for x in split]
    flat = np.fromiter(map(_words.__getitem__, chain.from_iterable(split)), np.uint64, sum(counts))
    out, at = [], 0
    for n in counts:
        w = flat[at : at + n]
        at += n
        if not n:
            out.append(w)
            continue
        m = min(n, k)
        h = np.full(n - m + 1, m, np.uint64)
        for j in range(m):
            h = (h ^ w[j : j + n - m + 1]) * _FIRST
            h ^= h >> np.uint64(29)
        out.append(np.unique(_mixed(h)))
    return out


def _to_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(set, slot) MinHash values of 16 bits of sets that aren't empty."""
    out = np.empty((len(sets), SLOTS), np.uint64)
    first = 0
    while first < len(sets):
        last, room = first, _AT_ONCE
        while last < len(sets) and (last == first or len(sets[last]) <= room):
            room -= len(sets[last])
            last += 1
        part = sets[first:last]
        values = np.concatenate(part)
        starts = np.cumsum([0, *map(len, part)])[:-1]
        for i in range(SLOTS):
            out[first:last, i] = np.minimum.reduceat((values ^ _XOR[i]) * _ODD[i], starts)
        first = last
    return (out * _SECOND) >> np.uint64(48)


def odd_sketch(values: np.ndarray) -> bytes:
    return np.packbits((np.bincount((values >> np.uint64(20)).astype(np.int64) & (ODD_BITS - 1), minlength=ODD_BITS) & 1).astype(np.uint8)).tobytes()


def _two_bits(sig: np.ndarray) -> np.ndarray:
    """(set, 2) longs of the lowest two bits of each slot."""
    return ((sig & np.uint64(3)).reshape(-1, 2, 32) << (2 * np.arange(32)).astype(np.uint64)).sum(2, dtype=np.uint64)


def _slots(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(x[: 2 * SLOTS] for x in batch.column("sig").to_pylist()), "<u2").astype(np.uint64).reshape(-1, SLOTS)


_TRAITS = "id long, n long, s1 long, s2 long, odd struct<" + ", ".join(f"o{i}: long" for i in range(ODD_LONGS)) + ">"


def _traits(batches):
    """(id, n, s1, s2, odd): size, 2-bit signature and odd sketch of each class."""
    kind = pa.struct([(f"o{i}", pa.int64()) for i in range(ODD_LONGS)])
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = _two_bits(_slots(batch))
        data = np.frombuffer(b"".join(x[2 * SLOTS :] for x in batch.column("sig").to_pylist()), "<i8").reshape(-1, ODD_LONGS)
        odd = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(data[:, i])) for i in range(ODD_LONGS)], fields=list(kind))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), _to_long(sketch[:, 0]), _to_long(sketch[:, 1]), odd], names=["id", "n", "s1", "s2", "odd"])


def _profile(k: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(binary_texts(batch.column("text")), k)
            sizes = np.array([len(x) for x in sets], np.int64)
            full = [x for x in sets if len(x)]
            sums = np.zeros((2, len(sets)), np.uint64)
            sums[0, sizes > 0] = [_mixed(x + _FIRST).sum(dtype=np.uint64) for x in full]
            sums[1, sizes > 0] = [_mixed(x ^ _THIRD).sum(dtype=np.uint64) for x in full]
            written = iter(signatures(full).astype("<u2") if full else ())
            sig = [next(written).tobytes() + odd_sketch(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), _to_long(sums[0]), _to_long(sums[1]), pa.array(sig, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"])
        _words.clear()

    return run


def _index(batches):
    """(key, id): WIDTH keys a chunk, each leaving out one slot."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _slots(batch)
        keys = np.empty((len(sig), SLOTS), np.uint64)
        for chunk in range(CHUNKS):
            part = sig[:, chunk * WIDTH : (chunk + 1) * WIDTH] + np.uint64(1)
            for wrong in range(WIDTH):
                i = chunk * WIDTH + wrong
                keys[:, i] = _mixed(np.uint64(i + 1) + sum(part[:, j] * _KEY[i, j] for j in range(WIDTH) if j != wrong))
        yield pa.RecordBatch.from_arrays([_to_long(keys.reshape(-1)), pa.array(np.repeat(batch.column("id").to_numpy(), SLOTS))], names=["key", "id"])


def _differing(a: str, b: str) -> Column:
    """Number of slots in which two long columns of 2-bit values differ."""
    return F.expr(f"bit_count(({a} ^ {b} | shiftrightunsigned({a} ^ {b}, 1)) & 6148914691236517205L)")


def _may_link(a: str, b: str, percent: int) -> Column:
    sizes = F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)")
    return sizes & (_differing(f"{a}.s1", f"{b}.s1") + _differing(f"{a}.s2", f"{b}.s2") <= MAX_SKETCH_DISTANCE)


def _odd_allows(a: str, b: str, percent: int) -> Column:
    """Can two sets be similar enough?  Each differing shingle flips one bit, so at least as many differ as there are unlike bits: this drops no link."""
    unlike = " + ".join(f"bit_count({a}.odd.o{i} ^ {b}.odd.o{i})" for i in range(ODD_LONGS))
    return F.expr(f"({unlike}) * {100 + percent} <= ({a}.n + {b}.n) * {100 - percent}")


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of distinct (a, b) whose full shingle sets are similar enough.  Only the texts of ids in pairs are shuffled."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()

    def sets(batches):
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(binary_texts(batch.column("text")), k)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "set"])

    def compare(batches):
        for batch in batches:
            same = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                if not len(p):
                    continue
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                same[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(same))

    texts = docs.join(ids, "id", "left_semi").select("id", "text")
    found = texts.mapInArrow(tidied(sets), "id long, set binary")
    one = pairs.join(found.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = one.join(found.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(tidied(compare), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b): the smallest id that can be reached.

    Each round takes the smallest label among an id and its neighbours, then that label's own label, and ends when no
    label changes; every round is written to the shared folder, so lineage stays short.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("id"), "component"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        least = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("was"), F.least("component", "theirs").alias("now"))
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("beyond"))
        step = least.join(jump, "now", "left").select("id", "was", F.least("now", "beyond").alias("component"))
        step = materialize(step, "labels")
        labels = step.select("id", "component")
        if not step.where("component <> was").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: percent is the least Jaccard similarity of a link."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    by_id = rows.withColumnRenamed("doc_id", "id")
    profiles = materialize(rows.mapInArrow(tidied(_profile(words)), "doc_id long, n long, h1 long, h2 long, sig binary"), "profiles")
    linkable = profiles.where(F.col("n").cast("boolean") & F.col("doc_id").isNotNull())
    classes = linkable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig"), F.count("*").alias("members"))
    # many small tasks, as each class gives SLOTS rows of the index
    classes = materialize(classes.repartition(shuffle_partitions(spark), "id"), "classes")
    traits = classes.select("id", "n", "sig").mapInArrow(tidied(_traits), _TRAITS)

    keys = classes.select("id", "sig").mapInArrow(tidied(_index), "key long, id long")
    met = keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1").select("key", "least")
    buckets = materialize(keys.join(met, "key"), "buckets")

    star = buckets.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(traits.select(F.col("id").alias("a"), F.struct("id", "n", "s1", "s2", "odd").alias("y")), "a").join(traits.select(F.col("id").alias("b"), F.struct("id", "n", "s1", "s2", "odd").alias("x")), "b")
    tried = star.where(_may_link("x", "y", percent) & _odd_allows("x", "y", percent)).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    tried = materialize(tried, "first-pairs")
    links = materialize(_confirm(tried, by_id, words, percent), "first-links")
    found = components(links)

    placed = materialize(buckets.join(found, "id", "left").select("key", F.coalesce("component", "id").alias("c"), "id"), "placed")
    share = placed.groupBy("key", "c").agg(F.count("*").alias("size")).groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "c")).alias("largest")).where("parts > 1").select("key", F.col("largest.c").alias("main"))
    mixed = placed.join(share, "key").join(traits, "id").select("key", "c", "main", F.struct("id", "n", "s1", "s2", "odd").alias("m"))
    outside = mixed.where("c <> main").select("key", F.col("c").alias("cx"), F.col("m").alias("x"))
    others = mixed.select("key", F.col("c").alias("cy"), F.col("m").alias("y"), (F.col("c") != F.col("main")).alias("also"))
    meet = outside.join(
        others,
        (outside["key"] == others["key"]) & (F.col("cx") != F.col("cy")) & (F.col("x.id") != F.col("y.id")) & (~F.col("also") | (F.col("x.id") < F.col("y.id"))) & _may_link("x", "y", percent) & _odd_allows("x", "y", percent),
    )
    more = meet.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    more = materialize(more.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "more-pairs")
    if more.limit(1).count():
        further = materialize(_confirm(more, by_id, words, percent), "more-links")
        if further.limit(1).count():
            found = components(links.union(further))

    shared = classes.where("members > 1").select("h1", "h2", "n", F.col("id").alias("first"))
    member = profiles.select("doc_id", "n", "h1", "h2").join(shared, ["h1", "h2", "n"], "left").select("doc_id", "n", F.coalesce("first", "doc_id").alias("id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id"))
    named = member.join(found, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
