"""Document fingerprints: content-defined chunks, their digests weighted by length, and containment.

A text's UTF-8 bytes are cut where a gear hash of the last sixteen bytes has zeros under a mask.  Chunking is normalised:
no cut within ``MIN`` bytes, a rare mask up to ``NORMAL`` bytes and a common one after it, so that lengths gather about
the middle; a chunk ends at ``MAX`` bytes at the latest.  As cuts depend on nearby bytes only, an insertion moves the
cuts near it and no others.  A fingerprint is the sorted set of its chunks, 16 hex digits each: 48 bits of digest and
16 bits of length.

Containment of A in B is the length of A's distinct chunks that B has too over the length of all of A's distinct
chunks.  A null or empty text has the empty fingerprint: containment 1 in an empty one, 0 in others.  Equal texts have
equal fingerprints; texts of under ``MIN`` bytes are one chunk.  Repeated rows each get a row; other columns are ignored;
an empty table gives no rows.  Ids that are put in order are whole numbers; other types raise a TypeError.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import binary_texts, cuts_array, joined, long_id, prepare, range_cuts, range_of

MIN, NORMAL, MAX = 16, 48, 256
#: Bits 12 to 15 of the gear hash for the common mask (1 in 16), bits 9 to 15 for the rare one (1 in 128).
COMMON_MASK, RARE_MASK = np.uint32(0xF000), np.uint32(0xFE00)

_SEEDED = np.random.Generator(np.random.PCG64(20240229))
_GEAR = _SEEDED.integers(0, 2**32, 256, np.uint32)
_BYTE = _SEEDED.integers(0, 2**63, 256, np.uint64) | np.uint64(1)
_PLACE = _SEEDED.integers(0, 2**63, MAX, np.uint64) | np.uint64(1)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of it and the fifteen before it, by doubling the span four times."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8):
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
    return h


def _cuts(n: int, places: list[int], rare: list[bool]) -> list[int]:
    """Ends of the chunks of a text of n bytes; places after which a cut may be, ascending, and which pass the rare mask."""
    out, start, k, m = [], 0, 0, len(places)
    while n - start > MIN:
        k = bisect_left(places, start + MIN, k)
        end = min(start + MAX, n)
        while k < m and (at := places[k]) < end:
            if rare[k] or at >= start + NORMAL:
                end = at
                break
            k += 1
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunk_sets(items: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct chunks, ascending, as digest << 16 | length."""
    data, starts = joined(items)
    if not len(data):
        return [np.empty(0, np.uint64)] * len(items)
    h = gear(data)
    places = np.flatnonzero((h & COMMON_MASK) == 0) + 1
    rare = (h[places - 1] & RARE_MASK) == 0
    bounds = np.searchsorted(places, starts)
    begins, counts = [], []
    for i, n in enumerate(np.diff(starts).tolist()):
        a, b, at = bounds[i], bounds[i + 1], int(starts[i])
        ends = _cuts(n, (places[a:b] - at).tolist(), rare[a:b].tolist())
        begins.extend([at + e for e in (0, *ends[:-1])] if ends else ())
        counts.append(len(ends))
    begin = np.array(begins, np.int64)
    length = np.diff(np.append(begin, len(data)))
    spread = np.repeat(begin, length)
    value = _BYTE[data]
    value *= _PLACE[np.arange(len(data)) - spread]
    value ^= value >> np.uint64(29)
    digest = np.add.reduceat(value, begin)
    digest ^= digest >> np.uint64(32)
    digest *= np.uint64(0x9E3779B97F4A7C15)
    packed = (digest >> np.uint64(16) << np.uint64(16)) | length.astype(np.uint64)
    return [np.unique(x) for x in np.split(packed, np.cumsum(counts)[:-1])]


def written(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's length that b holds too."""
    if not len(a):
        return float(not len(b))
    weight = np.uint64(0xFFFF)
    common = np.intersect1d(a, b, assume_unique=True)
    return float((common & weight).sum() / (a & weight).sum())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; no shuffle."""

    def run(batches):
        for batch in batches:
            out = [written(x) for x in chunk_sets(binary_texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def in_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents dealt into ranges of descending ids, each followed by the first document of the range after it.

    Returns (range, ahead, doc_id, text), one task a range, sorted: whoever reads a range in order meets each document's
    successor right after it.  The ends of ranges are ids that percentile_approx found in the table, one a partition,
    so the first document of each range is known before the one shuffle of the texts.  After the smallest id comes the
    largest.  Null ids count as the smallest; of equal ids the smaller text is first.
    """
    rows = docs.select(F.coalesce(long_id(docs, id_col), F.lit(-(2**63))).alias("key"), long_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cuts = range_cuts(rows, "key")
    rows = rows.withColumn("range", range_of("key", cuts))
    first = F.expr(f"coalesce(get({cuts_array(cuts)}, range) = key, false)")
    after = F.when(F.col("range") == len(cuts) - 1, F.lit(0)).otherwise(F.col("range") + 1)
    copies = F.when(first, F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ahead")), F.struct(after.alias("range"), F.lit(1).alias("ahead")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ahead"))))
    dealt = rows.select(F.explode(copies).alias("at"), "key", "doc_id", "text").select("at.range", "at.ahead", "key", "doc_id", "text")
    dealt = dealt.repartitionById(max(1, len(cuts)), F.col("range").cast("int"))
    return dealt.sortWithinPartitions("range", "ahead", F.desc("key"), "text").select("range", "ahead", "doc_id", "text")


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of text, and it with its last third replaced by as many code points (or all) of the following one."""
    a, b = text.decode("utf-8", "replace"), following.decode("utf-8", "replace")
    third = len(a) // 3
    return len(a), (a[: len(a) - third] + b[:third]).encode()


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document's, and both likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        last = None  # the document whose successor is still to come: range, ahead, id, bytes, chunks
        for batch in batches:
            items = binary_texts(batch.column("text"))
            own = chunk_sets(items)
            pairs = []
            for row in zip(batch.column("range").to_pylist(), batch.column("ahead").to_pylist(), batch.column("doc_id").to_pylist(), items, own, strict=True):
                if last is not None and last[0] == row[0] and not last[1]:
                    pairs.append((last, row))
                last = row
            edits = [edited(a[3], b[3]) for a, b in pairs]
            sets = chunk_sets([e for _, e in edits])
            out = [
                (a[2], n, hashlib.sha256(e).hexdigest(), written(a[4]), written(s), containment(a[4], s), containment(a[4], b[4]))
                for (a, b), (n, e), s in zip(pairs, edits, sets, strict=True)
            ]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    prepare(docs.sparkSession)
    return in_ranges(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
