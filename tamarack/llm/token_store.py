"""Token ids in ORC: run-length coded id lists, row indexes and Bloom filters on document ids.

``write_token_store`` deals documents into ascending ranges of ids (one shuffle of the texts), encodes each range in
order in Arrow batches and writes one ORC file a range.  Stripes are read in parallel; filters on ``doc_id`` prune
files, stripes and row groups by min/max and by Bloom filter without touching the ids.

Columns of a store: ``doc_id``, ``part`` (number of the range), ``local_start`` (ids before it in its range),
``n_tokens``, ``ids``.  A document's place in the whole store is ``local_start`` plus the ids of the ranges before it;
only the totals of the ranges are gathered for that, so no window ever runs over the documents.

Null or empty texts hold the end id alone.  Null doc_ids come first.  Repeated rows are kept, ties in doc_id are ordered
by text.  An empty table gives an empty store.  Other columns are ignored.  Ids are whole numbers; other types raise a
TypeError.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.bpe import byte_symbols
from tamarack.llm.common import by_bytes, lists_of, long_id, prepare, range_cuts, range_of, tidied
from tamarack.llm.segments import SegmentIds

#: Bytes of text given to the library at once.
ENCODE_BYTES = 1 << 20
STORE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizers library's tokenizer of a file, single-threaded, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Letters up to U+024F but for three: Unicode's versions agree on them, and each has one letter as its lower case.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
#: A segment of one word with marks behind it: patterns of both layouts take all the letters, then all the marks.
_SIMPLE = re.compile(rf"(\n?)( ?)([{_LETTERS}]+)([!-/:-@\[-`{{-~]*)")


def segment_encoder(tokenizer, lower: bool = False) -> Callable[[list[str]], tuple[list[int], list[int]]]:
    """The library's ids of segments, and how many each has: the words of simple ones go to its model as they are.

    lower: for the layout that drops white space and lower-cases; else for byte-level words.
    """
    model, symbols = tokenizer.model, byte_symbols()
    ascii_symbols = {i: symbols[i] for i in range(128)}

    @functools.lru_cache(maxsize=4096)
    def whole(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids if text else []

    def of_word(word: str) -> list[int]:
        shown = word.translate(ascii_symbols) if word.isascii() else "".join([symbols[b] for b in word.encode()])
        return [x.id for x in model.tokenize(shown)]

    def encode(segments: list[str]) -> tuple[list[int], list[int]]:
        simple = [m if m and not (m[1] and m[2]) and "<" not in m[4] else None for m in map(_SIMPLE.fullmatch, segments)]
        other = [x for x, m in zip(segments, simple, strict=True) if m is None]
        coded = iter([e for part in by_bytes(other, ENCODE_BYTES) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)])
        ids: list[int] = []
        ends = []
        for m in simple:
            if m is None:
                ids += next(coded).ids
            elif lower:
                ids += of_word(m[3].lower())
                ids += whole(m[4])
            else:
                ids += whole(m[1])
                ids += of_word(m[2] + m[3])
                ids += whole(m[4])
            ends.append(len(ids))
        return ids, np.diff(ends, prepend=0)

    return encode


@functools.lru_cache(maxsize=4)
def segment_ids(path: str) -> SegmentIds:
    """Ids of texts for a byte-level tokenizer's file; the library encodes each distinct segment."""
    return SegmentIds(segment_encoder(load_tokenizer(path)))


def encode_documents(ordered: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of STORE_SCHEMA from (doc_id, text), in the order of each partition's rows."""

    def run(batches):
        part, start, segments = TaskContext.get().partitionId(), 0, segment_ids(path)
        for batch in batches:
            values, counts = segments.ids_of(batch.column("text"), end_id)
            local = start + np.cumsum(counts) - counts
            start += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(local), pa.array(counts), lists_of(values, counts)],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )

    return ordered.mapInArrow(tidied(run), STORE_SCHEMA)


def write_token_store(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20, row_index_stride: int = 1000, bloom_fpp: float = 0.01, compress: str = "zstd") -> None:
    """Encode docs and write them to ORC files in ascending order of their ids, each followed by end_id."""
    prepare(docs.sparkSession)
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cuts = range_cuts(rows, "doc_id")
    dealt = rows.repartitionById(max(1, len(cuts)), range_of("doc_id", cuts).cast("int"))
    ordered = dealt.sortWithinPartitions("doc_id", "text")
    writer = encode_documents(ordered, tokenizer_path, end_id).write
    for key, value in {
        "orc.compress": compress.upper(),
        "orc.stripe.size": stripe_bytes,
        "orc.row.index.stride": row_index_stride,
        "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": bloom_fpp,
    }.items():
        writer = writer.option(key, str(value))
    writer.option("compression", compress).orc(out)


def read_token_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of a store; doc_ids (a stated short list) prunes stripes and row groups by metadata."""
    store = spark.read.schema(STORE_SCHEMA).orc(path)
    return store if doc_ids is None else store.where(F.col("doc_id").isin(doc_ids))


def part_offsets(store: DataFrame) -> DataFrame:
    """(part, offset): the ids of all ranges before each.  One row for each task that wrote the store."""
    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))


def with_start(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Add start, the ids of all documents before it.  The broadcast side has one row a writing task."""
    return rows.join(F.broadcast(part_offsets(store)), "part").withColumn("start", F.col("local_start") + F.col("offset"))


def digests(store: DataFrame) -> DataFrame:
    """(doc_id, part, local_start, n_tokens, ids_crc32) as read back from the files."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            buffer = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crcs = [zlib.crc32(buffer[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())],
                names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
            )

    prepare(store.sparkSession)
    return store.select("doc_id", "part", "local_start", "ids").mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
