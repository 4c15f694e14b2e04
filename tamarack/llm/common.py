"""What the training-data operators share: inputs, shared folders and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.runtime import materialize, ship_package, shared_dir

__all__ = ["materialize", "prepare", "shared_dir"]

#: Arrow batches handed to Python workers hold at most this many bytes, so that long texts stay in bounded memory.
ARROW_BATCH_BYTES = 2 << 20
ARROW_BATCH_ROWS = 4096

#: ASCII white space, the separators of words in every operator here.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session (a user's own setting stays) and ship the package to its workers."""
    ship_package(spark)
    for key, default, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", None, ARROW_BATCH_BYTES),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", ARROW_BATCH_ROWS),
    ):
        if default is None or spark.conf.get(key, default) == default:
            spark.conf.set(key, str(value))
    return spark


def give_back() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run):
    """An Arrow function that gives its freed memory back to the system at the end of each task.

    Idle workers of earlier stages stay, beside an executor's heap, so what they keep counts in every later stage.
    """

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def long_id(docs: DataFrame, id_col: str) -> Column:
    """The id column as a long; ids have to be whole numbers."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"ids of {id_col} are {kind}, not whole numbers")
    return F.col(id_col).cast("long")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where docs has such columns."""
    taken = {c.lower() for c in docs.columns}
    return [next(x for x in (n + "_" * i for i in range(len(taken) + 1)) if x.lower() not in taken) for n in names]


def remove_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the ids in gone, and with one row of each id that is left; rows of null ids stay.

    gone may be as large as a fixed share of docs, so it isn't broadcast by hand; anti-join and window share one
    shuffle by id.
    """
    left = docs.join(gone.select(F.col(id_col)).distinct(), id_col, "left_anti")
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    (row,) = unused(docs, "__row")
    return left.withColumn(row, first).where((F.col(row) == 1) | F.col(id_col).isNull()).drop(row).select(*docs.columns)


def told_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __node, which rows share that are equal in id and text: the id, or for further texts of one id a hash of both from 2**62 up.

    Null ids stay null.  Tables of unique ids cost one aggregate of ids and hashes; only others are joined.
    """
    digest = F.xxhash64(F.col(text_col))
    s_id, s_first = unused(docs, "s_id", "s_first")
    several = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(s_id)).agg(F.min(digest).alias(s_first), F.max(digest).alias("s_last"))
    several = materialize(several.where(F.col(s_first) != F.col("s_last")).select(s_id, s_first), "ids-of-several-texts")
    if not several.limit(1).count():
        return docs.withColumn("__node", F.col(id_col))
    further = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    node = F.when(F.col(s_first).isNull() | (F.col(s_first) == digest), F.col(id_col)).otherwise(further)
    return docs.join(several, F.col(id_col) == F.col(s_id), "left").withColumn("__node", node).drop(s_id, s_first)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of input that a range of ids holds at most on average, and ranges that a plan lists at most.
RANGE_BYTES, MAX_RANGES = 256 << 20, 20_000


def range_count(rows: DataFrame) -> int:
    """As many ranges as shuffle partitions, or more where Spark's estimate of the bytes of rows asks for it."""
    estimate = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = estimate < 1 << 60  # without statistics the estimate is a huge number
    return max(shuffle_partitions(rows.sparkSession), min(MAX_RANGES, -(-estimate // RANGE_BYTES)) if known else 1)


def range_cuts(rows: DataFrame, key: str) -> list[int]:
    """Ascending values of a long column that cut its rows into about equal ranges, range_count() of them; the last is its maximum.

    Only the column is read, and percentile_approx summarises it; each cut is a value that occurs.  Null counts as the
    smallest long.
    """
    n = range_count(rows)
    value = F.coalesce(F.col(key), F.lit(-(2**63)))
    found = rows.agg(F.percentile_approx(value, [k / n for k in range(1, n)] + [1.0], 10 * n).alias("c"), F.max(value).alias("m")).first()
    return sorted({*(found.c or ()), *([] if found.m is None else [found.m])})


def cuts_array(cuts: list[int]) -> str:
    """SQL for the cuts."""
    if not cuts:
        return "CAST(array() AS array<bigint>)"
    return f"array({', '.join(f'{c}L' if c > -(2**63) else 'CAST(-9223372036854775808 AS BIGINT)' for c in cuts)})"


def range_of(key: str, cuts: list[int]) -> Column:
    """The number of cuts below the key, by binary search: range k holds the keys above cut k-1 up to cut k."""
    steps = ", ".join(str(2**k) for k in reversed(range(max(1, len(cuts).bit_length()))))
    value = f"coalesce({key}, CAST(-9223372036854775808 AS BIGINT))"
    return F.expr(f"aggregate(array({steps}), 0, (lo, s) -> if(lo + s <= {len(cuts)} AND get({cuts_array(cuts)}, lo + s - 1) < {value}, lo + s, lo))")


def word_count(text: str) -> Column:
    """Number of words of a text column; null counts as 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def binary_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of a string column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def joined(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each item begins (one more entry than items)."""
    starts = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(x) for x in items], out=starts[1:])
    return np.frombuffer(b"".join(items), np.uint8), starts


def lists_of(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def by_bytes(items: list[str], limit: int) -> list[list[str]]:
    """Deal items into consecutive batches of about equal size in bytes: as many as keep the mean at the limit or below."""
    sizes = [(len(x) if x.isascii() else len(x.encode())) + 16 for x in items]
    share = sum(sizes) / max(1, -(-sum(sizes) // limit))
    out: list[list[str]] = []
    upto = 0
    for x, n in zip(items, sizes, strict=True):
        # the batch that holds the item's middle
        if not out or upto + n / 2 > share * len(out):
            out.append([])
        out[-1].append(x)
        upto += n
    return out
