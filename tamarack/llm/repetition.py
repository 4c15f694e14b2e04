"""Quality rules with suffix-array repetition.

The suffixes of a text's words that share five words or more with another one are sorted by prefix doubling (a suffix
whose first five words are unique in its text can't belong to an interval of that depth, so it isn't sorted).  Adjacent
suffixes give longest common prefixes; each suffix is covered as far as the longer one of its two, which is the depth of
its deepest interval, so the union of these spans is the union of all maximal repeated substrings.  Rules limit the
share of the text's word characters that the union covers, and the longest repeat.

All arrays are built over an Arrow batch of bounded bytes at once.  Null and empty texts have no words and fail the base
rules.  A text of any length is handled whole, in memory that grows with it alone.  Repeated rows each get a row; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import binary_texts, joined, prepare, tidied

SYMBOLS = b"#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WINDOW = 5
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
#: Bytes that begin a code point of a word: neither white space nor continuation bytes.
_IN_WORD = np.array([x not in b" \t\n\v\f\r" and x & 0xC0 != 0x80 for x in range(256)])


@dataclass(frozen=True)
class Rules:
    """Limits; a text that exceeds one isn't kept.  base_*: the base rules of words and repeated five-word windows."""

    base_min_words: int = 10
    base_max_repeat_percent: int = 20
    max_covered_fraction: float = 0.2
    max_longest_repeat: int = 50


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their keys, and for each row in that order the place of the first one that equals it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            ordered = k[order]
            new[1:] |= ordered[1:] != ordered[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _shared_windows(words: np.ndarray, text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places whose five words occur at another place of the same text, ascending, by 64-bit hashes."""
    whole = np.flatnonzero(np.arange(len(words)) + _WINDOW <= end)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    key = (text[whole].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(_WINDOW):
        key = (key ^ mixed[whole + j]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return whole[:0]
    return whole[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]


def repeats(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on (five at least, or 0) occur elsewhere in its text too.

    words: ids of the words of all texts; starts: where each text begins, and the end of the last.
    """
    n = len(words)
    depth = np.zeros(n, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = np.asarray(starts[1:])[text] if n else depth
    at = _shared_windows(words, text, end)
    if not len(at):
        return depth
    padded = np.append(words, np.full(_WINDOW, -1))

    def word(where: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.where(where < ends, padded[np.minimum(where, n)], -1)

    number = np.full(n + 1, -1, np.int64)  # of a place among those sorted
    number[at] = np.arange(len(at))
    order, first = _groups(text[at], *[words[at + j] for j in range(_WINDOW)])
    rank = np.empty(len(at), np.int64)  # the place of the first suffix that equals it in so many words
    rank[order] = first
    levels, length = [rank], _WINDOW
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=len(at))[rank] > 1)
        if not len(tied):
            break
        beyond, ends = at[tied] + length, end[at[tied]]
        known = number[np.minimum(beyond, n)]
        known = np.where((known >= 0) & (beyond < ends), rank[known], -1)
        order, first = _groups(rank[tied], *[word(beyond + j, ends) for j in range(_WINDOW)], known)
        old = rank[tied][order]
        begins = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), np.arange(len(old)), 0))
        rank = rank.copy()
        rank[tied[order]] = old + first - begins
        levels.append(rank)
        length *= 2
    sorted_at = np.empty(len(at), np.int64)
    sorted_at[rank] = at
    a, b = sorted_at[:-1], sorted_at[1:]
    shared = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        i, j = a + shared, b + shared
        x, y = number[np.minimum(i, n)], number[np.minimum(j, n)]
        inside = (i < end[a]) & (j < end[b]) & (x >= 0) & (y >= 0)
        shared += np.where(inside & (levels[k][x] == levels[k][y]), _WINDOW << k, 0)
    for _ in range(_WINDOW - 1):  # unequal words stay unequal at the same place
        i, j = a + shared, b + shared
        shared += (i < end[a]) & (j < end[b]) & (text[a] == text[b]) & (padded[np.minimum(i, n)] == padded[np.minimum(j, n)])
    shared[shared < _WINDOW] = 0
    depth[a] = shared
    depth[b] = np.maximum(depth[b], shared)
    return depth


def measure(items: list[bytes]) -> dict[str, np.ndarray]:
    """What the rules need of each text."""
    split = [x.split() for x in items]
    counts = np.array([len(x) for x in split], np.int64)
    starts = np.append(0, np.cumsum(counts))
    n, texts_n = int(starts[-1]), len(items)
    ids: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter(map(ids.__getitem__, chain.from_iterable(split)), np.int64, n)
    data, byte_starts = joined(items)
    total = lambda flags, begins: np.add.reduceat(np.append(flags, 0).astype(np.int64), begins[:-1]) * (np.diff(begins) > 0) if texts_n else np.zeros(0, np.int64)
    dup_lines = []
    for x in items:
        lines = [y for y in x.split(b"\n") if y.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    depth = repeats(words, starts)
    reach = np.maximum.accumulate(np.where(depth > 0, np.arange(n) + depth, 0)) if n else depth
    covered = reach > np.arange(n)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) - np.array([sum(c & 0xC0 == 0x80 for c in w) if not w.isascii() else 0 for w in ids], np.int64)
    chars = lengths[words] if n else words
    longest = np.maximum.reduceat(np.append(depth, 0), starts[:-1]) * (counts > 0) if texts_n else counts
    return {
        "n_words": counts,
        "word_chars": total(_IN_WORD[data], byte_starts),
        "n_symbols": total(_IS_SYMBOL[data], byte_starts),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": total(covered, starts),
        "covered_chars": total(np.where(covered, chars, 0), starts),
        "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of every whole text, base_failed, covered_fraction, longest_repeat and kept; no shuffle."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat"]

    def run(batches):
        for batch in batches:
            found = measure(binary_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(found[x]) for x in names]], names=["doc_id", *names])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(tidied(run), f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{x} long" for x in names))
    failed = (F.col("n_words") < rules.base_min_words) | (100 * F.col("n_repeat_words") > rules.base_max_repeat_percent * F.col("n_words"))
    fraction = F.when(F.col("word_chars") > 0, F.col("covered_chars") / F.col("word_chars")).otherwise(F.lit(0.0))
    fine = (fraction <= rules.max_covered_fraction) & (F.col("longest_repeat") <= rules.max_longest_repeat)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fine).alias("kept"), fraction.alias("covered_fraction"), "longest_repeat"
    )
