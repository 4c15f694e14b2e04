"""Ids of whole texts from the ids of their segments, each distinct segment being worked out once.

A batch of texts stays in Arrow's buffers.  Segments are cut where no token can cross (see ``tiling`` and ``spaced``),
looked up in arrays by their bytes, and the ids of all texts are gathered at once.  A segment of at most SHORT bytes is
its own key, padded to two 64-bit numbers with its length; longer ones are kept in a dictionary, very long ones aren't
kept beyond their batch.  So results never depend on a hash.  Memory is bounded: beyond ``limit`` segments all are
forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of a segment that is its own key, and of one that is kept.
SHORT, KEPT = 15, 64
#: Segments worked out, and looked up, at once, which bounds what that takes in memory.
AT_ONCE, LOOKED_UP = 1 << 14, 1 << 18
_CUT, _OTHER = 1, 2
_WHITE = np.zeros(256, np.uint8)
_WHITE[[0x20, 0x0A]] = _CUT
_WHITE[[0x09, 0x0B, 0x0C, 0x0D]] = _OTHER
_PLAIN = np.isin(np.arange(256), np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tiling(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of segments that tile the texts: cut before a single space or line end between two other characters.

    GPT-2's pattern never reaches across such a place.  A space begins a new word, a line end is a word of its own, and
    the word before it ends there.  A segment that ends with white space beyond ASCII is an exception; see SegmentIds.
    """
    white = _WHITE[data]
    at = np.flatnonzero(white == _CUT)
    text = np.searchsorted(ends, at, "right")
    at = at[(at > begins[text]) & (at + 1 < ends[text])]
    at = at[(white[at - 1] == 0) & (white[at + 1] == 0)]
    starts = np.sort(np.concatenate([begins[ends > begins], at]), kind="stable")
    return starts, np.append(starts[1:], len(data))[: len(starts)]


def spaced(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between spaces and line ends, for tokenizers that drop white space."""
    inside = _WHITE[data] != _CUT
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = ends > begins
    begin[begins[full]] = inside[begins[full]]
    end[ends[full] - 1] = inside[ends[full] - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def lettered(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of segments parted by, and without, single spaces between two ASCII letters or digits."""
    at = np.flatnonzero(data == 0x20)
    text = np.searchsorted(ends, at, "right")
    at = at[(at > begins[text]) & (at + 1 < ends[text])]
    at = at[_PLAIN[data[at - 1]] & _PLAIN[data[at + 1]]]
    full = ends > begins
    return np.sort(np.concatenate([begins[full], at + 1])), np.sort(np.concatenate([ends[full], at]))


class _Table:
    """Open addressing from pairs of 64-bit numbers to entries."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.a, self.b = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.entry = np.full(1 << bits, -1, np.int32)
        self.held = 0

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (b * _MORE)) * _ODD
        return (((h ^ (h >> np.uint64(32))) * _MORE) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot = self._slot(a, b)
        out = self.entry[slot]
        at = np.flatnonzero((out >= 0) & ((self.a[slot] != a) | (self.b[slot] != b)))
        while len(at):
            slot[at] = (slot[at] + 1) & self.mask
            s = slot[at]
            out[at] = self.entry[s]
            at = at[(out[at] >= 0) & ((self.a[s] != a[at]) | (self.b[s] != b[at]))]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, entry: np.ndarray) -> None:
        """Distinct keys that aren't there yet; the table grows where they would fill more than two thirds of it."""
        if 3 * (self.held + len(a)) > 2 * len(self.entry):
            old = self.entry >= 0
            a, b, entry = np.append(self.a[old], a), np.append(self.b[old], b), np.append(self.entry[old], entry)
            self.__init__((2 * len(a)).bit_length())
        self.held += len(a)
        slot = self._slot(a, b)
        while len(slot):
            free = np.flatnonzero(self.entry[slot] < 0)
            take = free[np.unique(slot[free], return_index=True)[1]]
            s = slot[take]
            self.a[s], self.b[s], self.entry[s] = a[take], b[take], entry[take]
            left = np.ones(len(slot), bool)
            left[take] = False
            a, b, entry, slot = a[left], b[left], entry[left], (slot[left] + 1) & self.mask


class SegmentIds:
    """work_out gives the ids of a list of strings, one after the other, and the number of each; cut finds segments whose ids, joined, are a text's.

    Tiling cuts beside white space beyond ASCII could part what belongs together, so a text with a segment that ends
    with such a character, and with another one behind it, is worked out whole.
    """

    def __init__(self, work_out: Callable[[list[str]], tuple[Sequence[int], Sequence[int]]], cut=tiling, limit: int = 400_000):
        self.work_out, self.cut, self.limit = work_out, cut, limit
        self._forget()

    def _forget(self) -> None:
        self.table = _Table((2 * self.limit).bit_length())
        self.long: dict[bytes, int] = {}
        self.first = np.zeros(1 << 12, np.int64)  # where an entry's ids begin in the pool
        self.count = np.zeros(1 << 12, np.int64)
        self.ragged = np.zeros(1 << 12, bool)
        self.pool = np.zeros(1 << 14, np.int32)
        self.entries, self.used = 0, 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])

    def _append(self, keys: list[bytes]) -> np.ndarray:
        """Entries of new segments."""
        if not keys:
            return np.zeros(0, np.int64)
        if len(keys) > AT_ONCE:
            return np.concatenate([self._append(keys[i : i + AT_ONCE]) for i in range(0, len(keys), AT_ONCE)])
        strings = [x.decode("utf-8", "replace") for x in keys]
        ids, counts = self.work_out(strings)
        n, counts, total = len(keys), np.asarray(counts, np.int64), len(ids)
        self.first, self.count, self.ragged = (self._room(x, self.entries + n) for x in (self.first, self.count, self.ragged))
        self.pool = self._room(self.pool, self.used + total)
        new = np.arange(self.entries, self.entries + n)
        self.first[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        self.ragged[new] = [x[-1:].isspace() for x in strings] if self.cut is tiling else False
        self.pool[self.used : self.used + total] = ids
        self.entries, self.used = self.entries + n, self.used + total
        return new

    def _find(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each segment of texts with sixteen zeros behind them, or -1 for one that isn't kept."""
        size, n_bytes = ends - starts, len(raw) - 16
        at = np.ndarray((n_bytes + 8,), "<u8", raw, strides=(1,))
        short = size <= SHORT
        n = np.minimum(size, SHORT)
        a = at[starts] & _LOW[np.minimum(n, 8)]
        b = at[np.minimum(starts + 8, n_bytes)] & _LOW[np.maximum(n - 8, 0)] | (n.astype(np.uint64) << np.uint64(56))
        entry = np.where(short, self.table.find(a, b), -1).astype(np.int64)
        new = np.flatnonzero(short & (entry < 0))
        if len(new):
            order = np.lexsort((a[new], b[new]))
            x, y = a[new][order], b[new][order]
            differs = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            one = new[order[differs]]
            made = self._append([raw[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            self.table.add(a[one], b[one], made)
            entry[new[order]] = made[np.cumsum(differs) - 1]
        late = np.flatnonzero(~short).tolist()
        keys = [raw[i:j] for i, j in zip(starts[late].tolist(), ends[late].tolist(), strict=True)]
        unknown = list(dict.fromkeys(x for x in keys if len(x) <= KEPT and x not in self.long))
        self.long.update(zip(unknown, self._append(unknown).tolist(), strict=True))
        entry[late] = [self.long.get(x, -1) for x in keys]
        return entry

    def _find_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each segment; those that aren't kept come last, to be forgotten by _end()."""
        raw = data.tobytes() + bytes(16)
        entry = np.empty(len(starts), np.int64)
        for i in range(0, len(starts), LOOKED_UP):
            entry[i : i + LOOKED_UP] = self._find(raw, starts[i : i + LOOKED_UP], ends[i : i + LOOKED_UP])
        self.keep_entries, self.keep_used = self.entries, self.used
        passing = np.flatnonzero(entry < 0)
        keys = [raw[i:j] for i, j in zip(starts[passing].tolist(), ends[passing].tolist(), strict=True)]
        distinct = list(dict.fromkeys(keys))
        known = dict(zip(distinct, self._append(distinct).tolist(), strict=True))
        entry[passing] = [known[x] for x in keys]
        return entry

    def _look_up(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, entry) of all segments of a column of strings, in order."""
        if self.entries > self.limit:
            self._forget()
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(column) else np.zeros(0, np.uint8)
        begins, upto = (offsets[:-1] - offsets[0], offsets[1:] - offsets[0]) if len(column) else (np.zeros(0, np.int64),) * 2
        if not len(data):
            self.keep_entries, self.keep_used = self.entries, self.used
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends = self.cut(data, begins, upto)
        text = np.searchsorted(upto, starts, "right")
        entry = self._find_all(data, starts, ends)
        parted = self.ragged[entry[:-1]] & (text[:-1] == text[1:])
        if parted.any():
            whole = np.unique(text[:-1][parted])
            made = self._append([data[begins[i] : upto[i]].tobytes() for i in whole])
            left = ~np.isin(text, whole)
            text, entry = np.concatenate([text[left], whole]), np.concatenate([entry[left], made])
            order = np.argsort(text, kind="stable")
            text, entry = text[order], entry[order]
        return text, entry

    def _end(self) -> None:
        """Forget what isn't kept beyond a batch."""
        self.entries, self.used = self.keep_entries, self.keep_used

    def counts_of(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text; null counts as empty."""
        text, entry = self._look_up(column)
        out = np.bincount(text, self.count[entry], len(column)).astype(np.int64)
        self._end()
        return out

    def ids_of(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, each text's followed by end, and the number of each text's."""
        text, entry = self._look_up(column)
        first, count = self.first[entry], self.count[entry]
        per_text = np.bincount(text, count, len(column)).astype(np.int64)
        before = np.cumsum(count) - count
        flat = self.pool[np.repeat(first - before, count) + np.arange(int(count.sum()))]
        if end is not None:
            flat = np.insert(flat, np.cumsum(per_text), end)
            per_text += 1
        self._end()
        return flat, per_text
