"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text.  Preference pairs are all pairs of a document of the better label
and one of the worse; the weights maximise the Bradley-Terry likelihood, a logistic loss on feature differences, by
Newton's method with an L2 penalty.  The threshold is the score quantile at the share of worse labels among the training
rows, and the reported score is the logistic function of the distance to it, so 0.5 is the threshold.

All labelled rows that aren't held out are learned from, in passes over a table of their measures; the driver gets one
summary a task.  Quantiles are exact, found by narrowing ranges of values.  Pairs are never made: scores are put in bins
with the powers of their distances from the bins' centres, and the loss of a pair, as a Taylor series around the centres
of its two bins, is a sum of products of these (pairs' relative error is below 1e-10).

Features use the text only.  Null and empty texts have features of zeros, hence a score too.  Labels that are null are
ignored; of several labels of an id the lowest counts, of several documents of an id the one of least measures.  Without
rows of both labels all documents score 0.5.  Repeated rows each get a row; other columns stay, but for one named as the
score; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import binary_texts, joined, materialize, prepare, tidied

_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_CLASSES = [
    np.isin(np.arange(256), np.frombuffer(x, np.uint8))
    for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&", b"|<>{}[]\\/_=+~^", b"!?", b".", b",;:", b"\n", b"\"'()-", b"@")
] + [np.arange(256) >= 128]
#: Cuts of each measure at these training quantiles give its hinge features.
_QUANTILES = (0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98)
#: Width of the bins of scores; order of the series for losses and gradients, and of each side's for the Hessian's mixed part.
_WIDTH, _ORDER, _MIXED = 0.25, 10, 4
#: Values that a pass over the table sends to the driver at most when it ends a search for quantiles.
_FEW = 1 << 16
#: Tasks of a pass at most, as each sends a summary of about 1 MB.
_TASKS = 64


def measures(items: list[bytes]) -> np.ndarray:
    """A row of plain measures for each text."""
    data, starts = joined(items)
    sizes = np.maximum(np.diff(starts), 1)
    total = lambda flags: np.add.reduceat(np.append(flags, 0).astype(np.int64), starts[:-1]) * (np.diff(starts) > 0) if items else np.zeros(0, np.int64)
    shares = [total(c[data]) / sizes for c in _CLASSES]
    rows = []
    for x in items:
        words = x.split()
        n = len(words)
        if not n:
            rows.append([0.0] * 9)
            continue
        counts = Counter(words)
        lines = [y for y in x.split(b"\n") if y.strip()]
        same = sum(map(bytes.__eq__, words[1:], words))
        pairs = len(set(zip(words, words[1:], strict=False)))
        rows.append(
            [
                np.log1p(n),
                len(counts) / n,
                len(counts) / n**0.8,
                max(counts.values()) / n,
                same / n,
                pairs / max(n - 1, 1),
                len(set(lines)) / max(len(lines), 1),
                np.log1p(n / max(len(lines), 1)),
                (len(x) - n) / n / 10,
            ]
        )
    return np.column_stack([*shares, np.array(rows, np.float64).reshape(len(items), 9)])


@dataclass(frozen=True)
class Model:
    """Hinges of the measures, their scales, weights and the threshold."""

    cuts: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    threshold: float

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, *[np.maximum(x - c, 0) for c in self.cuts]]) / self.scales

    def raw(self, x: np.ndarray) -> np.ndarray:
        # summed row by row, so that a row's value doesn't depend on those beside it
        return (self.features(x) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def _untrained(width: int) -> Model:
    return Model(np.zeros((0, width)), np.ones(width), np.zeros(width), 0.0)


#: Chunks of training rows: measures, and whether the label is the better one.
Chunks = Iterable[tuple[np.ndarray, np.ndarray]]
#: Applies a function to the chunks of each part of the training rows and returns its results.
Run = Callable[[Callable[[Chunks], object]], list]


def _sizes(chunks: Chunks) -> np.ndarray:
    return sum((np.array([len(y) - y.sum(), y.sum()]) for _, y in chunks), np.zeros(2, np.int64))


def _keys(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    bits = (values + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def _values(keys: np.ndarray) -> np.ndarray:
    top = np.uint64(1 << 63)
    return np.where(keys & top, keys ^ top, ~keys).view(np.float64)


def _below(chunks: Chunks, of: Callable, ranges: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """For each (column, edges) how many keys of the column lie below each edge."""
    out = [np.zeros(len(e), np.int64) for _, e in ranges]
    for x, _ in chunks:
        keys = np.sort(_keys(of(x)), axis=0)
        for n, (c, edges) in zip(out, ranges, strict=True):
            n += np.searchsorted(keys[:, c], edges)
    return out


def _within(chunks: Chunks, of: Callable, ranges: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """For each (column, low, high) the column's keys from low to high."""
    out = [[np.zeros(0, np.uint64)] for _ in ranges]
    for x, _ in chunks:
        keys = _keys(of(x))
        for found, (c, low, high) in zip(out, ranges, strict=True):
            found.append(keys[(keys[:, c] >= np.uint64(low)) & (keys[:, c] <= np.uint64(high)), c])
    return [np.concatenate(x) for x in out]


def _ordered(run: Run, of: Callable, rows: int, wanted: list[tuple[int, int]]) -> np.ndarray:
    """The value at each (column, place) of the columns that of() gives, places from 0, by narrowing ranges of keys."""
    # (column, place): the lowest and highest key that it may have, how many keys lie below that range and how many in it
    at = {t: (0, 2**64 - 1, 0, rows) for t in wanted}
    while True:
        ranges = sorted({(c, *at[c, p]) for c, p in wanted if at[c, p][0] < at[c, p][1]})
        if not ranges:
            return _values(np.array([at[t][0] for t in wanted], np.uint64))
        if sum(r[4] for r in ranges) <= _FEW:
            parts = run(partial(_within, of=of, ranges=[r[:3] for r in ranges]))
            keys = {r[:3]: np.sort(np.concatenate(x)) for r, x in zip(ranges, zip(*parts, strict=True), strict=True)}
            for (c, p), (low, high, before, _) in at.items():
                if low < high:
                    key = int(keys[c, low, high][p - before])
                    at[c, p] = (key, key, 0, 0)
            continue
        edges = [sorted({low + (high - low) * k // 256 for k in range(256)} | {high}) for _, low, high, _, _ in ranges]
        counts = [sum(x) for x in zip(*run(partial(_below, of=of, ranges=[(r[0], np.array(e, np.uint64)) for r, e in zip(ranges, edges, strict=True)])), strict=True)]
        for r, e, n in zip(ranges, edges, counts, strict=True):
            ends = [*n, r[3] + r[4]]
            for (c, p), now in at.items():
                if (c, *now) == r:
                    k = int(np.searchsorted(n, p, "right")) - 1
                    at[c, p] = (e[k], e[k + 1] - 1 if k + 1 < len(e) else r[2], int(ends[k]), int(ends[k + 1] - ends[k]))


def _quantiles(run: Run, of: Callable, rows: int, columns: int, shares: Iterable[float]) -> np.ndarray:
    """Exact quantiles, interpolated: a row a share, a column a column of what of() gives."""
    places = [s * (rows - 1) for s in shares]
    ends = [[(c, min(math.floor(p) + up, rows - 1)) for p in places for c in range(columns)] for up in (0, 1)]
    low, high = np.split(_ordered(run, of, rows, [*ends[0], *ends[1]]), 2)
    t = np.repeat([p - math.floor(p) for p in places], columns)
    return (low + (high - low) * t).reshape(len(places), columns)


def _spread(chunks: Chunks, model: Model) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean of each feature and sum of its squared distances from it."""
    parts = []
    for x, _ in chunks:
        f = model.features(x)
        parts.append((len(f), f.mean(0), ((f - f.mean(0)) ** 2).sum(0)))
    return _spread_of(parts, len(model.scales))


def _spread_of(parts: list, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    n, mean, squares = 0, np.zeros(width), np.zeros(width)
    for m, other, more in parts:
        if m:
            gap = other - mean
            squares = squares + more + gap**2 * (n * m / (n + m))
            mean, n = mean + gap * (m / (n + m)), n + m
    return n, mean, squares


def _summed(bins: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins that occur, ascending, and the sum of the values of each."""
    order = np.argsort(bins, kind="stable")
    found, starts = np.unique(bins[order], return_index=True)
    return found, np.add.reduceat(values[order], starts, axis=0) if len(found) else values[:0]


def _placed(chunks: Chunks, model: Model, centre: np.ndarray):
    """(centred features, bin, powers of the distance from its centre) of the rows of the worse and of the better label, chunk by chunk."""
    for x, better in chunks:
        f = model.features(x) - centre
        s = (f * model.weights).sum(1)
        bins = np.rint(s / _WIDTH)
        powers = (s - bins * _WIDTH)[:, None] ** np.arange(_ORDER + 1)
        yield [(f[y], bins[y], powers[y]) for y in (~better, better)]


def _moments(chunks: Chunks, model: Model, centre: np.ndarray) -> list:
    """For the rows of the worse and of the better label the bins of their scores and the sums of powers in each."""
    out = [(np.zeros(0), np.zeros((0, _ORDER + 1)))] * 2
    for sides in _placed(chunks, model, centre):
        out = [_merged([old, (b, p)]) for old, (_, b, p) in zip(out, sides, strict=True)]
    return out


def _merged(parts: Iterable) -> tuple[np.ndarray, np.ndarray]:
    bins, values = zip(*parts, strict=True)
    return _summed(np.concatenate(bins), np.concatenate(values))


def _derivatives(gap: np.ndarray, order: int) -> list[np.ndarray]:
    """log(1 + exp(-gap)) and its derivatives."""
    q = np.exp(-np.abs(gap)) / (1 + np.exp(-np.abs(gap)))
    out = [np.logaddexp(0, -gap), np.where(gap < 0, q - 1, -q)]
    slope = np.polynomial.Polynomial([0, 1, -1])
    p = slope
    for n in range(2, order + 1):
        out.append(np.where(gap < 0, (-1) ** n, 1) * p(q))
        p = -p.deriv() * slope
    return out[: order + 1]


def _series(at: np.ndarray, other: np.ndarray, moments: np.ndarray, sign: int) -> np.ndarray:
    """For each bin (at) three series in the distance from its centre: the loss summed over the other side's rows, and its first two derivatives by the gap.

    sign is 1 where the rows of these bins are the better ones, else -1.
    """
    out = np.zeros((3, len(at), _ORDER + 1))
    for i in range(0, len(at), 64):
        found = _derivatives(sign * (at[i : i + 64, None] - other) * _WIDTH, _ORDER + 2)
        for n in range(_ORDER + 1):
            for m in range(n + 1):
                share = sign**m * (-sign) ** (n - m) / math.factorial(m) / math.factorial(n - m)
                for d in range(3):
                    out[d, i : i + 64, m] += share * (found[n + d] @ moments[:, n - m])
    return out


def _slopes(chunks: Chunks, model: Model, centre: np.ndarray, bins: list, series: list) -> tuple:
    """Gradient, the Hessian's part of single rows, and for its mixed part the bins' sums of features times powers, for each side."""
    width = len(centre)
    gradient, hessian = np.zeros(width), np.zeros((width, width))
    mixed = [(np.zeros(0), np.zeros((0, _MIXED, width)))] * 2
    for sides in _placed(chunks, model, centre):
        for side, (f, b, powers) in enumerate(sides):
            if not len(f):
                continue
            at = np.searchsorted(bins[side], b)
            first, second = ((series[side][d][at] * powers).sum(1) for d in (1, 2))
            gradient += (2 * side - 1) * (first @ f)
            hessian += (f * second[:, None]).T @ f
            sums = [_summed(b, f * powers[:, k, None]) for k in range(_MIXED)]
            mixed[side] = _merged([mixed[side], (sums[0][0], np.stack([x for _, x in sums], 1))])
    return gradient, hessian, mixed


def _mixed(mixed: list) -> np.ndarray:
    """The sum over all pairs of the loss's second derivative times the better row's features by the worse one's."""
    (low, bad), (high, good) = mixed
    out = np.zeros((bad.shape[2],) * 2)
    for i in range(0, len(high), 64):
        found = _derivatives((high[i : i + 64, None] - low) * _WIDTH, 2 * _MIXED)
        for k in range(_MIXED):
            inner = sum((-1) ** m / math.factorial(k) / math.factorial(m) * (found[2 + k + m] @ bad[:, m]) for m in range(_MIXED))
            out += good[i : i + 64, k].T @ inner
    return out


def _weights(run: Run, model: Model, centre: np.ndarray, pairs: int, penalty: float) -> np.ndarray:
    """The weights of least loss over all pairs, by Newton's method; a step that doesn't lower the loss is halved."""

    def measured(w):
        m = [_merged(x) for x in zip(*run(partial(_moments, model=replace(model, weights=w), centre=centre)), strict=True)]
        series = [_series(m[side][0], *m[1 - side], 2 * side - 1) for side in (0, 1)]
        return float((m[1][1] * series[1][0]).sum()) / pairs + penalty / 2 * float(w @ w), [x for x, _ in m], series

    w = np.zeros(len(centre))
    loss, bins, series = measured(w)
    for _ in range(50):
        parts = run(partial(_slopes, model=replace(model, weights=w), centre=centre, bins=bins, series=series))
        gradient, hessian = (sum(p[i] for p in parts) / pairs for i in (0, 1))
        mixed = _mixed([_merged([p[2][side] for p in parts]) for side in (0, 1)]) / pairs
        step = np.linalg.solve(hessian - mixed - mixed.T + penalty * np.eye(len(w)), gradient + penalty * w)
        while np.abs(step).max() >= 1e-6:
            now, *found = measured(w - step)
            if now <= loss + 1e-14:
                break
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
        loss, (bins, series) = now, found
    return w


def _drawn_weights(f: np.ndarray, better: np.ndarray, pairs: int, penalty: float, seed: int) -> np.ndarray:
    """The weights of least loss over pairs drawn at random."""
    rng = np.random.default_rng(seed)
    diff = f[rng.choice(np.flatnonzero(better), pairs)] - f[rng.choice(np.flatnonzero(~better), pairs)]
    w = np.zeros(f.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -50, 50)))
        gradient = diff.T @ (p - 1) / pairs + penalty * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _plain(x: np.ndarray) -> np.ndarray:
    return x


def _raw(x: np.ndarray, model: Model) -> np.ndarray:
    return model.raw(x)[:, None]


def _fitted(run: Run, width: int, weigh: Callable[[Model, np.ndarray, int], np.ndarray]) -> Model:
    bad, good = (int(n) for n in sum(run(_sizes), np.zeros(2, np.int64)))
    if not good or not bad:
        return _untrained(width)
    cuts = _quantiles(run, _plain, bad + good, width, _QUANTILES)
    start = Model(cuts, np.ones(width * (1 + len(cuts))), np.zeros(1), 0.0)
    n, mean, squares = _spread_of(run(partial(_spread, model=start)), len(start.scales))
    deviation = np.sqrt(squares / n)
    scales = np.where(deviation > 1e-9, deviation, 1.0)
    model = replace(start, scales=scales)
    model = replace(model, weights=weigh(model, mean / scales, good * bad))
    threshold = _quantiles(run, partial(_raw, model=model), bad + good, 1, [bad / (bad + good)])
    return replace(model, threshold=float(threshold[0, 0]))


def fit(x: np.ndarray, better: np.ndarray, pairs: int | None = None, penalty: float = 1e-3, seed: int = 4) -> Model:
    """Bradley-Terry weights from all preference pairs of rows (only from so many drawn ones where pairs is given), and the quantile threshold."""

    def run(f):
        return [f([(x, better)])]

    if pairs is None:
        return _fitted(run, x.shape[1], lambda model, centre, n: _weights(run, model, centre, n, penalty))
    return _fitted(run, x.shape[1], lambda model, centre, n: _drawn_weights(model.features(x), better, pairs, penalty, seed))


def held_out(id_col: str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", penalty: float = 1e-3) -> Model:
    """Fit on all labelled rows that aren't held out (only on those of smallest hash, as many as train_rows, where that is given)."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("label").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if train_rows is not None:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    kind = dict(texts.dtypes)["doc_id"]

    def measure(batches):
        for batch in batches:
            x = measures(binary_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    # measures are joined, as labels may be too many to broadcast and texts too long to shuffle; one row an id, however many documents have it
    measured = texts.mapInArrow(tidied(measure), f"doc_id {kind}, x array<double>").join(known, "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
    rows = materialize(measured.select(F.col("x"), (F.col("label") > 0).alias("better")), "training-rows").coalesce(_TASKS)
    width = measures([b""]).shape[1]

    def run(f):
        def task(batches):
            chunks = ((b.column("x").flatten().to_numpy().reshape(-1, width), b.column("better").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(chunks))], pa.binary())], names=["part"])

        return [pickle.loads(r.part) for r in rows.mapInArrow(tidied(task), "part binary").collect()]

    return _fitted(run, width, lambda model, centre, n: _weights(run, model, centre, n, penalty))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __score (0 to 1) added, in the order and number of its rows; no shuffle."""

    def run(batches):
        for batch in batches:
            x = measures(binary_texts(batch.column("__text")))
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(model.score(x), pa.float64())], names=[f"c{i}" for i in range(len(keep))] + ["__score"])

    prepare(docs.sparkSession)
    kinds = [x for x in docs.dtypes if x[0] != "__score"]
    columns = [c for c, _ in kinds]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(text_col).alias("__text"))
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(kinds)) + ", __score double"
    scored = rows.mapInArrow(tidied(run), schema)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "__score")
