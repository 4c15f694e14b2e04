"""Statistical kernels in relational form: a DataFrame of values by key in, one row a key out.

Keys are single columns.  Nothing is gathered into arrays: dispersion is two aggregates, the gap threshold a histogram
of occupied bins with cumulative sums, periodicity a self-join of occupied bins on bin + lag.

Gaps, bursts and quantiles need a key's rows in order.  Where a key has more than LONG_KEY rows, rows are dealt into
ranges of key and order instead of by key, and the ranges of a key are stitched together by one row a range, so no key
has to fit in one task; the results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.runtime import materialize

_TINY = 1e-12
_BINS = 64
#: Rows of one key that a task sorts or counts at most.
LONG_KEY = 4_000_000


def has_long_key(rows: DataFrame, key: str) -> bool:
    """Has a key more than LONG_KEY rows?  One count with partial sums."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > LONG_KEY).limit(1).count() > 0


def _in_ranges(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with __range: ascending ranges of key and order, written, so that they stay as they are."""
    return materialize(rows.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def _carried(rows: DataFrame, key: str, total: Column) -> DataFrame:
    """(key, __range, __before): the sum of a total over the key's ranges before each."""
    totals = rows.groupBy(key, "__range").agg(total.alias("__total"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, "__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))


def quantiles(rows: DataFrame, key: str, value: str, shares: list[float], long: bool = False, also: dict[str, Column] | None = None) -> DataFrame:
    """(key, n, also..., q): exact quantiles of each key's values, interpolated; q is an array in the order of shares, also are further aggregates."""
    sums = [F.count("*").alias("n"), *[c.alias(k) for k, c in (also or {}).items()]]
    if not long:
        return rows.groupBy(key).agg(*sums, F.percentile(value, F.array(*map(F.lit, shares))).alias("q"))
    counted = _in_ranges(rows.groupBy(key, value).agg(F.count("*").alias("__c")), key, [value])
    within = Window.partitionBy(key, "__range").orderBy(value)
    placed = counted.withColumn("__upto", F.sum("__c").over(within)).join(_carried(counted, key, F.sum("__c")), [key, "__range"])
    placed = placed.select(key, value, (F.col("__upto") + F.col("__before") - F.col("__c")).alias("__first"), (F.col("__upto") + F.col("__before")).alias("__end"))
    sizes = rows.groupBy(key).agg(*sums)
    aims = placed.join(sizes.select(key, "n"), key)
    parts = []
    for s in shares:
        at = F.lit(s) * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        hit = lambda place: F.max(F.when((F.col("__first") <= place) & (place < F.col("__end")), F.col(value)))  # noqa: E731, B023
        parts += [(hit(low), hit(high), s)]
    found = aims.groupBy(key, "n").agg(*[c.alias(f"__{i}{side}") for i, (a, b, _) in enumerate(parts) for side, c in (("a", a), ("b", b))])
    share = lambda s: F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1))
    found = found.select(key, F.array(*[(1 - share(s)) * F.col(f"__{i}a") + share(s) * F.col(f"__{i}b") for i, (_, _, s) in enumerate(parts)]).alias("q"))
    return sizes.join(found, key)


def dispersion(values: DataFrame, key: str, value: str, long: bool = False, also: dict[str, Column] | None = None) -> DataFrame:
    """(key, n, med, mad, cod, q25, also...): median, median absolute deviation, their ratio (1 if it can't be formed) and first quartile."""
    rows = values.where(F.col(value).isNotNull())
    first = quantiles(rows, key, value, [0.25, 0.5], long, also).select(key, "n", *(also or ()), F.col("q")[0].alias("q25"), F.col("q")[1].alias("med"))
    apart = rows.join(first.select(key, "med"), key).select(key, F.abs(F.col(value) - F.col("med")).alias("__apart"))
    second = quantiles(apart, key, "__apart", [0.5], long).select(key, F.col("q")[0].alias("mad"))
    ratio = F.when(F.abs("med") < _TINY, F.lit(1.0)).otherwise(F.col("mad") / F.abs("med"))
    return first.join(second, key).select(key, "n", "med", "mad", ratio.alias("cod"), "q25", *(also or ()))


def schedule_floor(n: Column, q25: Column, med: Column) -> Column:
    """How far the lower quartile falls below the median, relative to it; 0 for under four values, 1 for a median of about 0."""
    return F.when(n < 4, F.lit(0.0)).when(med < _TINY, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (med - q25) / med))


def robust_deviation(value: Column, med: Column, mad: Column, n: Column) -> Column:
    """Modified z-score; null for under three values or no spread."""
    return F.when((n >= 3) & (mad >= _TINY), (value - med) / (1.4826 * mad))


def gaps(events: DataFrame, key: str, ts: str, order: list[str], long: bool = False) -> DataFrame:
    """events with gap: the seconds since the key's event before; null for the first."""
    if not long:
        return events.withColumn("gap", F.col(ts) - F.lag(ts).over(Window.partitionBy(key).orderBy(ts, *order)))
    rows = _in_ranges(events, key, [ts, *order])
    lasts = rows.groupBy(key, "__range").agg(F.max(ts).alias("__last"))
    lasts = lasts.select(key, "__range", F.lag("__last").over(Window.partitionBy(key).orderBy("__range")).alias("__before"))
    near = F.lag(ts).over(Window.partitionBy(key, "__range").orderBy(ts, *order))
    found = rows.withColumn("__near", near).join(lasts, [key, "__range"])
    return found.select(*events.columns, (F.col(ts) - F.coalesce("__near", "__before")).alias("gap"))


def gap_threshold(with_gaps: DataFrame, key: str, min_decades: float = 1.0, min_share: float = 0.10) -> DataFrame:
    """(key, threshold): where a bimodal distribution of gaps splits (Otsu over 64 bins of log10), for keys that have a split.

    Between-class variance is a step function of the bin that changes at occupied bins only, so empty bins are never made.
    """
    logs = with_gaps.where("gap > 0").select(key, F.log10("gap").alias("lg"))
    range_ = logs.groupBy(key).agg(F.min("lg").alias("lo"), F.max("lg").alias("hi"), F.count("*").alias("n")).where((F.col("n") >= 8) & (F.col("hi") - F.col("lo") >= min_decades))
    spread = F.col("hi") - F.col("lo")
    binned = logs.join(range_, key).withColumn("bin", F.least(F.lit(_BINS - 1), F.floor((F.col("lg") - F.col("lo")) / spread * _BINS)).cast("int"))
    counts = binned.groupBy(key, "bin", "lo", "hi", "n").agg(F.count("*").alias("c"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / _BINS
    upto, whole = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    share = F.col("c") / F.col("n")
    masses = counts.withColumn("centre", centre).select(key, "bin", "centre", F.sum(share).over(upto).alias("below"), F.sum(share * centre).over(upto).alias("moment"), F.sum(share * centre).over(whole).alias("total"))
    inner = masses.where((F.col("bin") < _BINS - 1) & (F.col("below") > 0) & (F.col("below") < 1 - 1e-12))
    variance = F.pow(F.col("total") * F.col("below") - F.col("moment"), 2) / F.greatest(F.col("below") * (1 - F.col("below")), F.lit(_TINY))
    best = inner.groupBy(key).agg(F.min_by("centre", F.struct((-F.round(variance, 9)).alias("v"), F.col("bin").alias("b"))).alias("split"))
    sides = logs.join(best, key).groupBy(key, "split").agg(
        F.count(F.when(F.col("lg") <= F.col("split"), 1)).alias("n_low"),
        F.count(F.when(F.col("lg") > F.col("split"), 1)).alias("n_high"),
        F.avg(F.when(F.col("lg") <= F.col("split"), F.col("lg"))).alias("low"),
        F.avg(F.when(F.col("lg") > F.col("split"), F.col("lg"))).alias("high"),
    )
    held = (F.col("high") - F.col("low") >= min_decades) & (F.least("n_low", "n_high") / (F.col("n_low") + F.col("n_high")) >= min_share)
    return sides.where(held).select(key, F.pow(F.lit(10.0), F.col("split")).alias("threshold"))


def coalesce_bursts(with_gaps: DataFrame, thresholds: DataFrame, key: str, ts: str, value: str, order: list[str], long: bool = False) -> DataFrame:
    """(key, ts, value, records): one row a burst.  A burst starts where the gap exceeds the key's threshold; keys without one keep each event.

    The value is null where no event of the burst has one.
    """
    upto = (Window.unboundedPreceding, 0)
    starts = F.when(F.col("gap").isNull() | F.col("threshold").isNull() | (F.col("gap") > F.col("threshold")), 1).otherwise(0)
    rows = with_gaps.join(thresholds, key, "left").withColumn("__starts", starts)
    if long:
        rows = _in_ranges(rows, key, [ts, *order])
        by = Window.partitionBy(key, "__range").orderBy(ts, *order).rowsBetween(*upto)
        numbered = rows.join(_carried(rows, key, F.sum("__starts")), [key, "__range"]).withColumn("burst", F.sum("__starts").over(by) + F.col("__before"))
    else:
        numbered = rows.withColumn("burst", F.sum("__starts").over(Window.partitionBy(key).orderBy(ts, *order).rowsBetween(*upto)))
    return numbered.groupBy(key, "burst").agg(F.min(ts).alias(ts), F.sum(value).alias(value), F.count("*").alias("records")).drop("burst")


def periodicity(events: DataFrame, params: DataFrame, key: str, ts: str, max_bins: int = 200_000) -> DataFrame:
    """(key, autocorrelation) from events and params (key, period, jitter): the best lag within a fifth of the period, clipped to 0..1.

    Keys whose jitter hides the period, with under 8 events or no span have no row: unmeasured.  The correlation of bin
    counts less their mean follows from occupied bins alone.
    """
    spans = events.groupBy(key).agg(F.min(ts).alias("t0"), (F.max(ts) - F.min(ts)).alias("span"), F.count("*").alias("n"))
    usable = params.join(spans, key).where((F.col("n") >= 8) & (F.col("period") > 0) & (F.col("span") > 0) & (2.5 * F.col("jitter") <= F.col("period") / 2))
    width = F.least(F.greatest(2.5 * F.col("jitter"), F.col("period") / 4), F.col("period") / 2)
    usable = usable.withColumn("w0", width).withColumn("bins0", F.floor(F.col("span") / F.col("w0")) + 1)
    wide = F.col("bins0") > max_bins
    usable = usable.withColumn("width", F.when(wide, F.col("span") / max_bins).otherwise(F.col("w0"))).withColumn("bins", F.when(wide, F.lit(max_bins)).otherwise(F.col("bins0")))
    usable = usable.where(F.col("width") <= F.col("period") / 2).withColumn("mean", F.col("n") / F.col("bins"))
    placed = events.join(usable.select(key, "t0", "width", "bins"), key)
    occupied = placed.withColumn("bin", F.least(F.col("bins") - 1, F.floor((F.col(ts) - F.col("t0")) / F.col("width")))).groupBy(key, "bin").agg(F.count("*").cast("double").alias("c"))
    energy = occupied.groupBy(key).agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    base = usable.join(energy, key).withColumn("energy", F.col("squares") - F.col("bins") * F.col("mean") * F.col("mean")).where(F.col("energy") >= _TINY)
    lag = F.col("period") / F.col("width")
    base = base.withColumn("first", F.greatest(F.lit(1), F.bround(lag * 0.8, 0).cast("int"))).withColumn("last", F.least(F.bround(lag * 1.2, 0).cast("long"), F.col("bins") - 1).cast("int")).where("last >= first")
    lags = base.select(key, "bins", "mean", "energy", F.explode(F.sequence("first", "last")).alias("lag"))
    with_lag = occupied.join(lags, key)
    edges = with_lag.groupBy(key, "lag", "bins", "mean", "energy").agg(
        F.sum(F.when(F.col("bin") < F.col("bins") - F.col("lag"), F.col("c")).otherwise(0.0)).alias("head"),
        F.sum(F.when(F.col("bin") >= F.col("lag"), F.col("c")).otherwise(0.0)).alias("tail"),
    )
    ahead = with_lag.select(key, "lag", (F.col("bin") + F.col("lag")).alias("bin"), F.col("c").alias("c0"))
    products = ahead.join(occupied, [key, "bin"]).groupBy(key, "lag").agg(F.sum(F.col("c0") * F.col("c")).alias("product"))
    m = F.col("mean")
    value = (F.coalesce("product", F.lit(0.0)) - m * F.col("head") - m * F.col("tail") + (F.col("bins") - F.col("lag")) * m * m) / F.col("energy")
    best = edges.join(products, [key, "lag"], "left").groupBy(key).agg(F.max(value).alias("best"))
    return best.select(key, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("best"))).alias("autocorrelation"))
