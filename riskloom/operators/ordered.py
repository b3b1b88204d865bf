"""Exact order statistics without ever sorting a whole table in one task.

Equal values are first merged into one row with counts (combined on the map side), so a value held by a
third of all rows costs one row. The distinct values are then cut into many ordered chunks of many fine
chunks; running totals are taken inside each fine chunk in parallel and shifted by the totals of those
before it. Only the chunk totals, whose number is bounded by the chunk rule, are ordered in a single task
per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNKS_PER_E_FOLD = 2000
FINE_BITS = 12  # a chunk is cut into 4,096 fine chunks


def fine_chunk(value: Column | str, per_e_fold: int = CHUNKS_PER_E_FOLD) -> Column:
    """Fine chunk number that never decreases with the value.

    log1p of the magnitude keeps heavy tails balanced: [0, 1] gives about 1,400 chunks and each further
    factor e gives 2,000 more, so even values up to 1e15 make fewer than 80,000 chunks.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * (per_e_fold << FINE_BITS)).cast("bigint")


def running_totals(df: DataFrame, by: Sequence[str], order: str, fine: Column,
                   totals: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Adds, per total ``col -> (before, all)``, the sum over smaller ``order`` values and over the group.

    ``df`` has one row per (by, order); ``fine`` must not decrease with ``order``. Sums run over the values
    of a fine chunk, over the fine chunks of a chunk and over the chunks of a group, so values crowded
    into one chunk still spread over thousands of tasks.
    """
    by = list(by)
    before_row = Window.unboundedPreceding, -1
    chunked = df.withColumn("__fine", fine)
    sums = chunked.groupBy(*by, "__fine").agg(*[F.sum(c).alias(f"__{c}_n") for c in totals]) \
        .withColumn("__chunk", F.shiftright("__fine", FINE_BITS))
    chunks = sums.groupBy(*by, "__chunk").agg(*[F.sum(f"__{c}_n").alias(f"__{c}_c") for c in totals])
    group = Window.partitionBy(*by)
    over_chunks = group.orderBy("__chunk").rowsBetween(*before_row)
    outer = chunks.select(
        *by, "__chunk",
        *[F.coalesce(F.sum(f"__{c}_c").over(over_chunks), F.lit(0)).alias(f"__{c}_outer") for c in totals],
        *[F.sum(f"__{c}_c").over(group).alias(every) for c, (_, every) in totals.items()])
    over_fine = Window.partitionBy(*by, "__chunk").orderBy("__fine").rowsBetween(*before_row)
    inner = sums.select(*by, "__chunk", "__fine", *[
        F.coalesce(F.sum(f"__{c}_n").over(over_fine), F.lit(0)).alias(f"__{c}_inner") for c in totals])
    shifts = inner.join(outer, [*by, "__chunk"]).drop("__chunk")
    joined = chunked.join(shifts, [*by, "__fine"])
    inside = Window.partitionBy(*by, "__fine").orderBy(order).rowsBetween(*before_row)
    for c, (before, _) in totals.items():
        joined = joined.withColumn(before, F.coalesce(F.sum(c).over(inside), F.lit(0))
                                   + F.col(f"__{c}_inner") + F.col(f"__{c}_outer"))
    return joined.drop("__fine", *[f"__{c}_{part}" for c in totals for part in ("inner", "outer")])


def long_form(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) rows of the given numeric columns."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*pairs)))


def _interpolated(ranked: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], kept: Column | None = None) -> DataFrame:
    """Quantiles from ``ranked`` values (n, before, total); only rows that are ``kept`` may hold one."""
    by = list(by)

    def position(q: float) -> Column:
        return (F.col("total") - 1) * F.lit(float(q))

    def hit(q: float) -> Column:
        pos, last = position(q), F.col("before") + F.col("n") - 1
        low, high = F.floor(pos), F.ceil(pos)
        has_low = (F.col("before") <= low) & (last >= low)
        has_high = (F.col("before") <= high) & (last >= high)
        v = F.col(value) if kept is None else F.when(kept, F.col(value)).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
        return F.when(has_low | has_high, F.struct(
            F.lit(float(q)).alias("q"), (pos - low).alias("weight"),
            F.when(has_low, v).alias("low"), F.when(has_high, v).alias("high")))

    hits = ranked.select(*by, F.inline(F.array_compact(F.array(*[hit(q) for q in qs]))))
    low, high, weight = F.max("low"), F.max("high"), F.max("weight")
    return hits.groupBy(*by, "q").agg((low * (1 - weight) + high * weight).alias("quantile"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles per group: columns ``by``, ``q``, ``quantile``.

    Without groups, only the values near the wanted ranks are shuffled (``selected_quantiles``).
    """
    by = list(by)
    if not by:
        return selected_quantiles(df.select(F.col(value).cast("double").alias("value")), ["value"], qs).drop("column")
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = known.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, by, "__v", fine_chunk("__v"), {"n": ("before", "total")})
    return _interpolated(ranked, by, "__v", qs)


#: The sketch of the first pass is at most a share of 1 / ACCURACY of the rows off, and brackets reach MARGIN times as far;
#: columns of up to SMALL rows are kept whole.
ACCURACY, MARGIN, SMALL = 10_000, 4, 100_000
_LOWEST = -1.7976931348623157e308


def rank_brackets(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> Column:
    """column -> (lows, highs), read as a scalar: values between which the ranks of ``qs`` surely lie.

    One pass over ``df`` makes one mergeable sketch a column, whose rank error is bounded. Nulls and NaN do not count.
    """
    reach = MARGIN / ACCURACY
    probabilities = [min(1.0, max(0.0, q + side * reach)) for side in (-1, 1) for q in qs]

    def bracket(c: str) -> Column:
        v = F.col(c).cast("double")
        known = F.when(~F.isnan(v), v)
        at = F.percentile_approx(known, probabilities, ACCURACY)
        few = F.count(known) <= SMALL
        side = [F.when(few, F.array(*[F.lit(float(x))] * len(qs))).otherwise(F.slice(at, start, len(qs)))
                for x, start in (("-inf", 1), ("inf", len(qs) + 1))]
        return F.struct(side[0].alias("lows"), side[1].alias("highs"))

    entries = [x for c in cols for x in (F.lit(c), bracket(c))]
    return df.agg(F.create_map(*entries).alias("brackets")).scalar()


def selected_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Exact quantiles of several columns: ``column``, ``q``, ``quantile``; nulls and NaN do not count.

    A first pass brackets each rank by a sketch. A second one keeps the values inside the brackets, a share of about
    (2 MARGIN + 2) / ACCURACY of the rows for each rank, and merely counts those between them, so neither the distinct values nor the
    rows are shuffled. A bracket that missed its rank, which the sketch's bound excludes, would raise an error.
    """
    cols, qs = list(cols), list(qs)
    values = long_form(df, cols).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    values = values.withColumn("__brackets", rank_brackets(df, cols, qs))
    bracket, v = F.try_element_at("__brackets", F.col("column")), F.col("value")
    lows, highs = ([F.get(bracket[side], F.lit(i)) for i in range(len(qs))] for side in ("lows", "highs"))
    inside = F.lit(False)
    for low, high in zip(lows, highs):
        inside = inside | ((v >= low) & (v <= high))
    below = F.greatest(F.lit(_LOWEST), *[F.when(v > high, high).otherwise(F.lit(_LOWEST)) for high in highs])
    marked = values.select("column", F.when(inside, v).otherwise(below).alias("__v"), (~inside).alias("between"))
    counts = marked.groupBy("column", "__v", "between").agg(F.count(F.lit(1)).alias("n")).withColumn("__place", F.struct("__v", "between"))
    ranked = running_totals(counts, ["column"], "__place", fine_chunk("__v"), {"n": ("before", "total")})
    return _interpolated(ranked, ["column"], "__v", qs, ~F.col("between"))


def quantiles(df: DataFrame, col: str, qs: Sequence[float] = (0.25, 0.5, 0.75), exact: bool = True) -> DataFrame:
    """(q, quantile) rows; ``exact=False`` uses the mergeable sketch instead."""
    if exact:
        return exact_quantiles(df, [], col, qs)
    probabilities = F.array(*[F.lit(float(q)) for q in qs])
    sketch = df.agg(F.percentile_approx(F.col(col).cast("double"), list(map(float, qs)), 100000).alias("v"))
    return sketch.select(F.explode(F.arrays_zip(probabilities.alias("q"), F.col("v").alias("quantile"))).alias("p")) \
        .select(F.col("p.q").alias("q"), F.col("p.quantile").alias("quantile"))


def quantile_row(df: DataFrame, cols: Sequence[str], qs: Mapping[str, float]) -> DataFrame:
    """One row per column: ``column`` and one field per named quantile."""
    flat = selected_quantiles(df, cols, list(qs.values()))
    return flat.groupBy("column").agg(*[
        F.max(F.when(F.col("q") == F.lit(float(q)), F.col("quantile"))).alias(name) for name, q in qs.items()])


def ewma(df: DataFrame, by: Sequence[str], order: Sequence[str], col: str, alpha: float = 0.1,
         chunk: str = "1 minute") -> DataFrame:
    """Final value of m <- (1-alpha)*m + alpha*x started at 0, per group, in time order.

    ``order[0]`` is a timestamp. Every minute of a group is folded on its own; the result of a minute is then
    decayed by the number of later rows, which only needs one row per minute and group.
    """
    by, ts = list(by), order[0]
    decay = F.lit(1.0 - alpha)
    rows = df.filter(F.col(col).isNotNull()).withColumn("__chunk", time_chunk(ts, chunk))
    newest_first = Window.partitionBy(*by, "__chunk").orderBy(*[F.desc(c) for c in order])
    aged = rows.withColumn("__age", F.row_number().over(newest_first) - 1)
    folded = aged.groupBy(*by, "__chunk").agg(
        F.sum(F.lit(alpha) * F.pow(decay, F.col("__age")) * F.col(col)).alias("__part"),
        F.count(F.lit(1)).alias("__n"))
    later = Window.partitionBy(*by).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    shifted = folded.withColumn("__later", F.coalesce(F.sum("__n").over(later), F.lit(0)))
    return shifted.groupBy(*by).agg(F.sum(F.col("__part") * F.pow(decay, F.col("__later"))).alias("ewma"))


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def interval_micros(text: str) -> int:
    """'30 minutes', '1 hour', '7 days' … in microseconds."""
    number, unit = text.split()
    per_unit = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(round(float(number) * per_unit[unit.rstrip("s")] * 1_000_000))


def time_chunk(ts: Column | str, width: str) -> Column:
    return F.floor(micros(ts) / F.lit(interval_micros(width))).cast("bigint")
