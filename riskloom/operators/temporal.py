"""Point-in-time operators: trailing features, as-of lookup, gap filling, cache replay."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskloom.operators.ordered import interval_micros, micros
from riskloom.operators.relational import instant, seconds


def trailing_features(df: DataFrame, key: str, ts: str, days: float, aggs: Mapping[str, tuple[str, str | None]],
                      bucket: str = "1 hour") -> DataFrame:
    """Counts, sums and averages over the earlier rows of the same key within ``days``.

    Both ends are open: a row at exactly ``days`` before does not count, neither does the row itself nor
    any row of the same instant. ``aggs`` maps output names to ("count", None) or ("avg"/"sum", column).
    A row without a key gets a count of 0 and no averages.
    """
    return trailing_by_keys(df, ts, {key: (days, aggs)}, bucket)


def trailing_by_keys(df: DataFrame, ts: str, by: Mapping[str, tuple[float, Mapping[str, tuple[str, str | None]]]],
                     bucket: str = "1 hour") -> DataFrame:
    """``trailing_features`` for several keys, given as key: (days, aggs). Every key's features come from ``df`` itself, not
    from rows that already carry those of another key, which would be made twice."""
    out = rows = df.withColumn("__t", micros(ts))
    for key, (days, aggs) in by.items():
        out = out.join(_trailing_table(rows, key, days, aggs, bucket), [key, "__t"], "left")
    counts = {n: 0 for _, aggs in by.values() for n, (kind, _) in aggs.items() if kind == "count"}
    return out.select(*df.columns, *[n for _, aggs in by.values() for n in aggs]).na.fill(counts)


def _trailing_table(rows: DataFrame, key: str, days: float, aggs: Mapping[str, tuple[str, str | None]], bucket: str) -> DataFrame:
    """The trailing features of every (key, __t).

    Rows are merged per (key, instant) and processed per (key, hour), so a key with a third of all rows is
    spread over as many tasks as it has hours. A window is the part of the own hour before the row, the
    whole hours in between, and the part of the oldest hour that is still inside; nothing is subtracted,
    so no precision is lost.
    """
    width, span = interval_micros(bucket), int(days * 86_400_000_000)
    if span % width:
        raise ValueError("the trailing period must be a whole number of buckets")
    reach = span // width
    measures = sorted({c for _, c in aggs.values() if c is not None})
    fields = ["n_rows", *[f"sum_{c}" for c in measures], *[f"n_{c}" for c in measures]]

    points = rows.filter(F.col(key).isNotNull() & F.col("__t").isNotNull()).groupBy(key, "__t").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in measures],
        *[F.count(c).alias(f"n_{c}") for c in measures],
    ).withColumn("__b", F.floor(F.col("__t") / F.lit(width)).cast("bigint"))

    hours = points.groupBy(key, "__b").agg(*[F.sum(f).alias(f) for f in fields])
    between = Window.partitionBy(key).orderBy("__b").rangeBetween(-(reach - 1), -1)
    whole = hours.select(key, "__b", *[F.sum(f).over(between).alias(f"{f}_whole") for f in fields])

    own = points.withColumn("__own", F.lit(True))
    oldest = points.withColumns({"__t": F.col("__t") + span, "__b": F.col("__b") + reach, "__own": F.lit(False)})
    edge = own.unionByName(oldest)
    hour = Window.partitionBy(key, "__b")
    earlier = hour.orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    later = hour.orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, -1)
    parts = {}
    for f in fields:
        parts[f"{f}_own"] = F.sum(F.when(F.col("__own"), F.col(f))).over(earlier)
        parts[f"{f}_old"] = F.sum(F.when(~F.col("__own"), F.col(f))).over(later)
    edges = edge.withColumns(parts).filter("__own").drop("__own", *fields)
    joined = edges.join(whole, [key, "__b"])

    def total(f: str) -> Column:
        terms = [F.coalesce(f"{f}_{part}", F.lit(0)) for part in ("own", "whole", "old")]
        return terms[0] + terms[1] + terms[2]

    out = []
    for name, (kind, c) in aggs.items():
        if kind == "count":
            out.append((total("n_rows") if c is None else total(f"n_{c}")).cast("bigint").alias(name))
        elif kind == "avg":
            out.append(F.try_divide(total(f"sum_{c}"), total(f"n_{c}")).alias(name))
        elif kind == "sum":
            out.append(F.when(total(f"n_{c}") > 0, total(f"sum_{c}")).alias(name))
        else:
            raise ValueError(f"unknown trailing aggregate: {kind}")
    return joined.select(key, "__t", *out)


def trailing_snapshot(df: DataFrame, key: str, ts: str, days: float, aggs: Mapping[str, tuple[str, str | None]],
                      as_of=None) -> DataFrame:
    """The trailing features of every key at one instant, for joining to a stream: one row per key."""
    end = instant(as_of, df, ts)
    recent = df.filter((F.col(ts) > end - seconds(days * 86400)) & (F.col(ts) <= end) & F.col(key).isNotNull())
    kinds = {"count": lambda c: F.count(c if c else F.lit(1)), "avg": F.avg, "sum": F.sum}
    return recent.groupBy(key).agg(*[kinds[kind](c).alias(name) for name, (kind, c) in aggs.items()])


def active_model_asof(assessments: DataFrame, updates: DataFrame, ts: str = "assessment_timestamp",
                      model: str = "new_model_id", at: str = "event_time", rows_per_task: int = 200_000) -> DataFrame:
    """Adds ``active_model``: the newest update at or before each row's time, null before the first.

    Of updates at one instant the largest id counts; rows without a time and updates without one meet nothing. An ordered
    merge: rows and updates go in one union, dealt by hour, and the last update is carried forward in the order of time
    inside each part. An hour of over ``rows_per_task`` updates is cut in time; one of more rows than that is dealt over several parts,
    each with the hour's updates, so rows of a single instant are spread too. What a part carries in comes from one row per
    stretch of time, the only order over everything. A row crosses the network once and is never paired with updates.
    """
    known = assessments.filter(F.col(ts).isNotNull()).select(F.struct(*assessments.columns).alias("__row"), F.col(ts).alias("__t"))
    changes = updates.filter(F.col(at).isNotNull() & F.col(model).isNotNull()).groupBy(F.col(at).cast(assessments.schema[ts].dataType).alias("__t")).agg(
        F.max(model).alias("__model"))
    rows, steps = (x.withColumn("__hour", F.date_trunc("hour", "__t")) for x in (known, changes))

    sizes = rows.select("__hour", F.lit(1).alias("r"), F.lit(0).alias("u")).unionByName(steps.select("__hour", F.lit(0).alias("r"), F.lit(1).alias("u"))) \
        .groupBy("__hour").agg(F.sum("r").alias("r"), F.sum("u").alias("u"))
    dealt = sizes.select("__hour", F.ceil(F.greatest("u", F.lit(1)) / rows_per_task).cast("int").alias("__cuts"),
                         F.ceil(F.greatest("r", F.lit(1)) / rows_per_task).cast("int").alias("__parts"))
    special = dealt.filter("__cuts > 1 OR __parts > 1")

    def placed(x: DataFrame) -> DataFrame:
        into = (micros("__t") - micros("__hour")) / F.lit(3_600_000_000.0)
        return x.join(special, "__hour", "left").na.fill(1, ["__cuts", "__parts"]).withColumn("__cut", F.floor(into * F.col("__cuts")).cast("int"))

    def all_parts(x: DataFrame) -> DataFrame:
        return x.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))

    cut_steps = placed(steps)
    lasts = cut_steps.groupBy("__hour", "__cut").agg(F.max_by("__model", "__t").alias("__last"))
    stretches = dealt.select("__hour", "__parts", F.explode(F.sequence(F.lit(0), F.col("__cuts") - 1)).alias("__cut")).join(lasts, ["__hour", "__cut"], "left")
    before = Window.partitionBy().orderBy("__hour", "__cut").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_parts(stretches.withColumn("__model", F.last("__last", ignorenulls=True).over(before)))

    nothing = F.lit(None).cast(known.schema["__row"].dataType).alias("__row")
    deal = ["__hour", "__cut", "__part"]
    own = placed(rows).withColumn("__part", F.pmod(F.xxhash64("__row"), F.col("__parts")).cast("int")).select(
        *deal, F.lit(2).alias("__order"), "__t", F.lit(None).cast(updates.schema[model].dataType).alias("__model"), "__row")
    moved = all_parts(cut_steps).select(*deal, F.lit(1).alias("__order"), "__t", "__model", nothing)
    start = carried.select(*deal, F.lit(0).alias("__order"), F.lit(None).cast(assessments.schema[ts].dataType).alias("__t"), "__model", nothing)
    merged = own.unionByName(moved).unionByName(start)
    so_far = Window.partitionBy(*deal).orderBy(F.col("__t").asc_nulls_first(), "__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = merged.withColumn("active_model", F.last("__model", ignorenulls=True).over(so_far)).filter("__row IS NOT NULL").select("__row.*", "active_model")
    timeless = assessments.filter(F.col(ts).isNull()).withColumn("active_model", F.lit(None).cast(updates.schema[model].dataType))
    return told.unionByName(timeless)


def gap_fill_hours(df: DataFrame, ts: str, as_of=None, hours: int = 24) -> DataFrame:
    """The trailing hours before ``as_of``, oldest first, with zeros for hours without rows.

    Slot ``hours_ago`` = i covers [as_of - (i+1) h, as_of - i h).
    """
    end = instant(as_of, df, ts)
    age = (micros(end) - micros(ts)) / F.lit(3_600_000_000)
    recent = df.filter((F.col(ts) >= end - seconds(hours * 3600)) & (F.col(ts) < end))
    slots = recent.groupBy((F.ceil(age) - 1).cast("int").alias("hours_ago")).agg(
        F.count(F.lit(1)).alias("assessments"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("high_risk"),
        F.avg("risk_score").alias("average_risk_score"))
    every = df.sparkSession.range(hours).select(F.col("id").cast("int").alias("hours_ago"))
    return every.join(slots, "hours_ago", "left").na.fill(
        {"assessments": 0, "high_risk": 0, "average_risk_score": 0.0}).orderBy(F.desc("hours_ago"))


def repeat_rate(df: DataFrame, id_col: str, ts: str, within: str = "30 minutes") -> DataFrame:
    """Requests that follow another of their id in under ``within``: totals and rate.

    Time is cut into stretches as long as ``within``. All but the first request of an id and stretch repeat; the first one
    does if the id's last request of the stretch before is near enough. So counts, first and last instants per id and
    stretch suffice, and no id is ordered in one task. Rows without id or instant do not count.
    """
    width = interval_micros(within)
    t = micros(ts)
    known = df.filter(F.col(id_col).isNotNull() & F.col(ts).isNotNull())
    parts = known.groupBy(F.col(id_col).alias("id"), F.floor(t / F.lit(width)).cast("bigint").alias("stretch")).agg(
        F.count(F.lit(1)).alias("requests"), F.min(t).alias("first"), F.max(t).alias("last"))
    before = parts.select("id", (F.col("stretch") + 1).alias("stretch"), F.col("last").alias("last_before"))
    repeats = F.col("requests") - F.when(F.col("first") - F.col("last_before") < width, 0).otherwise(1)
    total, hits = F.coalesce(F.sum("requests"), F.lit(0)), F.coalesce(F.sum(repeats), F.lit(0))
    return parts.join(before, ["id", "stretch"], "left").agg(
        total.alias("total_requests"), hits.alias("repeated_requests"), F.round(F.try_divide(hits, total), 6).alias("repeat_rate"))
