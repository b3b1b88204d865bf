"""Scalar building blocks: every function takes columns and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NIGHT_FROM_HOUR, NIGHT_UNTIL_HOUR = 22, 6
YOUNG_BELOW, SENIOR_ABOVE = 25, 65
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
SCORE_BUCKETS = [(0.2, "0.0-0.2"), (0.4, "0.2-0.4"), (0.6, "0.4-0.6"), (0.8, "0.6-0.8")]
TOP_SCORE_BUCKET = "0.8-1.0"
CUT_LEVELS = [(0.3, "Low"), (0.6, "Medium"), (0.8, "High"), (1.0, "Critical")]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- time -------------------------------------------------------------------------------------

def day_of_week(ts: Column | str) -> Column:
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(as_col(ts)) - 1


def is_weekend(ts: Column | str) -> Column:
    return F.dayofweek(as_col(ts)).isin(1, 7)


def is_night(ts: Column | str) -> Column:
    hour = F.hour(as_col(ts))
    return (hour >= NIGHT_FROM_HOUR) | (hour <= NIGHT_UNTIL_HOUR)


def calendar_features(ts: Column | str, sunday: int = 0) -> dict[str, Column]:
    """hour, day_of_week (Sunday = ``sunday``), month, is_weekend, is_night."""
    return {
        "hour": F.hour(as_col(ts)),
        "day_of_week": day_of_week(ts) + F.lit(sunday),
        "month": F.month(as_col(ts)),
        "is_weekend": is_weekend(ts).cast("int"),
        "is_night": is_night(ts).cast("int"),
    }


def date_functions(ts: Column | str) -> dict[str, Column]:
    c = as_col(ts)
    return {
        "ts_hour": F.date_trunc("hour", c).cast("timestamp_ntz"),
        "ts_date": F.to_date(c),
        "hour_of_day": F.hour(c),
        "day_of_week": day_of_week(c),
        "week_earlier": c - F.expr("INTERVAL '7' DAY"),
    }


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole days of ``end - start``."""
    return F.extract(F.lit("DAY"), as_col(end) - as_col(start))


def case_day_name(dow: Column | str) -> Column:
    """0..6 -> weekday name, anything else null."""
    return F.try_element_at(F.array(*map(F.lit, DAY_NAMES)), as_col(dow).cast("int") + 1)


# -- amounts, ages, ratios --------------------------------------------------------------------

def amount_transforms(amount: Column | str, plus_one: bool = True) -> dict[str, Column]:
    """log, square root, square and cube of an amount; ``plus_one=False`` gives the plain log."""
    x = as_col(amount)
    log = F.log1p(x) if plus_one else F.when(x > 0, F.ln(x))
    return {"amount_log": log, "amount_sqrt": F.sqrt(x), "amount_squared": x * x, "amount_cubed": x * x * x}


def age_features(age: Column | str) -> dict[str, Column]:
    """Flags stay null when the age is unknown."""
    x = as_col(age)
    return {"is_young": (x < YOUNG_BELOW).cast("int"), "is_senior": (x > SENIOR_ABOVE).cast("int")}


def interaction_features(amount: Column | str, age: Column | str, customer_count: Column | str,
                         customer_avg: Column | str) -> dict[str, Column]:
    x = as_col(amount)
    return {
        "amount_age_ratio": F.try_divide(x, as_col(age)),
        "amount_frequency_ratio": F.try_divide(x, as_col(customer_count)),
        "amount_ratio": F.try_divide(x, as_col(customer_avg)),
    }


def snap(x: Column | str) -> Column:
    """Drop the noise of binary sums beyond 14 significant digits, so that limits and ties decide as decimals do."""
    return F.format_string("%.13e", as_col(x).cast("double")).try_cast("double")


def round_half_up(x: Column | str, digits: int) -> Column:
    return F.round(snap(x), digits)


def distinct_count(x: Column | str, approx: bool = False) -> Column:
    """Distinct values; ``approx`` estimates them (5 % standard error) from sketches that merge before the shuffle."""
    return F.approx_count_distinct(as_col(x)) if approx else F.count_distinct(as_col(x))


def percent(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``part`` of ``whole`` in percent; null for an empty whole."""
    return F.round(F.try_divide(as_col(part) * F.lit(100.0), as_col(whole)), digits)


def coalesce_delta(current: Column | str, previous: Column | str) -> Column:
    """Change against the previous value, 0 when there is none."""
    return as_col(current) - F.coalesce(as_col(previous), as_col(current))


def clamp(x: Column | str, low: float | None = 0.0, high: float | None = 1.0) -> Column:
    """Limit to [low, high]; null stays null although least/greatest skip nulls."""
    c = as_col(x)
    out = c
    if high is not None:
        out = F.least(F.lit(high), out)
    if low is not None:
        out = F.greatest(F.lit(low), out)
    return F.when(c.isNotNull(), out)


# -- score binning ----------------------------------------------------------------------------

def score_bucket(score: Column | str, null_bucket: str | None = TOP_SCORE_BUCKET) -> Column:
    """Five buckets of width 0.2. A null score lands in the top bucket unless told otherwise."""
    c = as_col(score)
    out = F.when(c.isNull(), F.lit(null_bucket))
    for limit, label in SCORE_BUCKETS:
        out = out.when(c < limit, label)
    return out.otherwise(TOP_SCORE_BUCKET)


def cut_levels(score: Column | str) -> Column:
    """Right-closed bins over [0, 1], lowest edge included; outside is null."""
    c = as_col(score)
    out = F.when((c < 0) | (c > 1) | c.isNull(), F.lit(None).cast("string"))
    for limit, label in CUT_LEVELS:
        out = out.when(c <= limit, label)
    return out


# -- strings, JSON, maps ----------------------------------------------------------------------

def string_predicates(customer_id: Column | str, location: Column | str, path: Column | str) -> dict[str, Column]:
    return {
        "is_new_customer": as_col(customer_id).startswith("NEW"),
        "is_high_risk_location": as_col(location).contains("HIGH_RISK"),
        "is_csv_or_json": as_col(path).rlike(r"\.(csv|json)$"),
    }


def json_map(col: Column | str) -> Column:
    """JSON object text -> map<string,double>; malformed text -> null."""
    return F.from_json(as_col(col), "map<string,double>")


def json_functions(features: Column | str, **fields: Column) -> dict[str, Column]:
    """Pairs of a JSON object, and a response serialised back to JSON."""
    parsed = json_map(features)
    return {
        "pairs": F.map_entries(parsed),
        "response_json": F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()], parsed.alias("features"))),
    }


def present_map(**entries: Column) -> Column:
    """map<string,double> holding only the non-null entries."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("double").alias("value")) for k, c in entries.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def present_list(*items: Column) -> Column:
    """array<string> of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def map_array_features(amount: Column | str, ts: Column | str, age: Column | str) -> dict[str, Column]:
    """A feature map with absent entries for unknown values, and the list of raised flags."""
    cal, ages = calendar_features(ts), age_features(age)
    return {
        "features": present_map(
            amount=as_col(amount), hour=cal["hour"], is_night=cal["is_night"],
            customer_age=as_col(age), is_young=ages["is_young"], is_senior=ages["is_senior"]),
        "flags": present_list(
            F.when(is_night(ts), "NIGHT"), F.when(is_weekend(ts), "WEEKEND"),
            F.when(ages["is_young"] == 1, "YOUNG"), F.when(ages["is_senior"] == 1, "SENIOR")),
    }
