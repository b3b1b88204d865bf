"""Risk scoring as column expressions, parameterised by a named profile.

The same functions serve batch and streaming frames: nothing here aggregates, shuffles or runs a job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import as_col, is_night, is_weekend, present_list


@dataclass(frozen=True)
class Inputs:
    """Names of the request columns the rules look at."""

    amount: str = "amount"
    customer_id: str = "customer_id"
    ts: str = "transaction_timestamp"
    location: str = "location"
    age: str = "customer_age"


Predicate = Callable[[Inputs], Column]


def _over(limit: float) -> Predicate:
    return lambda c: F.col(c.amount) > limit


def _between(low: float, high: float) -> Predicate:
    return lambda c: (F.col(c.amount) > low) & (F.col(c.amount) <= high)


def _new_customer(c: Inputs) -> Column:
    return F.col(c.customer_id).startswith("NEW")


def _night(c: Inputs) -> Column:
    return is_night(c.ts)


def _outside_business_day(c: Inputs) -> Column:
    hour = F.hour(c.ts)
    return (hour < 6) | (hour > 22)


def _weekend(c: Inputs) -> Column:
    return is_weekend(c.ts)


def _age_outside(c: Inputs) -> Column:
    return (F.col(c.age) < 25) | (F.col(c.age) > 65)


def _age_outside_or_missing(c: Inputs) -> Column:
    return _age_outside(c) | F.col(c.age).isNull()


def _risky_location(c: Inputs) -> Column:
    return F.col(c.location).contains("HIGH_RISK")


@dataclass(frozen=True)
class Profile:
    """One deployment's constants: score floors, fallback weights, level scheme."""

    name: str
    floors: tuple[tuple[str, float, Predicate], ...] = ()
    weights: tuple[tuple[float, Predicate], ...] = ()
    levels: str = "three_level"
    fallback_confidence: float = 0.5
    other_action: str = "REVIEW"
    inputs: Inputs = field(default_factory=Inputs)


# Rule names, floors, weights and level limits that results must reproduce.
ENGINE = Profile(
    "engine",
    floors=(
        ("HIGH_AMOUNT_THRESHOLD", 0.7, _over(10000)),
        ("NEW_CUSTOMER", 0.5, _new_customer),
        ("UNUSUAL_TIME", 0.3, _night),
        ("WEEKEND_TRANSACTION", 0.2, _weekend),
        ("AGE_BASED_RISK", 0.2, _age_outside),
    ),
    weights=((0.4, _over(10000)), (0.2, _between(5000, 10000)), (0.2, _night), (0.1, _weekend), (0.1, _age_outside)),
    levels="four_level",
    fallback_confidence=0.5,
)
SERVICE = Profile(
    "service",
    floors=(
        ("HIGH_AMOUNT_THRESHOLD", 0.7, _over(10000)),
        ("NEW_CUSTOMER", 0.5, _new_customer),
        ("UNUSUAL_TIME", 0.3, _outside_business_day),
        ("HIGH_RISK_LOCATION", 0.6, _risky_location),
    ),
    levels="three_level",
    other_action="REVIEW",
)
GATEWAY = Profile(
    "gateway",
    weights=((0.3, _over(10000)), (0.2, _between(5000, 10000)), (0.2, _night), (0.1, _weekend),
             (0.1, _age_outside_or_missing)),
    levels="three_level",
    fallback_confidence=0.7,
    other_action="APPROVE",
)
PROFILES = {p.name: p for p in (ENGINE, SERVICE, GATEWAY)}

LEVELS = {
    "three_level": ((0.8, "HIGH"), (0.5, "MEDIUM")),
    "four_level": ((0.9, "CRITICAL"), (0.7, "HIGH"), (0.4, "MEDIUM")),
    "merchant": ((0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM")),
}
ACTIONS = {"CRITICAL": "ESCALATE", "HIGH": "BLOCK", "MEDIUM": "REVIEW", "LOW": "APPROVE"}
LOCATION_RISK = ((10, 0.8), (100, 0.5))
LOCATION_RISK_ESTABLISHED = 0.2
# End of fixed values.


def profile_of(profile: Profile | str) -> Profile:
    return PROFILES[profile] if isinstance(profile, str) else profile


def risk_level(score: Column | str, scheme: str = "three_level") -> Column:
    """Level of a score; ``merchant`` compares strictly, ``cut`` uses right-closed bins. Null -> null."""
    from riskloom.functions.columns import cut_levels

    c = as_col(score)
    if scheme == "cut":
        return cut_levels(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for limit, name in LEVELS[scheme]:
        out = out.when(c > limit if scheme == "merchant" else c >= limit, name)
    return out.otherwise("LOW")


def recommended_action(level: Column | str, default: str = "REVIEW") -> Column:
    c = as_col(level)
    out = None
    for name, action in ACTIONS.items():
        out = F.when(c == name, action) if out is None else out.when(c == name, action)
    return out.otherwise(default)


def location_risk(count: Column | str) -> Column:
    """Risk of a location from its transaction count: the fewer, the riskier."""
    c = as_col(count)
    out = None
    for limit, risk in LOCATION_RISK:
        out = F.when(c < limit, risk) if out is None else out.when(c < limit, risk)
    return out.otherwise(LOCATION_RISK_ESTABLISHED)


def floored_score(base: Column | str, profile: Profile | str) -> Column:
    """Base score raised to the floor of every rule that fires, at most 1."""
    p = profile_of(profile)
    floors = [F.when(fires(p.inputs), F.lit(floor)) for _, floor, fires in p.floors]
    raised = F.greatest(as_col(base), *floors) if floors else as_col(base)
    return F.when(as_col(base).isNotNull(), F.least(F.lit(1.0), raised))


def fired_rules(profile: Profile | str) -> Column:
    p = profile_of(profile)
    if not p.floors:
        return F.array().cast("array<string>")
    return present_list(*[F.when(fires(p.inputs), F.lit(name)) for name, _, fires in p.floors])


def additive_score(profile: Profile | str) -> Column:
    """Score from rules alone, used when no model score is available."""
    p = profile_of(profile)
    total = F.lit(0.0)
    for weight, fires in p.weights:
        total = total + F.when(fires(p.inputs), F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), total)


def decision_path_col(amount: Column | str, ts: Column | str, score: Column | str) -> Column:
    # The step texts.
    return present_list(
        F.when(as_col(amount) > 10000, "High amount detected"),
        F.when(is_night(ts), "Transaction during night hours"),
        F.when(is_weekend(ts), "Weekend transaction"),
        F.format_string("Final risk score: %.3f", as_col(score)),
    )


# -- frame-level operators --------------------------------------------------------------------

def naive_risk_score(df: DataFrame, inputs: Inputs = Inputs()) -> DataFrame:
    """Three-part heuristic score; its smallest value for known amounts is 0.6.

    An unknown location counts as an ordinary one; an unknown amount gives no score and no level.
    """
    amount = F.col(inputs.amount)
    base = F.when(amount > 10000, 0.7).when(amount.isNotNull(), 0.3)
    customer = F.when(_new_customer(inputs), 0.5).otherwise(0.2)
    place = F.when(_risky_location(inputs), 0.6).otherwise(0.1)
    scored = df.withColumn("risk_score", F.when(base.isNotNull(), F.least(F.lit(1.0), base + customer + place)))
    return scored.withColumn("risk_level", risk_level("risk_score", "three_level"))


def rules_max(df: DataFrame, profile: Profile | str = "engine", base_score_col: str = "base_score") -> DataFrame:
    return df.withColumns({
        "risk_score": floored_score(base_score_col, profile),
        "business_rules_applied": fired_rules(profile),
    })


def rules_additive(df: DataFrame, profile: Profile | str = "engine") -> DataFrame:
    return df.withColumn("risk_score", additive_score(profile))


def score_with_fallback(df: DataFrame, model_col: str, profile: Profile | str = "engine",
                        model_confidence: float | str = 0.8) -> DataFrame:
    """Model score where there is one, else the additive score with the profile's confidence."""
    p = profile_of(profile)
    known = F.col(model_col).isNotNull()
    confidence = F.col(model_confidence) if isinstance(model_confidence, str) else F.lit(float(model_confidence))
    return df.withColumns({
        "base_score": F.coalesce(F.col(model_col), additive_score(p)),
        "confidence": F.when(known, confidence).otherwise(F.lit(p.fallback_confidence)),
    })


def error_policy(df: DataFrame, invalid: Column, mode: str = "default") -> DataFrame:
    """Rows that failed: ``default`` keeps them as 0.5 / MEDIUM / 0.5, ``drop`` removes them."""
    bad = F.coalesce(invalid, F.lit(True))
    if mode == "drop":
        return df.filter(~bad)
    if mode != "default":
        raise ValueError(f"unknown error policy: {mode}")
    return df.withColumns({
        "risk_score": F.when(bad, F.lit(0.5)).otherwise(F.col("risk_score")),
        "risk_level": F.when(bad, F.lit("MEDIUM")).otherwise(F.col("risk_level")),
        "confidence": F.when(bad, F.lit(0.5)).otherwise(F.col("confidence")),
    })


def decision_path(df: DataFrame, inputs: Inputs = Inputs(), score_col: str = "risk_score") -> DataFrame:
    return df.withColumn("decision_path", decision_path_col(inputs.amount, inputs.ts, score_col))


def score_batch(df: DataFrame, profile: Profile | str = "engine", model_col: str | None = None,
                model_confidence: float | str = 0.8, invalid: Column | None = None, on_error: str = "default") -> DataFrame:
    """Complete assessment of every row: score, confidence, rules, level, action.

    Rows that are ``invalid`` (or for which that is unknown) follow ``error_policy`` before their action is chosen.
    """
    p = profile_of(profile)
    model = df if model_col else df.withColumn("__model", F.lit(None).cast("double"))
    based = score_with_fallback(model, model_col or "__model", p, model_confidence)
    ruled = rules_max(based, p)
    levelled = ruled.withColumn("risk_level", risk_level("risk_score", p.levels))
    if invalid is not None:
        levelled = error_policy(levelled, invalid, on_error)
    out = levelled.withColumn("recommended_action", recommended_action("risk_level", p.other_action))
    return out if model_col else out.drop("__model")
