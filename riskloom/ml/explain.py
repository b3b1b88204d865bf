"""Explanations of single predictions. The explained rows, samples and features bound the work."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.ml import trees
from riskloom.schemas import EXPLANATION, struct_of


def shap_values(model: PipelineModel, rows: DataFrame, features: Sequence[str], id_col: str, background: DataFrame | None = None,
                **sampling) -> DataFrame:
    """Shapley values: (id, feature, contribution, gap).

    Exact and path-dependent for tree ensembles, without a shuffle; ``gap`` is then what the contributions of the row and
    the mean score of the training rows leave of its score, zero up to rounding. Other models are sampled over ``background`` (``rows``
    if none is given) and have a null ``gap``.
    """
    features = list(features)
    if not trees.is_ensemble(model):
        told = shap_sampling(model, rows, rows if background is None else background, features, id_col, **sampling)
        return told.withColumn("gap", F.lit(None).cast("double"))
    out = trees.shap_trees(model, rows, id_col)
    gap = F.col("score") - F.col("base") - F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    pairs = F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.col("contributions").alias("contribution"))
    return out.select(id_col, F.inline(pairs).alias("feature", "contribution"), gap.alias("gap"))


def shap_sampling(model: PipelineModel, rows: DataFrame, background: DataFrame, features: Sequence[str], id_col: str,
                  n_perm: int = 10, n_background: int = 10, seed: int = 42) -> DataFrame:
    """Sampled Shapley values: (id, feature, contribution).

    For every row, background row and feature order, features switch from the background to the row one
    by one; each switch is credited with the change of the probability. Contributions of a row add up to
    its probability minus the mean over the background. One transform scores all mixtures and one
    aggregate collects the signed probabilities.
    """
    features = list(features)
    k = len(features)
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(k) for _ in range(n_perm)]
    sample = background.select(id_col, *features).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n_background)
    reference = sample.agg(F.collect_list(F.struct(*features))).scalar()
    # position of every feature in every order, so feature i is switched on from step position+1
    order_col = F.array(*[F.array(*[F.lit(int(f)) for f in o]) for o in orders])
    place_col = F.array(*[F.array(*[F.lit(int(np.flatnonzero(o == i)[0])) for i in range(k)]) for o in orders])
    mixed = (
        rows.select(F.col(id_col).alias("__id"), F.struct(*features).alias("__x"))
        .withColumn("__b", F.explode(reference))
        .withColumn("__o", F.explode(F.arrays_zip(order_col.alias("order"), place_col.alias("place"))))
        .withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(k)))))
    evaluated = mixed.select(
        "__id", "__step", F.col("__o.order").alias("__order"),
        *[F.when(F.col("__o.place")[i] < F.col("__step"), F.col("__x")[f]).otherwise(F.col("__b")[f]).alias(f)
          for i, f in enumerate(features)])
    p = model.transform(evaluated).select("__id", "__step", "__order", vector_to_array("probability")[1].alias("p"))
    lost = F.when(F.col("__step") < k, F.struct(F.get("__order", F.col("__step")).alias("f"), (-F.col("p")).alias("v")))
    gained = F.when(F.col("__step") > 0, F.struct(F.get("__order", F.col("__step") - 1).alias("f"), F.col("p").alias("v")))
    names = F.array(*map(F.lit, features))
    signed = p.select("__id", F.inline(F.array_compact(F.array(gained, lost))))
    # every (background row, order) pair gives a feature one gain and one loss
    return signed.groupBy("__id", "f").agg((2 * F.sum("v") / F.count(F.lit(1))).alias("contribution")).select(
        F.col("__id").alias(id_col), F.element_at(names, F.col("f") + 1).alias("feature"), "contribution")


def shap_linear(df: DataFrame, coefficients: Mapping[str, float], id_col: str) -> DataFrame:
    """Exact contributions of a linear score: coefficient times distance from the mean."""
    names = list(coefficients)
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in names])).scalar()
    parts = [F.struct(F.lit(c).alias("feature"), (F.lit(float(b)) * (F.col(c) - F.col("__means")[c])).alias("contribution"))
             for c, b in coefficients.items()]
    return df.withColumn("__means", means).select(id_col, F.inline(F.array(*parts)))


def _normal(*keys: Column) -> Column:
    """Standard normal draw that depends only on the keys (Box-Muller on the two halves of a hash)."""
    h = F.xxhash64(*keys)
    u, v = ((half.cast("double") + 0.5) / float(2**32) for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(2**32 - 1))))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2 * F.pi() * v)


def _hashed(value: int | np.ndarray, h: np.ndarray) -> np.ndarray:
    """XXH64 of whole numbers of 32 bits under the seeds ``h``: what ``F.xxhash64`` makes of one more key."""
    a, b, c, e = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (h + (e + np.uint64(4))) ^ (np.asarray(value, dtype=np.uint64) * a)
    t = h >> np.uint64(41)
    h <<= np.uint64(23)
    h |= t
    h *= b
    h += c
    for shift, factor in ((33, b), (29, c), (32, None)):
        np.right_shift(h, np.uint64(shift), out=t)
        h ^= t
        if factor is not None:
            h *= factor
    return h


#: The sine as a polynomial of odd powers, from the highest; off by less than 1e-15 up to a quarter of the circle.
_SINE = [(-1) ** (i % 2) / factorial(2 * i + 1) for i in range(10, -1, -1)]


def _cosine_of_turns(v: np.ndarray) -> np.ndarray:
    """The cosine of ``v`` turns for v in [0, 1], in place: the sine of what |v - 1/2| is over a quarter."""
    v -= 0.5
    np.abs(v, out=v)
    v -= 0.25
    v *= 2 * np.pi
    square = v * v
    out = np.full_like(v, _SINE[0])
    for c in _SINE[1:]:
        out *= square
        out += c
    out *= v
    return out


def _offsets(key: np.ndarray, n: int, features: int, seed: int) -> np.ndarray:
    """``_offset`` for all perturbations and features, by hash of the id: rows x n x features, of which a row's and feature's lie together."""
    with np.errstate(over="ignore"):
        drawn = _hashed(np.arange(n), key.astype(np.int64).view(np.uint64)[:, None])
        out = np.empty((len(key), features, n))
        for j in range(features):
            h = _hashed(seed, _hashed(j, drawn))
            u = (h >> np.uint64(32)).astype(np.float64)
            h &= np.uint64(2**32 - 1)
            v = h.astype(np.float64)
            for part in (u, v):
                part += 0.5
                part *= 2.0**-32
            np.log(u, out=u)
            u *= -2.0
            np.sqrt(u, out=u)
            np.multiply(u, _cosine_of_turns(v), out=out[:, j])
    out[:, :, 0] = 0.0
    return out.swapaxes(1, 2)


def _offset(key: Column, i: Column, feature: int, seed: int) -> Column:
    """The ``i``-th perturbation of a feature in deviations; the first one is the row itself."""
    return F.when(i == 0, F.lit(0.0)).otherwise(_normal(key, i, F.lit(feature), F.lit(seed)))


def lime_local(model: PipelineModel, rows: DataFrame, features: Sequence[str], id_col: str, scale: DataFrame | None = None,
               n: int = 500, k: int = 10, seed: int = 42, ridge: float = 1.0) -> DataFrame:
    """Top ``k`` weights of a local linear model per row: (id, feature, score, rank).

    ``scale`` is the frame the feature deviations come from. A row's ``n`` perturbations are drawn by its id, and weighted by
    nearness in a ridge fit. For a forest on (scaled) assembled numbers they live and die inside the Arrow batch of the
    row; other models score them as rows, and an aggregate reduces each row's to its normal equations.
    """
    features = list(features)
    deviations = (scale if scale is not None else rows).agg(
        F.struct(*[F.coalesce(F.stddev(c), F.lit(0.0)).alias(c) for c in features])).scalar()
    penalty = ridge * np.eye(len(features) + 1)
    penalty[0, 0] = 0.0
    width = 0.75 * np.sqrt(len(features))
    factors = _input_factors(model, features)
    fit = _lime_scored if factors is None else _lime_in_batches
    solved = fit(model, rows, features, id_col, deviations, n, seed, penalty, width, factors)
    names = F.array(*map(F.lit, features))
    pairs = F.arrays_zip(names.alias("feature"), F.slice(F.col("solved"), 2, len(features)).alias("score"))
    by_weight = F.array_sort(pairs, lambda x, y: F.when(F.abs(x["score"]) > F.abs(y["score"]), -1)
                             .when(F.abs(x["score"]) < F.abs(y["score"]), 1)
                             .when(x["feature"] < y["feature"], -1).otherwise(1))
    return solved.select(id_col, F.posexplode(F.slice(by_weight, 1, k)).alias("pos", "pair")).select(
        id_col, "pair.feature", "pair.score", (F.col("pos") + 1).alias("rank"))


def _input_factors(model: PipelineModel, features: list[str]) -> np.ndarray | None:
    """What the pipeline multiplies the features by before a forest classifier; None for any other pipeline."""
    stages = model.stages
    if type(stages[-1]).__name__ != "RandomForestClassificationModel" or not 2 <= len(stages) <= 3:
        return None
    if type(stages[0]).__name__ != "VectorAssembler" or list(stages[0].getInputCols()) != features:
        return None
    if len(stages) == 2:
        return np.ones(len(features))
    if type(stages[1]).__name__ != "StandardScalerModel" or stages[1].getWithMean() or not stages[1].getWithStd():
        return None
    return trees.scale_factors(stages[1])


def _lime_in_batches(model, rows, features, id_col, deviations, n, seed, penalty, width, factors) -> DataFrame:
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(trees.class_scorer(model, spark))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, step = sent.value, max(1, 20_000 // n)
        for b in batches:
            x, sd = (np.stack(b[c].to_numpy()) if len(b) else np.empty((0, len(features))) for c in ("__x", "__sd"))
            solved = []
            for lo in range(0, len(b), step):
                at = slice(lo, lo + step)
                z = _offsets(b["__key"].to_numpy()[at], n, len(features), seed).swapaxes(1, 2)
                points = [(x[at, j, None] + z[:, j] * sd[at, j, None]) * factors[j] for j in range(len(features))]
                p = forest.at(points) if isinstance(forest, trees.Table) else forest(np.stack(points, axis=2).reshape(-1, len(features))).reshape(len(z), n)
                design = np.concatenate([np.ones((len(z), 1, n)), z], axis=1)
                weighted = design * np.exp(np.einsum("rfn,rfn->rn", z, z) / -width ** 2)[:, None]
                solved.append(np.linalg.solve(weighted @ design.swapaxes(1, 2) + penalty, weighted @ p[..., None])[..., 0])
            if solved:
                yield pd.DataFrame({id_col: b[id_col], "solved": list(np.concatenate(solved))})

    given = rows.select(id_col, F.xxhash64(id_col).alias("__key"), F.array(*[F.col(c).cast("double") for c in features]).alias("__x"),
                        F.array(*[deviations[c] for c in features]).alias("__sd"))
    kind = rows.schema[id_col].dataType.simpleString()
    return given.mapInPandas(solve, f"`{id_col}` {kind}, solved array<double>")


def _lime_scored(model, rows, features, id_col, deviations, n, seed, penalty, width, factors) -> DataFrame:
    size = len(penalty)
    noisy = rows.select(F.col(id_col).alias("__id"), F.struct(*features).alias("__x"), deviations.alias("__sd")) \
        .withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) \
        .withColumns({f"__z{j}": _offset(F.col("__id"), F.col("__i"), j, seed) for j in range(len(features))})
    z_cols = [f"__z{j}" for j in range(len(features))]
    perturbed = noisy.select(
        "__id", *z_cols,
        *[(F.col("__x")[f] + F.col(f"__z{j}") * F.col("__sd")[f]).alias(f) for j, f in enumerate(features)])
    p = vector_to_array("probability")[1]
    weight = F.exp(-sum((F.col(c) * F.col(c) for c in z_cols[1:]), F.col(z_cols[0]) * F.col(z_cols[0])) / float(width**2))
    scored = model.transform(perturbed).select("__id", *z_cols, p.alias("p"), weight.alias("w"))

    # weighted normal equations per explained row, summed on the map side
    design = [F.lit(1.0), *[F.col(c) for c in z_cols]]
    left = [F.sum(F.col("w") * design[a] * design[b]) for a in range(size) for b in range(size)]
    right = [F.sum(F.col("w") * design[a] * F.col("p")) for a in range(size)]
    equations = scored.groupBy("__id").agg(F.array(*left).alias("left"), F.array(*right).alias("right"))

    @F.pandas_udf("array<double>")
    def solve(left: pd.Series, right: pd.Series) -> pd.Series:
        if left.empty:
            return pd.Series([], dtype=object)
        a = np.stack(left.to_numpy()).reshape(-1, size, size) + penalty
        return pd.Series(list(np.linalg.solve(a, np.stack(right.to_numpy())[..., None])[..., 0]))

    return equations.select(F.col("__id").alias(id_col), solve("left", "right").alias("solved"))


def explanation_struct(df: DataFrame, importance: str | None, shap: str | None, lime: str | None, path: str,
                       enabled: bool = True) -> DataFrame:
    """Adds ``explanation``, or a null one when explanations are switched off."""
    schema = struct_of(EXPLANATION)
    if not enabled:
        return df.withColumn("explanation", F.lit(None).cast(schema))
    parts = dict(zip(schema.fieldNames(), (importance, shap, lime, path)))
    return df.withColumn("explanation", F.struct(*[
        (F.col(c) if c else F.lit(None)).cast(schema[name].dataType).alias(name) for name, c in parts.items()]))


def contribution_maps(contributions: DataFrame, id_col: str, value: str = "contribution") -> DataFrame:
    """(id, map feature -> value); one entry per feature, so a row's map is as small as the feature list."""
    return contributions.groupBy(id_col).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", value)))).alias("shap_values"))
