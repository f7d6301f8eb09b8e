"""Rolling-origin prediction: a target term is scored by what could be read before its first arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clock import keyed_bits
from .boosting import Boosting, Model, fit


def training_pairs(rows: DataFrame, term: str, target: str = "target") -> DataFrame:
    """`rows` with `target`: one for each later term that began after the row's result was readable.

    Terms come to the driver, since each is a model.
    """
    starts = rows.where(F.col(term).isNotNull()).groupBy(term).agg(F.min("arrival_us").alias("start")).orderBy(term).collect()
    if not starts:
        return rows.withColumn(target, F.col(term)).limit(0)
    terms = F.array(*(F.struct(F.lit(r[term]).cast(rows.schema[term].dataType).alias("term"), F.lit(r.start).alias("start")) for r in starts))
    later = F.filter(terms, lambda t: (t["term"] > F.col(term)) & (F.col("available_us") < t["start"]))
    return rows.withColumn("_t", F.explode(later)).withColumn(target, F.col("_t.term")).drop("_t")


def cutoffs(pairs: DataFrame, by: Sequence[str], value: str, **shares: float) -> DataFrame:
    """(by, a column per share): exact quantiles of each model's own training rows, so that no cut-off knows its target.

    Values are counted and the counts sum up along a sorted stream, so that no task holds all values of a model.
    """
    counts = pairs.groupBy(*by, value).agg(F.count(value).alias("_n"))
    along = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = counts.withColumns({"_to": F.sum("_n").over(along), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    out = []
    for name, p in shares.items():
        at = (F.col("_all") - F.lit(1)).cast("double") * F.lit(p)
        held = lambda rank: F.max(F.when((F.col("_to") > rank) & (F.col("_to") - F.col("_n") <= rank), F.col(value).cast("double")))
        out += [held(F.floor(at)).alias(f"_low_{name}"), held(F.ceil(at)).alias(f"_high_{name}"), F.max(at).alias(f"_at_{name}")]
    both = lambda n: (F.ceil(f"_at_{n}") - F.col(f"_at_{n}")) * F.col(f"_low_{n}") + (F.col(f"_at_{n}") - F.floor(f"_at_{n}")) * F.col(f"_high_{n}")
    return steps.groupBy(*by).agg(*out).select(*by, *(F.when(F.col(f"_low_{n}") == F.col(f"_high_{n}"), F.col(f"_low_{n}")).otherwise(both(n)).alias(n) for n in shares))


def rolling_models(rows: DataFrame, term: str, features: Sequence[str], label: str, spec: Boosting = Boosting()) -> Model:
    """A frozen model per target term, all fitted in one plan; bins, start scores and trees know no row of their target."""
    return fit(training_pairs(rows, term), ["target"], features, label, spec)


def forward_scores(model: Model, rows: DataFrame, term: str, name: str = "prediction") -> DataFrame:
    """`rows` with the score by their own term's model; rows of terms without a past are left out.

    The histories may have changed since the fit: nothing is learned here.
    """
    return model.score(rows.withColumn("target", F.col(term)), name).where(F.col(name).isNotNull()).drop("target")


def drawn(seed: Column, share: float, *keys: str) -> Column:
    """Whether a row is in the part that a seed draws, from its keys alone."""
    return keyed_bits(seed, *(F.col(k) for k in keys)).cast("double") * F.lit(2.0**-52) < F.lit(share)


def ensemble(rows: DataFrame, by: Sequence[str], features: Sequence[str], label: str, seeds: Sequence[int], share: float, key: str, spec: Boosting) -> Model:
    """Models of `by` for every seed, each of the part of rows that the seed draws, fitted in one plan."""
    seeded = rows.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds)))).where(drawn(F.col("seed"), share, key))
    return fit(seeded, [*by, "seed"], features, label, spec)


def averaged(model: Model, rows: DataFrame, seeds: Sequence[int], key: str, name: str = "prediction") -> DataFrame:
    """(key, prediction): the mean over an ensemble's seeds. `rows` has the other columns that models are told by."""
    seeded = rows.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))
    return model.score(seeded, name).groupBy(key).agg(F.avg(name).alias(name)).where(F.col(name).isNotNull())


def calibrated(model: Model, past: DataFrame, rows: DataFrame, by: Sequence[str], label: str, name: str = "prediction", bins: int = 20) -> DataFrame:
    """`rows` (with predictions) with `calibrated`: the share of true labels among `past` rows in the same bin of the prediction.

    Bins are equal steps; a bin's share leans to the middle of its predictions
    by one row, so empty bins give that.
    """
    step = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    seen = past.withColumn("_bin", step(name)).groupBy(*by, "_bin").agg(F.sum(F.col(label).cast("double")).alias("_t"), F.count("*").alias("_n"))
    out = rows.withColumn("_bin", step(name)).join(seen, [*by, "_bin"], "left")
    middle = (F.col("_bin") + F.lit(0.5)) / F.lit(float(bins))
    share = (F.coalesce("_t", F.lit(0.0)) + middle) / (F.coalesce("_n", F.lit(0)) + F.lit(1.0))
    return out.withColumn("calibrated", share).drop("_bin", "_t", "_n")


def superposition_forecast(panel: DataFrame, group: str, phase: str, value: str) -> DataFrame:
    """(group, phase, forecast): each group's level times the common shape over phases."""
    level = panel.groupBy(group).agg(F.avg(value).alias("_level"))
    shape = panel.join(level, group).groupBy(phase).agg(F.try_divide(F.sum(value), F.sum("_level")).alias("_shape"))
    return panel.select(group, phase).distinct().join(level, group).join(shape, phase).select(group, phase, (F.col("_level") * F.col("_shape")).alias("forecast"))
