"""Mixing sources to target weights with a time-varying curriculum.

Each source gets a token target. Its weight over training time t in [0, 1] is
a piecewise linear schedule; integrated and scaled to the target it is the
source's cumulative token demand. A document's place in its source's stream
(its running sum of words) is put through the inverse of that demand, which
gives the training position, and documents are range-sorted by position.

Main path: DataFrame functions only.

Defined results: a null text counts no words and is never taken; an empty
table gives an empty result; a null source is a source of its own, after the
others; repeated rows and null ids are separate documents; texts are read
whole, and one that is longer than a target may be taken not at all; other
columns, of any name, are kept aside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, order_key, running_sums, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Tokens to take, in hundredths of all tokens, and the most of a source.
SHARE_PERCENT = 150
MOST_PERCENT = 200
#: Relative weight at knots of training time, by weight class: the strongest
#: class starts high and fades, the weakest one grows.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.25, 1.0, 1.75))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE_PERCENT, most: int = MOST_PERCENT) -> DataFrame:
    """(source, source_size, target, weight_class) of `sizes` (source, size).

    Targets are proportional to weight but stop at `most` percent of the
    source's size, and the excess is shared by weight among the others until
    none is above. In order of size / weight the sources that stop come
    first, so the level is found by running sums in place of rounds.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    known = F.array(*(F.lit(w) for w in weights))
    ranked = by_source.withColumn("weight_class", (F.row_number().over(order) - 1) % len(weights)).withColumn(
        "weight", F.element_at(known, F.col("weight_class") + 1).cast("long")
    )
    along = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    state = (
        ranked.withColumn("_all", F.sum("source_size").over(all_rows))
        .withColumn("_stopped", F.coalesce(F.sum("source_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_weight", F.sum("weight").over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_room", F.lit(share) * F.col("_all") - F.lit(most) * F.col("_stopped"))
        # the first source that doesn't stop ends the run of those that do
        .withColumn("_stops", F.col("weight") * F.col("_room") > F.lit(most) * F.col("source_size") * F.col("_weight"))
        .withColumn("_open", F.max(F.when(~F.col("_stops"), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    level = F.max(F.when(F.col("_open") == 1, F.struct(F.col("_weight"), F.col("_room")))).over(all_rows)
    return state.withColumn("_level", level).select(
        "source",
        "source_size",
        "weight_class",
        F.when(F.col("_open") == 0, (F.lit(most) * F.col("source_size")).cast("double") / F.lit(100.0))
        .otherwise((F.col("weight") * F.col("_level._room")).cast("double") / (F.lit(100) * F.col("_level._weight")).cast("double"))
        .alias("target"),
    )


def training_position(share: Column, weight_class: Column, schedules=SCHEDULES, knots=KNOTS) -> Column:
    """The time at which a source's demand reaches `share` (0 to 1) of its target.

    Between knots the weight is linear, so the demand is a quadratic and is
    inverted in closed form, in the segment whose demand holds the share.
    """

    def of(weights: Sequence[float]) -> Column:
        areas = [(weights[i] + weights[i + 1]) / 2 * (knots[i + 1] - knots[i]) for i in range(len(knots) - 1)]
        done, total, place = 0.0, sum(areas), F.lit(float(knots[-1]))
        steps = []
        for i, area in enumerate(areas):
            steps.append((i, done / total, (done + area) / total, total))
            done += area
        for i, low, high, total in reversed(steps):
            rest = (share - F.lit(low)) * F.lit(total)
            w, slope = weights[i], (weights[i + 1] - weights[i]) / (knots[i + 1] - knots[i])
            # slope/2 x^2 + w x = rest, in the form that stays exact for a slope of 0
            root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * rest, F.lit(0.0)))
            x = F.when(rest <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(w) + root))
            place = F.when(share < F.lit(high), F.lit(float(knots[i])) + x).otherwise(place)
        return place

    out = of(schedules[0])
    for i, weights in enumerate(schedules[1:], start=1):
        out = F.when(weight_class == i, of(weights)).otherwise(out)
    return out


def mixed(docs: DataFrame, keep: Sequence[str] = (), **options) -> DataFrame:
    """One row per document: what the mix takes of it and when.

    Documents of a source follow each other in a pseudo-random order, again
    from the start when the target asks for more than there is. A whole
    document is taken if at least half of it lies before the target's end.
    Columns: doc_id, size, source, source_size, target, taken, position (of
    the first take; null if it isn't taken), times, before (words of the source
    that come first), weight_class, and those in `keep`.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep).withColumn(
        "order_key", order_key(F.col("doc_id"), F.col("source"))
    )
    if not keep:
        sized = materialise(sized, "sizes")
    targets = source_targets(sized, **options)
    rows = running_sums(sized, ["source"], ["doc_id", "size"], {"before": F.col("size")}, extra=targets)
    middle = lambda e: (2 * (F.lit(e) * F.col("source_size") + F.col("before")) + F.col("size")).cast("double")
    times = sum((F.when((F.col("size") > 0) & (middle(e) <= 2 * F.col("target")), 1).otherwise(0) for e in (0, 1)), F.lit(0))
    share = F.col("before").cast("double") / F.col("target")
    return rows.withColumn("times", times).select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
        F.when(F.col("times") > 0, training_position(F.least(share, F.lit(1.0)), F.col("weight_class"))).alias("position"),
        "times",
        "before",
        "weight_class",
        *keep,
    )


def training_order(mix: DataFrame) -> DataFrame:
    """The documents taken, range-sorted by training position: partitions follow each other."""
    return in_order(mix.where("times > 0"))


def in_order(mix: DataFrame) -> DataFrame:
    """All documents range-sorted by training position, those not taken at the end."""
    last = F.coalesce(F.col("position"), F.lit(2.0))
    order = [F.col("_place"), F.col("doc_id")]
    parts = int(mix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mix.withColumn("_place", last).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_place")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The columns of `docs`, a row per take of a document, range-sorted by training position."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    mix = mixed(rows, keep=("_row",), **options).where("times > 0")
    takes = mix.withColumn("_take", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    share = (F.col("_take") * F.col("source_size") + F.col("before")).cast("double") / F.col("target")
    placed = takes.select("doc_id", training_position(F.least(share, F.lit(1.0)), F.col("weight_class")).alias("position"), "_row")
    return in_order(placed).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
