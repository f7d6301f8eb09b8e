"""Aggregates: exact percentiles, tail shares, ranking metrics, policy summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written


def policy_summary(waits: DataFrame, by: Sequence[str], quick_us: int = 1_000_000) -> DataFrame:
    """Per policy and `by`: waits in and out of the deadline window, excess and harm against arrival order.

    `waits` has wait_us, fcfs_us, in_window, heavy, forced.
    """
    excess = F.col("wait_us") - F.col("fcfs_us")
    waits = written(waits.select(*by, "wait_us", "fcfs_us", "in_window", "heavy", "forced"), "waits")
    sums = waits.groupBy(*by).agg(
        F.count("*").alias("jobs"),
        F.avg("wait_us").alias("mean_us"),
        F.max(excess).alias("max_excess_us"),
        F.max(F.when(F.col("fcfs_us") <= quick_us, excess)).alias("harm_us"),
        F.max(F.when(F.col("heavy"), F.col("wait_us"))).alias("max_heavy_us"),
        F.avg(F.col("forced").cast("double")).alias("forced_share"),
    )
    for name, part in (("window_p99_us", waits.where("in_window")), ("p99_us", waits)):
        sums = _beside(sums, exact_quantile(part, by, "wait_us", 0.99, name), by)
    return sums.select(*by, "jobs", "window_p99_us", "mean_us", "p99_us", "max_excess_us", "harm_us", "max_heavy_us", "forced_share")


def _beside(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """`rows` with the other columns of `table`, if it has their key; null is a key like others."""
    side = table.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return rows.join(side, on, "left").drop(*(f"_k{i}" for i in range(len(by)))) if by else rows.crossJoin(F.broadcast(side))  # one row


def exact_quantile(rows: DataFrame, by: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """(by, name): the exact quantile, interpolated, as F.percentile gives it, without a group's values in one task.

    Equal values are counted first, counts summed over ranges of values; the
    values at the two ranks around the quantile are all that is left.
    """
    counts = written(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")), "counts")
    at = F.lit(float(p)) * (F.sum("_n") - 1).cast("double")
    ranks = counts.groupBy(*by).agg(at.alias("_at"))
    ranked = _beside(running_sums(counts, value, {"_upto": "_n"}, by=by), ranks, by)
    least = lambda rank: F.min(F.when(F.col("_upto") > rank(F.col("_at")), F.col(value)))
    found = ranked.groupBy(*by).agg(F.max("_at").alias("_at"), least(F.floor).alias("_low"), least(F.ceil).alias("_high"))
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    between = (F.ceil("_at") - F.col("_at")) * low + (F.col("_at") - F.floor("_at")) * high
    return found.select(*by, F.when(low == high, low).otherwise(between).alias(name))


def gap_closed(value: Column, worst: Column, best: Column) -> Column:
    """How much of the way from the worst to the best; null where there is none."""
    return F.try_divide(worst - value, worst - best)


def tail_share(rows: DataFrame, by: Sequence[str], value: str, share: float) -> DataFrame:
    """(by, tail_share): what the largest `share` of rows, at least one, has of the total."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc())
    ranked = rows.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(*by))})
    top = F.col("_r") <= F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(1))
    return ranked.groupBy(*by).agg((F.sum(F.when(top, F.col(value)).otherwise(0)) / F.sum(value)).alias("tail_share"))


def dispersion(value: Column) -> Column:
    """Variance over mean, of counts."""
    return F.try_divide(F.var_samp(value), F.avg(value))


#: Ranges of values that running sums over all rows are cut into.
RANGES = 256


def running_sums(rows: DataFrame, along: str, sums: dict[str, str], descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """`rows`, one per value of `along` (and `by`), with sums of all rows up to each: {output: summed column}.

    Values are cut into ranges at approximate quantiles, sums run inside a
    range, and each range starts at the sum of those before it, from a table of
    RANGES rows a group. So no task sees all rows, and the sums are exact.
    """
    cuts = sorted(set(rows.approxQuantile(along, [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)))
    value = F.col(along)
    part = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<double>"), lambda c: F.coalesce(c < value, F.lit(False)))).cast("int") if cuts else F.lit(0)
    rows = rows.withColumn("_part", -part if descending else part)
    inside = Window.partitionBy(*by, "_part").orderBy(value.desc() if descending else value.asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = {c: f"_g{i}" for i, c in enumerate(by)}
    totals = rows.groupBy(*(F.col(c).alias(k) for c, k in keys.items()), F.col("_part").alias("_p")).agg(*(F.sum(c).alias(f"_t_{name}") for name, c in sums.items()))
    before = Window.partitionBy(*keys.values()).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows a group
    starts = totals.select(*keys.values(), "_p", *(F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_s_{name}") for name in sums))
    on = [F.col("_part") == F.col("_p"), *(F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items())]
    joined = rows.withColumns({f"_i_{name}": F.sum(c).over(inside) for name, c in sums.items()}).join(starts if by else F.broadcast(starts), on)
    return joined.withColumns({name: F.col(f"_i_{name}") + F.col(f"_s_{name}") for name in sums}).drop("_part", "_p", *keys.values(), *(f"_{x}_{name}" for x in "is" for name in sums))


def auroc(rows: DataFrame, score: str, label: str, weight: Column | None = None) -> DataFrame:
    """One row (auroc): half a point for ties; null if there is one class only."""
    return auroc_by(rows, (), score, label, weight).select("auroc")


def auroc_by(rows: DataFrame, by: Sequence[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """(by, positives, negatives, auroc) of each group, such as users with little history; sums of weights where there are any."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    per = rows.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("q"))
    below = running_sums(per, score, {"_b": "q"}, by=by)
    pairs = below.groupBy(*by).agg(F.sum(F.col("p") * (F.col("_b") - F.lit(0.5) * F.col("q"))).alias("a"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return pairs.select(*by, "positives", "negatives", F.try_divide(F.col("a"), F.col("positives") * F.col("negatives")).alias("auroc"))


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row (average_precision): one step per block of equal scores."""
    return average_precision_by(rows, (), score, label).select("average_precision")


def average_precision_by(rows: DataFrame, by: Sequence[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """(by, average_precision) of each group, rows counting by their weights."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    per = rows.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("p"), F.sum(w).alias("n"))
    steps = running_sums(per, score, {"_p_": "p", "_n_": "n"}, descending=True, by=by)
    return steps.groupBy(*by).agg(F.try_divide(F.sum(F.coalesce(F.try_divide(F.col("p") * F.col("_p_"), F.col("_n_")), F.lit(0.0))), F.sum("p")).alias("average_precision"))


def resampled_ranking(rows: DataFrame, block: str, score: str, label: str, draws: DataFrame) -> DataFrame:
    """(resample, auroc, average_precision) of samples of whole blocks with replacement: draws has resample, block, m.

    No row is copied: it counts m times, and rows of one score and block are
    counted before they meet the draws.
    """
    few = rows.groupBy(F.col(block).alias("block"), score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    each = few.select("block", score, F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("_p").alias("c")), F.struct(F.lit(0).alias("y"), F.col("_q").alias("c")))).alias("_e"))
    drawn = each.join(F.broadcast(draws), "block").select("resample", score, "_e.y", (F.col("_e.c") * F.col("m")).alias("w"))  # blocks times resamples
    a = auroc_by(drawn, ["resample"], score, "y", F.col("w")).select("resample", "auroc")
    b = average_precision_by(drawn, ["resample"], score, "y", F.col("w"))
    return a.join(b, "resample")


def rmse_log(rows: DataFrame, prediction: str, truth: str) -> DataFrame:
    r = F.log1p(prediction) - F.log1p(truth)
    return rows.agg(F.sqrt(F.avg(r * r)).alias("rmse"))


def midranks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`rows` with `<column>_rank`, equal values sharing the middle of their places."""
    out = rows
    for c in columns:
        counts = running_sums(rows.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n")), "_v", {"_upto": "_n"})
        ranks = counts.select("_v", (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(f"{c}_rank"))
        out = out.join(ranks, F.col(c).eqNullSafe(F.col("_v"))).drop("_v")
    return out


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    return midranks(rows, [a, b]).agg(F.corr(f"{a}_rank", f"{b}_rank").alias("spearman"))


def icc(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row (icc): one-way intraclass correlation with the mean group size."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = per.agg(F.count("*").alias("g"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = (F.col("s2") - F.col("s") * F.col("s") / F.col("N")) / (F.col("g") - 1)
    within = F.col("within") / (F.col("N") - F.col("g"))
    size = (F.col("N") - F.col("n2") / F.col("N")) / (F.col("g") - 1)
    return total.select(((between - within) / (between + (size - 1) * within)).alias("icc"))


def pairwise_corr(rows: DataFrame, series: str, point: str, value: str, blocks: int = 1) -> DataFrame:
    """(a, b, corr) of all pairs of series, a < b, over all points; a series has one value a point, 0 where it has none.

    A Gram matrix by blocks of series: a point's values meet within a pair of
    blocks, so no array holds more than two blocks' series and points are never
    joined with each other. Constant series give null.
    """
    first, second = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.col("_own")
    n = rows.select(point).distinct().agg(F.count("*").alias("_n"))
    sums = rows.groupBy(series).agg(F.sum(value).cast("double").alias("_s"), F.sum(F.col(value).cast("double") * F.col(value)).alias("_q"))
    own = rows.where(F.col(value) != 0).select(point, F.struct(F.col(series).alias("s"), F.col(value).cast("double").alias("v")).alias("_x"), F.pmod(F.xxhash64(series), F.lit(blocks)).alias("_own"), first.alias("_other"))
    cell = own.select(point, "_x", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), second)
    met = cell.groupBy(point, "_i", "_j").agg(
        F.collect_list(F.when(F.col("_own") == F.col("_i"), F.col("_x"))).alias("_l"), F.collect_list(F.when(F.col("_own") == F.col("_j"), F.col("_x"))).alias("_r")
    )
    pairs = met.select("_i", "_j", F.explode("_l").alias("x"), "_r").select("_i", "_j", "x", F.explode("_r").alias("y"))
    # a pair of different blocks meets once, within a block both ways round
    pairs = pairs.where((F.col("_i") != F.col("_j")) | (F.col("x.s") < F.col("y.s")))
    gram = pairs.groupBy(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("_g"))
    one, two = sums.withColumnsRenamed({series: "a", "_s": "_sa", "_q": "_qa"}), sums.withColumnsRenamed({series: "b", "_s": "_sb", "_q": "_qb"})
    # pairs without a common point have no cell
    every = one.join(two, F.col("a") < F.col("b")).join(gram, ["a", "b"], "left").crossJoin(F.broadcast(n))  # one row; the pairs are the result
    size = F.col("_n").cast("double")
    spread = lambda q, t: size * F.col(q) - F.col(t) * F.col(t)
    return every.select("a", "b", F.try_divide(size * F.coalesce("_g", F.lit(0.0)) - F.col("_sa") * F.col("_sb"), F.sqrt(spread("_qa", "_sa") * spread("_qb", "_sb"))).alias("corr"))


def peak_scores(rows: DataFrame, series: str, truth: str, forecast: str, p: float) -> DataFrame:
    """Per series how well a forecast finds the peaks: those above the series' own quantile."""
    cut = rows.groupBy(series).agg(F.percentile(truth, F.lit(p)).alias("_cut"))
    both = rows.join(cut, series)
    hit, said, real = (F.col(forecast) > F.col("_cut")) & (F.col(truth) > F.col("_cut")), F.col(forecast) > F.col("_cut"), F.col(truth) > F.col("_cut")
    counts = both.groupBy(series).agg(F.count_if(hit).alias("hits"), F.count_if(said).alias("said"), F.count_if(real).alias("peaks"))
    return counts.select(series, "hits", "said", "peaks", F.try_divide(2 * F.col("hits"), F.col("said") + F.col("peaks")).alias("f1"))


def time_weighted(levels: DataFrame, by: Sequence[str], p: float) -> DataFrame:
    """Mean, quantile and maximum of a step function, weighed by time. levels: from_us, to_us, level."""
    per = levels.groupBy(*by, "level").agg(F.sum(F.col("to_us") - F.col("from_us")).alias("us"))
    along = Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.sum("us").over(Window.partitionBy(*by))
    rows = per.withColumns({"_c": F.sum("us").over(along), "_t": whole})
    reached = F.when(F.col("_c") >= F.lit(p) * F.col("_t"), F.col("level"))
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col("level") * F.col("us")), F.sum("us")).alias("mean_level"), F.min(reached).alias("quantile_level"), F.max("level").alias("max_level"))
