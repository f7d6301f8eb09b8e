"""Overlays, parameter search, bootstrap, and visibility audits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clock import keyed_bits
from .metrics import running_sums

HOUR, DAY, WEEK = 3_600_000_000, 86_400_000_000, 604_800_000_000


# ---------------------------------------------------------------- overlays
def superpose(jobs: DataFrame, entries: DataFrame, term: str) -> DataFrame:
    """Copies of terms shifted by whole weeks: entries (copy, term, shift_weeks) times their jobs, ranked."""
    copies = jobs.join(F.broadcast(entries), term)
    shifted = copies.withColumn("arrival_us", F.col("arrival_us") + F.col("shift_weeks") * F.lit(WEEK))
    return shifted


def rebased(jobs: DataFrame, by: Sequence[str]) -> DataFrame:
    """`jobs` with the whole days before each trace's first arrival taken off."""
    first = F.min("arrival_us").over(Window.partitionBy(*by))
    return jobs.withColumn("arrival_us", F.col("arrival_us") - F.floor(first / DAY) * DAY)


def entries(spark: SparkSession, terms: Sequence, copies: int, weeks: int, seed: int = 0) -> DataFrame:
    """A draw of shifts, copy by copy, so that fewer copies are a prefix of more."""
    rng = np.random.default_rng(seed)
    rows = [(c, t, int(rng.integers(weeks))) for c in range(copies) for t in terms]
    return spark.createDataFrame(rows, "copy int, term string, shift_weeks int")


def busy_hour(jobs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, busy_us): work that arrives in the busiest whole hour."""
    per = jobs.groupBy(*by, F.floor(F.col("arrival_us") / HOUR).alias("_h")).agg(F.sum("work_us").alias("_w"))
    return per.groupBy(*by).agg(F.max("_w").alias("busy_us"))


def assembled(superposed: DataFrame, by: Sequence[str], loads: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Whole overlays: per trace the jobs in arrival order with rank, calendar week, labels, and servers for each load.

    Weeks count from the first Monday of the clock; arrivals lose the whole
    days before the trace after that. `servers` holds a number per load, from
    the busiest hour.
    """
    keys = {c: f"_k{i}" for i, c in enumerate(by)}
    same = lambda *more: [*(F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()), *more]
    named = [F.col(c).alias(k) for c, k in keys.items()]
    # a trace is ranked within instants, and instants by running sums, so that no task sorts a whole trace
    instants = superposed.groupBy(*by, "arrival_us").agg(F.count("*").alias("_here"))
    upto = running_sums(instants, "arrival_us", {"_upto": "_here"}, by=by).select(*named, F.col("arrival_us").alias("_at"), (F.col("_upto") - F.col("_here")).alias("_before"))
    within = Window.partitionBy(*by, "arrival_us").orderBy("job_id")
    ranked = superposed.withColumn("_place", F.row_number().over(within)).join(upto, same(F.col("arrival_us") == F.col("_at"))).drop(*keys.values())
    levels = busy_hour(superposed, by).select(*by, "busy_us", F.array(*(servers(F.col("busy_us"), x) for x in loads)).alias("servers"))
    first = superposed.groupBy(*by).agg(F.min("arrival_us").alias("_first"))
    traces = levels.join(first, list(by)).select(*named, "busy_us", "servers", "_first")
    out = ranked.join(F.broadcast(traces), same())  # a row per trace
    return out.select(
        *by, "job_id", (F.col("_before") + F.col("_place") - 1).cast("long").alias("rank"), (F.col("arrival_us") - F.floor(F.col("_first") / DAY) * DAY).alias("arrival_us"), "work_us",
        F.floor((F.col("arrival_us") - 4 * DAY) / WEEK).alias("calendar_week"), *labels, "busy_us", "servers",
    )


def copies_probe(jobs: DataFrame, shifts: DataFrame, by: str) -> DataFrame:
    """(copies, busy_us) for 1, 2, ... copies, from hour histograms: jobs are never multiplied.

    shifts: (copy, by, shift_hours).
    """
    histogram = jobs.groupBy(by, F.floor(F.col("arrival_us") / HOUR).alias("h")).agg(F.sum("work_us").alias("w"))
    moved = histogram.join(F.broadcast(shifts), by).groupBy("copy", (F.col("h") + F.col("shift_hours")).alias("h")).agg(F.sum("w").alias("w"))
    upto = Window.partitionBy("h").orderBy("copy").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = moved.withColumn("total", F.sum("w").over(upto))
    best = running.groupBy("copy").agg(F.max("total").alias("_m"))
    along = Window.orderBy("copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return best.select((F.col("copy") + 1).alias("copies"), F.max("_m").over(along).alias("busy_us"))


def servers(busy_us: Column, load: float) -> Column:
    """How many servers keep the busiest hour at a load, half up, at least one."""
    return F.greatest(F.lit(1), F.floor(busy_us.cast("double") / F.lit(float(HOUR)) / F.lit(load) + F.lit(0.5))).cast("int")


# ---------------------------------------------------------------- search
def log_spaced(low: float, high: float, n: int) -> list[float]:
    return [round(low * (high / low) ** (i / (n - 1)), 6) for i in range(n)] if n > 1 else [low]


def grid(spark: SparkSession, b0_s: Sequence[float], gam_s: Sequence[float], eta: Sequence[float], promise_s: Sequence[float]) -> DataFrame:
    """Grid points with a key under which two points give the same schedule: a full budget makes the rest idle."""
    points = spark.range(0, 1, 1, 1)  # one partition: a product of tables would have the product of their partitions
    for name, xs in (("b0_s", b0_s), ("gam_s", gam_s), ("eta", eta), ("promise_s", promise_s)):
        points = points.withColumn(name, F.explode(F.array(*(F.lit(float(x)) for x in xs)).cast("array<double>")))
    points = points.drop("id")
    full = F.col("b0_s") >= F.col("promise_s")
    key = F.when(full, F.concat_ws("|", F.lit("full"), F.col("promise_s").cast("string"))).otherwise(F.concat_ws("|", *(F.col(c).cast("string") for c in ("b0_s", "gam_s", "eta", "promise_s"))))
    return points.withColumn("schedule_key", key)


def worst_cells(cells: DataFrame, config: Sequence[str]) -> DataFrame:
    """(config, worst_gap, worst_harm, cells): the least gap and the most harm over a configuration's cells."""
    return cells.groupBy(*config).agg(F.min("gap").alias("worst_gap"), F.max("harm").alias("worst_harm"), F.count("*").alias("cells"))


def choose(worst: DataFrame, by: Sequence[str], most_harm: float, tie: Sequence[Column]) -> DataFrame:
    """Per `by` the feasible configuration of the largest worst gap, ties in the order given."""
    order = Window.partitionBy(*by).orderBy(F.col("worst_gap").desc(), F.col("worst_harm").asc(), *tie)
    return worst.where(F.col("worst_harm") <= most_harm).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def frontier(worst: DataFrame, by: Sequence[str]) -> DataFrame:
    """Configurations that no other one beats in both gap and harm."""
    before = Window.partitionBy(*by).orderBy("worst_harm", F.col("worst_gap").desc()).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("worst_gap").over(before)
    return worst.withColumn("_b", best).where(F.col("_b").isNull() | (F.col("worst_gap") > F.col("_b"))).drop("_b")


# ---------------------------------------------------------------- bootstrap
def draws_of(blocks: int, resamples: int, seed: int = 0) -> list[list[int]]:
    """How often each resample draws each block; resample 0 is the sample itself."""
    rng = np.random.default_rng(seed)
    return [[1] * blocks, *(rng.multinomial(blocks, np.full(blocks, 1 / blocks)).tolist() for _ in range(resamples))]


def multiplicities(spark: SparkSession, blocks: Sequence[int], resamples: int, seed: int = 0) -> DataFrame:
    """(resample, block, m): how often a resample draws a block; resample 0 is the sample itself."""
    drawn = draws_of(len(blocks), resamples, seed)
    return spark.createDataFrame([(r, int(b), m) for r, row in enumerate(drawn) for b, m in zip(blocks, row, strict=True)], "resample int, block long, m int")


def resampled_mean(rows: DataFrame, block: str, value: str, by: Sequence[str], draws: DataFrame) -> DataFrame:
    """(resample, by, mean): from block sums alone."""
    sums = rows.groupBy(*by, F.col(block).alias("block")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return sums.join(draws, "block").groupBy("resample", *by).agg(F.try_divide(F.sum(F.col("m") * F.col("_s")), F.sum(F.col("m") * F.col("_n"))).alias("mean"))


def resampled_quantile(rows: DataFrame, block: str, value: str, by: Sequence[str], p: float, draws: DataFrame) -> DataFrame:
    """(resample, by, quantile): exact, with values counted as often as drawn and no row copied.

    Equal values of a block are counted first, so what meets the draws is a histogram.
    """
    counts = rows.groupBy(*by, F.col(block).alias("block"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    weighed = counts.join(draws, "block").groupBy("resample", *by, "_v").agg(F.sum(F.col("m") * F.col("_n")).alias("_f"))
    return weighed.where("_f > 0").groupBy("resample", *by).agg(F.percentile("_v", F.lit(p), F.col("_f")).alias("quantile"))


def cluster_bootstrap(jobs: DataFrame, cluster: str, draws: DataFrame, by: Sequence[str], k: int, rules: Sequence, p: float, weeks: int) -> DataFrame:
    """(resample, policy, quantile of waits) where clusters are drawn, overlaid anew and replayed.

    A cluster drawn m times comes in m copies, each shifted by whole weeks (0
    to `weeks` - 1) by a keyed draw. Resamples are traces of one replay, so
    they run side by side. Copies of a job are numbered by its id times 100.
    """
    from .metrics import exact_quantile
    from .replay import replay

    drawn = jobs.join(draws, F.col(cluster) == F.col("block")).where("m > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    shift = keyed_bits(F.col("resample"), F.col(cluster), F.col("_copy")) % weeks
    rows = drawn.withColumns({"arrival_us": F.col("arrival_us") + shift * WEEK, "job_id": F.col("job_id") * 100 + F.col("_copy")})
    waits = replay(rows, ["resample", *by], k, rules)
    return exact_quantile(waits, ["resample", "policy"], "wait_us", p, "quantile")


def interval(replicates: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """(by, estimate, low, high): resample 0 and the percentile interval of the others."""
    tail = (1 - level) / 2
    drawn = F.when(F.col("resample") > 0, F.col(value))
    return replicates.groupBy(*by).agg(
        F.max(F.when(F.col("resample") == 0, F.col(value))).alias("estimate"),
        F.percentile(drawn, F.lit(tail)).alias("low"),
        F.percentile(drawn, F.lit(1 - tail)).alias("high"),
    )


def paired(replicates: DataFrame, by: Sequence[str], policy: str, a: str, b: str, value: str) -> DataFrame:
    """(resample, by, difference) of two policies on the same draws."""
    of = lambda name: F.max(F.when(F.col(policy) == name, F.col(value)))
    return replicates.groupBy("resample", *by).agg((of(a) - of(b)).alias("difference"))


def smallest_pools(jobs: DataFrame, by: Sequence[str], p: float, target_us: int) -> DataFrame:
    """(by, servers): the least number of servers under which the p-quantile of waits is within the target.

    Doubling, then bisection, of all traces side by side; each round replays
    them with their own number of servers. With a server per job none waits, so
    it ends, after about twice the binary digits of the answer.
    """
    from ..operators import replay

    state = jobs.select(*by).distinct().withColumns({"low": F.lit(0), "high": F.lit(1), "met": F.lit(False)}).checkpoint()
    while state.where("not met or high - low > 1").limit(1).count():
        tried = F.when(F.col("met"), F.floor((F.col("low") + F.col("high")) / 2).cast("int")).otherwise(F.col("high"))
        open_ = state.where("not met or high - low > 1").select(*by, tried.alias("k"))
        waits = replay.fcfs(jobs.join(open_, list(by)), by, "k").groupBy(*by).agg((F.percentile("wait_us", F.lit(p)) <= target_us).alias("_ok"))
        both = state.join(waits, list(by), "left").withColumn("_k", tried)
        done = F.col("_ok").isNull()
        state = both.select(
            *by,
            F.when(done, F.col("low")).when(F.col("_ok"), F.col("low")).otherwise(F.col("_k")).alias("low"),
            F.when(done, F.col("high")).when(F.col("_ok"), F.col("_k")).when(F.col("met"), F.col("high")).otherwise(F.col("high") * 2).alias("high"),
            F.coalesce(F.col("met") | F.col("_ok"), F.col("met")).alias("met"),
        ).checkpoint()
    return state.select(*by, F.col("high").alias("servers"))


def first_codes(rows: DataFrame, column: str, position: str) -> DataFrame:
    """(column, code): dense codes from 0 by first appearance along `position`, whose values are unique."""
    from .metrics import running_sums

    firsts = rows.groupBy(column).agg(F.min(position).alias("_first")).withColumn("_one", F.lit(1))
    return running_sums(firsts, "_first", {"_upto": "_one"}).select(column, (F.col("_upto") - 1).cast("long").alias("code"))


def learned_score(rows: DataFrame, score: str, weights: dict[str, float]) -> DataFrame:
    """`rows` with `learned`: the log of the score plus weighted features, each scaled by its mean and deviation over all rows.

    A missing feature counts as the mean; a constant one is an error.
    """
    moments = rows.agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(weights)), *(F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(weights))).first()
    total = F.log(score)
    for i, (c, w) in enumerate(weights.items()):
        if not moments[f"_s{i}"]:
            raise ValueError(f"{c} is constant")
        total = total + F.lit(float(w)) * F.coalesce((F.col(c) - F.lit(moments[f"_m{i}"])) / F.lit(moments[f"_s{i}"]), F.lit(0.0))
    return rows.withColumn("learned", total)


def audited(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], one_of: int, tolerance: float = 0.0) -> DataFrame:
    """compare_tables() on the rows whose keys' digest falls on one of so many parts: a check by an independent route."""
    part = F.pmod(keyed_bits(*(F.col(c) for c in key)), F.lit(one_of)) == 0
    return compare_tables(a.where(part), b.where(part), key, columns, tolerance)


# ---------------------------------------------------------------- visibility
def premature_counts(jobs: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """(job_id, premature): results that the source's clock shows a job on arrival but the replay has not finished.

    A result counts if it shares a key; `keys` are taken by inclusion and
    exclusion, the last one being the pair of all others. `jobs` has
    arrival_us, available_us and done_us (in the replay).
    """
    out = None
    for i, key in enumerate(keys):
        sign = -1 if i == len(keys) - 1 and len(keys) > 1 else 1
        legs = [
            jobs.select(*key, F.col("available_us").alias("at_us"), F.lit(0).alias("kind"), "job_id", F.lit(1).alias("v")),
            jobs.select(*key, F.col("done_us").alias("at_us"), F.lit(0).alias("kind"), "job_id", F.lit(-1).alias("v")),
            jobs.select(*key, F.col("arrival_us").alias("at_us"), F.lit(1).alias("kind"), "job_id", F.lit(0).alias("v")),
        ]
        stream = legs[0].unionAll(legs[1]).unionAll(legs[2])
        own = stream.withColumn("_n", F.sum("v").over(Window.partitionBy(*key).orderBy("at_us", "kind", "job_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        counts = own.where("kind = 1").select("job_id", (F.col("_n") * sign).alias("_n"))
        out = counts if out is None else out.unionAll(counts)
    return out.groupBy("job_id").agg(F.sum("_n").alias("premature"))


def lag_certificate(waits: DataFrame, by: Sequence[str], lag_us: int) -> DataFrame:
    """(by, jobs, violations, share, worst_us): jobs that wait longer than the lag their features allow for."""
    late = F.col("wait_us") > lag_us
    return waits.groupBy(*by).agg(F.count("*").alias("jobs"), F.count_if(late).alias("violations"), F.avg(late.cast("double")).alias("share"), F.max(F.when(late, F.col("wait_us") - lag_us)).alias("worst_us"))


def signatures(jobs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(job_id, signature): a sum of random labels of all results of a key readable on arrival.

    Equal signatures stand for equal sets, so a change of what a job sees
    shows without comparing sets.
    """
    label = keyed_bits(F.col("job_id")).cast("decimal(38,0)")
    legs = jobs.select(*by, F.col("available_us").alias("at_us"), F.lit(0).alias("kind"), "job_id", label.alias("v")).unionAll(
        jobs.select(*by, F.col("arrival_us").alias("at_us"), F.lit(1).alias("kind"), "job_id", F.lit(0).cast("decimal(38,0)").alias("v"))
    )
    over = Window.partitionBy(*by).orderBy("at_us", "kind", "job_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return legs.withColumn("signature", F.sum("v").over(over)).where("kind = 1").select("job_id", "signature")


def compare_tables(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """One row per column: rows that differ, and rows of one side only. Keys are unique in each."""
    left = a.select(*key, F.struct(*columns).alias("_a"))
    both = left.join(b.select(*key, F.struct(*columns).alias("_b")), list(key), "full")
    alone = both.select(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), *(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~_same(F.col(f"_a.{c}"), F.col(f"_b.{c}"), tolerance)).alias(f"d_{c}") for c in columns
    ))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("different")) for c in columns))
    return alone.select(F.explode(pairs).alias("p"), "only_a", "only_b").select("p.column", "p.different", "only_a", "only_b")


def _same(x: Column, y: Column, tolerance: float) -> Column:
    return x.eqNullSafe(y) if not tolerance else x.eqNullSafe(y) | (F.abs(x - y) <= tolerance)


# ---------------------------------------------------------------- more of overlays, scores and intervals
def single_server_pool(histogram: DataFrame, term: str, hour: str, work: str, capacity_us: int) -> list:
    """Terms whose summed busiest hour stays within one server: each step adds the one that leaves the busiest hour least.

    Each step is a grouped sum over the terms not yet taken, with the hours of
    the chosen ones added; only the name of the best term comes back, so that
    the histogram may have any size.
    """
    chosen: list = []
    base = histogram.groupBy(F.col(term).alias("_t"), F.col(hour).alias("_h")).agg(F.sum(work).alias("_w"))
    while True:  # until no term fits
        taken = F.col("_t").isin(chosen) if chosen else F.lit(False)
        load = base.where(taken).groupBy(F.col("_h").alias("_k")).agg(F.sum("_w").alias("_l"))
        # a term's busiest hour is one of its own, or the busiest of those chosen
        own = base.where(~taken).join(load, F.col("_h") == F.col("_k"), "left").groupBy("_t").agg(F.max(F.col("_w") + F.coalesce("_l", F.lit(0))).alias("_p"))
        top = load.agg(F.coalesce(F.max("_l"), F.lit(0)).alias("_m"))
        peak = own.crossJoin(F.broadcast(top)).select("_t", F.greatest("_p", "_m").alias("_p"))  # one row
        best = peak.where(F.col("_p") <= capacity_us).orderBy("_p", "_t").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["_t"])
    return chosen


def simultaneous_band(replicates: DataFrame, at: str, value: str, level: float = 0.95) -> DataFrame:
    """(at, estimate, low, high) that hold together: the quantile of the largest standardised deviation."""
    drawn = F.when(F.col("resample") > 0, F.col(value))
    centre = replicates.groupBy(at).agg(F.max(F.when(F.col("resample") == 0, F.col(value))).alias("estimate"), F.stddev_samp(drawn).alias("sd"))
    both = replicates.where("resample > 0").join(F.broadcast(centre), at)  # a row per point of the curve
    worst = both.groupBy("resample").agg(F.max(F.abs(F.try_divide(F.col(value) - F.col("estimate"), F.col("sd")))).alias("z"))
    width = worst.agg(F.percentile("z", F.lit(level)).alias("z"))
    return centre.crossJoin(F.broadcast(width)).select(at, "estimate", (F.col("estimate") - F.col("z") * F.col("sd")).alias("low"), (F.col("estimate") + F.col("z") * F.col("sd")).alias("high"))


def noisy(score: Column, sigma: float, *keys: str) -> Column:
    """A score times lognormal noise, one draw per source row, from its keys alone."""
    u = lambda salt: (keyed_bits(F.lit(salt), *(F.col(k) for k in keys)) + F.lit(0.5)) * F.lit(2.0**-52)
    normal = F.sqrt(F.lit(-2.0) * F.log(u(1))) * F.cos(F.lit(2 * 3.141592653589793) * u(2))
    return score * F.exp(F.lit(sigma) * normal)


def two_class(score: Column, threshold: float) -> Column:
    return F.when(score > threshold, F.lit(1.0)).otherwise(F.lit(0.0))


def longest_share(rows: DataFrame, value: str, tie: str, share: float) -> DataFrame:
    """`rows` with `longest`: the largest `share` of them, at least one; among equal values those with the smaller `tie`.

    Places of values come from running sums by ranges, so no task sorts all rows.
    """
    from .metrics import running_sums

    most = F.greatest(F.floor(F.sum("_n") * F.lit(share)), F.lit(1)).alias("_most")
    per = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    places = running_sums(per, "_v", {"_upto": "_n"}, descending=True).crossJoin(F.broadcast(per.agg(most)))  # one row
    within = F.row_number().over(Window.partitionBy(value).orderBy(tie))
    joined = rows.join(places, F.col(value) == F.col("_v"), "left").withColumn("_i", within)
    longest = F.coalesce(F.col("_upto") - F.col("_n") + F.col("_i") <= F.col("_most"), F.lit(False))
    return joined.withColumn("longest", longest).drop("_v", "_n", "_upto", "_most", "_i")


def repaired(rows: DataFrame, score: str, truth: str, share: float) -> DataFrame:
    """`rows` with the truth in place of the score where the error is among the largest `share`."""
    error = F.abs(F.col(score) - F.col(truth))
    cut = rows.agg(F.percentile(error, F.lit(1 - share)).alias("_cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn(score, F.when(error > F.col("_cut"), F.col(truth)).otherwise(F.col(score))).drop("_cut")  # one row
