"""Joins and windows along time: as-of, sessions, step functions, interval overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, take: Sequence[str], direction: str = "backward", strict: bool = False, tolerance: int | None = None, tie: str | None = None) -> DataFrame:
    """`left` with the columns `take` of the nearest row of `right` with the same keys.

    Both tables go into one stream per key, sorted by time, so there is a
    shuffle and a sort and no theta join. `direction` is backward, forward or
    nearest (backward at equal distance); with `strict` equal times don't
    count. `tie` orders right rows of one time, the last one counts backward
    and the first one forward. Taken columns are null where nothing is near.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("direction must be backward, forward or nearest")
    payload = F.struct(F.col(right_time).alias("_t"), *(F.col(c).alias(c) for c in take))
    order_tie = F.col(tie).cast("string") if tie else F.lit(None).cast("string")
    one = left.select(*by, F.col(left_time).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias("_tie"), F.struct(*left.columns).alias("_left"))
    two = right.select(*by, F.col(right_time).alias("_at"), F.lit(1).alias("_side"), order_tie.alias("_tie"), payload.alias("_right"))
    stream = one.unionByName(two, allowMissingColumns=True)
    # at equal times right rows come first for backward, unless strict; and last for forward
    late = F.lit(-1) if strict else F.lit(1)
    back = Window.partitionBy(*by).orderBy("_at", late * -F.col("_side"), "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what comes next is what came last in the reverse order: a growing frame, where one that shrinks is built anew for each row
    ahead = Window.partitionBy(*by).orderBy(F.desc("_at"), (late * F.col("_side")).desc(), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found: dict[str, Column] = {}
    if direction != "forward":
        found["_back"] = F.last("_right", ignorenulls=True).over(back)
    if direction != "backward":
        found["_ahead"] = F.last("_right", ignorenulls=True).over(ahead)
    rows = stream.withColumns(found).where("_side = 0")
    if direction == "nearest":
        gap_back, gap_ahead = F.col("_at") - F.col("_back._t"), F.col("_ahead._t") - F.col("_at")
        best = F.when(gap_ahead.isNull() | (gap_back <= gap_ahead), F.col("_back")).otherwise(F.col("_ahead"))
    else:
        best = F.col("_back" if direction == "backward" else "_ahead")
    if tolerance is not None:
        best = F.when(F.abs(F.col("_at") - best["_t"]) <= tolerance, best)
    rows = rows.withColumn("_best", best)
    return rows.select("_left.*", F.col("_best._t").alias(f"{right_time}_matched"), *(F.col(f"_best.{c}").alias(c) for c in take))


def sessions(rows: DataFrame, by: Sequence[str], start: str, end: str, gap: int, tie: str) -> DataFrame:
    """Merged sessions (by, start, end, n): intervals at most `gap` apart belong together."""
    order = Window.partitionBy(*by).orderBy(start, end, tie)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    numbered = rows.withColumn("_new", new).withColumn("_session", F.sum("_new").over(order))
    return numbered.groupBy(*by, "_session").agg(F.min(start).alias("start_us"), F.max(end).alias("end_us"), F.count("*").alias("n")).drop("_session")


def levels(rows: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """The step function of how many intervals are open: (by, from_us, to_us, level); closing comes before opening."""
    steps = rows.select(*by, F.col(start).alias("at"), F.lit(1).alias("d")).unionAll(rows.select(*by, F.col(end).alias("at"), F.lit(-1).alias("d")))
    net = steps.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*by).orderBy("at")
    level = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return net.select(*by, F.col("at").alias("from_us"), F.lead("at").over(order).alias("to_us"), level.alias("level")).where("to_us is not null")


def overlap(a: DataFrame, b: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Time during which intervals of both tables are open, per key, by a sweep in place of a join."""
    steps = None
    for df, which in ((a, "a"), (b, "b")):
        for column, d in ((start, 1), (end, -1)):
            part = df.select(*by, F.col(column).alias("at"), F.lit(d if which == "a" else 0).alias("da"), F.lit(d if which == "b" else 0).alias("db"))
            steps = part if steps is None else steps.unionAll(part)
    net = steps.groupBy(*by, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(*by).orderBy("at")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = net.select(*by, "at", F.lead("at").over(order).alias("to"), F.sum("da").over(up_to).alias("la"), F.sum("db").over(up_to).alias("lb"))
    return swept.groupBy(*by).agg(F.sum(F.when((F.col("la") > 0) & (F.col("lb") > 0), F.col("to") - F.col("at")).otherwise(0)).alias("both_us"))


def within(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, end: str, step: int, parts: int = 1) -> DataFrame:
    """`points` with every interval (the other columns of `intervals`) of the same keys that holds them, ends included.

    An interval stands once for each step of time that it touches and a point
    in its own step only, so they meet as equals and a pair is found once.
    With `parts` the points of a key and step are dealt into so many, each
    with the intervals of that step: for keys that hold much of the table.
    """
    cell = lambda c: F.floor(F.col(c) / step)
    names = {c: f"_k{i}" for i, c in enumerate(by)}
    salt = F.pmod(F.xxhash64(*points.columns), F.lit(parts)).cast("int")
    left = points.withColumns({"_step": cell(at), "_part": salt})
    right = intervals.where(F.col(start) <= F.col(end)).withColumnsRenamed(names).withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    right = right.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    on = [F.col("_step") == F.col("_cell"), F.col("_part") == F.col("_deal"), *(F.col(c) == F.col(k) for c, k in names.items())]
    return left.join(right, on).where(F.col(at).between(F.col(start), F.col(end))).drop("_step", "_part", "_cell", "_deal", *names.values())


def interpolated(rows: DataFrame, by: Sequence[str], x: str, y: str, at: DataFrame, at_x: str) -> DataFrame:
    """`at` with y interpolated linearly between the anchors of `rows`, whose y never falls; flat outside."""
    anchors = rows.groupBy(*by, x).agg(F.min(y).alias(y))
    anchors = anchors.withColumn(y, F.max(y).over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    low = asof(at, anchors.withColumnsRenamed({x: "_x0", y: "_y0"}), by, at_x, "_x0", ["_y0"])
    both = asof(low, anchors.withColumnsRenamed({x: "_x1", y: "_y1"}), by, at_x, "_x1", ["_y1"], direction="forward")
    x0, x1 = F.col("_x0_matched"), F.col("_x1_matched")
    share = (F.col(at_x) - x0).cast("double") / (x1 - x0).cast("double")
    value = F.when(x0.isNull(), F.col("_y1").cast("double")).when(x1.isNull() | (x0 == x1), F.col("_y0").cast("double")).otherwise(
        F.col("_y0") + (F.col("_y1") - F.col("_y0")).cast("double") * share
    )
    return both.select(*at.columns, value.alias(y))
