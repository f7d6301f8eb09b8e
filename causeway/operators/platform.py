"""History of a judging platform by record number: what was judged more than `lag` records ago.

A record reads the judged results of its problem, user, contest, language and
tags, of some pairs of these, and how many different problems its user has
seen. Records are ranked by id; a result of rank j is read from rank j + lag + 1
on, so results and reads are one stream in order of rank. Keys that contain
the user share one shuffle; problems, contests and tags, of which there may be
few, go by stretches of ranks. Tags are exploded, and what a record's tags hold
is summed up again per record.

Statistics without a result are null, counts 0. A record without contest or
tags has counts of 0 there. Costs are whole numbers, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .metrics import running_sums
from .stretches import STRETCH, running

_RESULT = "kind = 3"
_ORDER = ("at", "kind", "id")


def ranked(rows: DataFrame) -> DataFrame:
    """`rows` with `rank`, from 0 in the order of their ids, which are unique."""
    places = running_sums(rows.select("id").withColumn("_one", F.lit(1)), "id", {"_upto": "_one"})
    return rows.join(places.select("id", (F.col("_upto") - 1).cast("long").alias("rank")), "id")


def _stream(rows: DataFrame, lag: int, carry: list[str]) -> DataFrame:
    results = rows.where("judged").select((F.col("rank") + lag).alias("at"), F.lit(3).alias("kind"), "id", *carry)
    return results.unionByName(rows.select(F.col("rank").alias("at"), F.lit(1).alias("kind"), "id", *carry))


def _over(*by: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _of(value: Column) -> Column:
    return F.when(F.expr(_RESULT), value)


def _state(prefix: str, over: WindowSpec, *what: str) -> dict[str, Column]:
    """Running n and, as named, total, square, top, last and sums of columns."""
    cost = F.col("cost")
    kinds = {
        "total": F.sum(_of(cost)), "square": F.sum(_of(cost.cast("decimal(38,0)") * cost)), "top": F.max(_of(cost)), "last": F.last(_of(cost), ignorenulls=True),
        "last_ok": F.last(_of(F.col("accepted")), ignorenulls=True), "last_limit": F.last(_of(F.col("over_time")), ignorenulls=True),
    }
    out = {f"{prefix}_n": F.count(_of(F.lit(1))).over(over)}
    for c in what:
        out[f"{prefix}_{c}"] = (kinds[c] if c in kinds else F.sum(_of(F.col(c)))).over(over)
    return out


def _valued(stream: DataFrame, size: int, *sums: str) -> DataFrame:
    """`stream` with stretches of `size` ranks, and with what a result adds in columns that are null on reads; states so far are null on results."""
    cost = F.col("cost")
    values = {"n": F.lit(1), "total": cost, "square": cost.cast("decimal(38,0)") * cost, "top": cost, "last": cost, **{c: F.col(c) for c in sums}}
    known = [c for c in stream.columns if c.partition("_")[0] in ("u", "up", "cu", "ut")]
    out = stream.withColumns({c: F.when(F.col("kind") == 1, F.col(c)) for c in known} | {c: _of(x) for c, x in values.items()})
    return out.withColumn("stretch", F.floor(F.col("at") / max(size, 1)).cast("int")).drop("cost")


def _mean(prefix: str, c: str) -> Column:
    return F.when(F.col(f"{prefix}_n") > 0, F.col(f"{prefix}_{c}").cast("double") / F.col(f"{prefix}_n"))


def _deviation(prefix: str) -> Column:
    mean = _mean(prefix, "total")
    return F.when(F.col(f"{prefix}_n") > 0, F.sqrt(F.greatest(_mean(prefix, "square") - mean * mean, F.lit(0.0))))


def platform_history(rows: DataFrame, lag: int, size: int = STRETCH) -> DataFrame:
    """A row per record. rows: id, problem, user, contest, lang, tags (array), cost, memory, length, heavy, over_time, accepted (numbers), judged.

    A stretch of ranks has `size` rows of the stream.
    """
    sums = ("heavy", "over_time", "accepted", "length")
    own = ranked(rows)
    stream = _stream(own, lag, ["problem", "user", "contest", "lang", "cost", "memory", *sums]).repartition("user")
    users = stream.withColumns(_state("up", _over("user", "problem"), "total", "top", "last", "last_ok", "last_limit")).withColumns(_state("cu", _over("user", "contest"), "total"))
    # a problem counts for its user with the first result there
    users = users.withColumn("fresh", F.when(F.expr(_RESULT) & (F.col("up_n") == 1), 1).otherwise(0))
    users = users.withColumns(_state("u", _over("user"), "total", "square", "top", "last", *sums, "fresh"))
    at = running(
        _valued(users.drop("user", "fresh"), size // 2, *sums, "memory"), _ORDER,
        {
            "p": (["problem"], ["n", "total", "square", "top", "last", *sums, "memory"]), "cp": (["problem", "contest"], ["n", "total"]),
            "pl": (["problem", "lang"], ["n", "total"]), "c": (["contest"], ["n", "total", "heavy"]),
        },
        {"n": "sum", "total": "sum", "square": "sum", "top": "max", "last": "last", **dict.fromkeys((*sums, "memory"), "sum")},
    ).where("kind = 1").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("p_n", "cp_n", "pl_n", "c_n")})
    tagged = _stream(own.select("id", "rank", "judged", "user", "cost", "heavy", F.explode("tags").alias("tag")), lag, ["tag", "user", "cost", "heavy"]).repartition("user")
    tagged = _valued(tagged.withColumns(_state("ut", _over("user", "tag"), "total")).drop("user"), size // 4, "heavy")
    tagged = running(tagged.drop("square", "top", "last"), _ORDER, {"t": (["tag"], ["n", "total", "heavy"])}, dict.fromkeys(("n", "total", "heavy"), "sum")).where("kind = 1")
    tags = tagged.groupBy(F.col("id").alias("_id")).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("t_n", "t_total", "t_heavy", "ut_n", "ut_total")))
    both = at.join(tags, F.col("id") == F.col("_id"), "left")
    inside = F.col("contest").isNotNull()
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        "id",
        *(x.alias(f"{p}_{n}") for p in ("p", "u") for n, x in (
            ("n", F.col(f"{p}_n")), ("mean", _mean(p, "total")), ("sd", _deviation(p)), ("max", F.col(f"{p}_top")), ("last", F.col(f"{p}_last")),
            ("heavy_rate", _mean(p, "heavy")), ("limit_rate", _mean(p, "over_time")), ("accept_rate", _mean(p, "accepted")), ("length_mean", _mean(p, "length")),
        )),
        _mean("p", "memory").alias("p_memory_mean"), F.coalesce("u_fresh", F.lit(0)).alias("u_problems"),
        "up_n", F.col("up_last").alias("up_last"), F.col("up_top").alias("up_max"), _mean("up", "total").alias("up_mean"), F.col("up_last_ok").alias("up_last_accepted"), F.col("up_last_limit").alias("up_last_limit"),
        *(F.when(inside, F.col(f"{p}_n")).otherwise(0).alias(f"{p}_n") for p in ("c", "cu", "cp")),
        *(F.when(inside, _mean(p, c)).alias(n) for p, c, n in (("c", "total", "c_mean"), ("c", "heavy", "c_heavy_rate"), ("cu", "total", "cu_mean"), ("cp", "total", "cp_mean"))),
        count("t_n").alias("tag_n"), _mean("t", "total").alias("tag_mean"), _mean("t", "heavy").alias("tag_heavy_rate"), count("ut_n").alias("utag_n"), _mean("ut", "total").alias("utag_mean"),
        F.col("pl_n").alias("plang_n"), _mean("pl", "total").alias("plang_mean"),
    )
