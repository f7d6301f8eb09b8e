"""The feature block and its sliding statistics against plain recomputation, with ties and zero lags."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import blocks, history

COLUMNS = "job_id long, user_key int, item_key int, assessment string, class_term string, arrival_us long, available_us long, work_us long, is_error int, heavy int, tests int, is_submission boolean"


def submissions(n, seed, quick=False):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 5]) * 1_000_000
        lag = rng.choice([0, 1, 3, 20]) * 1_000_000
        item = rng.randrange(4) if not quick else 0
        rows.append((i, rng.randrange(5), item, f"w|{item % 2}", f"c{rng.randrange(2)}", t, t + lag, rng.randrange(1, 9) * 700_000, int(rng.random() < 0.3), int(rng.random() < 0.2), rng.randrange(1, 9), rng.random() < 0.8))
    return rows


def quantile(values, p):
    values = sorted(values)
    return values[min(len(values) - 1, int(p * (len(values) - 1) + 0.5))] if values else None


def visible(rows, r):
    """Results that r may read, in the order in which they became readable."""
    seen = [x for x in rows if x[6] <= r[5] and not (x[6] == x[5] == r[5])]
    return sorted(seen, key=lambda x: (x[6], 3 if x[6] == x[5] else 0, x[0]))


def arrived(rows, r):
    return [x for x in rows if (x[5], x[0]) < (r[5], r[0]) and x[5] < r[5]]


def cost(x):
    return math.floor(math.log1p(x[7] / 1e6) * 1e6 + 0.5)


def plain_block(rows, low, high):
    out = {}

    def mean(v, unit=1.0):
        return sum(v) / len(v) / unit if v else None

    def sd(v):
        return math.sqrt(max(sum(x * x for x in v) / len(v) - (sum(v) / len(v)) ** 2, 0)) / 1e6 if v else None

    def tercile(seen):
        m = mean([cost(x) for x in seen], 1e6)
        return 1 if m is None else 0 if m < low else 1 if m < high else 2

    for r in rows:
        if not r[11]:
            continue
        seen = visible(rows, r)
        subs = [x for x in seen if x[11]]
        ex, us = [x for x in subs if x[2] == r[2]], [x for x in subs if x[1] == r[1]]
        before = [x for x in rows if x[5] < r[5]]
        sub_before = [x for x in before if x[11]]
        pair = [x for x in sub_before if x[1:3] == r[1:3]]
        last = max((x for x in ex if x[1] == r[1]), key=lambda x: (x[5], x[0]), default=None)
        prev = max((x for x in seen if x[1] == r[1]), key=lambda x: (x[5], x[0]), default=None)
        u_before = [x for x in before if x[1] == r[1]]

        def relations(item, assessment, r=r, subs=subs, us=us):
            alike, at = [], tercile(us)
            for x in subs:
                if x[2] == item:
                    # a result counts for the tercile that its user has with it
                    own = [y for y in subs if y[1] == x[1]]
                    own = own[: own.index(x) + 1]
                    if tercile(own) == at:
                        alike.append(x)
            rest = [x for x in subs if x[3] == assessment and x[2] != item]
            mates = [x for x in subs if x[2] == item and x[4] == r[4]]
            return [mean([cost(x) for x in alike], 1e6), mean([x[9] for x in alike]), mean([cost(x) for x in rest], 1e6), mean([x[9] for x in rest]), mean([cost(x) for x in mates], 1e6)]

        c, u = [cost(x) for x in ex], [cost(x) for x in us]
        scaled = lambda v: None if v is None else v / 1e6
        since = lambda xs: math.log1p((r[5] - max(x[5] for x in xs)) / 1e6) if xs else None
        out[r[0]] = {
            "ex_n": sum(x[2] == r[2] for x in sub_before), "ex_mean": mean(c, 1e6), "ex_sd": sd(c), "ex_p50": scaled(quantile(c[-120:], 0.5)), "ex_p90": scaled(quantile(c[-120:], 0.9)),
            "ex_max": scaled(max(c[-120:], default=None)), "ex_err": mean([x[8] for x in ex]), "ex_heavy": mean([x[9] for x in ex]), "ex_tests": mean([x[10] for x in ex]),
            "u_n": sum(x[1] == r[1] for x in sub_before), "u_mean": mean(u, 1e6), "u_sd": sd(u), "u_p50": scaled(quantile(u[-120:], 0.5)), "u_p90": scaled(quantile(u[-120:], 0.9)),
            "u_err": mean([x[8] for x in us]), "u_heavy": mean([x[9] for x in us]),
            "pair_n": len(pair), "pair_last_log": cost(last) / 1e6 if last else None, "pair_last_err": last[8] if last else None, "pair_since": since(pair),
            "prev_err": prev[8] if prev else None, "prev_since": since(u_before),
            **dict(zip(("alike_log", "alike_heavy", "other_log", "other_heavy", "class_log"), relations(r[2], r[3]), strict=True)),
            **dict(zip(("permuted_alike_log", "permuted_alike_heavy", "permuted_other_log", "permuted_other_heavy", "permuted_class_log"), relations((r[2] + 1) % 4, f"w|{(r[2] + 1) % 2}"), strict=True)),
        }
    return out


def read_block(df, low=1.2, high=1.5):
    got = blocks.feature_block(df, low, high, (F.col("item_key") + 1) % 4, F.concat(F.lit("w|"), (F.col("item_key") + 1) % 2)).collect()
    return {r.job_id: {k: v for k, v in r.asDict().items() if k != "job_id"} for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_block_is_its_definition(spark, seed):
    # arrivals at one instant have different ids, and none sees another's registration of that instant
    rows = submissions(220, seed)
    rows = [(*r[:5], r[5] + r[0], r[6] + r[0], *r[7:]) for r in rows]
    got, want = read_block(spark.createDataFrame(rows, COLUMNS)), plain_block(rows, 1.2, 1.5)
    assert set(got) == set(want)
    for i, row in want.items():
        assert set(got[i]) == set(row)
        for name, value in row.items():
            assert got[i][name] == (pytest.approx(value, abs=1e-6) if value is not None else None), (i, name)


def test_block_ignores_the_future(spark):
    rows = submissions(200, 3)
    cut = rows[120][5]
    changed = [(*r[:7], r[7] * 2, 1 - r[8], 1 - r[9], r[10] + 5, r[11]) if r[6] > cut else r for r in rows]
    one, two = (read_block(spark.createDataFrame(x, COLUMNS)) for x in (rows, changed))
    early = [r[0] for r in rows if r[11] and r[5] <= cut]
    assert len(early) > 50 and all(one[i] == two[i] for i in early)
    assert read_block(spark.createDataFrame([], COLUMNS)) == {}


@pytest.mark.parametrize("size", [1, 3, 120])
def test_sliding_statistics(spark, size):
    rows = submissions(400, 4)
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.job_id: r for r in history.recent_results(df, ["item_key"], size, (0.0, 0.5, 0.9)).collect()}
    for r in rows:
        values = [x[7] for x in visible(rows, r) if x[2] == r[2]][-size:]
        assert (got[r[0]].n, got[r[0]].p0_us, got[r[0]].p50_us, got[r[0]].p90_us, got[r[0]].max_us) == (len(values), *(quantile(values, p) for p in (0, 0.5, 0.9)), max(values, default=None))


def test_sliding_over_one_key_and_null_keys(spark):
    rows = submissions(300, 5, quick=True)
    df = spark.createDataFrame(rows, COLUMNS).withColumn("item_key", F.when(F.col("job_id") % 3 == 0, F.lit(None)).otherwise(F.col("item_key")))
    got = {r.job_id: r.n for r in history.recent_results(df.repartition(9), ["item_key"], 50).collect()}
    for r in rows:
        assert got[r[0]] == min(50, len([x for x in visible(rows, r) if (x[0] % 3 == 0) == (r[0] % 3 == 0)]))


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_carried_sums_are_a_fold(spark, size):
    rng = random.Random(size)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([0, 1]), rng.randrange(50), rng.random() < 0.5, rng.random() < 0.6) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, k int, s string, t int, x long, counts boolean, reads boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        got = {r.i: tuple(r)[1:] for r in blocks.carried(df.repartition(3, "k").sortWithinPartitions("k", "i"), "k", {"s": ("s", ["x"]), "t": ("t", [])}, ["i"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    of = lambda r, c: [q for q in rows[: r[0] + 1] if q[5] and q[1] == r[1] and q[c] == r[c]]
    assert got == {r[0]: (len(of(r, 2)), sum(q[4] for q in of(r, 2)), len(of(r, 3))) for r in rows if r[6]}


def test_an_exercise_is_sorted_once_for_its_sums(spark):
    df = spark.createDataFrame(submissions(50, 6), COLUMNS)
    plan = blocks.feature_block(df, 1.2, 1.5, F.col("item_key"), F.col("assessment"))._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [item_key" in line]
    assert 1 <= len(sorts) <= 2, plan  # its sums, and its last results
