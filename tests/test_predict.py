"""Boosted trees against a plain booster; rolling origins, saved models, ensembles."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import boosting, metrics, predict
from causeway.operators.boosting import UNIT, Boosting


def sample(n, seed, models=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(9), rng.gauss(0, 1), rng.random()
        y = max(0.0, a * 0.5 + (3 if b > 0.3 else 0) + rng.gauss(0, 0.2))
        rows.append((i, i % models, float(a) if rng.random() > 0.1 else None, b, c, y, int(y > 3)))
    return rows


SCHEMA = "job_id long, target int, a double, b double, c double, y double, flag int"
LOSS = {
    "tweedie": (math.log, lambda y: y, lambda y, s: math.exp(0.5 * s) - y * math.exp(-0.5 * s), lambda y, s: 0.5 * math.exp(0.5 * s) + 0.5 * y * math.exp(-0.5 * s), math.exp),
    "log": (lambda m: m, math.log1p, lambda y, s: s - y, lambda y, s: 1.0, math.expm1),
    "logistic": (lambda m: math.log(m / (1 - m)), lambda y: y, lambda y, s: 1 / (1 + math.exp(-s)) - y, lambda y, s: math.exp(-s) / (1 + math.exp(-s)) ** 2, lambda s: 1 / (1 + math.exp(-s))),
}


def plain_booster(rows, spec):
    """Scores of all rows by trees that are grown one node at a time. rows: (features, y)."""
    start, target, gradient, hessian, predict_ = LOSS[spec.loss]
    ys = [target(y) for _, y in rows]
    features = len(rows[0][0])
    cuts = []
    for f in range(features):
        values = sorted(x[f] for x, _ in rows if x[f] is not None)
        cuts.append(sorted({values[max(0, math.ceil(len(values) * i / spec.bins) - 1)] for i in range(1, spec.bins)}))
    bins = [[0 if x[f] is None else 1 + sum(c < x[f] for c in cuts[f]) for f in range(features)] for x, _ in rows]
    score = [round(start(sum(ys) / len(ys)), 9)] * len(rows)

    def grow(at, depth, g, h):
        sg, sh = sum(g[i] for i in at), sum(h[i] for i in at)
        part = lambda a, b: (a / UNIT) * (a / UNIT) / (b / UNIT + spec.shrink)
        best = None
        for f in range(features if depth else 0):
            for cut in sorted({bins[i][f] for i in at}):
                left = [i for i in at if bins[i][f] <= cut]
                if len(left) < spec.least_rows or len(at) - len(left) < spec.least_rows:
                    continue
                lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                gain = part(lg, lh) + part(sg - lg, sh - lh) - part(sg, sh)
                if gain > spec.least_gain and (best is None or gain > best[0]):
                    best = (gain, f, cut)
        if best is None:
            for i in at:
                score[i] += -spec.rate * (sg / UNIT) / (sh / UNIT + spec.shrink)
            return
        _, f, cut = best
        grow([i for i in at if bins[i][f] <= cut], depth - 1, g, h)
        grow([i for i in at if bins[i][f] > cut], depth - 1, g, h)

    for _ in range(spec.rounds):
        g = [math.floor(gradient(y, s) * UNIT + 0.5) for y, s in zip(ys, score, strict=True)]
        h = [math.floor(hessian(y, s) * UNIT + 0.5) for y, s in zip(ys, score, strict=True)]
        grow(list(range(len(rows))), spec.depth, g, h)
    return [predict_(s) for s in score]


@pytest.mark.parametrize("loss", ["tweedie", "log", "logistic"])
def test_trees_are_those_of_a_plain_booster(spark, loss):
    rows = sample(200, 1)
    spec = Boosting(loss=loss, rounds=3, depth=3, bins=8, least_rows=5, rate=0.3)
    label = "flag" if loss == "logistic" else "y"
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.job_id: r.prediction for r in boosting.fit(df, ["target"], ["a", "b", "c"], label, spec).score(df).collect()}
    for target in (0, 1):
        own = [r for r in rows if r[1] == target]
        want = plain_booster([(r[2:5], r[6] if loss == "logistic" else r[5]) for r in own], spec)
        assert [got[r[0]] for r in own] == pytest.approx(want, rel=1e-9)


def test_loss_falls_every_round_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame(sample(400, 2, models=1), SCHEMA)
    losses = []
    for rounds in (1, 3, 6):
        spec = Boosting(rounds=rounds, depth=2, bins=8, rate=0.3)
        losses.append(boosting.fit(df, ["target"], ["a", "b", "c"], "y", spec).score(df).agg(boosting.mean_loss(spec, "y", "prediction")).first()[0])
    assert losses[0] > losses[1] > losses[2] and losses[2] < losses[0] - 0.05
    trees = lambda d: boosting.fit(d, ["target"], ["a", "b", "c"], "y", Boosting(rounds=2, depth=2, bins=8)).table.select("trees", "start").first()
    assert trees(df.repartition(7, "b")) == trees(df.repartition(2, "c"))


def test_slopes_have_the_last_bit_of_the_c_library(spark):
    rng = random.Random(5)
    y, s = [rng.random() * 60 for _ in range(2_000)], [rng.gauss(0, 3) for _ in range(2_000)]
    for loss, (_, _, gradient, hessian, _) in LOSS.items():
        g, h = boosting.slopes(loss, np.array(y), np.array(s))
        assert g.tolist() == [math.floor(gradient(a, b) * UNIT + 0.5) for a, b in zip(y, s, strict=True)]
        if loss != "logistic":
            assert h.tolist() == [math.floor(hessian(a, b) * UNIT + 0.5) for a, b in zip(y, s, strict=True)]


def test_cuts_are_exact_beyond_any_sketch(spark, monkeypatch):
    spec = Boosting(rounds=1, depth=1, bins=8)
    df = spark.range(1_200_000).repartition(12).selectExpr("0 target", "cast(id as double) a", "1.0D y")
    want = [[float(1_200_000 * i // 8 - 1) for i in range(1, 8)]]
    assert boosting.fit(df, ["target"], ["a"], "y", spec).table.first().cuts == want
    rows = [(*r[:4], random.Random(r[0]).choice([r[4], 0.5, float("nan"), float("inf"), -float("inf")]), *r[5:]) for r in sample(600, 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {}
    for target in (0, 1):
        values = [sorted(x for r in rows if r[1] == target and (x := r[f]) is not None and x == x) for f in (2, 3, 4)]
        want[target] = [sorted({v[max(0, math.ceil(len(v) * i / 8) - 1)] for i in range(1, 8)}) for v in values]
    for name, most in (("SKETCH", 3), ("MOST_CELLS", 0)):  # brackets that miss; counts of all values
        with monkeypatch.context() as m:
            m.setattr(boosting, name, most)
            assert {r.target: r.cuts for r in boosting.fit(df, ["target"], ["a", "b", "c"], "y", spec).table.collect()} == want


def test_cutoffs_are_those_of_interpolated_ranks(spark):
    rng = random.Random(8)
    rows = [(i % 3, rng.choice([None, rng.randrange(40)]) if i % 3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "target int, v int")
    got = {r.target: (r.a, r.b) for r in predict.cutoffs(df, ["target"], "v", a=0.95, b=0.5).collect()}
    assert got == {r.target: (r.a, r.b) for r in df.groupBy("target").agg(F.percentile("v", F.lit(0.95)).alias("a"), F.percentile("v", F.lit(0.5)).alias("b")).collect()}
    assert got[0] == (None, None)


def test_few_models_grow_the_trees_of_many(spark, monkeypatch):
    df = spark.createDataFrame([(*r[:5], r[5] * 1e7, r[6]) for r in sample(400, 3, models=3)], SCHEMA)  # sums beyond the whole numbers of a double
    for loss, label in (("tweedie", "y"), ("log", "y"), ("logistic", "flag")):
        spec = Boosting(loss=loss, rounds=3, depth=3, bins=8, least_rows=5)
        trees = lambda: {r.target: (r.start, r.trees) for r in boosting.fit(df, ["target"], ["a", "b", "c"], label, spec).table.collect()}  # noqa: E731, B023
        few = trees()
        with monkeypatch.context() as m:
            m.setattr(boosting, "MOST_CELLS", 0)
            assert trees() == few


def test_odd_training_rows(spark):
    spec = Boosting(rounds=2, depth=2, bins=4)
    empty = spark.createDataFrame([], SCHEMA)
    rows = [(1, 0, None, float("nan"), 1.0, 2.0, 1), (2, 0, None, 1.0, None, None, None), (3, None, 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    none = boosting.fit(empty, ["target"], ["a", "b"], "y", spec)
    assert none.models == 0 and {r.prediction for r in none.score(df).collect()} == {None}
    got = {r.job_id: r.prediction for r in boosting.fit(df, ["target"], ["a", "b"], "y", spec).score(df).collect()}
    assert got[1] == pytest.approx(2.0) == got[2] and got[3] is None  # one row: its own mean
    one_sided = boosting.fit(df, ["target"], ["a"], "flag", Boosting(loss="logistic", rounds=1, depth=1)).score(df)
    assert all(0 < r.prediction <= 1 for r in one_sided.where("prediction is not null").collect())
    with pytest.raises(ValueError):
        Boosting(loss="hinge")
    with pytest.raises(ValueError):
        none.score(df.withColumn("cuts", F.lit(1)))


def terms(seed=3, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        term = i * 4 // n
        arrival = term * 1000 + rng.randrange(900)
        rows.append((i, term, arrival, arrival + rng.choice([5, 300, 1500]), rng.random(), rng.random() * 5))
    return rows


TERMS = "job_id long, week int, arrival_us long, available_us long, x double, y double"


def test_origins_roll_in_one_plan(spark):
    rows = terms()
    got = {(r.target, r.job_id) for r in predict.training_pairs(spark.createDataFrame(rows, TERMS), "week").collect()}
    starts = {w: min(r[2] for r in rows if r[1] == w) for w in range(4)}
    assert got == {(w, r[0]) for w in range(4) for r in rows if r[1] < w and r[3] < starts[w]}
    assert predict.training_pairs(spark.createDataFrame([], TERMS), "week").collect() == []


def test_no_model_knows_a_row_of_its_target(spark):
    rows = terms()
    spec = Boosting(loss="log", rounds=2, depth=2, bins=8, least_rows=5)
    models = lambda rs: {r.target: (r.start, r.cuts, r.trees) for r in predict.rolling_models(spark.createDataFrame(rs, TERMS), "week", ["x"], "y", spec).table.collect()}
    changed = [(*r[:4], r[4] + 9, r[5] + 9) if r[1] >= 2 else r for r in rows]
    late = [(*r[:4], r[4] + 9, r[5] + 9) if r[3] >= min(x[2] for x in rows if x[1] == 2) else r for r in rows]
    one, two, three = models(rows), models(changed), models(late)
    assert set(one) == {1, 2, 3} and one[2] == two[2] == three[2] and one[3] != two[3]


def test_saved_models_score_changed_histories(spark, tmp_path):
    df = spark.createDataFrame(terms(), TERMS)
    spec = Boosting(loss="log", rounds=2, depth=2, bins=8, least_rows=5)
    model = predict.rolling_models(df, "week", ["x"], "y", spec)
    model.save(str(tmp_path / "m"))
    again = boosting.Model.load(spark, str(tmp_path / "m"), spec, ["target"], ["x"])
    changed = df.withColumn("x", F.col("x") / 2)
    score = lambda m, d: {r.job_id: r.prediction for r in predict.forward_scores(m, d, "week").collect()}
    assert score(again, changed) == score(model, changed) != score(model, df)
    assert set(score(model, df)) == {r[0] for r in terms() if r[1] > 0}


def test_ensembles_average_their_seeds(spark):
    df = spark.createDataFrame(sample(240, 4), SCHEMA)
    spec = Boosting(loss="logistic", rounds=2, depth=2, bins=8, least_rows=5)
    model = predict.ensemble(df, ["target"], ["a", "b", "c"], "flag", [1, 2, 3], 0.7, "job_id", spec)
    assert model.models == 6
    got = {r.job_id: r.prediction for r in predict.averaged(model, df, [1, 2, 3], "job_id").collect()}
    single = {}
    for seed in (1, 2, 3):
        part = df.where(predict.drawn(F.lit(seed), 0.7, "job_id"))
        for r in boosting.fit(part, ["target"], ["a", "b", "c"], "flag", spec).score(df).collect():
            single.setdefault(r.job_id, []).append(r.prediction)
    assert {k: pytest.approx(sum(v) / 3) for k, v in single.items()} == got
    rows = df.withColumn("prediction", F.lit(0.31))
    shares = predict.calibrated(model, rows, rows, ["target"], "flag").groupBy("target").agg(F.first("calibrated").alias("c"), F.sum("flag").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.c == pytest.approx((r.t + 0.325) / (r.n + 1)) for r in shares)


def test_auroc_of_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["cold", "warm", None]), rng.randrange(12) / 4, rng.randrange(2)) for _ in range(400)] + [("one", 1.0, 1)]
    got = {r.g: r for r in metrics.auroc_by(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect()}
    for g in ("cold", "warm", None, "one"):
        p, q = ([s for x, s, y in rows if x == g and y == want] for want in (1, 0))
        want = sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q)) if p and q else None
        assert got[g].auroc == (pytest.approx(want) if want is not None else None) and (got[g].positives, got[g].negatives) == (len(p), len(q))


def test_blocks_are_cut_and_scored_as_rows_are(spark, monkeypatch):
    rows = sample(400, 6, models=3)
    df = spark.createDataFrame([*rows, (401, 9, 1.0, None, float("nan"), 1.0, 0)], SCHEMA).repartition(3)
    spec = Boosting(rounds=2, depth=2, bins=8, least_rows=5)
    learned = df.where("target < 3")
    whole = boosting.fit(learned, ["target"], ["a", "b", "c"], "y", spec)
    jobs = []
    with monkeypatch.context() as m:
        m.setattr(boosting, "BLOCK_ROWS", 7)
        real = boosting.written
        m.setattr(boosting, "written", lambda rows, name, **options: jobs.append(name) or real(rows, name, **options))
        small = boosting.fit(learned, ["target"], ["a", "b", "c"], "y", spec)
    assert jobs.count("boosted") == spec.rounds  # rows are packed once and take leaves between rounds
    assert sorted(small.table.collect()) == sorted(whole.table.collect())
    few = {r.job_id: r.prediction for r in whole.score(df).collect()}
    monkeypatch.setattr(boosting, "MOST_CELLS", 0)
    assert few == {r.job_id: r.prediction for r in whole.score(df).collect()} and few[401] is None
