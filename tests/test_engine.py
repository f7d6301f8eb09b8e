"""Time joins, histories, metrics, bootstrap, sources and access on small hand-made tables."""

from __future__ import annotations

import io
import math
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.access import Guard, SealedData
from causeway.functions import clock
from causeway.functions import text as text_functions
from causeway.operators import history, metrics, study, temporal
from causeway.plans import catalog
from causeway.schema import MissingColumns, require_columns, require_rows
from causeway.sources import readers, sinks


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- time joins
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_is_its_definition(spark, direction, strict):
    rng = random.Random(4)
    left = [(rng.randrange(4), i, rng.randrange(60)) for i in range(80)]
    right = [(k, t, k * 1000 + t) for k in range(3) for t in sorted(rng.sample(range(60), 12))]
    got = temporal.asof(spark.createDataFrame(left, "k int, i int, t int"), spark.createDataFrame(right, "k int, u int, v int"), ["k"], "t", "u", ["v"], direction, strict, tolerance=9)
    for r in got.collect():
        before = [x for x in right if x[0] == r.k and (x[1] < r.t or not strict and x[1] == r.t)]
        after = [x for x in right if x[0] == r.k and (x[1] > r.t or not strict and x[1] == r.t)]
        b, a = max(before, key=lambda x: x[1], default=None), min(after, key=lambda x: x[1], default=None)
        if direction == "nearest":
            best = b if a is None or b is not None and r.t - b[1] <= a[1] - r.t else a
        else:
            best = b if direction == "backward" else a
        if best is not None and abs(best[1] - r.t) > 9:
            best = None
        assert r.v == (best[2] if best else None)


def test_sessions_and_levels(spark):
    df = spark.createDataFrame([(1, 0, 10, 1), (1, 12, 14, 2), (1, 30, 31, 3), (1, 5, 25, 4)], "k int, s long, e long, i int")
    assert rows_of(temporal.sessions(df, ["k"], "s", "e", 3, "i")) == [(1, 0, 25, 3), (1, 30, 31, 1)]
    assert rows_of(temporal.levels(df, ["k"], "s", "e"))[:3] == [(1, 0, 5, 1), (1, 5, 10, 2), (1, 10, 12, 1)]


def test_interpolation_is_flat_outside(spark):
    anchors = spark.createDataFrame([(1, 0, 100), (1, 10, 200), (1, 20, 150)], "k int, x long, y long")
    at = spark.createDataFrame([(1, -5), (1, 5), (1, 15), (1, 99)], "k int, at long")
    assert rows_of(temporal.interpolated(anchors, ["k"], "x", "y", at, "at")) == [(1, -5, 100.0), (1, 5, 150.0), (1, 15, 200.0), (1, 99, 200.0)]


# ---------------------------------------------------------------- histories
def random_jobs(spark, n=150, seed=3):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.randrange(3)
        work = rng.randrange(6)
        rows.append((i, rng.randrange(5), rng.randrange(4), t, t + work, work, int(rng.random() < 0.3)))
    return rows, spark.createDataFrame(rows, "job_id long, user_key int, item_key int, arrival_us long, available_us long, work_us long, is_error int")


def test_history_sees_what_was_readable(spark):
    rows, df = random_jobs(spark)
    stream = history.merged_stream(df, ["item_key", "work_us", "is_error"])
    got = {r.job_id: r for r in history.keyed_history(stream, ["item_key"], "x").collect()}
    for i, _, item, at, _, _, _ in rows:
        # a result that is readable at its own arrival comes after that instant's reads
        seen = [r for r in rows if r[2] == item and r[4] <= at and not (r[4] == r[3] == at)]
        assert got[i].x_n == len(seen)
        assert got[i].x_mean_us == pytest.approx(sum(r[5] for r in seen) / len(seen) if seen else -1)


def test_history_ignores_the_future(spark):
    rows, df = random_jobs(spark, seed=8)
    cut = rows[90][3]
    read = lambda d: {r.job_id: tuple(r) for r in history.keyed_history(history.merged_stream(d, ["user_key", "work_us", "is_error"]), ["user_key"], "u").collect() if rows[r.job_id][3] <= cut}
    changed = df.withColumn("is_error", F.when(F.col("available_us") > cut, 1 - F.col("is_error")).otherwise(F.col("is_error"))).withColumn("work_us", F.when(F.col("available_us") > cut, F.lit(99)).otherwise(F.col("work_us")))
    assert read(df) == read(changed)


def test_last_result_goes_by_arrival(spark):
    df = spark.createDataFrame([(0, 1, 0, 50, 5, 1), (1, 1, 10, 20, 6, 0), (2, 1, 60, 70, 7, 0)], "job_id long, user_key int, arrival_us long, available_us long, work_us long, is_error int")
    got = {r.job_id: r.last_job for r in history.last_result(history.merged_stream(df, ["user_key", "arrival_us", "is_error", "work_us"]), ["user_key"]).collect()}
    assert got == {0: None, 1: None, 2: 1}


def test_coending_merged_and_dropped(spark):
    df = spark.createDataFrame([(1, 7, 100, 5), (2, 7, 100, 9), (3, 7, 101, 4)], "job_id long, user int, second long, work long")
    assert rows_of(history.merge_coending(df, ["user", "second"], ["job_id"], "work").select("job_id", "work")) == [(1, 9), (3, 4)]
    assert rows_of(history.merge_coending(df, ["user", "second"], ["job_id"], "work", drop=True).select("job_id", "work")) == [(3, 4)]


@pytest.mark.parametrize("parts", [1, 3])
def test_points_meet_every_interval_that_holds_them_once(spark, parts):
    rng = random.Random(14)
    points = [(i, 0 if rng.random() < 0.5 else rng.randrange(1, 5), rng.randrange(-50, 200)) for i in range(200)]
    spans = [(100 + i, rng.randrange(5), (a := rng.randrange(-40, 180)), a + rng.choice([-1, 0, 3, 60])) for i in range(60)]
    left, right = spark.createDataFrame(points, "p long, k int, at long"), spark.createDataFrame(spans, "i long, k int, lo long, hi long")
    got = temporal.within(left, right, ["k"], "at", "lo", "hi", 10, parts).select("p", "i").collect()
    assert sorted(map(tuple, got)) == sorted((p, i) for p, k, at in points for i, kk, lo, hi in spans if k == kk and lo <= at <= hi)


# ---------------------------------------------------------------- metrics and bootstrap
def test_ranking_metrics(spark):
    df = lambda rows: spark.createDataFrame(rows, "s double, y int")
    assert metrics.auroc(df([(1.0, 0), (1.0, 1)]), "s", "y").first().auroc == 0.5
    assert metrics.auroc(df([(1.0, 0), (2.0, 1), (2.0, 0)]), "s", "y").first().auroc == 0.75
    assert metrics.auroc(df([(1.0, 1), (2.0, 1)]), "s", "y").first().auroc is None
    assert metrics.average_precision(df([(3.0, 1), (2.0, 0), (1.0, 1)]), "s", "y").first()[0] == pytest.approx((1 + 2 / 3) / 2)


def test_resampled_quantile_is_that_of_the_expanded_sample(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.randrange(50)) for _ in range(300)]
    draws = study.multiplicities(spark, range(5), 6, seed=3)
    table = {(r.resample, r.block): r.m for r in draws.collect()}
    got = study.resampled_quantile(spark.createDataFrame(rows, "w long, v long"), "w", "v", [], 0.9, draws).collect()
    for r in got:
        expanded = [v for w, v in rows for _ in range(table[r.resample, w])]
        assert r.quantile == pytest.approx(np.quantile(expanded, 0.9))
    assert {table[0, b] for b in range(5)} == {1}


def test_ranking_of_resamples_is_that_of_expanded_samples(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(6), rng.randrange(9), int(rng.random() < 0.4)) for _ in range(200)]
    draws = study.multiplicities(spark, range(6), 20, seed=4)
    table = {(r.resample, r.block): r.m for r in draws.collect()}
    got = {r.resample: r for r in metrics.resampled_ranking(spark.createDataFrame(rows, "b long, s long, y int"), "b", "s", "y", draws).collect()}
    assert len(got) == 21
    for resample, r in got.items():
        drawn = [(s, y) for b, s, y in rows for _ in range(table[resample, b])]
        p, q = ([s for s, y in drawn if y == want] for want in (1, 0))
        assert r.auroc == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q)))
        ap = sum(p.count(s) / len(p) * sum(x >= s for x in p) / sum(x >= s for x, _ in drawn) for s in set(p))
        assert r.average_precision == pytest.approx(ap)


@pytest.mark.parametrize("blocks", [1, 3, 8])
def test_pairwise_correlations(spark, blocks):
    rng = random.Random(16)
    rows = [(s, p, rng.randrange(-3, 6)) for s in range(7) for p in range(12) if rng.random() < 0.7] + [(7, 3, 2), (8, 5, 1), (9, 0, 0)]
    got = {(r.a, r.b): r["corr"] for r in metrics.pairwise_corr(spark.createDataFrame(rows, "s int, p int, v int"), "s", "p", "v", blocks).collect()}
    value = {(s, p): v for s, p, v in rows}
    curve = {s: [value.get((s, p), 0) for p in range(12)] for s in range(10)}
    assert set(got) == {(a, b) for a in range(10) for b in range(a + 1, 10)}
    for (a, b), r in got.items():
        assert r == (pytest.approx(np.corrcoef(curve[a], curve[b])[0, 1]) if b != 9 else None)


@pytest.mark.parametrize("share", [0.001, 0.1, 0.5, 1.0])
def test_longest_share_with_ties(spark, share):
    rng = random.Random(13)
    rows = [(i, rng.randrange(12)) for i in range(300)]
    got = {r.id for r in study.longest_share(spark.createDataFrame(rows, "id long, v long"), "v", "id", share).where("longest").collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[: max(1, int(len(rows) * share))]}


def test_premature_hand_example(spark):
    df = spark.createDataFrame([(0, 1, 0, 5, 25), (1, 1, 10, 15, 15), (2, 1, 20, 25, 25)], "job_id long, k int, arrival_us long, available_us long, done_us long")
    assert rows_of(study.premature_counts(df, [["k"]])) == [(0, 0), (1, 1), (2, 1)]


def test_choice_and_frontier(spark):
    worst = spark.createDataFrame([("a", 0.5, 10.0), ("b", 0.7, 90.0), ("c", 0.5, 5.0), ("d", 0.4, 7.0)], "config string, worst_gap double, worst_harm double")
    assert study.choose(worst, [], 50.0, [F.col("config")]).first().config == "c"
    assert rows_of(study.frontier(worst, []).select("config")) == [("b",), ("c",)]


def test_half_even_micros(spark):
    df = spark.createDataFrame([(0.0000005,), (0.0000015,), (2.0,)], "x double").select(clock.seconds_to_micros(F.col("x")).alias("m"))
    assert [r.m for r in df.collect()] == [0, 2, 2_000_000]


# ---------------------------------------------------------------- text and sources
def test_text_functions(spark):
    code = "def f(n):\n    for i in x:\n        for j in y:\n            f(n - 1)\n    while z:\n        pass\n"
    df = spark.createDataFrame([(code, "Traceback\n  File\nValueError: no\n\n"), ("x = 1", "killed"), ("", "")], "c string, e string")
    got = [tuple(r) for r in df.select(text_functions.loop_depth(F.col("c")), text_functions.recursion(F.col("c")), text_functions.error_class(F.col("e"))).collect()]
    assert got == [(2, True, "ValueError"), (0, False, "TimeLimit"), (0, False, "Empty")]


def test_code_features(spark):
    code = "import math\nfrom os.path import join\n  import foo, bar\n# note\ndef fib(n):\n    if n < 2:\n        return n\n    return fib(n - 1) + fib(n - 2)\nfor i in range(1000):\n\twhile True:\n\t\tfor j in range(12, 7):\n            print(i * 123456)\nwhile x:\n    time.sleep(len(y))\n"
    df = spark.createDataFrame([(code,), ("",), ("def g():\n    pass\ng()\n" + "9" * 40,)], "c string")
    a, b, c = (r.asDict() for r in df.select(*(x.alias(n) for n, x in text_functions.code_features(F.col("c")).items())).collect())
    assert len(a) == 37
    want = {"chars": len(code), "lines": 15, "nonblank_lines": 14, "n_comment_lines": 1, "n_while": 2, "n_for": 2, "n_def": 1, "n_if": 1, "n_print": 1, "n_range": 2, "n_return": 2, "n_len": 1, "n_import": 3, "imp_math": 1, "imp_os": 1, "imp_time": 0, "imp_other": 1, "max_indent": 12, "nest_loop_depth": 3, "has_while_true": 1, "has_recursion": 1, "max_num_digits": 6, "max_range_digits": 4, "has_sleep": 1, "has_evalexec": 0, "has_open": 0}
    assert {k: a[k] for k in want} == want
    assert b == dict.fromkeys(a, 0) | {"lines": 1}
    assert (c["has_recursion"], c["max_num_digits"], c["nest_loop_depth"]) == (0, 18, 0)


def test_archive(spark, tmp_path):
    sep = readers.SEPARATOR
    log = (
        "== SUBMITION (2021-3-2 9:00:05)\n-- CODE:\nprint('é')\nx = 2\n-- not a mark\n\n-- EXECUTION TIME:\n 0.25 \n-- TEST CASE 1:\nok\n-- TEST CASE 2:\n-- GRADE:\n80%\n" + sep
        + "\n== TEST (2021-03-02 09:05:00)\n-- CODE:\nprint(\n-- OUTPUT:\n-- ERROR:\n  File x\nSyntaxError: bad\n\n" + sep
        + "\n== TEST (2021-03-02 09:06:00)\n-- EXECUTION TIME:\nslow\n-- ERROR:\n\n" + sep + "\n== TEST (2021-03-02 09:07:00)\n-- ERROR:\nProcess killed: Time Limit reached\n" + sep + "\nno head\n-- CODE:\nx\n" + sep
    )
    files = {
        "2021-1/c1/assessments/a1.data": "---- type: homework\n---- weight: 2.5\n-- start: 2021-3-1 10:00\n---- end: 2021-03-08 23:59\n---- total_exercises: 3\n---- exercise 1: 11\n---- exercise 2: 12\n---- exercise 3: 13\n---- class number: 7\n---- language: py\n----- type: no\n",
        "2021-1/c1/users/u9/executions/a1_11.log": log,
        "2021-1/c1/users/u9/codemirror/a1_1_1.log": "2021-3-2 9:05:01.1#change\n2021-03-02 09:05:09.2#x\n2021-13-02 09:05:09.2#x\nnoise noise noise noise\n2021-3-2 19:06:00.0#some key\n2021-3-2 19:07\n",
        "2021-1/c1/users/u9/logins.log": "2021-3-2 8:59:00#user/login\njunk\n2021-03-02 10:00:00#user/logout more\n",
        "2021-1/c1/users/u9/user.data": "-- DATA\n---- course id: 42\n-- HIGH SCHOOL\n---- course id: 99\n",
        "2021-1/c1/users/u9/grades/x.data": "skipped",
        "2021-1/readme": "skipped",
    }
    with tarfile.open(tmp_path / "set_2021_1_v1.0.tar.gz", "w:gz") as archive:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            archive.addfile(info, io.BytesIO(text.encode()))
    members = readers.routed(readers.archive_members(spark, str(tmp_path)))
    assert {r.t for r in members.select(readers.term_of(F.col("archive")).alias("t")).collect()} == {"2021-1"}
    a = readers.assessments(members).first()
    assert (a.term, a.class_id, a.assessment, a.type, a.weight, a.n_exercises, a.exercise_ids, a.class_number, a.language) == ("2021-1", "c1", "a1", "homework", 2.5, 3, ["11", "12", "13"], "7", "py")
    assert (str(a.start), str(a.end)) == ("2021-03-01 10:00:00", "2021-03-08 23:59:00")
    e = readers.executions(members).orderBy("ts").collect()
    assert [(x.user, x.assessment, x.exercise, x.kind, str(x.ts)[11:]) for x in e[:2]] == [("u9", "a1", "11", "submit", "09:00:05"), ("u9", "a1", "11", "test", "09:05:00")]
    assert [(x.exec_time, x.grade, x.n_testcases, x.has_error, x.error_type) for x in e] == [
        (0.25, 80.0, 2, False, None), (None, None, 0, True, "SyntaxError"), (None, None, 0, True, "Empty"), (None, None, 0, True, "TimeLimit")
    ]
    assert [(x.code_len, x.code_lines) for x in e] == [(len("print('é')\nx = 2\n-- not a mark"), 3), (6, 1), (0, 0), (0, 0)]
    minutes = readers.keystroke_minutes(members).orderBy("minute").collect()
    assert [(r.assessment, r.exercise, str(r.minute)[11:16], r.n_events) for r in minutes] == [("a1", "1_1", "09:05", 2), ("a1", "1_1", "19:06", 1)]
    assert [(str(r.ts)[11:], r.kind) for r in readers.logins(members).orderBy("ts").collect()] == [("08:59:00", "login"), ("10:00:00", "logout")]
    assert [(r.user, r.course_id) for r in readers.users(members).collect()] == [("u9", "42")]
    c = readers.coverage(members).first()
    assert (c.executions, c.other, c.lines_seen, c.lines_used) == (1, 2, 5, 3)


def test_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("-- head\nINSERT INTO `users` VALUES (1,'it''s',NULL),(2,'a\\'b,(c)\\n','x');\nINSERT INTO `tags` VALUES (7,'t');\nINSERT INTO `users` VALUES (3,'',' y');\n")
    got = rows_of(readers.dump_table(spark, str(tmp_path / "d.sql"), "users", ["id", "name", "note"]).fillna("<null>"))
    assert got == [("1", "it's", "<null>"), ("2", "a'b,(c)\n", "x"), ("3", "", " y")]
    assert rows_of(readers.insert_count(spark, str(tmp_path / "d.sql"))) == [("tags", 1), ("users", 2)]


def test_flat_files(spark, tmp_path):
    (tmp_path / "w.swf").write_text("; a comment\n 1 0 5 " + " ".join(["-1"] * 15) + "\n\n")
    row = readers.workload(spark, str(tmp_path / "w.swf")).first()
    assert (row.job, row.wait, row.think) == (1.0, 5.0, -1.0)
    (tmp_path / "i.csv").write_text("app,func,end_timestamp,duration\na,f,10.5,0.5\n")
    assert readers.invocations(spark, str(tmp_path / "i.csv")).first().arrival == 10.0
    (tmp_path / "c.csv").write_text("code_module,code_presentation,id_student,id_site,date,sum_click\nA,x,1,1,3,4\nA,x,2,1,3,6\n")
    assert rows_of(readers.clicks(spark, str(tmp_path / "c.csv"), {"A": "g"})) == [("g", 3, 10)]
    (tmp_path / "t.jsonl").write_text('{"task_id": "t", "runs": [{"state": "a"}, {"state": "b"}]}\n')
    tasks = readers.json_lines(spark, str(tmp_path / "t.jsonl"), "task_id string, runs array<struct<state:string>>")
    assert rows_of(readers.runs_of_tasks(tasks)) == [("t", 0, "a"), ("t", 1, "b")]
    with pytest.raises(FileNotFoundError):
        readers.cached(spark, [str(tmp_path / "none")], ["x"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a_b", 0.5), (2, None, None)], "i int, s string, x double")
    sinks.write_table(df, str(tmp_path / "p"), ["i"])
    before = sinks.manifest(spark, str(tmp_path / "p"))
    before = spark.createDataFrame(before.collect(), before.schema)
    assert sinks.verify(before, spark, str(tmp_path / "p")).count() == 0
    assert r"\num{0.50}" in sinks.latex(df) and r"a\_b" in sinks.latex(df)
    assert rows_of(sinks.remaining(spark.createDataFrame([(1,), (3,)], "i int"), str(tmp_path / "p"), ["i"])) == [(3,)]


def test_signed_and_cells(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3).toDF("job_id").withColumns({"arrival_us": F.col("job_id") * 5, "level": F.col("job_id") % 2})

    for _ in range(2):
        assert sinks.signed(spark, str(tmp_path / "s"), "k=2", make).count() == 3
    assert len(calls) == 1 and sinks.signed(spark, str(tmp_path / "s"), "k=3", make).count() == 3 and len(calls) == 2
    sinks.write_cells(make(), str(tmp_path / "c"), ["level"])
    assert sorted(r.job_id for r in readers.cell(spark, str(tmp_path / "c"), level=0).collect()) == [0, 2]


def test_access(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,), (3,)], "term int")
    guard = Guard("term", frozenset({3}), ledger=tmp_path / "ledger")
    assert rows_of(guard.read(df, [1, 2])) == [(1,), (2,)]
    with pytest.raises(SealedData):
        guard.read(df, [2, 3])
    assert guard.open_part(df).count() == 2
    open_guard = Guard("term", frozenset({3}), lock=True, allow=True, ledger=tmp_path / "ledger")
    with pytest.raises(RuntimeError), open_guard.recording([3], "a trial"):
        raise RuntimeError
    assert open_guard.reads[0]["outcome"] == "failed" and (tmp_path / "ledger").read_text().count("\n") == 1


def test_boundary_checks(spark):
    df = spark.createDataFrame([(1, 5), (2, -1)], "a int, b int")
    with pytest.raises(MissingColumns):
        require_columns(df, ["a", "c"])
    with pytest.raises(Exception, match="b must not be negative"):
        require_rows(df, F.col("b") >= 0, "b must not be negative").collect()


def test_powers_have_the_last_bit_of_the_c_library(spark):
    rows = spark.range(20_000).select((F.col("id") / F.lit(20_011.0)).alias("x"))
    assert all(r.y == math.pow(r.x, 1 / 0.7) for r in rows.select("x", clock.power(F.col("x"), 1 / 0.7).alias("y")).collect())
    assert spark.createDataFrame([(None,)], "x double").select(clock.power(F.col("x"), 0.5).alias("y")).first().y is None


def test_assembled_ranks_traces_by_parts(spark):
    import re

    from causeway.operators import study

    day = 86_400_000_000
    rows = [(c, i, 9 * day + (i * 7 % 5) * 1_000, 1_000_000) for c in (0, 1) for i in range(20 + c)]
    out = study.assembled(spark.createDataFrame(rows, "copy int, job_id long, arrival_us long, work_us long"), ["copy"], (0.5,))
    for c in (0, 1):
        want = [r[1] for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1]))]
        got = sorted((r.rank, r.job_id, r.arrival_us) for r in out.where(f"copy = {c}").collect())
        assert [x[0] for x in got] == list(range(len(want))) and [x[1] for x in got] == want and all(x[2] < day for x in got)
    # no window along a whole trace
    plan = out._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"windowspecdefinition\(copy#\d+, (arrival_us#\d+L ASC|specifiedwindowframe)", plan)


def test_code_features_cut_a_text_up_once(spark, tmp_path):
    rows = [(1, "import os.path, re\nfrom  numpy.linalg import norm\n\n  \t\nfor x in range(10):\n\twhile (1):\n        print(len(x)); évalué = eval(x)\n# sleep"), (2, "whilé for_ if if  import time\n from sys import a\nfromage import"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.QUERIES["code_features"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3, plan  # words, modules and digits
    alone = text_functions.code_features(F.coalesce("text", F.lit("")))
    want = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", *(alone[c].cast("int").alias(c) for c in df.columns[1:]))
    got = {r.doc_id: r for r in df.collect()}
    assert got == {r.doc_id: r for r in want.collect()}
    assert [got[1][c] for c in ("n_import", "imp_os", "imp_numpy", "imp_other", "n_for", "n_while", "n_len", "has_evalexec", "has_sleep", "has_open")] == [2, 1, 1, 0, 1, 1, 1, 1, 1, 0]
    assert [got[2][c] for c in ("n_if", "n_for", "n_import", "imp_sys", "imp_time")] == [2, 0, 1, 1, 0]
