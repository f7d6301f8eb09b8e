"""Live histories against their definition, with rows out of order and rows behind the watermark."""

from __future__ import annotations

import datetime
import random

from causeway.streaming import live

SCHEMA = "user_key long, job_id long, ts timestamp, arrival_us long, available_us long, work_us long, is_error int"
HOUR = 3_600_000_000


def job(i, user, arrival, available):
    return (user, i, datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=arrival), arrival, available, i % 7, i % 2)


def run(spark, tmp_path, chunks, late):
    for rows in chunks:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, 1)
    return {r.job_id: (r.n, r.work_us, r.errors) for r in live.drained(live.live_history(stream, "user_key", late), str(tmp_path / "out")).collect()}


def plain(rows, r):
    seen = [x for x in rows if x[0] == r[0] and (x[4] < r[3] or (x[4] == r[3] and x[4] != x[3]))]
    return (len(seen), sum(x[5] for x in seen), sum(x[6] for x in seen))


def test_rows_may_come_in_any_order_within_the_delay(spark, tmp_path):
    rng = random.Random(21)
    rows, t = [], 100 * HOUR
    for i in range(160):
        t += rng.choice([0, 0, 1, HOUR // 4])
        rows.append(job(i, 1 if rng.random() < 0.6 else rng.randrange(2, 5), t, t + rng.choice([0, 1, HOUR // 4, 3 * HOUR])))
    come = sorted(rows, key=lambda r: r[3] + rng.randrange(2 * HOUR))  # up to two hours late
    chunks = [come[i : i + 40] for i in range(0, 160, 40)]
    got = run(spark, tmp_path, [*chunks, [job(-1, 99, t + 100 * HOUR, t + 100 * HOUR)]], "2 hours")
    assert got == {r[1]: plain(rows, r) for r in rows}


def test_rows_behind_the_watermark_neither_read_nor_count(spark, tmp_path):
    a, b, late, after = job(1, 1, 10 * HOUR, 11 * HOUR), job(2, 1, 20 * HOUR, 20 * HOUR + 1), job(3, 1, 9 * HOUR, 9 * HOUR), job(4, 1, 40 * HOUR, 41 * HOUR)
    end = job(-1, 99, 300 * HOUR, 300 * HOUR)
    got = run(spark, tmp_path, [[a, b], [job(-2, 98, 30 * HOUR, 30 * HOUR)], [job(-3, 98, 31 * HOUR, 31 * HOUR)], [late, after], [end]], "1 hour")
    assert {i: got[i][0] for i in got if i > 0} == {1: 0, 2: 1, 4: 2}


def test_many_keys_are_few_states(spark, tmp_path):
    rng = random.Random(8)
    rows = [job(i, rng.choice([None, *range(1500)]) if i % 9 else 7, 100 * HOUR + i * HOUR // 500, 100 * HOUR + i * HOUR // 500 + rng.choice([0, 1, HOUR])) for i in range(3000)]
    for chunk in (rows[:1400], rows[1400:], [job(-1, 99, 900 * HOUR, 900 * HOUR)]):
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.live_history(live.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, 1), "user_key")
    got = {}

    def take(batch, _):
        got.update({r.job_id: (r.n, r.work_us, r.errors) for r in batch.collect()})

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert got == {r[1]: plain(rows, r) for r in rows}
    assert 0 < max(states) <= live.BUCKETS
