"""Platform histories against folding one record after the other."""

from __future__ import annotations

import random
from math import sqrt

import pytest

from causeway.operators import platform

SCHEMA = "id long, problem int, user int, contest int, lang int, tags array<int>, cost long, memory long, length long, heavy int, over_time int, accepted int, judged boolean"


def records(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = 0 if rng.random() < 0.4 else rng.randrange(1, 5)
        tags = [[], [1], [1, 2], [3], None][p]
        rows.append((i * 3 + rng.randrange(3), p, rng.randrange(4), rng.choice([None, 1, 2]), rng.randrange(2), tags, rng.randrange(1, 50), rng.randrange(9), rng.randrange(99), rng.randrange(2), rng.randrange(2), rng.randrange(2), rng.random() < 0.8))
    return rows


def plain(rows, lag):
    rows = sorted(rows)
    out = {}
    for i, r in enumerate(rows):
        seen = [x for x in rows[: max(0, i - lag)] if x[12]]
        mean = lambda xs, c: sum(x[c] for x in xs) / len(xs) if xs else None
        row = {}
        for name, c in (("p", 1), ("u", 2)):
            xs = [x for x in seen if x[c] == r[c]]
            sd = sqrt(max(sum(x[6] ** 2 for x in xs) / len(xs) - mean(xs, 6) ** 2, 0)) if xs else None
            row |= {f"{name}_n": len(xs), f"{name}_mean": mean(xs, 6), f"{name}_sd": sd, f"{name}_max": max((x[6] for x in xs), default=None), f"{name}_last": xs[-1][6] if xs else None}
            row |= {f"{name}_{n}": mean(xs, c2) for n, c2 in (("heavy_rate", 9), ("limit_rate", 10), ("accept_rate", 11), ("length_mean", 8))}
        row["p_memory_mean"] = mean([x for x in seen if x[1] == r[1]], 7)
        row["u_problems"] = len({x[1] for x in seen if x[2] == r[2]})
        xs = [x for x in seen if x[1:3] == r[1:3]]
        row |= {"up_n": len(xs), "up_last": xs[-1][6] if xs else None, "up_max": max((x[6] for x in xs), default=None), "up_mean": mean(xs, 6), "up_last_accepted": xs[-1][11] if xs else None, "up_last_limit": xs[-1][10] if xs else None}
        same = [x for x in seen if r[3] is not None and x[3] == r[3]]
        for name, xs in (("c", same), ("cu", [x for x in same if x[2] == r[2]]), ("cp", [x for x in same if x[1] == r[1]])):
            row |= {f"{name}_n": len(xs), f"{name}_mean": mean(xs, 6)}
        row["c_heavy_rate"] = mean(same, 9)
        xs = [x for t in r[5] or [] for x in seen if t in (x[5] or [])]
        mine = [x for x in xs if x[2] == r[2]]
        row |= {"tag_n": len(xs), "tag_mean": mean(xs, 6), "tag_heavy_rate": mean(xs, 9), "utag_n": len(mine), "utag_mean": mean(mine, 6)}
        xs = [x for x in seen if x[1] == r[1] and x[4] == r[4]]
        out[r[0]] = row | {"plang_n": len(xs), "plang_mean": mean(xs, 6)}
    return out


@pytest.mark.parametrize("lag", [0, 7])
def test_platform_history_folds_records_in_order(spark, lag):
    rows = records(150, lag)
    got = {r.id: {k: v for k, v in r.asDict().items() if k != "id"} for r in platform.platform_history(spark.createDataFrame(rows, SCHEMA).repartition(5), lag).collect()}
    want = plain(rows, lag)
    assert set(got) == set(want)
    for i, row in want.items():
        assert set(got[i]) == set(row)
        for name, value in row.items():
            assert got[i][name] == (pytest.approx(value, abs=1e-6) if value is not None else None), (i, name)
