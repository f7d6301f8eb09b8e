"""Replaying a trace through k servers that never idle while a job waits.

Jobs are ranked by (arrival, job). At one instant completions come first, then
arrivals, then dispatches; a job's true work is known only once it completes.
All clocks are whole microseconds. First-come-first-served with one server is
a closed form of running windows, and with k servers a fold over each trace;
score-ordered rules run one trace per task in Python, since each choice
depends on all before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .traces import per_trace

SECOND = 1_000_000
#: Rates are fractions over this.
RATE_PARTS = 720_720


# ---------------------------------------------------------------- closed forms
def fluid_backlog(jobs: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """`jobs` with backlog_us: work left just after each arrival if k servers drained it as a fluid."""
    order = Window.partitionBy(*by).orderBy("arrival_us", "job_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.sum("work_us").over(order)
    rows = jobs.withColumn("_p", done)
    low = F.min(F.col("_p") - F.col("work_us") - F.lit(k) * F.col("arrival_us")).over(order)
    return rows.withColumn("backlog_us", F.col("_p") - F.lit(k) * F.col("arrival_us") - low).drop("_p")


def lindley(jobs: DataFrame, by: Sequence[str]) -> DataFrame:
    """`jobs` with wait_us under first come, first served and one server."""
    return fluid_backlog(jobs, by, 1).withColumn("wait_us", F.col("backlog_us") - F.col("work_us")).drop("backlog_us")


def fcfs(jobs: DataFrame, by: Sequence[str], k: int | str) -> DataFrame:
    """(by, job_id, wait_us) under first come, first served with k servers, or as many as a column of that name says for a trace.

    A fold per trace keeps the sorted times at which servers become free. It
    gathers a trace, so traces must be of bounded length; longer ones go
    through replay().
    """
    rows = jobs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("arrival_us", "job_id", "work_us"))).alias("_jobs"), (F.max(k) if isinstance(k, str) else F.lit(k)).cast("int").alias("_k"))
    none = "array<struct<job_id:bigint,wait_us:bigint>>"
    start = F.struct(F.transform(F.sequence(F.lit(1), F.col("_k")), lambda _: F.lit(-(1 << 62)).cast("long")).alias("free"), F.array().cast(none).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = F.greatest(F.element_at(acc["free"], 1), x["arrival_us"])
        free = F.array_sort(F.concat(F.slice(acc["free"], F.lit(2), F.size(acc["free"])), F.array(begin + x["work_us"])))
        row = F.struct(x["job_id"].cast("long").alias("job_id"), (begin - x["arrival_us"]).alias("wait_us"))
        return F.struct(free.alias("free"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = rows.select(*by, F.aggregate("_jobs", start, step, lambda acc: acc["out"]).alias("_out"))
    return folded.select(*by, F.explode("_out").alias("_r")).select(*by, "_r.job_id", "_r.wait_us")


# ---------------------------------------------------------------- rules
@dataclass(frozen=True)
class Rule:
    """A dispatch rule: a base order and what may override it.

    order: fcfs, score or block (`block` ranks at a time, by score within).
    guard: none; work (serve the first job whose overtaken work reached its
    budget); skip (the head once `skips` were dispatched past it); timeout
    (the head once it waited `timeout_us`); channels (the head once `skips`
    short overtakers, of work up to `short_us`, or budget of longer ones);
    refund (budgets reserved at dispatch by `limit_us`, the rest returned at
    completion).
    """

    name: str
    order: str = "score"
    guard: str = "none"
    b0_us: int = 0
    gam_us: int = 0
    eta_k: float = 0.0
    bmax_us: int = 0
    skips: int = 0
    timeout_us: int = 0
    short_us: int = 0
    block: int = 1
    limit_us: int = 60 * SECOND
    report_delay_us: int = 0

    def __post_init__(self) -> None:
        if self.order not in ("fcfs", "score", "block"):
            raise ValueError(f"unknown order {self.order}")
        if self.guard not in ("none", "work", "skip", "timeout", "channels", "refund"):
            raise ValueError(f"unknown guard {self.guard}")
        if self.guard == "skip" and self.skips < 1 or self.block < 1 or self.eta_k < 0 or min(self.b0_us, self.gam_us, self.bmax_us) < 0:
            raise ValueError(f"{self.name}: parameters out of range")


def cap_for_promise(promise_s: float, k: int, limit_s: float = 60.0) -> float:
    """The largest budget under which no job waits `promise_s` longer than in arrival order."""
    floor = (3 - 2 / k) * limit_s
    if promise_s <= floor:
        raise ValueError(f"a promise of {promise_s} s isn't above {floor} s, the least that any such rule can keep")
    return k * (promise_s - floor)


def skips_for_promise(promise_s: float, k: int, limit_s: float = 60.0) -> int:
    n = int(np.floor(promise_s * k / limit_s - (2 * k - 2) + 1e-9))
    if n < 1:
        raise ValueError(f"a promise of {promise_s} s admits no skip")
    return n


def _us(seconds: float) -> int:
    return int(round(seconds * SECOND))


def fcfs_rule() -> Rule:
    return Rule("FCFS", order="fcfs")


def score_rule(name: str = "SPJF") -> Rule:
    return Rule(name)


def guard_rule(promise_s: float, k: int, b0_s: float, eta: float = 0.0, gam_s: float = 0.0, limit_s: float = 60.0, name: str | None = None) -> Rule:
    cap = cap_for_promise(promise_s, k, limit_s)
    return Rule(name or f"Guard({promise_s:g})", guard="work", b0_us=_us(min(b0_s, cap)), gam_us=_us(max(gam_s, 0.0)), eta_k=eta * k, bmax_us=_us(cap))


def fixed_rule(promise_s: float, k: int, b0_s: float | None = None, limit_s: float = 60.0) -> Rule:
    cap = cap_for_promise(promise_s, k, limit_s)
    return Rule(f"Fixed({promise_s:g})", guard="work", b0_us=_us(cap if b0_s is None else min(b0_s, cap)), bmax_us=_us(cap))


def skip_rule(promise_s: float, k: int, limit_s: float = 60.0) -> Rule:
    return Rule(f"Skip({promise_s:g})", guard="skip", skips=skips_for_promise(promise_s, k, limit_s))


def timeout_rule(seconds: float) -> Rule:
    return Rule(f"Timeout({seconds:g})", guard="timeout", timeout_us=_us(seconds))


def block_rule(width: int) -> Rule:
    return Rule(f"Block({width})", order="block", block=width)


def channels_rule(short_s: float, count: int, b0_s: float) -> Rule:
    return Rule(f"Channels({short_s:g},{count})", guard="channels", short_us=_us(short_s), skips=count, b0_us=_us(b0_s))


def refund_rule(b0_s: float, limit_s: float = 60.0) -> Rule:
    return Rule(f"Refund({b0_s:g})", guard="refund", b0_us=_us(b0_s), limit_us=_us(limit_s))


def aged(score: Column, arrival_us: Column, first_us: Column, credit_per_s: float) -> Column:
    """A score less a credit for waiting, as a static order: what all lose together doesn't count."""
    return score + F.lit(credit_per_s) * (arrival_us - first_us) / F.lit(float(SECOND))


class _Sums:
    """Prefix sums under point updates."""

    def __init__(self, n: int):
        self.tree, self.total = [0] * (n + 1), 0

    def add(self, i: int, x: int) -> None:
        self.total += x
        i += 1
        while i < len(self.tree):
            self.tree[i] += x
            i += i & -i

    def above(self, i: int) -> int:
        """Sum over places greater than i."""
        out, i = self.total, i + 1
        while i:
            out -= self.tree[i]
            i -= i & -i
        return out


def simulate(arrival: Sequence[int], service: Sequence[int], score: Sequence[float], k: int | Sequence[tuple[int, int]], rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(wait, place in dispatch order, forced) of each job; jobs come ranked.

    `k` is a number, or steps (from when, how many) of a varying capacity:
    what runs is never stopped. Forced are dispatches by the guard.
    """
    if isinstance(k, int) and rule.guard == "none":
        return _simulate_plain(arrival, service, score, k, rule)
    n = len(arrival)
    wait, place, forced = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    steps = [(-(1 << 62), k)] if isinstance(k, int) else sorted(k)
    rate = Fraction(round(rule.eta_k * RATE_PARTS), RATE_PARTS)
    num, den = rate.numerator, rate.denominator
    charge, count = _Sums(n), _Sums(n)  # overtaking work, and overtakers, by rank
    budget = [0] * n
    key = (lambda i: (i // rule.block, score[i], i)) if rule.order == "block" else (lambda i: (score[i], i))
    served = bytearray(n)
    heap: list = []
    running: list[tuple[int, int]] = []
    reports: list[tuple[int, int]] = []
    by_rank: list[int] = []  # waiting jobs by rank, with served ones to be skipped at the front
    head = waiting = arrived = done = step = 0
    servers = steps[0][1]
    t, never = -(1 << 62), 1 << 62

    def over(q: int) -> int:
        return charge.above(q)

    def fired() -> int:
        first = by_rank[head]
        if rule.guard == "timeout":
            return first if t - arrival[first] >= rule.timeout_us else -1
        if rule.guard == "skip":
            return first if count.above(first) >= rule.skips else -1
        if rule.guard == "channels":
            return first if count.above(first) >= rule.skips or over(first) >= rule.b0_us else -1
        # what has overtaken never grows with rank, so the head's is the most there is
        most = over(first)
        if most < rule.b0_us and (rule.bmax_us == 0 or most < rule.bmax_us):
            return -1
        if rule.bmax_us and most >= rule.bmax_us:
            return first
        for p in range(head, len(by_rank)):
            q = by_rank[p]
            if served[q]:
                continue
            own = over(q)
            if own * den >= budget[q] * den + num * (t - arrival[q]):
                return q
            if own < rule.b0_us and not rule.b0_us == 0:
                return -1  # later ones have less, and budgets start at b0
        return -1

    while done < n:
        # the next instant at which anything happens
        ahead = running[0][0] if running else never
        if arrived < n and arrival[arrived] < ahead:
            ahead = arrival[arrived]
        if reports and reports[0][0] < ahead:
            ahead = reports[0][0]
        if step + 1 < len(steps) and steps[step + 1][0] < ahead:
            ahead = steps[step + 1][0]
        if ahead != never and ahead > t:
            t = ahead
        while step + 1 < len(steps) and steps[step + 1][0] <= t:
            step += 1
            servers = steps[step][1]
        while running and running[0][0] <= t:
            end, c = heapq.heappop(running)
            if rule.report_delay_us and end + rule.report_delay_us > t:
                heapq.heappush(reports, (end + rule.report_delay_us, c))
            else:
                heapq.heappush(reports, (end, c))
        while reports and reports[0][0] <= t:
            _, c = heapq.heappop(reports)
            if rule.guard == "work" or rule.guard == "channels" and service[c] > rule.short_us:
                charge.add(c, service[c])
            elif rule.guard == "channels":
                count.add(c, 1)
            elif rule.guard == "refund":
                charge.add(c, service[c] - rule.limit_us)
        while arrived < n and arrival[arrived] <= t:
            own = rule.b0_us + rule.gam_us * waiting
            budget[arrived] = min(own, rule.bmax_us) if rule.bmax_us else own
            by_rank.append(arrived)
            if rule.order != "fcfs":
                heapq.heappush(heap, key(arrived))
            waiting += 1
            arrived += 1
        while waiting and len(running) < servers:
            while served[by_rank[head]]:
                head += 1
            j = by_rank[head] if rule.order == "fcfs" else (fired() if rule.guard != "none" else -1)
            if j < 0:
                while served[heap[0][-1]]:
                    heapq.heappop(heap)
                j = heapq.heappop(heap)[-1]
            else:
                forced[j] = rule.order != "fcfs"
            served[j] = 1
            waiting -= 1
            wait[j], place[j] = t - arrival[j], done
            done += 1
            if rule.guard == "skip":
                count.add(j, 1)
            elif rule.guard == "refund":
                charge.add(j, rule.limit_us)
            heapq.heappush(running, (t + service[j], j))
    return wait, place, forced


def _simulate_plain(arrival: Sequence[int], service: Sequence[int], score: Sequence[float], k: int, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rule without a guard: from dispatch to dispatch, when a server is free and a job has come."""
    n = len(arrival)
    if rule.order == "fcfs":
        rank = range(n)
    else:
        keys = (np.arange(n), np.asarray(score, float)) + ((np.arange(n) // rule.block,) if rule.order == "block" else ())
        rank = np.empty(n, np.int64)
        rank[order := np.lexsort(keys)] = np.arange(n)
        rank, back = rank.tolist(), order.tolist()
    start, place = [0] * n, [0] * n
    t = -(1 << 62)
    free, heap, arrived = [t] * k, [], 0
    push, pop, put = heapq.heappush, heapq.heappop, heapq.heapreplace
    for done in range(n):
        if free[0] > t:
            t = free[0]
        if not heap and arrival[arrived] > t:
            t = arrival[arrived]
        while arrived < n and arrival[arrived] <= t:
            push(heap, rank[arrived])
            arrived += 1
        j = pop(heap)
        if rule.order != "fcfs":
            j = back[j]
        start[j], place[j] = t, done
        put(free, t + service[j])
    return np.array(start, np.int64) - np.array(arrival, np.int64), np.array(place, np.int64), np.zeros(n, bool)


def simulate_closed(user: Sequence, think: Sequence[int], service: Sequence[int], score: Sequence[float], first: Sequence[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(arrival, wait) where a user's next job comes `think` after the last one's result.

    `first` holds when each user's first job comes; jobs are in each user's order.
    """
    n = len(service)
    after: dict[int, int] = {}
    last: dict = {}
    coming: list[tuple[int, int]] = []
    for i, u in enumerate(user):
        if u in last:
            after[last[u]] = i
        else:
            heapq.heappush(coming, (first[i], i))
        last[u] = i
    arrival, wait = np.zeros(n, np.int64), np.zeros(n, np.int64)
    running: list[tuple[int, int]] = []
    heap: list[tuple[float, int]] = []
    t = -(1 << 62)
    done = 0
    while done < n:
        t = max(t, min(x[0][0] for x in (running, coming) if x))
        while running and running[0][0] <= t:
            end, c = heapq.heappop(running)
            if c in after:
                heapq.heappush(coming, (end + think[after[c]], after[c]))
        while coming and coming[0][0] <= t:
            at, i = heapq.heappop(coming)
            arrival[i] = at
            heapq.heappush(heap, (score[i], i))
        while heap and len(running) < k:
            _, j = heapq.heappop(heap)
            wait[j] = t - arrival[j]
            heapq.heappush(running, (t + service[j], j))
            done += 1
    return arrival, wait


def uniform(seed: int, job: int, attempt: int) -> float:
    """A keyed draw in (0, 1)."""
    mask = (1 << 64) - 1
    x = (seed * 0x9E3779B97F4A7C15 + job * 0xBF58476D1CE4E5B9 + attempt * 0x94D049BB133111EB) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53 + 2.0**-54


def simulate_abandon(arrival: Sequence[int], service: Sequence[int], score: Sequence[float], k: int, patience_us: float, again: float, back_us: int, seed: int = 0, most: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(wait of the last attempt, attempts, served): jobs leave after an exponential patience and may come back."""
    n = len(arrival)
    events: list[tuple[int, int, int, int]] = [(a, 1, i, 0) for i, a in enumerate(arrival)]
    heapq.heapify(events)  # (when, 0 completion / 1 arrival / 2 patience over, job, attempt)
    heap: list[tuple[float, int, int]] = []
    came, attempts, state = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int8)  # 1 waits, 2 served, 3 gone
    wait = np.zeros(n, np.int64)
    busy = 0
    while events:
        t = events[0][0]
        while events and events[0][0] == t:
            _, kind, i, attempt = heapq.heappop(events)
            if kind == 0:
                busy -= 1
            elif kind == 1:
                came[i], state[i] = t, 1
                attempts[i] = attempt + 1
                heapq.heappush(heap, (score[i], i, attempt))
                patience = int(-patience_us * np.log(uniform(seed, i, attempt)))
                heapq.heappush(events, (t + max(1, patience), 2, i, attempt))
            elif state[i] == 1 and attempts[i] == attempt + 1:
                wait[i], state[i] = t - came[i], 3
                if attempt + 1 < most and uniform(seed + 1, i, attempt) < again:
                    heapq.heappush(events, (t + back_us, 1, i, attempt + 1))
        while heap and busy < k:
            _, i, attempt = heapq.heappop(heap)
            if state[i] == 1 and attempts[i] == attempt + 1:
                wait[i], state[i] = t - came[i], 2
                busy += 1
                heapq.heappush(events, (t + service[i], 0, i, attempt))
    return wait, attempts, state == 2


def simulate_backfill(arrival: Sequence[int], service: Sequence[int], estimate: Sequence[int], k: int, slack_us: int = 0) -> np.ndarray:
    """Waits under backfilling: every job holds a reservation on the profile of estimates.

    At each event the waiting jobs are placed anew in arrival order; with
    `slack_us` a shorter job may push a reservation back by that much in all.
    """
    n = len(arrival)
    wait = np.zeros(n, np.int64)
    promised: dict[int, int] = {}
    running: list[tuple[int, int, int]] = []  # (true end, estimated end, job)
    waiting: list[int] = []
    arrived = done = 0
    t = -(1 << 62)

    def place(order: Sequence[int]) -> dict[int, int]:
        steps = [max(e, t + 1) for _, e, _ in running]
        used: list[tuple[int, int]] = [(t, e) for e in steps]
        out = {}
        for j in order:
            for s in sorted({t, *(e for _, e in used)}):
                points = [s, *(a for a, _ in used if s < a < s + estimate[j])]
                if all(sum(a <= p < b for a, b in used) < k for p in points):
                    out[j] = s
                    used.append((s, s + max(1, estimate[j])))
                    break
        return out

    while done < n:
        t = max(t, min([x[0] for x in running[:1]] + ([arrival[arrived]] if arrived < n else [])))
        while running and running[0][0] <= t:
            heapq.heappop(running)
        while arrived < n and arrival[arrived] <= t:
            waiting.append(arrived)
            arrived += 1
        again = True
        while again and waiting and len(running) < k:
            again = False
            starts = place(waiting)
            for j in waiting:
                promised[j] = min(promised.get(j, starts[j]), starts[j])
            ready = [j for j in waiting if starts[j] <= t]
            if slack_us:
                for j in sorted(waiting, key=lambda x: (estimate[x], x)):
                    if j not in ready:
                        moved = place([j, *(x for x in waiting if x != j)])
                        if moved[j] <= t and all(moved[x] <= promised[x] + slack_us for x in waiting if x != j):
                            ready = [j]
                            break
            if ready:
                j = ready[0]
                waiting.remove(j)
                wait[j] = t - arrival[j]
                heapq.heappush(running, (t + service[j], t + estimate[j], j))
                done += 1
                again = True
    return wait


# ---------------------------------------------------------------- Spark operator
def replay(jobs: DataFrame, by: Sequence[str], k: int, rules: Sequence[Rule], score: str = "score") -> DataFrame:
    """(by, policy, job_id, wait_us, place, forced) of each trace under each rule.

    A trace under a rule is one task's work, since a choice depends on all
    before it; traces and rules run side by side. The few rules are a small
    table that multiplies the traces.
    """
    known = {r.name: r for r in rules}
    if len(known) != len(rules):
        raise ValueError("rules need names of their own")
    names = F.explode(F.array(*(F.lit(n) for n in known))).alias("policy")
    rows = jobs.select(*by, "job_id", "arrival_us", "work_us", F.col(score).cast("double").alias("_score"), names)

    def run(x: dict[str, np.ndarray]) -> Sequence[np.ndarray]:
        return simulate(x["arrival_us"].tolist(), x["work_us"].tolist(), x["_score"].tolist(), k, known[x["policy"][0]])

    return per_trace(rows, [*by, "policy"], ["arrival_us", "job_id"], [*by, "policy", "job_id"], run, "wait_us long, place long, forced boolean")


# ---------------------------------------------------------------- bounds
def guard_bound(wait_fcfs_us: Column, rule: Rule, k: int, limit_s: float = 60.0) -> Column:
    """The longest wait a rule may cause a job, in microseconds, from its wait in arrival order."""
    base = wait_fcfs_us.cast("double")
    if rule.guard == "skip":
        return base + F.lit(limit_s * (rule.skips + 2 * k - 2) / k * SECOND)
    if rule.guard != "work":
        raise ValueError(f"{rule.name} has no such bound")
    const = (3 - 2 / k) * limit_s * SECOND
    by_cap = base + F.lit(rule.bmax_us / k + const)
    if rule.gam_us:
        if not rule.bmax_us:
            raise ValueError(f"{rule.name}: a budget that grows with the queue needs a cap")
        return by_cap
    eta = rule.eta_k / k
    if eta >= 1:
        raise ValueError("the rate must be under 1")
    by_rate = (base + F.lit(rule.b0_us / k + const)) / F.lit(1 - eta)
    return F.least(by_rate, by_cap) if rule.bmax_us else by_rate


def bound_usage(waits: DataFrame, reference: DataFrame, by: Sequence[str], rule: Rule, k: int, limit_s: float = 60.0) -> DataFrame:
    """(by, jobs, violations, worst_excess_us) of one rule's waits against arrival order."""
    own = waits.where(F.col("policy") == rule.name).select(*by, "job_id", "wait_us")
    both = own.join(reference.select(*by, "job_id", F.col("wait_us").alias("fcfs_us")), [*by, "job_id"])
    over = F.col("wait_us") > guard_bound(F.col("fcfs_us"), rule, k, limit_s)
    return both.groupBy(*by).agg(F.count("*").alias("jobs"), F.count_if(over).alias("violations"), F.max(F.col("wait_us") - F.col("fcfs_us")).alias("worst_excess_us"))


def queue_lengths(schedule: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, job_id, queue): jobs waiting at each dispatch, the dispatched one included.

    `schedule` holds arrival_us, wait_us and place; who has come less who has
    gone, from one sorted stream of arrivals and starts.
    """
    legs = schedule.select(*by, F.col("arrival_us").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("job_id"), F.lit(None).cast("long").alias("place")).unionByName(
        schedule.select(*by, (F.col("arrival_us") + F.col("wait_us")).alias("_at"), F.lit(1).alias("_kind"), "job_id", F.col("place").cast("long").alias("place"))
    )
    come = F.sum(1 - F.col("_kind")).over(Window.partitionBy(*by).orderBy("_at", "_kind", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return legs.withColumn("_come", come).where("_kind = 1").select(*by, "job_id", (F.col("_come") - F.col("place")).alias("queue"))


def queue_weights(schedule: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, queue_total, queue_forced, forced_share): queue lengths at dispatch, summed, and what of them the guard's dispatches met."""
    rows = schedule.join(queue_lengths(schedule, by), [*by, "job_id"])
    forced, queue = F.col("forced").cast("long"), F.col("queue")
    return rows.groupBy(*by).agg(F.sum(queue).alias("queue_total"), F.sum(queue * forced).alias("queue_forced"), F.try_divide(F.sum(queue * forced), F.sum(queue)).alias("forced_share"))


def rank_displacement(schedule: DataFrame, by: Sequence[str], score: str, corrected: str) -> DataFrame:
    """(by, job_id, moved): by how many places a job's rank in its queue at dispatch moves under corrected scores.

    All jobs get their corrected score (that of others equals the score) while
    the queues stay as they were. `schedule` holds arrival_us, wait_us and
    place; ties go to the earlier job. A trace is one group.
    """
    def run(x: dict[str, np.ndarray]) -> Sequence[np.ndarray]:
        n = len(x["place"])
        ranks = []
        for name in (score, corrected):
            rank = np.empty(n, np.int64)
            rank[np.lexsort((np.arange(n), x[name]))] = np.arange(n)
            ranks.append(rank.tolist())
        start = (x["arrival_us"] + x["wait_us"]).tolist()
        arrival, trees, moved, come = x["arrival_us"].tolist(), (_Sums(n), _Sums(n)), [0] * n, 0
        for j in np.argsort(x["place"], kind="stable").tolist():
            while come < n and arrival[come] <= start[j]:
                for tree, rank in zip(trees, ranks, strict=True):
                    tree.add(rank[come], 1)
                come += 1
            old, new = (tree.total - tree.above(rank[j] - 1) if rank[j] else 0 for tree, rank in zip(trees, ranks, strict=True))
            moved[j] = new - old
            for tree, rank in zip(trees, ranks, strict=True):
                tree.add(rank[j], -1)
        return [np.array(moved, np.int64)]

    wanted = schedule.select(*by, "job_id", "arrival_us", "wait_us", "place", score, corrected)
    return per_trace(wanted, by, ["arrival_us", "job_id"], [*by, "job_id"], run, "moved long")


def overtaking(schedule: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, job_id, in_us, out_us): work that overtook each job, and that it overtook.

    `schedule` holds arrival_us, job_id, work_us, place. Two-dimensional
    dominance in one pass per trace with prefix sums; a trace is one group.
    """
    def run(x: dict[str, np.ndarray]) -> Sequence[np.ndarray]:
        n = len(x["place"])
        work = x["work_us"].tolist()
        seen, over, under = _Sums(n), [0] * n, [0] * n
        total = np.concatenate([[0], np.cumsum(x["work_us"])]).tolist()
        for q in np.argsort(x["place"], kind="stable").tolist():
            over[q] = seen.above(q)
            under[q] = total[q] - (seen.total - over[q])
            seen.add(q, work[q])
        return [np.array(over, np.int64), np.array(under, np.int64)]

    return per_trace(schedule.select(*by, "job_id", "arrival_us", "work_us", "place"), by, ["arrival_us", "job_id"], [*by, "job_id"], run, "in_us long, out_us long")
