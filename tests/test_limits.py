"""Limits, carried prefixes and time joins beside plain loops."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkspan.operators import rollup
from linkspan.operators.carry import carried
from linkspan.operators.limits import admissions, admitted, lockouts, reservations
from linkspan.operators.timejoin import asof_join, interval_join

ZERO = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return ZERO + dt.timedelta(hours=hours)


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("own", [False, True])
def test_carried_prefixes(spark, ahead, own):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", None]), at(r.randrange(200)), r.choice([None, 1, 2, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v long")
    last = "first" if ahead else "last"
    got = carried(df, ["k"], F.date_trunc("day", "ts"), ["ts", "id"], {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "near": (last, F.col("v"))}, own=own, ahead=ahead)
    assert got.columns == ["id", "k", "ts", "v", "s", "n", "hi", "lo", "near"]
    for x in got.collect():
        me = (x.ts, x.id)
        side = [(t, i, v) for i, k, t, v in rows if k == x.k and ((t, i) > me if ahead else (t, i) < me)] + ([(x.ts, x.id, x.v)] if own else [])
        vs = [v for _, _, v in sorted(side, reverse=ahead) if v is not None]
        assert (x.s, x.n, x.hi, x.lo, x.near) == (sum(vs), len(vs), max(vs, default=None), min(vs, default=None), vs[-1] if vs else None)


def fits(rows, most):
    held, out = defaultdict(int), {}
    for ts, i, k, a in sorted(rows, key=lambda r: (r[0], r[1])):
        a = max(a or 0, 0)
        if ok := a == 0 or held[k] + a <= most:
            held[k] += a
        out[i] = (ok, held[k])
    return out


def requests(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, id long, k string, a long")


def test_a_refusal_gives_back(spark):
    rows = [(at(0), 1, "x", 90), (at(1), 2, "x", 50), (at(2), 3, "x", 10), (at(3), 4, "x", None), (at(3), 5, "x", 1), (at(3), 6, None, 100), (at(4), 7, None, 1)]
    for fold in (2000, 0):
        got = {r.id: (r.fits, r.reserved) for r in admitted(requests(spark, rows), ["k"], "ts", "id", "a", 100, fold=fold).collect()}
        assert got == {1: (True, 90), 2: (False, 90), 3: (True, 100), 4: (True, 100), 5: (False, 100), 6: (True, 100), 7: (False, 100)}


@pytest.mark.parametrize("seed", range(4))
def test_phases_by_brute_force(spark, seed):
    r = random.Random(seed)
    sizes = [lambda: r.randint(1, 40), lambda: r.choice([1, 999]), lambda: int(2 ** (r.random() * 11)), lambda: r.choice([None, 0, -5, 3, 400])][seed]
    rows = [(at(r.randrange(24)), i, r.choice("aaab"), sizes()) for i in range(400)]
    # A key in which small and large ones alternate, each large one a little too large.
    rows += [(at(i / 100), 1000 + i, "c", 1 if i % 2 == 0 else 1000 - i // 2) for i in range(300)]
    got = admitted(requests(spark, rows), ["k"], "ts", "id", "a", 1000, fold=[0, 150, 0, 50][seed]).collect()
    assert {x.id: (x.fits, x.reserved) for x in got} == fits(rows, 1000)


def test_admissions(spark):
    rows = [(at(0), 1, 7, "cloud", 60), (at(0), 2, 7, "cloud", 60), (at(0), 3, 7, "cloud", 30), (at(1), 4, 8, "local", 999), (at(1), 5, 8, "local", 1), (at(1), 6, 8, "local", 1), (at(2), 7, 7, "cloud", 1), (at(30), 8, 7, "cloud", 100)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id long, u long, p string, tokens long")
    out = admissions(df, "u", "p", F.col("p") == "cloud", "ts", "id", "tokens", per_day=3, per_minute=2, budget=100)
    got = {r.id: (r.user_count, r.minute_count, r.outcome, r.reserved) for r in out.collect()}
    # 3 is beyond the minute's two, though 2 was refused; 7 is the user's fourth of the day.
    assert got == {
        1: (1, 1, "admitted", 60), 2: (2, 2, "budget", 60), 3: (3, 3, "rate_limit", 60), 4: (1, 1, "admitted", 60), 5: (2, 2, "admitted", 60), 6: (3, 3, "rate_limit", 60),
        7: (4, 1, "user_limit", 60), 8: (1, 1, "admitted", 100),
    }


def locks(rows, most, seconds, guarded):
    out, length = {}, dt.timedelta(seconds=seconds)
    state = defaultdict(lambda: [0, None, None])  # counted, expires, locked until
    for ts, i, k, failed in sorted(rows, key=lambda r: (r[0], r[1])):
        s = state[k]
        if s[1] is not None and ts >= s[1]:
            s[0], s[1] = 0, None
        if s[2] is not None and ts >= s[2]:
            s[2] = None
        if guarded and s[2]:
            out[i] = (most, "refused", s[2])
            continue
        if failed:
            s[0] += 1
            s[1] = s[1] or ts + length
            if s[0] >= most:
                s[2] = ts + length
            out[i] = (s[0], "locked" if s[0] >= most else "failed", s[2])
        else:
            s[:] = 0, None, None
            out[i] = (0, "passed", None)
    return out


def attempts(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, id long, k string, failed boolean")


def test_a_counter_expires_with_its_first_failure(spark):
    rows = [(at(h), i, "x", True) for i, h in enumerate([0, 23, 25, 26])]
    got = lockouts(attempts(spark, rows), "k", "ts", "id", F.col("failed"), 3, 86400).collect()
    assert {r.id: (r.failures, r.outcome) for r in got} == {0: (1, "failed"), 1: (2, "failed"), 2: (1, "failed"), 3: (2, "failed")}
    rows = [(at(h), i, "x", True) for i, h in enumerate([0, 1, 2, 3, 25.5, 26.5, 27.5])]
    got = lockouts(attempts(spark, rows), "k", "ts", "id", F.col("failed"), 3, 86400, guarded=False).collect()
    until = {r.id: (r.outcome, r.locked_until) for r in got}
    assert until[2] == ("locked", at(26)) and until[3] == ("locked", at(27))  # each one renews the lock
    assert until[4] == ("failed", at(27)) and until[6] == ("locked", at(51.5))


@pytest.mark.parametrize(("seed", "most", "hours", "span", "guarded"), [(1, 3, 24, 2000, True), (2, 2, 5, 300, False), (3, 1, 3, 200, True), (4, 4, 1, 60, False), (5, 2, 9, 400, True)])
def test_lockouts_by_brute_force(spark, guarded, seed, most, hours, span):
    r = random.Random(seed)
    rows = [(at(r.randrange(span)), i, r.choice(["hot", "hot", "a", None]), r.choice([True, True, True, False, None])) for i in range(300)]
    got = lockouts(attempts(spark, rows), "k", "ts", "id", F.col("failed"), most, hours * 3600, guarded).collect()
    assert {x.id: (x.failures, x.outcome, x.locked_until) for x in got} == locks(rows, most, hours * 3600, guarded)


@pytest.mark.parametrize("forward", [False, True])
def test_asof_by_brute_force(spark, forward):
    r = random.Random(2)
    left = [(i, r.choice(["a", "b", None]), at(r.randrange(100)) if r.random() < 0.95 else None) for i in range(150)]
    right = [(i, r.choice(["a", "b", None, "c"]), at(r.randrange(100)) if r.random() < 0.95 else None) for i in range(60)]
    l, s = spark.createDataFrame(left, "id long, k string, ts timestamp_ntz"), spark.createDataFrame(right, "price long, k string, since timestamp_ntz")
    for within, hours in ((None, 1e9), ("3 HOURS", 3)):
        got = {x.id: x.price for x in asof_join(l, s, ["k"], "ts", "since", ["price"], right_order="price", forward=forward, within=within).collect()}
        for i, k, t in left:
            ok = [(u, p) for p, q, u in right if q == k and t and u and ((u >= t) if forward else (u <= t))]
            best = (min(ok) if forward else max(ok)) if ok else None
            assert got[i] == (best[1] if best and abs((best[0] - t).total_seconds()) <= hours * 3600 else None)


def test_intervals_by_brute_force(spark):
    r = random.Random(3)
    points = [(i, r.choice("ab"), at(r.randrange(100))) for i in range(120)]
    spans = [(i, r.choice("abc"), at(a := r.randrange(100)), at(a + r.choice([-1, 0, 0.01, 1, 30, 5000]))) for i in range(80)]
    p, s = spark.createDataFrame(points, "id long, k string, ts timestamp_ntz"), spark.createDataFrame(spans, "span long, k string, since timestamp_ntz, until timestamp_ntz")
    want = sorted((i, n) for i, k, t in points for n, q, a, b in spans if k == q and a <= t < b)
    assert sorted((x.id, x.span) for x in interval_join(p, s, ["k"], "ts", "since", "until").collect()) == want
    hit = {i for i, _ in want}
    assert {x.id for x in interval_join(p, s, ["k"], "ts", "since", "until", "left_semi").collect()} == hit
    assert {x.id for x in interval_join(p, s, ["k"], "ts", "since", "until", "left_anti").collect()} == {i for i, _, _ in points} - hit
    assert interval_join(p, s.where("false"), ["k"], "ts", "since", "until").count() == 0
    assert interval_join(p, s.where("false"), ["k"], "ts", "since", "until", "left_anti").count() == 120


def test_states_merge_into_any_range(spark, tmp_path):
    r = random.Random(6)
    rows = [(at(r.random() * 60), r.choice("ab"), r.randrange(3000), r.random() * 100) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k string, u long, v double")
    how = {"step": "30 seconds", "keys": ["k"], "counts": {"all": F.lit(True), "high": F.col("v") > 90}, "sums": {"v": F.col("v")}, "distinct": {"u": F.col("u")}, "quantiles": {"v": F.col("v")}}
    path = str(tmp_path / "states")
    cut = F.lit("2024-01-02 03:00:00").cast("timestamp_ntz")
    rollup.refresh(df.where(F.col("ts") < cut), path, "ts", None, **how)
    rollup.refresh(df, path, "ts", cut, **how)
    made = rollup.read(spark, path)
    start, end = at(5.5), at(50)
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    got = {x.k: x for x in rollup.over(made, ["k"], lit(start), lit(end)).select("k", "count_all", "count_high", "max_v", rollup.estimate("u").alias("u"), rollup.quantile("v", 0.95).alias("p95")).collect()}
    for k in "ab":
        own = sorted(v for t, q, _, v in rows if q == k and start <= t < end)
        users = len({u for t, q, u, _ in rows if q == k and start <= t < end})
        assert (got[k].count_all, got[k].count_high, got[k].max_v) == (len(own), sum(v > 90 for v in own), own[-1])
        assert abs(got[k].u / users - 1) < 4 * 0.016
        assert abs(sum(v <= got[k].p95 for v in own) / len(own) - 0.95) < 0.0133 * 1.5
    windows = rollup.merged(made, ["k"], "1 hour", "30 minutes")
    assert windows.agg(F.sum("count_all")).first()[0] == 2 * len(rows)


def test_no_side_of_an_interval_join_is_broadcast(spark):
    """Whatever Spark takes the sides' sizes for before their rows are put into buckets."""
    p = spark.range(10).selectExpr("id", "1L AS k", "timestamp_seconds(id) AS ts")
    s = spark.range(10).selectExpr("id AS span", "1L AS k", "timestamp_seconds(id) AS since", "timestamp_seconds(id + 3) AS until")
    plan = interval_join(p, s, ["k"], "ts", "since", "until")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_minutes_reserve_and_give_back(spark):
    """By a fold, with crowded seconds, amounts beyond the budget, nothing to give back and no amount; keys may be null."""
    r = random.Random(9)
    rows = [(i, r.choice(["a", "b", None]), ZERO + dt.timedelta(milliseconds=r.choice([0, 1, 900, 1000, 5000, r.randrange(60_000)])), r.choice([None, 0, 3, 10, 25, 60, 61, -7, -30, -200])) for i in range(600)]
    want, held = {}, {}
    for i, k, t, a in sorted(rows, key=lambda x: (x[2], x[0])):
        a, h = a or 0, held.get(k, 0)
        ok = a <= 0 or h + a <= 60
        held[k] = max(h + a, 0) if ok else h
        want[i] = (ok, held[k])
    got = reservations(spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, a int"), ["k"], "ts", "id", "a", 60)
    assert {x.id: (x.fits, x.reserved) for x in got.collect()} == want
