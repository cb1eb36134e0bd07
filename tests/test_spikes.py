"""Problem 5 on small fixtures."""

import math
import random

from lumenarray.operators.spikes import implausible

SCHEMA = "source string, field string, key string, at bigint, reading double, ok boolean, own string, middle int"


def flags(spark, rows, **k):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return {(r.source, r.key): r.kind for r in implausible(df, **k).collect()}


def usual(source, n, seed=1):
    r = random.Random(seed)
    return [(source, "x", f"k{i:05d}", i * 3600, math.exp(r.gauss(1, 0.3)), True) for i in range(n)]


def test_kinds(spark):
    rows = usual("a", 400)
    rows[50] = ("a", "x", "k00050", 50 * 3600, 500.0, True)
    rows[60] = ("a", "x", "k00060", 60 * 3600, -1.0, False)
    rows[70] = ("a", "x", "k00070", 70 * 3600, float("nan"), False)
    for i in range(100, 104):
        rows[i] = ("a", "x", f"k{i:05d}", i * 3600, 2.5 + 0.001 * (i % 2), True)
    rows += [("a", "x", "null", 5, None, None), (None, "x", "k", 1, 1.0, True)]
    want = {("a", "k00050"): "spike", ("a", "k00060"): "impossible", ("a", "k00070"): "impossible", **{("a", f"k{i:05d}"): "stuck" for i in range(100, 104)}}
    assert flags(spark, rows) == want
    assert flags(spark, rows, segment_rows=7) == want  # runs across segments are found too


def test_three_alike_are_not_stuck(spark):
    rows = usual("a", 60)
    for i in (20, 21, 22):
        rows[i] = ("a", "x", f"k{i:05d}", i * 3600, 2.5, True)
    assert flags(spark, rows) == {}


def test_nulls_do_not_part_a_run(spark):
    rows = usual("a", 60)
    for i in (20, 21, 23, 24):
        rows[i] = ("a", "x", f"k{i:05d}", i * 3600, 2.5, True)
    rows[22] = ("a", "x", "k00022", 22 * 3600, None, None)
    assert set(flags(spark, rows).values()) == {"stuck"}


def test_constant_and_single_and_empty(spark):
    assert set(flags(spark, [("c", "x", f"k{i}", i, 1.0, True) for i in range(9)]).values()) == {"stuck"}
    assert flags(spark, [("s", "x", "k", 1, 1.0, True)]) == {}
    assert flags(spark, []) == {}


def walk(n, step, noise, seed):
    r, level, out = random.Random(seed), 2.0, []
    for _ in range(n):
        level += r.gauss(0, step)
        out.append(math.exp(level + r.gauss(0, noise)))
    return out


def source(values, name="a"):
    return [(name, "x", f"k{i:05d}", i * 600, v, True) for i, v in enumerate(values)]


def test_segments_do_not_change_the_flags(spark):
    values = walk(1300, 0.02, 0.1, 4)
    values = [v * (20 if i >= 1000 else 1) * (9 if i % 97 == 5 else 1) for i, v in enumerate(values)]
    rows = source(values) + [("b", "x", f"k{i:05d}", 0, v, True) for i, v in enumerate(walk(300, 0.05, 0.1, 5))]  # one instant
    got = [flags(spark, rows, segment_rows=n) for n in (13, 100, 400, 20_000)]
    assert got[0] and all(g == got[0] for g in got)
    spikes = {int(k[1:]) for s, k in got[0] if s == "a"}
    assert {i for i in range(1300) if i % 97 == 5} - {5, 1000} <= spikes
    assert len([i for i in spikes if i > 1000 and i % 97 != 5]) <= 8  # a new level is taken up


def test_a_drifting_source_hides_no_local_spike(spark):
    r = random.Random(6)
    values = [math.exp(1 + 0.004 * i + r.gauss(0, 0.05)) for i in range(1000)]
    values[500] *= math.exp(0.6)  # twelve times the noise, well within the whole source's range
    assert flags(spark, source(values)) == {("a", "k00500"): "spike"}


def test_stillness_is_relative_to_the_source(spark):
    r = random.Random(7)
    values = [math.exp(r.gauss(7, 0.2)) for _ in range(300)]
    for i in range(120, 126):
        values[i] = 1340 * (1 + 1e-5 * (i % 2))
    got = flags(spark, source(values))
    assert got == {("a", f"k{i:05d}"): "stuck" for i in range(120, 126)}
    assert flags(spark, source([3.3 * math.exp(r.gauss(0, 1e-3)) for _ in range(60)])) == {}


def test_innovations_against_a_loop():
    import numpy as np

    from lumenarray.operators.spikes import MEMORY, SHIFT, innovations

    r = np.random.default_rng(8)
    y = r.normal(0, 1, 300) + np.where(np.arange(300) > 180, 15, 0)
    y[[20, 21, 90, 250]] += [30, -30, 12, 40]
    y[[40, 41, 130]] = np.nan
    middle, noise, drift, start, threshold = 0.1, 0.9, 0.01, 0.2, 6.0
    got = innovations(y, 0, middle, noise, drift, start, threshold)
    for i in range(300):
        level, var, streak, side = middle, start, 0, 0
        before = [np.nan] * max(0, MEMORY - i) + y[max(0, i - MEMORY) : i].tolist()
        for x in before:
            var += drift
            if np.isnan(x):
                continue
            e = x - level
            if abs(e) > threshold * np.sqrt(var + noise):
                streak = streak + 1 if np.sign(e) == side else 1
                side = np.sign(e)
                if streak >= SHIFT:
                    level, var, streak = x, noise, 0
                continue
            gain = var / (var + noise)
            level, var, streak = level + gain * e, var * (1 - gain), 0
        want = (y[i] - level) / np.sqrt(var + drift + noise)
        assert np.isnan(want) and np.isnan(got[i]) or abs(want - got[i]) < 1e-9


def test_a_hot_slice_is_numbered_in_parts(spark):
    from lumenarray.operators.ordered import numbered

    rows = [("a", k % 2, float((k * 37) % 500), f"k{k}") for k in range(900)] + [("b", 0, 7.0, "k")]
    df = spark.createDataFrame(rows, "s string, f int, at double, key string")
    got = numbered(df, ["s", "f"], "at", ["at", "key"], "place", slice_s=100, hot_rows=40).collect()
    for s, f in {(r.s, r.f) for r in got}:
        mine = sorted((r.at, r.key, r.place) for r in got if (r.s, r.f) == (s, f))
        assert [p for *_, p in mine] == list(range(len(mine)))
