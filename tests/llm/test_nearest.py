"""Problem 6: the streaming join against brute force, and its edges."""

import random

from lumenarray.functions.files import absolute_ms
from lumenarray.llm.nearest import nearest_in_time
from pyspark.sql import functions as F

LEFT, RIGHT = "entity string, left_id string, t_ms bigint", "entity string, right_id string, t_ms bigint"


def run(spark, left, right, **k):
    got = nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), **k).collect()
    return {(r.left_id, r.right_id, r.gap_ms) for r in got}


def test_against_brute_force_in_slices(spark):
    r = random.Random(3)
    left = [(r.choice("ab"), f"l{i}", r.randrange(2_000_000)) for i in range(150)]
    right = [(r.choice("ab"), f"r{i}", r.randrange(2_000_000)) for i in range(200)]
    want = set()
    for e, i, t in left:
        near = [(abs(t - u), j) for f, j, u in right if f == e and abs(t - u) <= 20_000]
        if near:
            want.add((i, min(near)[1], min(near)[0]))
    assert run(spark, left, right) == want
    assert run(spark, left + left[:20], right + right[:20], slice_rows=60) == want  # one day, cut by quantiles
    assert run(spark, [(e, i, t * 300) for e, i, t in left], [(e, i, t * 300) for e, i, t in right], slice_rows=40) == run(spark, [(e, i, t * 300) for e, i, t in left], [(e, i, t * 300) for e, i, t in right])


def test_nulls_ties_and_limits(spark):
    left = [("a", "x", 100_000), (None, "n", 100_000), ("a", None, 1), ("a", "t", None), ("b", "far", 0)]
    right = [("a", "early", 80_000), ("a", "late", 120_000), ("a", "out", 120_001), (None, "n", 100_000), ("b", "far", 20_001)]
    assert run(spark, left, right) == {("x", "early", 20_000)}


def test_many_rows_at_one_instant(spark):
    left, right = [("a", f"l{i}", 50_000) for i in range(40)], [("a", f"r{i}", 50_007) for i in range(40)] + [("a", "far", 50_100)]
    assert run(spark, left, right) == {(f"l{i}", "r0", 7) for i in range(40)}


def test_empty(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("a", "x", 1)], []) == set()


def test_forms_of_time(spark):
    forms = ["2013-01-19T03:29:38.832Z", "2013-01-19T03:29:38.832000", "2013/01/19 03:29:38.832", "2013-01-19 03:29:38,832", "1358566178.832", "2013-01-18T20:29:38.832-07:00", "2013-01-19T12:29:38.832+09:00"]
    df = spark.createDataFrame([(f,) for f in [*forms, "", None, "soon", "2013-01-19"]], "o string").select("o", absolute_ms(F.col("o")).alias("m"))
    assert [r.m for r in df.collect()] == [1358566178832] * 7 + [None] * 4
