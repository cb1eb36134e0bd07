"""Problem 1 on small fixtures."""

from lumenarray.operators import history

PROFILE = "array_id string, thresholds_json string, snr50 double, updated double, entity string, prev int"
COPY = "array_id string, thresholds_json string, snr50 double, archived_at double, at int"


def versions(spark, profiles, copies):
    v = history.profile_versions(spark.createDataFrame([(*p, "x", 1) for p in profiles], PROFILE), spark.createDataFrame([(*c, 1) for c in copies], COPY))
    return [(r.array_id, r.valid_from, r.valid_to, r.thresholds, r.snr50) for r in v.orderBy("array_id", "valid_from").collect()]


def test_versions_begin_and_return(spark):
    got = versions(
        spark,
        [("a", '{"t": 4, "u": 1.0}', 2.0, 10.0), ("a", '{"u":1,"t":4.0}', 2.0, 20.0), ("a", '{"t": 5, "u": 1}', 2.0, 40.0), ("a", '{"t": 4, "u": 1}', 2.0, 60.0), ("a", None, None, 50.0), ("a", "{broken", 2.0, 55.0)],
        [("a", '{"t":4,"u":1}', 2.0, 35.0), ("a", '{"t":4,"u":1}', 2.0, 35.0)],
    )
    same = '{"t":4,"u":1}'
    # the copy at 35 closes the first version; the second is known from 40 and ends with a snapshot at 60
    assert got == [("a", 10.0, 35.0, same, "2.0"), ("a", 35.0, 60.0, '{"t":5,"u":1}', "2.0"), ("a", 60.0, None, same, "2.0")]


def test_one_attribute_and_nulls(spark):
    got = versions(spark, [("a", None, 1.0, 1.0), ("a", '{"t":1}', 1.0, 2.0), ("a", '{"t":1}', None, 3.0), (None, '{"t":1}', 1.0, 1.0), ("a", '{"t":9}', 1.0, None)], [])
    assert got == [("a", 1.0, 2.0, None, "1.0"), ("a", 2.0, 3.0, '{"t":1}', "1.0"), ("a", 3.0, None, '{"t":1}', None)]


def test_copy_and_write_at_one_time(spark):
    got = versions(spark, [("a", '{"t":1}', 1.0, 5.0), ("a", '{"t":2}', 1.0, 9.0)], [("a", '{"t":1}', 1.0, 9.0)])
    assert [g[1] for g in got] == [5.0, 9.0]


def test_a_change_across_buckets(spark):
    s = history.BUCKET_S
    rows = [("a", '{"t":%d}' % (k // 3), 1.0, k * s / 2) for k in range(12)]
    assert [g[1] for g in versions(spark, rows, [])] == [k * s / 2 for k in (0, 3, 6, 9)]


def test_empty(spark):
    assert versions(spark, [], []) == []
