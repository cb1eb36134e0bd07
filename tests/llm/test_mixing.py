"""Problem 8: shares, repeats and the budget, against a plain simulation."""

import random

import pytest

from lumenarray.llm import mixing

DOCS, TARGETS = "doc_id bigint, text string, source string, tokens int, copy int", "source string, target_share double, max_repeats int, weight int"


def tables(spark, docs, targets):
    return spark.createDataFrame([(*d, 1, 1) for d in docs], DOCS), spark.createDataFrame([(*t, 1) for t in targets], TARGETS)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    docs = [(i, "word " * r.randrange(1, 60), r.choice(["big"] * 6 + ["Small-Source"])) for i in range(600)]
    return docs + [(1000, None, "big"), (1001, "", "big"), (1002, "a b c", None), (1003, "a b c d", "untargeted"), (None, "x", "big")]


TARGETS_ROWS = [("big", 0.6, 1), ("small_source", 0.3, 3), ("absent", 0.1, 2), (None, 0.5, 1)]


@pytest.mark.parametrize("bucket_rows", [20_000, 17])
def test_against_one_queue(spark, corpus, bucket_rows):
    d, t = tables(spark, corpus, TARGETS_ROWS)
    rows = mixing.mix(d, t, bucket_rows=bucket_rows).collect()
    encode = mixing.encoding(mixing.VOCABULARY).encode_ordinary
    budget = sum(len(encode(x)) for i, x, _ in corpus if i is not None and x)
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    assert all(r.copy <= (1 if r.source == "big" else 3) for r in rows)
    # the order is that of finish times, each source's being its tokens so far over its weight
    rows.sort(key=lambda r: r.ends_at)
    total, so_far = 0, {"big": 0, "small_source": 0}
    finish = -1.0
    for r in rows:
        total, so_far[r.source] = total + r.tokens, so_far[r.source] + r.tokens
        assert r.ends_at == total and r.finish >= finish
        assert abs(r.finish - so_far[r.source] / {"big": 0.6, "small_source": 0.3}[r.source]) < 1e-6
        finish = r.finish
    assert total <= budget
    small = sum(len(encode(x)) for i, x, s in corpus if s == "Small-Source")
    used = {s: sum(r.tokens for r in rows if r.source == s) for s in so_far}
    assert used["small_source"] <= 3 * small
    assert total > budget - 200 or used["small_source"] == 3 * small


def test_shares(spark, corpus):
    d, t = tables(spark, corpus, TARGETS_ROWS)
    got = {r.source: r for r in mixing.shares(d, t, mixing.mix(d, t)).collect()}
    assert set(got) == {"big", "small_source", "absent"} and got["absent"].tokens == 0
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9


def test_empty(spark):
    d, t = tables(spark, [], [])
    assert mixing.mix(d, t).count() == 0
    d, t = tables(spark, [(1, "a", "s")], [])
    assert mixing.mix(d, t).count() == 0


def test_copies_beyond_the_budget_are_never_made():
    import random

    from lumenarray.llm.mixing import needed_copies

    r = random.Random(4)
    for _ in range(300):
        docs = {s: [r.randint(1, 60) for _ in range(r.randint(1, 12))] for s in "abcd"[: r.randint(1, 4)]}
        weight, repeats = {s: r.uniform(0.05, 1) for s in docs}, {s: r.randint(1, 6) for s in docs}
        budget = r.randint(1, 2 * sum(map(sum, docs.values())))
        queue = []
        for s, sizes in docs.items():
            c = 0
            for copy in range(1, repeats[s] + 1):
                for x in sizes:
                    c += x
                    queue.append((c / weight[s], s, copy, x))
        most, total = {}, 0
        for _, s, copy, x in sorted(queue):
            total += x
            if total > budget:
                break
            most[s] = max(most.get(s, 0), copy)
        got = dict(needed_copies([(s, sum(x), max(x), weight[s], repeats[s]) for s, x in docs.items()], budget))
        assert all(got[s] >= n for s, n in most.items()) and all(1 <= got[s] <= repeats[s] for s in docs)
