"""Problem 7: the distance against dynamic programming, and small corpora."""

import random

import numpy as np

from lumenarray.llm import leakage
from lumenarray.llm.text import words


def least_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(4)
    cases = [([rng.randrange(5) for _ in range(rng.randrange(1, 31))], [rng.randrange(6) for _ in range(rng.randrange(1, 50))]) for _ in range(300)]
    m, n = 30, 50
    p, t = np.full((len(cases), m), -2), np.full((len(cases), n), -3)
    for k, (a, b) in enumerate(cases):
        p[k, : len(a)], t[k, : len(b)] = a, b
    got, _ = leakage.myers(p, np.array([len(a) for a, _ in cases]), t)
    assert got.tolist() == [min(len(a), least_distance(a, b)) for a, b in cases]


def vocabulary(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def pairs(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in leakage.find(d, e).collect()}


def test_altered_passages_short_quotes_and_formulas(spark):
    w = vocabulary(4000, 1)
    formula = " ".join(w[3000:3030])
    items = [(k, " ".join(w[k * 100 : k * 100 + 100])) for k in range(4)]
    items += [(k, " ".join(w[1000 + k * 50 : 1050 + k * 50]) + " " + formula) for k in range(4, 8)]
    leak = w[120:160]
    dirty = [x.upper() + "," if i % 9 == 0 else "misread" if i % 13 == 5 else x for i, x in enumerate(leak)]
    split = " ".join(leak[:20]) + " (Applause) [A member: no!] " + leak[20][:3] + "-\n" + leak[20][3:] + " " + " ".join(leak[21:])
    around = " ".join(w[2000:2050])
    docs = [(1, around + " " + " ".join(dirty) + " " + around), (2, split), (3, around + " ".join(w[100:109])), (4, formula + " " + around), (5, None), (6, ""), (7, " ".join(reversed(leak))), (None, " ".join(leak)), (8, " ".join(w[300:330]))]
    docs += [(9, " ".join(leak)), (9, " ".join(leak)), (10, (around + " ") * 400 + " ".join(leak))]
    assert pairs(spark, docs, items) == {(1, 1), (2, 1), (8, 3), (9, 1), (10, 1)}


def test_equal_items_share_their_hits(spark):
    w = vocabulary(200, 2)
    items = [(1, " ".join(w[:60])), (2, " ".join(w[:60])), (3, None), (4, ""), (None, " ".join(w[100:150]))]
    assert pairs(spark, [(1, " ".join(w[5:45]))], items) == {(1, 1), (1, 2)}


def test_empty(spark):
    assert pairs(spark, [], []) == set()
    assert pairs(spark, [(1, "a b c")], []) == set()


def test_words():
    assert words("Señor-\nía (risas) LÍNEA, 20 [x] l'été") == ["senoria", "linea", "20", "l", "ete"]


def test_a_formula_within_a_leak_does_not_hide_it(spark):
    w = vocabulary(3000, 3)
    formula = w[2000:2012]
    items = [(k, " ".join(w[k * 100 : k * 100 + 40] + formula + w[k * 100 + 40 : k * 100 + 80])) for k in range(4)]
    around = w[2500:2540]
    leak = w[128:140] + formula + w[140:152]  # 36 words; 12 outside the formula on either side
    short = w[235:240] + formula + w[240:245]  # 10 words outside it
    docs = [(1, " ".join(around + leak + around)), (2, " ".join(around + short + around)), (3, " ".join(around + formula + around))]
    assert pairs(spark, docs, items) == {(1, 1)}


def test_formulas_are_counted_over_all_blocks(spark):
    w = vocabulary(3000, 5)
    formula = w[2000:2040]
    items = [(k, " ".join(w[k * 100 : k * 100 + 50] + formula)) for k in range(6)]
    d = spark.createDataFrame([(1, " ".join(formula)), (2, " ".join(w[105:145]))], "doc_id bigint, text string")
    found = leakage.find(d, spark.createDataFrame(items, "item_id bigint, text string"), block_chars=400)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(2, 1)}


def test_own_words_of_an_alignment():
    p, t = np.array([[1, 2, 3, 4, -2], [1, 2, 3, 4, 5]]), np.array([[9, 1, 2, 9, 4, -3], [1, 9, 3, 4, 5, -3]])
    own = np.array([[False, True, True, True, False], [True, True, False, False, False]])
    assert leakage.own_words(p, own, t).tolist() == [2, 1]


def test_every_window_within_its_edits_is_found(spark):
    w = vocabulary(6000, 8)
    phrases = [w[5000 + k * 5 : 5005 + k * 5] for k in range(12)]  # shared by custom: each in many items
    rng = random.Random(9)
    items = []
    for k in range(12):
        own = w[k * 200 : k * 200 + 60]
        for z in range(0, 60, 10):
            own[z : z + 5] = phrases[rng.randrange(12)]
        items.append((k, " ".join(own)))
    docs = []
    for k in range(12):
        for z in range(31):
            run = items[k][1].split()[z : z + 30]
            for n, p in enumerate((4, 9, 14, 19, 24)):  # one unharmed piece of five words, the last
                run[p] = f"misread{n}"
            docs.append((k * 100 + z, " ".join(run)))
    assert {(d, d // 100) for d, _ in docs} <= pairs(spark, docs, items)


def test_short_items_come_whole(spark):
    w = vocabulary(400, 10)
    items = [(n, " ".join(w[n * 5 : n * 5 + n])) for n in (9, 10, 15, 20, 24, 29)]
    around = w[300:330]
    docs = [(n, " ".join(around + w[n * 5 : n * 5 + n] + around)) for n in (9, 10, 15, 20, 24, 29)]
    docs += [(124, " ".join(around + w[120:131] + ["misread"] + w[132:144] + around)), (220, " ".join(around + w[100:110] + around))]
    assert pairs(spark, docs, items) == {(n, n) for n in (10, 15, 20, 24, 29)} | {(124, 24)}


def test_what_two_items_share_is_a_passage_and_three_a_formula(spark):
    w = vocabulary(4000, 11)
    docs, items, want = [], [], set()
    for n, shared in enumerate((1, 2, 3)):
        passage = w[n * 1000 : n * 1000 + 40]
        items += [(n * 100 + k, " ".join(passage + w[n * 1000 + 50 + k * 60 : n * 1000 + 110 + k * 60])) for k in range(shared)]
        docs.append((n, " ".join(w[3900:3930] + passage + w[3930:3960])))
        want |= {(n, n * 100 + k) for k in range(shared)} if shared < 3 else set()
    assert pairs(spark, docs, items) == want


def test_five_spread_errors(spark):
    w = vocabulary(100, 12)
    run = w[20:50]
    for p in (4, 10, 16, 22, 28):
        run[p] = "misread"
    assert pairs(spark, [(1, " ".join(run))], [(1, " ".join(w[:80]))]) == {(1, 1)}
