"""Problem 9: held-out accuracy on planted subjects, and edges."""

import random

import numpy as np

from lumenarray.llm import subjects

TOPICS = {s: [f"{s}{chr(97 + k)}{chr(97 + j)}" for k in range(5) for j in range(4)] for s in ("sport", "law", "energy")}
COMMON = [f"common{chr(97 + k)}" for k in range(20)]


def speech(r, topics):
    out = []
    for s in topics:
        out.append(" ".join(r.sample(COMMON, 5) + r.sample(TOPICS[s], 3)).capitalize() + ".")
    r.shuffle(out)
    return " ".join(out) + (" (sporta sportb) This is a stock phrase commona about nothing." if r.random() < 0.3 else "")


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.sample(sorted(TOPICS), 2)
        two = r.random() < 0.3
        plan = [a] * 4 + ([b] * 3 if two else [b] * (r.random() < 0.5))
        rows.append((i, speech(r, plan), {a, b} if two else {a}))
    return rows


def test_held_out(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(9001, None, ""), (9002, "", ""), (9003, "Commona commonb. " * 4000, ""), (None, rows[0][1], "")], "doc_id bigint, text string, subject string")
    labels = spark.createDataFrame([(i, s) for i, _, lab in rows if i % 2 for s in lab] * 2, "doc_id bigint, subject string")
    topics = spark.createDataFrame([(s, w[0]) for s, w in TOPICS.items()], "subject string, description string")
    model = subjects.train(docs, labels, topics)
    got = {}
    for r in subjects.assign(docs, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    test = [(i, lab) for i, _, lab in rows if not i % 2]
    right = sum(len(got.get(i, set()) & lab) for i, lab in test)
    said, true = sum(len(got.get(i, set())) for i, _ in test), sum(len(lab) for _, lab in test)
    assert 2 * right / (said + true) > 0.95
    assert not {9001, 9002, 9003, None} & got.keys()


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    topics = spark.createDataFrame([("sport", None)], "subject string, description string")
    assert subjects.assign(docs, subjects.train(docs, labels, topics)).count() == 0


def test_the_rule():
    counts = np.array([[2, 6, 0], [1, 9, 0], [2, 7, 0], [0, 0, 0], [1, 1, 0]])
    assert subjects.decide(counts).tolist() == [[True, True, False], [False, True, False], [False, True, False], [False] * 3, [False] * 3]
