"""Problem 3 against a parser that goes row by row."""

import json
import random

from lumenarray.operators import nested
from lumenarray.operators.nested import flatten

TREE = {"candidates": {"curve": {}, "picks": {}}}


def unpacked(x):
    while isinstance(x, str):
        try:
            x = json.loads(x)
        except ValueError:
            return None
    return x


def walk(x, path, tree, out):
    x = unpacked(x)
    if isinstance(x, dict):
        items = [(int(k), v) for k, v in x.items()] if x and all(k.isdigit() for k in x) else [(0, x)]
    else:
        items = list(enumerate(x)) if isinstance(x, list) else []
    for i, v in items:
        v = unpacked(v)
        if isinstance(v, dict):
            out.add(f"{path}[{i}]")
            for k, t in tree.items():
                if k in v:
                    walk(v[k], f"{path}[{i}].{k}", t, out)


def expected(text):
    out = set()
    try:
        doc = unpacked(json.loads(text))
    except (ValueError, TypeError):
        return out
    if isinstance(doc, dict) and "candidates" in doc:
        walk(doc["candidates"], "m.candidates", TREE["candidates"], out)
    return out


def run(spark, texts):
    df = spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(texts)], "id string, m string, root string")
    got = {}
    for r in flatten(df, "id", "m", TREE, False).collect():
        got.setdefault(int(r.root), set()).add(r.path)
    return got


CASES = [
    '{"candidates": [{"curve": [{"a": 1}, null, {"a": 2}], "picks": {"p": 1}}, null, {"x": "a } ] , { \\" \\\\"}]}',
    '{"candidates": {"0": {"curve": {"v": 1}}, "3": {"picks": []}}}',
    '{"candidates": {"curve": [1, 2, {"z": {}}]}}',
    json.dumps(json.dumps({"candidates": [{"curve": json.dumps([{"a": 1}])}]})),
    '{"candidates": "[{\\"picks\\": [{\\"q\\": 1}]}]"}',
    '{"candidates": ["{\\"curve\\": {\\"a\\": 1}}", {"b": 2}, 5, "text"]}',
    '{"candidates": [{"a": 1}',
    '{"candidates": [{"a": 1]}}',
    '{"candidates": [{"a": 1}]} trailing',
    "", " ", None, "null", "[]", "{}", '"{"', '{"candidates": {}}', '{"other": [{"candidates": [{"a": 1}]}]}',
    '{"é": "ñ{[", "candidates": [{"ü": "€"}, {"k": [[{"a": 1}]]}]}',
    '{"candidates": [' + ", ".join('{"curve": [{"v": %d}]}' % k for k in range(3000)) + "]}",
]


def test_shapes(spark):
    got = run(spark, CASES)
    assert {i: got.get(i, set()) for i in range(len(CASES))} == {i: expected(t) for i, t in enumerate(CASES)}


def test_random_documents(spark):
    r = random.Random(5)

    def value(depth):
        k = r.random()
        if depth > 3 or k < 0.2:
            return r.choice([None, 1, -2.5, True, "a", 'q"{[\\', "x,y:z", ""])
        if k < 0.4:
            return [value(depth + 1) for _ in range(r.randrange(4))]
        if k < 0.5:
            return json.dumps(value(depth + 1))
        if k < 0.6:
            return {str(i): value(depth + 1) for i in range(r.randrange(1, 4))}
        return {r.choice(["candidates", "curve", "picks", "a", "b"]): value(depth + 1) for _ in range(r.randrange(4))}

    texts = [json.dumps({"candidates": value(0), "n": value(2)}) for _ in range(400)]
    texts += [t[: r.randrange(len(t))] for t in texts[:100]]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got.get(i, set()) == expected(t), t


def test_links_and_values(spark):
    df = spark.createDataFrame([("f", CASES[0])], "id string, m string")
    rows = {r.path: r for r in flatten(df, "id", "m", TREE, False).collect()}
    child = rows["m.candidates[0].curve[2]"]
    assert (child.parent_path, child.list, child.position, json.loads(child.value)) == ("m.candidates[0]", "curve", 2, {"a": 2})
    assert rows["m.candidates[0]"].parent_path == "m"


def test_empty(spark):
    assert run(spark, []) == {}


def test_children_against_plain_parsing(spark):
    from lumenarray.functions.files import current
    from lumenarray.session import table

    d = "/root/testdata/sf0.001"

    def no(_):
        raise ValueError

    def parsed(x):
        try:
            return json.loads(x, parse_constant=no)
        except (ValueError, TypeError):
            return None

    def inner(x):
        return parsed(x) if isinstance(x, str) else x

    def elements(v):
        v = inner(v)
        if isinstance(v, dict) and v and all(k.isdigit() for k in v):
            v = [(int(k), e) for k, e in v.items()]
        elif isinstance(v, dict):
            v = [(0, v)]
        else:
            v = list(enumerate(v)) if isinstance(v, list) else []
        return [(i, inner(e)) for i, e in v if isinstance(inner(e), dict)]

    want = {}

    def walk(root, parent, path, v, tree):
        for i, e in elements(v):
            here = f"{path}[{i}]"
            want[root, here] = parent, i, e
            for name, below in tree.items():
                if name in e:
                    walk(root, here, f"{here}.{name}", e[name], below)

    trees = {"metrics_json": {"candidates": {"curve": {}, "picks": {}}}, "gt_json": {"magnitudes": {}}}
    for r in current(table(spark, d, "ledger"), "metrics_json", "gt_json").collect():
        for column, tree in trees.items():
            whole = inner(parsed(r[column]))
            if isinstance(whole, dict):
                for name, below in tree.items():
                    if name in whole:
                        walk(r.event_file, column, f"{column}.{name}", whole[name], below)
    for r in table(spark, d, "resultados").filter("phases is not null").collect():
        walk(f"{r.file}/{r.event_id}", "phases", "phases", parsed(r.phases), {})
    got = {(r.root, r.path): r for r in nested.verdict_children(table(spark, d, "ledger"), table(spark, d, "resultados")).collect()}
    assert got.keys() == want.keys() and len(got) > 500
    for key, (parent, i, e) in want.items():
        r = got[key]
        assert r.position == i and json.loads(inner_text(r.value)) == e, (key, r.value, e)
        assert r.parent_path == (None if parent == "phases" else parent)  # a list that is the whole record has no parent in it


def inner_text(value):
    return json.loads(value) if value.startswith('"') else value
