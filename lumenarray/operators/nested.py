"""Problem 3: deeply nested records to flat, linked child tables.

A batch of JSON texts is read as one byte array. Quote, bracket and delimiter
bitmaps are built for all texts at once, nesting depths come from prefix sums,
matching brackets from one sort by depth, and the spans of the wanted objects
are cut out and emitted with a link to their parent. No text is parsed row by
row, but for lists written as text inside a string.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE, BACKSLASH, COMMA, COLON = 34, 92, 44, 58
OPEN_LIST, CLOSE_LIST, OPEN_OBJECT, CLOSE_OBJECT = 91, 93, 123, 125

STRUCTURAL = np.zeros(256, bool)
STRUCTURAL[[COMMA, COLON, OPEN_LIST, CLOSE_LIST, OPEN_OBJECT, CLOSE_OBJECT]] = True
STEP = np.zeros(256, np.int64)
STEP[[OPEN_LIST, OPEN_OBJECT]], STEP[[CLOSE_LIST, CLOSE_OBJECT]] = 1, -1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 13, 32]] = True

#: Children of a list: name of a member list -> its own children.
Tree = dict[str, "Tree"]

CHILDREN = "root string, parent_path string, path string, list string, position bigint, value string"


class Index:
    """Structural index of many texts that lie end to end in `buf`."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.buf, self.starts, self.ends = buf, starts, ends
        n = len(starts)
        quote = buf == QUOTE
        slashes = np.flatnonzero(buf == BACKSLASH)
        if slashes.size:  # a quote after an odd run of backslashes is escaped
            first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
            last = np.append(first[1:], slashes.size) - 1
            escaped = slashes[last[(last - first) % 2 == 0]] + 1
            quote[escaped[escaped < buf.size]] = False
        self.quotes = np.flatnonzero(quote)
        before = np.searchsorted(self.quotes, starts)
        odd = (np.searchsorted(self.quotes, ends) - before) % 2 == 1

        at = np.flatnonzero(STRUCTURAL[buf])
        doc = np.searchsorted(ends, at, side="right")
        outside = (np.searchsorted(self.quotes, at) - before[np.minimum(doc, n - 1)]) % 2 == 0
        at, doc = at[outside], doc[outside]
        kind = buf[at]
        total = np.cumsum(STEP[kind])
        base = np.append(0, total)[np.searchsorted(at, starts)]
        depth = total - base[doc]
        # opening and closing brackets of one pair have one level
        self.valid = ~odd
        lows = np.full(n, 0)
        np.minimum.at(lows, doc, depth)
        self.valid &= (lows >= 0) & (np.append(0, total)[np.searchsorted(at, ends)] == base)
        good = self.valid[doc]
        at, doc, kind, depth = at[good], doc[good], kind[good], depth[good]

        bracket = STEP[kind] != 0
        b_at, b_doc, b_kind = at[bracket], doc[bracket], kind[bracket]
        level = depth[bracket] + (STEP[b_kind] < 0)
        order = np.lexsort((b_at, level, b_doc))
        opening, closing = order[0::2], order[1::2]
        torn = (b_kind[closing] != b_kind[opening] + 2) | (level[closing] != level[opening]) | (b_doc[closing] != b_doc[opening])
        self.valid[b_doc[opening[torn]]] = False
        by_place = np.argsort(b_at[opening])
        opening, closing = opening[by_place], closing[by_place]
        keep = self.valid[b_doc[opening]]
        opening, closing = opening[keep], closing[keep]

        #: containers, in order of their place
        self.open, self.close = b_at[opening], b_at[closing]
        self.kind, self.level, self.doc = b_kind[opening], level[opening], b_doc[opening]
        self.at_level = [np.flatnonzero(self.level == k) for k in range(int(self.level.max(initial=0)) + 1)]
        self.parent = self.holder(self.open, self.level - 1)
        # a text is one container and nothing else
        top = np.flatnonzero(self.level == 1)
        self.whole = np.bincount(self.doc[top], minlength=n) == 1
        of = self.doc[top]
        self.whole[of[(self.next_ink(starts[of] - 1) != self.open[top]) | (self.next_ink(self.close[top]) < ends[of])]] = False

        still = self.valid[doc]
        self.commas = [at[still & (kind == COMMA) & (depth == k)] for k in range(len(self.at_level))]
        is_colon = still & (kind == COLON)
        self.colons, self.colon_level = at[is_colon], depth[is_colon]
        self.colon_owner = self.holder(self.colons, self.colon_level)
        key_end = np.searchsorted(self.quotes, self.colons) - 1
        self.key_to, self.key_from = self.quotes[key_end], self.quotes[key_end - 1] + 1

    def holder(self, places: np.ndarray, level: np.ndarray) -> np.ndarray:
        """For each place the container of that level around it, else -1."""
        out = np.full(len(places), -1)
        for k in range(1, len(self.at_level)):
            here = np.flatnonzero(level == k)
            if here.size and self.at_level[k].size:
                i = np.searchsorted(self.open[self.at_level[k]], places[here]) - 1
                found = i >= 0
                out[here[found]] = self.at_level[k][i[found]]
        return out

    def position(self, places: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How many elements of the owning list come before each place."""
        out = np.zeros(len(places), np.int64)
        for k in range(1, len(self.at_level)):
            here = np.flatnonzero(self.level[owner] == k)
            if here.size:
                c = self.commas[k]
                out[here] = np.searchsorted(c, places[here]) - np.searchsorted(c, self.open[owner[here]])
        return out

    def text(self, a: int, b: int) -> str:
        return self.buf[a:b].tobytes().decode("utf-8", "replace")

    def next_ink(self, places: np.ndarray) -> np.ndarray:
        """The first place after each that is no white space."""
        out = places + 1
        while (blank := np.flatnonzero((out < self.buf.size) & SPACE[self.buf[np.minimum(out, self.buf.size - 1)]])).size:
            out[blank] += 1
        return out


def children(texts: list[tuple], tree: Tree, with_value: bool) -> list[list]:
    """Columns root, parent_path, path, list, position, value of all child
    objects of the texts (root, path, node, kind, bytes).

    kind: `object` (a record whose members are lists), `list`, or `element` of
    a list, for texts that were found inside a string. node is the number of
    the text's list in the tree, 0 for a record.
    """
    nodes = Nodes(tree)
    out: list[list] = [[], [], [], [], [], []]
    while texts:
        lengths = [len(t[4]) for t in texts]
        ends = np.cumsum(lengths)
        texts = _one_pass(np.frombuffer(b"".join(t[4] for t in texts), np.uint8), ends - lengths, ends, texts, nodes, out if with_value else out[:5])
    if not with_value:
        out[5] = [None] * len(out[0])
    return out


class Nodes:
    """The lists of a tree, numbered; 0 is the record itself."""

    def __init__(self, tree: Tree):
        self.name, self.below = [""], []
        todo = [(0, tree)]
        while todo:
            node, members = todo.pop(0)
            for name, inner in members.items():
                self.below.append((node, name, len(self.name)))
                todo.append((len(self.name), inner))
                self.name.append(name)
        self.keys = sorted({name for _, name, _ in self.below})
        self.child = np.full((len(self.name), len(self.keys) + 1), -1)  # the last column: no wanted key
        for node, name, inner in self.below:
            self.child[node, self.keys.index(name)] = inner


def _one_pass(buf, starts, ends, texts, nodes: Nodes, out: list[list]) -> list[tuple]:
    ix = Index(buf, starts, ends)
    n, m = len(ix.open), len(ix.colons)
    if not n:
        return []
    # keys: which wanted name, or which position
    length = ix.key_to - ix.key_from
    code = np.full(m, len(nodes.keys))
    for k, name in enumerate(map(str.encode, nodes.keys)):
        here = np.flatnonzero(length == len(name))
        same = (buf[ix.key_from[here][:, None] + np.arange(len(name))] == np.frombuffer(name, np.uint8)).all(axis=1)
        code[here[same]] = k
    digit = np.append(0, np.cumsum((buf >= 48) & (buf <= 57)))
    digits = (length > 0) & (length < 10) & (digit[ix.key_to] - digit[ix.key_from] == length)
    owned = ix.colon_owner >= 0
    count = np.bincount(ix.colon_owner[owned], minlength=n)
    by_position = (count > 0) & (count == np.bincount(ix.colon_owner[owned & digits], minlength=n))
    # the key of each container that is an object's member
    value_at = ix.next_ink(ix.colons)
    named = np.full(n, -1)
    hit = np.minimum(np.searchsorted(ix.open, value_at), n - 1)
    is_container = ix.open[hit] == value_at
    named[hit[is_container]] = np.flatnonzero(is_container)
    element = ix.position(ix.open, np.maximum(ix.parent, 0))

    role, member = np.full(n, -1), np.full(n, -1)  # list whose elements it holds; list of which it is an element
    path, up = np.empty(n, object), np.empty(n, object)
    is_object = ix.kind == OPEN_OBJECT

    def emit(c: np.ndarray, node: np.ndarray, parents: np.ndarray, position: np.ndarray) -> None:
        here = c.tolist()
        out[0].extend(texts[d][0] for d in ix.doc[c].tolist())
        out[1].extend(parents)
        out[2].extend(path[c])
        out[3].extend(nodes.name[k] or texts[d][1].rpartition(".")[2] for k, d in zip(node.tolist(), ix.doc[c].tolist(), strict=True))
        out[4].extend(position.tolist())
        if len(out) > 5:
            out[5].extend(ix.text(ix.open[i], ix.close[i] + 1) for i in here)

    def lists(c: np.ndarray) -> None:
        """Of new lists, those that are a lone object hold that one element."""
        lone = c[is_object[c] & ~by_position[c]]
        path[lone] = [f"{x}[0]" for x in path[lone]]
        emit(lone, role[lone], up[lone], np.zeros(len(lone), np.int64))
        member[lone], role[lone] = role[lone], -1

    top = ix.at_level[1][ix.whole[ix.doc[ix.at_level[1]]]]
    kinds = np.array([("object", "list", "element").index(t[3]) for t in texts])[ix.doc[top]]
    base = np.array([t[2] for t in texts])
    path[top] = [texts[d][1] for d in ix.doc[top].tolist()]
    member[top[(kinds == 0) & is_object[top]]] = 0
    found = top[kinds == 1]
    role[found] = base[ix.doc[found]]
    up[found] = [x.rpartition(".")[0] or None for x in path[found]]
    lists(found)
    found = top[(kinds == 2) & is_object[top]]
    member[found] = base[ix.doc[found]]
    emit(found, member[found], [x.rpartition(".")[0] or None for x in path[found]], np.array([int(x[x.rindex("[") + 1 : -1]) for x in path[found]], np.int64))
    for c in ix.at_level[2:]:
        p = ix.parent[c]
        one = (role[p] >= 0) & is_object[c]
        e, q = c[one], p[one]
        position = element[e]
        keyed = np.flatnonzero(is_object[q])
        position[keyed] = [int(ix.text(ix.key_from[k], ix.key_to[k])) for k in named[e[keyed]]]
        member[e] = role[q]
        path[e] = [f"{x}[{i}]" for x, i in zip(path[q], position.tolist(), strict=True)]
        emit(e, role[q], up[q], position)
        inside = (member[p] >= 0) & (named[c] >= 0)
        e, q = c[inside], p[inside]
        node = nodes.child[member[q], code[named[e]]]
        e, q, node = e[node >= 0], q[node >= 0], node[node >= 0]
        role[e], up[e] = node, path[q]
        path[e] = [f"{x}.{nodes.name[k]}" for x, k in zip(path[q], node.tolist(), strict=True)]
        lists(e)

    # lists and elements written as text in a string, for the next pass
    again: list[tuple] = []

    def encoded(owner: int, at: int, where: str, node: int, kind: str) -> None:
        end = int(ix.quotes[np.searchsorted(ix.quotes, at) + 1]) + 1
        try:
            inner = json.loads(ix.text(at, end))
            if inner.strip()[:1] not in ("{", "[", '"'):
                return
            while isinstance(said := json.loads(inner), str):
                inner = said
        except ValueError:
            return
        again.append((texts[ix.doc[owner]][0], where, node, kind, inner.strip().encode()))

    quoted = np.flatnonzero(owned & (buf[np.minimum(value_at, buf.size - 1)] == QUOTE))
    owner = ix.colon_owner[quoted]
    for c, q in zip(owner[role[owner] >= 0].tolist(), quoted[role[owner] >= 0].tolist(), strict=True):
        encoded(c, int(value_at[q]), f"{path[c]}[{int(ix.text(ix.key_from[q], ix.key_to[q]))}]", int(role[c]), "element")
    node = np.where(member[owner] >= 0, nodes.child[member[owner], code[quoted]], -1)
    for c, q, k in zip(owner[node >= 0].tolist(), quoted[node >= 0].tolist(), node[node >= 0].tolist(), strict=True):
        encoded(c, int(value_at[q]), f"{path[c]}.{nodes.name[k]}", k, "list")
    for k in range(1, len(ix.at_level)):
        spans = ix.at_level[k][(role[ix.at_level[k]] >= 0) & ~is_object[ix.at_level[k]]]
        commas = ix.commas[k]
        inner = commas[role[ix.holder(commas, np.full(len(commas), k))] >= 0]
        edges = np.sort(np.concatenate([ix.open[spans], inner]))
        first = ix.next_ink(edges)
        is_text = buf[np.minimum(first, buf.size - 1)] == QUOTE
        edges, first = edges[is_text], first[is_text]
        of = ix.holder(first, np.full(len(first), k))
        for c, a, i in zip(of.tolist(), first.tolist(), ix.position(first, of).tolist(), strict=True):
            if not is_object[c]:
                encoded(c, a, f"{path[c]}[{i}]", int(role[c]), "element")
    return again


def whole_json(text: Column) -> Column:
    """The text if it is JSON, unpacked if it is JSON written inside a JSON
    string (twice at most); null if it is broken."""
    def inner(t: Column) -> Column:
        v = F.try_parse_json(t)
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(v.isNotNull(), t)

    one = inner(F.trim(text))
    return F.when(F.trim(text).startswith('"'), inner(one)).otherwise(one)


def flatten(df: DataFrame, root: str, text: str, tree: Tree, is_list: bool, with_value: bool = True) -> DataFrame:
    """Child objects of the JSON column `text`, each linked to its parent.

    Output (CHILDREN): root, parent_path (the name of the JSON column
    if the parent is the record; null if the list is the record), path, list (the list's name), position, value (the object's own text).
    A lone object counts as a list of one, an object keyed by positions as a
    list, and a document or list written as text in a string as what it says.
    Null and scalar elements keep their position and give no row; broken JSON,
    null and empty texts give none. Rows with a null root are dropped.
    """
    rows = df.filter(F.col(root).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 1)).select(F.col(root).cast("string").alias("root"), whole_json(F.col(text)).alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(f, pa.int64() if f == "position" else pa.string()) for f in ("root", "parent_path", "path", "list", "position", "value")]
        for batch in batches:
            roots = batch.column(0).to_pylist()
            raw = [x.encode() for x in batch.column(1).to_pylist()]
            cols = children([(r, text, 0, "list" if is_list else "object", t) for r, t in zip(roots, raw, strict=True)], tree, with_value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=pa.schema(fields))

    return rows.mapInArrow(run, CHILDREN)


# The nested lists of the verdict tables.
METRICS: Tree = {"candidates": {"curve": {}, "picks": {}}}
TRUTH: Tree = {"magnitudes": {}}
PHASES: Tree = {}


def verdict_children(ledger: DataFrame, resultados: DataFrame, with_value: bool = True) -> DataFrame:
    """All child objects of current ledger rows and of resultados, distinct."""
    from lumenarray.functions.files import current

    now = current(ledger, "metrics_json", "gt_json")
    verdicts = resultados.filter("file is not null and event_id is not null and phases is not null").select(F.concat_ws("/", "file", "event_id").alias("key"), "phases")
    parts = [
        flatten(now, "event_file", "metrics_json", METRICS, False, with_value),
        flatten(now, "event_file", "gt_json", TRUTH, False, with_value),
        flatten(verdicts, "key", "phases", PHASES, True, with_value),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
