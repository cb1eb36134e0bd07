"""Problem 2: schemas that drift between files.

Every file's columns are profiled (types, value sketches, shares); the columns
that go and come between two versions are paired by a bipartite matching over
name, type and value similarity; matched columns are unified under one name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarray.operators.ordered import previous_in_order
from lumenarray.session import cut

SKETCH = 12  # minimum hashes kept per column
ACCEPT = 0.5  # least similarity of a rename
RUN_BUCKET = 64
CHANGES = "series string, run_no int, result_file string, field string, change_kind string, other_field string, score double"


def lines_of(raw: DataFrame) -> DataFrame:
    """series, run_no, result_file, line_no, line: the lines that may hold an
    object. Marks before the first brace are dropped; null lines and those
    without a brace are left out, as are rows without series, run_no or file."""
    d = raw.filter("series is not null and run_no is not null and result_file is not null and line is not null")
    d = d.select("series", "run_no", "result_file", "line_no", F.regexp_replace("line", r"^[^{]+", "").alias("line"))
    return d.filter(F.col("line").startswith("{"))


def cells(raw: DataFrame) -> DataFrame:
    """One row per parsable line and field: field, value (variant), type (null
    for a null). A line ingested twice counts twice, in all its fields alike.
    A line without fields gives one row without a field."""
    view = lines_of(raw).select("series", "run_no", "result_file", F.try_parse_json("line").alias("record")).filter("record is not null")
    each = view.lateralJoin(raw.sparkSession.tvf.variant_explode(F.col("record").outer())).drop("record", "pos").withColumnRenamed("key", "field")
    kind = F.split_part(F.schema_of_variant("value"), F.lit("<"), F.lit(1))
    return each.withColumn("type", F.when(kind.isin("STRING", "BOOLEAN", "ARRAY", "OBJECT"), kind).when(kind != "VOID", "NUMBER"))


TYPES = ["NUMBER", "STRING", "BOOLEAN", "ARRAY", "OBJECT"]


def profiles(cell: DataFrame) -> DataFrame:
    """Per file and field: its types, shares, number range and a value sketch.

    All parts are plain aggregates of fixed size, so a file with a large share
    of all lines is reduced before it is shuffled. The letters of a value are
    hashed once; the sketch is the least of each of SKETCH permutations.
    """
    is_number = F.col("type") == "NUMBER"
    text = F.when(~is_number, F.to_json("value"))
    bare = F.trim(F.lower(F.regexp_replace("_text", r"[0-9+\-.eE\"\[\]{}]+", " ")))
    number = F.when(is_number, F.try_variant_get("value", "$", "double")).when(F.col("type") == "STRING", F.try_variant_get("value", "$", "string").try_cast("double"))
    d = cell.select("series", "run_no", "result_file", "field", "type", text.alias("_text"), number.alias("_x"))
    d = d.withColumn("_h", F.when(F.col("type").isNotNull(), F.when(is_number, F.lit(0)).otherwise(F.shiftright(F.crc32(bare.cast("binary")), 2))))
    d = d.withColumn("_bit", F.coalesce(*(F.when(F.col("type") == t, F.lit(1 << k)) for k, t in enumerate(TYPES)), F.lit(0))).withColumn("_log", F.ln(F.abs("_x") + 1e-6))
    whole = F.when(F.col("_x").isNotNull(), (F.col("_x") == F.floor("_x")).cast("double"))
    # odd multipliers and shifts permute the hashes, which have 30 bits
    mins = [F.min(F.pmod(F.col("_h") * F.lit(0x9E3779B1 + 2 * 7919 * i) + F.lit(104729 * i), F.lit(1 << 30))).alias(f"h{i}") for i in range(SKETCH)]
    got = d.groupBy("series", "run_no", "result_file", "field").agg(
        F.bit_or("_bit").alias("_bits"), F.count("type").alias("n"), F.count("_x").alias("n_numbers"), F.avg("_log").alias("log_mean"), F.stddev_pop("_log").alias("log_dev"),
        F.avg(whole).alias("whole"), F.avg((F.col("_x") < 0).cast("double")).alias("negative"), F.avg(F.length("_text")).alias("length"), *mins,
    )
    types = F.filter(F.array(*(F.when(F.col("_bits").bitwiseAND(1 << k) > 0, F.lit(t)) for k, t in enumerate(TYPES))), lambda t: t.isNotNull())
    return got.withColumn("types", types).withColumn("sketch", F.array(*(f"h{i}" for i in range(SKETCH)))).drop("_bits", *(f"h{i}" for i in range(SKETCH)))


def words(name: str) -> list[str]:
    """The lower-case words of a field name in snake or camel case."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", plain).lower()) if w]


def name_similarity(a: str, b: str) -> float:
    """How alike two names are: by their words in any order and by letters."""
    x, y = words(a), words(b)
    if not x or not y:
        return 0.0
    alike = lambda p, q: SequenceMatcher(None, p, q, autojunk=False).ratio()
    one = sum(max(alike(p, q) for q in y) for p in x) / len(x)
    two = sum(max(alike(p, q) for q in x) for p in y) / len(y)
    return max((one + two) / 2, alike("".join(x), "".join(y)))


def value_similarity(a: dict, b: dict) -> float:
    """How alike two columns' contents are; 0.5 where nothing can be said."""
    if not a["n"] or not b["n"]:
        return 0.5
    typed = 1.0 if set(a["types"]) & set(b["types"]) else 0.35
    if a["n_numbers"] >= 0.5 * a["n"] and b["n_numbers"] >= 0.5 * b["n"]:
        wide = max(a["log_dev"] or 0, b["log_dev"] or 0, 0.7)
        scale = math.exp(-abs(a["log_mean"] - b["log_mean"]) / (2 * wide))
        apart = max(abs(a["whole"] - b["whole"]), abs(a["negative"] - b["negative"]))
        return typed * scale * (1 - 0.5 * apart)
    if (a["n_numbers"] >= 0.5 * a["n"]) != (b["n_numbers"] >= 0.5 * b["n"]):
        return 0.2 * typed
    same = np.mean([p == q for p, q in zip(a["sketch"], b["sketch"], strict=True)])
    long = math.exp(-abs(math.log((a["length"] or 1) / (b["length"] or 1))))
    return typed * (0.3 + 0.4 * same + 0.3 * long)


def matching(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the bipartite matching of greatest total score (shortest
    augmenting paths with potentials)."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            row = owner[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], j
            free = np.where(used[1:], np.inf, least[1:])
            nxt = int(np.argmin(free)) + 1
            step = free[nxt - 1]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nxt
        while j:
            owner[j], j = owner[came[j]], came[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def similarity(a: dict, b: dict) -> float:
    """Of a gone and a come column: name and contents must both agree. Files
    may hold a line or two, so that contents alone never rule a pair out."""
    return math.sqrt(name_similarity(a["field"], b["field"]) * (0.25 + 0.75 * value_similarity(a, b)))


def compare(before: list[dict], after: list[dict]) -> list[tuple]:
    """Changes (field, kind, other field, score) from one version to the next."""
    old, new = {p["field"]: p for p in before}, {p["field"]: p for p in after}
    out = [(f, "retyped", None, None) for f in old.keys() & new.keys() if len(old[f]["types"]) and len(new[f]["types"]) and set(old[f]["types"]) != set(new[f]["types"])]
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    renamed: dict[str, str] = {}
    if gone and come:
        score = np.array([[similarity(old[a], new[b]) for b in come] for a in gone])
        for i, j in matching(score):
            if score[i, j] >= ACCEPT:
                renamed[gone[i]] = come[j]
                out.append((come[j], "renamed", gone[i], float(score[i, j])))
    out += [(f, "removed", None, None) for f in gone if f not in renamed]
    taken = set(renamed.values())
    return out + [(f, "added", None, None) for f in come if f not in taken]


def changes(raw: DataFrame) -> DataFrame:
    """Each field that a file adds, removes, renames or retypes (CHANGES).

    A file is compared with the one of the next lower run_no of its series;
    the first has no changes. For a rename, field is the new name and
    other_field the old one. Empty input gives no changes.
    """
    p = profiles(cells(raw)).filter("field is not null")
    shape = F.struct(*(c for c in p.columns if c not in ("series", "run_no", "result_file")))
    files = p.groupBy("series", "run_no", "result_file").agg(F.collect_list(shape).alias("fields"))  # bounded by the width of a file
    # files are looked up by (series, run) rather than carried through the window
    runs = files.select("series", "run_no").distinct()
    before = previous_in_order(runs, ["series"], ["run_no"], F.floor(F.col("run_no") / RUN_BUCKET), ["run_no"]).filter("prev is not null").select("series", "run_no", F.col("prev.run_no").alias("_before"))
    old = files.select(F.col("series"), F.col("run_no").alias("_before"), F.col("fields").alias("old"))
    pairs = files.join(before, ["series", "run_no"]).join(old, ["series", "_before"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.series, r.run_no, r.result_file, *c) for r in b.itertuples() for c in compare(list(r.old), list(r.fields))]
            yield pd.DataFrame(rows, columns=["series", "run_no", "result_file", "field", "change_kind", "other_field", "score"])

    return pairs.select("series", "run_no", "result_file", "old", "fields").mapInPandas(run, CHANGES).distinct()


# The columns of a verdict and their types.
NUMBERS = ["apparent_velocity_mps", "semblance", "coincidence_fraction", "coherent_channels", "span_fraction", "track_speed_mps", "track_r2", "v_app_onset_mps", "onset_fit_r2", "channel_offset", "time_offset_s"]
FLAG = "suppressed_false_positive"
TEXTS = ["event_id", "classification", "phases", "file"]


KNOWN = [*NUMBERS, *TEXTS, FLAG, "explanations"]


def canonical_names(change: DataFrame, fields: DataFrame) -> DataFrame:
    """series, names (field -> name): what each field of a series is called in
    the unified table.

    Names that a series renames into each other are one column there; other
    series' renames don't join them. It is called by the verdict column among
    its names, else by the one that most series give any of its names, else by
    the name used in most files (ties: the least). fields: series, field, uses.
    """
    edges = change.filter("change_kind = 'renamed'").select("series", F.col("other_field").alias("field"), F.col("field").alias("to"), F.lit(None).cast("bigint").alias("uses")).distinct()

    def link(g: pd.DataFrame) -> pd.DataFrame:
        label: dict[str, str] = {}

        def top(x: str) -> str:
            while label.setdefault(x, x) != x:
                x = label[x]
            return x

        for r in g[g["to"].notna()].itertuples():
            label[top(r.field)] = top(r.to)
        uses = {r.field: r.uses for r in g[g["to"].isna()].itertuples()}
        groups: dict[str, list[str]] = {}
        for f in sorted(set(uses) | set(label), key=lambda f: (f not in KNOWN, -uses.get(f, 0), f)):
            groups.setdefault(top(f), []).append(f)
        rows = [(g["series"].iloc[0], f, fs[0], fs[0] in KNOWN) for fs in groups.values() for f in fs]
        return pd.DataFrame(rows, columns=["series", "field", "name", "sure"])

    # a group is a series' field names, whatever its lines
    own = cut(fields.select("series", "field", F.lit(None).cast("string").alias("to"), "uses").unionByName(edges).groupBy("series").applyInPandas(link, "series string, field string, name string, sure boolean"))
    said = own.filter("sure and field <> name").groupBy("field", "name").agg(F.count("*").alias("n"))
    elsewhere = said.groupBy("field").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("b")).select("field", F.col("b.name").alias("_said"))
    whole = own.join(elsewhere, "field", "left").groupBy("series", "name").agg(F.min(F.when(~F.col("sure"), F.col("_said"))).alias("_said"))
    named = own.join(whole, ["series", "name"]).select("series", "field", F.coalesce("_said", "name").alias("name"))
    return named.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("names"))


def unified(raw: DataFrame) -> DataFrame:
    """One table of verdicts with consistent columns, one row per parsable line.

    Numbers written as text become numbers, 0/1 and text flags become
    booleans, a lone explanation becomes a list; what can't be converted is
    null. Of two fields of a line with one name the one so written wins, then
    the lesser. Fields that are no verdict column are kept in the map `extra`.
    A line ingested twice counts once. A line is taken apart and renamed in
    its own row; the names of its series (as many as it has fields) join it.
    """
    line = ["series", "run_no", "result_file", "line_no"]
    whole = lines_of(raw).distinct().filter(F.try_parse_json("line").isNotNull())
    fields = cells(raw).filter("field is not null").groupBy("series", "field").agg(F.approx_count_distinct("result_file").alias("uses"))
    names = canonical_names(changes(raw), fields)
    entries = F.map_entries(F.from_json("line", "map<string,string>"))
    d = whole.select(*line, entries.alias("e")).join(names, "series", "left")
    name = lambda x: F.coalesce(F.try_element_at("names", x["key"]), x["key"])
    said = F.filter(F.transform("e", lambda x: F.struct(name(x).alias("name"), (name(x) != x["key"]).alias("other"), x["key"].alias("field"), x["value"].alias("value"))), lambda x: x["value"].isNotNull())
    d = d.select(*line, F.array_sort(said).alias("s"))
    first = F.filter("s", lambda x, i: (i == 0) | (F.element_at("s", F.greatest(i, F.lit(1)))["name"] != x["name"]))
    d = d.select(*line, F.map_from_entries(F.transform(first, lambda x: F.struct(x["name"], x["value"]))).alias("m"))
    text = lambda c: F.try_element_at("m", F.lit(c))
    flag = F.lower(text(FLAG))
    listed = F.coalesce(F.from_json(text("explanations"), "array<string>"), F.when(text("explanations").isNotNull(), F.array(text("explanations"))))
    return d.select(
        *line, *(text(c).alias(c) for c in TEXTS), *(text(c).try_cast("double").alias(c) for c in NUMBERS), F.when(flag.isin("true", "1", "yes"), True).when(flag.isin("false", "0", "no"), False).alias(FLAG),
        listed.alias("explanations"), F.map_filter("m", lambda k, _: ~k.isin(KNOWN)).alias("extra"),
    )
