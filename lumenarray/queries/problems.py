"""Queries of the general problems 1, 2, 3 and 5 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarray.operators import drift, history, nested, spikes
from lumenarray.session import table


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    return history.profile_versions(table(spark, d, "array_profiles"), table(spark, d, "array_profile_history"))


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    """Every version with its period and SNR50 as a number."""
    return p1_history(spark, d).select("array_id", "valid_from", "valid_to", F.col("snr50").cast("double").alias("snr50"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_history(spark, d).select("array_id", F.floor("valid_from").cast("bigint").alias("valid_from_s")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "resultados_raw")).select("result_file", "field", "change_kind").distinct()


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "resultados_raw"))


def p3_children(spark: SparkSession, d: str) -> DataFrame:
    return nested.verdict_children(table(spark, d, "ledger"), table(spark, d, "resultados"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.verdict_children(table(spark, d, "ledger"), table(spark, d, "resultados"), with_value=False).select("root", "path").distinct()


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(spikes.ledger_readings(table(spark, d, "ledger"), table(spark, d, "arrays")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.ledger_cases(table(spark, d, "ledger"), table(spark, d, "arrays"))


QUERIES = {f.__name__: f for f in (p1_found, p1_versions, p1_history, p2_found, p2_unified, p3_found, p3_children, p5_found, p5_flags)}

SQL = {}

_STATEMENTS = """
with said as (
  select distinct array_id, t, opens, thr, snr50 from (
    select array_id, updated as t, 1 as opens, thresholds_json as j, snr50 from array_profiles
    union all
    select array_id, archived_at, 0, thresholds_json, snr50 from array_profile_history) s,
  lateral (select coalesce(cast(cast(j->>'threshold' as double) as varchar), '-') || '|' || coalesce(cast(cast(j->>'seismic_min_semblance' as double) as varchar), '-') || '|' || coalesce(j->>'tier0_threshold_calibration_note', '-') as thr) x
  where array_id is not null and t is not null and (j is not null or snr50 is not null)),
seen as (
  select *, lag(thr) over w as thr0, lag(snr50) over w as snr0, lag(opens) over w as opens0, lag(t) over w as t0, row_number() over w as k
  from said window w as (partition by array_id order by t, opens, thr, snr50))
"""

SQL["p1_found"] = _STATEMENTS + """
select distinct array_id, cast(floor(case when opens0 = 0 then t0 else t end) as bigint) as valid_from_s
from seen where k = 1 or thr is distinct from thr0 or snr50 is distinct from snr0
"""

SQL["p1_versions"] = _STATEMENTS + """,
marked as (select array_id, case when opens0 = 0 then t0 else t end as valid_from, thr, snr50, t, opens from seen where k = 1 or thr is distinct from thr0 or snr50 is distinct from snr0)
select array_id, valid_from, lead(valid_from) over (partition by array_id order by t, opens, thr, snr50) as valid_to, snr50 from marked
"""

NOW = """
now as (select * from (select *, row_number() over (partition by event_file order by ts desc nulls last) as k from ledger where event_file is not null) where k = 1),
placed as (
  select n.*, a.array_id as arr, regexp_extract(event_file, '[_-]([^_-]*(?:-[0-9]{2}-[0-9]{2}_[0-9.]+)?)[.]h5$', 1) as mark from now n
  join arrays a on starts_with(event_file, a.file_prefix || '_') or starts_with(event_file, a.file_prefix || '-')),
timed as (
  select *, case when mark like '%T%Z' then epoch(strptime(mark, '%Y%m%dT%H%M%SZ')) when mark like '%-%' then epoch(strptime(mark, '%Y-%m-%d_%H.%M.%S')) else cast(mark as double) end as t from placed)
"""

SQL["p5_found"] = "with " + NOW + """,
long as (
  select arr, event_file, t, 'dt_detect_s' as field, dt_detect_s as y from timed where dt_detect_s is not null
  union all select arr, event_file, t, 'snr_observed', snr_observed from timed where snr_observed is not null),
judged as (select *, not isnan(y) and not isinf(y) and y > 0 and (field <> 'dt_detect_s' or y <= 60) as ok from long),
middle as (select arr, field, median(ln(y)) as m from judged where ok group by all),
spread as (select j.arr, j.field, m, 1.4826 * median(abs(ln(y) - m)) as s from judged j join middle using (arr, field) where ok group by all),
run as (
  select arr, field, event_file, max(y) over w - min(y) over w <= 0.004 and count(*) over w = 4 and not isnan(max(y) over w) as still, row_number() over (partition by arr, field order by t, event_file) as k
  from judged window w as (partition by arr, field order by t, event_file rows between current row and 3 following))
select event_file, field from judged where not ok
union select j.event_file, j.field from judged j join spread s using (arr, field) where ok and abs(ln(y) - m) > 6.75 * s
union select b.event_file, b.field from run a join run b on a.arr = b.arr and a.field = b.field and b.k between a.k and a.k + 3 where a.still
"""


def _elements(source: str) -> str:
    """SQL: (root, path, el) of the objects in each (root, path, v) of a list."""
    return f"""(select root, path || '[' || e.pos || ']' as path, case when json_type(e.el) = 'VARCHAR' and json_valid(e.el->>'$') then (e.el->>'$')::json else e.el end as el
  from (select root, path, unnest(case
    when json_type(u) = 'ARRAY' then list_transform(range(json_array_length(u)::bigint), lambda i: {{'pos': i, 'el': json_extract(u, '$[' || i || ']')}})
    when json_type(u) = 'OBJECT' and len(json_keys(u)) > 0 and len(list_filter(json_keys(u), lambda k: not regexp_full_match(k, '[0-9]+'))) = 0 then list_transform(json_keys(u), lambda k: {{'pos': k::bigint, 'el': json_extract(u, '$."' || k || '"')}})
    when json_type(u) = 'OBJECT' then [{{'pos': 0::bigint, 'el': u}}] else [] end) as e
    from (select root, path, case when json_type(v) = 'VARCHAR' and json_valid(v->>'$') then (v->>'$')::json else v end as u from {source} where v is not null)))"""


SQL["p3_found"] = "with " + NOW + f""",
j1 as (select event_file, case when json_valid(trim(gt_json)) then trim(gt_json)::json end as g, case when json_valid(trim(metrics_json)) then trim(metrics_json)::json end as m from now),
j2 as (select event_file, case when json_type(g) = 'VARCHAR' and json_valid(g->>'$') then (g->>'$')::json else g end as g, case when json_type(m) = 'VARCHAR' and json_valid(m->>'$') then (m->>'$')::json else m end as m from j1),
cands as {_elements("(select event_file as root, 'metrics_json.candidates' as path, m->'candidates' as v from j2 where json_type(m) = 'OBJECT')")},
found as (
  select root, path, el from cands
  union all select * from {_elements("(select root, path || '.curve' as path, el->'curve' as v from cands where json_type(el) = 'OBJECT')")}
  union all select * from {_elements("(select root, path || '.picks' as path, el->'picks' as v from cands where json_type(el) = 'OBJECT')")}
  union all select * from {_elements("(select event_file as root, 'gt_json.magnitudes' as path, g->'magnitudes' as v from j2 where json_type(g) = 'OBJECT')")}
  union all select * from {_elements("(select file || '/' || event_id as root, 'phases' as path, phases::json as v from resultados where json_valid(phases) and trim(phases) <> '')")})
select distinct root, path from found where json_type(el) = 'OBJECT'
"""
