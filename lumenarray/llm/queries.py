"""Queries of problems 4, 6, 7, 8 and 9 over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarray.llm import leakage, mixing, mixture, nearest, subjects
from lumenarray.queries.ledger import VERDICT_TIMES
from lumenarray.session import table


SOURCE_COSINE = 0.785  # fixed value: signatures of one source have 0.80 or more, those of two less than 0.77


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the mixture's sources; its links are checked by their cosine."""
    return mixture.pairs(mixture.sources(table(spark, d, "unknown_clusters"), least_cosine=SOURCE_COSINE))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Each usable signature with the size of its source and the source's least
    id, as the mixture alone has it, without a look at any cosine."""
    m = mixture.sources(table(spark, d, "unknown_clusters")).select("id", "source")
    return m.join(m.groupBy("source").agg(F.min("id").alias("least"), F.count("*").alias("size")), "source").select("id", "least", "size")


def p4_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Each source's representative, the member of highest density that most others are linked to, with the source's size."""
    return mixture.sources(table(spark, d, "unknown_clusters")).groupBy(F.col("source").alias("representative")).agg(F.count("*").alias("size"), F.sum("n_events").alias("n_events"))


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    return mixture.described(mixture.sources(table(spark, d, "unknown_clusters")))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return nearest.paired(spark, table(spark, d, "ledger"), table(spark, d, "resultados"), table(spark, d, "arrays"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("event_file", "file", "event_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), p8_mix(spark, d))


def p9_subjects(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return subjects.assign(documents, subjects.train(documents, table(spark, d, "subject_labels"), table(spark, d, "subjects")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_subjects(spark, d).select("doc_id", "subject").distinct()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences of each subject; a document counts for each of its subjects."""
    return p9_subjects(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES = {f.__name__: f for f in (p4_found, p4_members, p4_representatives, p4_sources, p9_found, p9_subjects, p9_shares, p6_found, p6_pairs, p7_found, p7_leaks, p8_mix, p8_shares)}

SQL = {
    "p4_found": """with ok as (select id, vec, row_number() over (partition by id order by last_seen desc nulls last, n_events desc nulls last) as k from unknown_clusters where id is not null and len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0),
u as (select id, vec::double[] as v, sqrt(list_dot_product(vec::double[], vec::double[])) as n from ok where k = 1)
select a.id as id_a, b.id as id_b from u a join u b on a.id < b.id and list_dot_product(a.v, b.v) >= 0.785 * a.n * b.n""",
    "p6_found": f"""with {VERDICT_TIMES}
select event_file, file, event_id from (select d.event_file, x.file, x.event_id, row_number() over (partition by d.event_file order by abs(x.at_ms - d.origin_ms), x.file, x.event_id) as k from dec d join vt x on d.arr = x.arr and x.at_ms between d.origin_ms - 20000 and d.origin_ms + 20000) where k = 1""",
}
SQL["p6_pairs"] = SQL["p6_found"].replace("select event_file, file, event_id from (select d.event_file, x.file, x.event_id,", "select event_file, file, event_id, gap_ms from (select d.event_file, x.file, x.event_id, abs(x.at_ms - d.origin_ms) as gap_ms,")
SQL["p4_members"] = """with ok as (select id, vec, row_number() over (partition by id order by last_seen desc nulls last, n_events desc nulls last) as k from unknown_clusters where id is not null and len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0),
u as (select id, vec::double[] as v, sqrt(list_dot_product(vec::double[], vec::double[])) as n from ok where k = 1)
select a.id, min(b.id) as least, count(*) as size from u a join u b on list_dot_product(a.v, b.v) >= 0.785 * a.n * b.n group by a.id"""


def queries() -> dict:
    return QUERIES


def sql() -> dict[str, str]:
    return SQL
