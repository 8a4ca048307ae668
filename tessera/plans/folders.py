"""Folder spellings, removal order and merged records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import folders as O
from tessera.plans.registry import query, table


@query("""WITH g AS (SELECT source, lang, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS c, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS o FROM documents GROUP BY ALL)
SELECT source, lang FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, o DESC, lang) = 1""")
def canonical_folder(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("current", F.lit(True))
    docs = table(spark, d, "documents").select("doc_id", "source", "lang").join(known, "doc_id", "left")
    return O.canonical_folder(docs, "source", "lang", F.coalesce("current", F.lit(False)))


@query("""SELECT DISTINCT path FROM (SELECT p_brand || '/' || replace(p_type, ' ', CASE p_partkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '/_' ELSE ' ' END) AS path FROM part) WHERE NOT regexp_matches(path, '(^|/)([_.]|/|$)')""")
def removal_order(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    kind = F.when(F.expr("p_partkey % 3 = 0"), F.replace("p_type", F.lit(" "), F.lit("/"))).when(F.expr("p_partkey % 3 = 1"), F.replace("p_type", F.lit(" "), F.lit("/_"))).otherwise(F.col("p_type"))
    return O.removal_order(part.select(F.concat_ws("/", "p_brand", kind).alias("path")).distinct(), "path")


@query("""WITH r AS (SELECT s_suppkey, 'a' || s_nationkey AS alt FROM supplier), m AS (SELECT s_suppkey, s_suppkey - s_suppkey % 4 AS into_ FROM supplier WHERE s_suppkey % 4 IN (1, 2) AND s_suppkey > 4),
g AS (SELECT into_ AS s_suppkey, alt FROM m JOIN r USING (s_suppkey) UNION SELECT into_, CAST(s_suppkey AS VARCHAR) FROM m UNION SELECT s_suppkey, alt FROM r)
SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT s_suppkey FROM m) THEN 'superseded' ELSE 'complete' END AS state,
CASE WHEN s_suppkey IN (SELECT s_suppkey FROM m) THEN '' ELSE (SELECT string_agg(alt, ',' ORDER BY alt) FROM g WHERE g.s_suppkey = r.s_suppkey) END AS alternates FROM r""")
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "supplier").select("s_suppkey", F.lit("complete").alias("state"), F.array(F.concat(F.lit("a"), F.col("s_nationkey").cast("string"))).alias("alternates"))
    merges = records.where("s_suppkey % 4 in (1, 2) and s_suppkey > 4").select("s_suppkey", F.expr("s_suppkey - s_suppkey % 4").alias("into"))
    return O.merge_records(records, merges, "s_suppkey").withColumn("alternates", F.array_join("alternates", ","))
