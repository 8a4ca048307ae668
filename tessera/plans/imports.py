"""Import outcomes, ledgers, archives, drifted paths and numbered sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import imports as I
from tessera.plans.registry import query, table

_ASIN = "'B0' || lpad(CAST({0} AS VARCHAR), 8, '0')"


@query(f"""WITH b AS (SELECT p_partkey, lower(p_brand || '/' || p_name || '/x.m4b') AS t, {_ASIN.format('p_partkey')} AS asin, p_retailprice AS bytes, p_size FROM part),
l AS (SELECT lower(p_brand || '/' || p_name || CASE p_partkey % 3 WHEN 0 THEN '/x.m4b' WHEN 1 THEN '/cover.jpg' ELSE '/y.MP3' END) AS path FROM part WHERE p_size < 15
UNION ALL SELECT lower('in/' || {_ASIN.format('p_partkey')} || '/z.txt') FROM part WHERE p_size > 45),
a AS (SELECT *, CASE WHEN t IN (SELECT path FROM l) THEN 'review_destination_exists' WHEN p_size > 45 THEN 'review_existing_asin'
WHEN regexp_extract(t, '^(.*)/[^/]*$', 1) IN (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM l WHERE regexp_matches(path, '\\.(mp3|m4b)$')) THEN 'review_book_folder_has_audio' ELSE 'proposed_copy' END AS x FROM b),
c AS (SELECT *, CASE WHEN x = 'proposed_copy' AND count(*) FILTER (x = 'proposed_copy') OVER (PARTITION BY t) > 1 THEN 'review_target_collision' ELSE x END AS y FROM a)
SELECT p_partkey, CASE WHEN y = 'proposed_copy' AND (SELECT 100000 - sum(bytes) - max(bytes) < 1000 FROM c WHERE y = 'proposed_copy') THEN 'defer_disk_budget' ELSE y END AS action FROM c""")
def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    asin, folder = F.concat(F.lit("B0"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")), F.concat_ws("/", "p_brand", "p_name")
    books = part.select("p_partkey", F.concat(folder, F.lit("/x.m4b")).alias("destination"), asin.alias("asin"), F.col("p_retailprice").alias("bytes"))
    name = F.when(F.expr("p_partkey % 3 = 0"), "/x.m4b").when(F.expr("p_partkey % 3 = 1"), "/cover.jpg").otherwise("/y.MP3")
    library = part.where("p_size < 15").select(F.concat(folder, name).alias("path")).unionByName(part.where("p_size > 45").select(F.concat(F.lit("in/"), asin, F.lit("/z.txt")).alias("path")))
    return I.import_outcomes(books, library, "p_partkey", 100000, 1000)


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_quantity > 30) AS moved, min(l_returnflag) AS flag FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'no_entry' WHEN n > 1 THEN 'several_entries' WHEN flag <> o_flag THEN 'identity_differs' WHEN moved THEN 'relocated' ELSE 'verified' END AS outcome
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'R' END AS o_flag FROM orders) LEFT JOIN l ON l_orderkey = o_orderkey""")
def ledger_verify(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "orders").select("o_orderkey", F.when(F.expr("o_orderkey % 2 = 0"), "N").otherwise("R").alias("flag"), F.lit(False).alias("place"))
    ledger = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("flag"), (F.col("l_quantity") > 30).alias("place"))
    return I.verify_ledger(plan, ledger, "o_orderkey", ["flag"], "place")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'local_only' WHEN b.doc_id IS NULL THEN 'remote_only' WHEN a.n = b.n THEN 'same' ELSE 'size_changed' END AS state
FROM (SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 3 > 0) a FULL JOIN (SELECT doc_id, n_chars - CAST(doc_id % 5 = 0 AS INT) AS n FROM documents WHERE doc_id % 4 > 0) b ON a.doc_id = b.doc_id""")
def path_drift(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    return I.path_drift(docs.where("path % 3 > 0"), docs.where("path % 4 > 0").withColumn("size", F.col("size") - F.expr("int(path % 5 = 0)")))


@query("""SELECT 'In/' || upper(p_name) AS member, p_size AS size, (SELECT count(*) FROM part b WHERE b.p_name = a.p_name AND b.p_size = a.p_size) AS loose,
(SELECT min(p_brand || '/' || b.p_name) FROM part b WHERE b.p_name = a.p_name AND b.p_size = a.p_size) AS first FROM part a""")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    members = part.select(F.concat(F.lit("In/"), F.upper("p_name")).alias("member"), F.col("p_size").alias("size"))
    return I.archive_members(members, part.select(F.concat_ws("/", "p_brand", "p_name").alias("path"), F.col("p_size").alias("size")))


@query("""WITH k AS (SELECT conv_id, turn + 1 AS n, CASE WHEN conv_id % 5 = 0 THEN turn + 1 ELSE 6 END AS m, length(text) > 60 AS ok FROM conversations),
p AS (SELECT conv_id, n, count(*) AS c, bool_or(ok) AS ok, min(m) AS low, max(m) AS high, bool_or(n > m) AS bad FROM k GROUP BY conv_id, n),
s AS (SELECT conv_id, count(*) AS present, max(c) AS most, count(*) FILTER (ok) AS readable, min(low) AS low, max(high) AS high, bool_or(bad) AS bad FROM p GROUP BY conv_id),
t AS (SELECT *, CASE WHEN bad THEN 'invalid' WHEN present = 1 AND low < high THEN 'unnumbered' WHEN low < high THEN 'conflicting_totals' WHEN most > 1 THEN 'duplicates' WHEN readable < high THEN 'incomplete' ELSE 'complete' END AS state FROM s)
SELECT conv_id, state, CASE WHEN state = 'incomplete' THEN high - present ELSE 0 END AS missing, CASE WHEN state = 'incomplete' THEN present - readable ELSE 0 END AS unreadable FROM t""")
def numbered_sets(spark: SparkSession, d: str) -> DataFrame:
    total = F.when(F.col("conv_id") % 5 == 0, F.col("turn") + 1).otherwise(F.lit(6))
    name = F.concat(F.lit("x ("), (F.col("turn") + 1).cast("string"), F.lit(" of "), total.cast("string"), F.lit(").mp3"))
    files = table(spark, d, "conversations").select(F.col("conv_id").alias("group_key"), name.alias("relative_path"), F.when(F.length("text") > 60, 1.0).alias("duration"))
    return I.numbered_sets(files).withColumnRenamed("group_key", "conv_id")
