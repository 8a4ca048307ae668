"""Output, source and eligibility checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import checks as C
from tessera.operators import imports as I
from tessera.operators import shelves as S
from tessera.plans.registry import query, table

_SUMS = "SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s, count(*) AS n, min(l_returnflag) AS low, max(l_returnflag) AS high FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_totalprice <= 0 THEN 'not readable AAC audio' WHEN NOT (s > 0 AND abs(o_totalprice - s) <= greatest(5, 0.005 * s)) THEN 'duration differs' WHEN n > 4 THEN 'chapter count differs'
WHEN low <> high THEN 'embedded title differs' WHEN o_orderpriority LIKE '1%' THEN 'embedded author differs' END AS problem FROM ({_SUMS})""")
def output_problems(spark: SparkSession, d: str) -> DataFrame:
    """Orders as outputs, held against their lines."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")).alias("want_duration"), F.count("*").alias("want_chapters"), F.min("l_returnflag").alias("want_title"), F.max("l_returnflag").alias("high"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "mp3").otherwise("aac").alias("codec"), F.col("o_totalprice").alias("duration"), F.least("want_chapters", F.lit(4)).alias("chapters"), F.array("high").alias("titles"),
        F.array(F.lit("ann ash oak"), F.lit("")).alias("authors"), "want_duration", "want_chapters", "want_title", F.array(F.when(F.col("o_orderpriority").startswith("1"), "bo").otherwise("ash")).alias("want_authors"),
    )
    return rows.select("o_orderkey", C.output_problem().alias("problem"))


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'missing_canonical_author' END, CASE WHEN n IS NULL THEN 'missing_source_file' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'source_author_conflict' END,
CASE WHEN p > 0 THEN 'source_probe_problem' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'source_title_unverified' END) AS issues, CASE WHEN c_mktsegment = 'BUILDING' THEN 'review' END AS severity
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def source_issue_codes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("broken"))
    rows = table(spark, d, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.lit("{}").alias("metadata"), F.when(F.col("c_acctbal") < 0, " Unknown ").otherwise("x").alias("author"), F.lit("Title").alias("title"), F.col("n").isNull().cast("int").alias("absent"), "broken",
        F.when(F.col("c_mktsegment") == "BUILDING", "conflict").otherwise("aligned").alias("author_status"), F.when(F.col("c_mktsegment") == "MACHINERY", "unverified").otherwise("aligned").alias("title_status"),
    )
    rows = rows.withColumn("codes", C.source_issues())
    severe = C.rechecks(rows.select("c_custkey", "title", F.lit("complete").alias("state"), F.split("codes", ",").alias("issues"))).select("c_custkey", "severity")
    return rows.join(severe, "c_custkey", "left").select("c_custkey", F.col("codes").alias("issues"), "severity")


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size = 1 THEN 'missing_output_author_tag' END, CASE WHEN n > 1 THEN 'multiple_current_book_claims' END, CASE WHEN p_size > 30 THEN 'output_author_folder_mismatch' END,
CASE WHEN p_size > 40 THEN 'output_author_tag_mismatch' END, CASE WHEN p_size = 2 THEN 'output_series_mismatch' END, CASE WHEN p_size = 3 THEN 'unexpected_output_codec' END) AS issues FROM (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand) AS n FROM part)""")
def output_issue_codes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_brand")
    claims = part.groupBy(F.col("p_name").alias("name_"), F.col("p_brand").alias("brand_")).agg(F.count("*").alias("claims"))
    rows = part.join(claims, (F.col("p_name") == F.col("name_")) & (F.col("p_brand") == F.col("brand_"))).select(
        "p_partkey", F.lit(None).cast("string").alias("error"), F.when(F.col("p_size") == 3, "mp3").otherwise("aac").alias("codec"), "claims", (F.col("p_size") <= 30).alias("author_folder"), F.lit(True).alias("title_folder"),
        F.when(F.col("p_size") > 1, F.array("p_brand")).alias("author_tags"), F.array("p_name").alias("title_tags"), (F.col("p_size") <= 40).alias("author_tag"), F.lit(True).alias("title_tag"), F.when(F.col("p_size") == 2, False).alias("series_fits"),
    )
    return rows.select("p_partkey", C.output_issues().alias("issues"))


@query("""SELECT path, split_part(path, '/', 1) AS author, CASE WHEN len(string_split(path, '/')) = 4 THEN split_part(path, '/', 2) END AS series, p_name AS title
FROM (SELECT p_name, CASE WHEN p_size < 5 THEN '_quarantine' ELSE p_brand END || '/' || CASE WHEN p_size > 25 THEN p_type || '/' ELSE '' END || p_partkey || '/' || p_brand || ' - ' || p_name || CASE WHEN p_size = 50 THEN '.mp3' ELSE '.m4b' END AS path FROM part) WHERE path LIKE '%.m4b' AND path NOT LIKE '\\_%' ESCAPE '\\'""")
def published_outputs(spark: SparkSession, d: str) -> DataFrame:
    folder = F.concat(F.when(F.col("p_size") < 5, "_quarantine").otherwise(F.col("p_brand")), F.lit("/"), F.when(F.col("p_size") > 25, F.concat("p_type", F.lit("/"))).otherwise(""), F.col("p_partkey").cast("string"))
    path = F.concat(folder, F.lit("/"), "p_brand", F.lit(" - "), "p_name", F.when(F.col("p_size") == 50, ".mp3").otherwise(".m4b"))
    return C.published(table(spark, d, "part").select(path.alias("path")))


@query("""SELECT o_orderkey, o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority NOT LIKE '1%') AS eligible, o_orderstatus = 'P' AND o_orderpriority NOT LIKE '2%' AND o_orderpriority NOT LIKE '3%' AS blocked FROM orders""")
def work_queues(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "metadata_matched").when(F.col("o_orderstatus") == "O", "local_metadata").otherwise("quarantined")
    title = F.when(F.col("o_orderpriority").startswith("1"), "Untitled").otherwise("North Wind")
    failure = F.when(F.col("o_orderpriority").startswith("2"), "output path is already claimed by x")
    kind = F.when(F.col("o_orderpriority").startswith("3"), "quarantine").otherwise("combine_components")
    rows = table(spark, d, "orders")
    return rows.select("o_orderkey", C.eligible(state, title, F.array(F.lit("Ann Ash")), F.lit(None).cast("string")).alias("eligible"), C.blocked(state, kind, title, failure).alias("blocked"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice > 0 AND l_quantity > 0 AND abs(l_extendedprice - l_quantity * 60) <= greatest(900, l_quantity * 60 * 0.08) AS fits, round(abs(l_extendedprice - l_quantity * 1000) / greatest(l_extendedprice, l_quantity * 1000, 1), 12) AS share FROM lineitem""")
def runtime_fits(spark: SparkSession, d: str) -> DataFrame:
    gap = C.length_gap(F.col("l_extendedprice"), F.col("l_quantity") * 1000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.runtime_matches(F.col("l_quantity").cast("string"), F.col("l_extendedprice")).alias("fits"), F.round(gap["share"], 12).alias("share"))


@query(r"""SELECT doc_id, NOT regexp_matches(regexp_replace(text, '\p{Latin}', '', 'g'), '\p{L}') AS latin FROM documents""")
def latin_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", I.latin(F.col("text")).alias("latin"))


@query("""SELECT o_orderkey, 'archive:' || left(sha256('a/' || o_orderkey || '.zip'), 24) AS archive, 'A/B ' || o_custkey || ' [B0' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || ']/c.m4b' AS path FROM orders""")
def archive_places(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    path = F.concat(F.lit("A/B "), F.col("o_custkey").cast("string"), F.lit("/c.m4b"))
    return table(spark, d, "orders").select("o_orderkey", C.archive_id(F.concat(F.lit("a/"), key, F.lit(".zip"))).alias("archive"), C.destination(path, F.concat(F.lit("B0"), F.lpad(key, 8, "0"))).alias("path"))
