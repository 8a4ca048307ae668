"""The catalog-reconciliation operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import entities as E
from tessera.operators import matching as M
from tessera.operators.components import components
from tessera.plans.registry import query, table


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type <> 'error'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    return E.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("""SELECT event_id, min(event_id) OVER w AS owner, event_id <> min(event_id) OVER w AS conflict
FROM events WINDOW w AS (PARTITION BY user_id, event_type)""")
def claim_first_owner(spark: SparkSession, d: str) -> DataFrame:
    return E.claims(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id").select("event_id", "owner", "conflict")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def props_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.finite(F.get_json_object("props", "$.k")).alias("k"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_order(spark: SparkSession, d: str) -> DataFrame:
    return E.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT source, count(*) AS members, CAST(sum(n_chars) AS BIGINT) AS chars,
CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS unanimous_lang FROM documents GROUP BY source""")
def group_members(spark: SparkSession, d: str) -> DataFrame:
    langs = F.when(F.min("lang") == F.max("lang"), F.min("lang"))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("members"), F.sum("n_chars").alias("chars"), langs.alias("unanimous_lang"))


_CLASS = [("short", "n_chars < 500"), ("middle", "n_chars < 3000"), ("long", "n_chars < 20000")]


@query("""SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' WHEN n_chars < 20000 THEN 'long' ELSE 'huge' END AS class,
count(*) AS members, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def size_by_class(spark: SparkSession, d: str) -> DataFrame:
    kind = M.first_match([(n, F.expr(c)) for n, c in _CLASS], "huge")
    return table(spark, d, "documents").groupBy(kind.alias("class")).agg(F.count("*").alias("members"), F.sum("n_chars").alias("chars"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))), ' ') AS title_key FROM documents""")
def title_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.title_key(F.col("text")).alias("title_key"))


_TOKENS = r"list_distinct(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'))"


@query(f"""WITH p AS (SELECT p_partkey, p_brand, p_size, {_TOKENS} AS t FROM part)
SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS containment
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
WHERE len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.5""")
def token_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", T.tokens(F.col("p_name")).alias("t"))
    return M.contained_pairs(p, "p_partkey", ["p_brand", "p_size"], "t", 0.5).select("a_key", "b_key", F.round("containment", 6).alias("containment"))


@query("""WITH g AS (SELECT text, lang, min(doc_id) AS root, count(*) AS n FROM documents GROUP BY text, lang)
SELECT doc_id AS node, root FROM documents JOIN g USING (text, lang) WHERE n > 1""")
def entity_components(spark: SparkSession, d: str) -> DataFrame:
    """Documents that copies link, each to the next smaller id of its text and language among its thousand, and to the smallest of all."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("text"), "lang")
    near = Window.partitionBy("text", "lang", F.floor(F.col("doc_id") / 1000)).orderBy("doc_id")
    chain = docs.select("doc_id", F.lag("doc_id").over(near).alias("before"))
    first = docs.groupBy("text", "lang", F.floor(F.col("doc_id") / 1000)).agg(F.min("doc_id").alias("low"))
    low = E.with_group(first.select("text", "lang", "low"), ["text", "lang"], top=F.min("low"))
    edges = chain.where("before is not null").select(F.col("doc_id").alias("a"), F.col("before").alias("b"))
    return components(edges.unionByName(low.where("low > top").select(F.col("low").alias("a"), F.col("top").alias("b"))))


@query()
def order_components(spark: SparkSession, d: str) -> DataFrame:
    """Orders that suppliers link, over all rows; a supplier's node is -1 - l_suppkey. Recursive SQL is too slow for it."""
    rows = table(spark, d, "lineitem").where("l_orderkey is not null and l_suppkey is not null")
    return components(rows.select(F.col("l_orderkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'untracked' ELSE 'current' END AS state
FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id""")
def label_trichotomy(spark: SparkSession, d: str) -> DataFrame:
    return E.trichotomy(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""SELECT v.status, count(x.status) AS n FROM (VALUES ('confirm'), ('reject'), ('defer'), ('unreviewed')) v(status)
LEFT JOIN (SELECT CASE WHEN l.quality = 1 THEN 'confirm' WHEN l.quality = 0 THEN 'reject' ELSE 'unreviewed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) x USING (status) GROUP BY v.status""")
def decision_status(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    status = M.first_match([("confirm", F.col("quality") == 1), ("reject", F.col("quality") == 0)], "unreviewed")
    counted = found.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(s,) for s in ("confirm", "reject", "defer", "unreviewed")], "status string")
    return names.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH k AS (SELECT conv_id, turn FROM conversations)
SELECT conv_id, count(turn) AS members, max(turn) + 1 - count(DISTINCT turn) AS missing, count(turn) - count(DISTINCT turn) AS repeated,
max(turn) + 1 = count(DISTINCT turn) AND count(turn) = count(DISTINCT turn) AS complete FROM k GROUP BY conv_id""")
def sequence_completeness(spark: SparkSession, d: str) -> DataFrame:
    return E.completeness(table(spark, d, "conversations"), "conv_id", "turn")


@query("""SELECT conv_id, turn, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS start_at, CAST(sum(length(text)) OVER w AS BIGINT) AS end_at
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    end = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", (end - F.length("text")).alias("start_at"), end.alias("end_at"))


@query("""WITH r AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
SELECT a.conv_id, a.n AS place, a.turn AS user_turn, b.turn AS assistant_turn FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.n = b.n WHERE a.role = 'user' AND b.role = 'assistant'""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "conversations").select("conv_id", "role", "turn", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).alias("place"))
    a, b = r.where("role = 'user'"), r.where("role = 'assistant'")
    return a.select("conv_id", "place", F.col("turn").alias("user_turn")).join(b.select("conv_id", "place", F.col("turn").alias("assistant_turn")), ["conv_id", "place"]).select("conv_id", "place", "user_turn", "assistant_turn")


@query("""WITH p AS (SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 100)
SELECT s_suppkey, c_custkey FROM p WHERE s_suppkey IN (SELECT s_suppkey FROM p GROUP BY 1 HAVING count(*) = 1)""")
def band_match(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"))
    return M.exactly_one(M.band_join(s, c, "s_acctbal", "c_acctbal", 100.0, ["nation"]), "s_suppkey").select("s_suppkey", "c_custkey")


@query("""SELECT o_orderkey, round(s, 4) AS parts_sum, abs(s - o_totalprice) <= greatest(5, 0.005 * greatest(s, o_totalprice)) AS same
FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def part_sum_match(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("s"))
    same = F.expr("abs(s - o_totalprice) <= greatest(5, 0.005 * greatest(s, o_totalprice))")
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(s, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.round("s", 4).alias("parts_sum"), same.alias("same"))


@query("""WITH r AS (SELECT p_brand, p_partkey, p_retailprice, p_retailprice - lead(p_retailprice) OVER w AS lead, row_number() OVER w AS n
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey))
SELECT p_brand, p_partkey, round(lead, 4) AS lead, p_retailprice >= 1500 AND (lead IS NULL OR lead >= 5) AS wins FROM r WHERE n = 1""")
def top1_margin(spark: SparkSession, d: str) -> DataFrame:
    best = M.top_with_margin(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey", 1500, 5)
    return best.select("p_brand", "p_partkey", F.round("lead", 4).alias("lead"), "wins")


@query("""SELECT p_brand, p_partkey FROM part QUALIFY p_retailprice >= 0.97 * max(p_retailprice) OVER (PARTITION BY p_brand)""")
def relative_to_best(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return E.with_group(part, ["p_brand"], best=F.max("p_retailprice")).where("p_retailprice >= 0.97 * best").select("p_brand", "p_partkey")


@query("""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'empty' WHEN n = 1 THEN 'single' WHEN returned = n THEN 'all_returned' WHEN returned > 0 THEN 'part_returned' ELSE 'combined' END AS class
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    rules = [("empty", F.col("n").isNull()), ("single", F.col("n") == 1), ("all_returned", F.col("returned") == F.col("n")), ("part_returned", F.col("returned") > 0)]
    return table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", M.first_match(rules, "combined").alias("class"))


@query("""SELECT c_custkey, array_to_string(list_sort(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN n IS NULL THEN 'no_orders' END, CASE WHEN n > 15 THEN 'many_orders' END], lambda x: x IS NOT NULL)), ',') AS issues
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def issue_codes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rules = [("negative_balance", F.col("c_acctbal") < 0), ("no_orders", F.col("n").isNull()), ("many_orders", F.col("n") > 15)]
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", M.issue_codes(rules).alias("issues"))


@query("""SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY lower(p_name)) > 1 THEN 'review_destination_collision' ELSE 'proposed' END AS state,
row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1 AS preferred FROM part""")
def collision_relabel(spark: SparkSession, d: str) -> DataFrame:
    part = E.with_group(table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name")), ["name"], n=F.count("*"), first=F.min("p_partkey"))
    state = F.when(F.col("n") > 1, "review_destination_collision").otherwise("proposed")
    return part.select("p_partkey", state.alias("state"), (F.col("p_partkey") == F.col("first")).alias("preferred"))


@query("""(SELECT n_nationkey AS nation, 'both' AS side FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier))
UNION ALL SELECT nation, 'customers_only' FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT nation, 'suppliers_only' FROM (SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT c_nationkey FROM customer)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers_only"))).unionByName(s.subtract(c).withColumn("side", F.lit("suppliers_only")))


@query("""SELECT l_orderkey, sha256(string_agg(l_linenumber || '|' || l_partkey || '|' || l_suppkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey)) AS fingerprint FROM lineitem GROUP BY l_orderkey""")
def source_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    member = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lines = F.transform(F.array_sort(F.collect_list(member)), lambda m: F.concat_ws("|", m["l_linenumber"], m["l_partkey"], m["l_suppkey"]))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


@query("""SELECT v.band, count(x.band) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('very_low')) v(band)
LEFT JOIN (SELECT CASE WHEN l_quantity * 2 >= 95 THEN 'high' WHEN l_quantity * 2 >= 80 THEN 'medium' WHEN l_quantity * 2 >= 50 THEN 'low' ELSE 'very_low' END AS band FROM lineitem) x USING (band) GROUP BY v.band""")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "lineitem").groupBy(M.band_name(F.col("l_quantity") * 2).alias("band")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(s,) for s in ("high", "medium", "low", "very_low")], "band string")
    return names.join(counted, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20")
def topk_review(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages")
def page_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))


@query("""SELECT o_orderkey, CASE WHEN g <= 5 THEN 50 WHEN g <= 500 THEN 47 ELSE 0 END AS points FROM (SELECT o_orderkey, abs(o_totalprice - p) AS g FROM
(SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)) WHERE g IS NOT NULL""")
def compared_to_previous(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    gap = F.abs(F.col("o_totalprice") - F.col("before"))
    return table(spark, d, "orders").withColumn("before", before).where("before is not null").select("o_orderkey", F.when(gap <= 5, 50).when(gap <= 500, 47).otherwise(0).alias("points"))
