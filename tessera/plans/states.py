"""Books, decisions, claims, runs and reviews over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import matching as M
from tessera.operators import states as S
from tessera.plans.registry import query, table
from tessera.sources import media


@query("""WITH f AS (SELECT l_orderkey, min(l_partkey) AS fingerprint FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS book, CASE WHEN l_orderkey IS NULL THEN 'superseded' ELSE 'detected' END AS state, fingerprint, CASE WHEN l_orderkey IS NULL THEN 'awaiting reevaluation by current discovery pass' END AS failure,
CASE WHEN l_orderkey IS NULL THEN o_orderpriority END AS output FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def book_rediscovery(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "orders").select(F.col("o_orderkey").alias("book"), F.col("o_orderstatus").alias("state"), F.lit(None).cast("string").alias("failure"), F.col("o_orderpriority").alias("output"))
    found = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("book")).agg(F.min("l_partkey").alias("fingerprint")).withColumn("state", F.lit("detected"))
    return S.detected(S.rediscovery(books), found, ["book"], ["failure", "output"]).select("book", "state", "fingerprint", "failure", "output")


@query("""WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, min(c_custkey) AS owner FROM customer GROUP BY ALL)
SELECT * FROM c WHERE owner NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def claims_released(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("owner"), "c_acctbal")
    claims = rows.groupBy("nation", "segment").agg(F.min("owner").alias("owner"))
    return S.released(claims, rows.where("c_acctbal < 0"), ["nation", "segment"], "owner")


_ITEM = """SELECT doc_id, left(sha256('{"doc_id":' || doc_id || ',"source":"' || source || '"}'), 16) AS relationship, sha256('{"chars":' || n_chars || ',"note":null}') AS fingerprint,
CASE WHEN n_chars >= 9500 THEN 'high' WHEN n_chars >= 8000 THEN 'medium' WHEN n_chars >= 5000 THEN 'low' ELSE 'very_low' END AS band FROM documents"""
_SEEN = """SELECT doc_id, CASE quality WHEN 1 THEN 'confirm' ELSE 'reject' END AS decision, sha256('{"chars":' || (n_chars - toxic) || ',"note":null}') AS seen FROM labels JOIN documents USING (doc_id)"""


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as relationships, labels as decisions; those of toxic documents were made on other evidence."""
    docs, none = table(spark, d, "documents").select("doc_id", "source", "n_chars"), F.lit(None).cast("string")
    band = F.when(F.col("n_chars") >= 9500, "high").when(F.col("n_chars") >= 8000, "medium").when(F.col("n_chars") >= 5000, "low").otherwise("very_low")
    items = docs.select("doc_id", F.left(T.json_digest(doc_id=F.col("doc_id"), source=F.col("source")), F.lit(16)).alias("relationship"), T.json_digest(chars=F.col("n_chars"), note=none).alias("fingerprint"), band.alias("band"))
    labels = table(spark, d, "labels").join(docs.select("doc_id", "n_chars"), "doc_id")
    decisions = labels.select("doc_id", F.when(F.col("quality") == 1, "confirm").otherwise("reject").alias("decision"), T.json_digest(chars=F.col("n_chars") - F.col("toxic"), note=none).alias("fingerprint"))
    return S.with_decisions(items, decisions, "doc_id")


@query(f"SELECT i.doc_id, relationship, fingerprint, band, coalesce(decision, 'unreviewed') AS status, decision IS NOT NULL AND seen <> fingerprint AS stale FROM ({_ITEM}) i LEFT JOIN ({_SEEN}) s ON s.doc_id = i.doc_id")
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d)


@query(f"SELECT i.doc_id, relationship FROM ({_ITEM}) i LEFT JOIN ({_SEEN}) s ON s.doc_id = i.doc_id WHERE band = 'very_low' AND coalesce(decision, 'unreviewed') = 'unreviewed'")
def review_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.filtered(_reviewed(spark, d), "very_low", "unreviewed").select("doc_id", "relationship")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'skipped' WHEN n IS NULL THEN 'needs_metadata' WHEN done THEN 'skipped' ELSE 'ready' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'F') AS done FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def batch_items(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("done"))
    rows = table(spark, d, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", S.batch_status(F.col("c_mktsegment") == "MACHINERY", F.col("n") > 0, F.col("done")).alias("status"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT c_custkey AS key FROM customer), n AS (SELECT DISTINCT o_custkey AS key FROM orders)
SELECT 'cached_not_physical' AS gap, key FROM (SELECT * FROM n EXCEPT SELECT * FROM p) UNION ALL SELECT 'physical_not_cached', key FROM (SELECT * FROM p EXCEPT SELECT * FROM n)
UNION ALL SELECT 'active_not_selected', key FROM (SELECT * FROM a EXCEPT SELECT * FROM r) UNION ALL SELECT 'selected_not_active', key FROM (SELECT * FROM r EXCEPT SELECT * FROM a)""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    orders, customers = table(spark, d, "orders").withColumnRenamed("o_custkey", "key"), table(spark, d, "customer").withColumnRenamed("c_custkey", "key")
    active, selected = orders.where("o_orderstatus = 'P'"), orders.where("o_orderstatus = 'F'")
    return S.gaps({"cached_not_physical": (orders, customers), "physical_not_cached": (customers, orders), "active_not_selected": (active, selected), "selected_not_active": (selected, active)}, "key")


@query("""WITH o AS (SELECT DISTINCT lower(p_name) AS path FROM part WHERE p_size < 25), r AS (SELECT lower(p_name) AS path, count(DISTINCT p_partkey) AS n FROM part WHERE p_size > 15 GROUP BY 1)
SELECT coalesce(o.path, r.path) AS path, CASE WHEN o.path IS NULL THEN 'missing' WHEN r.path IS NULL THEN 'untracked' ELSE 'current' END AS state, coalesce(n, 0) AS claims, greatest(coalesce(n, 0) - 1, 0) AS extra FROM o FULL JOIN r ON o.path = r.path""")
def output_claims(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_size", F.lower("p_name").alias("path"))
    return S.claimed_outputs(part.where("p_size < 25"), part.where("p_size > 15"), "path", "p_partkey")


@query("""SELECT person, title, count(*) AS members, min(p_partkey) AS first FROM (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS person, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title FROM part)
WHERE person <> '' AND title <> '' GROUP BY ALL HAVING count(*) > 1""")
def duplicate_identities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", T.person_key("p_brand").alias("person"), T.person_key("p_name").alias("title")).where("person <> '' and title <> ''")
    return rows.groupBy("person", "title").agg(F.count("*").alias("members"), F.min("p_partkey").alias("first")).where("members > 1")


@query("""SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def strongest_claims(spark: SparkSession, d: str) -> DataFrame:
    return S.strongest(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderpriority"], "o_totalprice", "o_orderkey")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(l_extendedprice / 7.0 * 1000, 0) AS BIGINT) AS ms FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(ms) OVER w - ms AS BIGINT) AS start_ms, CAST(sum(ms) OVER w AS BIGINT) AS end_ms FROM m WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, ms ROWS UNBOUNDED PRECEDING)""")
def chapter_times(spark: SparkSession, d: str) -> DataFrame:
    """Each chapter is rounded to milliseconds before it is added up."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.bround(F.col("l_extendedprice") / 7.0 * 1000).cast("long").alias("ms"))
    end = F.sum("ms").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "ms").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", (end - F.col("ms")).alias("start_ms"), end.alias("end_ms"))


@query("""SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def resumable_runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "complete").otherwise("converting")
    return S.resumable(table(spark, d, "orders").select("o_custkey", "o_orderkey", status.alias("status")), ["o_custkey"], "o_orderkey", "status")


_LISTS = """SELECT l_orderkey, coalesce(list_sort(list(DISTINCT l_partkey) FILTER (l_returnflag <> 'N')), []) AS files, coalesce(list_sort(list(DISTINCT l_partkey) FILTER (l_returnflag = 'N')), []) AS alternates,
CASE WHEN l_orderkey % 3 = 0 THEN list_sort(list(DISTINCT l_partkey) FILTER (l_linenumber < 3)) WHEN l_orderkey % 3 = 1 THEN [l_orderkey] END AS selected FROM lineitem GROUP BY 1"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    own = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_partkey"))))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(own(F.col("l_returnflag") != "N").alias("files"), own(F.col("l_returnflag") == "N").alias("alternates"), own(F.col("l_linenumber") < 3).alias("low"))
    picked = F.when(F.col("l_orderkey") % 3 == 0, F.when(F.size("low") > 0, F.col("low"))).when(F.col("l_orderkey") % 3 == 1, F.array("l_orderkey"))
    return rows.select("l_orderkey", "files", "alternates", picked.alias("selected"))


@query(f"""WITH b AS ({_LISTS}), k AS (SELECT *, list_distinct(list_concat(files, alternates)) AS known FROM b),
o AS (SELECT *, selected IS NOT NULL AND NOT list_has_all(known, selected) AS bad FROM k)
SELECT l_orderkey, CASE WHEN bad THEN 'error' ELSE 'complete' END AS outcome, array_to_string(list_sort(CASE WHEN bad OR selected IS NULL THEN files ELSE selected END), ',') AS files,
array_to_string(list_sort(CASE WHEN bad OR selected IS NULL THEN alternates ELSE list_filter(known, lambda x: NOT list_contains(selected, x)) END), ',') AS alternates FROM o""")
def adopted_outputs(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return S.adopted(_lists(spark, d)).select("l_orderkey", "outcome", text("files").alias("files"), text("alternates").alias("alternates"))


@query("""SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN 'registered' WHEN s_nationkey = c_nationkey THEN 'unchanged' ELSE 'conflict' END AS outcome FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def import_register(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("nation"))
    return S.registered(known, table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), ["c_custkey"], ["nation"]).select("c_custkey", "outcome")


@query("""WITH r AS (SELECT p_type, p_partkey, CASE WHEN p_size > 40 THEN '  ' ELSE p_name END AS title, p_brand AS provider FROM part)
SELECT p_type, arg_max(title, p_partkey) FILTER (trim(title) <> '') AS title, count(*) FILTER (trim(title) = '') AS refused FROM r GROUP BY 1""")
def approved_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_type", "p_partkey", F.when(F.col("p_size") > 40, "  ").otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("provider"), F.col("p_partkey").cast("string").alias("provider_id"))
    return S.approved(rows, "p_type", "p_partkey").select("p_type", "title", "refused")


@query("""SELECT o_orderkey, CASE WHEN s IS NULL THEN 'missing' WHEN s IN ('F', 'P') THEN 'planned' ELSE 'state' END AS outcome FROM (SELECT DISTINCT l_orderkey + l_linenumber % 2 * 7 AS o_orderkey FROM lineitem) LEFT JOIN (SELECT o_orderkey, o_orderstatus AS s FROM orders) USING (o_orderkey)""")
def corrections(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") % 2 * 7).alias("o_orderkey")).distinct()
    return S.corrections(wanted, table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state")), "o_orderkey", ["F", "P"])


@query("""SELECT CASE WHEN l_returnflag = 'N' THEN 'local' ELSE 'online' END AS kind, l_returnflag AS provider, count(*) AS books, CAST(sum(l_partkey) AS BIGINT) AS bytes, round(sum(l_partkey) / 1073741824.0, 2) AS gib, count(*) FILTER (l_quantity < 3) AS failures FROM lineitem GROUP BY ALL""")
def plan_totals(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "local").otherwise("online")
    return table(spark, d, "lineitem").groupBy(kind.alias("kind"), F.col("l_returnflag").alias("provider")).agg(
        F.count("*").alias("books"), F.sum("l_partkey").alias("bytes"), F.round(F.sum("l_partkey") / 1073741824.0, 2).alias("gib"), F.count_if(F.col("l_quantity") < 3).alias("failures")
    )


@query("""SELECT p_partkey, CASE WHEN lower(a) = lower(b) THEN a ELSE a || '|' || b END AS queries FROM (SELECT p_partkey, p_brand || ' ' || p_type AS a, p_brand || ' ' || upper(p_type) || CASE WHEN p_size > 30 THEN ' ' || p_size ELSE '' END AS b FROM part)""")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_size") > 30, F.col("p_size").cast("string")).otherwise(F.lit(""))
    every = F.array(F.concat_ws(" ", "p_brand", "p_type"), F.lit(""), F.concat_ws("  ", "p_brand", F.upper("p_type"), size), F.lit(None).cast("string"), F.concat_ws(" ", "p_brand", F.lower("p_type")))
    return table(spark, d, "part").select("p_partkey", F.array_join(S.compact_list(every), "|").alias("queries"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN p_type WHEN p_size > 30 THEN '' ELSE p_name END AS tag FROM part""")
def first_tags(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_size") > 30, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    tags = F.create_map(F.lit("title"), name, F.lit("album"), F.when(F.col("p_size") > 40, F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", S.first_tag(tags, "title", "name", "album").alias("tag"))


@query("""SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, (c_acctbal + 1000) / 11000 AS score FROM customer) QUALIFY score >= 0.84 AND score >= max(score) OVER (PARTITION BY c_nationkey) - 0.03""")
def best_family(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", ((F.col("c_acctbal") + 1000) / 11000).alias("score"))
    return S.near_best(rows, ["c_nationkey"], "score", 0.84, 0.03).select("c_nationkey", "c_custkey")


@query("""WITH p AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS gap, s_acctbal > 0 AND c_acctbal > 0 AND abs(s_acctbal - c_acctbal) <= greatest(5, 0.005 * greatest(s_acctbal, c_acctbal)) AS same FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 200),
g AS (SELECT s_suppkey, count(*) AS n, count(*) FILTER (same) AS good, array_to_string(list_slice(list(c_custkey ORDER BY same DESC, gap, c_custkey), 1, 5), ',') AS candidates FROM p GROUP BY 1)
SELECT s.s_suppkey, CASE WHEN n IS NULL THEN 'none' WHEN good = 1 THEN 'one' WHEN good > 1 THEN 'many' ELSE 'weak' END AS class, coalesce(candidates, '') AS candidates FROM supplier s LEFT JOIN g ON g.s_suppkey = s.s_suppkey""")
def untracked_classes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers held against customers of like balance; the first five candidates are shown.

    On each side of a balance `same` holds up to some distance, so the five nearest balances of either side have the five first
    candidates, and tell whether none, one or more are the same.
    """
    s, c = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation")), table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"))
    gap = F.abs(F.col("s_acctbal") - F.col("c_acctbal"))
    same = (F.col("s_acctbal") > 0) & (F.col("c_acctbal") > 0) & (gap <= F.greatest(F.lit(5.0), 0.005 * F.greatest("s_acctbal", "c_acctbal")))
    near = M.nearest(s, c, "s_acctbal", "c_acctbal", 200.0, "c_custkey", ["nation"], 5).withColumns({"gap": gap, "same": same})
    # at most ten balances of five keys
    first = F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("keys_", lambda k: F.struct((~F.col("same")).alias("other"), F.col("gap").alias("gap"), k.alias("key")))))), 1, 5)
    found = near.groupBy("nation", "s_acctbal").agg(F.coalesce(F.sum(F.when(F.col("same"), F.col("n_"))), F.lit(0)).alias("good"), F.array_join(F.transform(first, lambda x: x["key"]), ",").alias("candidates"))
    kind = M.first_match([("none", F.col("good").isNull()), ("one", F.col("good") == 1), ("many", F.col("good") > 1)], "weak")
    return s.join(found, ["nation", "s_acctbal"], "left").select("s_suppkey", kind.alias("class"), F.coalesce("candidates", F.lit("")).alias("candidates"))


@query(r"""SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '\', '\\'), '=', '\='), ';', '\;'), '#', '\#'), chr(10), ' ')) AS escaped FROM documents""")
def chapter_escapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(S.chapter_escaped(F.col("text")), 256).alias("escaped"))


@query("""WITH f AS (SELECT l_orderkey, 'Book ' || l_orderkey || CASE l_returnflag WHEN 'R' THEN '/CD' || (l_linenumber % 3) WHEN 'A' THEN '/Part 1' ELSE '' END || '/' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || '.mp3' AS path, l_returnflag <> 'N' AS disc FROM lineitem)
SELECT 'Book ' || l_orderkey AS group_key, string_agg(DISTINCT path, '|' ORDER BY path) AS members, bool_or(disc) AS folded FROM f GROUP BY l_orderkey""")
def group_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files grouped by their nearest folder that is no disc, in path order."""
    folder = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("/CD"), (F.col("l_linenumber") % 3).cast("string"))).when(F.col("l_returnflag") == "A", "/Part 1").otherwise("")
    path = F.concat(F.lit("Book "), F.col("l_orderkey").cast("string"), folder, F.lit("/"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lit(".mp3"))
    rows = table(spark, d, "lineitem").select(path.alias("path")).withColumn("group_key", media.group_directory(F.col("path")))
    disc = F.col("group_key") != media.directory(F.col("path"))
    return rows.groupBy("group_key").agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("members"), F.bool_or(disc).alias("folded"))
