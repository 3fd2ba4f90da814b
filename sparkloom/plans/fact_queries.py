"""Facts, scopes, graph, jobs and traces.

orders are versions of facts: the key is the customer, a version is valid from its date until the next of the key.
lineitem bridges facts to scopes; customers, suppliers, parts and nations are a graph; events are traces and jobs.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import history, ranking
from ..sources import version_store
from ..sources.version_store import VersionStore
from .registry import Tables, query

AS_OF, KNOWN = "1998-01-01", "1999-01-01"
at = lambda x: F.lit(x).cast("timestamp_ntz")
VERSIONS = "(SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, o_orderdate AS recorded_at, row_number() OVER w AS revision, o_totalprice AS value, o_orderstatus AS status, o_orderpriority AS priority FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def versions(t: Tables) -> DataFrame:
    facts = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("valid_from"), F.col("o_orderdate").alias("recorded_at"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return history.closed(facts, ["k"], [F.asc("recorded_at"), F.asc("id")]).withColumnRenamed("recorded_to", "valid_to")


def snapshot(t: Tables, valid: str, known: str) -> DataFrame:
    return history.as_of(versions(t), ["k"], at(valid), at(known), [F.desc("revision")])


SNAP = f"(SELECT * FROM {VERSIONS} WHERE valid_from <= TIMESTAMP '{{0}}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{{0}}') AND recorded_at <= TIMESTAMP '{{1}}' QUALIFY row_number() OVER (PARTITION BY k ORDER BY revision DESC) = 1)"


def fact_store(t: Tables) -> VersionStore:
    """The orders as versions, laid out by the time in which they are valid."""
    facts = versions(t).drop("revision", "valid_to")
    return version_store.of_table(facts, f"{t.sf_dir}/orders.parquet", "facts", "k", ["id"])


def asked(t: Tables, valid: str, known: str, content: str) -> DataFrame:
    found = fact_store(t).as_of(datetime.fromisoformat(valid), datetime.fromisoformat(known), ["id", "value", "status", "priority"])
    return found.where(content).select("k", "id", "revision", "value")


ASKED = f"SELECT k, id, revision, value FROM {SNAP.format(AS_OF, KNOWN)} WHERE {{}}"


@query(ASKED.format("TRUE"))
def join_bitemporal_asof(t: Tables) -> DataFrame:
    return asked(t, AS_OF, KNOWN, "TRUE")


@query(ASKED.format("status = 'F'"))
def mem_bitemporal_query(t: Tables) -> DataFrame:
    return asked(t, AS_OF, KNOWN, "status = 'F'")


@query(ASKED.format("priority LIKE '1%'"))
def date_bitemporal_valid(t: Tables) -> DataFrame:
    return asked(t, AS_OF, KNOWN, "priority LIKE '1%'")


@query(f"""
SELECT k, id, revision, value FROM (SELECT * FROM {VERSIONS}
 WHERE valid_from <= TIMESTAMP '2000-06-01' AND recorded_at <= TIMESTAMP '1997-03-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2000-06-01' OR valid_to > TIMESTAMP '1997-03-01')
 QUALIFY row_number() OVER (PARTITION BY k ORDER BY revision DESC) = 1) WHERE status <> 'P'""")
def mem_bitemporal_known_before(t: Tables) -> DataFrame:
    """What was thought in 1997 to hold in 2000: what ended later had not ended then."""
    return asked(t, "2000-06-01", "1997-03-01", "status <> 'P'")


query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1", "win_latest_version")(lambda t: ranking.latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice"))
query(f"SELECT k, id, revision, epoch(valid_to)::BIGINT AS recorded_to FROM {VERSIONS}", "mem_version_append")(lambda t: versions(t).select("k", "id", F.col("revision").cast("bigint").alias("revision"), F.unix_timestamp(F.col("valid_to").cast("timestamp")).alias("recorded_to")))
query(f"SELECT id, revision, value FROM {VERSIONS} WHERE k = 7 ORDER BY revision DESC", "mem_versions")(lambda t: versions(t).where("k = 7").select("id", F.col("revision").cast("bigint").alias("revision"), "value").orderBy(F.desc("revision")))
query("SELECT o_custkey AS k, count(*) AS revision, max(o_totalprice) AS best, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey", "mem_upsert")(lambda t: t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("revision"), F.max("o_totalprice").alias("best"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status")))


@query(f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change,
 CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN concat_ws(',', CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value' END, CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END) END AS fields
 FROM {SNAP.format('1996-06-01', KNOWN)} a FULL JOIN {SNAP.format('1999-06-01', '2000-01-01')} b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.value IS DISTINCT FROM b.value OR a.status IS DISTINCT FROM b.status""")
def join_fact_diff_full_outer(t: Tables) -> DataFrame:
    return history.differences(snapshot(t, "1996-06-01", KNOWN), snapshot(t, "1999-06-01", "2000-01-01"), "k", ["value", "status"])


NOW = "2001-09-01"
AGE = f"(epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 86400.0"
DECAY = f"CASE WHEN {AGE} > 90 THEN 0 ELSE (o_orderkey % 5 + 1) * exp(-0.01 * greatest({AGE}, 0)) END"
importance = lambda: F.col("o_orderkey") % 5 + 1
query(f"SELECT o_orderkey, round({DECAY}, 6) AS score FROM orders", "math_decay")(lambda t: t.orders.select("o_orderkey", F.round(N.decay(importance(), F.col("o_orderdate"), at(NOW)), 6).alias("score")))
query(f"SELECT o_orderkey, round(least(greatest(exp(-0.01 * {AGE}), 0), 1), 6) AS freshness FROM orders", "math_freshness")(lambda t: t.orders.select("o_orderkey", F.round(N.clamped(N.decay(F.lit(1.0), F.col("o_orderdate"), at(NOW), ttl_days=1e9)), 6).alias("freshness")))
query(f"SELECT o_orderkey, round((0.35 * least(o_totalprice / 500000.0, 1) + 0.15 * exp(-0.01 * {AGE}) + 0.25 * (o_orderkey % 5) / 4.0 + 0.15 * 0.8 + 0.1 * 0.5) / 1.0, 6) AS score FROM orders", "math_weighted_average")(
    lambda t: t.orders.select("o_orderkey", F.round(N.weighted_average([(0.35, F.col("o_totalprice") / 500000.0), (0.15, F.exp(-0.01 * N.days_between(at(NOW), F.col("o_orderdate")))), (0.25, (importance() - 1) / 4.0), (0.15, F.lit(0.8)), (0.10, F.lit(0.5))]), 6).alias("score"))
)
query(f"SELECT o_orderkey, round(exp(-0.01 * {AGE}), 6) AS freshness FROM orders WHERE abs(exp(-0.01 * {AGE}) - 0.5) >= 0.01", "mem_decay_batch")(lambda t: t.orders.withColumn("f", F.exp(-0.01 * N.days_between(at(NOW), F.col("o_orderdate")))).where(F.abs(F.col("f") - 0.5) >= 0.01).select("o_orderkey", F.round("f", 6).alias("freshness")))
query(f"SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND {AGE} > 30) OR (o_orderkey % 5 + 1 <= 1 AND exp(-0.01 * {AGE}) <= 0.1 AND {AGE} > 60)", "mem_purge_stale")(
    lambda t: t.orders.withColumn("age", N.days_between(at(NOW), F.col("o_orderdate"))).where(((F.col("o_orderstatus") == "O") & (F.col("age") > 30)) | ((importance() <= 1) & (F.exp(-0.01 * F.col("age")) <= 0.1) & (F.col("age") > 60))).select("o_orderkey")
)
query(f"SELECT o_orderkey FROM orders WHERE o_orderdate + to_days(365) <= TIMESTAMP '{NOW}' AND o_orderstatus <> 'P'", "mem_expire")(lambda t: t.orders.where((F.col("o_orderdate") + F.expr("interval 365 days") <= at(NOW)) & (F.col("o_orderstatus") != "P")).select("o_orderkey"))
query(f"SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '{NOW}' - to_days(730) GROUP BY 1", "mem_retention")(lambda t: t.orders.where(F.col("o_orderdate") < at(NOW) - F.expr("interval 730 days")).groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month")).agg(F.count("*").alias("n")))
query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS place FROM orders QUALIFY place > 5", "mem_cap")(lambda t: history.capped(t.orders, "o_custkey", [F.desc("o_totalprice"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey", "place"))
query("SELECT o_custkey, least(1 + sum(0.1), 5)::DOUBLE AS importance FROM orders GROUP BY o_custkey", "mem_recall_boost")(lambda t: t.orders.groupBy("o_custkey").agg(F.round(F.least(1 + F.sum(F.lit(0.1)), F.lit(5.0)), 6).alias("importance")))
query("SELECT o_orderkey, 'expired' AS reason FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 5000", "mem_archive")(lambda t: t.orders.where("o_orderstatus = 'F' AND o_totalprice < 5000").select("o_orderkey", F.lit("expired").alias("reason")))
query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "mem_consolidate_select")(lambda t: t.orders.where("o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey"))
query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%-%' AND (o_totalprice, o_orderkey) < (400000.0, 1000) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50", "mem_list")(lambda t: t.orders.where("o_orderpriority LIKE '%-%' AND (o_totalprice < 400000.0 OR (o_totalprice = 400000.0 AND o_orderkey < 1000))").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(50).select("o_orderkey"))
query("SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 20", "agg_list_and_count")(lambda t: page(t.orders.where("o_totalprice > 300000"), 20))
query("SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 25", "agg_count_over")(lambda t: page(t.orders.where("o_orderstatus = 'P'"), 25))
query("SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY o_orderkey LIMIT 25", "mem_structured_query")(lambda t: page(t.orders.where("o_orderstatus = 'F'").join(t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi"), 25))


def page(rows: DataFrame, k: int) -> DataFrame:
    """A page and the total, which is one row: neither brings all rows together."""
    return rows.orderBy("o_orderkey").limit(k).select("o_orderkey").crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


query("SELECT o_orderkey FROM orders ORDER BY (o_orderkey % 5) DESC, o_totalprice DESC, o_orderkey LIMIT 30", "topk_important_memories")(lambda t: t.orders.orderBy((F.col("o_orderkey") % 5).desc(), F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey"))
query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'", "mem_active_users")(lambda t: t.orders.where(F.col("o_orderdate") >= at("2001-01-01")).select("o_custkey").distinct())
query(f"SELECT k, id FROM {VERSIONS} WHERE status = 'F' AND valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')", "filter_memory_active")(lambda t: versions(t).where((F.col("status") == "F") & (F.col("valid_from") <= at(AS_OF)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at(AS_OF)))).select("k", "id"))

# Scopes.
SCOPED = "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey IN (1, 2, 3)){}"
scoped = lambda t, how="left_semi": t.orders.join(t.lineitem.where("l_suppkey IN (1, 2, 3)").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", how).select("o_orderkey")
query(SCOPED.format(" AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_partkey % 3 = 0)"), "filter_memory_scope")(lambda t: scoped(t).join(t.lineitem.where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"))
query("SELECT DISTINCT o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey IN (1, 2, 3)) OR NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)", "join_scope_exists")(
    lambda t: t.orders.join(scoped(t).unionByName(t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")), "o_orderkey", "left_semi").select("o_custkey").distinct()
)
query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", "join_in_subquery_tenant")(lambda t: t.orders.join(t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey"))
query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::BIGINT IN (1, 5, 9)", "join_json_each_in")(lambda t: t.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).join(F.broadcast(t.spark.createDataFrame([("[1,5,9]",)], "ids string").select(F.explode(F.from_json("ids", "array<bigint>")).alias("k"))), "k", "left_semi").select("event_id"))
query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)", "join_not_exists_orphans")(lambda t: t.orders.join(t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey"))
query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)", "join_anti_fts_backfill")(lambda t: t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti"))
query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)", "join_missing_summary_vectors")(lambda t: t.documents.where("lang = 'en'").select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti"))
query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS without_row", "kg_reconcile_vectors")(
    lambda t: t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").agg(F.count("*").alias("without_vector")).crossJoin(t.embeddings.select(F.col("vec_id").alias("doc_id")).join(t.documents.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("without_row")))
)
query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en'", "join_fts_content")(lambda t: t.documents.where("lang = 'en'").select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id"))
query("SELECT o.o_orderkey, c.c_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_partkey = 10", "join_chat_search")(lambda t: t.lineitem.where("l_partkey = 10").select(F.col("l_orderkey").alias("o_orderkey")).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "c_name"))
query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", "join_files_meetings")(lambda t: t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name"))
query("SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id HAVING count(*) >= 4", "join_unsummarized_sessions")(lambda t: t.conversations.select("conv_id").join(t.conversations.where("role = 'system'").select("conv_id"), "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 4"))
query("SELECT o_orderkey, unnest(string_split(concat(o_custkey, ',', o_orderkey % 10), ','))::BIGINT AS id FROM orders", "join_recursive_split")(lambda t: t.orders.select("o_orderkey", F.explode(F.transform(F.split(F.concat("o_custkey", F.lit(","), F.col("o_orderkey") % 10), ","), lambda x: x.cast("bigint"))).alias("id")))
query("SELECT l_partkey, max(l_extendedprice) AS score, min(l_orderkey) AS first FROM lineitem WHERE l_suppkey = 5 GROUP BY l_partkey", "join_parent_child")(lambda t: t.lineitem.where("l_suppkey = 5").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("score"), F.min("l_orderkey").alias("first")))
query(None, "join_sibling_chunks_whole")(lambda t: siblings(t, t.documents))
query("SELECT DISTINCT s_suppkey FROM supplier WHERE lower(s_name) IN (SELECT lower(s_name) FROM supplier WHERE s_nationkey = 4)", "join_speaker_mapping")(lambda t: t.supplier.withColumn("k", F.lower("s_name")).join(t.supplier.where("s_nationkey = 4").select(F.lower("s_name").alias("k")), "k", "left_semi").select("s_suppkey").distinct())
query("SELECT DISTINCT n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2", "join_known_speakers")(lambda t: t.supplier.join(t.nation.where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name")).distinct())
query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (1, 2, 4, 5, 7, 8) ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 30", "join_ready_files")(lambda t: t.orders.where("o_orderstatus = 'F' AND o_custkey IN (1, 2, 4, 5, 7, 8)").orderBy("o_custkey", "o_orderdate", "o_orderkey").limit(30).select("o_orderkey", "o_custkey"))
query("SELECT c_custkey, coalesce(n, 0) AS n, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey", "join_file_summaries")(lambda t: file_summaries(t.customer, t.orders))
query(None, "join_file_summaries_whole")(lambda t: file_summaries(t.customer, t.orders))
query("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name", "join_meeting_summaries")(lambda t: t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n")))
query("SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)", "join_rebuild_sources")(lambda t: rebuild_sources(t))
query(None, "join_rebuild_sources_whole")(lambda t: rebuild_sources(t))
query("SELECT n_name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS aliases FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "join_project_materials")(lambda t: t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("aliases")))
query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1", "join_project_file_ids")(lambda t: t.customer.join(F.broadcast(t.nation.where("n_regionkey = 1")), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey"))
query(None, "join_continuation_diff_whole")(lambda t: continuation_diff(t, t.orders))
query("SELECT p_partkey, round(least(0.3, 0.1 * (contains(lower(p_name), 'part')::INT + contains(lower(p_name), '00')::INT) + 0.05 * contains(lower(p_type), 'brass')::INT), 6)::DOUBLE AS prior FROM part", "join_theta_title_contains")(
    lambda t: t.part.select("p_partkey", F.round(F.least(F.lit(0.3), F.aggregate(F.array(F.lit("part"), F.lit("00")), F.lit(0.0), lambda s, x: s + 0.1 * F.contains(F.lower("p_name"), x).cast("int")) + 0.05 * F.contains(F.lower("p_type"), F.lit("brass")).cast("int")), 6).alias("prior"))
)


# Names that end in _whole are the same queries, tested against brute force in tests/test_whole_queries.py.
def rebuild_sources(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


def siblings(t: Tables, documents: DataFrame) -> DataFrame:
    """The two last other documents of a document's source and language. Of a group only its last three meet the others,
    so no pairs of a group are listed; doc_id is the key of documents."""
    last = ranking.top_per(t.documents.select(F.col("doc_id").alias("sibling"), "source", "lang"), ["source", "lang"], [F.desc("sibling")], 3).select("sibling", "source", "lang")
    met = documents.select("doc_id", "source", "lang").join(last, ["source", "lang"]).where("doc_id <> sibling")
    return ranking.top_per(met, ["doc_id"], [F.desc("sibling")], 2).select("doc_id", "sibling")


def file_summaries(customers: DataFrame, orders: DataFrame) -> DataFrame:
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return customers.select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


def continuation_diff(t: Tables, saved: DataFrame) -> DataFrame:
    now = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice")
    state = F.when(F.col("o_totalprice").isNull(), "deleted").when(F.col("o_totalprice") > F.col("saved"), "changed").otherwise("same")
    return saved.select("o_orderkey", F.lit(200000.0).alias("saved")).join(now, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


def merged(relations: DataFrame) -> DataFrame:
    return relations.select(F.when(F.col("s").isin(2, 3), 1).otherwise(F.col("s")).cast("bigint").alias("s"), "p").distinct()


def profile_sources(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("valid"))


ALIASES = [("the", 1), ("the of", 2), ("and", 3)]


@query("SELECT doc_id, project FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'the of') THEN 2 WHEN contains(lower(text), 'the') THEN 1 END AS project FROM documents) WHERE project IS NOT NULL UNION ALL SELECT doc_id, 3 FROM documents WHERE contains(lower(text), 'and')")
def join_project_alias_longest(t: Tables) -> DataFrame:
    """Aliases that a text holds, of those that lie in one another the longest."""
    aliases = t.spark.createDataFrame(ALIASES, "alias string, project int")  # a dictionary of fixed size
    hits = t.documents.select("doc_id", "text").join(F.broadcast(aliases), F.contains(F.lower("text"), F.col("alias"))).select("doc_id", "alias", "project")
    longer = hits.select(F.col("doc_id").alias("d"), F.col("alias").alias("long"))
    return hits.join(longer, (F.col("d") == F.col("doc_id")) & (F.col("long") != F.col("alias")) & F.contains("long", F.col("alias")), "left_anti").select("doc_id", "project")


query("SELECT e.event_id, count(*) AS n FROM events e JOIN events o ON o.user_id = e.user_id AND o.ts < e.ts + INTERVAL 1 HOUR AND o.ts > e.ts - INTERVAL 1 HOUR GROUP BY e.event_id", "join_interval_overlap_speakers")(
    lambda t: history.within(t.events, ["user_id"], "ts", 3_600_000_000, "n").select("event_id", "n")
)
query("SELECT d.doc_id, CASE WHEN l.quality = 1 AND coalesce(l.toxic, 0) = 0 THEN 'approved' WHEN l.quality IS NULL THEN 'unreviewed' ELSE 'rejected' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR (l.quality = 1 AND l.toxic = 0)", "filter_evidence_policy")(
    lambda t: t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("status", F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), "approved").when(F.col("quality").isNull(), "unreviewed").otherwise("rejected")).where("status <> 'rejected'").select("doc_id", "status")
)
query("SELECT doc_id, (n - 5 * bonus) AS score FROM (SELECT doc_id, n_chars % 100 AS n, (quality = 1)::INT AS bonus FROM documents JOIN labels USING (doc_id))", "math_material_boost")(lambda t: t.documents.select("doc_id", (F.col("n_chars") % 100).alias("n")).join(t.labels.select("doc_id", (F.col("quality") == 1).cast("int").alias("bonus")), "doc_id").select("doc_id", (F.col("n") - 5 * F.col("bonus")).alias("score")))


# Graph: suppliers supply parts.
EDGES = "(SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)"
edges = lambda t: t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
query(f"SELECT 'out' AS direction, p AS other FROM {EDGES} WHERE s = 3 UNION ALL SELECT 'in', s FROM {EDGES} WHERE p = 3", "join_entity_relations")(lambda t: edges(t).where("s = 3").select(F.lit("out").alias("direction"), F.col("p").alias("other")).unionByName(edges(t).where("p = 3").select(F.lit("in").alias("direction"), F.col("s").alias("other"))))
query(f"SELECT 'out' AS direction, p AS other FROM {EDGES} WHERE s IN (1, 2) UNION ALL SELECT 'in', s FROM {EDGES} WHERE p IN (1, 2)", "set_union_relations")(lambda t: edges(t).where("s IN (1, 2)").select(F.lit("out").alias("direction"), F.col("p").alias("other")).unionByName(edges(t).where("p IN (1, 2)").select(F.lit("in").alias("direction"), F.col("s").alias("other"))))
query(f"SELECT s, p FROM {EDGES} WHERE s IN (1, 2, 3) AND p % 2 = 0 QUALIFY row_number() OVER (PARTITION BY s ORDER BY p) <= 5", "join_kg_batch_neighbors")(lambda t: ranking.top_per(edges(t).where("s IN (1, 2, 3) AND p % 2 = 0"), ["s"], [F.asc("p")], 5).select("s", "p"))
query(None, "kg_merge_whole")(lambda t: merged(edges(t)))
query("SELECT l_suppkey, count(*) AS mentions, min(l_orderkey) AS first, max(l_orderkey) AS last, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS aliases FROM lineitem GROUP BY l_suppkey", "agg_entity_upsert")(lambda t: t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("mentions"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("aliases")))
query("SELECT l_suppkey, count(*) AS mentions FROM lineitem GROUP BY l_suppkey ORDER BY mentions DESC, l_suppkey LIMIT 20", "kg_list_entities")(lambda t: t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "l_suppkey").limit(20))
query("SELECT c_custkey, string_agg(a, ',' ORDER BY a) AS aliases FROM (SELECT DISTINCT c_custkey, unnest([lower(trim(c_mktsegment)), lower(c_name), 'building']) AS a FROM customer) WHERE a <> 'building' GROUP BY c_custkey", "set_alias_normalise")(
    lambda t: t.customer.select("c_custkey", F.array_join(F.array_sort(F.array_remove(F.array_distinct(F.transform(F.array("c_mktsegment", "c_name", F.lit(" Building ")), lambda x: F.lower(F.trim(x)))), F.lit("building"))), ",").alias("aliases"))
)
query("SELECT a.k AS new_key, min(b.k) AS existing FROM (SELECT p_partkey AS k, string_split(lower(p_type), ' ') AS w FROM part WHERE p_partkey <= 100) a JOIN (SELECT p_partkey AS k, string_split(lower(p_type), ' ') AS w FROM part WHERE p_partkey > 100) b ON len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.75 GROUP BY 1", "set_semantic_duplicate_key")(lambda t: duplicate_keys(t))


def duplicate_keys(t: Tables) -> DataFrame:
    """The first old key whose tokens overlap by three quarters with a new key's. Only keys with a token in common meet,
    and each set of tokens once."""
    keys = t.part.select(F.col("p_partkey").alias("k"), F.array_sort(F.array_distinct(F.split(F.lower("p_type"), " "))).alias("w"))
    old = keys.where("k > 100").groupBy("w").agg(F.min("k").alias("existing"))
    new = keys.where("k <= 100")
    met = new.withColumn("token", F.explode("w")).join(old.select("existing", F.col("w").alias("v"), F.explode("w").alias("token")), "token")
    close = F.size(F.array_intersect("w", "v")) / F.least(F.size("w"), F.size("v")) >= 0.75
    return met.where(close).groupBy(F.col("k").alias("new_key")).agg(F.min("existing").alias("existing"))


query("SELECT l_orderkey, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS scopes FROM lineitem GROUP BY l_orderkey", "set_scope_encode")(lambda t: t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("scopes")))
query("SELECT l_partkey % 50 AS cluster, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS scopes FROM lineitem GROUP BY 1", "agg_scope_union")(lambda t: t.lineitem.groupBy((F.col("l_partkey") % 50).alias("cluster")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("scopes")))
query("SELECT o_orderpriority, o_custkey % 20 AS cluster, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 3 AND bool_or(o_orderdate >= TIMESTAMP '2001-07-01')", "set_consolidation_candidates")(lambda t: t.orders.groupBy("o_orderpriority", (F.col("o_custkey") % 20).alias("cluster")).agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderdate") >= at("2001-07-01")).alias("recent")).where("n >= 3 AND recent").drop("recent"))
query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag <> 'R') = 0", "mem_detach_evidence")(lambda t: t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("n")).where("n = 0").select("l_orderkey"))
query("SELECT o_orderkey FROM orders WHERE o_custkey IN (11, 13) AND o_orderstatus <> 'F'", "mem_retract_session")(lambda t: t.orders.where("o_custkey IN (11, 13) AND o_orderstatus <> 'F'").select("o_orderkey"))
query("SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = 9 AND o_orderstatus = 'O' AND l_quantity < 10", "mem_requalify")(lambda t: t.orders.where("o_orderstatus = 'O'").select("o_orderkey").join(t.lineitem.where("l_suppkey = 9 AND l_quantity < 10").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").distinct())
query("SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS valid FROM orders GROUP BY 1", "mem_profile_sources")(lambda t: profile_sources(t.orders))
query(None, "mem_profile_sources_whole")(lambda t: profile_sources(t.orders))
query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(turn // 2))), ',') AS scope FROM conversations GROUP BY conv_id", "mem_scope_from_messages")(lambda t: t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.floor(F.col("turn") / 2))), lambda x: x.cast("string")), ",").alias("scope")))
