"""Writes to indexes and memories, near duplicates, and searches in two hops, with the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import duplicates, ranking, recall, upserts
from .registry import Tables, query

# Near duplicates. A row for each document: what it repeats, and the source that the kept text also stands for.


def copies(t: Tables, least: float, size: int | None = None) -> DataFrame:
    kept = duplicates.keep_first(t.documents, "doc_id", "text", least, size)
    return kept.join(t.documents.select(F.col("doc_id").alias("rank"), "source"), "rank").select(F.col("rank").alias("doc_id"), F.col("head").alias("kept"), "source")


query(duplicates.sql(0.92), "set_pre_rerank_dedup")(lambda t: copies(t, 0.92))
query(f"SELECT * FROM ({duplicates.sql(0.85, 4)}) WHERE kept <> doc_id", "set_near_duplicate")(lambda t: copies(t, 0.85, 4).where("kept <> doc_id"))


# The lexical index: a row for each document, then for each of its lines.
CHANGED = """(SELECT d.doc_id, source, CASE WHEN quality = 1 THEN concat(text, ' approved after review') ELSE concat(text, ' reviewed') END AS content, quality
    FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"""SELECT doc_id, source AS meeting, md5(CASE WHEN quality IS NULL THEN text ELSE content END) AS content,
    len(regexp_extract_all(lower(CASE WHEN quality IS NULL THEN text ELSE content END), '[a-z0-9]+')) AS length,
    CASE WHEN quality IS NULL THEN concat('{{"lang":"', lang, '"}}') ELSE concat('{{"quality":', quality, '}}') END AS metadata
    FROM {CHANGED} JOIN documents USING (doc_id, source)""")
def sink_bm25_upsert(t: Tables) -> DataFrame:
    """The lexical index of documents after a batch that writes each labelled document once, and the approved ones again."""
    index = t.documents.select("doc_id", F.col("source").alias("meeting"), F.col("text").alias("content"), F.to_json(F.struct("lang")).alias("metadata"))
    named = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id")
    named = named.select("doc_id", F.col("source").alias("meeting"), "text", "quality", F.to_json(F.struct("quality")).alias("metadata"))
    first = named.withColumn("content", F.concat("text", F.lit(" reviewed"))).withColumn("revision", F.lit(1))
    again = named.where("quality = 1").withColumn("content", F.concat("text", F.lit(" approved after review"))).withColumn("revision", F.lit(2))
    after = upserts.upserted(index, first.unionByName(again), "doc_id", [F.desc("revision")])
    return after.select("doc_id", "meeting", F.md5("content").alias("content"), F.size(T.words(F.col("content"))).alias("length"), "metadata")


@query("""SELECT concat(doc_id, ':', n) AS chunk_id, source AS meeting, len(w) AS length, len(list_distinct(w)) AS terms, md5(line) AS content
    FROM (SELECT doc_id, source, n, parts[n] AS line, regexp_extract_all(lower(parts[n]), '[a-z0-9]+') AS w
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS n))
    WHERE len(w) > 0""")
def sink_docs_to_bm25(t: Tables) -> DataFrame:
    """Rows of the lexical index for prepared chunks, here lines; a line without terms has nothing to index."""
    lines = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("w", T.words(F.col("line")))
    made = F.concat(F.col("doc_id").cast("string"), F.lit(":"), (F.col("n") + 1).cast("string"))
    return lines.where(F.size("w") > 0).select(made.alias("chunk_id"), F.col("source").alias("meeting"), F.size("w").alias("length"), F.size(F.array_distinct("w")).alias("terms"), F.md5("line").alias("content"))


@query("""SELECT vec_id, label, CASE WHEN label % 2 <> 0 THEN 0 WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS revision,
    round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) * CASE WHEN label % 2 = 0 AND vec_id % 3 = 0 THEN 2 ELSE 1 END, 5) AS norm,
    (embedding[1] < 0) <> (label % 2 = 0 AND vec_id % 3 <> 0 AND embedding[1] <> 0) AS turned
    FROM embeddings""")
def sink_vector_upsert(t: Tables) -> DataFrame:
    """The vector index after a batch that replaces vectors of even labels, some of them twice."""
    index = t.embeddings.select("vec_id", "label", "embedding", F.lit(0).alias("revision"))
    scaled = lambda k, n: index.where("label % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: (x * k).cast("float"))).withColumn("revision", F.lit(n))
    after = upserts.upserted(index, scaled(-1, 1).unionByName(scaled(2, 2).where("vec_id % 3 = 0")), "vec_id", [F.desc("revision")])
    return after.select("vec_id", "label", "revision", F.round(F.sqrt(N.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), (F.element_at("embedding", 1) < 0).alias("turned"))


# Memories: orders are writes to the key of their priority; an urgent finished one supersedes what was of low priority.
WRITES = "(SELECT o_custkey AS owner, o_orderpriority AS key, o_orderdate AS made, o_orderkey AS id, o_totalprice AS value, o_orderstatus AS scope, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN '5-LOW' END AS supersedes FROM orders)"


@query(f"""WITH w AS {WRITES},
    s AS (SELECT owner, key, max((made, id)) AS last, arg_max(value, (made, id)) AS value, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes FROM w GROUP BY ALL),
    n AS (SELECT owner, supersedes AS key, max((made, id)) AS named FROM w WHERE supersedes IS NOT NULL GROUP BY ALL),
    j AS (SELECT s.*, coalesce(named > last, false) AS gone FROM s LEFT JOIN n ON n.owner = s.owner AND n.key = s.key)
    SELECT owner, key, value, scopes, CASE WHEN gone THEN 'superseded' WHEN row_number() OVER (PARTITION BY owner, gone ORDER BY value DESC, key) > 3 THEN 'evicted' ELSE 'active' END AS state FROM j""")
def mem_set_service(t: Tables) -> DataFrame:
    """The last value and all scopes of each key, its state after supersession and a cap of three keys."""
    gone = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), "5-LOW")
    writes = t.orders.select(
        F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("key"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("value"), F.col("o_totalprice").alias("importance"), F.col("o_orderstatus").alias("scope"), gone.alias("supersedes"),
    )
    return upserts.facts_set(writes, ["at", "id"], 3).withColumn("scopes", F.array_join("scopes", ","))


@query("""WITH f AS (SELECT o_orderkey AS key, o_custkey AS project, o_orderpriority AS p, o_orderstatus AS s, o_orderdate AS made,
        1 + o_orderkey % 2 AS revision, max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS winner FROM orders),
    g AS (SELECT winner, bool_and(s <> 'P') FILTER (key <> winner) AND winner % 7 <> 0 AND max(made) IS NOT NULL AS ok, max(made) FILTER (key = winner) AS won_at FROM f GROUP BY winner),
    r AS (SELECT f.*, coalesce(ok, false) AS ok, won_at FROM f JOIN g USING (winner))
    SELECT key, project, revision + ok::INT AS revision, CASE WHEN ok AND key = winner THEN 'confirmed' WHEN ok THEN 'superseded' WHEN s = 'P' THEN 'retracted' ELSE 'pending' END AS status,
        CASE WHEN ok AND key <> winner THEN coalesce(CASE WHEN s = 'F' THEN made END, won_at) WHEN s = 'F' THEN made END AS valid_to,
        CASE WHEN ok AND key <> winner THEN winner END AS superseded_by FROM r""")
def mem_supersede(t: Tables) -> DataFrame:
    """The newest order of a customer and priority supersedes the others it declares; every seventh request is out of date,
    and one that names a retracted fact fails."""
    status = F.when(F.col("o_orderstatus") == "P", "retracted").otherwise("pending")
    facts = t.orders.select(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("project"), (1 + F.col("o_orderkey") % 2).alias("revision"), status.alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("valid_to"),
    )
    newest = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct(F.col("o_orderkey").alias("winner"), F.col("o_orderdate").alias("at"))).alias("w"))
    newest = newest.select("o_custkey", "o_orderpriority", "w.winner", "w.at")
    stale = F.when(F.col("winner") % 7 == 0, 1).otherwise(0)
    requests = newest.select("winner", (1 + F.col("winner") % 2 + stale).alias("expected_revision"), "at")
    declared = t.orders.join(newest.drop("at"), ["o_custkey", "o_orderpriority"]).where("o_orderkey <> winner").select("winner", F.col("o_orderkey").alias("loser"))
    return upserts.resolved(facts, requests, declared, declared)


LAST = "(l_orderkey, l_linenumber, l_discount)"


@query(f"""SELECT l_suppkey, l_partkey, round(least(greatest(arg_max(l_discount, {LAST}) * 12 - 0.1, 0), 1), 6)::DOUBLE AS confidence,
    arg_max(l_returnflag, {LAST}) FILTER (l_returnflag <> 'N') AS session, arg_max(l_shipdate, {LAST}) FILTER (l_linestatus = 'F') AS valid_from,
    CASE WHEN arg_max(l_tax, {LAST}) > 0.04 THEN arg_max(l_shipdate, {LAST}) END AS valid_to
    FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL""")
def agg_relation_upsert(t: Tables) -> DataFrame:
    """The last write of a relation sets confidence and end, if null too; session and start keep the last that was given."""
    when = F.struct("l_orderkey", "l_linenumber", "l_discount")
    given = lambda c, cond: F.max_by(c, F.when(cond, when))
    last = lambda c: F.max_by(c, when)
    return t.lineitem.where("l_suppkey <> l_partkey").groupBy("l_suppkey", "l_partkey").agg(
        F.round(N.clamped(last("l_discount") * 12 - 0.1), 6).alias("confidence"),
        given("l_returnflag", F.col("l_returnflag") != "N").alias("session"),
        given("l_shipdate", F.col("l_linestatus") == "F").alias("valid_from"),
        F.when(last("l_tax") > 0.04, last("l_shipdate")).alias("valid_to"),
    )


# Several searches as one. A query is the vector of a number; content that isn't a document's is its own.
DISTANCE = "sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(embedding, q)]))"
NEAREST = "(SELECT vec_id, d, row_number() OVER (ORDER BY d, vec_id) AS r FROM (SELECT vec_id, {0} AS d FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = {1}) WHERE vec_id <> {1}) QUALIFY r <= {2})"


def nearest(t: Tables, number: int, k: int) -> DataFrame:
    """vec_id, distance and rank r of the k nearest to one vector, which is one row."""
    q = t.embeddings.where(F.col("vec_id") == number).select(F.col("embedding").alias("q"))
    near = t.embeddings.where(F.col("vec_id") != number).crossJoin(F.broadcast(q)).select("vec_id", N.l2(F.col("embedding"), F.col("q")).alias("d"))
    return ranking.top(near, [F.asc("d"), F.asc("vec_id")], k).withColumnRenamed("rank", "r")


def similarity(d: str | Column) -> Column:
    return N.relevance(F.col(d) if isinstance(d, str) else d, True)


@query(f"""SELECT vec_id, round(max(1 / (1 + d)), 6) AS score, row_number() OVER (ORDER BY min((hop, r))) AS rank
    FROM (SELECT *, 1 AS hop FROM {NEAREST.format(DISTANCE, 0, 50)} UNION ALL SELECT *, 2 FROM {NEAREST.format(DISTANCE, 1, 50)}) GROUP BY vec_id""")
def set_merge_vector_hops(t: Tables) -> DataFrame:
    """What two hops found, with the better similarity, in the order it was first seen."""
    both = nearest(t, 0, 50).withColumn("hop", F.lit(1)).unionByName(nearest(t, 1, 50).withColumn("hop", F.lit(2)))
    merged = both.groupBy("vec_id").agg(F.max(similarity("d")).alias("score"), F.min(F.struct("hop", "r")).alias("seen"))
    return ranking.ranked(merged, [F.asc("seen")]).select("vec_id", F.round("score", 6).alias("score"), "rank")


VARIANTS, WANTED, FETCH = 3, 10, 2
EACH = max(WANTED // VARIANTS, 3) * FETCH


@query(f"""SELECT text_key, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, text_key) AS rank FROM (
    SELECT coalesce(md5(text), concat('v', vec_id)) AS text_key, max(1 / (1 + d)) AS s
    FROM ({' UNION ALL '.join('SELECT * FROM ' + NEAREST.format(DISTANCE, q, EACH) for q in range(VARIANTS))}) LEFT JOIN documents ON doc_id = vec_id GROUP BY 1)
    QUALIFY rank <= {WANTED * FETCH}""")
def set_scoped_multi_query(t: Tables) -> DataFrame:
    """Variants of a query, each with its part of the fetch; the best score of each content, the best of all."""
    found = reduce(DataFrame.unionByName, (nearest(t, q, EACH) for q in range(VARIANTS)))
    texts = t.documents.select(F.col("doc_id").alias("vec_id"), F.md5("text").alias("h"))
    named = found.join(texts, "vec_id", "left").select(F.coalesce("h", F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("text_key"), similarity("d").alias("s"))
    best = ranking.top(named.groupBy("text_key").agg(F.max("s").alias("s")), [F.desc("s"), F.asc("text_key")], WANTED * FETCH)
    return best.select("text_key", F.round("s", 6).alias("score"), "rank")


QUESTION = ("the", "tion", "ment", "que")
SEEDS, HOP, LIMIT = 2, 20, 8
WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"
FACTS = f"(SELECT vec_id, embedding, {WORDS} AS w FROM embeddings JOIN documents ON doc_id = vec_id)"


@query(f"""WITH f AS {FACTS}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    one AS (SELECT vec_id, w, {DISTANCE} AS d FROM f, q WHERE vec_id <> 0 ORDER BY d, vec_id LIMIT {HOP}),
    seeds AS (SELECT vec_id, w, row_number() OVER (ORDER BY len(list_intersect(w, {list(QUESTION)})) DESC, d, vec_id) AS n FROM one WHERE len(list_intersect(w, {list(QUESTION)})) > 0 QUALIFY n <= {SEEDS}),
    e AS (SELECT list_distinct(list_concat({list(QUESTION)}, flatten(list(w)))) AS e FROM seeds HAVING count(*) > 0),
    two AS (SELECT vec_id, w, {DISTANCE} AS d FROM f, (SELECT embedding AS q FROM f SEMI JOIN (SELECT vec_id FROM seeds WHERE n = 1) USING (vec_id)) WHERE vec_id <> 0 ORDER BY d, vec_id LIMIT {HOP}),
    a AS (SELECT vec_id, min(d) AS d FROM (SELECT vec_id, d FROM one UNION ALL SELECT vec_id, d FROM two) GROUP BY vec_id),
    b AS (SELECT vec_id, len(list_intersect(w, e)) / least(len(w), len(e)) AS bridge FROM two, e WHERE len(list_intersect(w, e)) > 0),
    c AS (SELECT vec_id, d, CASE WHEN row_number() OVER (ORDER BY bridge DESC NULLS LAST, d, vec_id) <= {SEEDS} THEN bridge END AS bridge FROM a LEFT JOIN b USING (vec_id))
    SELECT vec_id, round(1 / (1 + d), 6) AS score, bridge IS NOT NULL AS bridged,
        row_number() OVER (ORDER BY bridge DESC NULLS LAST, d, vec_id) AS rank FROM c QUALIFY rank <= {LIMIT}""")
def mem_multi_hop(t: Tables) -> DataFrame:
    """Facts in two hops: of the nearest, those that share most words with the question are seeds; the second hop searches near
    the first seed, and what it shares words with the question and all seeds takes the reserved places. A hop is a bounded pool."""
    facts = t.embeddings.where("vec_id <> 0").join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    question = F.array(*map(F.lit, QUESTION))

    def hop(q: DataFrame) -> DataFrame:
        near = facts.crossJoin(F.broadcast(q)).withColumn("d", N.l2(F.col("embedding"), F.col("q")))
        return near.orderBy("d", "vec_id").limit(HOP).select("vec_id", "d", "embedding", F.array_distinct(T.tokens(F.col("text"))).alias("w"))

    one = hop(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")))
    shared = one.withColumn("o", F.size(F.array_intersect("w", question))).where("o > 0")
    seeds = ranking.top(shared, [F.desc("o"), F.asc("d"), F.asc("vec_id")], SEEDS)
    expanded = seeds.agg(F.flatten(F.collect_list("w")).alias("s")).where(F.size("s") > 0).select(F.array_union(question, F.col("s")).alias("e"))
    two = hop(seeds.where("rank = 1").select(F.col("embedding").alias("q")))
    bridge = two.crossJoin(F.broadcast(expanded)).select("vec_id", T.overlap_coefficient(F.col("w"), F.col("e")).alias("bridge")).where("bridge > 0")
    found = one.select("vec_id", "d").unionByName(two.select("vec_id", "d")).groupBy("vec_id").agg(F.min("d").alias("d")).join(bridge, "vec_id", "left")
    order = [F.desc_nulls_last("bridge"), F.asc("d"), F.asc("vec_id")]
    reserved = ranking.ranked(found, order, name="n").withColumn("bridge", F.when(F.col("n") <= SEEDS, F.col("bridge")))
    return ranking.top(reserved, order, LIMIT).select("vec_id", F.round(similarity("d"), 6).alias("score"), F.col("bridge").isNotNull().alias("bridged"), "rank")


# Recall. A document is a fact: its source is its scope, unless it is Spanish or French; a toxic label means that its text was
# edited after its vector was made, every seventh length that it has expired.
SCOPES = ("src1", "src2", "src3", "src4", "src5")
MEMORY = r"""(SELECT doc_id AS id, (n_chars % 7 <> 0) AS active, CASE WHEN lang IN ('en', 'de') THEN source END AS scope, (lang = 'fr' AND n_chars % 2 = 0) AS profile, (lang = 'es' AND n_chars % 4 = 0) AS legacy,
    n_chars % 5 + 1 AS importance, exp(-0.01 * (n_chars % 90)) AS freshness, CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.8 END AS confidence, CASE toxic WHEN 1 THEN 0.0 WHEN 0 THEN 0.5 ELSE 0.3 END AS usefulness,
    coalesce(toxic, 0) = 1 AS edited, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents LEFT JOIN labels USING (doc_id))"""


def facts(t: Tables) -> DataFrame:
    own = t.documents.join(t.labels, "doc_id", "left")
    n = F.col("n_chars")
    return own.select(
        F.col("doc_id").alias("id"), (1 + F.coalesce("toxic", F.lit(0))).alias("revision"), (n % 7 != 0).alias("active"), F.when(F.col("lang").isin("en", "de"), F.col("source")).alias("scope"),
        F.when((F.col("lang") == "fr") & (n % 2 == 0), "user_profile").alias("category"), ((F.col("lang") == "es") & (n % 4 == 0)).alias("legacy"), (n % 5 + 1).alias("importance"),
        F.exp(-0.01 * (n % 90)).alias("freshness"), F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.5).otherwise(0.8).alias("confidence"),
        F.when(F.col("toxic") == 1, 0.0).when(F.col("toxic") == 0, 0.5).otherwise(0.3).alias("usefulness"), "text",
    )


@query(f"""
WITH m AS {MEMORY},
a AS (SELECT * FROM m WHERE active AND importance >= 2 AND (scope IN {SCOPES} OR scope IS NULL AND (profile OR NOT legacy))),
v AS (SELECT id, embedding, w FROM a JOIN embeddings ON vec_id = id WHERE NOT edited),
one AS (SELECT id, w, {DISTANCE} AS d FROM v, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY d, id LIMIT 40),
seeds AS (SELECT id, w, row_number() OVER (ORDER BY len(list_intersect(w, {list(QUESTION)})) DESC, 1 / (1 + d) DESC, id) AS n FROM one WHERE len(list_intersect(w, {list(QUESTION)})) > 0 QUALIFY n <= 2),
e AS (SELECT list_distinct(list_concat({list(QUESTION)}, flatten(list(w)))) AS e FROM seeds HAVING count(*) > 0),
two AS (SELECT id, w, {DISTANCE} AS d FROM v, (SELECT embedding AS q FROM v SEMI JOIN (SELECT id FROM seeds WHERE n = 1) USING (id)) ORDER BY d, id LIMIT 16),
near AS (SELECT id, 1 / (1 + min(d)) AS similarity, any_value(len(list_intersect(w, e)) / least(len(w), len(e))) AS bridge FROM (SELECT * FROM one UNION ALL SELECT * FROM two) LEFT JOIN e ON TRUE GROUP BY id),
pool AS (SELECT id, max(similarity) AS similarity, max(bridge) AS bridge FROM (SELECT id, similarity, CASE WHEN bridge > 0 THEN bridge END AS bridge FROM near UNION ALL SELECT * FROM (SELECT id, 0.0, NULL FROM a ORDER BY importance DESC, id LIMIT 40)) GROUP BY id),
s AS (SELECT id, similarity, bridge, scope IS NULL AND NOT profile AS counted, round(0.35 * similarity + 0.15 * freshness + 0.25 * (importance - 1) / 4.0 + 0.15 * confidence + 0.10 * usefulness, 9) AS score FROM pool JOIN a USING (id)),
k AS (SELECT *, row_number() OVER (ORDER BY bridge DESC NULLS LAST, score DESC, id) AS n FROM (SELECT * FROM s QUALIFY NOT counted OR row_number() OVER (PARTITION BY counted ORDER BY score DESC, id) <= 3)),
r AS (SELECT id, score, similarity, CASE WHEN n <= 2 THEN bridge END AS bridge FROM k)
SELECT id, round(score, 6) AS score, round(similarity, 6) AS similarity, bridge IS NOT NULL AS bridged, row_number() OVER (ORDER BY bridge IS NULL, bridge DESC, score DESC, id) AS rank FROM r QUALIFY rank <= 8""")
def mem_semantic_search(t: Tables) -> DataFrame:
    """Facts recalled for a question within some scopes, among facts that have expired, were edited, or have no scope."""
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(1).alias("revision"), "embedding")
    query_vector = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    out = recall.recall(facts(t), vectors, query_vector, QUESTION, SCOPES, recall.Policy(least=2.0))
    return out.select("id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"), F.col("bridge").isNotNull().alias("bridged"), "rank")
