"""Chains, clusters and entities over the driver's tables.

An order is superseded by its customer's next one if their statuses differ. Customers of one nation and segment follow one
another as sessions branched from sessions. Embeddings become the vectors of entities: each stands near the first of its
six, so that some pairs are close, some nearly, and most far apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import chains, entities, graph, nearby
from .registry import Tables, query

# Chains.
NEXT = "(SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN lead(o_orderstatus) OVER w <> o_orderstatus THEN lead(o_orderkey) OVER w END AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
LINK = f"(SELECT *, sum(broken) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM (SELECT *, coalesce((lag(superseded_by) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL)::INT, 1) AS broken FROM {NEXT}))"


def superseded(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    changed = F.lead("o_orderstatus").over(w) != F.col("o_orderstatus")
    return t.orders.select("o_orderkey", "o_orderdate", F.when(changed, F.lead("o_orderkey").over(w)).alias("superseded_by"))


def links(t: Tables) -> DataFrame:
    return superseded(t).select(F.col("o_orderkey").alias("source"), F.col("superseded_by").alias("target"))


@query(f"""
WITH l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY o_custkey, run ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey, run) AS n FROM {LINK})
SELECT a.o_orderkey AS start, b.o_orderkey AS node, b.place - a.place AS step FROM l a JOIN l b ON a.o_custkey = b.o_custkey AND a.run = b.run AND b.place BETWEEN a.place AND a.place + 20 WHERE a.n > 1""")
def join_self_supersede(t: Tables) -> DataFrame:
    """What supersedes every fact, step by step, up to 20 steps."""
    return chains.reaches(links(t), 20).select("start", "node", F.col("step").cast("bigint").alias("step"))


@query(f"""
SELECT o_orderkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) OVER w AS head, row_number() OVER (PARTITION BY o_custkey, run ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER w AS n
FROM {LINK} WINDOW w AS (PARTITION BY o_custkey, run) QUALIFY n > 1""")
def mem_timeline(t: Tables) -> DataFrame:
    """Every fact's timeline, which is that of all facts with the same last one: its place in order of time, and its length."""
    found = chains.heads(links(t)).join(t.orders.select(F.col("o_orderkey").alias("node"), "o_orderdate"), "node")
    size = found.groupBy("head").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("head").orderBy("o_orderdate", "node")).cast("bigint")
    return found.withColumn("place", place).join(size, "head").select(F.col("node").alias("o_orderkey"), "head", "place", "n")


@query("""
WITH c AS MATERIALIZED (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS place FROM customer)
SELECT a.c_custkey AS session, b.c_custkey AS ancestor, a.place - b.place AS step FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND b.place BETWEEN a.place - 100 AND a.place - 1""")
def join_session_ancestors(t: Tables) -> DataFrame:
    """Ancestors of every session, up to 100."""
    parent = F.lag("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    branches = t.customer.select(F.col("c_custkey").alias("source"), parent.alias("target"))
    found = chains.reaches(branches, 100).where("step > 0")
    return found.select(F.col("start").alias("session"), F.col("node").alias("ancestor"), F.col("step").cast("bigint").alias("step"))


# Similar vectors.
COSINE = "list_sum([x[1]::DOUBLE * x[2]::DOUBLE for x in list_zip({0}, {1})]) / (sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in {0}])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in {1}])))"
NEAR = "(SELECT e.vec_id, e.label % 3 AS type, [x[1]::DOUBLE + 0.4 * x[2]::DOUBLE for x in list_zip(a.embedding, e.embedding)] AS vector FROM embeddings e JOIN embeddings a ON a.vec_id = e.vec_id - e.vec_id % 6)"
L2 = "sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip({0}, {1})]))"
REACH = """
r AS (SELECT DISTINCT vec_id AS node, vec_id AS low FROM n UNION SELECT l.a, r.low FROM r JOIN l ON l.b = r.node)
"""


def near(t: Tables) -> DataFrame:
    first = t.embeddings.select(F.col("vec_id").alias("first"), F.col("embedding").alias("anchor"))
    own = t.embeddings.withColumn("first", F.col("vec_id") - F.col("vec_id") % 6).join(first, "first")
    vector = F.zip_with("anchor", "embedding", lambda a, x: a.cast("double") + 0.4 * x.cast("double"))
    return own.select("vec_id", (F.col("label") % 3).alias("type"), vector.alias("vector"))


@query(f"SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COSINE.format('a.embedding', 'b.embedding')} >= 0.3")
def join_pairwise_similarity(t: Tables) -> DataFrame:
    """Pairs of one label whose cosine reaches the threshold. Equal vectors are compared once and listed as pairs only here."""
    unit = t.embeddings.withColumn("x", nearby.unit(F.col("embedding")))
    nodes, members = nearby.nodes_of(unit, "vec_id", "x", ["label"])
    pairs = nearby.cosine_pairs(nodes, 0.3, ["label"]).select(F.col("u").alias("node"), F.col("v").alias("other"))
    both = pairs.unionByName(nodes.select("node", F.col("node").alias("other")))
    mine, theirs = members.select("node", F.col("vec_id").alias("a")), members.select(F.col("node").alias("other"), F.col("vec_id").alias("b"))
    out = both.join(mine, "node").join(theirs, "other").where("node <> other OR a < b")
    return out.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


@query(f"""
WITH RECURSIVE n AS MATERIALIZED {NEAR},
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE {COSINE.format('a.vector', 'b.vector')} >= 0.86),{REACH}
SELECT node AS vec_id, min(low) AS cluster FROM r GROUP BY node""")
def set_semantic_clusters(t: Tables) -> DataFrame:
    """Clusters of vectors that are linked by cosines at the threshold."""
    nodes, members = nearby.nodes_of(near(t).withColumn("x", nearby.unit(F.col("vector"))), "vec_id", "x")
    found = graph.components(nodes.select("node"), nearby.cosine_pairs(nodes, 0.86).select("u", "v"))
    return members.join(found, "node").select("vec_id", F.col("component").alias("cluster"))


# Entities.
BOUND = (2 * (1 - 0.85)) ** 0.5
MAPPING = f"""
n AS MATERIALIZED {NEAR},
told AS MATERIALIZED (SELECT doc_id AS vec_id, doc_id + 1 AS alias FROM labels WHERE quality = 1),
d AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, {L2.format('a.vector', 'b.vector')} AS far FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.type = b.type),
l AS MATERIALIZED (SELECT a, b FROM d WHERE far <= {BOUND} OR far <= {BOUND * 1.3} AND ((a, b) IN (SELECT vec_id, alias FROM told) OR (b, a) IN (SELECT vec_id, alias FROM told))),{REACH},
m AS MATERIALIZED (SELECT node AS vec_id, min(low) AS canonical FROM r GROUP BY node)"""


def mapping(t: Tables) -> DataFrame:
    told = t.labels.where("quality = 1").select(F.col("doc_id").alias("vec_id"), F.array(F.concat(F.lit("E"), F.col("doc_id") + 1)).alias("aliases"))
    rows = near(t).join(told, "vec_id", "left").select(F.col("vec_id").alias("id"), F.concat(F.lit("e"), "vec_id").alias("name"), "type", "vector", "aliases")
    return entities.canonical(rows, BOUND, ["type"])


@query(f"WITH RECURSIVE {MAPPING} SELECT vec_id, canonical FROM m")
def set_entity_merge(t: Tables) -> DataFrame:
    """Each entity's canonical one: nearest of its kind within the bound, or a little beyond it where an alias says so."""
    return mapping(t).select(F.col("id").alias("vec_id"), "canonical")


RELATIONS = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS subject, l_returnflag AS predicate, l_partkey AS object, l_discount AS confidence FROM lineitem)"


@query(f"""
WITH RECURSIVE {MAPPING},
p AS (SELECT r.id, coalesce(s.canonical, subject) AS subject, predicate, coalesce(o.canonical, object) AS object, confidence FROM {RELATIONS} r LEFT JOIN m s ON s.vec_id = subject LEFT JOIN m o ON o.vec_id = object)
SELECT subject, predicate, object, count(*) AS n, max(confidence) AS confidence, arg_min(id, (-confidence, id)) AS id FROM p GROUP BY ALL""")
def kg_merge(t: Tables) -> DataFrame:
    """Relations between canonical entities, one for each triple."""
    relations = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.col("l_partkey").alias("object"), F.col("l_discount").alias("confidence"))
    return entities.repointed(relations, mapping(t))


# Similar token sets.
TOKENS = "list_sort(list_distinct(string_split(lower(concat_ws(' ', p_type, p_brand, p_size)), ' ')))"


@query(f"""
WITH n AS MATERIALIZED (SELECT w, min(p_partkey) AS node FROM (SELECT p_partkey, {TOKENS} AS w FROM part) GROUP BY w)
SELECT a.node AS u, b.node AS v FROM n a JOIN n b ON a.node < b.node WHERE len(list_intersect(a.w, b.w)) >= 0.6 * least(len(a.w), len(b.w))""")
def join_token_overlap(t: Tables) -> DataFrame:
    """Links between different token sets, of which the smaller has three fifths in the larger; clusters rest on such links."""
    sets = t.part.select("p_partkey", F.array_sort(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand", F.col("p_size").cast("string"))), " "))).alias("s"))
    found = graph.overlapping(sets.groupBy("s").agg(F.min("p_partkey").alias("node")), 0.6)
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


@query(f"SELECT vec_id, round(far, 6) AS distance FROM (SELECT vec_id, {L2.format('vector', 'q')} AS far FROM {NEAR}, (SELECT vector AS q FROM {NEAR} WHERE vec_id = 6)) WHERE far <= {BOUND}")
def math_l2_alias_bound(t: Tables) -> DataFrame:
    """Vectors of a table within the distance that a cosine of 0.85 between unit vectors is."""
    asked = near(t).where("vec_id = 6").limit(1).select(F.col("vector").alias("q"))  # one row
    return near(t).crossJoin(F.broadcast(asked)).withColumn("d", N.l2(F.col("vector"), F.col("q"))).where(F.col("d") <= BOUND).select("vec_id", F.round("d", 6).alias("distance"))
