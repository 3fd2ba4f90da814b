"""Reranking, the review queue, the health of indexes, context from entities and facts with evidence, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import chunks, evidence, ranking
from . import strategies
from .index_queries import DISTANCE
from .registry import Tables, query
from .retrieval_queries import HEAD, POOL, head, order, pool

# Reranking. The scorer is the share of a question's words that a text has.
QUESTION = "the of and that"
SHARE = "round(len(list_intersect(list_distinct(string_split_regex(lower(text), '\\s+')), {0})) / len({0}), 6)"


def share(words: str) -> str:
    return SHARE.format(words.split())


@query(f"""SELECT doc_id, score, rank FROM (
        SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, max(score) OVER () AS best, count(*) OVER () AS n
        FROM (SELECT doc_id, {share(QUESTION)} AS score FROM {HEAD} JOIN (SELECT doc_id, text FROM documents) USING (doc_id)))
    WHERE rank <= CASE WHEN n >= 24 THEN greatest(16, n // 2) ELSE 16 END AND (score >= 0.1 OR (best < 0.1 AND rank <= 16))""")
def topk_rerank(t: Tables) -> DataFrame:
    """A scoped request for 16: of a pool of at least 24 half is kept, and what scores below 0.1 goes unless all do."""
    docs = head(t).join(t.documents.select("doc_id", "text"), "doc_id")
    return strategies.reranked(docs, QUESTION, "doc_id", "text", 16, 0.1).select("doc_id", "score", "rank")


REQUEST, SMALL = 60, 24


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY score DESC, doc_id) AS r FROM {POOL} QUALIFY r <= {REQUEST}),
    s AS (SELECT p.*, {share(QUESTION)} AS s, count(*) OVER (PARTITION BY meeting) AS n FROM p JOIN (SELECT doc_id, text FROM documents) USING (doc_id)),
    f AS (SELECT meeting, count(DISTINCT file) AS files FROM s GROUP BY meeting),
    a AS (SELECT s.*, greatest(16, n // 3, files) AS k, row_number() OVER (PARTITION BY meeting ORDER BY s DESC, doc_id) AS i,
        max(s) OVER (PARTITION BY meeting) AS best FROM s JOIN f USING (meeting) WHERE n >= {SMALL}),
    b AS (SELECT *, row_number() OVER (PARTITION BY meeting, file ORDER BY s DESC, doc_id) > 1 AS late FROM a WHERE s >= 0.05 OR (best < 0.05 AND i <= k)),
    c AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY late, s DESC, doc_id) AS rank FROM b)
    SELECT meeting, doc_id, s AS score, rank, true AS reranked FROM c WHERE rank <= least(k, {SMALL // 2})
    UNION ALL SELECT meeting, doc_id, score, r, false FROM s WHERE n < {SMALL}""")
def topk_rerank_step(t: Tables) -> DataFrame:
    """A broad request to each source for 12: small pools stay as they are; the scorer is asked for a third of the pool, at
    least 16 and one for each file, of which each has its best first; then the request's number stays."""
    best = ranking.top_per(pool(t), ["meeting"], order(), REQUEST).join(t.documents.select("doc_id", "text"), "doc_id")
    sized = best.join(best.groupBy("meeting").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")), "meeting")
    few = sized.where(F.col("n") < SMALL).select("meeting", "doc_id", "score", "rank", F.lit(False).alias("reranked"))
    wanted = F.greatest(F.lit(16), F.floor(F.col("n") / 3), F.col("files"))
    many = strategies.reranked(sized.where(F.col("n") >= SMALL).drop("rank", "score"), QUESTION, "doc_id", "text", wanted, 0.05, by=["meeting"], file="file", per_file=1)
    return many.where(F.col("rank") <= SMALL // 2).select("meeting", "doc_id", "score", "rank", F.lit(True).alias("reranked")).unionByName(few)


@query(f"""SELECT doc_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, max(score) OVER () AS best
        FROM (SELECT doc_id, {share('from with')} AS score FROM documents WHERE doc_id IN (SELECT doc_id FROM {POOL} ORDER BY score DESC, doc_id LIMIT 30)))
    WHERE rank <= 15 AND (score >= 0.1 OR (best < 0.1 AND rank <= 8))""")
def ext_reranker(t: Tables) -> DataFrame:
    """A registered scorer over a small pool."""
    docs = head(t, 30).join(t.documents.select("doc_id", "text"), "doc_id")
    return strategies.reranked(docs, "from with", "doc_id", "text", 8, 0.1, model="overlap").select("doc_id", "score", "rank")


# The review queue: orders are assertions; urgent and low ones were made by a machine, and most name others that they contradict.
STATUS = "CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority = '3-MEDIUM' THEN 'disputed' ELSE 'confirmed' END"
MADE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'auto_extracted' WHEN '5-LOW' THEN 'consolidated' ELSE 'manual' END"
OPEN = "(status IN ('pending', 'disputed') OR (status = 'confirmed' AND made IN ('auto_extracted', 'consolidated')))"


@query(f"""WITH m AS (SELECT o_custkey % 3 AS owner, o_orderkey AS key, {STATUS} AS status, {MADE} AS made,
        CASE WHEN o_orderkey % 4 <> 0 THEN [o_orderkey + 1, o_orderkey * 2] END AS others FROM orders),
    q AS (SELECT * FROM m WHERE {OPEN}),
    f AS (SELECT n.owner, n.key, m.key AS other, m.status AS other_status FROM (SELECT owner, key, unnest(others) AS other FROM q) n JOIN m ON m.owner = n.owner AND m.key = n.other)
    SELECT q.owner, q.key, q.status, other, other_status FROM q LEFT JOIN f ON f.owner = q.owner AND f.key = q.key""")
def join_review_conflicts(t: Tables) -> DataFrame:
    """What waits for review, pending, disputed or confirmed by a machine alone, with each assertion of the same owner that it
    names in its JSON list of conflicts, whatever that one's status; a row without other where there is none."""
    named = F.when(F.col("o_orderkey") % 4 != 0, F.to_json(F.array(F.col("o_orderkey") + 1, F.col("o_orderkey") * 2)))
    facts = t.orders.select((F.col("o_custkey") % 3).alias("owner"), F.col("o_orderkey").alias("key"), F.expr(STATUS).alias("status"), F.expr(MADE).alias("made"), named.alias("conflicts_with"))
    waiting = facts.where(OPEN).select("owner", "key", "status", F.explode_outer(F.from_json("conflicts_with", "array<bigint>")).alias("other"))
    known = facts.select("owner", F.col("key").alias("other"), F.col("status").alias("other_status"))
    found = waiting.join(known, ["owner", "other"], "left").withColumn("other", F.when(F.col("other_status").isNotNull(), F.col("other")))
    # Both names may be unknown, or one known: one row without other, or the known one's.
    return found.groupBy("owner", "key", "status").agg(F.collect_set(F.when(F.col("other").isNotNull(), F.struct("other", "other_status"))).alias("x")).select(
        "owner", "key", "status", F.explode_outer("x").alias("x")
    ).select("owner", "key", "status", "x.other", "x.other_status")


FINGERPRINT = 0


@query(f"""SELECT *, CASE WHEN without_vector + without_lexical + failed + repair_pending + mismatched = 0 THEN 'ok' ELSE 'degraded' END AS status FROM (
    SELECT count(*) AS files, count(*) FILTER (vec_id IS NULL) AS without_vector, count(*) FILTER (l.doc_id IS NULL) AS without_lexical,
        count(*) FILTER (quality = 0) AS failed, count(*) FILTER (toxic = 1) AS repair_pending, count(*) FILTER (coalesce(label, -1) <> {FINGERPRINT}) AS mismatched
    FROM documents d LEFT JOIN embeddings ON vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars > 0)""")
def agg_index_consistency(t: Tables) -> DataFrame:
    """Ready files against the state of their indexes: a vector stands for the vector index and its label for the fingerprint
    of the configuration, a row of labels for the lexical index, with failure and pending repair."""
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label", F.lit(True).alias("v"))
    states = t.labels.select("doc_id", "quality", "toxic", F.lit(True).alias("l"))
    ready = t.documents.where("n_chars > 0").select("doc_id").join(vectors, "doc_id", "left").join(states, "doc_id", "left")
    faults = {
        "without_vector": F.col("v").isNull(), "without_lexical": F.col("l").isNull(), "failed": F.col("quality") == 0, "repair_pending": F.col("toxic") == 1,
        "mismatched": F.coalesce("label", F.lit(-1)) != FINGERPRINT,
    }
    counts = ready.agg(F.count("*").alias("files"), *(F.count_if(c).alias(n) for n, c in faults.items()))
    return counts.withColumn("status", F.when(sum(F.col(n) for n in faults) == 0, "ok").otherwise("degraded"))


# Context from entities: suppliers near a vector, in a scope of nations; a negative balance marks one older than scopes.
ENTITIES, RELATIONS = 15, 5
SCOPE = "(scope IS NULL OR scope BETWEEN 1 AND 12) AND NOT legacy"
HOME = "CASE WHEN s_nationkey % 6 <> 0 THEN s_nationkey END"


@query(f"""WITH e AS (SELECT s_suppkey AS id, s_name, n_name, {HOME} AS scope, s_acctbal < 0 AS legacy, embedding
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN embeddings ON vec_id = s_suppkey),
    near AS (SELECT *, row_number() OVER (ORDER BY d, id) AS r FROM (SELECT e.*, {DISTANCE} AS d FROM e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)) QUALIFY r <= {ENTITIES}),
    kept AS (SELECT * FROM near WHERE {SCOPE}),
    rel AS (SELECT s, string_agg('supplies ' || p, ', ' ORDER BY p) AS line
        FROM (SELECT s, p FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_linestatus = 'O') QUALIFY row_number() OVER (PARTITION BY s ORDER BY p) <= {RELATIONS}) GROUP BY s)
    SELECT r AS rank, concat('- Supplier: **', s_name, '** (', n_name, ')', CASE WHEN line IS NOT NULL THEN concat(' [relations: ', line, ']') ELSE '' END) AS line
    FROM kept LEFT JOIN rel ON s = id""")
def kg_entity_context(t: Tables) -> DataFrame:
    """One line for each of the k nearest entities that is in scope, with its first relations that still hold. Entities without a
    scope are everyone's, but for those older than scopes. The entities found are a bounded list, so relations meet them at the scan."""
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    entities = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.embeddings, F.col("vec_id") == F.col("s_suppkey"))
    scored = entities.crossJoin(F.broadcast(q)).select("s_suppkey", "s_name", "n_name", F.expr(HOME).alias("scope"), (F.col("s_acctbal") < 0).alias("legacy"), N.l2(F.col("embedding"), F.col("q")).alias("d"))
    kept = ranking.top(scored, [F.asc("d"), F.asc("s_suppkey")], ENTITIES).where(SCOPE)
    valid = t.lineitem.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey")
    known = valid.join(F.broadcast(kept.select("s_suppkey")), "s_suppkey").distinct()
    first = ranking.top_per(known, ["s_suppkey"], [F.asc("l_partkey")], RELATIONS).groupBy("s_suppkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("ps"))
    parts = F.array_join(F.transform("ps", lambda p: F.concat(F.lit("supplies "), p.cast("string"))), ", ")
    relations = F.when(F.col("ps").isNotNull(), F.concat(F.lit(" [relations: "), parts, F.lit("]"))).otherwise("")
    line = F.concat(F.lit("- Supplier: **"), "s_name", F.lit("** ("), "n_name", F.lit(")"), relations)
    return kept.join(first, "s_suppkey", "left").select("rank", line.alias("line"))


# Facts with evidence: each document is remembered by its first words, quotes some of its words and cites itself and the next.
EXCERPT = "array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 3, 8), ' ')"
VALUE = "array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 1, 12), ' ')"


@query(f"""WITH m AS (SELECT doc_id AS key, source, n_chars, {EXCERPT} AS excerpt, regexp_matches(lower({EXCERPT}), '{T.DIRECTIVE}') OR regexp_matches(lower({VALUE}), '{T.DIRECTIVE}') AS directive FROM documents),
    r AS (SELECT key, directive, trim(regexp_replace(excerpt, '\\s+', ' ', 'g')) AS excerpt, key + 1 AS doc_id, source AS meeting, NULL AS revision, NULL AS stop FROM m WHERE key % 5 > 1
        UNION ALL SELECT key, directive, trim(regexp_replace(excerpt, '\\s+', ' ', 'g')), key, CASE WHEN key % 3 <> 0 THEN source END, CASE WHEN key % 7 <> 0 THEN n_chars::VARCHAR ELSE 'old' END, CASE WHEN key % 4 = 0 THEN 400 END FROM m WHERE key % 5 > 1),
    x AS (SELECT key, excerpt, regexp_replace(CASE WHEN stop IS NULL THEN text ELSE substr(text, 1, stop) END, '\\s+', ' ', 'g') AS body
        FROM r JOIN documents d USING (doc_id) LEFT JOIN labels USING (doc_id)
        WHERE coalesce(toxic, 0) = 0 AND NOT directive AND excerpt <> '' AND (meeting IS NULL OR meeting = d.source) AND (revision IS NULL OR revision = n_chars::VARCHAR) AND (stop IS NULL OR stop <= length(text)))
    SELECT key FROM m WHERE key % 5 = 0 OR (key % 5 = 1 AND key % 2 = 1 AND NOT directive)
    UNION SELECT key FROM x WHERE length(body) - length(replace(body, excerpt, '')) = length(excerpt)""")
def filter_admissible_memory(t: Tables) -> DataFrame:
    """Every fifth fact was written by hand and every fifth comes from talk; files of toxic label are no project state."""
    key = F.col("doc_id")
    words = F.split(F.trim("text"), r"\s+")
    ref = lambda file, meeting, revision, stop: F.struct(file.alias("file_id"), meeting.alias("meeting_id"), revision.alias("source_revision"), stop.alias("window_end"))
    next_one = ref(key + 1, F.col("source"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    own = ref(key, F.when(key % 3 != 0, F.col("source")), F.when(key % 7 != 0, F.col("n_chars").cast("string")).otherwise("old"), F.when(key % 4 == 0, 400))
    memories = t.documents.select(
        key.alias("key"),
        F.when(key % 5 == 0, "manual").when(key % 5 == 1, "consolidated").otherwise("auto_extracted").alias("made"),
        F.array_join(F.slice(words, 1, 12), " ").alias("value"),
        F.array_join(F.slice(words, 3, 6), " ").alias("excerpt"),
        F.when(key % 5 > 1, F.to_json(F.array(next_one, own))).alias("refs"),
        F.when(key % 2 == 0, F.to_json(F.array(key))).alias("file_ids"),
    )
    policy = F.when(F.coalesce("toxic", F.lit(0)) == 0, "project_state").otherwise("reference")
    files = t.documents.join(t.labels.select("doc_id", "toxic"), "doc_id", "left").select(
        key.alias("file_id"), F.col("source").alias("meeting_id"), policy.alias("policy"), F.array(F.col("n_chars").cast("string")).alias("revisions"), "text"
    )
    return evidence.admissible(memories, files)


# Pages: the lines of a document, some with a table or a picture.
BUDGET = 40


@query(f"""WITH p AS (SELECT doc_id, lang, source, i AS page, parts[i] AS line, string_split_regex(trim(parts[i]), '\\s+') AS w
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
    i AS (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN source END AS caption, CASE WHEN page % 2 = 0 AND length(substr(line, 1, 30)) >= 15 THEN substr(line, 1, 30) END AS ocr FROM p),
    c AS (SELECT doc_id, page, 1 AS kind, 0 AS n, 'text' AS content_type, line AS content FROM p WHERE length(trim(line)) > 0 AND len(w) <= {BUDGET}
        UNION ALL SELECT doc_id, page, 1, j, 'text', array_to_string(list_slice(w, j * {BUDGET} + 1, (j + 1) * {BUDGET}), ' ') FROM p, LATERAL (SELECT unnest(range(0, (len(w) - 1) // {BUDGET} + 1)) AS j) WHERE length(trim(line)) > 0 AND len(w) > {BUDGET}
        UNION ALL SELECT doc_id, page, 2, 0, 'table', concat('| ', lang, ' | ', source, ' |') FROM p WHERE page = 1
        UNION ALL SELECT doc_id, page, 3, 0, CASE WHEN caption IS NULL THEN 'image_ocr' WHEN ocr IS NULL THEN 'image_caption' ELSE 'image_combined' END,
            CASE WHEN caption IS NULL THEN ocr WHEN ocr IS NULL THEN caption ELSE concat('[Caption] ', caption, chr(10), '[OCR] ', ocr) END FROM i WHERE caption IS NOT NULL OR ocr IS NOT NULL)
    SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, kind, n) - 1 AS chunk_index, content_type, md5(content) AS content FROM c""")
def scan_page_chunks(t: Tables) -> DataFrame:
    """Text, tables and pictures of each page as rows of an index."""
    lines = t.documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("page", (F.col("i") + 1).cast("bigint"))
    table = F.when(F.col("page") == 1, F.array(F.concat(F.lit("| "), "lang", F.lit(" | "), "source", F.lit(" |"))))
    picture = F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("caption"), F.when(F.col("page") % 2 == 0, F.substring("text", 1, 30)).alias("ocr"))
    pages = lines.select("doc_id", "page", "text", table.alias("tables"), F.array(picture).alias("images"))
    return chunks.page_chunks(pages, "doc_id", BUDGET).select("doc_id", "page", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content_type", F.md5("content").alias("content"))
