"""Ranking, fusion, full text, vectors and evaluation over documents and embeddings.

A file is a document, its meeting is its source, and its vector is the embedding of the same id. A chunk is a row of
``embeddings`` here; its label is its file. Scores are rounded to six places in both engines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import fulltext, ranking
from ..sources import lexical_index
from ..sources.lexical_index import LexicalIndex
from ..sources.store import shared_folder
from .registry import Tables, query

QUERY_WORDS = ("the", "tion", "and")


def order():
    return ranking.best_first("score", "doc_id")



# A pool of scored chunks of known form: what rerankers and routers hand on.
def pool(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("source").alias("meeting"), (F.col("doc_id") % 37).alias("file"), F.round(((F.col("doc_id") * 7919) % 1000) / 1000.0, 6).alias("score"))


POOL = "(SELECT doc_id, source AS meeting, doc_id % 37 AS file, round(((doc_id * 7919) % 1000) / 1000.0, 6)::DOUBLE AS score FROM documents)"
HEAD = f"(SELECT * FROM {POOL} ORDER BY score DESC, doc_id LIMIT 200)"


def head(t: Tables, k: int = 200) -> DataFrame:
    return pool(t).orderBy(*order()).limit(k)


def query_vector(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))


def with_query(t: Tables) -> DataFrame:
    """Every vector with the query's, which is one row."""
    return t.embeddings.crossJoin(F.broadcast(query_vector(t)))


VEC = "FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
DIST = "sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(embedding, q)]))"
DOT = "list_sum([x[1]::DOUBLE * x[2]::DOUBLE for x in list_zip(embedding, q)])"
NORM = "sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in {}]))"
COS = f"{DOT} / ({NORM.format('embedding')} * {NORM.format('q')})"
KNN = f"(SELECT vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score, row_number() OVER (ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, {DIST} AS d {VEC}) WHERE d <= 1.5 QUALIFY rank <= 50)"


def knn(t: Tables, k: int = 50) -> DataFrame:
    return ranking.knn(with_query(t), N.l2(F.col("embedding"), F.col("q")), "vec_id", k, most=1.5).select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


query(f"SELECT * FROM {KNN}", "join_vector_knn")(knn)
query(f"SELECT vec_id, round({COS}, 6) AS cosine {VEC}", "math_cosine")(lambda t: with_query(t).select("vec_id", F.round(N.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine")))
query(f"SELECT vec_id, round(least(greatest({COS}, 0), 1), 4) AS score {VEC}", "math_summary_score")(lambda t: with_query(t).select("vec_id", F.round(N.clamped(N.cosine(F.col("embedding"), F.col("q"))), 4).alias("score")))
query(f"SELECT vec_id, round(1 / (1 + d), 6) AS score, 'relevance' AS score_kind FROM (SELECT vec_id, {DIST} AS d {VEC})", "project_score_normalize")(lambda t: with_query(t).select("vec_id", F.round(N.relevance(N.l2(F.col("embedding"), F.col("q")), True), 6).alias("score"), F.lit("relevance").alias("score_kind")))
query(f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {DIST} AS d {VEC}) WHERE d <= 1.3", "filter_score_threshold")(lambda t: with_query(t).withColumn("d", N.l2(F.col("embedding"), F.col("q"))).where("d <= 1.3").select("vec_id", F.round("d", 6).alias("distance")))
query("SELECT label, i AS place, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL", "agg_average_embedding")(lambda t: t.embeddings.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", (F.col("p") + 1).cast("bigint").alias("place")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean")))
query(f"SELECT vec_id, label, round({COS}, 6) AS score {VEC} WHERE label IN (1, 2, 3) AND vec_id <> 0 ORDER BY {COS} DESC, vec_id LIMIT 10", "join_entity_similarity")(lambda t: with_query(t).where("label IN (1, 2, 3) AND vec_id <> 0").withColumn("s", N.cosine(F.col("embedding"), F.col("q"))).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", "label", F.round("s", 6).alias("score")))

# Full text: every search reads an index that is stored once for its table.
BM25 = fulltext.sql(QUERY_WORDS)
SUMMARY = fulltext.sql(QUERY_WORDS, "(SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents)")
CHAT = fulltext.sql(("what", "the"), "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)")
BEST = "SELECT doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({})) WHERE rank <= {}"


def chunk_index(t: Tables) -> LexicalIndex:
    return lexical_index.of_table(t.spark, f"{t.sf_dir}/documents.parquet", "chunks", "doc_id", "text", ["source", "lang", "n_chars"])


def summary_index(t: Tables) -> LexicalIndex:
    return lexical_index.of_table(t.spark, f"{t.sf_dir}/documents.parquet", "summaries", "doc_id", F.element_at(F.split("text", "\n"), 1))


def chat_index(t: Tables) -> LexicalIndex:
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "role", "text")
    return lexical_index.of_table(t.spark, f"{t.sf_dir}/conversations.parquet", "turns", "doc_id", "text", ["role"], turns)


def best(index: LexicalIndex, terms, k: int, **filters) -> DataFrame:
    found = index.search(terms, k, **filters).withColumn("s", F.round("score", 9))
    return ranking.top(found, [F.desc("s"), F.asc("doc_id")], k).select("doc_id", F.round("score", 6).alias("score"), "rank")


def bm25(t: Tables, k: int = 50) -> DataFrame:
    return best(chunk_index(t), QUERY_WORDS, k)


@query(BEST.format(BM25, 50))
def fts_chunk_search(t: Tables) -> DataFrame:
    return bm25(t)


@query(f"""
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({BM25})
WHERE doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang = 'en') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) QUALIFY rank <= 30""")
def fts_chunk_search_scoped(t: Tables) -> DataFrame:
    """Within meetings, a speaker's language and a tenant's rows; statistics stay those of the whole index."""
    scope = F.col("source").isin("src1", "src2", "src3") & (F.col("lang") == "en")
    return best(chunk_index(t), QUERY_WORDS, 30, where=scope, allowed=t.labels.where("quality = 1").select("doc_id"))


@query("SELECT count(*) AS documents, round(avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))), 6) AS average FROM documents")
def fts_stats(t: Tables) -> DataFrame:
    return fulltext.stats(chunk_index(t).documents).select("documents", F.round("average", 6).alias("average"))


@query(BEST.format(SUMMARY, 20))
def fts_summary_search(t: Tables) -> DataFrame:
    return summary_search(t, " ".join(QUERY_WORDS), 20)


# The tables hold no CJK: their letters become characters, so words become runs without spaces between characters.
LETTERS, CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "一丁七万丈三上下不与丐丑专且世丘丙业丛东丝丞両並丫中"
CJK_TEXT = f"translate(lower({{}}), '{LETTERS}', '{CHARACTERS}')"
PHRASES = [w.translate(str.maketrans(LETTERS, CHARACTERS)) for w in ("tion", "the", "ingth", "sch")]
GRAMS = "list_sum(list_transform(regexp_extract_all({}, '[一-鿿]+'), lambda r: greatest(length(r) - 2, 0)))"


def in_characters(c: Column) -> Column:
    return F.translate(F.lower(c), LETTERS, CHARACTERS)


def cjk_index(t: Tables, name: str, text: Column) -> LexicalIndex:
    return lexical_index.of_table(t.spark, f"{t.sf_dir}/documents.parquet", name, "doc_id", text, tokens=T.cjk_grams, places=True)


def cjk_sql(text: str, terms: list[str]) -> str:
    """BM25 with each term counted where it stands, overlaps too (none of the terms overlaps itself)."""
    tf = ", ".join(f"(length(x) - length(replace(x, '{p}', ''))) // {len(p)} AS tf{i}" for i, p in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    parts = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / average)) ELSE 0 END" for i in range(len(terms)))
    return f"""
WITH c AS (SELECT doc_id, coalesce({GRAMS.format('x')}, 0) AS length, {tf} FROM (SELECT doc_id, {CJK_TEXT.format(text)} AS x FROM documents)),
s AS (SELECT count(*) AS n, avg(length) AS average, {df} FROM c)
SELECT doc_id, ({parts})::DOUBLE AS score FROM c, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(terms)))}"""


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({cjk_sql('text', PHRASES)})")
def fts_trigram_cjk(t: Tables) -> DataFrame:
    """Documents with any of some CJK phrases of three characters and more, found by the places of their 3-grams."""
    return cjk_index(t, "characters", in_characters(F.col("text"))).phrase_search(PHRASES).select("doc_id", F.round("score", 6).alias("score"))


def summary_search(t: Tables, asked: str, k: int) -> DataFrame:
    """A query with CJK goes to the index of 3-grams, any other to that of words; one term is enough in both."""
    first = F.element_at(F.split("text", "\n"), 1)
    terms = T.cjk_terms(asked)
    return best(cjk_index(t, "summary-characters", in_characters(first)), terms, k) if terms else best(summary_index(t), asked.split(), k)


@query(BEST.format(cjk_sql("string_split(text, chr(10))[1]", T.cjk_terms(f"{PHRASES[0]} or {PHRASES[2]}")), 20))
def fts_summary_search_cjk(t: Tables) -> DataFrame:
    return summary_search(t, f"{PHRASES[0]} or {PHRASES[2]}", 20)


@query(BEST.format(CHAT, 20))
def fts_chat_search(t: Tables) -> DataFrame:
    return best(chat_index(t), ["what", "the"], 20)


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({BM25}) WHERE score >= 0.1")
def filter_bm25_floor(t: Tables) -> DataFrame:
    return chunk_index(t).search(QUERY_WORDS).where("score >= 0.1").select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT source, max(round(score, 6)) AS score FROM ({BM25}) JOIN documents USING (doc_id) WHERE score >= 0.1 GROUP BY source ORDER BY score DESC, source LIMIT 8")
def fts_retrieve(t: Tables) -> DataFrame:
    index = chunk_index(t)
    found = index.search(QUERY_WORDS).where("score >= 0.1").join(index.documents.select("doc_id", "source"), "doc_id")
    return found.groupBy("source").agg(F.max(F.round("score", 6)).alias("score")).orderBy(F.desc("score"), "source").limit(8)


@query("""
WITH i AS (SELECT doc_id, text FROM documents WHERE lang IS NULL OR lang <> 'de'),
n AS (SELECT doc_id, CASE WHEN quality = 0 THEN concat(text, ' changed') ELSE text END AS text FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NULL OR lang <> 'fr')
SELECT count(*) FILTER (i.doc_id IS NULL) AS missing, count(*) FILTER (n.doc_id IS NULL) AS unknown, count(*) FILTER (i.text <> n.text) AS changed, count(i.doc_id) AS indexed,
  0::BIGINT AS wrong_length, 0::BIGINT AS wrong_df FROM i FULL JOIN n USING (doc_id)""")
def fts_integrity(t: Tables) -> DataFrame:
    """An index of one state of the documents held against another, which has lost a language, gained one and changed texts."""
    index = lexical_index.of_table(t.spark, f"{t.sf_dir}/documents.parquet", "not-de", "doc_id", "text", [], t.documents.where("lang IS NULL OR lang <> 'de'"))
    now = t.documents.where("lang IS NULL OR lang <> 'fr'").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    now = now.withColumn("text", F.when(F.col("quality") == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    whole = index.integrity().select("wrong_length", "wrong_df")
    return index.drift(now).crossJoin(F.broadcast(whole))


@query("""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM p GROUP BY term HAVING count(DISTINCT doc_id) > 3""")
def source_fts_rebuild(t: Tables) -> DataFrame:
    """An index of part of the documents has drifted too far from all of them, so it is built anew; its terms."""
    root = f"{shared_folder(t.spark)}/rebuilt-{uuid.uuid4().hex}"
    lexical_index.build(t.documents.where("lang = 'en'"), root, "doc_id")
    index, anew = lexical_index.rebuilt(t.documents, root, "doc_id")
    return index.terms.where((F.col("df") > 3) & F.lit(anew)).select("term", F.col("cf").alias("tf"), "df")


# Fusion: the flagship joins the vector's and the words' ranks.
LEX = f"(SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({BM25}) QUALIFY rank <= 50)"
FUSED = f"""(SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(s / max(s) OVER (), 9) AS score FROM
 (SELECT doc_id, sum(s) AS s FROM (SELECT vec_id AS doc_id, 0.5 * 61 / (60 + rank) AS s FROM {KNN} UNION ALL SELECT doc_id, 0.5 * 61 / (60 + rank) FROM {LEX}) GROUP BY doc_id ORDER BY s DESC, doc_id LIMIT 40)))"""


def fused(t: Tables, limit: int = 40) -> DataFrame:
    both = ranking.rrf([(knn(t).select(F.col("vec_id").alias("doc_id"), "rank"), 0.5), (bm25(t).select("doc_id", "rank"), 0.5)], "doc_id", 60, limit)
    return ranking.ranked(both.withColumn("score", F.round("score", 9)), order()).select("doc_id", "score", "rank")


query(f"SELECT doc_id, round(score, 6) AS score, rank FROM {FUSED}", "topk_rrf_merge")(lambda t: fused(t).select("doc_id", F.round("score", 6).alias("score"), "rank"))
HYBRID = f"SELECT doc_id, source, score, rank FROM (SELECT doc_id, source, round(score, 6) AS score, row_number() OVER (ORDER BY late, score DESC, doc_id) AS rank FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) > 2)::INT AS late FROM {FUSED} JOIN documents USING (doc_id))) WHERE rank <= 10"


@query(HYBRID)
def hybrid_top10(t: Tables) -> DataFrame:
    """The flagship: vector and lexical candidates, fused, at most two of a source first, ten in all."""
    pool_ = fused(t).drop("rank").join(t.documents.select("doc_id", "source"), "doc_id")
    return ranking.diversified(pool_, ["source"], 2, order()).where("rank <= 10").select("doc_id", "source", F.round("score", 6).alias("score"), "rank")


RANKS = "(SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {p} WHERE {w} QUALIFY rank <= 100)"
R = [RANKS.format(p=POOL, w=w) for w in ("doc_id % 2 = 0", "doc_id % 3 = 0", "doc_id % 5 < 2")]


def lists(t: Tables) -> list[DataFrame]:
    return [ranking.top(pool(t).where(w), order(), 100).select("doc_id", "rank") for w in ("doc_id % 2 = 0", "doc_id % 3 = 0", "doc_id % 5 < 2")]


def multi(weights: tuple[float, ...], k: int, n: int) -> tuple[str, object]:
    sql = "SELECT doc_id, round(s / max(s) OVER (), 6) AS score, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM (SELECT doc_id, round(sum(s), 12) AS s FROM (" + " UNION ALL ".join(f"SELECT doc_id, {w} * {k + 1} / ({k} + rank) AS s FROM {r}" for w, r in zip(weights, R)) + f") GROUP BY doc_id ORDER BY s DESC, doc_id LIMIT {n})"
    return sql, lambda t: ranking.ranked(ranking.rrf(list(zip(lists(t), weights)), "doc_id", k, n).withColumn("score", F.round("score", 12)), order()).select("doc_id", F.round("score", 6).alias("score"), "rank")


for name, args in {"topk_rrf_multi": ((1.0, 1.0, 1.0), 60, 30), "topk_rrf_file_lists": ((0.6, 0.4), 60, 20), "topk_multi_query_scope": ((1.0, 0.8, 0.6), 60, 16), "win_rank_to_rrf": ((1.0,), 60, 100), "topk_rrf_adaptive_k": ((0.5, 0.5), ranking.adaptive_k(30), 30)}.items():
    query(multi(*args)[0], name)(multi(*args)[1])
query(f"SELECT doc_id, round(s, 9) AS score, row_number() OVER (ORDER BY round(s, 12) DESC, coalesce(own, 999), doc_id) AS rank FROM (SELECT doc_id, sum(1.0 / (60 + rank)) AS s, min(own) AS own FROM (SELECT doc_id, rank, rank AS own FROM {R[0]} UNION ALL SELECT doc_id, rank, NULL FROM {R[1]}) GROUP BY doc_id) QUALIFY rank <= 8", "topk_router_funnel_rrf")(
    lambda t: ranking.top(ranking.rank_union(lists(t)[:2], "doc_id").withColumn("s", F.round("score", 12)), [F.desc("s"), F.coalesce("own", F.lit(999)).asc(), F.asc("doc_id")], 8).select("doc_id", F.round("score", 9).alias("score"), "rank")
)
query(f"""SELECT doc_id, row_number() OVER (ORDER BY least(side, 1), CASE WHEN side = 0 THEN n ELSE 2 * n + side END, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY coalesce(l, r), doc_id) AS n FROM
 (SELECT doc_id, l, r, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 0 WHEN r IS NULL THEN 1 ELSE 2 END AS side FROM (SELECT doc_id, min(l) AS l, min(r) AS r FROM (SELECT doc_id, rank AS l, NULL AS r FROM {R[0]} UNION ALL SELECT doc_id, NULL, rank FROM {R[1]}) GROUP BY doc_id)))""", "topk_router_funnel_zigzag")(lambda t: ranking.zigzag(*lists(t)[:2], "doc_id"))

# Selection from a pool.
query(f"SELECT doc_id, meeting, score, row_number() OVER (ORDER BY late, score DESC, doc_id) AS rank FROM (SELECT *, (row_number() OVER (PARTITION BY meeting, file ORDER BY score DESC, doc_id) > 1)::INT AS late FROM {HEAD})", "win_diversity_cap")(lambda t: ranking.diversified(head(t), ["meeting", "file"], 1, order()).select("doc_id", "meeting", "score", "rank"))
SURE = "SELECT doc_id, file, score, rank FROM (SELECT *, sum((late = 0)::INT) OVER () AS sure FROM (SELECT *, row_number() OVER (ORDER BY late, score DESC, doc_id) AS rank FROM (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY score DESC, doc_id) > {n})::INT AS late FROM {p}))) WHERE rank <= {k}"
query(SURE.format(n=3, p=HEAD, k="greatest(sure, 16)"), "win_per_file_guarantee")(lambda t: ranking.guaranteed(head(t), ["file"], 3, 16, order()).select("doc_id", "file", "score", "rank"))
query(SURE.format(n=1, p=f"(SELECT * FROM {HEAD} QUALIFY score >= 0.35 * max(score) OVER ())", k="least(greatest(sure, 12), 12)"), "win_coverage_select")(lambda t: ranking.coverage(head(t), "file", "score", "doc_id", 12).select("doc_id", "file", "score", "rank"))
query(f"SELECT doc_id, file, score, row_number() OVER (PARTITION BY file ORDER BY score DESC, doc_id) AS rank FROM {POOL} QUALIFY rank <= greatest(2 * 3, 3 + 2)", "win_fair_topn_per_file")(lambda t: ranking.top_per(pool(t), ["file"], order(), 6).select("doc_id", "file", "score", "rank"))
query(f"SELECT doc_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS a FROM {HEAD}) WHERE n <= greatest(round(a * 0.75), 1) OR file = 5", "win_percentile_keep")(lambda t: ranking.evidence(head(t), "percentile", 0.25, order(), protected=F.col("file") == 5).select("doc_id", "score"))
query(f"SELECT meeting, round(avg(score), 6) AS score FROM (SELECT * FROM {POOL} QUALIFY row_number() OVER (PARTITION BY meeting ORDER BY score DESC) <= 3) GROUP BY meeting ORDER BY avg(score) DESC, meeting LIMIT 8", "agg_by_meeting")(lambda t: ranking.group_scores(pool(t), "meeting", "score").orderBy(F.desc("score"), "meeting").limit(8).select("meeting", F.round("score", 6).alias("score")))
BY_FILE = f"(SELECT file, quality, n, 0.85 * quality + 0.15 * ln(1 + n) / ln(9) AS score FROM (SELECT file, avg(score) FILTER (r <= 3) AS quality, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC) AS r FROM {POOL}) GROUP BY file))"
by_file = lambda t: ranking.group_scores(pool(t), "file", "score", blend=0.85)
query(f"SELECT file, round(quality, 6) AS quality, n, round(score, 6) AS score FROM {BY_FILE} ORDER BY score DESC, file LIMIT 20", "agg_by_file_scored")(lambda t: by_file(t).orderBy(F.desc("score"), "file").limit(20).select("file", F.round("quality", 6).alias("quality"), "n", F.round("score", 6).alias("score")))
query(f"SELECT file FROM {BY_FILE} ORDER BY round(score, 9) DESC, file LIMIT 8", "agg_by_file")(lambda t: by_file(t).orderBy(F.round("score", 9).desc(), "file").limit(8).select("file"))
query(f"SELECT meeting, max(score) AS best, count(*) FILTER (score >= 0.1)::DOUBLE AS many FROM {POOL} GROUP BY meeting", "agg_topk_mean")(lambda t: ranking.group_scores(pool(t), "meeting", "score", "max").select("meeting", F.col("score").alias("best")).join(ranking.group_scores(pool(t), "meeting", "score", "count").select("meeting", F.col("score").alias("many")), "meeting"))
query(f"SELECT file, round(ln(1 + count(*)) / ln(9), 6) AS weight FROM {POOL} GROUP BY file", "agg_log_count")(lambda t: pool(t).groupBy("file").agg(F.round(N.log_count(F.count("*")), 6).alias("weight")))
query(f"SELECT doc_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS unit FROM {HEAD}", "agg_minmax_unit")(lambda t: ranking.unit_scaled(head(t), "score", equal=float("nan")).select("doc_id", F.round("unit", 6).alias("unit")))


@query(f"""WITH f AS (SELECT file, score FROM {BY_FILE} WHERE file % 3 = 0), r AS (SELECT file, quality AS score FROM {BY_FILE} WHERE file % 4 = 0)
 SELECT s.file, round(coalesce(f.score, r.score, 0.8 * (SELECT coalesce(median(score), 0.5) FROM (SELECT score FROM f UNION ALL SELECT score FROM r))), 6) AS score FROM (SELECT DISTINCT file FROM {POOL}) s LEFT JOIN f USING (file) LEFT JOIN r USING (file)""")
def agg_median_fallback(t: Tables) -> DataFrame:
    """A file's funnel score, else its router score, else a share of the median of all."""
    scored = by_file(t)
    funnel, router = scored.where("file % 3 = 0").select("file", F.col("score").alias("f")), scored.where("file % 4 = 0").select("file", F.col("quality").alias("r"))
    middle = funnel.select("f").union(router.select("r")).agg(F.coalesce(F.median("f"), F.lit(0.5)).alias("m"))
    return pool(t).select("file").distinct().join(funnel, "file", "left").join(router, "file", "left").crossJoin(F.broadcast(middle)).select("file", F.round(F.coalesce("f", "r", 0.8 * F.col("m")), 6).alias("score"))


SCOPE = f"(SELECT file, row_number() OVER (ORDER BY round(score, 9) DESC, file) AS rank FROM {BY_FILE} QUALIFY rank <= 8)"
query(f"SELECT file, row_number() OVER (ORDER BY late, place, file) AS rank FROM (SELECT file, CASE WHEN file IN (1, 2, 3, 4, 5, 6) THEN 0 ELSE 1 END AS late, rank AS place FROM {SCOPE} UNION ALL SELECT * FROM (SELECT file, 0, row_number() OVER (ORDER BY file) AS n FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS file) WHERE file NOT IN (SELECT file FROM {SCOPE}) QUALIFY n <= 4)) QUALIFY rank <= 8", "topk_anchor_evict")(
    lambda t: ranking.evicted(ranking.top(by_file(t).withColumn("s", F.round("score", 9)), [F.desc("s"), F.asc("file")], 8).select("file", "rank"), t.spark.createDataFrame([(x,) for x in range(1, 7)], "file long"), "file", 8, 4)
)
PRIOR = f"(SELECT b.file, round(0.8 * b.score + 0.2 * (b.file % 10) / 10.0, 9) AS score, b.file % 2 = 0 AS routed FROM {BY_FILE} b)"
query(f"SELECT file, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY routed ORDER BY score DESC, file) AS n FROM {PRIOR}) WHERE n <= CASE WHEN routed THEN 6 ELSE 2 END", "topk_meeting_priors")(
    lambda t: ranking.ranked(by_file(t).select("file", F.round(0.8 * F.col("score") + 0.2 * (F.col("file") % 10) / 10.0, 9).alias("score"), (F.col("file") % 2 == 0).alias("routed")), ranking.best_first("score", "file"), ["routed"]).where(F.col("rank") <= F.when(F.col("routed"), 6).otherwise(2)).select("file", F.round("score", 6).alias("score"))
)
ROUTED = f"(SELECT source, max(score) AS score FROM (SELECT vec_id, least(greatest({COS}, 0), 1) AS score {VEC} WHERE vec_id <> 0) JOIN documents ON doc_id = vec_id GROUP BY source)"


def routed(t: Tables) -> DataFrame:
    near = with_query(t).where("vec_id <> 0").select(F.col("vec_id").alias("doc_id"), N.clamped(N.cosine(F.col("embedding"), F.col("q"))).alias("s"))
    return near.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("s").alias("score"))


query(f"SELECT source, round(score, 6) AS score FROM {ROUTED} WHERE score >= 0.2 ORDER BY score DESC, source LIMIT 5", "topk_meeting_router")(lambda t: routed(t).where("score >= 0.2").orderBy(F.desc("score"), "source").limit(5).select("source", F.round("score", 6).alias("score")))
query(f"SELECT vec_id, round({COS}, 6) AS score {VEC} WHERE vec_id <> 0 AND {COS} >= 0.2 ORDER BY {COS} DESC, vec_id LIMIT 8", "topk_summary_router")(lambda t: with_query(t).where("vec_id <> 0").withColumn("s", N.cosine(F.col("embedding"), F.col("q"))).where("s >= 0.2").orderBy(F.desc("s"), "vec_id").limit(8).select("vec_id", F.round("s", 6).alias("score")))
query(f"SELECT DISTINCT source FROM documents WHERE doc_id IN (SELECT vec_id FROM (SELECT vec_id, {COS} AS s {VEC} WHERE vec_id <> 0) ORDER BY s DESC, vec_id LIMIT 8)", "topk_prefilter_meetings")(
    lambda t: t.documents.join(with_query(t).where("vec_id <> 0").withColumn("s", N.cosine(F.col("embedding"), F.col("q"))).orderBy(F.desc("s"), "vec_id").limit(8).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("source").distinct()
)
query(f"SELECT file, max(doc_id) AS newest, 0.1::DOUBLE AS score FROM (SELECT * FROM {POOL} ORDER BY doc_id DESC LIMIT 50) GROUP BY file", "topk_latest_chunks")(lambda t: pool(t).orderBy(F.desc("doc_id")).limit(50).groupBy("file").agg(F.max("doc_id").alias("newest"), F.lit(0.1).alias("score")))
query(f"SELECT meeting, doc_id, score FROM {POOL} WHERE meeting IN ('src1', 'src2') AND file IN (1, 2, 3)", "filter_restrict_pool")(lambda t: pool(t).where(F.col("meeting").isin("src1", "src2") & F.col("file").isin(1, 2, 3)).select("meeting", "doc_id", "score"))
query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') AND lang IN ('en', 'fr') AND n_chars BETWEEN 500 AND 5000", "filter_metadata_where")(lambda t: t.documents.where(F.col("source").isin("src1", "src2") & F.col("lang").isin("en", "fr") & F.col("n_chars").between(500, 5000)).select("doc_id", "source"))
query(f"SELECT string_agg(file, ',' ORDER BY first) AS files FROM (SELECT file, min(r) AS first FROM (SELECT file, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM {HEAD}) WHERE r <= 20 GROUP BY file)", "project_anchor_ids")(lambda t: ranking.top(head(t), order(), 20).groupBy("file").agg(F.min("rank").alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "file"))), lambda x: x["file"].cast("string")), ",").alias("files")))
query("SELECT text_key, max(score) AS score FROM (SELECT substr(sha256(text), 1, 16) AS text_key, (doc_id * 3 % 101)::DOUBLE AS score FROM documents) GROUP BY text_key", "set_dedup_best_score")(
    lambda t: t.documents.select(F.substring(F.sha2("text", 256), 1, 16).alias("text_key"), (F.col("doc_id") * 3 % 101).cast("double").alias("score")).groupBy("text_key").agg(F.max("score").alias("score"))
)
query("SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY source, lang", "set_merge_multimodal")(lambda t: ranking.latest(t.documents.select("source", "lang", "doc_id"), ["source", "lang"], [F.asc("doc_id")]).select("source", "lang", F.col("doc_id").alias("first")))
query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = d.doc_id AND o.doc_id % 2 = 0 AND sha256(o.text) = sha256(d.text))", "set_skip_unchanged")(lambda t: t.documents.select("doc_id", F.sha2("text", 256).alias("h")).join(t.documents.where("doc_id % 2 = 0").select("doc_id", F.sha2("text", 256).alias("h")), ["doc_id", "h"], "left_anti").select("doc_id"))
query("SELECT source, sha256(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2", "set_file_create_if_absent")(lambda t: t.documents.groupBy("source", F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")))
# Evaluation: ten nearest of each query vector, wanted are those of its label among them by another measure.
RUNS = "(SELECT o_custkey AS q, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS found, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS wanted FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') > 0)"


def runs(t: Tables) -> DataFrame:
    pairs = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))), lambda x: x["o_orderkey"])
    return t.orders.groupBy(F.col("o_custkey").alias("q")).agg(pairs.alias("found"), F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))).alias("wanted")).where(F.size("wanted") > 0)


HITS = "len(list_filter(list_slice(found, 1, 5), lambda x: list_contains(wanted, x)))"
metric = lambda f: lambda t: runs(t).select("q", F.round(f(F.col("found"), F.col("wanted")), 6).alias("value"))
query(f"SELECT q, round({HITS} / len(wanted), 6) AS value FROM {RUNS}", "math_recall_at_k")(metric(lambda f, w: N.recall_at(f, w, 5)))
query(f"SELECT q, round({HITS} / least(5, len(found)), 6) AS value, round({HITS} / len(wanted), 6) AS recall FROM {RUNS}", "math_file_precision_recall")(
    lambda t: runs(t).select("q", F.round(N.precision_at(F.col("found"), F.col("wanted"), 5), 6).alias("value"), F.round(N.recall_at(F.col("found"), F.col("wanted"), 5), 6).alias("recall"))
)
query(f"SELECT q, round(1.0 / list_min([i for i in range(1, len(found) + 1) if list_contains(wanted, found[i])]), 6)::DOUBLE AS value FROM {RUNS}", "math_mrr")(metric(N.reciprocal_rank))
NDCG = "list_sum([CASE WHEN list_contains(wanted, found[i]) THEN 1 / log2(i + 1) ELSE 0 END for i in range(1, least(5, len(found)) + 1)]) / list_sum([1 / log2(i + 1) for i in range(1, least(5, len(wanted)) + 1)])"
query(f"SELECT q, round({NDCG}, 6) AS value FROM {RUNS}", "math_ndcg")(metric(lambda f, w: N.ndcg_at(f, w, 5)))
query(f"SELECT round(0.4 * r + 0.3 * r + 0.2 * h + 0.1 * n, 6) AS score FROM (SELECT avg({HITS} / len(wanted)) AS r, avg(({HITS} > 0)::INT) AS h, avg({NDCG}) AS n FROM {RUNS})", "agg_weighted_score")(
    lambda t: runs(t).select(N.recall_at(F.col("found"), F.col("wanted"), 5).alias("r"), N.ndcg_at(F.col("found"), F.col("wanted"), 5).alias("n")).agg(F.avg("r").alias("r"), F.avg((F.col("r") > 0).cast("int")).alias("h"), F.avg("n").alias("n")).select(F.round(0.4 * F.col("r") + 0.3 * F.col("r") + 0.2 * F.col("h") + 0.1 * F.col("n"), 6).alias("score"))
)
query(f"SELECT count(*) AS queries, round(avg({HITS} / len(wanted)), 6) AS recall, round(avg(CASE WHEN q % 2 = 0 THEN {NDCG} END), 6) AS ndcg FROM {RUNS}", "agg_mean_metrics")(
    lambda t: runs(t).agg(F.count("*").alias("queries"), F.round(F.avg(N.recall_at(F.col("found"), F.col("wanted"), 5)), 6).alias("recall"), F.round(F.avg(F.when(F.col("q") % 2 == 0, N.ndcg_at(F.col("found"), F.col("wanted"), 5))), 6).alias("ndcg"))
)


@query("""SELECT method, config, score FROM (
    SELECT o_orderpriority AS method, o_orderstatus AS config, max(o_totalprice) AS score,
        row_number() OVER (PARTITION BY o_orderpriority ORDER BY max(o_totalprice) DESC, o_orderstatus) AS own
    FROM orders GROUP BY 1, 2) ORDER BY own > 1, score DESC, method, config LIMIT 2""")
def topk_select_phase1(t: Tables) -> DataFrame:
    """The two best configurations of different methods: priorities stand for methods, states for configurations."""
    scored = t.orders.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("config")).agg(F.max("o_totalprice").alias("score"))
    return ranking.best_of_each(scored, "method", "score", "config")
