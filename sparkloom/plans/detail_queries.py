"""Retrieval details over the driver's tables: metrics with missing identities, siblings of a page, continuations, strategies, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quantiles, ranking
from ..sources import export
from ..sources.store import shared_folder
from . import strategies
from .registry import Tables, query
from .retrieval_queries import FUSED, KNN, LEX, bm25, fused, knn

# A query is a source: its longest documents are found, those of good quality and some length were wanted. What identifies a
# document is its text, which a toxic one withholds.
FOUND = "(SELECT source AS q, CASE WHEN coalesce(toxic, 0) = 0 THEN md5(text) END AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents LEFT JOIN labels USING (doc_id) QUALIFY rank <= 6)"
WANTED = "(SELECT DISTINCT source AS q, md5(text) AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND n_chars >= 5000)"


@query(f"""
WITH f AS {FOUND}, w AS {WANTED}, n AS (SELECT q, count(*) AS wanted FROM w GROUP BY q),
h AS (SELECT f.q, bool_or(f.id IS NULL) AS missing, count(DISTINCT CASE WHEN w.id IS NOT NULL THEN f.id END) AS hits, min(CASE WHEN w.id IS NOT NULL THEN rank END) AS first FROM f LEFT JOIN w ON w.q = f.q AND w.id = f.id GROUP BY f.q)
SELECT q, CASE WHEN NOT missing THEN round(hits / wanted, 6) END AS recall, CASE WHEN NOT missing AND wanted > 0 THEN (hits > 0)::INT END AS hit, CASE WHEN NOT missing AND wanted > 0 THEN round(coalesce(1.0 / first, 0), 6)::DOUBLE END AS mrr
FROM h LEFT JOIN n USING (q)""")
def math_retrieval_metrics(t: Tables) -> DataFrame:
    """Recall, hit and reciprocal rank of different identities; null where one is missing or nothing was wanted."""
    own = t.documents.join(t.labels, "doc_id", "left")
    identity = F.when(F.coalesce("toxic", F.lit(0)) == 0, F.md5("text"))
    found = ranking.top_per(own.select(F.col("source").alias("q"), identity.alias("id"), "n_chars", "doc_id"), ["q"], [F.desc("n_chars"), F.asc("doc_id")], 6)
    wanted = own.where("quality = 1 AND n_chars >= 5000").select(F.col("source").alias("q"), F.md5("text").alias("id"), F.lit(True).alias("right")).distinct()
    hits = found.join(wanted, ["q", "id"], "left").groupBy("q").agg(
        F.bool_or(F.col("id").isNull()).alias("missing"), F.countDistinct(F.when(F.col("right"), F.col("id"))).alias("hits"), F.min(F.when(F.col("right"), F.col("rank"))).alias("first")
    )
    both = hits.join(wanted.groupBy("q").agg(F.count("*").alias("wanted")), "q", "left")
    known = ~F.col("missing") & (F.col("wanted") > 0)
    return both.select(
        "q", F.when(known, F.round(F.col("hits") / F.col("wanted"), 6)).alias("recall"), F.when(known, (F.col("hits") > 0).cast("int")).alias("hit"), F.when(known, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("mrr")
    )


@query("""
SELECT round(1 - avg((event_type = 'error')::INT), 6) AS availability, 1 - avg((event_type = 'error')::INT) >= 0.995 AS available, quantile_cont(value, 0.95) < 3 AS fast,
  CASE WHEN count(*) < 100 THEN NULL ELSE 1 - avg((event_type = 'error')::INT) >= 0.995 AND quantile_cont(value, 0.95) < 3 END AS passed FROM events""")
def agg_slo_assess(t: Tables) -> DataFrame:
    """Availability and latency against their objectives; null with too few events to say."""
    rates = t.events.agg(F.avg((F.col("event_type") == "error").cast("int")).alias("e"), F.count("*").alias("n"))
    high = quantiles.quantiles(t.events, [], "value", {"p": (0.95, False)})  # one row
    available, fast = 1 - F.col("e") >= 0.995, F.col("p") < 3
    return rates.join(F.broadcast(high), how="left").select(F.round(1 - F.col("e"), 6).alias("availability"), available.alias("available"), fast.alias("fast"), F.when(F.col("n") >= 100, available & fast).alias("passed"))


# A chunk is a document: its meeting the source, its file the language, its page a stretch of lengths, its type the label's.
CHUNKS = "(SELECT doc_id, source, lang, n_chars // 1500 AS page, n_chars, CASE quality WHEN 1 THEN 'image' WHEN 0 THEN 'table' ELSE 'text' END AS kind FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"""
WITH c AS {CHUNKS}, a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS anchor FROM c QUALIFY anchor <= 5),
m AS (SELECT a.source, anchor, c.doc_id, row_number() OVER (PARTITION BY a.source, anchor ORDER BY c.doc_id DESC) AS n FROM a JOIN c ON a.source = c.source AND a.lang = c.lang AND a.page = c.page
  WHERE c.kind IN ('image', 'table') AND c.doc_id NOT IN (SELECT doc_id FROM a) QUALIFY n <= 2),
u AS (SELECT source, doc_id, min((anchor, n)) AS first FROM m GROUP BY source, doc_id)
SELECT source, doc_id AS sibling, row_number() OVER (PARTITION BY source ORDER BY first) AS place FROM u QUALIFY place <= 4""")
def join_sibling_chunks(t: Tables) -> DataFrame:
    """Pictures and tables on the pages of a request's best chunks: the two newest of each, four for the request, each once."""
    kind = F.when(F.col("quality") == 1, "image").when(F.col("quality") == 0, "table").otherwise("text")
    page = F.floor(F.col("n_chars") / 1500)
    chunks = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "source", "lang", page.alias("page"), "n_chars", kind.alias("kind"))
    anchors = ranking.top_per(chunks, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 5, "anchor")
    # Of a page only as many newest as all anchors together could take meet them.
    shown = chunks.where("kind IN ('image', 'table')").join(anchors.select("doc_id"), "doc_id", "left_anti")
    newest = ranking.top_per(shown, ["source", "lang", "page"], [F.desc("doc_id")], 2).select("source", "lang", "page", "doc_id")
    met = ranking.top_per(anchors.select("source", "lang", "page", "anchor").join(newest, ["source", "lang", "page"]), ["source", "anchor"], [F.desc("doc_id")], 2, "n")
    once = met.groupBy("source", "doc_id").agg(F.min(F.struct("anchor", "n")).alias("at"))
    return ranking.top_per(once, ["source"], [F.asc("at")], 4, "place").select("source", F.col("doc_id").alias("sibling"), F.col("place").cast("bigint").alias("place"))


# A memory is a customer, its revisions the orders in order of time; a checkpoint was saved at the start of 1998.
SAVED = "1998-01-01"


@query(f"""
WITH s AS (SELECT o_custkey AS k, count(*) AS revision, max(o_orderkey) AS through FROM orders WHERE o_orderdate < TIMESTAMP '{SAVED}' GROUP BY 1),
n AS (SELECT o_custkey AS k, count(*) AS revision, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0 GROUP BY 1),
m AS (SELECT o_custkey AS k, count(*) AS messages FROM orders JOIN s ON s.k = o_custkey WHERE o_orderkey > through GROUP BY 1)
SELECT k, CASE WHEN n.k IS NULL THEN 'deleted' WHEN status = 'P' THEN 'inactive' WHEN n.revision <> s.revision THEN 'changed' ELSE 'same' END AS state, coalesce(messages, 0) AS messages
FROM s LEFT JOIN n USING (k) LEFT JOIN m USING (k)""")
def join_continuation_diff(t: Tables) -> DataFrame:
    """What became of what a checkpoint had saved, and how many messages have come since."""
    orders = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate", "o_orderstatus")
    saved = orders.where(F.col("o_orderdate") < F.lit(SAVED).cast("timestamp_ntz")).groupBy("k").agg(F.count("*").alias("was"), F.max("o_orderkey").alias("through"))
    present = orders.join(t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("k")), "k", "left_semi")
    now = present.groupBy("k").agg(F.count("*").alias("revision"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    since = orders.join(saved.select("k", "through"), "k").where("o_orderkey > through").groupBy("k").agg(F.count("*").alias("messages"))
    state = F.when(F.col("revision").isNull(), "deleted").when(F.col("status") == "P", "inactive").when(F.col("revision") != F.col("was"), "changed").otherwise("same")
    return saved.join(now, "k", "left").join(since, "k", "left").select("k", state.alias("state"), F.coalesce("messages", F.lit(0)).alias("messages"))


HEADINGS = "list_filter(list_transform(regexp_extract_all(html, '<(?:h1|b)>([^<]*)', 1), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""
SELECT page_id, CASE WHEN len(h) > 0 THEN array_to_string(h, ' > ') END AS headings, CASE WHEN len(h) > 0 THEN round(len(list_distinct(h)) / len(h), 6) END AS confidence FROM (SELECT page_id, {HEADINGS} AS h FROM pages)""")
def scan_page_meta(t: Tables) -> DataFrame:
    """A page's headings, as far as they aren't blank, and how sure they are (a repeated one is doubtful); null without any."""
    found = F.filter(F.transform(F.regexp_extract_all("html", F.lit("<(?:h1|b)>([^<]*)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    h = t.pages.select("page_id", found.alias("h"))
    some = F.size("h") > 0
    return h.select("page_id", F.when(some, F.array_join("h", " > ")).alias("headings"), F.when(some, F.round(F.size(F.array_distinct("h")) / F.size("h"), 6)).alias("confidence"))


@query("""
SELECT page_id, coalesce(nullif(trim(advert), ''), nullif(trim(title), '')) AS text, CASE WHEN trim(advert) <> '' THEN 'caption' WHEN trim(title) <> '' THEN 'ocr' END AS kind
FROM (SELECT page_id, regexp_extract(html, '<div class="ad">([^<]*)', 1) AS advert, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)""")
def scan_image_texts(t: Tables) -> DataFrame:
    """The text of a picture: its caption, here the page's advert, or else what was read in it, here the title."""
    part = lambda pattern: F.trim(F.regexp_extract("html", pattern, 1))
    both = t.pages.select("page_id", part('<div class="ad">([^<]*)').alias("caption"), part("<title>([^<]*)").alias("ocr"))
    kind = F.when(F.col("caption") != "", "caption").when(F.col("ocr") != "", "ocr")
    return both.select("page_id", F.when(kind == "caption", F.col("caption")).when(kind == "ocr", F.col("ocr")).alias("text"), kind.alias("kind"))


@query(f"""
SELECT 'vector' AS strategy, vec_id AS doc_id, rank FROM {KNN} WHERE rank <= 10 UNION ALL SELECT 'lexical', doc_id, rank FROM {LEX} WHERE rank <= 10
UNION ALL SELECT 'hybrid', doc_id, rank FROM {FUSED} WHERE rank <= 10
UNION ALL SELECT 'multimodal', doc_id, row_number() OVER (ORDER BY rank) FROM (SELECT doc_id, rank FROM {FUSED} WHERE doc_id IN (SELECT doc_id FROM labels)) QUALIFY row_number() OVER (ORDER BY rank) <= 10""")
def ext_retrieval_strategy(t: Tables) -> DataFrame:
    """What each strategy that can be chosen finds; one for pictures takes of the fused list what has been labelled."""
    labelled = t.labels.select("doc_id")
    found = {
        "vector": lambda: knn(t).select(F.col("vec_id").alias("doc_id"), "rank"),
        "lexical": lambda: bm25(t).select("doc_id", "rank"),
        "hybrid": lambda: fused(t).select("doc_id", "rank"),
        "multimodal": lambda: ranking.ranked(fused(t).select("doc_id", F.col("rank").alias("r")).join(labelled, "doc_id", "left_semi"), [F.asc("r")]).select("doc_id", "rank"),
    }
    out = None
    for name in found:
        own = strategies.selected(name, found)().where("rank <= 10").select(F.lit(name).alias("strategy"), "doc_id", F.col("rank").cast("bigint").alias("rank"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""
SELECT f.format, source, count(*) AS parts, sum(octet_length(encode(CASE f.format WHEN 'markdown' THEN concat('## ', doc_id, chr(10), text, chr(10)) WHEN 'text' THEN concat(text, chr(10)) ELSE concat('{"doc_id":', doc_id, ',"n_chars":', n_chars, '}') END)))::BIGINT AS bytes
FROM documents, (SELECT unnest(['text', 'markdown', 'json']) AS format) f GROUP BY ALL""")
def sink_meeting_export(t: Tables) -> DataFrame:
    """Every source written in three formats, in order of its documents, and what was written counted when read back."""
    folder = f"{shared_folder(t.spark)}/export-{uuid.uuid4().hex}"
    forms = {"text": F.concat("text", F.lit("\n")), "markdown": F.concat(F.lit("## "), "doc_id", F.lit("\n"), "text", F.lit("\n")), "json": F.to_json(F.struct("doc_id", "n_chars"))}
    out = None
    for name, form in forms.items():
        own = export.written(t.documents, f"{folder}/{name}", ["source"], ["doc_id"], form)
        own = own.groupBy("source").agg(F.count("*").alias("parts"), F.sum(F.octet_length("value")).alias("bytes")).select(F.lit(name).alias("format"), "source", "parts", "bytes")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT conv_id, count(*) AS turns, CASE WHEN count(*) <= 4 THEN 'fast' WHEN count(*) <= 8 THEN 'balanced' ELSE 'thorough' END AS profile, CASE WHEN count(*) <= 8 THEN 8 ELSE 12 END AS top_k, CASE WHEN count(*) <= 4 THEN 3 WHEN count(*) <= 8 THEN 6 ELSE 8 END AS fetch FROM conversations GROUP BY conv_id")
def ext_profiles(t: Tables) -> DataFrame:
    """The retrieval profile that each conversation's length asks for."""
    turns = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"))
    named = turns.withColumn("profile", F.when(F.col("turns") <= 4, "fast").when(F.col("turns") <= 8, "balanced").otherwise("thorough"))
    presets = [(name, p.top_k, p.fetch) for name, p in strategies.PROFILES.items()]  # a handful
    return named.join(F.broadcast(t.spark.createDataFrame(presets, "profile string, top_k int, fetch int")), "profile").select("conv_id", "turns", "profile", "top_k", "fetch")


@query("SELECT doc_id, substr(sha256(array_to_string(list_sort([concat('lang=', coalesce(lang, '')), concat('source=', coalesce(source, '')), concat('size=', n_chars)]), '|')), 1, 24) AS fingerprint FROM documents")
def hash_fingerprint(t: Tables) -> DataFrame:
    """A fingerprint of what an index was configured with for each document, whatever the order of its settings."""
    settings = F.array(*(F.concat(F.lit(f"{k}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in (("lang", "lang"), ("source", "source"), ("size", "n_chars"))))
    return t.documents.select("doc_id", F.substring(F.sha2(F.array_join(F.array_sort(settings), "|").cast("binary"), 256), 1, 24).alias("fingerprint"))


@query("""
SELECT event_id, concat_ws(',', CASE WHEN (value = 0 AND k <> 0) OR (value <> 0 AND (k - value) / abs(value) > 0.05) THEN 'm.latency' END, CASE WHEN k <> 0 AND (k - value) / abs(k) > 0.05 THEN 'm.recall' END) AS worse
FROM (SELECT event_id, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)""")
def json_flatten_metrics(t: Tables) -> DataFrame:
    """Metrics that got worse between two payloads: a latency from the value to k, a recall the other way."""
    value, k = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    slower = ((value == 0) & (k != 0)) | ((value != 0) & F.coalesce((k - value) / F.abs(F.nullif(value, F.lit(0.0))) > 0.05, F.lit(False)))
    lost = (k != 0) & F.coalesce((k - value) / F.abs(F.nullif(k, F.lit(0.0))) > 0.05, F.lit(False))
    return t.events.select("event_id", F.concat_ws(",", F.when(slower, "m.latency"), F.when(lost, "m.recall")).alias("worse"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '^\\s*<') THEN 'html' WHEN regexp_matches(text, '^\\s*[{\\[]') THEN 'json' WHEN contains(text, ' | ') THEN 'table' ELSE 'text' END AS kind, len(string_split(text, chr(10)))::BIGINT AS parts FROM documents""")
def ext_file_processor(t: Tables) -> DataFrame:
    """The kind of a text by what it looks like, and its lines."""
    kind = F.when(F.col("text").rlike(r"^\s*<"), "html").when(F.col("text").rlike(r"^\s*[{\[]"), "json").when(F.contains("text", F.lit(" | ")), "table").otherwise("text")
    return t.documents.select("doc_id", kind.alias("kind"), F.size(F.split("text", "\n")).cast("bigint").alias("parts"))


@query("SELECT doc_id, md5(text) AS text FROM documents")
def scan_text_file(t: Tables) -> DataFrame:
    """Bytes of a text file read as UTF-8."""
    data = t.documents.select("doc_id", F.encode("text", "utf-8").alias("data"))
    return data.select("doc_id", F.md5(F.decode("data", "utf-8")).alias("text"))


@query(r"""
SELECT conv_id, turn, CASE WHEN length(said) >= 10 THEN said ELSE concat('picture of ', strlen(text), ' bytes') END AS text FROM (SELECT conv_id, turn, text, trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS said FROM conversations)""")
def scan_image_ocr(t: Tables) -> DataFrame:
    """What was read in a picture, here the letters of a turn; a picture in which little was read is described by its size."""
    said = F.trim(F.regexp_replace("text", "[^A-Za-z ]", ""))
    return t.conversations.select("conv_id", "turn", F.when(F.length(said) >= 10, said).otherwise(F.concat(F.lit("picture of "), F.octet_length("text"), F.lit(" bytes"))).alias("text"))


@query(f"""
SELECT d.doc_id, len(list_distinct(regexp_extract_all(lower(d.text), '{T.PLAIN_WORD}'))) AS own, len(list_intersect(list_distinct(regexp_extract_all(lower(d.text), '{T.PLAIN_WORD}')), list_distinct(regexp_extract_all(lower(b.text), '{T.PLAIN_WORD}')))) AS shared
FROM documents d JOIN documents b ON b.doc_id = d.doc_id - 1""")
def str_token_support(t: Tables) -> DataFrame:
    """How many different words of a text the text of the id before supports."""
    before = t.documents.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before"))
    words = lambda c: F.array_distinct(T.words(F.col(c)))
    both = t.documents.select("doc_id", "text").join(before, "doc_id")
    return both.select("doc_id", F.size(words("text")).cast("bigint").alias("own"), F.size(F.array_intersect(words("text"), words("before"))).cast("bigint").alias("shared"))
