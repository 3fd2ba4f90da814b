"""Text operators over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import Tables, query

WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
DOC = "SELECT doc_id, {} FROM documents"


def register(name: str, sql: str, columns) -> None:
    """A query of documents whose further columns ``columns()`` gives; they are made when it runs, in its session."""
    query(sql, name)(lambda t: t.documents.select("doc_id", *(f.alias(n) for n, f in columns().items())))


joined = lambda x: F.md5(F.array_join(x, "|"))
JOINED = "md5(array_to_string({}, '|'))"

register("str_char_ngrams", DOC.format("len(list_distinct([substr(trim(lower(text)), i, 4) for i in range(1, greatest(length(trim(lower(text))) - 3, 1) + 1)])) AS n"), lambda: dict(n=F.size(T.char_ngrams(F.col("text"), 4)).cast("bigint")))
register("str_ngram_size", DOC.format("CASE WHEN length(text) < 100 THEN 3 WHEN length(text) > 1000 THEN 5 ELSE 4 END AS n"), lambda: dict(n=T.ngram_size(F.col("text"))))
register("str_content_normalise", DOC.format(f"substr(sha256({WS.format('lower(text)')}), 1, 32) AS content_key"), lambda: dict(content_key=T.content_key(F.col("text"))))
register("str_prior_tokens", DOC.format(JOINED.format("list_filter(regexp_extract_all(text, '[a-zA-Z0-9一-鿿]+'), lambda x: length(x) >= 4)") + " AS prior_tokens"), lambda: dict(prior_tokens=joined(T.prior_tokens(F.col("text")))))
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
register("str_fact_markers", DOC.format(JOINED.format(f"list_concat(regexp_extract_all(text, '{T.NUMBER}'), list_filter({TOKENS.format('text')}, lambda x: x IN {T.NEGATIONS}))") + " AS markers"), lambda: dict(markers=joined(T.fact_markers(F.col("text")))))
register("str_split_speakers", "SELECT doc_id, array_to_string(list_filter([trim(x) for x in string_split_regex(concat(source, ', ', lang, ',, ', chr(31), upper(lang)), '[,\\x1f]')], lambda x: x <> ''), '|') AS speakers FROM documents", lambda: dict(speakers=F.array_join(T.split_speakers(F.concat("source", F.lit(", "), "lang", F.lit(",, \x1f"), F.upper("lang"))), "|")))
register("str_scrub_segment", DOC.format("md5(" + WS.format(r"regexp_replace(text, '\[[Ss]peaker[^\]]*\]', ' ', 'g')") + ") AS scrubbed"), lambda: dict(scrubbed=F.md5(T.scrubbed(F.col("text")))))
register("str_boilerplate_low_info", r"SELECT doc_id, (len(w) = 0 OR (len(list_distinct(w)) = 1 AND len(w) > 2) OR (len(w) <= 1 AND length(text) < 20)) AS low FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)", lambda: dict(low=T.is_boilerplate(F.col("text"))))
register("str_key_points", DOC.format(JOINED.format(r"list_slice(list_filter([trim(regexp_replace(x, '^[ ]*(?:[-*•]|[0-9]+[.)])[ ]*', '')) for x in string_split(text, chr(10))], lambda x: length(x) >= 12), 1, 10)") + " AS points"), lambda: dict(points=joined(T.key_points(F.col("text")))))
query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g')) AS clean FROM pages", "str_sanitize")(lambda t: t.pages.select("page_id", F.md5(T.sanitized(F.col("html"))).alias("clean")))
register("str_assertion_normalise", DOC.format(r"md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS assertion"), lambda: dict(assertion=F.md5(T.assertion_key(F.col("text")))))
CLAUSES = r"list_filter([trim(x) for x in string_split_regex(text, '[.!?;\n]+|, but | however ')], lambda x: x <> '')"
register("str_split_clauses", DOC.format(JOINED.format(CLAUSES) + f" AS clauses, len({CLAUSES}) AS n"), lambda: dict(clauses=joined(T.clauses(F.col("text"))), n=F.size(T.clauses(F.col("text"))).cast("bigint")))
register("str_current_assertion", DOC.format(rf"len(list_filter({CLAUSES}, lambda x: NOT (regexp_matches(x, '\?\s*$') OR list_has_any({TOKENS.format('x')}, {[*T.UNCERTAIN, *T.NEGATIONS]})))) AS current_clauses"), lambda: dict(current_clauses=F.size(F.filter(T.clauses(F.col("text")), T.is_current_assertion)).cast("bigint")))
register("str_strip_citations", DOC.format(r"md5(regexp_replace(concat(text, ' [12] end [x] [3]'), ' ?\[[0-9]+\]', '', 'g')) AS stripped"), lambda: dict(stripped=F.md5(T.without_citations(F.concat(F.col("text"), F.lit(" [12] end [x] [3]"))))))
REDACT = "text"
for pattern, mark in ((T.EMAIL, "[email]"), (T.PHONE, "[phone]"), (T.IPV4, "[ip]"), (T.CARD, "[card]")):
    REDACT = f"regexp_replace({REDACT}, '{pattern}', '{mark}', 'g')"
register("str_pii_redact", DOC.format(f"md5({REDACT}) AS redacted"), lambda: dict(redacted=F.md5(T.redacted(F.col("text")))))
register("filter_pii_entity", rf"SELECT doc_id, (regexp_matches(text, '{T.EMAIL}') OR regexp_matches(text, '{T.PHONE}') OR regexp_matches(text, '{T.CARD}') OR regexp_matches(text, '\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\b')) AS pii FROM documents", lambda: dict(pii=T.looks_like_pii(F.col("text"))))
register("filter_directive_guard", rf"SELECT doc_id, regexp_matches(lower(text), '{T.DIRECTIVE}') AS directive FROM documents", lambda: dict(directive=T.has_directive(F.col("text"))))
AT = "strpos(lower(text), 'tion')"
register("project_snippet", f"""SELECT doc_id, CASE WHEN {AT} > 0 THEN concat(CASE WHEN greatest({AT} - 100, 1) > 1 THEN '...' ELSE '' END,
 substr(text, greatest({AT} - 100, 1), least({AT} + 4 + 99, length(text)) - greatest({AT} - 100, 1) + 1), CASE WHEN least({AT} + 4 + 99, length(text)) < length(text) THEN '...' ELSE '' END)
 ELSE substr(text, 1, 200) END AS snippet FROM documents""", lambda: dict(snippet=T.snippet(F.col("text"), "tion")))
register("str_token_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9_]+|[^\x00-\x7f]|[^\sa-zA-Z0-9_]')) + 4 AS BIGINT) AS tokens FROM documents", lambda: dict(tokens=(T.token_count(F.col("text")) + 4).cast("bigint")))
register("str_fts_query_build", DOC.format(JOINED.format("list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3)))") + " AS terms"), lambda: dict(terms=joined(F.array_sort(T.fts_terms(F.col("text"))))))
register("str_keyword_match", r"""SELECT doc_id, CASE WHEN contains(lower(text), 'the') AND NOT contains(lower(text), 'scum')
 THEN (0.4 + 0.4 * (contains(lower(text), 'and')::INT + contains(lower(text), 'with')::INT) / 2.0 + 0.2 * regexp_matches(lower(text), '\bof the\b')::INT)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents""", lambda: dict(score=T.keyword_score(F.col("text"), ["the"], ["and", "with"], ["scum"], r"\bof the\b")))
register("str_evidence_location", "SELECT doc_id, n, CASE WHEN n = 1 THEN strpos(lower(text), 'that the') ELSE 0 END AS place FROM (SELECT doc_id, text, len(regexp_extract_all(lower(text), 'that the'))::BIGINT AS n FROM documents)", lambda: dict(n=F.regexp_count(F.lower(F.col("text")), F.lit("that the")).cast("bigint"), place=F.when(F.regexp_count(F.lower(F.col("text")), F.lit("that the")) == 1, F.locate("that the", F.lower(F.col("text")))).otherwise(0).cast("bigint")))
INTENT = [("compare", r"\b(?:compare|versus|difference)\b"), ("summary", r"\b(?:summary|summari[sz]e|overview)\b"), ("list", r"\b(?:list|all|every|which)\b"), ("time", r"\b(?:when|date|before|after)\b"), ("count", r"\b(?:how many|count|number of)\b")]
query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in INTENT) + " ELSE 'fact' END AS intent FROM conversations", "str_intent_classify")(
    lambda t: t.conversations.select("conv_id", "turn", F.coalesce(*(F.when(F.lower(F.col("text")).rlike(p), n) for n, p in INTENT), F.lit("fact")).alias("intent"))
)
TYPES = [("decision", "decid|agreed"), ("action", "todo|action|will"), ("risk", "risk|issue"), ("date", "[0-9]{4}")]
query("SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in TYPES) + "], lambda x: x IS NOT NULL), ',') AS types FROM conversations", "str_structured_types")(
    lambda t: t.conversations.select("conv_id", "turn", F.array_join(F.array_compact(F.array(*(F.when(F.lower(F.col("text")).rlike(p), n) for n, p in TYPES))), ",").alias("types"))
)
LINES = "SELECT doc_id, i AS line_no, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)"


def lines(t: Tables):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


query(rf"SELECT doc_id, line_no, md5(trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), '[0-9]+', '#', 'g'), '[^\p{{L}}\p{{N}}# ]', '', 'g'))) AS line_key FROM ({LINES})", "str_line_normalise")(lambda t: lines(t).select("doc_id", "line_no", F.md5(T.line_key(F.col("line"), True)).alias("line_key")))
query(f"SELECT doc_id, line_no, regexp_matches(trim(lower(line)), '{T.PAGE_MARKER}') AS marker FROM ({LINES})", "str_page_marker")(lambda t: lines(t).select("doc_id", "line_no", T.is_page_marker(F.col("line")).alias("marker")))
ALPHA = r"CASE WHEN length(regexp_replace(line, '\s', '', 'g')) > 0 THEN length(regexp_replace(line, '[^\p{L}]', '', 'g')) / length(regexp_replace(line, '\s', '', 'g')) ELSE 0 END"


def keep_information(t: Tables):
    """Drop low-information lines of a document, but from its end only as far as two lines stay."""
    from pyspark.sql import Window

    flagged = lines(t).withColumn("low", T.is_low_information(F.col("line")))
    w = Window.partitionBy("doc_id")
    ranked = flagged.withColumn("good", F.sum((~F.col("low")).cast("int")).over(w)).withColumn("r", F.row_number().over(w.orderBy("low", "line_no")))
    return ranked.where(~F.col("low") | (F.col("r") <= F.greatest(F.col("good"), F.lit(2)))).select("doc_id", "line_no", "low")


query(rf"""SELECT doc_id, line_no, low FROM (SELECT *, sum((NOT low)::INT) OVER (PARTITION BY doc_id) AS good, row_number() OVER (PARTITION BY doc_id ORDER BY low, line_no) AS r FROM
 (SELECT doc_id, line_no, line, regexp_matches(trim(lower(line)), '{T.PAGE_MARKER}') OR (({ALPHA}) < 0.30 AND len(list_filter(regexp_extract_all(lower(line), '[a-z0-9]+'), lambda x: length(x) > 2)) < 5) AS low FROM ({LINES})))
 WHERE NOT low OR r <= greatest(good, 2)""", "filter_low_information")(keep_information)

register("project_contextualize", "SELECT doc_id, md5(p || text) AS content, length(p)::INT AS prefix FROM (SELECT doc_id, text, concat('[Retrieval context: file=', doc_id, '; meeting=', source, '; language=', lang, '] ') AS p FROM documents)", lambda: dict(content=F.md5(F.concat(F.format_string("[Retrieval context: file=%d; meeting=%s; language=%s] ", "doc_id", "source", "lang"), F.col("text"))), prefix=F.length(F.format_string("[Retrieval context: file=%d; meeting=%s; language=%s] ", "doc_id", "source", "lang"))))
query("SELECT doc_id, md5(text) AS content FROM documents", "project_restore_display")(
    lambda t: t.documents.withColumn("p", F.format_string("[Retrieval context: file=%d; meeting=%s] ", "doc_id", "source")).select("doc_id", F.md5(F.substr(F.concat("p", "text"), F.length("p") + 1, F.length("text"))).alias("content"))
)
register("project_chunk_id", "SELECT doc_id, concat_ws('_', 'meeting', source, 'file', doc_id::VARCHAR, 'text', 'g1') AS chunk_id FROM documents", lambda: dict(chunk_id=F.concat_ws("_", F.lit("meeting"), "source", F.lit("file"), F.col("doc_id").cast("string"), F.lit("text"), F.lit("g1"))))
register("topk_rrf_dedup_key", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'L' || doc_id WHEN doc_id % 3 = 1 THEN 'C' || doc_id ELSE substr(sha256({WS.format('lower(text)')}), 1, 32) END AS dedup_key FROM documents", lambda: dict(dedup_key=T.dedup_key(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("L"), "doc_id")), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("C"), "doc_id")), F.col("text"))))
register("filter_quality_gate", r"""SELECT doc_id, (length(text) > 0 AND length(text) >= 100 AND NOT (n_chars > 100 AND length(text) < 0.05 * n_chars) AND length(regexp_replace(text, '[^\x01-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) <= 0.03 * length(text)) AS ok,
 round(0.9 - CASE WHEN length(text) < 100 THEN 0.3 ELSE 0 END - CASE WHEN length(regexp_replace(text, '[^\x01-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) > 0.03 * length(text) THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM documents""",
    lambda: dict(ok=(F.length(F.col("text")) >= 100) & ~((F.col("n_chars") > 100) & (F.length(F.col("text")) < 0.05 * F.col("n_chars"))) & (F.length(F.regexp_replace(F.col("text"), r"[^\x01-\x08\x0b\x0c\x0e-\x1f]", "")) <= 0.03 * F.length(F.col("text"))),
    score=F.round(F.lit(0.9) - F.when(F.length(F.col("text")) < 100, 0.3).otherwise(0.0) - F.when(F.length(F.regexp_replace(F.col("text"), r"[^\x01-\x08\x0b\x0c\x0e-\x1f]", "")) > 0.03 * F.length(F.col("text")), 0.2).otherwise(0.0), 6)))
register("scan_file_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents", lambda: dict(content_hash=F.sha2(F.encode(F.col("text"), "utf-8"), 256)))
register("scan_document_profile", "SELECT doc_id, len(string_split(text, chr(10)))::INT AS pages, length(text)::BIGINT AS chars, round(length(text) / len(string_split(text, chr(10))), 6) AS chars_per_page, length(text) / len(string_split(text, chr(10))) < 50 AS scanned FROM documents", lambda: dict(pages=F.size(F.split(F.col("text"), "\n")), chars=F.length(F.col("text")).cast("bigint"), chars_per_page=F.round(F.length(F.col("text")) / F.size(F.split(F.col("text"), "\n")), 6), scanned=F.length(F.col("text")) / F.size(F.split(F.col("text"), "\n")) < 50))
register("scan_parser_router", "SELECT doc_id, CASE WHEN length(text) / len(string_split(text, chr(10))) < 50 THEN 'ocr,local,remote' ELSE 'local,remote,ocr' END AS parsers FROM documents", lambda: dict(parsers=F.array_join(F.when(F.length(F.col("text")) / F.size(F.split(F.col("text"), "\n")) < 50, F.array(*map(F.lit, ("ocr", "local", "remote")))).otherwise(F.array(*map(F.lit, ("local", "remote", "ocr")))), ",")))
ROLES = [("attachment", "lecture|course"), ("transcript", "meeting|transcript"), ("minutes", "minutes"), ("agenda", "agenda"), ("decision_log", "decision")]
NAMES = [("lecture notes.PDF", 0), ("Meeting 3.txt", 1), ("minutes.md", 2), ("AGENDA.docx", 3), ("decisions.xlsx", 4), ("photo.png", 5)]
FILE = "['" + "','".join(n for n, _ in NAMES) + "'][(doc_id % 6 + 1)::INT]"
def file_name():
    return F.element_at(F.array(*(F.lit(n) for n, _ in NAMES)), (F.col("doc_id") % 6 + 1).cast("int"))


register("scan_material_role", f"SELECT doc_id, CASE {' '.join(f'''WHEN regexp_matches(lower({FILE}), '{p}') THEN '{r}' ''' for r, p in ROLES)} ELSE 'attachment' END AS role FROM documents", lambda: dict(role=F.coalesce(*(F.when(F.lower(file_name()).rlike(p), r) for r, p in ROLES), F.lit("attachment"))))
KINDS = {"pdf": ("pdf", True), "txt": ("text", False), "md": ("text", False), "docx": ("word", True), "xlsx": ("sheet", False), "png": ("image", True)}


def file_kinds(t: Tables):
    kinds = t.spark.createDataFrame([(k, *v) for k, v in KINDS.items()], "extension string, kind string, images boolean")  # a fixed table of kinds
    return t.documents.select("doc_id", F.lower(F.element_at(F.split(file_name(), r"\."), -1)).alias("extension")).join(F.broadcast(kinds), "extension", "left").select("doc_id", "kind", "images")


query(f"SELECT doc_id, kind, images FROM (SELECT doc_id, lower(string_split({FILE}, '.')[-1]) AS extension FROM documents) LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v[0]}', {v[1]})" for k, v in KINDS.items()) + ") AS k(extension, kind, images) USING (extension)", "scan_file_kind_lookup")(file_kinds)
register("arr_id_list_codec", "SELECT doc_id, array_to_string([doc_id, doc_id + 1, n_chars], ',') AS ids FROM documents", lambda: dict(ids=F.array_join(F.transform(F.array("doc_id", F.col("doc_id") + 1, "n_chars"), lambda x: x.cast("string")), ",")))
register("arr_decode_scope", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([try_cast(trim(x) AS BIGINT) for x in string_split(concat(doc_id, ', ', n_chars % 7, ',x7,,', doc_id), ',')], lambda x: x IS NOT NULL))), ',') AS ids FROM documents", lambda: dict(ids=F.array_join(F.transform(F.array_sort(T.id_list(F.concat("doc_id", F.lit(", "), F.col("n_chars") % 7, F.lit(",x7,,"), "doc_id"))), lambda x: x.cast("string")), ",")))
register("hash_evidence_identity", "SELECT doc_id, sha256(concat('[\"', source, '\",', doc_id, ',1,\"p1\"]')) AS identity FROM documents", lambda: dict(identity=F.sha2(F.format_string('["%s",%d,1,"p1"]', "source", "doc_id"), 256)))
register("hash_job_jitter", "SELECT doc_id, (least(300, pow(2, doc_id % 12)) + ('0x' || substr(sha256(doc_id::VARCHAR), 1, 7))::BIGINT % 5)::BIGINT AS delay FROM documents", lambda: dict(delay=(F.least(F.lit(300), F.pow(F.lit(2), F.col("doc_id") % 12)).cast("bigint") + F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 7), 16, 10).cast("bigint") % 5)))
SETTINGS = ("chunk=384", "overlap=64", "metric=l2", "model=default", "version=1")
query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events", "json_extract_metadata")(lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")))
query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events", "json_valid_guard")(
    lambda t: t.events.withColumn("raw", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))).select("event_id", F.when(F.try_parse_json("raw").isNotNull(), F.get_json_object("raw", "$.k").cast("bigint")).alias("k"))
)
query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, '|', c_mktsegment) ELSE concat(c_mktsegment, '|', c_name) END AS aliases FROM customer", "json_aliases")(
    lambda t: t.customer.withColumn("raw", F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.array("c_name", "c_mktsegment"))).otherwise(F.concat("c_mktsegment", F.lit(", "), "c_name"))).select("c_custkey", F.array_join(F.coalesce(F.from_json("raw", "array<string>"), F.transform(F.split("raw", ","), lambda x: F.trim(x))), "|").alias("aliases"))
)
query("SELECT event_id, strftime(to_timestamp(floor(abs(value) * 10)), '%H:%M:%S') AS hms FROM events", "date_hms")(lambda t: t.events.select("event_id", T.hms(F.floor(F.abs("value") * 10)).alias("hms")))
query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::INT AS day FROM orders", "date_yyyymmdd")(lambda t: t.orders.select("o_orderkey", T.yyyymmdd(F.col("o_orderdate")).alias("day")))
query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE epoch(o_orderdate)::BIGINT END AS utc FROM orders", "date_as_utc")(
    lambda t: t.orders.withColumn("raw", F.when(F.col("o_orderkey") % 4 == 0, F.lit("not a time")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))).select("o_orderkey", F.expr("unix_timestamp(try_cast(raw AS timestamp))").alias("utc"))
)
query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch(o_orderdate + to_days(90))::BIGINT END AS expires FROM orders", "date_expiry")(
    lambda t: t.orders.withColumn("ttl", F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(90)).select("o_orderkey", F.when(F.col("ttl") >= 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.col("ttl")))).alias("expires"))
)
