"""Jobs, traces, sessions, transcripts and event time over events, conversations, documents and pages.

An event is a job or a trace span: event_type is its kind, value its duration, the user its owner. A conversation turn is
a message or utterance, its role the speaker.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import history, quantiles, ranking
from ..sources.store import shared_folder
from ..streaming import events as S
from ..streaming import keyed
from .registry import Tables, query

NOW = "2024-01-31 00:00:00"
now = lambda: F.lit(NOW).cast("timestamp_ntz")
seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' ELSE 'ready' END"
status = lambda: F.expr(STATUS)
E = "(SELECT *, " + STATUS + " AS status FROM events)"
ev = lambda t: t.events.withColumn("status", status())

query(f"SELECT status, count(*) AS n FROM {E} GROUP BY status", "agg_job_counts")(lambda t: ev(t).groupBy("status").agg(F.count("*").alias("n")))
query(f"SELECT count(*) FILTER (status = 'running' AND ts < TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS expired, greatest(0, max(epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))))::BIGINT AS oldest FROM {E} WHERE status = 'running'", "agg_job_health")(
    lambda t: ev(t).where("status = 'running'").agg(F.count_if(F.col("ts") < now() - F.expr("interval 1 day")).alias("expired"), F.greatest(F.lit(0), F.max(F.unix_timestamp(now().cast("timestamp")) - seconds("ts"))).cast("bigint").alias("oldest"))
)
query(f"SELECT user_id, status, count(*) AS n FROM {E} GROUP BY ALL", "agg_file_status_counts")(lambda t: ev(t).groupBy("user_id", "status").agg(F.count("*").alias("n")))
query(f"SELECT user_id, CASE WHEN bool_or(status = 'running') THEN 'processing' WHEN bool_or(status = 'queued') THEN 'summarizing' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'ready' END AS rollup FROM {E} GROUP BY user_id", "agg_meeting_status_rollup")(
    lambda t: ev(t).groupBy("user_id").agg(*(F.bool_or(F.col("status") == s).alias(s) for s in ("running", "queued", "failed"))).select("user_id", F.when(F.col("running"), "processing").when(F.col("queued"), "summarizing").when(F.col("failed"), "failed").otherwise("ready").alias("rollup"))
)
query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id", "agg_distinct_types")(lambda t: t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")))
query("SELECT source, count(DISTINCT doc_id) AS n FROM documents WHERE lang = 'en' GROUP BY source", "agg_count_distinct_files")(lambda t: t.documents.where("lang = 'en'").groupBy("source").agg(F.countDistinct("doc_id").alias("n")))
SPAN = "count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation"


def span(df: DataFrame, *by: str) -> DataFrame:
    """Exact percentiles by linear interpolation, and the spread, of each label."""
    plain = df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"))
    exact = quantiles.quantiles(df, list(by), "value", {f"p{k}": (k / 100, False) for k in (50, 95, 99)})
    return plain.join(exact, list(by), "left").select(*by, "n", *(F.round(f"p{k}", 6).alias(f"p{k}") for k in (50, 95, 99)), "mean", "deviation")


query(f"SELECT event_type, {SPAN} FROM events GROUP BY event_type UNION ALL SELECT 'trace_total', {SPAN} FROM events", "agg_span_stats")(
    lambda t: span(t.events.select(F.explode(F.array("event_type", F.lit("trace_total"))).alias("event_type"), "value"), "event_type")
)
def latency(df: DataFrame) -> DataFrame:
    """The median, and the 95th and 99th percentile by nearest rank, of each kind."""
    exact = quantiles.quantiles(df, ["event_type"], "value", {"p50": (0.5, False), "p95": (0.95, True), "p99": (0.99, True)})
    counts = df.groupBy("event_type").agg(F.count("*").alias("evaluated"), F.count_if(F.col("value").isNull()).alias("skipped"))
    return counts.join(exact, "event_type", "left").select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")), "evaluated", "skipped")


query("SELECT event_type, round(median(value), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, count(*) AS evaluated, count(*) FILTER (value IS NULL) AS skipped FROM events GROUP BY event_type", "agg_latency_nearest_rank")(
    lambda t: latency(t.events)
)
ERRORS = "SELECT event_id, user_id, round(avg((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW), 6) AS rate FROM events"
query(ERRORS, "agg_error_rate_window")(lambda t: S.trailing_error_rate(t.events, "user_id", 86400).select("event_id", "user_id", F.round("rate", 6).alias("rate")))
query(f"SELECT *, rate >= 0.5 AS alert FROM ({ERRORS})", "stream_sliding_error_rate")(lambda t: S.trailing_error_rate(t.events, "user_id", 86400).select("event_id", "user_id", F.round("rate", 6).alias("rate"), (F.round("rate", 6) >= 0.5).alias("alert")))
query(f"SELECT stage, count(*) AS files FROM (SELECT json_extract_string(props, '$.k')::BIGINT AS file, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'queued') THEN 'queued' WHEN bool_or(status = 'completed') THEN 'completed' ELSE 'unknown' END AS stage FROM {E} GROUP BY 1) GROUP BY stage", "agg_extraction_progress")(
    lambda t: ev(t).groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("file")).agg(F.collect_set("status").alias("s")).select(F.coalesce(*(F.when(F.array_contains("s", x), x) for x in ("failed", "running", "queued", "completed")), F.lit("unknown")).alias("stage")).groupBy("stage").agg(F.count("*").alias("files"))
)
query("SELECT user_id, round(avg((event_type = 'purchase')::INT), 6) AS usefulness FROM events GROUP BY user_id", "agg_usefulness_mean")(lambda t: t.events.groupBy("user_id").agg(F.round(F.avg((F.col("event_type") == "purchase").cast("int")), 6).alias("usefulness")))
# Digests of sets of ids: sums of 60 bits of each id's MD5, so no task holds the ids of a source and order doesn't matter.
ID_SUM = "sum(('0x' || substr(md5({}::VARCHAR), 1, 15))::BIGINT)"


def id_sum(c: str) -> Column:
    return F.sum(F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 15), 16, 10).cast("decimal(20,0)"))


query(f"SELECT source, sha256(concat(count(*), ':', {ID_SUM.format('doc_id')})) AS digest FROM documents GROUP BY source", "agg_source_snapshot_hash")(
    lambda t: t.documents.groupBy("source").agg(F.sha2(F.concat(F.count("*").cast("string"), F.lit(":"), id_sum("doc_id").cast("string")), 256).alias("digest"))
)
query("SELECT conv_id, arg_max(role, (n, -first)) AS speaker FROM (SELECT conv_id, role, sum(length(text)) AS n, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id", "agg_dominant_speaker")(lambda t: t.conversations.groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("n"), F.min("turn").alias("first")).groupBy("conv_id").agg(F.max_by("role", F.struct("n", -F.col("first"))).alias("speaker")))
query("SELECT count(*) AS n FROM documents WHERE source IN ('src1', 'src2')", "agg_retrieval_pool_estimate")(lambda t: t.documents.where("source IN ('src1', 'src2')").agg(F.count("*").alias("n")))
query(f"SELECT source, count(*) AS files, count(vec_id) AS indexed, {ID_SUM.format('doc_id')} = {ID_SUM.format('vec_id')} AS same FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source", "join_index_consistency")(
    lambda t: manifest(t, "source").select("source", "files", "indexed", "same")
)


def manifest(t: Tables, by: str) -> DataFrame:
    """Ids of rows and of vectors of each group, counted and compared by digest."""
    both = t.documents.select("doc_id", by).join(t.embeddings.select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left")
    counts = both.groupBy(by).agg(F.count("*").alias("files"), F.count("vec_id").alias("indexed"), id_sum("vec_id").alias("v"), id_sum("doc_id").alias("d"))
    return counts.select(by, "files", "indexed", F.md5(F.coalesce(F.col("v").cast("string"), F.lit(""))).alias("digest"), (F.col("v") == F.col("d")).alias("same"))


query(f"SELECT source, count(vec_id) AS indexed, md5(coalesce({ID_SUM.format('vec_id')}::VARCHAR, '')) AS digest FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source", "index_manifest_inspect")(
    lambda t: manifest(t, "source").select("source", "indexed", "digest")
)
query(f"SELECT status, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS expired FROM {E} GROUP BY status", "agg_idempotency_lifecycle")(lambda t: ev(t).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("ts") < now() - F.expr("interval 7 days")).alias("expired")))
query("SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'pending') AS status, count(*) AS n FROM events GROUP BY 1", "agg_pending_by_status")(lambda t: t.events.groupBy(F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("pending")).alias("status")).agg(F.count("*").alias("n")))
query("SELECT sha256(concat_ws('|', floor(epoch(max(ts) FILTER (ts <= TIMESTAMP '2024-01-15')))::BIGINT, max(event_id), 'q1')) AS token FROM events", "agg_clock_fence")(lambda t: t.events.agg(F.sha2(F.concat_ws("|", F.max(F.when(F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz"), seconds("ts"))).cast("string"), F.max("event_id").cast("string"), F.lit("q1")), 256).alias("token")))
query("SELECT user_id, count(*) + 1 AS next FROM events GROUP BY user_id", "agg_next_sequence")(lambda t: t.events.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).groupBy("user_id").agg((F.max("seq") + 1).cast("bigint").alias("next")))
query(f"SELECT count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'running') < 64 AS free FROM {E}", "agg_capacity_count")(lambda t: ev(t).agg(F.count_if(F.col("status") == "running").alias("running"), (F.count_if(F.col("status") == "running") < 64).alias("free")))
query(f"SELECT user_id, count(*) AS recovered FROM {E} WHERE status = 'running' AND ts < TIMESTAMP '{NOW}' - INTERVAL 10 DAY AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 400) GROUP BY user_id", "agg_stuck_recovery")(
    lambda t: ev(t).where((F.col("status") == "running") & (F.col("ts") < now() - F.expr("interval 10 days"))).join(t.events.where("event_type = 'signup' AND value > 400").select("user_id"), "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("recovered"))
)
query("SELECT count(*) FILTER (json_extract_string(props, '$.file_id') IS NULL) AS legacy FROM events", "agg_legacy_chunks")(lambda t: t.events.agg(F.count_if(F.get_json_object("props", "$.file_id").isNull()).alias("legacy")))
query("SELECT event_id, coalesce(json_extract_string(props, '$.file_id'), regexp_extract(concat('file_', user_id, '_', event_id), 'file_([0-9]+)', 1)) AS file_id FROM events", "index_backfill_metadata")(lambda t: t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.file_id"), F.regexp_extract(F.concat(F.lit("file_"), "user_id", F.lit("_"), "event_id"), "file_([0-9]+)", 1)).alias("file_id")))
query("SELECT doc_id, source FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10", "source_list_meetings")(lambda t: t.documents.where("lang = 'fr'").orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(20).select("doc_id", "source"))
query("SELECT count(*) AS n FROM documents WHERE lang = 'fr'", "source_count_meetings")(lambda t: t.documents.where("lang = 'fr'").agg(F.count("*").alias("n")))
query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 51", "source_memory_export")(lambda t: t.orders.where("o_orderkey > 500").orderBy("o_orderkey").limit(51).select("o_orderkey", "o_totalprice"))
query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 30", "source_sessions")(lambda t: t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns")).orderBy(F.desc("conv_id")).limit(30))
query("SELECT conv_id + 1000000 AS conv_id, turn, role FROM conversations WHERE turn < 3 UNION ALL SELECT conv_id, turn, role FROM conversations", "source_branch_session")(lambda t: t.conversations.where("turn < 3").select((F.col("conv_id") + 1000000).alias("conv_id"), "turn", "role").unionByName(t.conversations.select("conv_id", "turn", "role")))


# Messages.
query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3", "win_history_tail")(lambda t: ranking.top_per(t.conversations, ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn"))
BUDGET = "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn {d}) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn {d}) AS r FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '[a-zA-Z0-9_]+|[^\\x00-\\x7f]|[^\\sa-zA-Z0-9_]')) + 4 AS n FROM conversations)) WHERE r = 1 OR (used <= {b} AND r <= 64)"


def budgeted(t: Tables, newest_first: bool, budget: int) -> DataFrame:
    """Messages whose running token sum fits a budget, at least one and 64 at most."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn") if newest_first else F.asc("turn"))
    rows = t.conversations.withColumn("n", T.token_count(F.col("text")) + 4).withColumn("used", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.row_number().over(w))
    return rows.where(f"r = 1 OR (used <= {int(budget)} AND r <= 64)").select("conv_id", "turn")


for name, newest, budget in (("win_message_budget", True, 120), ("win_checkpoint_batch", False, 150), ("stream_checkpoint_summary", False, 200)):
    query(BUDGET.format(d="DESC" if newest else "ASC", b=budget), name)(lambda t, newest=newest, budget=budget: budgeted(t, newest, budget))


@query("SELECT doc_id, unnest(range(30, n_chars // 10, 30))::DOUBLE AS start FROM documents WHERE n_chars // 10 > 30")
def win_keyframe_segments(t: Tables) -> DataFrame:
    """A key frame every 30 seconds, none at the start or end."""
    long = t.documents.select("doc_id", F.expr("n_chars div 10").alias("d")).where("d > 30")
    return long.select("doc_id", F.explode(F.expr("sequence(30L, d - 1, 30L)")).alias("s")).select("doc_id", F.col("s").cast("double").alias("start"))


TIMELINE = "SELECT role, string_agg(concat('[', strftime(to_timestamp(conv_id * 60 + turn), '%H:%M:%S'), '] ', role, ': ', text), chr(10) ORDER BY conv_id, turn) AS lines, max(total) - count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS r, count(*) OVER (PARTITION BY role) AS total FROM conversations) WHERE r <= {k} GROUP BY role"


def timeline(t: Tables, k: int) -> DataFrame:
    """The first utterances of each speaker, and how many more there are; only those k meet."""
    first = ranking.top_per(t.conversations, ["role"], [F.asc("conv_id"), F.asc("turn")], k)
    line = F.concat(F.lit("["), T.hms(F.col("conv_id") * 60 + F.col("turn")), F.lit("] "), "role", F.lit(": "), "text")
    rendered = first.groupBy("role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"), F.count("*").alias("n"))
    return rendered.join(t.conversations.groupBy("role").agg(F.count("*").alias("total")), "role").select("role", "lines", (F.col("total") - F.col("n")).alias("more"))


query(TIMELINE.format(k=80), "win_speaker_timeline")(lambda t: timeline(t, 80))
query(TIMELINE.format(k=10), "project_speaker_context")(lambda t: timeline(t, 10))
query("SELECT source, string_agg(concat('[', n, '] ', doc_id), chr(10) ORDER BY n) AS section FROM (SELECT source, doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 60)) GROUP BY source", "project_group_render")(
    lambda t: ranking.top(t.documents.select("source", "doc_id"), [F.asc("doc_id")], 60).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["doc_id"].cast("string"))), "\n").alias("section"))
)
query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END DESC, doc_id DESC) = 1", "win_file_hash_dedup")(lambda t: ranking.latest(t.documents.withColumn("h", F.sha2("text", 256)), ["source", "h"], [F.when(F.col("lang") == "en", 2).when(F.col("lang") == "fr", 1).otherwise(0).desc(), F.desc("doc_id")]).select("doc_id"))
RANKED = "SELECT user_id AS k, row_number() OVER (ORDER BY {} DESC, user_id) AS r FROM events GROUP BY user_id QUALIFY r <= 30"
query(f"SELECT k, round(score / max(score) OVER (), 6) AS score FROM (SELECT k, sum(1.0 / (60 + r)) AS score FROM (({RANKED.format('max(value)')}) UNION ALL ({RANKED.format('count(*)')})) GROUP BY k) ORDER BY round(score, 12) DESC, k LIMIT 20", "win_session_best_rank")(lambda t: sessions(t))


def sessions(t: Tables) -> DataFrame:
    by = t.events.groupBy(F.col("user_id").alias("k")).agg(F.max("value").alias("best"), F.count("*").alias("n"))
    fused = ranking.rank_union([ranking.top(by, [F.desc(c), F.asc("k")], 30) for c in ("best", "n")], "k")
    return ranking.top(fused, [F.round("score", 12).desc(), F.asc("k")], 20).select("k", F.round(F.col("score") / F.max("score").over(Window.partitionBy()), 6).alias("score"))


query("SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY value DESC, ts, event_id LIMIT 1", "topk_claim_job")(lambda t: t.events.where("event_type = 'signup'").orderBy(F.desc("value"), "ts", "event_id").limit(1).select("event_id"))
query(f"SELECT event_id FROM {E} WHERE NOT (status IN ('completed', 'failed') AND ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY)", "job_cleanup")(lambda t: ev(t).where(~(F.col("status").isin("completed", "failed") & (F.col("ts") < now() - F.expr("interval 7 days")))).select("event_id"))
query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY", "audit_cleanup")(lambda t: t.events.where(F.col("ts") >= now() - F.expr("interval 14 days")).select("event_id"))
query("SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL", "idem_keys")(lambda t: t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first")))
query("SELECT user_id, event_type, count(*) AS coalesced, arg_max(value, (ts, event_id)) AS payload, max(value) AS priority FROM events GROUP BY ALL", "job_enqueue")(lambda t: t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("coalesced"), F.max_by("value", F.struct("ts", "event_id")).alias("payload"), F.max("value").alias("priority")))
query("SELECT user_id, count(*) AS attempts, CASE WHEN count(*) >= 3 THEN 'dead' ELSE 'queued' END AS state, least(300, pow(2, count(*) - 1))::BIGINT AS delay FROM events WHERE event_type = 'error' GROUP BY user_id", "job_fail_retry")(lambda t: t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts")).select("user_id", "attempts", F.when(F.col("attempts") >= 3, "dead").otherwise("queued").alias("state"), F.least(F.lit(300.0), F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("bigint").alias("delay")))

# Event time.
query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events", "stream_run_journal")(lambda t: t.events.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("seq")))
RUNS = "(SELECT *, sum(CASE WHEN event_type IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))"
query(f"SELECT user_id, run::BIGINT AS run, min(event_type) AS kind, count(*) AS n FROM {RUNS} GROUP BY user_id, run", "stream_ordered_sequence")(lambda t: history.runs(t.events, "user_id", ["ts", "event_id"], "event_type").groupBy("user_id", "run").agg(F.min("event_type").alias("kind"), F.count("*").alias("n")))
ISLANDS = "(SELECT *, sum(CASE WHEN p IS NULL OR floor(epoch(ts)) - floor(epoch(p)) > {g} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))"
query(f"SELECT user_id, session::BIGINT AS session, count(*) AS n, floor(min(epoch(ts)))::BIGINT AS first FROM {ISLANDS.format(g=1800)} GROUP BY user_id, session", "stream_anchor_ttl")(lambda t: history.islands(t.events, "user_id", "ts", "event_id", 1800).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min(seconds("ts")).alias("first")))
query(f"SELECT user_id, session::BIGINT AS session, count(*) AS n FROM {ISLANDS.format(g=86400)} GROUP BY user_id, session HAVING count(*) >= 2 AND max(ts) < TIMESTAMP '{NOW}' - INTERVAL 1 DAY", "stream_idle_sessions")(lambda t: history.islands(t.events, "user_id", "ts", "event_id", 86400).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.max("ts").alias("last")).where((F.col("n") >= 2) & (F.col("last") < now() - F.expr("interval 1 day"))).drop("last"))
query("SELECT user_id, floor(max(epoch(ts)))::BIGINT AS touched, count(*) AS n FROM events GROUP BY user_id", "stream_touch_batching")(lambda t: t.events.groupBy("user_id").agg(F.max(seconds("ts")).alias("touched"), F.count("*").alias("n")))
query("SELECT event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS newest FROM events) WHERE value >= newest", "stream_late_source_fence")(lambda t: t.events.withColumn("newest", F.max("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))).where("value >= newest").select("event_id"))
query(f"SELECT event_id, 'queued' AS state FROM {E} WHERE status = 'running' AND ts + INTERVAL 5 MINUTE <= TIMESTAMP '{NOW}'", "stream_lease_expiry")(lambda t: ev(t).where((F.col("status") == "running") & (F.col("ts") + F.expr("interval 5 minutes") <= now())).select("event_id", F.lit("queued").alias("state")))
query(None, "stream_circuit_breaker")(lambda t: S.breaker(t.events, "user_id"))
query(None, "stream_rate_limit")(lambda t: S.token_bucket(t.events, "user_id", rate=1 / 3600, burst=3))

# The same by keyed state with timers: a stream over the table, of which all that the last watermark has passed comes out.
PASSED = "(SELECT *, epoch_us(ts) AS us, epoch_us(max(ts) OVER ()) // 1000 * 1000 AS passed FROM events)"
LIVE = f"(SELECT * FROM {PASSED} WHERE us <= passed)"


def live(t: Tables, machine: keyed.Machine) -> DataFrame:
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    return keyed.drained(t.spark, f"{t.sf_dir}/events.parquet", folder, "user_id", machine)


@query(f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM {LIVE}")
def stream_run_journal_state(t: Tables) -> DataFrame:
    """Each run's events numbered in order of their time, as state keeps the number."""
    return live(t, keyed.Journal())


@query(f"""
WITH e AS (SELECT *, lead(us) OVER w AS next, count(*) FILTER (event_type = 'purchase') OVER w AS completed FROM {LIVE} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
x AS (SELECT user_id, us + 6 * 3600000000 AS until, row_number() OVER (PARTITION BY user_id, completed ORDER BY us, event_id) AS k FROM e
  WHERE event_type <> 'purchase' AND (next IS NULL OR next > us + 6 * 3600000000) AND us + 6 * 3600000000 <= passed)
SELECT user_id, until // 1000000 AS expired, CASE WHEN k % 3 = 0 THEN 'dead_letter' ELSE 'queued' END AS state, ((k - 1) % 3 + 1)::INT AS attempts FROM x""")
def stream_lease_expiry_timers(t: Tables) -> DataFrame:
    """Leases of six hours that ran out, and what became of their jobs."""
    out = live(t, keyed.Leases(6 * 3600))
    return out.select("user_id", F.unix_seconds("expired").alias("expired"), "state", "attempts")


@query(f"""
WITH e AS (SELECT *, CASE WHEN p IS NULL OR us // 1000000 - p // 1000000 > 21600 THEN 1 ELSE 0 END AS new FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p FROM {LIVE})),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM e)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(us) // 1000000 AS first FROM s GROUP BY user_id, session HAVING (max(us) // 1000000 + 21601) * 1000000 - 1 <= max(passed)""")
def stream_anchor_ttl_timers(t: Tables) -> DataFrame:
    """Anchors that six hours without a touch have ended."""
    return live(t, keyed.Anchors(21600))


# Filters whose constraints come from a question.
query("SELECT conv_id, turn FROM conversations WHERE role IN ('user') AND turn <= 2", "filter_in_extract")(lambda t: t.conversations.where(F.col("role").isin("user") & (F.col("turn") <= 2)).select("conv_id", "turn"))
query("SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 2 = 0 THEN list_has_any([lower(source), lower(lang)], ['src1', 'fr']) ELSE regexp_matches(lower(text), '(^|[^a-z0-9])(src1|fr)([^a-z0-9]|$)') END", "filter_speaker")(
    lambda t: t.documents.where(F.when(F.col("doc_id") % 2 == 0, F.arrays_overlap(F.array(F.lower("source"), F.lower("lang")), F.array(F.lit("src1"), F.lit("fr")))).otherwise(F.lower("text").rlike("(^|[^a-z0-9])(src1|fr)([^a-z0-9]|$)"))).select("doc_id")
)
query("SELECT event_id, (CASE WHEN least(a + 10, 300) - greatest(a, 200) > 5 THEN 0.1 ELSE 0 END)::DOUBLE AS boost FROM (SELECT event_id, floor(value) AS a FROM events) WHERE a < 300 AND a + 10 > 200", "filter_temporal")(
    lambda t: t.events.select("event_id", F.floor("value").alias("a")).where("a < 300 AND a + 10 > 200").select("event_id", F.when(F.least(F.col("a") + 10, F.lit(300)) - F.greatest("a", F.lit(200)) > 5, 0.1).otherwise(0.0).alias("boost"))
)
query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderstatus NOT IN ('F') AND o_orderdate < TIMESTAMP '1996-01-01'", "filter_action_constraints")(lambda t: t.orders.where(F.col("o_orderstatus").isin("O", "P") & ~F.col("o_orderstatus").isin("F") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey"))
query("SELECT o_orderkey FROM orders o WHERE o_orderpriority LIKE '5%' OR (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N'))", "filter_reference_memory")(
    lambda t: t.orders.select("o_orderkey", "o_orderpriority").join(t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_returnflag") == "N").alias("knowledge")), "o_orderkey", "left").where("o_orderpriority LIKE '5%' OR coalesce(knowledge, false)").select("o_orderkey")
)
query("SELECT conv_id, turn FROM conversations WHERE len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 3)), ['that', 'with', 'this', 'from', 'which'])) >= 2", "filter_web_overlap")(lambda t: t.conversations.where(F.size(F.array_intersect(F.array_distinct(F.filter(T.words(F.col("text")), lambda x: F.length(x) > 3)), F.array(*map(F.lit, ("that", "with", "this", "from", "which"))))) >= 2).select("conv_id", "turn"))
query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 2", "date_meeting_time_anchor")(lambda t: t.orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(2).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))
query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(list|all|every)\\b') THEN 12 WHEN length(text) < 40 THEN 3 ELSE 8 END AS k FROM conversations", "topk_adaptive_k")(lambda t: t.conversations.select("conv_id", "turn", F.when(F.lower("text").rlike(r"\b(list|all|every)\b"), 12).when(F.length("text") < 40, 3).otherwise(8).alias("k")))
query("SELECT source, least(greatest(floor(8 * log10(greatest(count(*), 10))), 8), 64)::BIGINT AS k FROM documents GROUP BY source", "topk_wide_k")(lambda t: t.documents.groupBy("source").agg(F.count("*").alias("n")).select("source", F.least(F.greatest(F.floor(8 * F.log10(F.greatest("n", F.lit(10)))), F.lit(8)), F.lit(64)).cast("bigint").alias("k")))


@query(r"""WITH l AS (SELECT doc_id, source, unnest([string_split(text, chr(10))[1], string_split(text, chr(10))[-1]]) AS line FROM documents), k AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), '[0-9]+', '#', 'g'), '[^\p{L}\p{N}# ]', '', 'g')) AS line_key FROM l)
 SELECT source, line_key, count(DISTINCT doc_id) AS pages FROM k WHERE length(line_key) > 0 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3""")
def win_header_footer_repetition(t: Tables) -> DataFrame:
    """Edge lines that repeat on three pages and more, here first and last lines of a source's documents."""
    parts = F.split("text", "\n")
    edge = t.documents.select("doc_id", "source", F.explode(F.array(F.element_at(parts, 1), F.element_at(parts, -1))).alias("line"))
    keys = edge.select("doc_id", "source", T.line_key(F.col("line"), True).alias("line_key")).where("length(line_key) > 0")
    return keys.groupBy("source", "line_key").agg(F.countDistinct("doc_id").alias("pages")).where("pages >= 3")


query("SELECT source, bool_and(n_chars > 100) AND count(DISTINCT lang) = 1 AS passed FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3) GROUP BY source", "str_fast_evidence_gate")(lambda t: ranking.top_per(t.documents.select("source", "n_chars", "doc_id", "lang"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3).groupBy("source").agg((F.bool_and(F.col("n_chars") > 100) & (F.countDistinct("lang") == 1)).alias("passed")))
query("SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 0.9 WHEN o_totalprice > 100000 THEN 0.6 END AS confidence FROM orders", "math_web_confidence")(lambda t: t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 400000, 0.9).when(F.col("o_totalprice") > 100000, 0.6).alias("confidence")))
query("SELECT lang, string_agg(concat('| ', source, ' | ', n, ' |'), chr(10) ORDER BY source) AS md FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang", "scan_table_markdown")(lambda t: t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")).groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: F.concat(F.lit("| "), x["source"], F.lit(" | "), x["n"].cast("string"), F.lit(" |"))), "\n").alias("md")))
query("SELECT doc_id FROM documents WHERE NOT (source = 'src3' AND doc_id % 2 = 0)", "sink_delete_scope")(lambda t: t.documents.select("doc_id").join(t.documents.where("source = 'src3' AND doc_id % 2 = 0").select("doc_id"), "doc_id", "left_anti"))
