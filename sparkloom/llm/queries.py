"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, language_id, lm_scoring, media, mixing, near_dedup, packing, permutation_index, quality_outliers, secret_scan, substring_dedup, token_output, vector_codes
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's payload, from blocks of its stored and decoded stream."""
    return media.block_digests(media.stored_blocks(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.classify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op11_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and verdict of every document."""
    out = quality_outliers.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every usable vector, with the error of its label and a digest of the codebooks."""
    codes, codebooks = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(vector_codes.digest(codebooks)))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every document, with digests of the output and of the text that it gives back."""
    out = fill_middle.transform(table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.col("output"), "restored_sha256": fill_middle.restored(F.col("output"), F.col("form"))}
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(F.sha2(x.cast("binary"), 256).alias(k) for k, x in digests.items()), "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_media": op2_media,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_permutation_index": op6_permutation_index,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_output": op8_token_output,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_secret_scan": op10_secret_scan,
    "op11_quality_outliers": op11_quality_outliers,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_middle": op13_fill_middle,
}


def vector_codes_sql(rounds: int = 4) -> str:
    """Each round is two steps: the nearest entry of every part, and the entries moved."""

    def nearest(k: int) -> str:
        return f"""
near{k} AS MATERIALIZED (SELECT id, part, any_value(x) AS x, min({{'far': far, 'entry': entry}}) AS best FROM (
  SELECT id, p.part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM p JOIN book{k} b ON p.part = b.part) GROUP BY id, part)"""

    def moved(k: int) -> str:
        return f"""
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
  SELECT part, entry, list(floor(total / n)::BIGINT ORDER BY i) AS c FROM (
    SELECT part, best.entry AS entry, i, sum(x[i])::DOUBLE AS total, count(*) AS n FROM near{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))"""

    steps = ",".join(f"{nearest(k)},{moved(k)}" for k in range(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM k, (SELECT unnest(range(4)) AS part)),
book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x AS c FROM p WHERE id <= 256),{steps},{nearest(rounds)},
coded AS (SELECT id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM near{rounds} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256 FROM k JOIN coded USING (id)"""


#: The others learn, sample or tokenize, which SQL can't say; tests/llm holds their brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
words AS (SELECT doc_id, j, w[j] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_vector_codes": vector_codes_sql(),
    "op13_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS i, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS j,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT *, array_to_string(u[1:least(i, j)], '') AS prefix, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS middle, array_to_string(u[greatest(i, j) + 1:], '') AS suffix FROM e)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256, length(text)::BIGINT AS n_chars FROM f""",
}
