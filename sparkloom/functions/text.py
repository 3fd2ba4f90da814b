"""Text functions on columns, all of them inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches define the results.
NUMBER = r"[$€£]?[0-9]+(?:[.,][0-9]+)*%?"
NEGATIONS = ("not", "no", "never", "without", "cannot", "none")
UNCERTAIN = ("if", "unless", "maybe", "perhaps", "might", "could", "will", "said", "says", "plan", "plans")
PAGE_MARKER = r"^(?:page|p\.) ?[0-9]+(?: of [0-9]+)?$|^[0-9]{1,4} ?/ ?[0-9]{1,4}$|^- ?[0-9]{1,4} ?-$|^[0-9]{1,4}$"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]{0,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"
CARD = r"\b[0-9]{13,16}\b"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
DIRECTIVE = r"(?:ignore|disregard) (?:all |the )?(?:previous|above|prior)|system prompt|you must now|act as"
CJK = r"[一-鿿㐀-䶿぀-ヿ가-힯]"


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def content_key(c: Column, length: int = 32) -> Column:
    """Equal for texts that differ in case and white space alone."""
    return F.substring(F.sha2(collapsed(F.lower(c)), 256), 1, length)


def dedup_key(logical_id: Column, chunk_id: Column, content: Column) -> Column:
    return F.coalesce(logical_id, chunk_id, content_key(content))


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct n-grams of the trimmed lower-case text; a shorter text is its own only n-gram."""
    t = F.trim(F.lower(c))
    return F.when(F.length(t) <= n, F.array(t)).otherwise(F.array_distinct(matches(t, f"(?s)(?=(.{{{n}}}))", 1)))


def ngram_size(c: Column) -> Column:
    return F.when(F.length(c) < 100, 3).when(F.length(c) > 1000, 5).otherwise(4)


def overlap_coefficient(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


#: What ``words`` takes for a word, in lower case.
PLAIN_WORD = "[a-z0-9]+"


def words(c: Column) -> Column:
    return matches(F.lower(c), PLAIN_WORD)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return matches(F.lower(c), r"[\p{L}\p{N}_]+")


def prior_tokens(c: Column) -> Column:
    return F.filter(matches(c, "[a-zA-Z0-9一-鿿]+"), lambda x: F.length(x) >= 4)


def fact_markers(c: Column) -> Column:
    """Numbers, then negations, in order of occurrence: texts that differ in them never say the same."""
    return F.concat(matches(c, NUMBER), F.filter(tokens(c), lambda w: w.isin(*NEGATIONS)))


def split_speakers(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,\x1f]"), lambda x: F.trim(x)), lambda x: x != "")


def scrubbed(c: Column) -> Column:
    return collapsed(F.regexp_replace(c, r"\[[Ss]peaker[^\]]*\]", " "))


def line_key(c: Column, mask_numbers: bool = False) -> Column:
    """A line as it repeats from page to page: lower case, single spaces, no punctuation, digits masked if asked for."""
    t = collapsed(F.lower(c))
    t = F.regexp_replace(t, "[0-9]+", "#") if mask_numbers else t
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}# ]", ""))


def is_page_marker(c: Column) -> Column:
    return F.trim(F.lower(c)).rlike(PAGE_MARKER)


def alpha_ratio(c: Column) -> Column:
    n = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when(n > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / n).otherwise(0.0)


def is_low_information(c: Column) -> Column:
    """Page markers, or few letters and fewer than five words of three letters and more."""
    long_words = F.size(F.filter(words(c), lambda w: F.length(w) > 2))
    return is_page_marker(c) | ((alpha_ratio(c) < 0.30) & (long_words < 5))


def is_boilerplate(c: Column) -> Column:
    """No letters or digits, one token again and again, or one token at most in under 20 characters."""
    t = tokens(c)
    return (F.size(t) == 0) | ((F.size(F.array_distinct(t)) == 1) & (F.size(t) > 2)) | ((F.size(t) <= 1) & (F.length(c) < 20))


def key_points(c: Column, limit: int = 10, least: int = 12) -> Column:
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ ]*(?:[-*•]|[0-9]+[.)])[ ]*", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x) >= least), 1, limit)


def sanitized(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"[\x00-\x08\x0b-\x1f\x7f]", "")


def assertion_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def clauses(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?;\n]+|, but | however "), lambda x: F.trim(x)), lambda x: x != "")


def is_current_assertion(c: Column) -> Column:
    """Not a question, condition, report, guess, plan or negation."""
    t = tokens(c)
    return ~(c.rlike(r"\?\s*$") | F.arrays_overlap(t, F.array(*map(F.lit, (*UNCERTAIN, *NEGATIONS)))))


def without_citations(c: Column) -> Column:
    return F.regexp_replace(c, r" ?\[[0-9]+\]", "")


def redacted(c: Column) -> Column:
    for pattern, mark in ((EMAIL, "[email]"), (PHONE, "[phone]"), (IPV4, "[ip]"), (CARD, "[card]")):
        c = F.regexp_replace(c, pattern, mark)
    return c


def looks_like_pii(c: Column) -> Column:
    return c.rlike(EMAIL) | c.rlike(PHONE) | c.rlike(CARD) | c.rlike(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")


def has_directive(c: Column) -> Column:
    return F.lower(c).rlike(DIRECTIVE)


def snippet(c: Column, needle: str, around: int = 100) -> Column:
    """Text around the first hit in either case with dots where it is cut, else the first characters."""
    at, size = F.locate(needle.lower(), F.lower(c)), F.lit(len(needle))
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + size + around - 1, F.length(c))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(c, start, end - start + 1), F.when(end < F.length(c), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substr(c, F.lit(1), F.lit(2 * around)))


def token_count(c: Column) -> Column:
    """Words, with each CJK character one: what budgets are counted in where no vocabulary is given."""
    return F.size(matches(c, r"[a-zA-Z0-9_]+|[^\x00-\x7f]|[^\sa-zA-Z0-9_]"))


def fts_terms(c: Column, least: int = 3) -> Column:
    """Distinct 3-grams of CJK runs and Latin words of three letters and more."""
    grams = F.concat(matches(c, f"(?=({CJK}{{3}}))", 1), F.filter(matches(c, f"{CJK}+"), lambda r: F.length(r) < 3))
    return F.array_distinct(F.concat(grams, F.filter(words(c), lambda w: F.length(w) >= least)))


def cjk_grams(c: Column) -> Column:
    """At each character the three CJK characters that begin there, empty where they don't; so places in the list are
    places in the text, counted in UTF-16 units."""
    return matches(F.lower(c), f"(?=({CJK}{{3}})?)", 1)


def cjk_terms(query: str) -> list[str]:
    """The different 3-grams of a query's CJK runs, in order; shorter runs have none."""
    runs = re.findall(f"{CJK}+", query.lower())
    return list(dict.fromkeys(run[i : i + 3] for run in runs for i in range(len(run) - 2)))


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def yyyymmdd(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd").cast("int")


def id_list(c: Column) -> Column:
    """Distinct whole numbers of a comma-separated list; what isn't a number is skipped."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull()))


def keyword_score(c: Column, required: list[str], optional: list[str], excluded: list[str], pattern: str | None) -> Column:
    """Weighted share of the configured dimensions; 0 without a required or with an excluded word."""
    t = F.lower(c)
    has = lambda w: t.contains(w)
    parts: list[tuple[float, Column]] = []
    if required:
        parts.append((0.4, F.lit(1.0)))
    if optional:
        parts.append((0.4, sum((has(w).cast("double") for w in optional), F.lit(0.0)) / len(optional)))
    if pattern:
        parts.append((0.2, t.rlike(pattern).cast("double")))
    score = sum((w * s for w, s in parts), F.lit(0.0)) / sum(w for w, _ in parts)
    ok = F.lit(True)
    for w in required:
        ok = ok & has(w)
    for w in excluded:
        ok = ok & ~has(w)
    return F.when(ok, score).otherwise(0.0)
