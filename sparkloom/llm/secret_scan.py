"""Secrets in texts, with multipart credentials linked.

Three base kinds stand alone: values assigned to secret-like names, access identifiers, and long hexadecimal
strings. Two weak kinds are common in clean text and are reported only where complementary parts meet in one scope:

* an endpoint with an access identifier or an assigned secret;
* an opaque string with an access identifier, or with both an assigned secret and an endpoint.

A hexadecimal string links nothing, as hashes of commits and files stand beside addresses in clean text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, with_text

# Fixed patterns of the base kinds; letters of names in either case.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is what [0-9a-f]+ finds there

NAMES = ("passw", "secret", "token", "api")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}")
# A digit and a capital within the string itself, so each string is looked at three times at most.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "opaque", "endpoint")
BASE = KINDS[:3]
#: Code points on either side of a part that its scope takes in; a scope also ends at a blank line, whatever ends its lines.
SCOPE = 300
BREAK = re.compile(r"\n[\x20\t]*\r?\n")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans, and where the values of the assigned ones lie."""
    spans: list[Span] = []
    values = []
    lower = text.lower()
    if (":" in text or "=" in text) and any(x in lower for x in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans, values


class Index:
    """Spans sorted by start, with the furthest end so far: as it never falls, it too can be searched."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.starts = [x[0] for x in self.spans]
        self.reach = list(accumulate((x[2] for x in self.spans), max))

    def overlaps(self, begin: int, end: int) -> bool:
        """Does any span share a character with [begin, end)? The furthest end of those that start before it says so."""
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > begin


def near(index: Index, begin: int, end: int, text: str) -> bool:
    """Interval join for one span: is any span of the index in its scope and paragraph, however long it is?"""
    for start, _, stop in index.spans[bisect_left(index.reach, begin - SCOPE) : bisect_right(index.starts, end + SCOPE)]:
        if stop >= begin - SCOPE and not (stop <= end and start >= begin) and not BREAK.search(text, min(stop, end), max(start, begin)):
            return True
    return False


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts whose complements co-occur: identifiers, secrets and endpoints are joined by their intervals."""
    access, assigned = [x for x in base if x[1] == 1], [x for x in base if x[1] == 0]
    if not access and not assigned:
        return []
    endpoints = [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    if not access and not endpoints:
        return []
    taken = Index(base + endpoints)
    opaque = [(m.start(), 3, m.end()) for m in OPAQUE.finditer(text) if not taken.overlaps(m.start(), m.end())]
    identifiers, secrets, places = Index(access), Index(assigned), Index(endpoints)

    def linked(x: Span) -> bool:
        at = x[0], x[2], text
        if near(identifiers, *at):
            return True
        return near(secrets, *at) and (x[1] == 4 or near(places, *at))

    return [x for x in opaque + endpoints if linked(x)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in sorted(spans))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each document; offsets are code points.

    Null or empty text has no spans. Every row is judged alone, so repeated rows give equal rows.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = []
            for text in part.column("text").to_pylist():
                base, _ = base_spans(text)
                kinds = [x[1] for x in base]
                more = linked_spans(text, base)
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.string() if k in (3, 4) else pa.int64()) for k, x in enumerate(zip(*rows)))], names)

    return map_arrow(with_text(documents), work, schema)


def redacted(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with each secret replaced by ``mark`` and n_chars, if there, as long as the text.

    Of an assigned secret only the value goes, so the name stays readable. Null text stays null.
    """
    names = documents.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = []
            for text in part.column("text").to_pylist():
                if text:
                    base, values = base_spans(text)
                    cuts = values + [(s, e) for s, k, e in [x for x in base if x[1]] + linked_spans(text, base)]
                    kept, at = [], 0
                    for start, end in sorted(cuts):
                        if end > at:
                            kept += [text[at : max(start, at)], mark if start >= at else ""]
                            at = end
                    text = "".join(kept) + text[at:]
                texts.append(text)
            yield part.set_column(names.index("text"), part.schema.field("text"), pa.array(texts, pa.string()))

    out = map_arrow(documents, work, documents.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out
