"""Files of many kinds as rows of pages, read through Spark's binaryFile source so that any store it reads will do."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import pretty_json, visible_text

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb2312", "latin-1")
PAGES = "path string, page int, text string"
W, A, S = (f"{{http://schemas.openxmlformats.org/{x}}}" for x in ("wordprocessingml/2006/main", "drawingml/2006/main", "spreadsheetml/2006/main"))


def decoded(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


def csv_text(text: str) -> str:
    return "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(text)))


def rtf_text(text: str) -> str:
    """Control words and braces go; escaped characters and paragraph marks stay as what they stand for."""
    t = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    t = re.sub(r"\\par[d]?\b ?", "\n", t)
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("latin-1"), t)
    t = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), t)
    t = re.sub(r"\\[a-zA-Z]+-?\d* ?", "", t)
    return re.sub(r"[{}]", "", t).strip()


def docx_pages(data: bytes) -> list[str]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{W}t")).strip() for p in root.iter(f"{W}p"))
    return ["\n\n".join(x for x in lines if x)]


def numbered(names: list[str], pattern: str) -> list[str]:
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.fullmatch(pattern, n)[1]))


def pptx_pages(data: bytes) -> list[str]:
    """A page for each slide: text of shapes, rows of tables, then notes."""
    archive, out = zipfile.ZipFile(io.BytesIO(data)), []
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{A}t"))
    for name in numbered(archive.namelist(), r"ppt/slides/slide(\d+)\.xml"):
        root = ElementTree.fromstring(archive.read(name))
        tables = [*root.iter(f"{A}tbl")]
        inside = {id(p) for t in tables for p in t.iter(f"{A}p")}
        lines = [words(p).strip() for p in root.iter(f"{A}p") if id(p) not in inside]
        for t in tables:
            lines += ["[TABLE]", *(" | ".join(words(c).strip() for c in r.iter(f"{A}tc")) for r in t.iter(f"{A}tr"))]
        notes = name.replace("slides/slide", "notesSlides/notesSlide")
        if notes in archive.namelist():
            lines.append(f"[NOTES] {' '.join(words(ElementTree.fromstring(archive.read(notes))).split())}")
        out.append("\n".join(x for x in lines if x))
    return out


def xlsx_pages(data: bytes) -> list[str]:
    """One page: each sheet that isn't empty under its title, rows without any value left out."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{S}si")] if "xl/sharedStrings.xml" in archive.namelist() else []
    titles = [s.get("name") for s in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{S}sheet")]
    out = []
    for title, name in zip(titles, numbered(archive.namelist(), r"xl/worksheets/sheet(\d+)\.xml")):
        rows = []
        for r in ElementTree.fromstring(archive.read(name)).iter(f"{S}row"):
            cells = []
            for c in r.iter(f"{S}c"):
                v = c.findtext(f"{S}v")
                cells.append(shared[int(v)] if c.get("t") == "s" and v else v or "".join(t.text or "" for t in c.iter(f"{S}t")))
            if any(x.strip() for x in cells):
                rows.append(" | ".join(cells))
        if rows:
            out.append("\n".join([f"[Sheet: {title}]", *rows]))
    return ["\n\n".join(out)]


def pdf_pages(data: bytes) -> list[str]:
    """Text of each page by an installed PDF library; without one, a clear error."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the pypdf package") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


PARSERS: dict[str, Callable[[bytes], list[str]]] = {
    "csv": lambda d: [csv_text(decoded(d))],
    "html": lambda d: [visible_text(decoded(d))],
    "htm": lambda d: [visible_text(decoded(d))],
    "json": lambda d: [pretty_json(decoded(d))],
    "rtf": lambda d: [rtf_text(decoded(d))],
    "docx": docx_pages,
    "pptx": pptx_pages,
    "xlsx": xlsx_pages,
    "pdf": pdf_pages,
}


def parsed(data: bytes, kind: str, parsers: dict[str, Callable[[bytes], list[str]]] = PARSERS) -> list[str]:
    return parsers.get(kind, lambda d: [decoded(d)])(data)


def cascade(data: bytes, kind: str, providers: list[Callable[[bytes, str], list[str]]], accept: Callable[[list[str]], bool]) -> list[str]:
    """The pages of the first provider whose result passes the gate; if none does, an error that names each failure. An empty
    file has one empty page, which passes any gate, as there is no text that the provider could have missed."""
    failures = []
    for provider in providers:
        try:
            pages = provider(data, kind)
        except Exception as e:  # a provider may fail in any way; the next one is tried
            failures.append(f"{getattr(provider, '__name__', 'provider')}: {e}")
            continue
        if accept(pages) or (not data and pages == [""]):
            return pages
        failures.append(f"{getattr(provider, '__name__', 'provider')}: rejected")
    raise ValueError("; ".join(failures) or "no provider")


def pages(spark: SparkSession, path: str, providers: list[Callable[[bytes, str], list[str]]] | None = None, accept: Callable[[list[str]], bool] = lambda p: any(x.strip() for x in p)) -> DataFrame:
    """path, page and text of all files under ``path``; injected providers stand for OCR or remote services. A file that
    nobody can read has one row with page 0 and null text."""
    own = providers or [parsed]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, data in zip(files["path"], files["content"]):
                kind = name.rpartition(".")[2].lower()
                try:
                    found = [(name, i + 1, x) for i, x in enumerate(cascade(bytes(data), kind, own, accept))]
                except ValueError:
                    found = [(name, 0, None)]
                yield pd.DataFrame(found, columns=["path", "page", "text"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(work, PAGES)


def segments(words: DataFrame, key: str) -> DataFrame:
    """Words (start_ms, end_ms, text, speaker) merged while the speaker stays: start, end, text, speaker, by number."""
    from ..operators.history import runs

    run = runs(words, key, ["start_ms", "end_ms"], "speaker")
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text")))
    return run.groupBy(key, "run").agg(F.round(F.min("start_ms") / 1000, 2).alias("start"), F.round(F.max("end_ms") / 1000, 2).alias("end"), F.min("speaker").alias("speaker"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def visible(html: Column) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(visible_text)

    return f(html)
