"""Rows of an index from the pages of parsed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) > 0


def page_chunks(pages: DataFrame, file: str, budget: int, least: int = 15) -> DataFrame:
    """file, page, chunk_index, content_type and content for pages of (file, page, text, tables, images).

    A page gives its text, cut after each ``budget`` words if it has more, then its tables, then its images: caption and recognised
    text together, or the one that is there; recognised text under ``least`` characters doesn't count. ``chunk_index`` runs
    from 0 through the file. Blank text, null lists and images with neither give nothing.
    """
    pages = pages.select(file, "page", "text", "tables", "images", F.split(F.trim("text"), r"\s+").alias("_words"))  # once for all chunks
    words = F.col("_words")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / budget).cast("int")), lambda i: F.array_join(F.slice(words, i * budget + 1, F.lit(budget)), " "))
    texts = F.when(~filled(F.col("text")), F.array().cast("array<string>")).when(F.size(words) <= budget, F.array("text")).otherwise(parts)

    def chunk(kind: Column | str, content: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("content_type"), content.alias("content"))

    def of_image(x: Column) -> Column:
        named, read = filled(x["caption"]), F.length(F.coalesce(x["ocr"], F.lit(""))) >= least
        both = F.concat(F.lit("[Caption] "), x["caption"], F.lit("\n[OCR] "), x["ocr"])
        kind = F.when(named & read, "image_combined").when(named, "image_caption").when(read, "image_ocr")
        return chunk(kind, F.when(named & read, both).when(named, x["caption"]).when(read, x["ocr"]))

    none = F.array().cast("array<struct<content_type: string, content: string>>")
    tables = F.transform(F.filter("tables", filled), lambda x: chunk("table", x))
    images = F.filter(F.transform("images", of_image), lambda x: x["content_type"].isNotNull())
    all_of = F.concat(F.transform(texts, lambda x: chunk("text", x)), F.coalesce(tables, none), F.coalesce(images, none))
    rows = pages.select(file, "page", F.posexplode(all_of).alias("_n", "_x"))
    order = Window.partitionBy(file).orderBy("page", "_n")
    return rows.select(file, "page", (F.row_number().over(order) - 1).alias("chunk_index"), "_x.content_type", "_x.content")
