"""Documents written as text files, a folder for each group, in order within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(rows: DataFrame, folder: str, by: list[str], order: list[str], form: Column) -> DataFrame:
    """Write ``form`` of each row below ``folder`` and return it as read back: the columns ``by`` and value, a row's whole text.

    Rows are dealt by ranges of group and order, so a large group is several files whose names are in its order; no group is
    one string or one task. A text file ends a row at a zero byte, which texts don't hold.
    """
    placed = rows.select(*by, *order, form.alias("value")).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed.select(*by, "value").write.partitionBy(*by).option("lineSep", "\0").text(folder)
    schema = ", ".join(["value string", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)])
    return rows.sparkSession.read.schema(schema).option("lineSep", "\0").text(folder).select(*by, F.col("value"))
