"""An index as a whole: published as one generation, read as of its last commit; see ``generations`` for how."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import generations
from .store import shared_folder

__all__ = ["current", "publish", "replaced", "shared_folder", "upserted"]


def current(spark: SparkSession, root: str) -> DataFrame | None:
    rows = generations.read(spark, root)
    return None if rows is None else rows.drop("generation", "_whole")


def publish(rows: DataFrame, root: str, key: str = "chunk_id", expected: int | None = None, **checks) -> int:
    """Replace the whole index and return the number of the commit. Readers see the old one until then, and a failure at any
    point leaves it as it was. A publisher whose rows were made from number ``expected`` fails if another came first."""
    return generations.write(rows.withColumn("_whole", F.lit(True)), root, ["_whole"], key, base=True, expected=expected, **checks)


def replaced(index: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """The index with all rows of the files in ``rows`` replaced by these."""
    return index.join(rows.select(*by).distinct(), by, "left_anti").unionByName(rows)


def upserted(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    both = index.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new")))).where("_r = 1").drop("_new", "_r")
