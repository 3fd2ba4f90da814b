"""Connected components and the clusters that links of similar rows make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap_coefficient


def persisted(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder of spark.checkpoint.dir; a session without one, as in tests, gets its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-"))
    return df.checkpoint()


def components(nodes: DataFrame, links: DataFrame, rounds: int = 50) -> DataFrame:
    """node and component, the smallest node it is linked to; labels jump to their label's label, so rounds grow with
    the logarithm of the longest path. Labels only fall, so a round that leaves their digest as it was has changed none."""
    both = persisted(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    now, known = persisted(nodes.select("node", F.col("node").alias("component"))), None
    for _ in range(rounds):
        near = both.join(now.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        lower = now.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = lower.join(lower.select(F.col("node").alias("component"), F.col("component").alias("next")), "component").select("node", F.least("component", "next").alias("component"))
        after = persisted(jump)
        state = after.agg(F.sum(F.xxhash64("component").cast("decimal(38,0)")), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()
        if state == known:
            return after
        now, known = after, state
    raise RuntimeError("components didn't settle")


def overlapping(sets: DataFrame, least: float = 0.75) -> DataFrame:
    """u and v, nodes of different token sets of which the smaller has at least that share in the larger.

    ``sets`` has node and s, a list of different tokens. Tokens are ordered from rare to common. Of n tokens of which m must be
    shared, one of the n - m + 1 rarest is, so the smaller set asks for those alone; and a shared token only counts where
    enough tokens follow it in both. A token that all sets hold therefore brings together only sets that have nothing rarer.
    """
    each = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("token"))
    ranked = each.join(each.groupBy("token").agg(F.count("*").alias("often")), "token")
    ordered = ranked.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t"))
    posted = persisted(ordered.select("node", "n", F.posexplode("t").alias("i", "t")).select("node", "n", "i", "t.token"))
    needed = F.ceil(F.col("n") * least - 1e-9).cast("int")
    asks = posted.withColumn("m", needed).where("m > 0 AND i < n - m + 1").select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("i").alias("iu"), "m", "token")
    met = asks.join(posted, "token").where("node <> u AND (nu < n OR (nu = n AND u < node))")
    pairs = met.where("1 + least(nu - iu - 1, n - i - 1) >= m").select("u", F.col("node").alias("v")).distinct()
    both = pairs.join(sets.select(F.col("node").alias("u"), "s"), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("t")), "v")
    return both.where(overlap_coefficient(F.col("s"), F.col("t")) >= least).select("u", "v")


def token_clusters(rows: DataFrame, key: str, tokens: str, least: float = 0.75) -> DataFrame:
    """key and component of rows whose token sets overlap enough. Equal sets are one candidate; a row without tokens stays
    alone."""
    sets = rows.select(key, F.array_sort(F.array_distinct(tokens)).alias("s"))
    heads = persisted(sets.where(F.size("s") > 0).groupBy("s").agg(F.min(key).alias("node")))
    found = components(heads.select("node"), overlapping(heads, least))
    joined = sets.join(heads, "s", "left").join(found, "node", "left")
    return joined.select(key, F.coalesce("component", key).alias("component"))
