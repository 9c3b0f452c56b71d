"""Connected components of a table of links, by alternating large-star and small-star steps on DataFrames.

Nothing is collected: the driver sees one row an iteration. It ends when each linked id has one link, to an id that has none of its own. Minima are pre-aggregated in the tasks; the
minima of hubs, vertices with more than HUB links, are broadcast to their links, so those are no single group and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import dropped, saved

#: Links above which a vertex is a hub, and parts into which those of a hub are dealt.
HUB, SALTS = 1000, 32


def salted(rows: DataFrame, facts: DataFrame, key: str = "u", own: tuple[str, ...] = ("v",)) -> DataFrame:
    """``rows`` joined by ``key`` with ``facts`` (one row a key), whose column n is at least the number of rows of the key.

    Rows of a key with more than HUB are dealt by the columns ``own``. Hubs are a HUB-th of all n at most, and are broadcast.
    """
    hubs = F.broadcast(facts.where(F.col("n") > HUB).select(key, F.lit(True).alias("hub")))
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(hubs, key, "left").withColumn("salt", salt).drop("hub")
    parts = F.when(F.col("n") > HUB, SALTS).otherwise(1)
    return dealt.join(facts.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n"), [key, "salt"])


def _told(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` (u, v) with the m of u that ``facts`` (u, m, n) has. A hub's rows stay where they are; hubs are a HUB-th of all n at most, and are broadcast."""
    hubs = F.broadcast(facts.where(F.col("n") > HUB).select("u", "m"))
    others = rows.join(hubs, "u", "left_anti").join(facts.where(F.col("n") <= HUB).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _told(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _told(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each u of ``edges`` (u > v, each once) has one v, which is no u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 0 AND down + up > 1").isEmpty()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. Ids without a link have no row.

    ``links`` has two id columns; order, repeats, self links and nulls do not matter. An empty table gives an empty one.
    """
    pairs = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    edges = saved(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(edges):
        large = saved(_large(edges), "large")  # read three times
        dropped(edges)
        edges = saved(_small(large), "stars")
        dropped(large)
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
