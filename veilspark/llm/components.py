"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few

#: Rows of one key from which it counts as hot, and how many keys can be hot at most.
LEAST_HOT, MOST_HOT = 100, 2000


def spread(rows: DataFrame, per_key: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows`` joined with ``per_key`` (key, n, more), where n rows have that key; n is dropped.

    Of ``total`` rows no more than ``MOST_HOT`` keys can have over ``total / MOST_HOT``
    each.  Those keys are broadcast, so that their rows stay where they are; the rest
    meets by key.
    """
    key = [key] if isinstance(key, str) else key
    bound = max(LEAST_HOT, total // MOST_HOT)
    hot = F.broadcast(per_key.where(F.col("n") > bound).drop("n"))
    rest = rows.join(hot.select(*key), key, "left_anti").join(per_key.where(F.col("n") <= bound).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge with two ends.

    ``edges`` holds pairs of longs.  Each round is a group-by and a join, materialised
    in the shared folder, in as many partitions as its edges fill; the number of rounds
    grows with the logarithm of the longest path.  Repeated edges and loops do no harm;
    null ends are ignored.  Edges that are not stars after ``rounds`` rounds are an error.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    edges, before = cut(edges), None
    n_edges = edges.count()
    edges = few(edges, n_edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour points to the least of the neighbourhood
        least = _least(both).select("u", F.least("u", "m").alias("m"), "n")
        large = spread(both, least, "u", 2 * n_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(few(few(large, n_edges).distinct(), n_edges))  # read three times
        # small star: every smaller neighbour, and the node, point to the least of them; after the
        # large star a node's smaller neighbours are the least ones of its neighbours, and few
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _least(down)
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(few(few(small, n_edges).distinct(), n_edges))
        n_edges, digest = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n_edges, digest) == before:
            break
        before = (n_edges, digest)
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return few(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), 2 * n_edges)
