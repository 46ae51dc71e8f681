"""Connected components of a link table, without a driver-side union-find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .work import Workspace

#: Links whose nodes' minima are broadcast at most.
FEW_LINKS = 50_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mins(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours b."""
    return edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame, meet: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every node's greater neighbours go to its least neighbour.  edges: a > b."""
    joined = _both(edges).join(meet(_mins(_both(edges))), F.col("a") == F.col("u"))
    return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, meet: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every node and its lesser neighbours go to the least of them.  edges: a > b."""
    mins = meet(_mins(edges))
    moved = edges.join(mins, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = mins.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.union(own).filter("a <> b").distinct()


def connected_components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) of every node of links(a, b); component is its least node.

    Large-star and small-star rounds in turn until the links are stars; each
    round's links are written to the shared folder.  The number of links never
    grows, so neither does a round's cost.  A node's minimum is summed in the map
    tasks and meets its links apart from that, so that the links of one centre
    can be split among tasks.  Null ends and loops are ignored; no links give no
    rows.
    """
    edges = work.keep(links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        held = [edges]

        def meet(mins: DataFrame) -> DataFrame:
            if before[0] <= FEW_LINKS:
                return F.broadcast(mins)
            held.append(work.keep(mins, "minima"))
            return held[-1]

        star = _large_star(edges, meet)
        if before[0] > FEW_LINKS:
            star = work.keep(star, "links")
            held.append(star)
        edges = work.keep(_small_star(star, meet), "links")
        work.drop(*held)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = work.keep(nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    work.drop(edges)
    return out
