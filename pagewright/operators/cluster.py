"""Connected components of an edge table, and labels for clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component) for each node of the undirected edges; component is its smallest node.

    Each round gives a node the smallest grandparent among its neighbours,
    hooks its parent below that too, and jumps to its own grandparent, so that
    a path of n nodes takes about log n rounds. A round is three equi joins and
    partial minima and is written to the shared folder; the driver only sees
    whether a parent changed. Edges with a null end are ignored; a self loop
    makes a component of one node.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    both = stored(both.union(both.select("v", "u")).distinct(), "edges")
    parents = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("f")), "parents")
    for _ in range(max_rounds):
        up = parents.select(F.col("node").alias("f"), F.col("f").alias("gf"))
        known = stored(parents.join(up, "f").select("node", "f", "gf"), "grandparents")
        near = both.join(known.select(F.col("node").alias("v"), "gf"), "v").groupBy("u").agg(F.min("gf").alias("m"))
        found = known.join(near.withColumnRenamed("u", "node"), "node")
        offers = found.select(F.explode(F.array(F.struct("node", F.least("m", "f", "gf").alias("f")), F.struct(F.col("f").alias("node"), F.col("m").alias("f")))).alias("x")).select("x.*")
        new = stored(offers.groupBy("node").agg(F.min("f").alias("f")), "parents")
        changed = new.join(known, "node").where((new.f != known.f) | (known.f != known.gf)).limit(1).count()
        dropped(parents)
        dropped(known)
        parents = new
        if not changed:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    dropped(both)
    return parents.select("node", F.col("f").alias("component"))


def cluster_labels(items: DataFrame, captions: DataFrame) -> DataFrame:
    """id, component, caption: the caption (path, caption) of the smallest path of a component goes to all its items (id, path, component)."""
    given = items.join(captions, "path").groupBy("component").agg(F.min_by("caption", "path").alias("caption"))
    return items.join(given, "component", "left").select("id", "component", "caption")
