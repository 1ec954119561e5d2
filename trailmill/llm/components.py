"""Connected components by min-label contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.session import cut, discard


#: Rows of one file, about: small tables of links are not spread over many tasks.
FILE_ROWS = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` links -> ``(id, component)`` for every linked vertex.

    `component` is the smallest id reachable.  Each round points every vertex at its
    smallest neighbour, follows the pointers to their roots, and contracts the links to
    the roots; every vertex that is not a local minimum disappears, so rounds are
    logarithmic.  Loops, repeated links and null ends are ignored; no links give no rows.
    A hub is aggregated with map-side partial minima, and the join back to it is one that
    Spark can split.
    """
    edges = cut(edges, "edges")
    files = 1 + edges.count() // FILE_ROWS
    keep = lambda table, name: cut(table.coalesce(files), name)
    links = keep(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "links",
    )
    labels = None
    while labels is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        parent = keep(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("root")), "parent")
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = parent.join(up, "root").select("id", "root", "above")
            if jumped.where("root <> above").isEmpty():
                break
            further = keep(jumped.select("id", F.col("above").alias("root")), "parent")
            discard(parent)
            parent = further
        if labels is None:
            labels = keep(parent.select("id", F.col("root").alias("component")), "labels")
        else:
            step = parent.select(F.col("id").alias("component"), "root")
            done = keep(labels.join(step, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
            discard(labels)
            labels = done
        one = parent.select(F.col("id").alias("src"), F.col("root").alias("a"))
        two = parent.select(F.col("id").alias("dst"), F.col("root").alias("b"))
        left = keep(
            links.join(one, "src").join(two, "dst").where("a <> b")
            .select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(),
            "links",
        )
        discard(links)
        discard(parent)
        links = left
    discard(links)
    discard(edges)
    return labels
