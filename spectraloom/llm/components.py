"""Connected components by alternating large-star and small-star rounds.

Both stars need, for each node, the least of its neighbours: a ``min`` aggregate, combined on the map
side, that is joined back to the edges. No node's neighbours are ever gathered in one group: the
join's own exchanges let adaptive execution split the partition of a node with very many edges, at
every size alike. Each round's edges go to the reliable checkpoint folder, so a lost executor costs
at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.session import cut

def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("coalesce(sum(cast(xxhash64(u, v) as decimal(38,0))), 0)").alias("h")).first()
    return row["n"], int(row["h"])


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", *, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges``; the component is its least node.

    Edges with a null end are dropped, loops and repeated edges do no harm, an edge list without
    rows gives no rows. Raises when ``max_rounds`` don't suffice (rounds grow with the logarithm
    of the longest chain, so 60 is out of reach).
    """
    given = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    # what makes the edges is run once, though loops and links are read apart
    pairs = cut(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = pairs.where("u = v").select("u").distinct()
    links = pairs.where("u <> v")
    alone = loops.join(links.select(F.explode(F.array("u", "v")).alias("u")).distinct(), "u", "left_anti")
    state = _state(links)
    for _ in range(max_rounds):
        # large-star: every greater neighbour of u is linked to the least of u and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: u and its lesser neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lesser = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = lesser.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = cut(small)
        new = _state(links)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(alone.select(F.col("u").alias("node"), F.col("u").alias("component")))
