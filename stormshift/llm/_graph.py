"""Connected components by contraction, as joins and grouped minima on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormshift.llm._shared import written


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component): every node of an edge and a name of its component.

    Each round points every node to the neighbour of smallest hash (or itself), follows pointers twice, and
    contracts: edges between the new names, without loops and repeats, remain. A round at least halves the
    live nodes in expectation, so the number of rounds grows with the logarithm of the nodes. The name is
    the member of smallest hash; take a minimum over members for another one.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    names = nodes.select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        up = both.groupBy("a").agg(F.min(key("b")).alias("m")).select("a", F.least(F.col("m"), key("a"))["v"].alias("p"))
        up = written(up, "pointers")
        for _ in range(2):  # p is a node of an edge itself, so it has a pointer
            up = up.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"))
        up = written(up, "pointers")
        names = written(names.join(up.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")), "components")
        a, b = (up.select(F.col("a").alias(c), F.col("p").alias("to_" + c)) for c in "ab")
        edges = written(edges.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    return names
