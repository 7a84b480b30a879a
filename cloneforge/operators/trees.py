"""What a tree (parent, child, dist) says of its nodes: closure, depth, height, subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneforge.operators.ordered import running
from cloneforge.plans.storage import written


def closure(tree: DataFrame) -> DataFrame:
    """(anc, desc, hops, dist) of each node and all it leads to, itself included. Paths are doubled: rounds grow with the logarithm of the depth."""
    edges = tree.select(F.col("parent").alias("anc"), F.col("child").alias("desc"), F.lit(1).alias("hops"), F.col("dist").cast("long").alias("dist"))
    # paths of up to `reach` hops, of which those of just `reach` are in the last table
    known = last = written(edges, "closure")
    reach = 1
    while True:
        ends = last.where(F.col("hops") == reach)
        onward = known.select(F.col("anc").alias("desc"), F.col("desc").alias("d2"), F.col("hops").alias("h2"), F.col("dist").alias("w2"))
        more = written(ends.join(onward, "desc").select("anc", F.col("d2").alias("desc"), (F.col("hops") + F.col("h2")).alias("hops"), (F.col("dist") + F.col("w2")).alias("dist")), "closure")
        if not more.limit(1).count():
            break
        known, last = known.unionByName(more), more
        reach *= 2
    nodes = tree.select(F.col("parent").alias("n")).union(tree.select("child")).distinct()
    return known.unionByName(nodes.select(F.col("n").alias("anc"), F.col("n").alias("desc"), F.lit(0).alias("hops"), F.lit(0).cast("long").alias("dist")))


def lineages(closed: DataFrame) -> DataFrame:
    """(cell, depth, height, subtreesize, root_dist): hops and weighted distance from the root, hops to the farthest leaf, and nodes below, itself included."""
    up = closed.groupBy(F.col("desc").alias("cell")).agg(F.max("hops").alias("depth"), F.max("dist").alias("root_dist"))
    down = closed.groupBy(F.col("anc").alias("cell")).agg(F.max("hops").alias("height"), F.count(F.lit(1)).alias("subtreesize"))
    return up.join(down, "cell").select("cell", "depth", "height", "subtreesize", "root_dist")


def measured(tree: DataFrame) -> DataFrame:
    """As lineages(), without the closure: after k rounds each node points to its ancestor 2^k hops up, and knows what lies less than 2^k hops below. A round has one row for
    each node, and rounds grow with the logarithm of the depth."""
    tops = roots(tree).select("cell", F.lit(None).cast("string").alias("up"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("root_dist"))
    own = tree.select(F.col("child").alias("cell"), F.col("parent").alias("up"), F.lit(1).alias("depth"), F.col("dist").cast("long").alias("root_dist")).unionByName(tops)
    own = written(own.withColumn("subtreesize", F.lit(1).cast("long")).withColumn("height", F.lit(0)), "measures")
    hops = 1
    while own.where("up is not null").limit(1).count():
        above = own.select(F.col("cell").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root_dist").alias("_dist"))
        below = own.where("up is not null").groupBy(F.col("up").alias("cell")).agg(F.sum("subtreesize").alias("_size"), (F.max("height") + hops).alias("_height"))
        next_ = own.join(above, "up", "left").join(below, "cell", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        own = written(
            next_.select("cell", F.col("_up").alias("up"), (F.col("depth") + zero("_depth")).alias("depth"), (F.col("root_dist") + zero("_dist")).alias("root_dist"),
                         (F.col("subtreesize") + zero("_size")).alias("subtreesize"), F.greatest("height", zero("_height")).alias("height")), "measures")
        hops *= 2
    return own.select("cell", "depth", "height", "subtreesize", "root_dist")


def roots(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("parent").alias("cell")).distinct().join(tree.select(F.col("child").alias("cell")), "cell", "left_anti")


def leaves(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("child").alias("cell")).join(tree.select(F.col("parent").alias("cell")).distinct(), "cell", "left_anti")


def eligible(lineage: DataFrame, root: str, least: int = 5) -> DataFrame:
    return lineage.where((F.col("subtreesize") >= least) & (F.col("cell") != root))


def betweenness(lineage: DataFrame, tree: DataFrame) -> DataFrame:
    """(parent, child, through): paths between two nodes that use an edge."""
    n = lineage.agg(F.max("subtreesize").alias("n"))
    sized = tree.join(lineage.select(F.col("cell").alias("child"), "subtreesize"), "child").crossJoin(F.broadcast(n))  # one row
    return sized.select("parent", "child", (F.col("subtreesize") * (F.col("n") - F.col("subtreesize"))).alias("through"))


def spans(tree: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(cell, first, last): nodes numbered so that first to last of each are those of its subtree, itself being the first. Siblings are in order of their names, trees of a forest too. A node lies as much after its parent as its
    elder siblings' subtrees hold, and one more; these steps are summed along the way to the root by doubled pointers. sizes: measured() of the tree, if known."""
    sizes = (measured(tree) if sizes is None else sizes).select("cell", "subtreesize")
    tops = roots(tree).join(sizes, "cell").select(F.lit(None).cast("string").alias("up"), "cell", "subtreesize")
    kids = tree.select(F.col("parent").alias("up"), F.col("child").alias("cell")).join(sizes, "cell").select("up", "cell", "subtreesize")
    steps = running(kids.unionByName(tops), ["up"], ["cell"], ["subtreesize"])
    own = steps.select("cell", "up", "subtreesize", (F.col("subtreesize_before") + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("first"))
    own = written(own, "spans")
    while own.where("up is not null").limit(1).count():
        above = own.select(F.col("cell").alias("up"), F.col("up").alias("_up"), F.col("first").alias("_first"))
        own = written(own.join(above, "up", "left").select("cell", F.col("_up").alias("up"), "subtreesize", (F.col("first") + F.coalesce("_first", F.lit(0))).alias("first")), "spans")
    return own.select("cell", "first", (F.col("first") + F.col("subtreesize") - 1).alias("last"))


def network(significant: DataFrame, tree: DataFrame) -> DataFrame:
    """(node1, node2, dist) of cells (cell, depth) that have a finding: the deepest one above, or `root`, and the difference of depths. Each node points to an ancestor, and carries the deepest marked one on the way there;
    pointers are doubled until they reach a marked one or the root."""
    marked = significant.select("cell", "depth").distinct()
    own = tree.select(F.col("child").alias("cell"), F.col("parent").alias("up")).join(marked.select(F.col("cell").alias("up"), F.col("cell").alias("mark")), "up", "left")
    own = written(own.select("cell", "up", "mark"), "marks")
    while own.where("mark is null and up is not null").limit(1).count():
        above = own.select(F.col("cell").alias("up"), F.col("up").alias("_up"), F.col("mark").alias("_mark"))
        onward = own.where("mark is null and up is not null").join(above, "up", "left").select("cell", F.col("_up").alias("up"), F.col("_mark").alias("mark"))
        own = written(onward.unionByName(own.where("mark is not null or up is null")), "marks")
    up = marked.select(F.col("cell").alias("mark"), F.col("depth").alias("updepth"))
    joined = marked.join(own.select("cell", "mark"), "cell", "left").join(up, "mark", "left")
    return joined.select(F.coalesce("mark", F.lit("root")).alias("node1"), F.col("cell").alias("node2"), (F.col("depth") - F.coalesce("updepth", F.lit(0))).alias("dist"))
