"""Graph operators over edge tables (src, dst): closures, components, paths, contraction.

Loops are semi-naive and cut their lineage every round. Ties are always broken by the node's own order, so two runs
over the same edges agree. Nulls are no nodes: edges with one are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.cut import cut


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All (src, dst) with a path of one or more edges; the reach doubles every round."""
    reached = cut(_edges(edges, src, dst))
    fresh = reached
    while True:
        longer = fresh.select("src", F.col("dst").alias("mid")).join(reached.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        fresh = cut(longer.join(reached, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return reached
        reached = cut(reached.unionByName(fresh))


def _trimmed(live: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: those whose source has an edge in and whose target has one out, to the end."""
    while True:
        into, out = live.select(F.col("dst").alias("src")).distinct(), live.select(F.col("src").alias("dst")).distinct()
        kept = cut(live.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        if kept.count() == live.count():
            return kept
        live = kept


def _colours(live: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches it, itself included; a front of changes moves along the edges."""
    colours = cut(live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")))
    front = colours
    while True:
        to = front.join(live, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("next"))
        front = cut(to.join(colours, "node").where("next < colour").select("node", F.col("next").alias("colour")))
        if front.isEmpty():
            return colours
        colours = cut(colours.join(front.withColumnRenamed("colour", "next"), "node", "left").select("node", F.coalesce("next", "colour").alias("colour")))


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the least node of its cycle, or the node itself.

    Forward and backward by colours: edges that can't lie on a cycle are trimmed, every node takes the least node that
    reaches it, and of each colour the nodes that reach back to it are one component. What is left goes on. A round
    costs the edges that are left, not the pairs that reach each other.
    """
    pairs = cut(_edges(edges, src, dst))
    nodes = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    live, found = _trimmed(pairs.where("src <> dst")), []
    while not live.isEmpty():
        colours = _colours(live)
        ends = colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), colours.select(F.col("node").alias("dst"), F.col("colour").alias("b"))
        inner = cut(live.join(ends[0], "src").join(ends[1], "dst").where("a = b").select("src", "dst", "a"))
        # backwards from the node that names the colour, within it
        front = cut(colours.where("node = colour").select("node", F.col("colour").alias("component")))
        members = [front]
        while not front.isEmpty():
            back = front.join(inner, (F.col("node") == F.col("dst")) & (F.col("component") == F.col("a"))).select(F.col("src").alias("node"), "component").distinct()
            front = cut(back.join(reduce(DataFrame.unionByName, members), ["node", "component"], "left_anti"))
            members.append(front)
        found.append(cut(reduce(DataFrame.unionByName, members)))
        gone = found[-1].select("node")
        live = _trimmed(cut(inner.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")))
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(reduce(DataFrame.unionByName, found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _star(both: DataFrame, larger: bool) -> DataFrame:
    least = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
    met = both.join(least, "u")
    if larger:
        return met.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()
    small = met.where("v < u and v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return small.unionByName(least.where("u <> m").select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct()


def weak_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its least node), by alternating large and small stars: a logarithmic number of rounds."""
    given = _edges(edges, src, dst)
    nodes = given.select(F.col("src").alias("node")).unionByName(given.select(F.col("dst").alias("node"))).distinct()
    pairs, state = cut(given.where("src <> dst")), None
    while True:
        both = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(pairs.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        large = _star(both, True)
        pairs = cut(_star(large.select(F.col("src").alias("u"), F.col("dst").alias("v")), False))
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return nodes.join(pairs, F.col("node") == F.col("src"), "left").select("node", F.coalesce("dst", "node").alias("component"))


def hops(edges: DataFrame, starts: Iterable, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame:
    """node, hops: the fewest edges from any of `starts`; unreached nodes have no row.

    It runs until nothing new is reached; if `most` is given and nodes lie farther away, that is an error.
    """
    step = _edges(edges, src, dst)
    spark, kind = edges.sparkSession, dict(step.dtypes)["src"]
    seen = cut(spark.createDataFrame([(s,) for s in starts], f"node {kind}").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for n in count(1):
        to = front.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(to.join(seen, "node", "left_anti").withColumn("hops", F.lit(n)))
        if front.isEmpty():
            return seen
        if most is not None and n > most:
            raise ValueError(f"nodes lie more than {most} edges away")
        seen = cut(seen.unionByName(front))


def shortest_path(edges: DataFrame, start, goal, src: str = "src", dst: str = "dst", most: int | None = None) -> list:
    """The nodes of a shortest path, the least one by its nodes where several are as short; empty if there is none.

    If `most` is given and the search isn't done after so many edges, that is an error.
    """
    step = _edges(edges, src, dst)
    kind = dict(step.dtypes)["src"]
    front = edges.sparkSession.createDataFrame([(start, [start])], f"node {kind}, path array<{kind}>")
    seen = front.select("node")
    for n in count():
        found = front.where(F.col("node") == F.lit(goal)).select("path").first()
        if found:
            return found["path"]
        to = front.join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.array_append("path", F.col("dst"))).alias("path"))
        front = cut(to.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return []
        if most is not None and n >= most:
            raise ValueError(f"the search isn't done after {most} edges")
        seen = cut(seen.unionByName(front.select("node")))


def shortcuts(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges of an acyclic graph that a longer path replaces: what a transitive reduction removes."""
    pairs = _edges(edges, src, dst)
    longer = pairs.select("src", F.col("dst").alias("mid")).join(closure(pairs).select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
    return pairs.join(longer, ["src", "dst"], "left_semi")


def reduce_in_order(edges: DataFrame, graph: str, order: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Per graph, edges left after removing, in `order`, each one whose target the remaining edges still reach.

    Unlike :func:`shortcuts` this is defined on cycles; it is sequential, so every graph is one group.
    """

    def reduce(pdf):
        left = list(pdf.sort_values(order)[[src, dst]].itertuples(index=True, name=None))
        for edge in list(left):
            rest = [e for e in left if e[0] != edge[0]]
            seen, todo = set(), [edge[1]]
            while todo:
                at = todo.pop()
                for _, a, b in rest:
                    if a == at and b not in seen:
                        seen.add(b)
                        todo.append(b)
            if edge[2] in seen:
                left = rest
        return pdf.loc[[e[0] for e in left]]

    return edges.groupBy(graph).applyInPandas(reduce, edges.schema)


def contract(edges: DataFrame, groups: DataFrame, node: str = "node", group: str = "group") -> DataFrame:
    """Edges between groups of nodes: endpoints renamed, loops dropped, edges of a pair merged.

    `edges` has src, dst, label, is_primary; a merged edge is primary if one was, and has a label only if all agree.
    """
    names = groups.select(F.col(node).alias("n"), F.col(group).alias("g"))
    a, b = names.select(F.col("n").alias("src"), F.col("g").alias("gs")), names.select(F.col("n").alias("dst"), F.col("g").alias("gd"))
    renamed = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("gs", "src").alias("src"), F.coalesce("gd", "dst").alias("dst"), "label", "is_primary")
    return merge_edges(renamed.where("src <> dst"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): is_primary by or, the label only where all rows agree (a null is a label of its own)."""
    same = (F.countDistinct("label") == 1) & (F.count("label") == F.count(F.lit(1)))
    return edges.groupBy("src", "dst").agg(F.bool_or("is_primary").alias("is_primary"), F.when(same, F.min("label")).alias("label"), F.count(F.lit(1)).alias("merged"))


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, degree: edges in and out, repeated edges counted."""
    return edges.select(F.explode(F.array(src, dst)).alias("node")).where("node is not null").groupBy("node").agg(F.count("*").alias("degree"))


def focal(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The node of the greatest degree, the least one on a tie: one row, or none without edges."""
    return degrees(edges, src, dst).orderBy(F.desc("degree"), "node").limit(1)


def neighbourhoods(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, neighbours: its sorted distinct (other, way) pairs. Group by `neighbours` for nodes with the same ones."""
    pairs = _edges(edges, src, dst)
    sides = pairs.select(F.col("src").alias("node"), F.struct(F.col("dst").alias("other"), F.lit("out").alias("way")).alias("near")).unionByName(
        pairs.select(F.col("dst").alias("node"), F.struct(F.col("src").alias("other"), F.lit("in").alias("way")).alias("near"))
    )
    return sides.groupBy("node").agg(F.array_sort(F.collect_set("near")).alias("neighbours"))


def on_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges whose target reaches their source: both ends lie in one strong component."""
    pairs = _edges(edges, src, dst)
    parts = strong_components(pairs)
    met = pairs.join(parts.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    return met.where("a = b and src <> dst or src = dst").select("src", "dst")


def propagate_labels(nodes: DataFrame, edges: DataFrame, graph: str, rounds: int = 3) -> DataFrame:
    """Per graph, nodes without a label take the majority of their neighbours', in place and in node order.

    `nodes` has graph, node, label; `edges` graph, src, dst. Ties go to the least label; updates of a round are seen
    by the nodes after it, which a synchronous round would not reproduce, so every graph is one group.
    """

    def spread(key, left, right):
        near: dict = {}
        for a, b in right[["src", "dst"]].itertuples(index=False):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        label = {n: x if isinstance(x, str) else None for n, x in left[["node", "label"]].itertuples(index=False)}
        for _ in range(rounds):
            changed = False
            for n in sorted(label):
                if label[n] is None:
                    votes: dict[str, int] = {}
                    for m in near.get(n, ()):
                        if label.get(m) is not None:
                            votes[label[m]] = votes.get(label[m], 0) + 1
                    if votes:
                        label[n], changed = min(votes, key=lambda x: (-votes[x], x)), True
            if not changed:
                break
        return left.assign(label=[label[n] for n in left["node"]])

    # columns under fresh names: both tables may come from one, which a co-group can't tell apart
    left, right = nodes.toDF(*[f"_{c}" for c in nodes.columns]).toDF(*nodes.columns), edges.toDF(*[f"_{c}" for c in edges.columns]).toDF(*edges.columns)
    return left.groupBy(graph).cogroup(right.groupBy(graph)).applyInPandas(spread, nodes.schema)
