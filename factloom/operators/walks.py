"""Walks that are joins a round: chains of fields to a type, dispatch by message, bounded traversals with visited nodes.

The state of a walk is a row, and a round joins all of them with their next step, so many tasks extend the walks of very
many starts side by side. Loops cut their lineage every round and end when no walk has a next step. Nulls in a key meet
nothing. Orders are arrays of numbers, compared from the left, a beginning before what it begins; every tie is broken
by them and then by the node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.cut import cut


def promoted(fields: DataFrame, most: int = 8) -> DataFrame:
    """scope, type, field, to: the fields of every type, its own and those of the types embedded in it.

    `fields` has scope, type, field, to, embedded, pos. The nearest embedding counts, of equally near ones the first by
    position; a type is visited once, so types may embed themselves or each other; embeddings deeper than `most` don't
    count. Of fields of one name in a type the first by position counts.
    """
    rows = fields.select("scope", "type", "field", "to", "embedded", F.col("pos").cast("long").alias("pos")).where("scope is not null and type is not null and to is not null")
    own = cut(rows.where("not embedded").groupBy("scope", F.col("type").alias("at"), "field").agg(F.min_by("to", F.struct("pos", "to")).alias("to")))
    inner = cut(rows.where("embedded").groupBy("scope", F.col("type").alias("at"), F.col("to").alias("next")).agg(F.min("pos").alias("pos")))
    front = cut(rows.select("scope", "type").distinct().select("scope", "type", F.col("type").alias("at"), F.array().cast("array<bigint>").alias("order")))
    seen = [front]
    for _ in range(most):
        to = front.join(inner, ["scope", "at"]).groupBy("scope", "type", F.col("next").alias("at")).agg(F.min(F.array_append("order", F.col("pos"))).alias("order"))
        front = cut(to.join(reduce(DataFrame.unionByName, seen), ["scope", "type", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen.append(front)
    met = reduce(DataFrame.unionByName, seen).join(own, ["scope", "at"])
    return met.groupBy("scope", "type", "field").agg(F.min_by("to", F.struct(F.size("order"), "order", "to")).alias("to"))


def chain_ends(chains: DataFrame, fields: DataFrame) -> DataFrame:
    """`chains` (id, scope, type, names array) with `found`, the type that their names lead to, field by field.

    An empty chain leads to its own type; one with an unknown field, or a null, to null. `fields` is what
    :func:`promoted` gives. Chains end, so fields may lead back to types that were passed.
    """
    state = chains.select("id", "scope", F.col("type").alias("at"), F.col("names").alias("rest"))
    done = []
    while True:
        state = cut(state)
        done.append(state.where("size(rest) = 0").select("id", F.col("at").alias("found")))
        state = state.where("size(rest) > 0")
        if state.isEmpty():
            break
        step = fields.select("scope", F.col("type").alias("at"), F.col("field").alias("name"), "to")
        state = state.withColumn("name", F.get("rest", F.lit(0))).join(step, ["scope", "at", "name"]).select("id", "scope", F.col("to").alias("at"), F.slice("rest", F.lit(2), F.size("rest") - 1).alias("rest"))
    return chains.join(reduce(DataFrame.unionByName, done), "id", "left")


def only_taker(asked: DataFrame, takers: DataFrame) -> DataFrame:
    """`asked` (id, scope, node, messages array) with `taker`: the one node that takes the first message that has just one.

    `takers` has scope, message, node. A node that asks isn't counted among the takers; a message with none or with
    several passes on to the next.
    """
    told = takers.select("scope", "message", F.col("node").alias("other")).where("other is not null").distinct()
    each = asked.select("id", "scope", "node", F.posexplode("messages").alias("pos", "message"))
    met = each.join(told, ["scope", "message"]).where(~F.col("node").eqNullSafe(F.col("other")))
    one = met.groupBy("id", "pos").agg(F.count("*").alias("n"), F.min("other").alias("taker")).where("n = 1")
    return asked.join(one.groupBy("id").agg(F.min_by("taker", "pos").alias("taker")), "id", "left")


def method_bodies(asked: DataFrame, methods: DataFrame, ports: DataFrame) -> DataFrame:
    """`asked` (id, scope, type, method) with `body`: the type's own, else its twin's, else that of a port's one adapter.

    `methods` has scope, type, method, body, of which the least counts. A twin is the one other type that has the method
    and is spelled the same but for case. `ports` has scope, port, type: the only type that implements a port.
    """
    own = methods.groupBy("scope", "type", "method").agg(F.min("body").alias("own"))
    low = own.select("scope", F.lower("type").alias("low"), "method", F.col("type").alias("other"), F.col("own").alias("twin"))
    keyed = asked.withColumn("low", F.lower("type"))
    twins = keyed.join(low, ["scope", "low", "method"]).where("other <> type").groupBy("id").agg(F.count("*").alias("n"), F.min("twin").alias("twin")).where("n = 1").drop("n")
    adapter = ports.select("scope", F.col("port").alias("type"), F.col("type").alias("by")).join(own.select("scope", F.col("type").alias("by"), "method", F.col("own").alias("adapted")), ["scope", "by"]).drop("by")
    met = asked.join(own, ["scope", "type", "method"], "left").join(twins, "id", "left").join(adapter, ["scope", "type", "method"], "left")
    return met.select(*asked.columns, F.coalesce("own", "twin", "adapted").alias("body"))


def traverse(entries: DataFrame, edges: DataFrame, depth: int, hops: int, visited: DataFrame | None = None) -> DataFrame:
    """entry, node, order, depth, hops, via: what each entry reaches, every node once.

    `entries` has entry, node, order; `edges` has src, dst, order, remote, via. An edge appends its order to that of its
    source. Local edges go `depth` deep; a remote one starts at depth 0 again, of which `hops` follow each other, and
    no two with the same `via`. A node counts where the fewest edges reach it, the least order first. Nodes of `visited`
    (entry, node) are not entered; a second row of an entry and node in `entries` is left out in the same way.
    """
    via = F.array().cast("array<string>")
    start = entries.where("entry is not null and node is not null").select("entry", "node", F.col("order").cast("array<bigint>").alias("order")).groupBy("entry", "node").agg(F.min("order").alias("order"))
    known = None if visited is None else visited.select("entry", "node")
    # entries that begin at one node and have nothing visited share a walk: their order is how all of its orders begin
    alone = start.groupBy("entry").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("order").alias("order")).where("n = 1 and order is not null").drop("n")
    alone = cut(alone if known is None else alone.join(known, "entry", "left_anti"))
    own = start.join(alone, "entry", "left_anti")
    own = own if known is None else own.join(known, ["entry", "node"], "left_anti")
    lead = lambda df, entry, shared, order: df.select(F.struct(entry.alias("entry"), shared.alias("shared")).alias("walk"), "node", order.alias("order"))
    front = lead(own, F.col("entry"), F.lit(None).cast(dict(start.dtypes)["node"]), F.col("order"))
    front = front.unionByName(lead(alone.select("node").distinct(), F.lit(None).cast(dict(start.dtypes)["entry"]), F.col("node"), F.array().cast("array<bigint>")))
    front = cut(front.select("walk", "node", "order", F.lit(0).alias("depth"), F.lit(0).alias("hops"), via.alias("via")))
    passed = None if known is None else known.select(F.struct("entry", F.lit(None).cast(dict(start.dtypes)["node"]).alias("shared")).alias("walk"), "node")
    walked = _walk(front, edges, depth, hops, passed)
    each = walked.where("walk.shared is null").select("walk.entry", "node", "order", "depth", "hops", "via")
    shared = walked.where("walk.shared is not null").withColumn("shared", F.col("walk.shared"))
    begun = alone.select("entry", F.col("node").alias("shared"), F.col("order").alias("begin"))
    return each.unionByName(shared.join(begun, "shared").select("entry", "node", F.concat("begin", "order").alias("order"), "depth", "hops", "via"))


def _walk(front: DataFrame, edges: DataFrame, depth: int, hops: int, visited: DataFrame | None) -> DataFrame:
    """walk, node, order, depth, hops, via: what the walks of `front` (the same columns) reach, as in :func:`traverse`."""
    state = F.struct("order", "depth", "hops", "via")
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("order").cast("array<bigint>").alias("step"), "remote", F.col("via").alias("by")).where("next is not null")
    # rounds read only edges that leave a node where a walk begins or an edge ends
    steps = cut(steps.join(steps.select(F.col("next").alias("node")).unionByName(front.select("node")).distinct(), "node", "left_semi"))
    found = [front]
    while not front.isEmpty():
        met = front.join(steps, "node")
        go = F.when(F.col("remote"), (F.col("hops") < hops) & ~F.array_contains("via", F.coalesce("by", F.lit("")))).otherwise(F.col("depth") < depth)
        to = met.where(go).select(
            "walk", F.col("next").alias("node"), F.concat("order", "step").alias("order"), F.when(F.col("remote"), F.lit(0)).otherwise(F.col("depth") + 1).alias("depth"), F.when(F.col("remote"), F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"),
            F.when(F.col("remote") & F.col("by").isNotNull(), F.array_append("via", F.col("by"))).otherwise(F.col("via")).alias("via"),
        )
        before = reduce(DataFrame.unionByName, [*([] if visited is None else [visited]), *[f.select("walk", "node") for f in found]])
        front = cut(to.groupBy("walk", "node").agg(F.min(state).alias("s")).select("walk", "node", "s.*").join(before, ["walk", "node"], "left_anti"))
        found.append(front)
    return reduce(DataFrame.unionByName, found)


def deliver(published: DataFrame, consumers: DataFrame, most: int) -> DataFrame:
    """id, consumer, n, inferred: the consumers that a message goes to, at most `most`, counted from 1 in their order.

    `published` has id, scope, bus, topic; `consumers` has consumer, scope, bus, topic, order. Those of the same bus and
    topic count. Where there are none and one side doesn't know its topic (null), the consumer counts that is the only
    such on the bus: `inferred`.
    """
    c = consumers.select("scope", "bus", "topic", "consumer", F.col("order").alias("at"))
    # the first `most` of all that a message meets are among the first `most` of each bus and topic, so no more are joined
    place = F.row_number().over(Window.partitionBy("scope", "bus", "topic").orderBy("at", "consumer"))
    first = c.where("topic is not null").withColumn("place", place).where(F.col("place") <= most)
    exact = published.join(first, ["scope", "bus", "topic"]).select("id", "consumer", "at", F.lit(False).alias("inferred"))
    # per bus: how many consumers there are and how many don't know their topic, so a message meets one row
    alone = c.groupBy("scope", "bus").agg(F.count("*").alias("all"), F.min_by("consumer", F.struct("at", "consumer")).alias("one"), F.count(F.when(F.col("topic").isNull(), 1)).alias("blind"), F.min_by("consumer", F.when(F.col("topic").isNull(), F.struct("at", "consumer"))).alias("blind_one"))
    rest = published.join(exact.select("id").distinct(), "id", "left_anti").join(alone, ["scope", "bus"])
    pick = F.when(F.col("topic").isNull() & (F.col("all") == 1), F.col("one")).when(F.col("topic").isNotNull() & (F.col("blind") == 1), F.col("blind_one"))
    lone = rest.select("id", pick.alias("consumer"), F.lit(None).cast(dict(c.dtypes)["at"]).alias("at"), F.lit(True).alias("inferred")).where("consumer is not null")
    n = F.row_number().over(Window.partitionBy("id").orderBy("at", "consumer"))
    return exact.unionByName(lone).withColumn("n", n).where(F.col("n") <= most).select("id", "consumer", "n", "inferred")


def bound_parameters(classes: DataFrame, extends: DataFrame) -> DataFrame:
    """scope, base, param, sub, bound: what a type parameter of a class becomes in the classes below it.

    `classes` has scope, class, params (array), of which the first by params of a (scope, class) counts; `extends` has
    scope, class, parent, args (array). A generation a round: an argument that is itself a parameter of the class below
    is followed further, any other is the end of its line. A class that extends without that argument binds nothing; a
    class is visited once for a parameter of a base and one of its own, so classes may extend each other.
    """
    params = cut(classes.where("scope is not null and class is not null").groupBy("scope", "class").agg(F.min("params").alias("params")))
    below = extends.where("parent is not null").select("scope", F.col("parent").alias("at"), F.col("class").alias("sub"), "args").distinct()
    below = cut(below.join(params.withColumnsRenamed({"class": "sub", "params": "own"}), ["scope", "sub"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>"))))
    front = cut(params.select("scope", F.col("class").alias("base"), F.posexplode("params").alias("pos", "param"), F.col("class").alias("at")))
    state = ["scope", "base", "param", "at", "pos"]
    seen, found = [front.select(*state)], []
    while not front.isEmpty():
        met = front.join(below, ["scope", "at"]).withColumn("bound", F.get("args", F.col("pos"))).where("bound is not null")
        met = cut(met.select("scope", "base", "param", "sub", "bound", (F.array_position("own", F.col("bound")) - 1).cast("int").alias("next")))
        found.append(met.where("next < 0").select("scope", "base", "param", "sub", "bound"))
        to = met.where("next >= 0").select("scope", "base", F.col("next").alias("pos"), "param", F.col("sub").alias("at"))
        front = cut(to.select(*state).distinct().join(reduce(DataFrame.unionByName, seen), state, "left_anti"))
        seen.append(front)
    empty = params.select("scope", F.col("class").alias("base"), F.col("class").alias("param"), F.col("class").alias("sub"), F.col("class").alias("bound")).where("false")
    return reduce(DataFrame.unionByName, found, empty).distinct()
