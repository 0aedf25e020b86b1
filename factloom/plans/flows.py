"""Flows: what an operation, a consumer or a schedule sets in motion, step by step.

Functions are nodes, calls between them edges, and all flows of all repositories are walked at once, a round of joins at
a time (:func:`factloom.operators.walks.traverse`): five calls deep within a unit, three units far, two messages on. No
row holds more than one step until a flow's own steps are put in order at the end.

A call leads to the handler of the message type that it names, if one alone takes it; else, through the fields of its
receiver, to the method of the type that they end at, of its twin or of a port's one adapter; else to the function of
its name in the same file or the only one of the unit. Interface declarations have no body. A function is entered once
a flow, where the fewest calls reach it. Every call and every step carries the numbers of its lines, after those of the
call that led there, so sorting by them gives the order of a depth-first reading: effects before calls on a line,
replies after what they answer, what consumers do after the part that published, one consumer after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import joins, walks
from factloom.operators.cut import cut
from factloom.plans.scan import Model

#: Fixed limits of a flow.
LOCAL, REMOTE, HOPS, CONSUMERS, PARTICIPANTS, STEPS, FIGURES = 5, 3, 2, 2, 8, 24, 6
#: Parameter types that say nothing about the message that a handler takes; fixed values.
GENERIC = ("Context", "context", "error", "string", "int", "int64", "bool", "T", "R", "any", "interface")
#: Lines of a file that share a bucket where a line looks for its function, and lines from an annotation to its function.
BUCKET, NEAR = 64, 10
#: What comes after all lines of a function, and after all functions of a part.
LAST = (1 << 31) - 1


def _numbers(*parts) -> Column:
    return F.array(*[(p if isinstance(p, Column) else F.lit(p)).cast("bigint") for p in parts])


def _located(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """`rows` (repo, path, line) with node, the innermost function around their line; those outside of any have no row."""
    scope = F.concat_ws("\u0001", "repo", "path")
    spans = bodies.select(scope.alias("scope"), F.col("node").alias("id"), F.col("start").alias("lo"), F.col("end").alias("hi"))
    at = joins.innermost(rows.select(scope.alias("scope"), "line").distinct(), spans, "scope", "line", BUCKET).where("id is not null")
    return rows.withColumn("scope", scope).join(at.withColumnRenamed("id", "node"), ["scope", "line"]).drop("scope")


def _named(asked: DataFrame, bodies: DataFrame) -> DataFrame:
    """`asked` (id, repo, unit, path, name) with found: the function of that name in the file, else the unit's only one."""
    near = bodies.groupBy("repo", "path", "name").agg(F.min_by("node", F.struct("start", "node")).alias("near"))
    only = bodies.groupBy("repo", "unit", "name").agg(F.count("*").alias("k"), F.min("node").alias("only")).where("k = 1").drop("k")
    return asked.join(near, ["repo", "path", "name"], "left").join(only, ["repo", "unit", "name"], "left").select(*asked.columns, F.coalesce("near", "only").alias("found"))


def functions(model: Model) -> DataFrame:
    """node, repo, unit, path, name, start, end, receiver, receiver_type, params of every function that has a body."""
    symbols = model.flows_input.select("repo", "unit", "path", F.explode("symbols").alias("s"))
    ports = symbols.where("s.kind in ('interface', 'trait')").select("repo", "path", F.col("s.name").alias("owner")).distinct()
    rows = symbols.where("s.kind in ('function', 'method')").select("repo", "unit", "path", F.col("s.name").alias("name"), F.col("s.start_line").alias("start"), F.col("s.end_line").alias("end"), F.col("s.owner").alias("owner"), "s.receiver", "s.receiver_type", "s.params")
    node = F.concat_ws("\u0001", "repo", "path", F.col("start").cast("string"), "name")
    return rows.join(ports, ["repo", "path", "owner"], "left_anti").drop("owner").withColumn("node", node).dropDuplicates(["node"])


def _inline(model: Model, bodies: DataFrame) -> DataFrame:
    """Operations whose handler is no function as nodes of their own, from the route's line to its last."""
    asked = model.operations.select("id", "repo", "unit", F.col("file").alias("path"), F.col("handler").alias("name"), "line", "end_line")
    rest = _named(asked, bodies).where("found is null")
    node = F.concat_ws("\u0001", "repo", "path", F.col("line").cast("string"), "id")
    return rest.select(node.alias("node"), "repo", "unit", "path", F.coalesce("name", "id").alias("name"), F.col("line").alias("start"), F.greatest("line", F.coalesce("end_line", "line")).alias("end"), "id")


def call_edges(model: Model, bodies: DataFrame) -> DataFrame:
    """src, dst, order of the calls within units."""
    calls = model.flows_input.select("repo", "unit", "path", F.posexplode("calls").alias("pos", "k")).select("repo", "unit", "path", "pos", "k.name", "k.callee", "k.line", "k.type_args")
    at = cut(_located(calls, bodies).withColumn("id", F.concat_ws("\u0001", "repo", "path", F.col("pos").cast("string"))))
    scope = F.concat_ws("\u0001", "repo", "unit")
    message = F.regexp_extract(F.col("p"), r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*$", 1)
    takers = bodies.where("receiver_type is not null").select(scope.alias("scope"), "node", F.explode("params").alias("p")).select("scope", "node", message.alias("message")).where(~F.col("message").isin(*GENERIC) & (F.col("message") != ""))
    sent = walks.only_taker(at.where("size(type_args) > 0").select("id", scope.alias("scope"), "node", F.col("type_args").alias("messages")), takers).select("id", F.col("taker").alias("by_message"))
    # receiver chains: the first name is the variable of the enclosing method's receiver
    parts = F.split("callee", r"[.]")
    rooted = at.join(bodies.where("receiver is not null").select("node", "receiver", "receiver_type"), "node").where((F.size(parts) > 1) & (F.get(parts, F.lit(0)) == F.col("receiver")))
    chains = rooted.select("id", scope.alias("scope"), F.col("receiver_type").alias("type"), F.slice(parts, F.lit(2), F.size(parts) - 2).alias("names"), "name")
    types = model.flows_input.select(scope.alias("scope"), "path", F.explode("types").alias("t"))
    fields = types.select("scope", F.col("t.name").alias("type"), "path", F.posexplode("t.fields").alias("pos", "f"))
    fields = fields.select("scope", "type", F.coalesce("f.name", F.lit("")).alias("field"), F.col("f.type").alias("to"), F.col("f.name").isNull().alias("embedded"), "pos")
    ends = walks.chain_ends(chains.drop("name"), walks.promoted(fields)).join(chains.select("id", F.col("name").alias("method")), "id").where("found is not null")
    methods = bodies.where("receiver_type is not null").select(scope.alias("scope"), F.col("receiver_type").alias("type"), F.col("name").alias("method"), F.col("node").alias("body"))
    offered = types.where("t.port and size(t.methods) > 0").select("scope", F.col("t.name").alias("interface"), F.col("t.methods").alias("methods")).dropDuplicates(["scope", "interface"])
    classes = methods.groupBy("scope", F.col("type").alias("class")).agg(F.collect_set("method").alias("methods"))
    ports = joins.only_implementor(offered, classes, "scope").select("scope", F.col("interface").alias("port"), F.col("class").alias("type")).where("type is not null")
    chained = walks.method_bodies(ends.select("id", "scope", F.col("found").alias("type"), "method"), methods, ports).select("id", F.col("body").alias("by_chain"))
    plain = _named(at.select("id", "repo", "unit", "path", "name"), bodies).select("id", F.col("found").alias("by_name"))
    met = at.join(sent, "id", "left").join(chained, "id", "left").join(plain, "id", "left")
    other = lambda c: F.when(F.col(c) != F.col("node"), F.col(c))
    to = F.coalesce("by_message", other("by_chain"), other("by_name"))
    return met.select(F.col("node").alias("src"), to.alias("dst"), _numbers(F.col("line"), 1, F.col("pos")).alias("order")).where("dst is not null")


def _stores(model: Model) -> DataFrame:
    """repo, unit, table, to: the store that a unit's access to an entity goes to: one of the entity's kind, if it uses it."""
    used = model.infra.where("category = 'storage' and kind in ('postgres', 'mysql', 'sqlite', 'mongodb')").select("repo", F.col("id").alias("to"), "kind", F.explode("used_by").alias("unit"))
    kinds = model.entities.select("repo", "table", F.when(F.col("source") == "mongo", "mongodb").otherwise("sql").alias("wants"))
    touched = model.accesses.select("repo", "unit", "table").distinct().join(kinds.groupBy("repo", "table").agg(F.min("wants").alias("wants")), ["repo", "table"], "left")
    fits = (F.col("kind") == "mongodb") == (F.coalesce("wants", F.lit("sql")) == "mongodb")
    return touched.join(used, ["repo", "unit"]).groupBy("repo", "unit", "table").agg(F.min_by("to", F.struct(~fits, "to")).alias("to"))


def effects(model: Model, bodies: DataFrame) -> DataFrame:
    """node, unit, path, line, order, to, kind, label, operation, bus, topic of what functions do beyond their unit."""
    none = F.lit(None).cast("string")

    def row(df: DataFrame, path: str, line: Column, to: Column, kind: Column, label: Column, operation: Column = none, bus: Column = none, topic: Column = none) -> DataFrame:
        return df.select("repo", "unit", F.col(path).alias("path"), line.cast("int").alias("line"), to.alias("to"), kind.alias("kind"), label.alias("label"), operation.alias("operation"), bus.alias("bus"), topic.alias("topic"))

    c = F.col
    parts = [
        row(model.accesses.join(_stores(model), ["repo", "unit", "table"]), "path", c("line"), c("to"), c("mode"), F.concat(c("mode"), F.lit("s "), c("table"))),
        row(model.client_calls.where("operation is not null"), "evidence.file_path", c("evidence.start_line"), c("target_unit"), F.lit("call"), F.concat_ws(" ", "method", c("path")), c("operation")),
        row(model.events.where("kind = 'publish' and bus is not null"), "path", c("line"), c("bus"), F.lit("event"), F.concat_ws(" ", F.lit("publishes"), "name"), bus=c("bus"), topic=c("name")),
        row(model.events.where("kind = 'emit'"), "path", c("line"), c("unit"), F.lit("event"), F.concat_ws(" ", F.lit("publishes"), "name"), bus=F.lit(""), topic=c("name")),
    ]
    # a third party is used by the functions of a file that imports it whose calls name it or its package; else by the last
    vendors = model.vendor_files.join(model.relationships.select("repo", c("source").alias("unit"), "target", "label"), ["repo", "unit", "target"])
    called = model.flows_input.select("repo", "path", F.explode("calls").alias("k")).select("repo", "path", F.lower("k.callee").alias("callee"), "k.line")
    word = F.lower(F.regexp_replace(F.element_at(F.split("spec", r"[/:.@-]"), -1), r"\W", ""))
    names = vendors.select("repo", "unit", "path", "target", "label", F.explode(F.concat(F.transform("specs", lambda s: F.lower(F.regexp_replace(F.element_at(F.split(s, r"[/:.@-]"), -1), r"\W", ""))), F.array("target"))).alias("word")).where("length(word) > 2").distinct()
    met = names.join(called, ["repo", "path"]).where(F.instr("callee", c("word")) > 0).select("repo", "unit", "path", "target", "label", "line").distinct()
    first = _located(met, bodies).groupBy("repo", "unit", "path", "target", "label", "node").agg(F.min("line").alias("line")).drop("node")
    last = bodies.groupBy("repo", "path").agg(F.max("start").alias("line"))
    rest = vendors.join(first.select("repo", "path", "target").distinct(), ["repo", "path", "target"], "left_anti").join(last, ["repo", "path"]).select(*first.columns)
    parts.append(row(first.unionByName(rest), "path", c("line"), c("target"), F.lit("call"), c("label")))
    found = _located(reduce(DataFrame.unionByName, parts), bodies)
    tie = F.hash("to", "kind", "label").cast("bigint")  # of several effects on a line any order will do, if it is the same one
    return found.withColumn("order", _numbers(c("line"), 0, tie))


def consumers(model: Model, bodies: DataFrame) -> DataFrame:
    """id, repo, unit, kind, name, bus, topic, node, path, line, function of what messages, events and clocks start.

    A function that the call hands over comes first, then the one around it, then the one that an annotation stands on.
    """
    rows = model.events.where("kind in ('consume', 'schedule', 'listen', 'startup')")
    rows = cut(rows.withColumn("id", F.concat_ws("\u0001", "repo", "path", F.col("line").cast("string"), "kind", F.coalesce("name", F.lit("")))).dropDuplicates(["id"]))
    handed = _named(rows.select(F.concat_ws("\u0001", "id").alias("id"), "repo", "unit", "path", F.posexplode("callbacks").alias("pos", "name")), bodies).where("found is not null").groupBy("id").agg(F.min_by("found", "pos").alias("handed"))
    around = _located(rows.select("id", "repo", "path", "line"), bodies).select("id", F.col("node").alias("around"))
    below = rows.select("id", "repo", "path", "line").join(bodies.select("repo", "path", "start", "node"), ["repo", "path"]).where(F.col("start").between(F.col("line"), F.col("line") + NEAR)).groupBy("id").agg(F.min_by("node", F.struct("start", "node")).alias("below"))
    met = rows.join(handed, "id", "left").join(around, "id", "left").join(below, "id", "left").withColumn("node", F.coalesce("handed", "around", "below"))
    said = bodies.select("node", F.col("name").alias("function"))
    return met.join(said, "node", "left").select("id", "repo", "unit", "kind", "name", F.when(F.col("kind") == "listen", "").otherwise(F.col("bus")).alias("bus"), F.col("name").alias("topic"), "node", "path", "line", "function")


def budget(steps: DataFrame) -> DataFrame:
    """entry, participants, steps: adjacent equal steps as one, the first eight participants, at most 24 steps; the last
    synchronous reply stays. A flow's own steps, which the limits of the walk bound, are one array here."""
    whole = steps.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("order", "s"))).alias("a")).select("entry", F.transform("a", lambda x: x["s"]).alias("a"))
    same = lambda x, y: (x["from"] == y["from"]) & (x["to"] == y["to"]) & (x["kind"] == y["kind"]) & (x["label"] == y["label"])
    merged = F.filter("a", lambda x, i: (i == 0) | ~same(x, F.get("a", F.greatest(i - 1, F.lit(0)))))
    people = F.slice(F.array_distinct(F.flatten(F.transform("m", lambda s: F.array(s["from"], s["to"])))), 1, PARTICIPANTS)
    kept = F.filter("m", lambda s: F.array_contains("participants", s["from"]) & F.array_contains("participants", s["to"]))
    out = whole.withColumn("m", merged).withColumn("participants", people).withColumn("k", kept)
    replies = F.filter(F.transform("k", lambda s, i: F.when((s["kind"] == "reply") & ~s["async"], i)), lambda i: i.isNotNull())
    reply = F.array_max(replies)
    rest = F.filter("k", lambda s, i: ~i.eqNullSafe(F.col("r")))
    short = F.when(F.col("r").isNull(), F.slice("k", 1, STEPS)).otherwise(F.concat(F.slice(rest, 1, STEPS - 1), F.array(F.get("k", F.col("r")))))
    return out.withColumn("r", reply).select("entry", "participants", F.when(F.size("k") > STEPS, short).otherwise(F.col("k")).alias("steps"))


def flows(model: Model) -> DataFrame:
    """The flows worth drawing of every operation, consumer, listener and schedule, the best first."""
    c = F.col
    known = functions(model)
    inline = cut(_inline(model, known))
    bodies = cut(known.unionByName(inline.drop("id"), allowMissingColumns=True))
    does = cut(effects(model, bodies))
    starts = cut(consumers(model, bodies))
    asked = model.operations.select("id", "repo", "unit", c("file").alias("path"), c("handler").alias("name"), "line", "method", c("path").alias("route"), "response_type")
    handled = _named(asked, known).join(inline.select("repo", "id", c("node").alias("inline")), ["repo", "id"], "left")
    callers = model.client_calls.where("operation is not null").groupBy("repo", c("operation").alias("id")).agg(F.min("unit").alias("caller"))
    operations = handled.join(callers, ["repo", "id"], "left").withColumn("node", F.coalesce("found", "inline"))
    operations = cut(operations.select("repo", "id", "unit", "path", "line", "node", "caller", F.concat_ws(" ", "method", "route").alias("trigger"), F.coalesce("response_type", F.lit("response")).alias("answer")))
    remote = does.where("operation is not null").join(operations.select("repo", c("id").alias("operation"), c("node").alias("dst")), ["repo", "operation"]).where("dst is not null")
    edges = call_edges(model, bodies).select("src", "dst", "order", F.lit(False).alias("remote"), F.lit(None).cast("string").alias("via"))
    edges = cut(edges.unionByName(remote.select(c("node").alias("src"), "dst", "order", F.lit(True).alias("remote"), F.concat_ws("\u0001", "repo", "operation").alias("via"))))

    step = lambda frm, to, kind, label, operation, late, path, line: F.struct(frm.alias("from"), to.alias("to"), kind.alias("kind"), label.alias("label"), operation.alias("operation"), late.alias("async"), path.alias("path"), line.cast("int").alias("line")).alias("s")
    none = F.lit(None).cast("string")
    entry = F.concat_ws("\u0001", "repo", "id")
    own = operations.select(entry.alias("entry"), "*")
    sent = own.where("caller is not null")
    said = [
        sent.select("entry", _numbers(0).alias("order"), step(c("caller"), c("unit"), F.lit("call"), c("trigger"), c("id"), F.lit(False), c("path"), c("line"))),
        sent.select("entry", _numbers(2).alias("order"), step(c("unit"), c("caller"), F.lit("reply"), c("answer"), c("id"), F.lit(False), c("path"), c("line"))),
    ]
    background = starts.select(c("id").alias("entry"), "*").withColumnRenamed("id", "consumer")
    begun = own.select("entry", "node", _numbers(1).alias("order")).unionByName(background.select("entry", "node", _numbers(1).alias("order")))
    sections = begun.select("entry", F.array().cast("array<bigint>").alias("section"), "order", "node", F.lit(False).alias("late"))
    # a consumer's own flow doesn't deliver to itself
    followed = background.select("entry", "consumer")
    reached, parts = None, []
    for hop in range(HOPS + 1):
        walked = cut(walks.traverse(sections.select("entry", "node", "order"), edges, LOCAL, REMOTE, reached))
        parts.append(walked.select("entry", "node", "order"))
        reached = reduce(DataFrame.unionByName, parts)
        acted = cut(walked.select("entry", "node", c("order").alias("at"), "hops", "via").join(does, "node").withColumn("order", F.concat("at", "order")))
        late = F.lit(hop > 0)
        said.append(acted.select("entry", "order", step(c("unit"), c("to"), c("kind"), c("label"), c("operation"), late | (c("kind") == "event"), c("path"), c("line"))))
        answered = acted.where("operation is not null").join(operations.select("repo", c("id").alias("operation"), c("unit").alias("by"), "answer", c("path").alias("file"), c("line").alias("at_line")), ["repo", "operation"])
        answered = answered.where((c("hops") < REMOTE) & ~F.array_contains("via", F.concat_ws("\u0001", "repo", "operation")) & (c("entry") != F.concat_ws("\u0001", "repo", "operation")))
        said.append(answered.select("entry", F.concat("order", _numbers(LAST)).alias("order"), step(c("by"), c("unit"), F.lit("reply"), c("answer"), c("operation"), late, c("file"), c("at_line"))))
        if hop == HOPS:
            break
        # the part of a flow that a message belongs to is the longest section that begins its order
        of = acted.where("bus is not null").join(sections.select("entry", "section").distinct(), "entry").where(F.slice("order", F.lit(1), F.size("section")) == c("section"))
        of = of.groupBy("entry", "order", "repo", "unit", "to", "bus", "topic").agg(F.max_by("section", F.size("section")).alias("section"))
        scope = lambda c_: F.when(F.col("bus") == "", F.concat_ws("\u0001", "repo", "unit")).otherwise(F.col("repo")).alias(c_)
        sites = of.withColumn("id", F.struct("entry", "order", "to", "topic", "section", "unit"))
        met = walks.deliver(sites.select("id", scope("scope"), "bus", "topic"), starts.where("kind in ('consume', 'listen') and bus is not null").select(c("id").alias("consumer"), scope("scope"), "bus", "topic", F.struct("unit", "path", "line").alias("order")), CONSUMERS)
        met = met.select("id.*", "consumer", "n").withColumn("section", F.concat("section", _numbers(LAST), F.slice("order", F.size("section") + 1, F.size("order")), _numbers(c("n"))))
        fresh = met.join(followed, ["entry", "consumer"], "left_anti").groupBy("entry", "consumer").agg(F.min(F.struct("section", "to", "topic", c("unit").alias("by"))).alias("m")).select("entry", "consumer", "m.*")
        fresh = cut(fresh.join(starts.select(c("id").alias("consumer"), "unit", "node", "path", "line", "kind", "function"), "consumer"))
        if fresh.isEmpty():
            break
        followed = followed.unionByName(fresh.select("entry", "consumer"))
        label = F.when(c("kind") == "listen", F.concat_ws(" ", "topic", F.lit("→"), "function")).otherwise(F.concat_ws(" ", F.lit("delivers"), "topic"))
        said.append(fresh.select("entry", c("section").alias("order"), step(F.when(c("kind") == "listen", c("by")).otherwise(c("to")), c("unit"), F.lit("deliver"), label, none, F.lit(True), c("path"), c("line"))))
        sections = fresh.select("entry", "section", F.concat("section", _numbers(0)).alias("order"), "node", F.lit(True).alias("late"))
    drawn = budget(reduce(DataFrame.unionByName, said))
    used = reduce(DataFrame.unionByName, parts).join(bodies.select("node", F.concat("unit", F.lit(":"), "name").alias("f")), "node")
    used = used.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("order", "f"))).alias("u")).select("entry", F.array_distinct(F.transform("u", lambda x: x["f"])).alias("functions"))
    titles = own.select("entry", "repo", "id", "trigger", c("caller").isNotNull().alias("called"), F.lit(False).alias("background"))
    key = F.concat("unit", F.lit(":"), "kind", F.lit(" "), F.coalesce("name", F.lit("messages")))
    titles = titles.unionByName(background.select("entry", "repo", key.alias("id"), F.concat_ws(" ", "kind", F.coalesce("name", F.lit("messages"))).alias("trigger"), F.lit(False).alias("called"), F.lit(True).alias("background")))
    acts = F.size(F.filter("steps", lambda s: ~s["kind"].isin("reply", "deliver")))
    worth = F.when(c("background"), F.size("steps") >= 2).otherwise((acts >= 2) | (acts >= 1) & (F.size("participants") >= 3))
    out = titles.join(drawn, "entry").join(used, "entry", "left").where(worth)
    score = 4 * F.size("participants") + F.least(F.size("steps"), F.lit(STEPS)) + F.when(c("called"), 6).otherwise(0)
    told = out.select("repo", F.concat(F.lit("flow:"), "id").alias("id"), c("id").alias("entry"), "trigger", "participants", "steps", F.coalesce("functions", F.array().cast("array<string>")).alias("functions"), score.cast("long").alias("score"))
    return cut(told.orderBy(F.desc("score"), "id"))
