"""Constraint checks over diagram nodes and edges: every check is a query that returns its violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import graphs, joins

#: Limits of a diagram; fixed values.
MAX_ID, MAX_FOCAL, MAX_PRIMARY, DENSITY_BUDGET = 80, 2, 6, 32
MAX_PARTICIPANTS, MAX_MESSAGES, MAX_ATTRIBUTES = 8, 30, 16
LABELS = {"node": 32, "edge": 32, "subtitle": 64, "tech": 40, "title": 80}


def _found(rows: DataFrame, code: str, message: Column, ids: Column, severity: str | None = None, suggestions: Column | None = None) -> DataFrame:
    return rows.select(
        "diagram", F.lit(code).alias("code"), F.lit(severity or ("warning" if code.startswith("WARN") else "error")).alias("severity"), message.alias("message"), F.array(ids).alias("element_ids"),
        (suggestions if suggestions is not None else F.array().cast("array<string>")).alias("suggestions"),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def id_checks(containers: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that aren't well formed or that several elements of a diagram share."""
    ids = _all([x.select("diagram", "id") for x in (containers, nodes, edges)])
    odd = ids.where(F.col("id").isNull() | ~F.col("id").rlike("^[A-Za-z0-9][A-Za-z0-9_.-]*$") | (F.length("id") > MAX_ID))
    twice = ids.groupBy("diagram", "id").agg(F.count("*").alias("n")).where("n > 1")
    return _all([
        _found(odd, "ERR_INVALID_ID", F.concat(F.lit("invalid id "), F.coalesce("id", F.lit(""))), F.coalesce("id", F.lit(""))),
        _found(twice, "ERR_DUPLICATE_ID", F.concat(F.lit("duplicate id "), "id"), F.col("id")),
    ])


def container_checks(containers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes in unknown containers, with the nearest known name, and containers without nodes."""
    known = containers.select("diagram", F.col("id").alias("container_id"))
    lost = nodes.where("container_id is not null").join(known, ["diagram", "container_id"], "left_anti")
    lost = joins.nearest_name(lost.withColumn("name", F.col("container_id")), containers.select(F.col("id").alias("name")))
    empty = containers.join(nodes.select("diagram", F.col("container_id").alias("id")), ["diagram", "id"], "left_anti")
    return _all([
        _found(lost, "ERR_UNKNOWN_CONTAINER", F.concat(F.lit("unknown container "), "container_id"), F.col("id"), suggestions=F.array_compact(F.array("suggestion"))),
        _found(empty, "WARN_EMPTY_CONTAINER", F.concat(F.lit("container without nodes "), "id"), F.col("id")),
    ])


def edge_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints that don't exist, loops, edges that repeat an earlier one, and nodes without edges."""
    known = nodes.select("diagram", F.col("id").alias("end"))
    ends = edges.select("diagram", "id", F.explode(F.array_distinct(F.array("source", "target"))).alias("end"))
    missing = ends.join(known, ["diagram", "end"], "left_anti")
    loops = edges.where("source = target")
    w = Window.partitionBy("diagram", "source", "target").orderBy("pos")
    again = edges.withColumn("_r", F.row_number().over(w)).withColumn("_f", F.first("id").over(w)).where("_r > 1")
    orphans = nodes.join(edges.select("diagram", F.explode(F.array("source", "target")).alias("id")), ["diagram", "id"], "left_anti")
    return _all([
        _found(missing, "ERR_MISSING_ENDPOINT", F.concat(F.lit("no node "), "end"), F.col("id")),
        _found(loops, "ERR_SELF_LOOP", F.lit("an edge from a node to itself"), F.col("id")),
        _found(again, "WARN_DUPLICATE_EDGE", F.concat(F.lit("repeats "), "_f"), F.col("id")),
        _found(orphans, "ERR_ORPHAN_NODE", F.lit("no edge reaches this node"), F.col("id")),
    ])


def cycle_checks(edges: DataFrame) -> DataFrame:
    """Cycles none of whose edges has a label: one finding for each strong component, by its least node."""
    tagged = edges.select("diagram", F.concat_ws("\u0001", "diagram", "source").alias("src"), F.concat_ws("\u0001", "diagram", "target").alias("dst"), "label")
    parts = graphs.strong_components(tagged)
    a, b = parts.select(F.col("node").alias("src"), F.col("component").alias("ca")), parts.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    inside = tagged.where("src <> dst").join(a, "src").join(b, "dst").where("ca = cb").groupBy("diagram", "ca").agg(F.count("label").alias("labels"))
    return _found(inside.where("labels = 0"), "ERR_UNLABELED_CYCLE", F.lit("a cycle without a label"), F.element_at(F.split("ca", "\u0001"), -1))


def focus_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Too many or no focal nodes; too many primary edges, or primary edges that don't hang together."""
    focal = nodes.groupBy("diagram").agg(F.sum(F.col("is_key_focal_point").cast("int")).alias("n"))
    primary = edges.groupBy("diagram").agg(F.sum(F.col("is_primary_path").cast("int")).alias("n"), F.count("*").alias("all"))
    limit = F.greatest(F.lit(1), F.least(F.lit(MAX_PRIMARY), F.ceil(F.col("all") / 2).cast("int")))
    main = edges.where("is_primary_path").select("diagram", F.concat_ws("\u0001", "diagram", "source").alias("src"), F.concat_ws("\u0001", "diagram", "target").alias("dst"))
    parts = graphs.weak_components(main).select(F.element_at(F.split("node", "\u0001"), 1).alias("diagram"), "component").groupBy("diagram").agg(F.countDistinct("component").alias("n"))
    return _all([
        _found(focal.where(f"n > {MAX_FOCAL}"), "ERR_ACCENT_OVERUSE", F.concat("n", F.lit(" focal nodes")), F.lit("")),
        _found(focal.where("n = 0"), "WARN_NO_FOCAL_POINT", F.lit("no focal node"), F.lit("")),
        _found(primary.where(F.col("n") > limit), "ERR_PRIMARY_PATH_OVERUSE", F.concat("n", F.lit(" primary edges")), F.lit("")),
        _found(parts.where("n > 1"), "WARN_PRIMARY_PATH_BROKEN", F.lit("the primary path is in several pieces"), F.lit("")),
    ])


def density_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Diagrams of more nodes and edges than the budget."""
    n = nodes.groupBy("diagram").agg(F.count("*").alias("nodes")).join(edges.groupBy("diagram").agg(F.count("*").alias("edges")), "diagram", "full_outer").fillna(0)
    over = n.where(F.col("nodes") + F.col("edges") > DENSITY_BUDGET)
    return _found(over, "WARN_HIGH_DENSITY", F.concat((F.col("nodes") + F.col("edges") - DENSITY_BUDGET).cast("string"), F.lit(" elements over the budget")), F.lit(""))


def label_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels longer than their place."""
    named = _all([
        nodes.select("diagram", "id", F.lit("node").alias("k"), F.col("label").alias("v")), nodes.select("diagram", "id", F.lit("subtitle").alias("k"), F.col("subtitle").alias("v")),
        nodes.select("diagram", "id", F.lit("tech").alias("k"), F.col("tech_stack").alias("v")), edges.select("diagram", "id", F.lit("edge").alias("k"), F.col("label").alias("v")),
    ])
    most = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])
    return _found(named.where(F.length("v") > most[F.col("k")]), "WARN_LABEL_TOO_LONG", F.concat("k", F.lit(" label of "), F.length("v").cast("string"), F.lit(" characters")), F.col("id"))


def sequence_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sequence diagrams: too many participants or messages; message numbers that lack or repeat."""
    participants = nodes.groupBy("diagram").agg(F.count("*").alias("n"))
    messages = edges.groupBy("diagram").agg(F.count("*").alias("n"))
    twice = edges.where("sequence is not null").withColumn("_n", F.count("*").over(Window.partitionBy("diagram", "sequence"))).where("_n > 1")
    return _all([
        _found(participants.where(f"n > {MAX_PARTICIPANTS}"), "ERR_TOO_MANY_PARTICIPANTS", F.concat("n", F.lit(" participants")), F.lit("")),
        _found(messages.where(f"n > {MAX_MESSAGES}"), "ERR_TOO_MANY_MESSAGES", F.concat("n", F.lit(" messages")), F.lit("")),
        _found(edges.where("sequence is null"), "ERR_SEQUENCE_MISSING", F.lit("a message without a number"), F.col("id")),
        _found(twice, "ERR_SEQUENCE_DUPLICATE", F.concat(F.lit("message number "), "sequence", F.lit(" repeats")), F.col("id")),
    ])


def lifecycle_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lifecycles: no initial state, terminal states that lead on, states that no initial one reaches, moves without a label."""
    start = nodes.where("state_kind = 'initial'")
    none = nodes.select("diagram").distinct().join(start.select("diagram").distinct(), "diagram", "left_anti")
    ends = edges.join(nodes.where("state_kind = 'terminal'").select("diagram", F.col("id").alias("source")), ["diagram", "source"], "left_semi")
    key = lambda c: F.concat_ws("\u0001", "diagram", c)
    reach = graphs.closure(edges.select(key("source").alias("src"), key("target").alias("dst")))
    got = reach.join(start.select(key("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("k")).unionByName(start.select(key("id").alias("k"))).distinct()
    lost = nodes.join(start.select("diagram").distinct(), "diagram", "left_semi").withColumn("k", key("id")).join(got, "k", "left_anti")
    return _all([
        _found(none, "ERR_NO_INITIAL_STATE", F.lit("no initial state"), F.lit("")),
        _found(ends, "ERR_TERMINAL_HAS_TRANSITIONS", F.lit("a terminal state leads on"), F.col("id")),
        _found(lost, "WARN_UNREACHABLE_STATE", F.lit("no initial state reaches this one"), F.col("id")),
        _found(edges.where("label is null or label = ''"), "WARN_UNLABELED_TRANSITION", F.lit("a transition without a label"), F.col("id")),
    ])


def entity_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entity diagrams: entities without columns or with too many, references without a cardinality; nodes have `attributes`, a number."""
    return _all([
        _found(nodes.where("coalesce(attributes, 0) = 0"), "WARN_ENTITY_WITHOUT_ATTRIBUTES", F.lit("an entity without columns"), F.col("id")),
        _found(nodes.where(f"attributes > {MAX_ATTRIBUTES}"), "ERR_TOO_MANY_ATTRIBUTES", F.concat(F.col("attributes").cast("string"), F.lit(" columns")), F.col("id")),
        _found(edges.where("cardinality is null"), "WARN_MISSING_CARDINALITY", F.lit("a reference without a cardinality"), F.col("id")),
    ])


def remedies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What makes a dense diagram lighter: diagram, saves, text, taken while what the ones before it save is below the excess.

    Nodes with the same neighbours become one; leaves off the primary path go, half the excess of them at most.
    """
    from factloom.operators.windows import greedy_cover

    size = nodes.groupBy("diagram").agg(F.count("*").alias("n")).join(edges.groupBy("diagram").agg(F.count("*").alias("e")), "diagram", "full_outer").fillna(0)
    over = size.withColumn("excess", F.col("n") + F.col("e") - DENSITY_BUDGET).where("excess > 0").select("diagram", "excess")
    key = lambda c: F.concat_ws("\u0001", "diagram", c)
    near = graphs.neighbourhoods(edges.select(key("source").alias("src"), key("target").alias("dst")))
    alike = near.groupBy("neighbours").agg(F.count("*").alias("k"), F.min("node").alias("first")).where("k >= 2")
    alike = alike.select(F.element_at(F.split("first", "\u0001"), 1).alias("diagram"), ((F.col("k") - 1) * (1 + F.size("neighbours"))).alias("saves"), F.concat(F.col("k").cast("string"), F.lit(" nodes like "), F.element_at(F.split("first", "\u0001"), 2), F.lit(" as one")).alias("text"))
    main = edges.where("is_primary_path").select("diagram", F.explode(F.array("source", "target")).alias("id")).distinct()
    degree = graphs.degrees(edges.select(key("source").alias("a"), key("target").alias("b")), "a", "b").select(F.element_at(F.split("node", "\u0001"), 1).alias("diagram"), F.element_at(F.split("node", "\u0001"), 2).alias("id"), "degree")
    leaves = nodes.join(degree, ["diagram", "id"], "left").where("coalesce(degree, 0) <= 1").join(main, ["diagram", "id"], "left_anti").join(over, "diagram")
    nth = F.row_number().over(Window.partitionBy("diagram").orderBy("id"))
    leaves = leaves.withColumn("_n", nth).where(F.col("_n") <= F.ceil(F.col("excess") / 2)).select("diagram", F.lit(2).alias("saves"), F.concat(F.lit("leave out "), "id").alias("text"))
    every = alike.select("diagram", F.col("saves").cast("long").alias("saves"), "text").unionByName(leaves.select("diagram", F.col("saves").cast("long").alias("saves"), "text")).join(over, "diagram")
    return greedy_cover(every, ["diagram"], [F.desc("saves"), "text"], "saves", F.col("excess")).select("diagram", "saves", "text")


def evidence_checks(cited: DataFrame, files: DataFrame, hunks: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """`cited` (id, repo, path, start, end, symbol) with the state of each citation, the first that applies.

    outside-repo, file-missing, line-out-of-range, symbol-mismatch, untracked, stale (a changed range of the file
    overlaps it, or its pinned commit is gone), verified. `files` has repo, path, lines (array), tracked; `hunks` repo,
    path, lo, hi; `pins` repo, commit_exists.
    """
    known = files.select("repo", "path", "lines", "tracked")
    met = cited.join(known, ["repo", "path"], "left")
    spans = cited.select(F.concat_ws("\u0001", "repo", "path").alias("scope"), F.col("id").alias("aid"), F.col("start").alias("alo"), F.col("end").alias("ahi")).where("alo > 0 and ahi >= alo")
    changed = hunks.select(F.concat_ws("\u0001", "repo", "path").alias("scope"), F.col("lo").alias("bid"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    stale = joins.overlapping(spans, changed, "scope", 64).select(F.col("aid").alias("id"), F.lit(True).alias("overlaps")).distinct()
    met = met.join(stale, "id", "left")
    met = met.join(pins, "repo", "left") if pins is not None else met.withColumn("commit_exists", F.lit(True))
    part = F.element_at(F.split("symbol", r"[.:]+"), -1)
    shown = F.slice("lines", F.greatest("start", F.lit(1)), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0)))
    outside = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    state = (
        F.when(outside, "outside-repo").when(F.col("lines").isNull(), "file-missing")
        .when((F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("end") > F.size("lines")), "line-out-of-range")
        .when(F.col("symbol").isNotNull() & ~F.coalesce(F.exists(shown, lambda x: F.contains(x, part)), F.lit(False)), "symbol-mismatch")
        .when(~F.coalesce("tracked", F.lit(True)), "untracked").when(F.coalesce("commit_exists", F.lit(True)) == F.lit(False), "stale")
        .when(F.coalesce("overlaps", F.lit(False)), "stale").otherwise("verified")
    )
    return met.select(*cited.columns, state.alias("state"))


def validate(containers: DataFrame, nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """All findings on diagrams in order of severity, path and code; `strict` makes warnings errors."""
    of = lambda rows, kind: rows.where(F.col("diagram_type") == kind)
    found = _all([
        id_checks(containers, nodes, edges), container_checks(containers, nodes), edge_checks(nodes, edges), cycle_checks(edges), focus_checks(nodes, edges), density_checks(nodes, edges), label_checks(nodes, edges),
        sequence_checks(of(nodes, "sequence"), of(edges, "sequence")), lifecycle_checks(of(nodes, "lifecycle"), of(edges, "lifecycle")), entity_checks(of(nodes, "entity-relationship"), of(edges, "entity-relationship")),
    ])
    if strict:
        found = found.withColumn("severity", F.lit("error"))
    return found.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "diagram", "code", "element_ids")
