"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for every row.

A row's leaf is the hash of its fields (`-` for a null, else the number of UTF-8 bytes, a colon, the value). Within a
group leaves ascend by their key; FAN consecutive nodes of a level become one node of the next, until one is left. The
groups' last nodes, in order of the group (null first, then bytewise), are the leaves of the tree over them.

A level is one window: partitioned by group and parent index, ordered by index, its full frame collects a run's digests,
which are the parent's preimage and every node's siblings at once; the first node of each run stands for the parent in
the next level. So a window partition has FAN rows, however large the group. Places in a group come from a range
sort of (group, key): a row's number within its task, and sums of rows over tasks, of which there is one row for each
task and group in it. Paths go down again level by level, joined on group and parent, so a third of a row's path moves
for it at most.

Defined cases: rows without a group are a group of their own, the first; rows without a key come first in their group,
rows with one key by their leaf, equal rows in any order (they have the same fields, so any order gives the same rows);
an empty table has no rows and no root; a lone leaf is its group's node, a lone group's node the root, and the proof of
a tree of one leaf is the hash of nothing. A column to keep that is named
like an output column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import write_shared

FAN = 3
#: Levels after which paths on their way down are written, above the lowest ones.
CUT = 3


def field(value: Column) -> Column:
    """A value as a part of a leaf's preimage."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest, lower-case hex, of a row's fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _placed(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """`df` with `idx`, a row's place in its group, and `n`, the group's rows; written, so that places stay as they are."""
    # the last key only tells equal rows apart, so that they need not meet in one task
    order = [F.col(group), *order, F.monotonically_increasing_id()]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = write_shared(dealt, "merkle-leaves").withColumn("task", F.shiftright("at", 33))
    runs = rows.groupBy(group, "task").agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    runs = runs.select(group, "task", "low", (F.sum("rows").over(whole.orderBy("task")) - F.col("rows")).alias("before"), F.sum("rows").over(whole).alias("n"))
    return rows.join(runs, [group, "task"]).withColumn("idx", F.col("at") - F.col("low") + F.col("before")).drop("at", "task", "low", "before")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels of the trees whose leaves are `nodes` (grp, idx, n, digest), each written: grp, idx, n,
    `parent`, the parent's digest, and `step`, the siblings on either side. A group's only node isn't in them."""
    up = F.expr(f"idx div {FAN}")
    run = Window.partitionBy("grp", up).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = nodes.agg(F.max("n")).first()[0] or 0
    out: list[DataFrame] = []
    while most > 1 or not out:
        many = nodes.where("n > 1").withColumn("run", F.collect_list("digest").over(run))
        pos = F.pmod("idx", F.lit(FAN)).cast("int")
        step = F.struct(F.slice("run", F.lit(1), pos).alias("left"), F.slice("run", pos + 2, F.lit(FAN)).alias("right"))
        made = many.withColumns({"parent": F.unhex(F.sha2(F.array_join(F.transform("run", _hex), "").cast("binary"), 256)), "step": step}).drop("run", "digest")
        out.append(write_shared(made, "merkle-level"))
        nodes = out[-1].where(F.pmod("idx", F.lit(FAN)) == 0).select("grp", up.alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("parent").alias("digest"))
        most = -(-most // FAN)
    return out


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The last node of each group: grp, top."""
    tops = leaves.where("n = 1").select("grp", F.col("digest").alias("top"))
    for level in levels:
        tops = tops.unionByName(level.where((F.col("n") <= FAN) & (F.col("idx") == 0)).select("grp", F.col("parent").alias("top")))
    return tops


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Of every node of the lowest level, the steps from it to its group's last node (grp, idx, path), topped by `tops`'
    own columns but grp."""
    last = [c for c in tops.columns if c != "grp"]
    above = None
    for height, level in reversed(list(enumerate(levels))):
        own = level.select("grp", "idx", "n", "step", F.expr(f"idx div {FAN}").alias("up"))
        # a run that makes its group's last node has no path above it
        ends = own.where(F.col("n") <= FAN).join(tops, "grp").select("grp", "idx", F.array("step").alias("path"), *last)
        if above is not None:
            rest = own.where(F.col("n") > FAN).join(above.select("grp", F.col("idx").alias("up"), F.col("path").alias("path_up"), *last), ["grp", "up"])
            ends = ends.unionByName(rest.select("grp", "idx", F.concat(F.array("step"), "path_up").alias("path"), *last))
        # small plans: of the upper levels, whose rows are few, every third is written
        above = write_shared(ends, "merkle-paths") if height > CUT and height % CUT == 0 else ends
    return above


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and the steps of a path lead to, in lower-case hex."""
    join = lambda part: F.array_join(F.transform(part, _hex), "")
    return F.aggregate(path, digest, lambda at, step: F.sha2(F.concat(join(step["left"]), at, join(step["right"])).cast("binary"), 256))


def manifest(df: DataFrame, fields: list[str], group: str, key: str, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (else group and key) of every row, leaf, subroot (its group's), root, each lower-case hex, and
    `path`, the steps from leaf to root. Other columns are read for the leaf and then stay where they are."""
    kept = [c for c in keep or [group, key] if c.lower() not in ("leaf", "subroot", "root", "path")]
    # as a string that is never null: null sorts first, then bytewise
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{key}`").alias("key"), name.alias("grp"), F.unhex(leaf(*[F.col(f"`{c}`") for c in fields])).alias("digest"))
    leaves = _placed(write_shared(rows, "merkle-rows"), "grp", F.col("key").asc_nulls_first(), F.col("digest"))
    levels = _levels(leaves.select("grp", "idx", "n", "digest"))
    tops = write_shared(_tops(leaves, levels), "merkle-tops")
    over = _placed(tops.select(F.lit("").alias("all"), F.col("grp").alias("name"), F.col("top").alias("digest")), "all", F.col("name")).withColumnRenamed("all", "grp")
    higher = _levels(over.select("grp", "idx", "n", "digest"))
    root = _tops(over, higher).select("grp", F.col("top").alias("root"))
    steps = _paths(higher, root).select("idx", F.col("path").alias("higher"), "root")
    lone = over.where("n = 1").select("idx", F.array().cast(steps.schema["higher"].dataType).alias("higher"), F.col("digest").alias("root"))
    tops = write_shared(over.select("idx", F.col("name").alias("grp"), F.col("digest").alias("top")).join(steps.unionByName(lone), "idx").drop("idx"), "merkle-tops")
    paths = _paths(levels, tops)
    far = leaves.where("n > 1").join(paths, ["grp", "idx"]).select("row", "digest", F.concat("path", "higher").alias("path"), "top", "root")
    near = leaves.where("n = 1").join(tops, "grp").select("row", "digest", F.col("higher").alias("path"), "top", "root")
    return far.unionByName(near).select("row.*", _hex("digest").alias("leaf"), _hex("top").alias("subroot"), _hex("root").alias("root"), "path")


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(F.flatten(F.transform(path, lambda s: F.concat(s["left"], s["right"]))), _hex), "").cast("binary"), 256)
