"""Window-like operators; every one states the order that decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_definition(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key by `order`, which must be total within a key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def collapse_adjacent(rows: DataFrame, scope: Sequence[str], order: Sequence, same: Sequence[str]) -> DataFrame:
    """Rows that differ from the row before them in one of `same`; nulls equal nulls, and the first of a run stays."""
    w = Window.partitionBy(*scope).orderBy(*order)
    now = F.struct(*same)
    return rows.withColumn("_p", F.lag(F.struct(F.lit(1), now.alias("v"))).over(w)).where(F.col("_p").isNull() | ~F.col("_p.v").eqNullSafe(now)).drop("_p")


def greedy_cover(rows: DataFrame, scope: Sequence[str], order: Sequence, saves: str, excess: Column) -> DataFrame:
    """Rows in order for as long as what the rows before them save is below `excess`; one at least."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(saves).over(w) - F.col(saves)
    return rows.withColumn("_b", before).where((F.col("_b") < excess) | (F.col("_b") == 0)).withColumn("covered", F.col("_b") + F.col(saves)).drop("_b")


def carry_forward(rows: DataFrame, scope: Sequence[str], order: Sequence, value: Column, out: str) -> DataFrame:
    """`out`: the last value that isn't null, of this row or one before it."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def disambiguate(rows: DataFrame, scope: Sequence[str], id_col: str, order: Sequence) -> DataFrame:
    """The n-th row of an id, n from 2, gets the id `id-n`."""
    n = F.row_number().over(Window.partitionBy(*scope, id_col).orderBy(*order))
    return rows.withColumn(id_col, F.when(n == 1, F.col(id_col)).otherwise(F.concat_ws("-", id_col, n.cast("string"))))


def chunked(rows: DataFrame, scope: Sequence[str], order: Sequence, size: int = 12, out: str = "chunk") -> DataFrame:
    """`out`: the number, from 1, of the run of `size` rows in order that the row is in."""
    return rows.withColumn(out, (F.floor((F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1) / size) + 1).cast("int"))


def shortest_suffix(rows: DataFrame, group: str, path: str, sep: str = "/") -> DataFrame:
    """`suffix`: as few last parts of the path as tell all paths of its group apart, one at least; whole paths else.

    Paths with the same parts are one path, whatever separators they repeat or end with.
    """
    parts = F.filter(F.split(path, sep), lambda p: p != "")
    deep = rows.select(group, parts.alias("_s")).distinct()
    # a path shorter than k takes part with all of its parts
    most = deep.groupBy(group).agg(F.max(F.size("_s")).alias("most"), F.count("*").alias("paths"))
    every = deep.join(most, group).withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest("most", F.lit(1)))))
    tail = F.array_join(F.slice("_s", F.greatest(F.size("_s") - F.col("k") + 1, F.lit(1)), F.greatest(F.col("k"), F.lit(0))), sep)
    ok = every.groupBy(group, "k", "paths").agg(F.countDistinct(tail).alias("d")).where("d = paths").groupBy(group).agg(F.min("k").alias("_k"))
    own = F.filter(F.split(path, sep), lambda p: p != "")
    keep = F.greatest(F.lit(1), F.least(F.coalesce("_k", F.size(own)), F.size(own)))
    suffix = F.when(F.size(own) == 0, F.lit("")).otherwise(F.array_join(F.slice(own, -keep, keep), sep))
    return rows.join(ok, group, "left").withColumn("suffix", suffix).drop("_k")


def repeated(rows: DataFrame, keys: Sequence[str], order: Sequence, id_col: str) -> DataFrame:
    """Rows after the first of their key, with `first_id`, the id of the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).withColumn("first_id", F.first(id_col).over(w)).where("_r > 1").drop("_r")


def nearest_before(rows: DataFrame, marks: DataFrame, scope: Sequence[str], at: str, value: str) -> DataFrame:
    """`rows` with the value of the last mark strictly before them in their scope, else null.

    Rows and marks are one ordered stream in which the last mark is carried forward, so nothing is compared by range.
    """
    both = rows.select(*rows.columns, F.lit(None).cast(dict(marks.dtypes)[value]).alias("_v"), F.lit(0).alias("_k")).unionByName(
        marks.select(*scope, F.col(at), F.col(value).alias("_v"), F.lit(1).alias("_k")), allowMissingColumns=True
    )
    w = Window.partitionBy(*scope).orderBy(at, "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_k = 0").drop("_k", "_v")


def suppress_after(rows: DataFrame, scope: Sequence[str], at: str, kind: str, lines: int = 3) -> DataFrame:
    """Rows less reads at most `lines` after a write of their scope: they are the same statement."""
    w = Window.partitionBy(*scope).orderBy(at, F.when(F.col(kind) == "write", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col(kind) == "write", F.col(at)), ignorenulls=True).over(w)
    return rows.withColumn("_w", last).where((F.col(kind) != "read") | F.col("_w").isNull() | (F.col(at) - F.col("_w") > lines)).drop("_w")


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence, most: int, out: str = "rank") -> DataFrame:
    """The first `most` rows of each key; `order` must be total within a key."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= most)
