"""Set operators: keyed differences, field differences, drift and conformance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_diff(base: DataFrame, head: DataFrame, keys: Sequence[str], compare: Sequence[str] = ()) -> DataFrame:
    """keys, verb (added, removed, changed), and before and after of each compared column; rows that agree are left out.

    `ordinal` gives the order of a report: added, removed, changed, each by key. Without columns to compare nothing
    is ever changed. Keys are unique on either side; nulls equal nulls.
    """
    b = base.select(*[F.col(k).alias(f"_b{k}") for k in keys], *[F.col(c).alias(f"{c}_before") for c in compare], F.lit(1).alias("_b"))
    h = head.select(*[F.col(k).alias(f"_h{k}") for k in keys], *[F.col(c).alias(f"{c}_after") for c in compare], F.lit(1).alias("_h"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_b{k}").eqNullSafe(F.col(f"_h{k}"))
    met = b.join(h, on, "full_outer")
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    verb = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(differs, "changed")
    out = met.withColumn("verb", verb).where("verb is not null").withColumn("ordinal", F.when(F.col("verb") == "added", 0).when(F.col("verb") == "removed", 1).otherwise(2))
    chosen = [F.when(F.col("_h").isNull(), F.col(f"_b{k}")).otherwise(F.col(f"_h{k}")).alias(k) for k in keys]
    return out.select(*chosen, "verb", "ordinal", *[f"{c}_{w}" for c in compare for w in ("before", "after")])


def gains_and_losses(rows: DataFrame, before: str, after: str) -> DataFrame:
    """`gains` and `losses`: sorted distinct elements that only the array `after` or `before` has; a null array is empty."""
    a, b = (F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in (before, after))
    return rows.withColumn("gains", F.array_sort(F.array_except(b, a))).withColumn("losses", F.array_sort(F.array_except(a, b)))


def drift(calls: DataFrame, operations: DataFrame) -> DataFrame:
    """`calls` (operation, reads) with drift: fields read that the operation's response (fields) doesn't declare, sorted.

    Null where the operation is unknown or declares no fields: then nothing can be said.
    """
    met = calls.join(operations.select("operation", "fields"), "operation", "left")
    said = F.col("fields").isNotNull() & (F.size("fields") > 0)
    return met.withColumn("drift", F.when(said, F.array_sort(F.array_except(F.array_distinct("reads"), "fields")))).drop("fields")


def conform(declared: DataFrame, implemented: DataFrame, scope: str | None = None) -> DataFrame:
    """verdict of every declared and implemented endpoint: matched, partial, missing, unrequested or not-checkable.

    `declared` has method, path, statuses; `implemented` method, path, statuses and pos, of which the last of a
    (method, path) counts. Paths are compared with their parameters made alike. Declared rows without a method or
    path are not checkable; a hit is partial if a declared status isn't among the implemented ones. With `scope`, a
    column of both, only endpoints of one scope meet, and it leads the result.
    """
    from factloom.functions.text import same_params

    area = (F.col(scope) if scope else F.lit(0)).alias("_s")
    d = declared.select("*", area).withColumn("_m", F.upper("method")).withColumn("_p", same_params(F.col("path")))
    i = implemented.select("*", area).withColumn("_m", F.upper("method")).withColumn("_p", same_params(F.col("path")))
    i = i.groupBy("_s", "_m", "_p").agg(F.max_by(F.struct(F.col("method").alias("m"), F.col("path").alias("p"), F.col("statuses").alias("s")), "pos").alias("own"))
    d = d.select("_s", "_m", "_p", F.struct("method", "path", "statuses").alias("said"))
    bad = d.where("_m is null or _p is null").select("_s", "said", F.lit(None).cast(i.schema["own"].dataType).alias("own"), F.lit("not-checkable").alias("verdict"))
    met = d.where("_m is not null and _p is not null").join(i, ["_s", "_m", "_p"], "full_outer")
    short = F.size(F.array_except(F.coalesce("said.statuses", F.array().cast("array<int>")), F.coalesce("own.s", F.array().cast("array<int>")))) > 0
    verdict = F.when(F.col("said").isNull(), "unrequested").when(F.col("own").isNull(), "missing").when(short, "partial").otherwise("matched")
    out = met.select("_s", "said", "own", verdict.alias("verdict")).unionByName(bad)
    lead = [F.col("_s").alias(scope)] if scope else []
    return out.select(*lead, F.coalesce("said.method", "own.m").alias("method"), F.coalesce("said.path", "own.p").alias("path"), "verdict", F.col("said.statuses").alias("declared"), F.col("own.s").alias("observed"))


def superseded(tables: DataFrame, used: DataFrame, scope: str = "repo") -> DataFrame:
    """Distinct scope, table of `tables` (scope, table, written) that a code table of the same singular name replaced.

    Such a table is `written` only in migrations and `used` (scope, table) doesn't name it. A name's singular takes one
    `s` from the end of every part between `_` that keeps three letters or more.
    """
    singular = F.array_join(F.transform(F.split("table", "_"), lambda p: F.when(p.endswith("s") & (F.length(p) > 3), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)), "_")
    named = tables.where("table is not null").withColumn("one", singular)
    coded = named.where("not written").select(scope, "one").distinct()
    return named.where("written").join(coded, [scope, "one"], "left_semi").join(used.select(scope, "table"), [scope, "table"], "left_anti").select(scope, "table").distinct()
