"""Aggregations: roll-ups, votes, ordered merges and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole; `empty` where the whole is 0."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(F.try_divide(part, whole))


def language_stats(files: DataFrame) -> DataFrame:
    """language, files, lines of `files` (language, line_count)."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))


def dominant(rows: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Each key's value of the greatest summed weight, the least value on a tie."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_w"), value))
    return sums.withColumn("_r", first).where("_r = 1").select(*keys, F.col(value).alias(out), F.col("_w").alias("weight"))


def census(rows: DataFrame, keys: Sequence[str], name: str, out: str = "census") -> DataFrame:
    """`3 Ruby, 1 Perl`: how often each name occurs in a key, the most frequent first, then by name."""
    counts = rows.groupBy(*keys, name).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(name).alias("name"))))
    said = F.array_join(F.transform(listed, lambda x: F.concat((-x["m"]).cast("string"), F.lit(" "), x["name"])), ", ")
    return counts.groupBy(*keys).agg(said.alias(out))


def merge_relationships(rows: DataFrame, most: int = 6) -> DataFrame:
    """One relationship for each (source, target) of `rows` (source, target, edge_type, label, origin, evidence, seq).

    Loops are dropped. The first row by seq gives type and label; the first row of origin `code` that isn't the first
    row overrides them and its evidence goes to the front; other rows append theirs. Evidence that repeats the one
    before it counts once, and `most` are kept. The fold of a pair is an ordered array, so its size is that of the
    pair's rows: pairs of very many rows should be thinned before, which :func:`thin` does without changing the result.
    """
    kept = thin(rows.where("source <> target"), most)
    entry = F.struct("seq", "edge_type", "label", "origin", "evidence")
    listed = kept.groupBy("source", "target").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    origins = rows.where("source <> target").groupBy("source", "target").agg(F.array_sort(F.collect_set("origin")).alias("sources"))
    code = F.array_position(F.transform("rows", lambda r: r["origin"]), "code").cast("int")
    lead = F.when(code > 0, F.element_at("rows", code)).otherwise(F.element_at("rows", 1))
    rest = F.when(code > 0, F.concat(F.array(F.element_at("rows", code)), F.slice("rows", 1, code - 1), F.slice("rows", code + 1, F.size("rows")))).otherwise(F.col("rows"))
    seen = F.transform(rest, lambda r: r["evidence"])
    adjacent = F.filter(seen, lambda e, i: (i == 0) | ~F.element_at(seen, F.greatest(i, F.lit(1))).eqNullSafe(e))
    merged = listed.select("source", "target", lead.alias("lead"), F.slice(adjacent, 1, most).alias("evidence")).join(origins, ["source", "target"])
    return merged.select("source", "target", F.col("lead.edge_type").alias("edge_type"), F.col("lead.label").alias("label"), "sources", "evidence")


def thin(rows: DataFrame, most: int = 6) -> DataFrame:
    """The rows of each pair that can show in its merged relationship.

    Only the first `most` + 1 rows that change the evidence, and the first `code` row, can: the code row moves to the
    front, and where it stood two equal neighbours may meet, which takes one more row.
    """
    w = Window.partitionBy("source", "target").orderBy("seq")
    changes = (~F.lag("evidence").over(w).eqNullSafe(F.col("evidence")) | (F.row_number().over(w) == 1)).cast("int")
    numbered = rows.withColumn("_n", F.sum(changes).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    numbered = numbered.withColumn("_c", F.min(F.when(F.col("origin") == "code", F.col("seq"))).over(Window.partitionBy("source", "target")))
    first = F.row_number().over(Window.partitionBy("source", "target", "_n").orderBy("seq"))
    numbered = numbered.withColumn("_f", first)
    return numbered.where(((F.col("_n") <= 2 * most + 3) & (F.col("_f") <= 2)) | (F.col("seq") == F.col("_c"))).drop("_n", "_c", "_f")


def vote(rows: DataFrame, keys: Sequence[str], choice: str, weight: Column, out: str = "choice") -> DataFrame:
    """Each key's choice of the most weight, the least one on a tie, with its votes."""
    sums = rows.groupBy(*keys, choice).agg(F.sum(weight).alias("votes"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), choice))
    return sums.withColumn("_r", first).where("_r = 1").select(*keys, F.col(choice).alias(out), "votes")


def matrix(rows: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], cell: Column) -> DataFrame:
    """A pivot to the given values, absent cells 0."""
    return rows.groupBy(*keys).pivot(column, list(values)).agg(cell).fillna(0, list(values))


def score(ratios: Sequence[Column]) -> Column:
    """floor(100 mean) of the ratios that aren't null; null if none is."""
    given = F.filter(F.array(*ratios), lambda x: x.isNotNull())
    return F.when(F.size(given) > 0, F.floor(F.lit(100) * F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given)))


def weakest(ratios: dict[str, Column]) -> Column:
    """The name of the least ratio that isn't null, the first in the order given on a tie."""
    named = F.array(*[F.struct(r.alias("r"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, r) in enumerate(ratios.items())])
    return F.array_min(F.filter(named, lambda x: x["r"].isNotNull()))["n"]


def density(nodes: Column, edges: Column) -> Column:
    """(nodes + edges) / 80 to three places: a figure has 80 cells."""
    return F.round((nodes + edges) / F.lit(80.0), 3)


def catalogue(rows: DataFrame, keys: Sequence[str], order: Sequence, out: str = "first") -> DataFrame:
    """Distinct keys with the first row's evidence: `rows` has `evidence`."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_r", first).where("_r = 1").select(*keys, F.col("evidence").alias(out))


def merge_entities(rows: DataFrame) -> DataFrame:
    """One entity for each (entity, table) of `rows` (table, unit, source, physical, pos, columns).

    A table is split by unit only if several units declare it in code and none physically. The base is the physical
    declaration of the best source with columns, else the first in code; without either there is no entity. Columns
    of other declarations match by name, letter case and `_` ignored: they add references and defaults that lack,
    and are appended only if the base isn't physical. `source` joins the distinct sources by `+`.
    """
    rank = F.when(F.col("source") == "ddl", 0).when(F.col("source").isin("alembic", "liquibase"), 1).when(F.col("source") == "diesel", 2).otherwise(3)
    per_table = rows.groupBy("table").agg(F.countDistinct(F.when(~F.col("physical"), F.col("unit"))).alias("units"), F.bool_or("physical").alias("any"))
    keyed = rows.join(per_table, "table").withColumn("entity", F.when((F.col("units") > 1) & ~F.col("any"), F.concat(F.lit("entity:"), "unit", F.lit("."), "table")).otherwise(F.concat(F.lit("entity:"), "table")))
    order = F.struct((~(F.col("physical") & (F.size("columns") > 0))).cast("int").alias("p"), rank.alias("r"), F.col("pos").alias("pos"))
    listed = keyed.groupBy("entity", "table").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "physical", "source", "columns"))).alias("d"), F.array_sort(F.collect_set("unit")).alias("declared_by"))
    plain = lambda c: F.lower(F.replace(c["name"], F.lit("_"), F.lit("")))
    base = F.element_at("d", 1)
    others = F.flatten(F.transform(F.slice("d", 2, F.size("d")), lambda x: x["columns"]))
    filled = F.transform(base["columns"], lambda c: F.aggregate(
        others, c, lambda a, o: F.when(plain(o) == plain(c), a.withField("references", F.coalesce(a["references"], o["references"])).withField("default", F.coalesce(a["default"], o["default"]))).otherwise(a)
    ))
    known = F.transform(base["columns"], plain)
    more = F.aggregate(others, F.slice(base["columns"], 1, 0), lambda a, o: F.when(F.array_contains(known, plain(o)) | F.exists(a, lambda x: plain(x) == plain(o)), a).otherwise(F.array_append(a, o)))
    columns = F.when(base["physical"], filled).otherwise(F.concat(filled, more))
    return listed.select("entity", "table", F.array_join(F.array_distinct(F.transform("d", lambda x: x["source"])), "+").alias("source"), "declared_by", columns.alias("columns")).where(F.size("columns") > 0)


def busiest(units: DataFrame, scope: str = "repo") -> DataFrame:
    """scope, id: the unit worth a look inside, of `units` (scope, id, modules, service, degree, lines).

    One with four modules or more before others, then a deployed service, then the most connected, then the longest,
    then the least id. Nulls count as zero or false.
    """
    rank = F.struct(-(F.coalesce("modules", F.lit(0)) >= 4).cast("int"), -F.coalesce("service", F.lit(False)).cast("int"), -F.coalesce("degree", F.lit(0)).cast("long"), -F.coalesce("lines", F.lit(0)).cast("long"), "id")
    return units.groupBy(scope).agg(F.min_by("id", rank).alias("id"))


def contracts(operations: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, operations, typed, partial, opaque, excluded of `operations` (keys, confidence) and `excluded` (keys).

    A confidence that is neither typed nor partial is opaque. Keys that only one side has count zero on the other.
    """
    told = operations.select(*keys, F.coalesce("confidence", F.lit("opaque")).alias("c"), F.lit(0).alias("x"))
    both = told.unionByName(excluded.select(*keys, F.lit(None).cast("string").alias("c"), F.lit(1).alias("x")))
    typed, part = F.count_if(F.col("c") == "typed"), F.count_if(F.col("c") == "partial")
    return both.groupBy(*keys).agg(F.count("c").alias("operations"), typed.alias("typed"), part.alias("partial"), (F.count("c") - typed - part).alias("opaque"), F.sum("x").alias("excluded"))
