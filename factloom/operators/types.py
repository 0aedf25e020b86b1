"""Names of types as they are written in a file: the class that each means, its ancestry, and values found along it.

Everything is an equi-join of distinct names with tables that are grouped first, so a name that very many files use and
a class that very many name are one row each. Nulls in a key meet nothing; a null package is the unnamed one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.cut import cut

_WRITTEN = ["scope", "unit", "path", "package", "name"]


def resolve(asked: DataFrame, classes: DataFrame, imports: DataFrame, never: Sequence[str] = ()) -> DataFrame:
    """Distinct scope, unit, path, package, name of `asked` with class, null where none answers.

    `classes` has scope, class (unique), name, package, unit; `imports` has scope, path, pos, specifier, which names a
    class (`a.b.C`) or a package (`a.b` or `a.b.*`). Every step sees only what those before it left: the only class of
    that name in the scope; one of the same package and unit; the first import by pos that has one; the only one of the
    unit. Ties in a step go to the least class. Names in `never` mean no class.
    """
    plain = F.coalesce("package", F.lit(""))
    want = asked.select(*_WRITTEN).distinct()
    own = classes.where("scope is not null and name is not null").select("scope", "class", "name", plain.alias("package"), "unit").distinct()
    open_ = want.where(~F.col("name").isin(*never)) if never else want
    every = own.groupBy("scope", "name").agg(F.count("*").alias("n"), F.min("class").alias("class"))
    met = cut(open_.withColumn("package", plain).distinct().join(every, ["scope", "name"]))
    rest = met.where("n > 1").drop("n", "class")
    near = own.groupBy("scope", "name", "package", "unit").agg(F.min("class").alias("near"))
    home = own.groupBy("scope", "name", "unit").agg(F.count("*").alias("k"), F.min("class").alias("home")).where("k = 1").drop("k")
    placed = own.groupBy("scope", "package", "name").agg(F.min("class").alias("class"))
    left = rest.join(near, ["scope", "name", "package", "unit"], "left")
    used = left.where("near is null").select("scope", "path", "name").distinct()
    said = imports.where("specifier is not null").select("scope", "path", "pos", F.regexp_replace("specifier", r"\.\*$", "").alias("whole"))
    single = said.select("scope", "path", "pos", F.regexp_extract("whole", r"^(.*)\.[^.]+$", 1).alias("package"), F.regexp_extract("whole", r"([^.]+)$", 1).alias("name"))
    several = said.select("scope", "path", "pos", F.col("whole").alias("package"))
    through = used.join(single, ["scope", "path", "name"]).unionByName(used.join(several, ["scope", "path"]))
    brought = through.join(placed, ["scope", "package", "name"]).groupBy("scope", "path", "name").agg(F.min_by("class", F.struct("pos", "class")).alias("brought"))
    late = left.join(brought, ["scope", "path", "name"], "left").join(home, ["scope", "name", "unit"], "left")
    found = met.where("n = 1").select(*_WRITTEN, "class").unionByName(late.select(*_WRITTEN, F.coalesce("near", "brought", "home").alias("class")))
    there = found.select(*[F.col(c).alias(f"_{c}") for c in _WRITTEN], "class")
    on = plain == F.col("_package")
    for c in ("scope", "unit", "path", "name"):
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return want.join(there, on, "left").select(*_WRITTEN, "class")


def ancestry(classes: DataFrame, imports: DataFrame, most: int = 5, never: Sequence[str] = ()) -> DataFrame:
    """class, names: a class's own name, its parent's as written, the parent's parent's and so on, `most` at the most.

    `classes` is as for :func:`resolve`, with path and parent (a name or null). A parent that no class answers is the
    last name. Classes may extend each other in a ring; the bound ends it.
    """
    asked = classes.where("parent is not null").select("scope", "unit", "path", "package", F.col("parent").alias("name"))
    met = resolve(asked, classes, imports, never).withColumnsRenamed({"name": "parent", "class": "up"}).select(*[F.col(c).alias(f"_{c}") for c in ("scope", "unit", "path", "package", "parent")], "up")
    on = F.lit(True)
    for c in ("scope", "unit", "path", "package", "parent"):
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    step = cut(classes.where("scope is not null").select("class", "name", "scope", "unit", "path", "package", "parent").distinct().join(met, on, "left").select("class", "name", "parent", "up"))
    above = step.select(F.col("class").alias("at"), F.col("parent").alias("_parent"), F.col("up").alias("_up"))
    out = step.select("class", F.array("name").alias("names"), F.col("parent").alias("next"), F.col("up").alias("at"))
    for _ in range(most - 1):
        names = F.when(F.col("next").isNull(), F.col("names")).otherwise(F.array_append("names", F.col("next")))
        out = out.withColumn("names", names).join(above, "at", "left").select("class", "names", F.col("_parent").alias("next"), F.col("_up").alias("at"))
    return out.select("class", "names")


def inherited(asked: DataFrame, classes: DataFrame, imports: DataFrame, known: DataFrame, local: DataFrame, every: DataFrame, most: int = 5, never: Sequence[str] = ()) -> DataFrame:
    """`asked` (id, scope, unit, path, package, name, home) with value: what the nearest name of its type's ancestry has.

    `known` (name, value) counts before `local` (scope, unit, name, value, ord), which is asked for the row's unit, and
    this before `every` (scope, name, value, ord); a name that has none leaves the answer to the next name above. Of
    several values of one name in `local` or `every` the first by ord counts. `home` is the unit from whose file the
    type is named; it decides what class is meant, `unit` what `local` says of it.
    """
    here = asked.select("scope", F.col("home").alias("unit"), "path", "package", "name")
    met = resolve(here, classes, imports, never).join(ancestry(classes, imports, most, never), "class", "left").select(*[F.col(c).alias(f"_{c}") for c in _WRITTEN], "names")
    on = F.col("home").eqNullSafe(F.col("_unit"))
    for c in ("scope", "path", "package", "name"):
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    lines = asked.join(met, on, "left").select("id", "scope", "unit", F.posexplode(F.coalesce("names", F.array("name"))).alias("up", "name"))
    one = local.groupBy("scope", "unit", "name").agg(F.min_by("value", F.struct("ord", "value")).alias("value"))
    any_ = every.groupBy("scope", "name").agg(F.min_by("value", F.struct("ord", "value")).alias("value"))
    first = known.groupBy("name").agg(F.min("value").alias("value"))
    hits = lines.join(first, "name").select("id", "up", F.lit(0).alias("tier"), "value")
    hits = hits.unionByName(lines.join(one, ["scope", "unit", "name"]).select("id", "up", F.lit(1).alias("tier"), "value"))
    hits = hits.unionByName(lines.join(any_, ["scope", "name"]).select("id", "up", F.lit(2).alias("tier"), "value"))
    best = hits.groupBy("id").agg(F.min_by("value", F.struct("up", "tier")).alias("value"))
    return asked.join(best, "id", "left")
